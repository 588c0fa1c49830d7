"""Operators that SQL cannot express, against plain Python on a small table."""

import hashlib
import math
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from factorspark.llm import elias_fano, ngram_lm, packing, pii, sharding
from factorspark.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def documents(spark):
    return [r.asDict() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def test_language_model(spark, documents):
    end, single, double = "\0", Counter(), Counter()
    texts = {d["doc_id"]: [*words(d["text"]), end] for d in documents}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in texts}
    for k, w in texts.items():
        if not held[k]:
            single.update(w)
            double.update(zip([end, *w], w, strict=False))
    n, v, part = sum(single.values()), len(single), ngram_lm.LAMBDA
    for r in QUERIES["op1_elias_fano_lm"](spark, SMALL).collect():
        w = texts[r["doc_id"]]
        alone = [(single[x] + 1) / (n + v + 1) for x in w]
        both = [part * double[a, b] / single[a] + (1 - part) * p if single[a] else p for a, b, p in zip([end, *w], w, alone, strict=False)]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(w), sum(single[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(map(math.log10, alone)), abs_tol=1e-6)
        assert abs(r["score"] - sum(map(math.log10, both))) < 3e-4 * len(w)  # quantisation


def test_language_model_normalises():
    """All successors of one context, and one word never seen, have probability 1 together."""
    rng = np.random.default_rng(3)
    heads = np.unique(rng.integers(0, 2**60, 40).astype(np.uint64))
    sizes = rng.integers(1, 30, len(heads))
    names = np.concatenate([np.sort(rng.choice(500, n, replace=False)) for n in sizes]).astype(np.uint64)
    counts = rng.integers(1, 9, len(names))
    total = np.add.reduceat(counts, np.cumsum(sizes) - sizes)
    levels = ngram_lm.build_trie(heads, total, sizes, names, counts)
    uni = np.full(501, 1 / 501)
    for k in range(len(heads)):
        seen, back = ngram_lm.query_trie(levels, heads[k : k + 1], np.zeros(501, int), np.arange(501, dtype=np.uint64))
        assert math.isclose((seen + back[0] * uni).sum(), 1, abs_tol=1e-3)


@pytest.mark.parametrize("n, top", [(0, 9), (1, 0), (1, 2**62), (5, 3), (900, 2000), (1000, 2**60), (70_000, 2**40)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, top, n, endpoint=True).astype(np.uint64))
    ef = elias_fano.build(values)
    asked = np.concatenate((values, rng.integers(0, top, 99, endpoint=True).astype(np.uint64), np.array([0, top, 2**63], dtype=np.uint64)))
    place = {x: i for i, x in enumerate(values.tolist())}
    assert elias_fano.find(ef, asked).tolist() == [place.get(x, -1) for x in asked.tolist()]
    assert elias_fano.get(ef, np.arange(len(values))).tolist() == values.tolist()
    assert packing.unpack_sorted(packing.pack_sorted(values)).tolist() == values.tolist()


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in reversed(digits(m))]
        if 12 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * c, 10)) for c in d[1::2])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


def test_personal_data(spark, documents):
    texts = {d["doc_id"]: d["text"] or "" for d in documents}
    for r in QUERIES["op8_disclosing_terms"](spark, SMALL).collect():
        spans = plain_spans(texts[r["doc_id"]])
        named = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r["base_sha256"] == hashlib.sha256(named.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == j for s in spans) for j in range(4)]
        assert set(named.split(",")) <= set(r["spans"].split(","))


@pytest.mark.parametrize("text", ["a@b@c.d", "a@b.c@d.e", "..@x.y a@-.-", "@a.b", "a@@b.c", "00001.2.3.4", "1.2.3.4.5.6.7.8", "é@b.co é a.b@c.de", "256.1.1.1 1.1.1.1", "+1 (23) 456-7890 12", "4111 1111 1111 1111-4111", "++1 2345678901"])
def test_base_patterns(text):
    assert [(a, k, b) for a, b, k in pii.base_spans(text)] == plain_spans(text)


def bare(text):
    """(word, start, end) without the punctuation around it, lower-cased in A-Z."""
    marks = string.punctuation
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        word = m[0].strip(marks)
        if word:
            a = m.start() + len(m[0]) - len(m[0].lstrip(marks))
            yield "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word), a, a + len(word)


def brute_spans(rows):
    """Spans of each (doc_id, text), terms by counting every document and passage."""
    found, holders, docs = defaultdict(list), defaultdict(set), Counter()
    texts = [(k, text or "", plain_spans(text or "")) for k, (_, text) in enumerate(rows)]
    for k, text, spans in texts:
        docs.update({w for w, _, _ in bare(text)})
        inside = lambda a, b, spans=spans: any(a < e and s < b for s, _, e in spans)
        pairs = defaultdict(list)
        lines = []
        at = 0
        for line in text.split("\n"):
            lines.append((at, at + len(line), line.strip() != ""))
            at += len(line) + 1
        for s, kind, e in spans:
            name = (kind, text[s:e].lower() if kind < 2 else re.sub(r"[ ().-]", "", text[s:e]))
            holders[name].add(k)
            i = next(i for i, (x, y, _) in enumerate(lines) if x <= s <= y)
            j = next(j for j, (x, y, _) in enumerate(lines) if x <= e <= y)
            up = next((u for u in range(i - 1, -1, -1) if lines[u][2]), 0)
            down = next((d for d in range(j + 1, len(lines)) if lines[d][2]), len(lines) - 1)
            whole = text[lines[up][0] : lines[down][1]]
            for w, x, y in bare(whole):
                if not inside(x + lines[up][0], y + lines[up][0]):
                    pairs[name, w].append(whole)
        for pair, seen in pairs.items():
            found[pair].append(seen)
    z = 1.645

    def lower(x, n):
        return (x / n + z * z / (2 * n) - z * math.sqrt(x / n * (1 - x / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)

    told = defaultdict(set)
    for (name, w), seen in found.items():
        both, different = len(seen), len({s for s in (min(p, key=passage_number) for p in seen)})
        of, n = len(holders[name]), len(rows)
        if of < n and lower(different, different + max(docs[w] - both, 0)) >= 0.4 and math.log2(both * n / (of * docs[w])) / math.log2(n / of) >= 0.8:
            told[name].add(w)
    out = []
    for k, text, spans in texts:
        names = {name for name, who in holders.items() if k in who}
        marked = [(a, 4, b, "term") for w, a, b in bare(text) if any(w in told[x] for x in names) and not any(a < e and s < b for s, _, e in spans)]
        every = sorted([(a, kind, b, pii.KINDS[kind]) for a, kind, b in spans] + marked)
        out.append(",".join(f"{name}:{a}:{b}" for a, _, b, name in every))
    return out


def passage_number(passage):
    return int.from_bytes(hashlib.blake2b(passage.encode(), digest_size=8).digest(), "little", signed=True)


def people(n):
    """n plain texts, a person named in six different letters, another one in three copies of a line within other lines."""
    rows = [(k, f"the and of {k} rare{k}\nplain words, here and there") for k in range(n)]
    rows += [(100_000 + k, f"dear {k},\nwrite to Zorblat, at the desk {k}: a@b.co of and\n\nyours{k} the\n\nlong after, zorblat went on") for k in range(6)]
    rows += [(200_000 + k, f"note{k}\n(Quux) c@d.eu\nthe {k}") for k in range(3)]
    rows += [(300_000 + k, "whole copies prove nothing\nabout wibble +49 30 1234567 the") for k in range(50)]
    return rows + [(400_000, "alone once e@f.org snark")]


def test_terms_equal_brute_force(spark, documents):
    rows = people(150) + [(d["doc_id"], d["text"]) for d in documents]
    got = pii.sanitise(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string"))
    assert [r["spans"] for r in got.orderBy("doc_id").collect()] == brute_spans(rows)


def test_disclosing_terms(spark):
    """A name met in several passages goes everywhere in the document; whole copies and single meetings prove nothing."""
    out = {r["doc_id"]: r["clean_text"] for r in pii.sanitise(spark.createDataFrame(people(300), "doc_id long, text string")).collect()}
    assert "zorblat" not in out[100_003].lower() and " the " in out[100_003] and "yours3" in out[100_003]
    assert out[200_001] == "note1\n(Q*) [EMAIL]\nthe 1"
    assert out[300_007] == "whole copies prove nothing\nabout wibble [PHONE] the" and out[400_000] == "alone once [EMAIL] snark"
    assert out[5] == people(300)[5][1]


def test_terms_do_not_depend_on_the_size_of_the_corpus(spark):
    """A value above a line of words that no other document has: they are no terms, in a small corpus and in a large one."""
    line = " ".join(f"made{k}" for k in range(60))
    got = []
    for n in (500, 8000):
        rows = [(k, f"plain text {k} of no use") for k in range(n)] + people(0) + [(-1, f"one@two.org\n{line}")]
        out = pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).filter("n_terms > 0").collect()
        got.append({r["doc_id"]: r["spans"] for r in out})
    assert got[0] == got[1] and set(got[0]) == {*range(100_000, 100_006), *range(200_000, 200_003)}


def test_shards_link_by_any_line(spark):
    """One shared line among forty others links two documents."""
    rows = [(k, "\n".join([*(f"own {k} {j}" for j in range(40)), f"shared {k // 2}"])) for k in range(40)]
    out = {r["doc_id"]: r for r in sharding.balanced_shards(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert all(r["linked"] for r in out.values())
    assert sum(out[k]["shard"] == out[k + 1]["shard"] for k in range(0, 40, 2)) >= 15


def test_languages_on_held_out_documents(spark, documents):
    lang = {d["doc_id"]: d["lang"] for d in documents}
    rows = [r for r in QUERIES["op7_byte_cnn_language"](spark, SMALL).collect() if r["held_out"]]
    assert len(rows) > 20 and sum(r["lang_pred"] == lang[r["doc_id"]] for r in rows) >= 0.95 * len(rows)
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)


def test_shards_keep_links(spark, documents):
    """Even sizes, whole groups of equal texts, and far fewer cut links than places at random give."""
    rows = {r["doc_id"]: r for r in QUERIES["op3_balanced_shards"](spark, SMALL).collect()}
    count = Counter(r["shard"] for r in rows.values())
    assert max(count.values()) - min(count.values()) <= 1 and set(count) == set(range(8))
    for s in range(8):
        assert sorted(r["slot"] for r in rows.values() if r["shard"] == s) == list(range(count[s]))
    lines, equal = defaultdict(set), defaultdict(set)
    for d in documents:
        raw = (d["text"] or "").encode()
        assert (rows[d["doc_id"]]["size"], rows[d["doc_id"]]["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        equal[d["text"]].add(d["doc_id"])
        for line in set((d["text"] or "").split("\n")):
            if line.strip():
                lines[line].add(d["doc_id"])
    links = defaultdict(float)  # a line binds each document as strongly to all its others together, however many they are
    for group in lines.values():
        for a in group:
            for b in group:
                if a < b:
                    links[a, b] += 1 / (len(group) - 1)
    cut = sum(w for (a, b), w in links.items() if rows[a]["shard"] != rows[b]["shard"])
    assert cut < 0.25 * sum(links.values())  # places at random cut seven eighths
    assert sum(len({rows[k]["shard"] for k in group}) > 1 for group in equal.values()) == 0
