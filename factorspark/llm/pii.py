"""Personal data and the terms that give it away.

Base kinds are found by pattern in every text. Around each found value, the other words of its line may tell it to a
reader. How strongly a term t discloses an entity e is measured over the corpus by pointwise mutual information,
``PMI(e; t) = log2(docs(e, t) * N / (docs(e) * docs(t)))``, against the entity's own information ``IC(e) = log2(N / docs(e))``:
at ratio 1 the term identifies the entity. A document counts for a pair where the term stands in the value's line or in the
nearest lines with words above and below it; terms are words without the punctuation around them.

A pair met once says nothing, however large the corpus: that a document with the term holds the entity is a share, and what
counts is the lower end of its confidence interval (Wilson). Its successes are the different passages with the pair, so a
signature copied into different documents counts each time and a document copied whole counts once; its failures are the
documents with the term and without the pair. Terms of ratio ``generalise`` and lower end ``sure`` keep their first letter,
those of ratio ``remove`` and lower end ``surest`` go, wherever they stand in a document that holds the entity.

Document counts of terms come from blocks: each block of texts sends its distinct words with their counts to hash
buckets, which answer only for the terms asked about. Nothing but disclosing pairs goes back to the documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship
from .packing import in_buckets, join_blobs, pack_ints, pack_sorted, signed, split_blobs, unpack_ints, unpack_sorted
from .tokens import parts, text_bytes, words

KINDS = ("email", "ip", "card", "phone")
Z = 1.645  # one-sided 95 %
MAX_BROADCAST_BYTES = 64 << 20
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    total = sum(int(c) if k % 2 == 0 else _DOUBLED[int(c)] for k, c in enumerate(reversed(digits)))
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the email pattern, tried only at the run of local characters before each @."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        match = _LOCAL.match(text, begin) if begin < at else None
        if match:
            out.append((begin, match.end()))
            done = match.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of all base findings, by start and kind."""
    out = [(a, b, 0) for a, b in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                    out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def entity_hash(kind: int, value: str) -> int:
    """64-bit name of an entity: its kind and its value without separators and case."""
    plain = re.sub(r"[\x20().-]", "", value) if kind > 1 else value.lower()
    return int.from_bytes(hashlib.blake2b(f"{kind}:{plain}".encode(), digest_size=8).digest(), "little", signed=True)


def passage(text: str, begin: int, end: int) -> tuple[int, int]:
    """The range of a line and the nearest lines with words above and below it."""
    first, last = begin, end
    while first > 0:
        stop = first - 1
        first = text.rfind("\n", 0, stop) + 1
        if text[first:stop].strip():
            break
    while last < len(text):
        start = last + 1
        last = text.find("\n", start)
        last = len(text) if last < 0 else last
        if text[start:last].strip():
            break
    return first, last


def context(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(entity, term, start, end, passage hash) of the words in the passages of each entity, but for words of found values."""
    if not spans:
        return []
    lines: dict[int, tuple[int, set[int]]] = {}  # begin -> end, entities
    for a, b, kind in spans:
        begin = text.rfind("\n", 0, a) + 1
        end = text.find("\n", b)
        lines.setdefault(begin, (len(text) if end < 0 else end, set()))[1].add(entity_hash(kind, text[a:b]))
    return _words_in(text, spans, [(*passage(text, begin, end), names) for begin, (end, names) in lines.items()])


def _words_in(text: str, spans: list[tuple[int, int, int]], ranges) -> list[tuple[int, int, int, int, int]]:
    """As :func:`context`, of the words in ``ranges`` (begin, end, names)."""
    covered = np.zeros(len(text) + 1, dtype=bool)
    for a, b, _ in spans:
        covered[a:b] = True
    out = []
    for begin, end, names in ranges:
        line = text[begin:end]
        raw = np.frombuffer(line.encode(), dtype=np.uint8)
        w = words(raw, np.array([0, len(raw)]), bare=True)
        named = int.from_bytes(hashlib.blake2b(raw.tobytes(), digest_size=8).digest(), "little", signed=True)
        place = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # bytes to code points
        for h, a, b in zip(signed(w.hashes).tolist(), (begin + place[w.starts]).tolist(), (begin + place[w.ends]).tolist(), strict=True):
            if not covered[a:b].any():
                out += [(e, h, a, b, named) for e in names]
    return out


def _pairs(batches: Iterator[pa.RecordBatch]):
    """(doc_id, entity, null, null) for each entity of a text, (doc_id, entity, term, a passage that holds both) for each pair."""
    for batch in batches:
        rows = {}
        for i, text in enumerate(batch.column(1).to_pylist()):
            if text and (spans := base_spans(text)):
                rows.update({(i, entity_hash(k, text[a:b]), None): None for a, b, k in spans})
                for e, t, _, _, named in context(text, spans):
                    rows[i, e, t] = min(named, rows.get((i, e, t), named))
        order = sorted(rows, key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0))
        ids = batch.column(0).to_pylist()
        columns = [[ids[r[0]] for r in order], [r[1] for r in order], [r[2] for r in order], [rows[r] for r in order]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "entity", "term", "passage"])


def _word_counts(buckets: int):
    """Distinct words of a block of texts with the number of texts that hold each, to hash buckets."""

    def run(batches):
        for batch in batches:
            raw, offsets = text_bytes(batch.column(0))
            keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for a, b in parts(offsets):
                w = words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], bare=True)
                doc = np.repeat(np.arange(b - a), np.diff(w.bounds))
                order = np.lexsort((doc, w.hashes))
                h, d = w.hashes[order], doc[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                k, n = np.unique(h[new], return_counts=True)
                keys.append(k)
                counts.append(n)
            k, n = np.concatenate(keys), np.concatenate(counts)
            k, inverse = np.unique(k, return_inverse=True)
            n = np.bincount(inverse, n, len(k)).astype(np.uint64)
            to = signed(k) % buckets
            order = np.lexsort((k, to))
            k, n, to = k[order], n[order], to[order]
            at = np.searchsorted(to, np.arange(buckets + 1))
            out = [(j, join_blobs(pack_sorted(k[p]), pack_ints(n[p]))) for j in range(buckets) if at[j] < at[j + 1] for p in [slice(at[j], at[j + 1])]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([j for j, _ in out]), pa.array([None] * len(out), pa.int64()), pa.array([d for _, d in out])], ["bucket", "term", "data"])

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Counts of the terms asked about in one bucket; the messages are read one by one."""
    asked = np.sort(table.column("term").drop_null().to_numpy().view(np.uint64))
    total = np.zeros(len(asked), dtype=np.int64)
    if len(asked):
        for data in table.column("data").drop_null().to_pylist():
            k, n = split_blobs(data)
            k, n = unpack_sorted(k), unpack_ints(n)
            at = np.minimum(np.searchsorted(k, asked), len(k) - 1)
            total += np.where(k[at] == asked, n[at], 0).astype(np.int64)
    return pa.table({"term": pa.array(signed(asked)), "docs": pa.array(total)})


_RESULT = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_terms long, base_spans string, spans string, clean_text string"
)


def _mark(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        out = []
        for doc_id, text, told in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            text = text or ""
            base = base_spans(text)
            acts = {(p["entity"], t["term"]): t["remove"] for p in told or () for t in p["terms"]}
            terms: dict[tuple[int, int], bool] = {}
            if acts:
                whole = [(0, len(text), {entity_hash(k, text[a:b]) for a, b, k in base})]
                for e, t, a, b, _ in _words_in(text, base, whole):
                    if (e, t) in acts:
                        terms[a, b] = terms.get((a, b), False) or acts[e, t]
            named = [(a, k, b, KINDS[k]) for a, b, k in base]
            every = sorted(named + [(a, len(KINDS), b, "term") for a, b in terms])
            clean, done = [], 0
            for a, k, b, kind in every:
                if a >= done:
                    clean.append(text[done:a])
                    clean.append(f"[{kind.upper()}]" if k < len(KINDS) else "[TERM]" if terms[a, b] else text[a] + "*")
                done = max(done, b)
            line = lambda spans: ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
            counts = [sum(k == j for _, _, k in base) for j in range(len(KINDS))]
            out.append((doc_id, *counts, len(terms), line(sorted(named)), line(every), "".join(clean) + text[done:]))
        columns = list(zip(*out, strict=True)) or [()] * 9
        types = [pa.int64()] * 6 + [pa.string()] * 3
        names = [f.split()[0] for f in _RESULT.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)



def lower_share(hits: Column, trials: Column) -> Column:
    """Lower end of Wilson's interval for a share of ``hits`` in ``trials``, both positive."""
    p, z2 = hits / trials, Z * Z
    return (p + z2 / (2 * trials) - Z * F.sqrt(p * (1 - p) / trials + z2 / (4 * trials * trials))) / (1 + z2 / trials)


def bounded_side(df: DataFrame, entries: Column) -> DataFrame:
    """A stored table for a broadcast if its bytes are known to be few: 16 a row and 24 for each of ``entries``; else as it is."""
    size = df.agg(F.sum(16 + 24 * entries)).first()[0] or 0
    return F.broadcast(df) if size <= MAX_BROADCAST_BYTES else df


def disclosing_terms(docs: DataFrame, generalise: float = 0.8, remove: float = 0.95, sure: float = 0.4, surest: float = 0.6) -> DataFrame:
    """(doc_id, told): per document the pairs (entity, term, remove) that disclose one of its entities."""
    spark = docs.sparkSession
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = cut(docs.select("doc_id", "text").mapInArrow(_pairs, "doc_id long, entity long, term long, passage long"))
    total = docs.count()
    passages = found.filter("term is not null").groupBy("entity", "term", "passage").agg(F.count(F.lit(1)).alias("n"))
    met = passages.groupBy("entity", "term").agg(F.sum("n").alias("both"), F.count(F.lit(1)).alias("different"))
    met = cut(met.filter(lower_share(F.col("different"), F.col("different")) >= sure))  # others cannot reach it
    holders = found.filter("term is null").groupBy("entity").agg(F.count(F.lit(1)).alias("of_entity"))
    asked = met.select("term").distinct()
    asked = asked.select(F.pmod("term", F.lit(buckets)).cast("long").alias("bucket"), "term", F.lit(None).cast("binary").alias("data"))
    sent = docs.select("text").mapInArrow(_word_counts(buckets), "bucket long, term long, data binary")
    counts = in_buckets(sent.unionByName(asked), "bucket", buckets, _answer, "term long, docs long")
    pmi = F.log2(F.col("both") * F.lit(float(total)) / (F.col("of_entity") * F.col("docs")))
    ratio = pmi / F.log2(F.lit(float(total)) / F.col("of_entity"))
    without = F.greatest(F.col("docs") - F.col("both"), F.lit(0))
    told = met.join(holders, "entity").join(counts, "term").filter(F.col("of_entity") < total)
    told = told.withColumns({"ratio": ratio, "share": lower_share(F.col("different"), F.col("different") + without)})
    told = told.filter((F.col("ratio") >= generalise) & (F.col("share") >= sure))
    told = told.select("entity", F.struct("term", ((F.col("ratio") >= remove) & (F.col("share") >= surest)).alias("remove")).alias("t"))
    own = cut(told.groupBy("entity").agg(F.collect_list("t").alias("terms")))
    holding = found.filter("term is null").select("doc_id", "entity").distinct().join(bounded_side(own, F.size("terms")), "entity")
    return holding.groupBy("doc_id").agg(F.collect_list(F.struct("entity", "terms")).alias("told"))


def sanitise(docs: DataFrame, generalise: float = 0.8, remove: float = 0.95, sure: float = 0.4, surest: float = 0.6) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_terms, base_spans, spans, clean_text) for each row of ``docs`` (doc_id, text).

    ``base_spans`` and ``spans`` (with the disclosing terms, kind ``term``) list ``kind:start:end`` in code points by
    start. In ``clean_text`` a found value is replaced by its kind, a removed term by ``[TERM]``, a generalised one by its
    first character and ``*``. Null and empty texts have no finding; very long ones are read whole. Rows with a null
    doc_id are treated as one name, and repeated rows share their pairs, each row counting as a document. An empty table
    gives an empty result. Equal ratios need no order: every term is judged by itself.
    """
    ship(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    told = cut(disclosing_terms(plain, generalise, remove, sure, surest)).withColumnRenamed("doc_id", "_told_id")
    told = bounded_side(told, F.aggregate("told", F.lit(0), lambda n, x: n + 1 + F.size(x["terms"])))
    joined = plain.join(told, F.col("doc_id").eqNullSafe(F.col("_told_id")), "left").select("doc_id", "text", "told")
    return joined.mapInArrow(_mark, _RESULT)
