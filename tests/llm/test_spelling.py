"""Spelling variants against brute force: all pairs of words, edits tried one by one."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from factorspark.llm import spelling

SMALL = "/root/testdata/sf0.001"


def one_edit(word, letters):
    """Every string one inserted, deleted or replaced letter away."""
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cuts if b} | {a + c + b for a, b in cuts for c in letters}
    return (out | {a + c + b[1:] for a, b in cuts if b for c in letters}) - {word}


def brute_counts(rows):
    words = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            word = low[: h % len(low)] + low[h % len(low) + 1 :] if h % 31 == 0 else low
            if len(word) >= 7:
                words[word] += 1
    return {w: n for w, n in words.items() if n >= 2}


def brute(rows):
    """word -> (form, root, n, n_near, form_n)"""
    n = brute_counts(rows)
    letters = sorted({c for w in n for c in w})
    form, near = {}, {}
    for w in n:
        found = [v for v in one_edit(w, letters) if v in n]
        near[w] = len(found)
        best = min(found, key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n[w], near[w], n.get(form.get(w))) for w in n}


def answer(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    out = {r[0]: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_table(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in df.collect()])
    assert answer(spelling.spelling_variants(df)) == want
    assert sum(v[0] is not None for v in want.values()) > 5


@pytest.mark.parametrize("letters", ["ab", "abc", "aé", "abcdefghij"])
def test_all_pairs(spark, letters):
    """Words of few letters: repeated bigrams, ties in the order, pivots at either end."""
    rng = np.random.default_rng(len(letters))
    words = {"".join(rng.choice(list(letters), rng.integers(7, 11))) for _ in range(300)} | {"a" * k for k in range(7, 12)}
    words |= {v for w in sorted(words)[:5] for v in one_edit(w, letters) if len(v) >= 7}
    got = spelling.near_words(spark.createDataFrame([(w,) for w in sorted(words)], "word string")).collect()
    want = {(w, v) for w in words for v in one_edit(w, letters) if v in words and w < v}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_pivots():
    assert spelling.disjoint_pivots([0, 1, 2], [5, 1, 5]) == [0, 2]
    assert spelling.disjoint_pivots([0, 1, 2, 3], [5, 1, 9, 2]) == [1, 3]
    assert spelling.disjoint_pivots([3, 7, 9], [4, 1, 1]) == [1, 2]


LONG = " ".join(f"langeswort{'abcdefgh'[k % 8]}" for k in range(50_000))
WORDS = [(1, "colour " * 12 + "Colours colors color honours honors HONOURS", "x")] + [
    (k, "tromboneX trombone", "x") for k in (None, None, 3)] + [(4, None, "x"), (5, "", None), (6, "123 !?", "x"), (7, LONG, "x"), (7, LONG, "x")]
SCHEMA = "doc_id long, text string, word string"


def test_edges(spark):
    got = answer(spelling.spelling_variants(spark.createDataFrame(WORDS, SCHEMA)))
    assert got == brute([w[:2] for w in WORDS]) and len(got) > 8


def test_chain_and_ties(spark):
    text = " ".join(["abcdefg"] * 2 + ["abcdefgh"] * 30 + ["abcdefghi"] * 900 + ["abcdefx"] * 30)
    rows = [(1, text, "")]
    got = answer(spelling.spelling_variants(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute([r[:2] for r in rows])
    assert got["abcdefg"][:2] == ("abcdefgh", "abcdefghi") and got["abcdefx"][0] is None


def test_empty(spark):
    for rows in ([], [(1, None, "x")], [(1, "short words only", "x")]):
        assert spelling.spelling_variants(spark.createDataFrame(rows, SCHEMA)).count() == 0
