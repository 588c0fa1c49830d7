"""Spelling variants: words one edit apart, found by pivotal bigrams.

The positional bigrams of a word are ordered by rarity; the first three are its prefix. Among any three bigrams two are
disjoint, and one edit spoils at most one of two disjoint bigrams. So of two words one edit apart, the word whose prefix
ends earlier in the order has a pivot (one of two disjoint bigrams of its prefix) that stands in the other word's prefix.
Pivots are chosen by dynamic programming to be as rare as possible. As the edit is on one side of the surviving pivot, all
letters on its other side agree: an edit after the left pivot leaves the word's beginning as it was, up to the pivot's end,
and any other leaves the end from the right pivot on. That limits the place of the pivot, counted from that end, to one.
The join's key is the agreeing text with the other word's length; of the remaining letters one half must agree as well, so
each half makes a key of its own, and a common beginning does not bring together all words that share it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship

GRAM = 2
EDITS = 1
PREFIX = GRAM * EDITS + 1
SHORTEST = 7
RUN = f"[A-Za-zÀ-ÿ]{{{SHORTEST},}}"  # a maximal run that is long enough, as the match is greedy
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def disjoint_pivots(places: list[int], weights: list[int], wanted: int = EDITS + 1) -> list[int]:
    """Indices of ``wanted`` bigrams that do not overlap and weigh least together; ``places`` ascend.

    best[k][i]: the least weight of k disjoint bigrams among the first i, by taking the i-th or not.
    """
    n, never = len(places), float("inf")
    before = [next((j for j in range(i, 0, -1) if places[j - 1] + GRAM <= places[i]), 0) for i in range(n)]
    best = [[0.0] * (n + 1)] + [[never] * (n + 1) for _ in range(wanted)]
    for k in range(1, wanted + 1):
        for i in range(1, n + 1):
            best[k][i] = min(best[k][i - 1], best[k - 1][before[i - 1]] + weights[i - 1])
    out, i = [], n
    for k in range(wanted, 0, -1):
        while best[k][i] == best[k][i - 1]:
            i -= 1
        out.append(i - 1)
        i = before[i - 1]
    return out[::-1]


def signature(word: str, order: dict[str, int], weight: dict[str, int]) -> tuple[int, list[int], list[int]]:
    """(number of the last prefix bigram in the order, places of the prefix, places of the pivots) of a word.

    The prefix has the three bigrams that come first, and every other place of the last of them.
    """
    grams = [word[p : p + GRAM] for p in range(len(word) - GRAM + 1)]
    last = sorted(order[g] for g in grams)[PREFIX - 1]
    places = [p for p, g in enumerate(grams) if order[g] <= last]
    pivots = disjoint_pivots(places, [weight[grams[p]] for p in places])
    return last, places, [places[i] for i in pivots]


def word_counts(docs: DataFrame, noise: int = 31) -> DataFrame:
    """(word, n): words of the texts with at least two occurrences, each run of letters as the contract spoils it.

    A run whose unsigned crc32 of ``<doc_id>:<run>`` is divisible by ``noise`` loses the letter at that number modulo
    its length. A null doc_id counts as an empty one. Partial counts are made before the shuffle by word.
    """
    run = F.explode(F.regexp_extract_all(F.translate(F.col("text").cast("string"), UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), run)
    runs = runs.withColumn("crc", F.crc32(F.concat_ws(":", "doc", "run")))
    at = F.pmod("crc", F.length("run")).cast("int")
    spoilt = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.pmod("crc", F.lit(noise)) == 0, spoilt).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).filter(F.length("word") >= SHORTEST)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def gram_weights(words: DataFrame) -> dict[str, int]:
    """In how many places of all words each bigram stands. Their alphabet has 89 letters, so there are at most 7921 bigrams."""
    places = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda p: F.substring("word", p, F.lit(GRAM)))
    rows = words.select(F.explode(places).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()
    return {r["gram"]: r["n"] for r in rows}


def _start(size: Column) -> Column:
    return F.substring("word", F.lit(1), size)


def _end(size: Column) -> Column:
    return F.right("word", size)


def _left_keys(place: Column, length: Column) -> list[Column]:
    """Keys of a bigram with the letters up to its end, for partners of ``length`` letters that agree with it there.

    What follows the bigram in the partner is halved: the edit is in one half, so the other half agrees too.
    """
    half = (place + GRAM + F.floor((length - place - GRAM) / 2)).cast("int")
    return [F.xxhash64(F.lit(0), length, _start(half)), F.xxhash64(F.lit(1), length, _start(place + GRAM), _end(length - half))]


def _right_keys(rest: Column, length: Column) -> list[Column]:
    """The same for a bigram with the ``rest`` letters from its beginning to the end of the word."""
    half = F.floor((length - rest) / 2).cast("int")
    return [F.xxhash64(F.lit(2), length, _start(half), _end(rest)), F.xxhash64(F.lit(3), length, _end(length - half))]


def near_words(words: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of ``words`` (column word, distinct, at least 4 letters) that are one edit apart, once each."""
    spark = words.sparkSession
    ship(spark)
    weights = gram_weights(words)
    order = {g: i for i, g in enumerate(sorted(weights, key=lambda g: (weights[g], g)))}
    held = spark.sparkContext.broadcast((order, weights))  # at most 7921 entries each

    @F.arrow_udf("struct<last: int, places: array<int>, pivots: array<int>>")
    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kinds = [pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        for column in batches:
            parts = zip(*[signature(w, *held.value) for w in column.to_pylist()], strict=True) if len(column) else ([], [], [])
            yield pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(parts, kinds, strict=True)], ["last", "places", "pivots"])

    signed = cut(words.select("word", sign("word").alias("s")).select("word", "s.*"))
    size, place = F.length("word"), F.col("place")
    left, right = F.col("pivots")[0], F.col("pivots")[1]
    own = [*_left_keys(place, size), *_right_keys(size - place, size)]
    # An edit after the left pivot keeps the word's beginning, any other keeps its end from the right pivot on.
    asked = [k for change in (-1, 0, 1) for k in (*_left_keys(left, size + change), *_right_keys(size - right, size + change))]
    prefixes = signed.select("word", "last", F.explode("places").alias("place")).select(F.col("word").alias("s"), F.col("last").alias("s_last"), F.explode(F.array(*own)).alias("key"))
    pivots = signed.select(F.col("word").alias("r"), F.col("last").alias("r_last"), F.explode(F.array(*asked)).alias("key"))
    met = pivots.join(prefixes, "key").filter("r <> s and r_last <= s_last and abs(length(r) - length(s)) <= 1")
    near = met.filter(F.levenshtein("r", "s", EDITS) == EDITS)
    return near.select(F.least("r", "s").alias("a"), F.greatest("r", "s").alias("b")).distinct()


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) of every word of ``forms`` (word, form): where the forms lead at last.

    Pointers are doubled until none moves. A form is at least ten times as frequent as its word, so there are no
    cycles and the rounds grow with the logarithm of the longest chain. A word is the form of few others (its letters
    bound the words one edit away), so no key of the join is hot.
    """
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``docs`` (doc_id, text); other columns may have any name.

    Null and empty texts have no words, an empty table gives no rows; texts are read whole, however long; repeated
    rows and repeated ids count again. Of near words that are equally frequent the smallest in code-point order is the
    form. ``root`` of a word without a form is the word.
    """
    words = cut(word_counts(docs.select("doc_id", "text")))
    pairs = near_words(words)
    ends = cut(pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other")), F.struct(F.col("b").alias("word"), F.col("a").alias("other")))).alias("x")).select("x.*"))
    counted = ends.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = counted.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct(-F.col("other_n"), F.col("other"))).alias("best"))
    rows = words.join(best, "word", "left").withColumn("form_n", -F.col("best")["col1"])
    chosen = F.col("form_n") >= ratio * F.col("n")
    rows = cut(rows.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(chosen, F.col("best.other")).alias("form"), F.when(chosen, F.col("form_n")).alias("form_n"),
    ))
    roots = follow(rows.filter("form is not null"))
    out = rows.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
