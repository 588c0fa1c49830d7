"""Benchmark decontamination: SimHash of item-sized windows, block search for near fingerprints, exact verification.

All steps are DataFrame functions. Items and documents are lower-cased words; their features are 5-word shingles with
their multiplicities as weights. A window that shares no shingle with an item has similarity 0, so windows are laid
only where a document shares one: at the place where that shingle would put the whole item, as long as the item. Each
window gets a 64-bit SimHash (a bit is the weighted majority of the shingles' hash bits). Fingerprints that differ in at
most ``radius`` bits agree in at least one of ``radius + 1`` blocks of bits, so joining on (length, block number, block)
finds all pairs within the radius; the pairs' exact distance and weighted Jaccard similarity decide.

At similarity 0.75 the distance averages 11 bits of 64 with a deviation of 3, so the default radius of 20 misses one pair
in a thousand that lies exactly on the threshold, and far fewer above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scale import measured_side
from ..session import cut

BITS = 64


def text_words(text: Column) -> Column:
    """Lower-cased words of a text, as an array; null is empty."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "[\\x20\\x09-\\x0D]+"), "")


def shingle_hashes(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words in order; ``words`` must be a stored column, as it is read for every word."""
    run = F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
    return F.when(F.size(words) >= size, run).otherwise(F.array().cast("array<long>"))


def with_simhash(rows: DataFrame, key: str, hashes: str, name: str) -> DataFrame:
    """Adds the 64-bit SimHash of the array column ``hashes`` to rows with a unique ``key``.

    The hash bits are counted by one aggregate, two bits in one number (32 of its bits each). Rows without hashes go.
    """
    lanes = F.lit(0x0000000100000001).cast("long")
    bits = rows.select(key, F.explode(hashes).alias("_h"))
    sums = bits.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(F.shiftrightunsigned("_h", k).bitwiseAND(lanes)).alias(f"_s{k}") for k in range(32)]
    )
    out = F.lit(0).cast("long")
    for k in range(32):
        for count, bit in ((F.col(f"_s{k}").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), k), (F.shiftrightunsigned(f"_s{k}", 32), k + 32)):
            out = out.bitwiseOR(F.when(count * 2 > F.col("_n"), F.shiftleft(F.lit(1).cast("long"), bit)).otherwise(F.lit(0).cast("long")))
    return rows.join(sums.select(key, out.alias(name)), key)


def blocks(fingerprint: Column, radius: int) -> Column:
    """The ``radius + 1`` blocks of a fingerprint as structs (number, bits)."""
    edges = [round(k * BITS / (radius + 1)) for k in range(radius + 2)]
    parts = [
        F.struct(F.lit(k).alias("no"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")).alias("bits"))
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))
    ]
    return F.array(*parts)


def shared_weight(a: Column, b: Column) -> Column:
    """Sum over distinct values of the smaller of the two multiplicities."""
    count = lambda x, h: F.size(F.filter(x, lambda y: y == h))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda total, h: total + F.least(count(a, h), count(b, h)))


def benchmark_items(items: DataFrame, size: int) -> DataFrame:
    """(item_id, n, its, print) of the items that can be searched for: those of ``size`` words or more."""
    words = items.select(F.col("item_id"), text_words(F.col("text")).alias("words")).filter(F.size("words") >= size)
    out = cut(words.select("item_id", F.size("words").alias("n"), shingle_hashes(F.col("words"), size).alias("its"), F.monotonically_increasing_id().alias("item")))
    return cut(with_simhash(out, "item", "its", "print"))


def contaminated(docs: DataFrame, items: DataFrame, size: int = 5, percent: int = 75, radius: int = 20) -> DataFrame:
    """(doc_id, item_id, start, distance, similarity): the best window of each document for each item it contains.

    A window of an item's length (cut where the document begins or ends) matches when 100 * shared weight of shingles >=
    ``percent`` * joint weight. ``start`` is its first word, from 0; of equally similar windows the first is given.
    Items under ``size`` words are not searched for, as any text holds such; null and short texts contain nothing. Rows
    with a null doc_id are returned under null when they match; rows repeated under one doc_id give one result. Empty
    tables give an empty result. Other columns are ignored.
    """
    its = benchmark_items(items, size)
    anchors = its.select("n", F.posexplode("its").alias("at", "hash")).distinct()
    # split() runs once per text: the words are a column of their own, read by several expressions.
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    hashed = docs.select("doc_id", text_words(F.col("text")).alias("words")).select("doc_id", shingle_hashes(F.col("words"), size).alias("own"))
    # The outer form, as the optimiser would test the size of a plain one's array below, computing it twice and per word.
    hits = hashed.select("doc_id", F.posexplode_outer("own").alias("place", "hash")).join(measured_side(anchors), "hash")
    laid = hits.select("doc_id", (F.col("place") - F.col("at")).alias("start"), "n").distinct()
    laid = laid.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("windows"))  # bounded by the document's length
    again = docs.join(measured_side(laid.select(F.col("doc_id").alias("_hit_id"), "windows")), F.col("doc_id").eqNullSafe(F.col("_hit_id")))
    again = again.select("doc_id", "windows", text_words(F.col("text")).alias("words")).select("doc_id", "windows", shingle_hashes(F.col("words"), size).alias("own"))
    one = again.select("doc_id", "own", F.explode("windows").alias("w")).select("doc_id", "own", "w.start", "w.n")
    first = F.greatest(F.col("start"), F.lit(0))
    count = F.least(F.col("start") + F.col("n") - size + 1, F.size("own")) - first
    windows = one.select("doc_id", "start", "n", F.slice("own", first + 1, count).alias("own")).distinct()
    windows = cut(windows.withColumn("window", F.monotonically_increasing_id()))
    mine = with_simhash(windows, "window", "own", "sketch")
    mine = mine.select("*", F.explode(blocks(F.col("sketch"), radius)).alias("block"))
    theirs = its.select("item", "item_id", "n", "its", "print", F.explode(blocks(F.col("print"), radius)).alias("block"))
    distance = F.bit_count(F.col("sketch").bitwiseXOR(F.col("print")))
    near = (
        mine.join(theirs, ["n", "block"])
        .withColumn("distance", distance)
        .filter(F.col("distance") <= radius)
        .dropDuplicates(["window", "item"])
    )
    shared = shared_weight(F.col("own"), F.col("its"))
    exact = near.select("doc_id", "item_id", F.greatest("start", F.lit(0)).alias("start"), "distance", shared.alias("shared"), (F.size("own") + F.size("its")).alias("both"))
    exact = exact.filter(100 * F.col("shared") >= percent * (F.col("both") - F.col("shared")))
    similarity = F.col("shared") / (F.col("both") - F.col("shared"))
    best = F.max_by(F.struct("start", "distance"), F.struct(similarity, -F.col("start"), -F.col("distance"))).alias("best")
    return exact.groupBy("doc_id", "item_id").agg(best, F.max(similarity).alias("similarity")).select(
        "doc_id", "item_id", "best.start", F.col("best.distance").cast("int").alias("distance"), "similarity"
    )


def keep_clean(docs: DataFrame, items: DataFrame, size: int = 5, percent: int = 75, radius: int = 20) -> DataFrame:
    """The rows of ``docs`` that contain no item; columns as in ``docs``."""
    found = contaminated(docs, items, size, percent, radius).select(F.col("doc_id").alias("hit")).distinct()
    return docs.join(measured_side(found), docs["doc_id"].eqNullSafe(found["hit"]), "left_anti")
