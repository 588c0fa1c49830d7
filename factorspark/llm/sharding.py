"""Balanced label propagation: documents move to the shards of the documents they are linked with, under quotas.

Links come from content: a document's keys are the hash of its whole text and the hashes of all its lines, so copies and
documents that share lines meet in keys; keys of one document are dropped. A key stands between its documents, so a key that a third of all
documents hold costs one row per document and never a list or a pair. Each round is joins and map-side combined sums:

* a key counts its documents in every shard;
* a document sums the counts of its keys' other documents (each over their number) and names the shard that holds most;
* per shard, moves are admitted by gain per key up to the free places; the threshold comes from a histogram of gains, so
  admission needs no global order.

At the end every shard gets its exact number of rows: linked documents keep their place in key order up to the quota,
and documents without links, and what is over a quota, fill the shards that have room, in key order too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scale import ordered_position
from ..session import cut

KEY_ROWS = 2_000  # rows of a key that one task serves
BINS = 64  # steps of gain in the histogram
SPLITS = 256  # parts of one step, by hash of the document's first key


def link_keys(text: Column) -> Column:
    """Hash of the text and the distinct hashes of its lines; no key for a null or blank text."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.trim(line) != "")
    hashes = F.transform(lines, lambda line: F.xxhash64(line))
    return F.when(F.trim(text) == "", F.array().cast("array<long>")).otherwise(F.array_union(F.array(F.xxhash64(text, F.lit(1))), hashes))


def propagate(pairs: DataFrame, start: DataFrame, shards: int, room: list[int], rounds: int) -> DataFrame:
    """(row, first, label): labels of the linked rows after some rounds. ``pairs`` is (row, key, cuts, part), ``start`` (row, first, label)."""
    labels = start
    for turn in range(rounds):
        counts = [F.sum((F.col("label") == s).cast("double")).alias(f"_n{s}") for s in range(shards)]
        keyed = pairs.join(labels.select("row", "label"), "row").groupBy("key").agg(F.count(F.lit(1)).alias("_size"), F.max("cuts").alias("_cuts"), *counts)
        keyed = keyed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_cuts") - 1)))
        others = F.col("_size") - 1
        votes = pairs.join(keyed, ["key", "part"]).groupBy("row").agg(F.count(F.lit(1)).alias("_keys"), F.sum(1 / others).alias("_own"), *[F.sum(F.col(f"_n{s}") / others).alias(f"_v{s}") for s in range(shards)])
        # Sums of fractions differ in their last bits with the order of addition: compare them rounded.
        vote = F.array(*[F.round(F.col(f"_v{s}") - F.when(F.col("label") == s, F.col("_own")).otherwise(0.0), 6) for s in range(shards)])
        named = labels.join(votes, "row", "left").withColumn("_vote", vote).withColumn("_best", F.array_max("_vote"))
        own = F.get("_vote", F.col("label"))
        # Half of the groups may move in a round, else linked ones would change places for ever.
        active = F.pmod(F.xxhash64("first", F.lit(turn)), F.lit(2)) == 0
        want = F.when(active & (own < F.col("_best")), F.array_position("_vote", F.col("_best")).cast("int") - 1)
        step = F.least(F.floor((F.col("_best") - own) * BINS / F.col("_keys")), F.lit(BINS - 1)).cast("int")
        split = F.pmod(F.xxhash64("first", F.lit(17)), F.lit(SPLITS)).cast("int")
        moves = cut(named.select("row", "first", "label", want.alias("want"), F.when(want.isNotNull(), step).alias("step"), split.alias("split")))
        held = {r["label"]: r["n"] for r in moves.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        free = F.array(*[F.lit(max(0, room[s] - held.get(s, 0))).cast("long") for s in range(shards)])
        order = Window.partitionBy("want").orderBy(F.desc("step"), "split").rowsBetween(Window.unboundedPreceding, 0)
        bins = moves.filter("want is not null").groupBy("want", "step", "split").agg(F.count(F.lit(1)).alias("n"))
        open_ = bins.withColumn("upto", F.sum("n").over(order)).filter(F.col("upto") <= F.get(free, F.col("want"))).select("want", "step", "split", F.lit(True).alias("go"))
        labels = cut(
            moves.join(F.broadcast(open_), ["want", "step", "split"], "left")  # shards * BINS * SPLITS rows at most
            .select("row", "first", F.when(F.col("go"), F.col("want")).otherwise(F.col("label")).alias("label"))
        )
    return labels


def balanced_shards(docs: DataFrame, shards: int = 8, rounds: int = 6) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, linked) for each row of ``docs`` (doc_id, text).

    The law is ``rows``: shard sizes differ by one row at most, the lower shards having the extra ones. ``size`` is the
    UTF-8 length plus 1 (null: 1), ``text_crc32`` the CRC of the UTF-8 text (null: of nothing, 0), ``slot`` counts each
    shard from 0 without gaps, ``grown_shard`` is null under this law, ``linked`` tells whether any other row shares a
    key. Null or blank texts link with nothing; rows with a null doc_id and repeated rows are placed like any other.
    An empty table gives an empty result. ``shards`` must not pass 64.
    """
    spark_schema = "doc_id", "size", "crc", "row", "first"
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(
        "doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("crc"), link_keys(text).alias("keys"),
        F.monotonically_increasing_id().alias("row"),
    )
    base = cut(keyed.withColumn("first", F.coalesce(F.get("keys", F.lit(0)), F.xxhash64("doc_id"))))
    total = base.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    all_pairs = base.select("row", F.explode("keys").alias("key"))
    # Cut, so that the join below reads two plain shuffles and a common key can be split.
    common = cut(all_pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    # A key of very many rows is answered in several parts, so that no task serves it alone.
    cuts = F.ceil(F.col("n") / KEY_ROWS).cast("int")
    pairs = all_pairs.join(common, "key").withColumn("cuts", cuts)
    pairs = cut(pairs.select("row", "key", "cuts", F.pmod(F.xxhash64("row"), F.col("cuts")).cast("int").alias("part")))
    # Documents start where the smallest of their shared keys falls, so that many groups start whole.
    seed = pairs.groupBy("row").agg(F.min("key").alias("first"))
    start = cut(seed.withColumn("label", F.pmod(F.xxhash64("first"), F.lit(shards)).cast("int")))
    labels = propagate(pairs, start, shards, quota, rounds)
    marked = base.select(*spark_schema[:4], "first").join(labels.select("row", F.col("first").alias("group"), "label"), "row", "left")
    marked = cut(marked.select("doc_id", "size", "crc", "row", F.coalesce("group", "first").alias("group"), "label"))
    linked = ordered_position(marked.filter("label is not null"), ["label"], [F.col("group"), F.col("row")], "place")
    quotas = F.array(*[F.lit(q).cast("long") for q in quota])
    linked = cut(linked.withColumn("stays", F.col("place") < F.get(quotas, F.col("label"))))
    kept = {r["label"]: r["n"] for r in linked.filter("stays").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    columns = ["doc_id", "size", "crc", "row", "group"]
    pool = linked.filter("not stays").select(*columns, F.lit(True).alias("linked")).unionByName(
        marked.filter("label is null").select(*columns, F.lit(False).alias("linked"))
    )
    pool = ordered_position(pool, [], [F.col("group"), F.col("row")], "place")
    shard, slot, begin = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    for s in range(shards):
        n = quota[s] - kept.get(s, 0)
        here = (F.col("place") >= begin) & (F.col("place") < begin + n)
        shard, slot = F.when(here, F.lit(s)).otherwise(shard), F.when(here, F.col("place") - begin + kept.get(s, 0)).otherwise(slot)
        begin += n
    out = linked.filter("stays").select("doc_id", "size", "crc", F.col("label").alias("shard"), F.col("place").alias("slot"), F.lit(True).alias("linked")).unionByName(
        pool.select("doc_id", "size", "crc", shard.alias("shard"), slot.alias("slot"), "linked")
    )
    return out.select(
        "doc_id", "size", F.col("crc").cast("long").alias("text_crc32"), F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "linked",
    )
