"""Mixing sources to target weights down a tree of domains, languages and sources.

A token budget flows from the root to the leaves. Every node shares what it gets among its children in proportion to
their weights, but gives none more than its documents hold (times the epochs allowed); what a short child leaves goes
to its siblings first, and only what all siblings cannot take stays out of the node's own demand, to be shared one
level higher. This is water-filling at every level, done with window functions over the tree's nodes. Each leaf then
takes whole epochs of its documents and a token-prefix of one more epoch in seeded order.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scale import measured_side
from ..session import cut

LEVELS = ("domain", "lang", "source")
_BUCKET_DOCS = 4_000


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null and empty texts have none."""
    return F.size(F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+"), ""))


def fill(nodes: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Share ``budget`` of each parent (columns ``by``) among its children ``name`` (weight, room): adds ``share``.

    Children are ordered by room per weight; those with too little room come first and are filled, the rest split
    what is left by weight.
    """
    order = Window.partitionBy(*by).orderBy((F.col("room") / F.col("weight")).asc_nulls_last(), name)
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(*by)
    out = nodes.withColumns({
        "_done": F.coalesce(F.sum("room").over(before), F.lit(0)),
        "_weight": F.sum("weight").over(rest),
    }).withColumn("_full", F.col("_done") + F.col("room") * F.col("_weight") / F.col("weight") <= F.col("budget"))
    out = out.withColumns({
        "_taken": F.coalesce(F.sum(F.when(F.col("_full"), F.col("room"))).over(whole), F.lit(0)),
        "_left": F.sum(F.when(~F.col("_full"), F.col("weight"))).over(whole),
    })
    share = F.when(F.col("_full"), F.col("room").cast("double")).otherwise((F.col("budget") - F.col("_taken")) * F.col("weight") / F.col("_left"))
    return out.withColumn("share", share).drop("_done", "_weight", "_full", "_taken", "_left")


def leaf_budgets(leaves: DataFrame, weights: Mapping[str, int], budget: float, epochs: int) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens) with ``share``: tokens each leaf has to give.

    ``weights`` maps "domain", "domain/lang" or "domain/lang/source" to a positive integer; others weigh 1.
    """
    table = F.create_map(*[F.lit(x) for item in weights.items() for x in item]) if weights else None

    def weight(*path: str) -> Column:
        found = F.try_element_at(table, F.concat_ws("/", *path)) if table is not None else F.lit(None)
        return F.coalesce(found, F.lit(1)).cast("long")

    room = leaves.withColumn("room", F.col("tokens") * epochs)
    level = room.withColumn("budget", F.lit(float(budget)))
    for depth in range(3):
        keys = list(LEVELS[: depth + 1])
        nodes = level.groupBy(*keys).agg(F.sum("room").alias("room"), F.max("budget").alias("budget")).withColumn("weight", weight(*keys))
        shared = fill(nodes, keys[:-1], keys[-1]).select(*keys, "share")
        level = level.join(shared, keys).drop("budget").withColumnRenamed("share", "budget")
    return level.withColumnRenamed("budget", "share").drop("room")


def mix(
    docs: DataFrame, domains: Mapping[str, str], weights: Mapping[str, int], share: float = 1.0, epochs: int = 4, seed: int = 11
) -> DataFrame:
    """(doc_id, domain, lang, source, tokens, times) for each row of ``docs`` (doc_id, text, lang, source).

    ``domains`` maps a source to its domain (else "other"); the budget is ``share`` of all tokens (words). ``times`` is
    how often the document is read: the full epochs its leaf affords, plus one when the document lies in the
    token-prefix of the next epoch, documents in order of md5(seed:epoch:doc_id) as long as their running sum of tokens
    fits. Null lang or source is the leaf name "". A text without words is read 0 times. A null doc_id counts as the
    empty name. Rows repeated under one doc_id are taken in either order. An empty table gives an empty result.

    Running sums of a leaf of any size are spread: sums per prefix of the hash first, then inside one prefix.
    """
    named = F.create_map(*[F.lit(x) for item in domains.items() for x in item]) if domains else None
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    domain = F.coalesce(F.try_element_at(named, source), F.lit("other")) if named is not None else F.lit("other")
    base = cut(docs.select(
        "doc_id", domain.alias("domain"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), source.alias("source"),
        word_count(F.col("text")).cast("long").alias("tokens"),
    ))
    leaves = cut(base.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")))
    total, widest = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.max("docs"), F.lit(0))).first()
    digits = max(0, math.ceil(math.log(max(widest / _BUCKET_DOCS, 1), 16)))
    spent = leaf_budgets(leaves.select(*LEVELS, "tokens"), weights, math.floor(share * total), epochs)
    spent = spent.withColumn("full", F.coalesce(F.floor(F.try_divide("share", F.col("tokens").cast("double"))), F.lit(0)))
    spent = spent.select(*LEVELS, "full", F.floor(F.col("share") - F.col("full") * F.col("tokens")).alias("rest"))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    # Broadcast when small: a join by leaf would put a large leaf in one task, and its window there too.
    turn = base.join(measured_side(spent), list(LEVELS)).withColumn("turn", order).withColumn("bucket", F.substring("turn", 1, digits))
    sums = turn.groupBy(*LEVELS, "bucket").agg(F.sum("tokens").alias("sum"))
    before = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*LEVELS, "bucket", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*LEVELS, "bucket").orderBy("turn", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    placed = turn.withColumn("upto", F.sum("tokens").over(inside)).join(measured_side(sums), [*LEVELS, "bucket"])
    times = F.when(F.col("tokens") > 0, F.col("full") + (F.col("before") + F.col("upto") <= F.col("rest")).cast("long")).otherwise(F.lit(0))
    return placed.select("doc_id", *LEVELS, "tokens", times.cast("long").alias("times"))


def keep_mixed(docs: DataFrame, domains: Mapping[str, str], weights: Mapping[str, int], share: float, seed: int = 11) -> DataFrame:
    """The rows of ``docs`` that one epoch of :func:`mix` reads; columns as in ``docs``. Rows without a doc_id go with that name."""
    chosen = mix(docs, domains, weights, share, 1, seed).filter("times > 0").select(F.col("doc_id").alias("chosen")).distinct()
    return docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["chosen"]), "left_semi")
