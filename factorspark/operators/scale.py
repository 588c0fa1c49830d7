"""Building blocks that keep wide groups out of a single task.

Two measured sizes decide between the short plan and the split plan everywhere in the library:

* a side is broadcast only when its row count is known to stay under ``MAX_BROADCAST_ROWS`` (less when wide);
* a window or an exact percentile runs per group only when the largest group is known to stay under
  ``MAX_GROUP_ROWS``; wider groups are ordered over many tasks by :func:`ordered_position`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, stored

MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_CELLS = 8_000_000  # about 64 MB of doubles
MAX_GROUP_ROWS = 2_000_000
MAP_SIDE_TOP = 1_000  # the largest k Spark prunes per task (spark.sql.optimizer.windowGroupLimitThreshold)

_POSITION_BITS = 33  # monotonically_increasing_id keeps the row position in its lower 33 bits


def small_side(df: DataFrame, n_rows: int) -> DataFrame:
    """Hint a broadcast when the known row count allows it, else leave the join to AQE."""
    return F.broadcast(df) if n_rows <= _broadcast_limit(df) else df


def _broadcast_limit(df: DataFrame) -> int:
    """Rows of ``df`` that may be broadcast; fewer when it is wide."""
    return min(MAX_BROADCAST_ROWS, MAX_BROADCAST_CELLS // max(len(df.columns), 1))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle by keys into all shuffle partitions. Ahead of Python work: AQE would pack small rows into few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def measured_side(df: DataFrame) -> DataFrame:
    """:func:`small_side` for a table whose size is not known yet; counts at most one row past the bound."""
    return small_side(df, df.limit(_broadcast_limit(df) + 1).count())


def max_group_rows(df: DataFrame, by: Sequence[str]) -> int:
    """Rows of the largest group (one map-side combined count)."""
    row = df.groupBy(*by).count().agg(F.max("count")).first() if by else df.agg(F.count(F.lit(1))).first()
    return int(row[0] or 0)


def ordered_position(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """0-based position of each row inside its ``by`` group, for groups of any size.

    One range shuffle on (by, order) spreads even a single huge group over all tasks. The sorted rows are
    fixed by a checkpoint, numbered inside their partition, and shifted by the rows that the earlier
    partitions hold of the same group. The table of shifts has one row per (partition, group) only.
    ``order`` must end in a unique key.
    """
    by = list(by)
    keys = [F.col(c) for c in by] + list(order)
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    tagged = cut(ranged.withColumn("_mid", F.monotonically_increasing_id()))
    split = tagged.withColumns(
        {
            "_pid": F.shiftright("_mid", _POSITION_BITS),
            "_pos": F.col("_mid").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)),
        }
    )
    before = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        split.groupBy("_pid", *by)
        .agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first"))
        .select("_pid", *by, "_shift")
    )
    return (
        split.join(measured_side(shifts), ["_pid", *by])
        .withColumn(name, F.col("_pos") + F.col("_shift"))
        .drop("_mid", "_pid", "_pos", "_shift")
    )


def position_in_group(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str, group_rows: int | None = None
) -> DataFrame:
    """0-based position by window when the largest group is known to be small, else by range shuffle."""
    size = max_group_rows(df, by) if group_rows is None else group_rows
    if size <= MAX_GROUP_ROWS:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))
    return ordered_position(df, by, order, name)


def top_in_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str) -> DataFrame:
    """The first k rows of each group, numbered from 1.

    The filter sits right on the row number, so Spark keeps only the k best of a group per task *before* the
    shuffle: a group of any size costs k rows per task.
    """
    if k > MAP_SIDE_TOP:
        return ordered_position(df, by, order, name).withColumn(name, F.col(name) + 1).filter(F.col(name) <= k)
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)


def average_rank(df: DataFrame, by: Sequence[str], names: Mapping[str, str], group_rows: int | None = None) -> DataFrame:
    """0-based ranks in the group with ties at their average, {column: name of its rank}; NULL stays NULL.

    In wide groups the distinct values are counted and ranked, one column after the other, and their ranks go back to the
    rows: by broadcast while the values are few, else by one shuffle of the rows for each column of many values.
    """
    by = list(by)
    size = max_group_rows(df, by) if group_rows is None else group_rows
    if size <= MAX_GROUP_ROWS:
        for col, name in names.items():
            order = Window.partitionBy(*by).orderBy(F.col(col).asc_nulls_last())
            ranked = F.rank().over(order) - 1
            ties = F.count(F.lit(1)).over(order.rangeBetween(Window.currentRow, Window.currentRow))  # peers, same sort
            df = df.withColumn(name, F.when(F.col(col).isNotNull(), ranked + (ties - 1) / F.lit(2.0)))
        return df
    # Ranks come from stored rows and go back to the same rows: values computed twice could differ in their last bits.
    # Equal values are one row of the joined side, and AQE splits a value that is very common.
    out = rows = stored(df)
    sides = []
    for col, name in names.items():
        values, n = _ranked_values(rows, by, col, name)
        sides.append((n, col, values))
    room = MAX_BROADCAST_ROWS
    for n, col, values in sorted(sides, key=lambda side: side[0]):
        if n <= room:
            values, room = F.broadcast(values), room - n
        same = F.col(col) == F.col("_value")
        for i, b in enumerate(by):
            same = same & F.col(b).eqNullSafe(F.col(f"_by{i}"))
        out = out.join(values, same, "left").drop("_value", *[f"_by{i}" for i in range(len(by))])
    return out


def _ranked_values(rows: DataFrame, by: Sequence[str], col: str, name: str) -> tuple[DataFrame, int]:
    """(_by0 .., _value, rank) of the present values of a column in their groups, and their number."""
    keys = [f"_by{i}" for i in range(len(by))]
    present = rows.filter(F.col(col).isNotNull()).select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col(col).alias("_value"))
    counts = stored(present.groupBy(*keys, "_value").agg(F.count(F.lit(1)).alias("_n")), "values")
    n = counts.count()
    placed = prefix_scan(counts, [F.col(c) for c in (*keys, "_value")], {"_before": ("sum", "_n")}, n)
    placed = placed.withColumn("_before", F.col("_before") - F.col("_n"))
    first = F.lit(0)
    if keys:
        starts = counts.groupBy(*keys).agg(F.sum("_n").alias("_before"))
        starts = prefix_scan(starts, [F.col(k) for k in keys], {"_first": ("sum", "_before")}).select(*[F.col(k).alias(f"_{k}") for k in keys], (F.col("_first") - F.col("_before")).alias("_first"))
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
        placed, first = placed.join(measured_side(starts), same), F.col("_first")
    rank = F.col("_before") - first + (F.col("_n") - 1) / F.lit(2.0)
    return placed.select(*keys, "_value", rank.alias(name)), n


def group_percentiles(
    df: DataFrame,
    by: Sequence[str],
    cols: Sequence[str],
    probs: Sequence[float],
    unique: Sequence[str],
    group_rows: int | None = None,
) -> DataFrame:
    """Exact interpolated percentiles per group, one ARRAY<DOUBLE> column per input column.

    Spark's ``percentile`` keeps all distinct values of a group in one buffer, so it is used only for groups
    of known size; wider groups read the two neighbouring positions from the distributed order.
    """
    by = list(by)
    size = max_group_rows(df, by) if group_rows is None else group_rows
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    if size <= MAX_GROUP_ROWS:
        return df.groupBy(*by).agg(*[F.percentile(c, wanted).alias(c) for c in cols])
    out = None
    for c in cols:
        rest = [u for u in unique if u not in by]
        valid = df.filter(F.col(c).isNotNull()).select(*by, c, *rest)
        placed = ordered_position(valid, by, [F.col(c), *[F.col(u) for u in rest]], "_at")
        counts = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
        placed = placed.join(counts, by) if by else placed.withColumn("_n", counts.scalar())
        parts = []
        for i, p in enumerate(probs):
            exact = F.lit(float(p)) * (F.col("_n") - 1)
            low, high = F.floor(exact), F.ceil(exact)
            weight = F.when(low == high, F.lit(1.0)).when(F.col("_at") == low, high - exact).otherwise(exact - low)
            parts.append(F.sum(F.when(F.col("_at").isin(low, high), F.col(c) * weight)).alias(f"_p{i}"))
        one = placed.groupBy(*by).agg(*parts)
        one = one.select(*by, F.array(*[F.col(f"_p{i}") for i in range(len(probs))]).alias(c))
        if out is None:
            out = one
        else:
            out = out.join(one, by, "full_outer") if by else out.withColumn(c, one.scalar())
    return out


_SCANS = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}


def prefix_scan(
    df: DataFrame, order: Sequence[Column], what: dict[str, tuple[str, str]], rows: int | None = None, exclusive: bool = False
) -> DataFrame:
    """Running ``sum``, ``max`` or ``last`` (present value) of columns over the whole table: {name: (how, column)}.

    ``order`` must end in a unique key; ``exclusive`` leaves out the row itself. Beyond ``MAX_GROUP_ROWS`` the rows are
    dealt by range and fixed by a checkpoint, scanned inside each part, and combined with what the earlier parts hold.
    """
    end = -1 if exclusive else 0
    size = max_group_rows(df, []) if rows is None else rows
    if size <= MAX_GROUP_ROWS:
        whole = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
        return df.withColumns({name: _SCANS[how](F.col(c)).over(whole) for name, (how, c) in what.items()})
    part = cut(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()))

    def held(how: str, c: str) -> Column:
        if how != "last":
            return _SCANS[how](F.col(c))
        return F.max(F.when(F.col(c).isNotNull(), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(c).alias("v"))))["v"]

    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    ends = part.groupBy("_pid").agg(*[held(how, c).alias(f"_t_{name}") for name, (how, c) in what.items()])
    ends = ends.select("_pid", *[_SCANS[how](F.col(f"_t_{name}")).over(before).alias(f"_s_{name}") for name, (how, _) in what.items()])
    inside = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)

    def combined(name: str, how: str, c: str) -> Column:
        own, earlier = _SCANS[how](F.col(c)).over(inside), F.col(f"_s_{name}")
        if how == "sum":
            return F.coalesce(own + earlier, own, earlier)
        return F.greatest(own, earlier) if how == "max" else F.coalesce(own, earlier)

    out = part.join(measured_side(ends), "_pid").withColumns({name: combined(name, how, c) for name, (how, c) in what.items()})
    return out.drop("_pid", *[f"_s_{name}" for name in what])


def running_total(df: DataFrame, order: Sequence[Column], value: str, name: str, rows: int | None = None) -> DataFrame:
    """Running sum over the whole table in ``order`` (which must end in a unique key)."""
    return prefix_scan(df, order, {name: ("sum", value)}, rows)


def join_in_span(df: DataFrame, spans: DataFrame, at: str, start: str, end: str) -> DataFrame:
    """Each row of ``df`` with every row of ``spans`` whose dates ``start`` .. ``end`` cover its date ``at``.

    Spans are listed by calendar month and joined on it, so that many spans need no nested loop; the exact check follows.
    """

    def month(c: str) -> Column:
        return F.year(c) * 12 + F.month(c)

    listed = spans.withColumn("_month", F.explode(F.when(F.col(start) <= F.col(end), F.sequence(month(start), month(end)))))
    inside = df.withColumn("_month", month(at)).join(measured_side(listed), "_month")
    return inside.filter(F.col(at).between(F.col(start), F.col(end))).drop("_month")
