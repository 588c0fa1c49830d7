"""Metrics between a target and a prediction, statistics of batches of programs.

Every metric is one aggregate row over the whole table; ranks and quantiles over the whole table use the
distributed order of ``scale`` once the table outgrows one task.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, ship, stored
from . import scale
from .scale import average_rank, max_group_rows, measured_side, position_in_group, prefix_scan, running_total

LOG_EPS = 1e-15  # fixed value


@dataclass(frozen=True)
class Metric:
    """``fn(y, prediction, weight) -> aggregate column``; ``ranked`` ones see average ranks instead of values."""

    name: str
    fn: Callable[[Column, Column, Column], Column]
    greater_is_better: bool
    ranked: bool = False


def _average(value: Column, w: Column) -> Column:
    return F.try_divide(F.sum(value * w), F.sum(w))


def _mae(y, p, w):
    return _average(F.abs(p - y), w)


def _mse(y, p, w):
    return _average((p - y) * (p - y), w)


def _rmse(y, p, w):
    return F.sqrt(_mse(y, p, w))


def _log_loss(y, p, w):
    def clip(v):
        return F.least(F.greatest(v, F.lit(LOG_EPS)), F.lit(1 - LOG_EPS))

    return _average(-(y * F.ln(clip(p)) + (1 - y) * F.ln(clip(1 - p))), w)


def _weighted_pearson(y, p, w):
    """Absolute weighted correlation of centred columns; 0 when it is not defined."""
    sw = F.sum(w)
    my, mp = F.sum(w * y) / sw, F.sum(w * p) / sw
    cov = F.sum(w * y * p) / sw - my * mp
    var = (F.sum(w * y * y) / sw - my * my) * (F.sum(w * p * p) / sw - mp * mp)
    return F.coalesce(F.abs(F.try_divide(cov, F.sqrt(F.when(var > 0, var)))), F.lit(0.0))


METRICS: dict[str, Metric] = {
    m.name: m
    for m in [
        Metric("pearson", _weighted_pearson, True),
        Metric("spearman", _weighted_pearson, True, ranked=True),
        Metric("mean absolute error", _mae, False),
        Metric("mse", _mse, False),
        Metric("rmse", _rmse, False),
        Metric("log loss", _log_loss, False),
    ]
}


def register_metric(name: str, fn: Callable[[Column, Column, Column], Column], greater_is_better: bool) -> Metric:
    METRICS[name] = Metric(name, fn, greater_is_better)
    return METRICS[name]


@dataclass(frozen=True)
class SumsMetric:
    """A metric in numpy that is a function of sums: ``part(y, prediction, weight)`` gives ``size`` numbers for some rows,
    ``finish`` turns their sums over all rows into the value."""

    name: str
    part: Callable[[np.ndarray, np.ndarray, np.ndarray], Sequence[float]]
    finish: Callable[[np.ndarray], float]
    size: int
    greater_is_better: bool


SUMS_METRICS: dict[str, SumsMetric] = {}


def register_sums_metric(name: str, part, finish, size: int, greater_is_better: bool) -> SumsMetric:
    """Register a numpy metric; :func:`grouped_metrics` takes it by name beside the column metrics."""
    if name in METRICS:
        raise ValueError(f"{name} is a column metric already")
    SUMS_METRICS[name] = SumsMetric(name, part, finish, size, greater_is_better)
    return SUMS_METRICS[name]


def grouped_metrics(df: DataFrame, names: Sequence[str], by: Sequence[str], y: str = "y", p: str = "p", w: str | None = None) -> DataFrame:
    """(by columns, one column per metric), ranked metrics excepted.

    Column metrics are one aggregate. Numpy metrics send one row of sums per task batch and group, so a group of any size is
    reduced where its rows lie; ``finish`` runs as an Arrow function on one row per group. Rows that miss the target or the
    prediction have no weight; a missing group key is a group.
    """
    unknown = [n for n in names if n not in METRICS and n not in SUMS_METRICS]
    if unknown or any(METRICS[n].ranked for n in names if n in METRICS):
        raise ValueError(f"{unknown or 'ranked metrics'} cannot be computed by group")
    weight = F.col(w) if w else F.lit(1.0)
    keys = [f"_k{i}" for i in range(len(by))]
    rows = df.select(
        *[F.col(k).alias(n) for k, n in zip(by, keys, strict=True)],
        F.col(y).cast("double").alias("_y"), F.col(p).cast("double").alias("_p"), weight.cast("double").alias("_w"),
    ).withColumn("_w", F.when(F.col("_y").isNotNull() & F.col("_p").isNotNull(), F.col("_w")))
    column = [METRICS[n].fn(F.col("_y"), F.col("_p"), F.col("_w")) for n in names if n in METRICS]
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[c.alias(f"_c{i}") for i, c in enumerate(column)])
    named = {n: f"_c{i}" for i, n in enumerate(n for n in names if n in METRICS)}
    custom = [SUMS_METRICS[n] for n in names if n in SUMS_METRICS]
    if custom:
        sums = _sums_by_group(rows, custom, keys).withColumnsRenamed({k: f"_j{k}" for k in keys})
        out = out.join(sums, [F.col(k).eqNullSafe(F.col(f"_j{k}")) for k in keys], "left")
        named |= {m.name: f"_v{i}" for i, m in enumerate(custom)}
    return out.select(*[F.col(n).alias(k) for k, n in zip(by, keys, strict=True)], *[F.col(named[n]).alias(n) for n in names])


def _finisher(finish: Callable[[np.ndarray], float]):
    @F.pandas_udf("double")
    def value(sums: pd.Series) -> pd.Series:
        return pd.Series([float(finish(np.asarray(s))) for s in sums], dtype=float)

    return value


def _sums_by_group(rows: DataFrame, metrics: Sequence[SumsMetric], keys: Sequence[str]) -> DataFrame:
    """(keys, _v0, _v1, ...): the metrics in their order."""
    ship(rows.sparkSession)
    # Metrics are the caller's functions, which only travel by value inside a closure.
    parts, sizes = [m.part for m in metrics], [m.size for m in metrics]

    def partial_sums(batches):
        for batch in batches:
            batch = batch.filter(pc.and_(pc.and_(batch["_y"].is_valid(), batch["_p"].is_valid()), batch["_w"].is_valid()))
            if not len(batch):
                continue
            codes = [batch[k].dictionary_encode("encode").indices.to_numpy() for k in keys] or [np.zeros(len(batch))]
            _, first, group = np.unique(np.column_stack(codes), axis=0, return_index=True, return_inverse=True)
            order = np.argsort(group, kind="stable")
            columns = [batch[c].to_numpy()[order] for c in ("_y", "_p", "_w")]
            cuts = np.searchsorted(group[order], np.arange(1, len(first)))
            pieces = zip(*[np.split(c, cuts) for c in columns], strict=True)
            sums = [[float(v) for f in parts for v in f(*piece)] for piece in pieces]
            some = batch.select(keys).take(pa.array(first))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(sums, pa.list_(pa.float64()))], names=[*keys, "_s"])

    schema = T.StructType([*rows.select(*keys).schema.fields, T.StructField("_s", T.ArrayType(T.DoubleType()))])
    summed = rows.mapInArrow(partial_sums, schema).groupBy(*keys).agg(*[F.sum(F.get("_s", F.lit(i))).alias(f"_s{i}") for i in range(sum(sizes))])
    at = 0
    for i, m in enumerate(metrics):
        sums = F.array(*[F.col(f"_s{j}") for j in range(at, at + m.size)])
        summed = summed.withColumn(f"_v{i}", F.nanvl(_finisher(m.finish)(sums), F.lit(None).cast("double")))
        at += m.size
    return summed.select(*keys, *[f"_v{i}" for i in range(len(metrics))])


def _with_ranks(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    rows = max_group_rows(df, [])
    out = average_rank(df, [], {c: f"_rank_{c}" for c in cols}, rows)
    out = out.select(*[c for c in df.columns if c not in cols], *[F.col(f"_rank_{c}").alias(c) for c in cols])
    return out if rows <= scale.MAX_GROUP_ROWS else stored(out)  # read for the means, and again


def weighted_metrics(
    df: DataFrame, names: Sequence[str], y: str = "y", p: str = "p", w: str | None = None, unique: Sequence[str] = ()
) -> DataFrame:
    """One row with a column per metric. Values are centred on their means first, so large offsets do no harm.

    Ranks are those of values, so columns that tell rows apart (``unique``) are not needed any more.
    """
    plain = [METRICS[n] for n in names if not METRICS[n].ranked]
    ranked = [METRICS[n] for n in names if METRICS[n].ranked]
    weight = F.col(w) if w else F.lit(1.0)
    out = None
    for group in (plain, ranked):
        if not group:
            continue
        keep = dict.fromkeys([y, p, *([w] if w else [])])
        src = _with_ranks(df.select(*keep), [y, p]) if group is ranked else df
        # The means come from one extra pass; both are scalars of the same aggregate.
        means = src.agg(F.avg(y).alias("_y"), F.avg(p).alias("_p"))
        my, mp = means.select("_y").scalar(), means.select("_p").scalar()
        needs_centre = any(m.fn is _weighted_pearson for m in group)
        cy, cp = (F.col(y) - my, F.col(p) - mp) if needs_centre else (F.col(y), F.col(p))
        part = src.select(
            F.col(y).alias("_y"), F.col(p).alias("_p"), weight.alias("_w"), cy.alias("_cy"), cp.alias("_cp")
        ).agg(
            *[
                m.fn(*((F.col("_cy"), F.col("_cp")) if m.fn is _weighted_pearson else (F.col("_y"), F.col("_p"))), F.col("_w")).alias(m.name)
                for m in group
            ]
        )
        out = part if out is None else out.withColumns({m.name: part.select(m.name).scalar() for m in group})
    return out.select(*names)


def regression_metrics(
    df: DataFrame, y: str, p: str, var_y: float | None = None, scale: float = 1.0, band: tuple[float, float] = (0.1, 0.0)
) -> DataFrame:
    """All one-pass regression metrics in one aggregate. ``var_y``: population variance of the training target."""
    mse = F.avg((F.col(y) - F.col(p)) * (F.col(y) - F.col(p)))
    var = F.lit(float(var_y)) if var_y is not None else F.var_pop(y)
    s = F.lit(float(scale))
    base = df.agg(
        mse.alias("_mse"),
        var.alias("_var"),
        F.avg(F.when(F.abs(F.col(y) - F.col(p)) < F.abs(F.col(y)) * band[0] + band[1], 1.0).otherwise(0.0)).alias("fraction"),
        F.corr(y, p).alias("pearson"),
    )
    m, v = F.col("_mse"), F.col("_var")
    n = F.try_divide(m, v)
    return base.select(
        (-m).alias("neg_mse"),
        (-F.sqrt(m)).alias("neg_rmse"),
        (-n).alias("neg_nmse"),
        (-F.sqrt(n)).alias("neg_nrmse"),
        (-F.ln(1 + m)).alias("neglog_mse"),
        (1 / (1 + s * m)).alias("inv_mse"),
        (1 / (1 + s * n)).alias("inv_nmse"),
        (1 / (1 + s * F.sqrt(n))).alias("inv_nrmse"),
        "fraction",
        "pearson",
    )


def spearman(df: DataFrame, y: str, p: str, unique: Sequence[str] = ()) -> DataFrame:
    """Ranks are those of values, so columns that tell rows apart (``unique``) are not needed any more."""
    return _with_ranks(df.select(*dict.fromkeys([y, p])), [y, p]).agg(F.corr(y, p).alias("spearman"))


def with_split(df: DataFrame, key: Sequence[str], fraction: float, seed: int = 0, name: str = "in_sample") -> DataFrame:
    """A repeatable in/out-of-sample flag from a hash of the row's key."""
    bucket = F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in key]), F.lit(1_000_000))
    return df.withColumn(name, bucket < int(fraction * 1_000_000))


def split_fitness(df: DataFrame, metric: str, y: str, p: str, w: str | None = None, flag: str = "in_sample") -> DataFrame:
    """The metric on both parts, from one aggregate."""
    m = METRICS[metric]
    if m.ranked:
        raise ValueError("rank each part with weighted_metrics instead")
    weight = F.col(w) if w else F.lit(1.0)
    return df.groupBy(flag).agg(m.fn(F.col(y), F.col(p), weight).alias("fitness"))


def parsimony_fitness(programs: DataFrame, coefficient: float | None = None, greater_is_better: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Raw fitness less a price per unit of length; the automatic price is cov(length, fitness) / var(length)."""
    if coefficient is not None:
        priced = programs.withColumn("_c", F.lit(float(coefficient)))
    else:
        price = F.try_divide(F.covar_samp("length", "fitness"), F.var_pop("length"))
        if by:
            priced = programs.join(measured_side(programs.groupBy(*by).agg(price.alias("_c"))), list(by))
        else:
            priced = programs.withColumn("_c", programs.agg(price).scalar())
    signed = 1.0 if greater_is_better else -1.0
    return priced.withColumn("penalised", F.col("fitness") - F.col("_c") * F.col("length") * F.lit(signed)).drop("_c")


def weighted_quantile(df: DataFrame, value: str, weight: str, q: float) -> DataFrame:
    """Smallest value whose cumulative weight reaches q. Equal values are summed before they are ordered.

    The comparison allows for the last bits of the sum, so that no order of addition changes the answer.
    """
    per_value = df.groupBy(value).agg(F.sum(weight).alias("_w"))
    cumulated = running_total(per_value, [F.col(value)], "_w", "_cum")
    return cumulated.filter(F.col("_cum") * (1 + 1e-12) >= q).agg(F.min(value).alias("quantile"))


def entropy(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """-sum p ln p of the label frequencies; 0 for one class."""
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("_n"))
    n = F.col("_n")
    total = F.sum("_n")
    value = F.ln(total) - F.sum(n * F.ln(n)) / total
    return counts.groupBy(*by).agg(F.when(F.count(F.lit(1)) > 1, value).otherwise(F.lit(0.0)).alias("entropy"))


def batch_statistics(batch: DataFrame, history: DataFrame, positions: str | None = None) -> DataFrame:
    """Best and mean reward, mean length, distinct and new expressions, invalid share, mean positional entropy."""
    base = batch.agg(
        F.max("r").alias("r_best"),
        F.avg("r").alias("r_mean"),
        F.avg("length").alias("length_mean"),
        F.avg(F.col("invalid").cast("double")).alias("invalid_rate"),
    )
    distinct = batch.select("expr").distinct()
    novel = distinct.join(history.select("expr").distinct(), "expr", "left_anti")
    out = base.withColumns(
        {"n_unique": distinct.agg(F.count(F.lit(1))).scalar(), "n_novel": novel.agg(F.count(F.lit(1))).scalar()}
    )
    if positions:
        tokens = batch.select(F.posexplode(positions).alias("_pos", "_tok"))
        out = out.withColumn("positional_entropy", entropy(tokens, "_tok", ["_pos"]).agg(F.avg("entropy")).scalar())
    return out


def quantile_filter(df: DataFrame, value: str, epsilon: float, unique: Sequence[str]) -> DataFrame:
    """Rows at or above the (1 - epsilon) quantile, taken as the higher neighbour."""
    n = max_group_rows(df, [])
    # The lowest kept position; the small subtraction undoes the rounding of the product.
    at = int(np.ceil((n - 1) * (1 - epsilon) - 1e-9))
    placed = position_in_group(df.select(value, *unique), [], [F.col(value), *[F.col(u) for u in unique]], "_at", n)
    threshold = placed.filter(F.col("_at") == at).agg(F.max(value)).scalar()
    return df.filter(F.col(value) >= threshold)


# --- frontiers and halls of fame -----------------------------------------------------------------


def hall_of_fame(programs: DataFrame, n: int, by: str = "r", expr: str = "expr") -> DataFrame:
    """The n best distinct programs."""
    return programs.groupBy(expr).agg(F.max(by).alias(by)).orderBy(F.col(by).desc(), expr).limit(n)


def pareto_front(programs: DataFrame, complexity: str = "complexity", r: str = "r", expr: str = "expr") -> DataFrame:
    """Programs no other one beats in complexity (low) and reward (high); equal points keep one.

    One row per complexity is left after the aggregate; the best reward of all lower ones is a prefix scan.
    """
    best = cut(programs.groupBy(complexity).agg(F.max(r).alias(r), F.min_by(expr, F.struct(-F.col(r), F.col(expr))).alias(expr)))
    lower = prefix_scan(best, [F.col(complexity)], {"_b": ("max", r)}, best.count(), exclusive=True)
    return lower.filter(F.col("_b").isNull() | (F.col(r) > F.col("_b"))).drop("_b")


FRONT_ROWS = 20_000  # points of one task that are compared with each other without more ado
GRID_CELLS = 4096
FAN_IN = 8


def _merged(front: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which points of an earlier front, and which new ones, no other point dominates. Points differ."""
    both = np.concatenate((front, points))
    kept: list[int] = []
    for i in np.lexsort(both.T[::-1]):  # a point comes after all that dominate it
        if not kept or not (both[kept] <= both[i]).all(axis=1).any():
            kept.append(i)
    good = np.zeros(len(both), dtype=bool)
    good[kept] = True
    return good[: len(front)], good[len(front) :]


def _local_fronts(df: DataFrame, costs: Sequence[str]) -> DataFrame:
    """The points of each partition that no point of the partition dominates; only its front is held."""

    def local(batches):
        held = None
        for pdf in batches:
            if not len(pdf):
                continue
            if held is None:
                held = pdf.iloc[:0]
            a, b = _merged(held[list(costs)].to_numpy(float), pdf[list(costs)].to_numpy(float))
            held = pd.concat([held[a], pdf[b]])
        if held is not None:
            yield held

    return df.mapInPandas(local, df.schema)


def _count_below(value: Column, n: Column, mark: Column) -> Column:
    return n + F.when(mark < value, 1).otherwise(0)


def _outside_dominated_cells(df: DataFrame, costs: Sequence[str]) -> DataFrame:
    """Leave out points in grid cells that lie wholly above a cell with a point, in every cost."""
    steps = max(2, int(GRID_CELLS ** (1 / len(costs))))
    edges = df.approxQuantile(list(costs), [k / steps for k in range(1, steps)], 0.01)
    cells = []
    for k, (c, e) in enumerate(zip(costs, edges, strict=True)):
        marks = F.array(*[F.lit(float(v)) for v in sorted(set(e))]) if e else F.array().cast("array<double>")
        value = F.col(c).cast("double")
        df = df.withColumn(f"_c{k}", F.aggregate(marks, F.lit(0), partial(_count_below, value)))
        cells.append(f"_c{k}")
    used = np.array([list(r) for r in df.select(*cells).distinct().collect()]).reshape(-1, len(costs))  # at most GRID_CELLS
    beaten = [tuple(map(int, u)) for u in used if (used < u).all(axis=1).any()]
    if beaten:
        gone = df.sparkSession.createDataFrame(beaten, ", ".join(f"{c} int" for c in cells))
        df = df.join(F.broadcast(gone), cells, "left_anti")
    return df.drop(*cells)


def skyline(df: DataFrame, costs: Sequence[str], unique: str) -> DataFrame:
    """Rows not dominated in any number of costs (all low). Equal points keep the one with the least ``unique``.

    Each task keeps its own front. While many points are left, cells of a grid that others dominate are dropped and
    fronts are merged in a tree, a few tasks into one, until one task can hold the rest. Where points hardly dominate each
    other, so that merging gains nothing, the rest is compared in chunks of bounded size.
    """
    ship(df.sparkSession)
    survivors = cut(_local_fronts(df.groupBy(*costs).agg(F.min(unique).alias(unique)), costs))
    n = survivors.count()
    if n > FRONT_ROWS:
        survivors = cut(_outside_dominated_cells(survivors, costs))
        n, parts = survivors.count(), survivors.rdd.getNumPartitions()
        while n > FRONT_ROWS:
            parts = -(-parts // FAN_IN)
            if n > FRONT_ROWS * parts:
                break
            survivors = cut(_local_fronts(survivors.repartition(parts), costs))
            n, earlier = survivors.count(), n
            if 2 * n > earlier:
                break
    if n <= FRONT_ROWS:
        return _local_fronts(survivors.coalesce(1), costs)
    # The side that is compared against travels in chunks of bounded size, however many points survive.
    chunks = -(-2 * n // scale.MAX_BROADCAST_ROWS)  # hashed evenly, about half the bound each
    no_worse, better = F.lit(True), F.lit(False)
    for c in costs:
        no_worse = no_worse & (F.col(f"b.{c}") <= F.col(f"a.{c}"))
        better = better | (F.col(f"b.{c}") < F.col(f"a.{c}"))
    left = survivors.alias("a")
    for i in range(chunks):
        chunk = survivors.filter(F.pmod(F.xxhash64(*costs), F.lit(chunks)) == i).alias("b")
        left = left.join(F.broadcast(chunk), no_worse & better, "left_anti").alias("a")
    return left


# --- correlated programs -------------------------------------------------------------------------


def row_correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(i, j, corr), i < j: Pearson correlations over the rows where all columns are present; NULL for a constant column.

    Columns are centred by their means, then every task sums one triangle of products; one number per pair and task is
    shuffled.
    """
    ship(df.sparkSession)
    k = len(cols)
    upper = np.triu_indices(k)
    full = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    mean = full.agg(*[F.avg(c).alias(c) for c in cols]).first()
    centred = full.select(F.array(*[F.col(c) - F.lit(float(mean[c] or 0.0)) for c in cols]).alias("v"))

    def products(batches):
        total = np.zeros((k, k))
        for b in batches:
            if b.num_rows:
                v = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, k)
                total += v.T @ v
        yield pa.RecordBatch.from_pydict({"i": upper[0].astype(np.int32), "j": upper[1].astype(np.int32), "dot": total[upper]})

    sums = cut(centred.mapInArrow(products, "i int, j int, dot double").groupBy("i", "j").agg(F.sum("dot").alias("dot")))
    own = sums.filter("i = j")
    left, right = own.select("i", F.col("dot").alias("_x")), own.select("j", F.col("dot").alias("_y"))
    out = sums.filter("i < j").join(F.broadcast(left), "i").join(F.broadcast(right), "j")  # one row per column
    return out.select("i", "j", F.try_divide("dot", F.sqrt(F.col("_x") * F.col("_y"))).alias("corr"))


def decorrelated_programs(
    df: DataFrame, programs: Mapping[str, Column], target: str, hall: int, keep: int, ranks: bool = False
) -> DataFrame:
    """(rank, program, fitness): of the ``hall`` fittest programs, the worse of the closest pair goes until ``keep`` are left.

    Fitness is the absolute correlation with the target, equal ones by text; with ``ranks`` all correlations are Spearman's,
    over average ranks. A program without a correlation counts as 0;
    correlations that agree to 12 digits are equal, and of equally close pairs that of the fitter programs comes first.
    """
    names = {f"_p{i}": c for i, c in enumerate(programs.values())}
    texts = list(programs)
    wide = df.withColumns(names).select(*names, F.col(target).alias("_y"))
    cols = [*names, "_y"]
    if ranks:
        wide = average_rank(wide, [], {c: f"_r{c}" for c in cols})
        wide = stored(wide.select(*[F.col(f"_r{c}").alias(c) for c in cols]))
    fitness = {r["i"]: r["corr"] for r in row_correlations_with(wide, cols).collect()}
    best = sorted(range(len(texts)), key=lambda i: (-round(abs(fitness.get(i) or 0.0), 12), texts[i]))[:hall]
    closest = row_correlations(wide, [f"_p{i}" for i in best]).select("i", "j", F.round(F.coalesce(F.abs("corr"), F.lit(0.0)), 12).alias("c"))
    gone: set[int] = set()
    for r in closest.orderBy(F.desc("c"), "i", "j").collect():  # hall * (hall - 1) / 2 rows
        if len(best) - len(gone) <= keep:
            break
        if r["i"] not in gone and r["j"] not in gone:
            gone.add(r["j"])
    left = [i for k, i in enumerate(best) if k not in gone]
    rows = [(k, texts[i], float(abs(fitness.get(i) or 0.0))) for k, i in enumerate(left)]
    return df.sparkSession.createDataFrame(rows, "rank int, program string, fitness double")


def row_correlations_with(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(i, corr) of every column with the last one, over the rows where both are present, in one aggregate."""
    last = cols[-1]
    out = [F.struct(F.lit(i).alias("i"), F.corr(c, last).alias("corr")) for i, c in enumerate(cols[:-1])]
    return df.agg(F.array(*out).alias("_a")).select(F.explode("_a").alias("_a")).select("_a.*")
