"""Information coefficients, candidate scores and turnover.

Everything per date is an aggregate with map-side combine; only daily series (one row per date) flow further.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.evaluate import add_factors
from ..plans.formula import DEFAULT, FormulaOptions, Node
from ..session import ship
from .cross_section import rank_average, zscore
from .panel import Panel
from .scale import join_in_span, measured_side, small_side, spread, top_in_group

IC_STD_FLOOR = 1e-3  # fixed value: below this spread the covariance is not scaled
WIDE_PAIRS = 12  # up to this many columns all pairs fit one aggregate
ICIR_STD_FLOOR = 1e-6  # fixed value
CANDIDATE_BATCH = 200  # formulas of one projection
ROWS_PER_SALT = 250_000  # symbols of one date that a task sums
HELD_NUMBERS = 8_000_000  # doubles a task holds before it passes its partial sums on


def forward_return(h: int = 20, close: str = "close") -> str:
    """The default target as a formula."""
    return f"Sub(Div(Ref(${close},-{h}d),${close}),1.0)"


def _guarded(cov: Column, sx: Column, sy: Column) -> Column:
    floor = (sx < IC_STD_FLOOR) | (sy < IC_STD_FLOOR)
    return cov / F.when(floor, F.lit(1.0)).otherwise(sx * sy)


def daily_correlations(df: DataFrame, pairs: Mapping[str, tuple[str, str]], by: Sequence[str] = ("date",)) -> DataFrame:
    """One correlation column per named pair, over the rows where both sides are present, in one aggregate."""
    moments, out = [], []
    for name, (x, y) in pairs.items():
        paired = F.col(x).isNotNull() & F.col(y).isNotNull()
        px, py = F.when(paired, F.col(x)), F.when(paired, F.col(y))
        moments += [
            F.covar_pop(px, py).alias(f"_c_{name}"),
            F.stddev_pop(px).alias(f"_x_{name}"),
            F.stddev_pop(py).alias(f"_y_{name}"),
        ]
        out.append(_guarded(F.col(f"_c_{name}"), F.col(f"_x_{name}"), F.col(f"_y_{name}")).alias(name))
    return df.groupBy(*by).agg(*moments).select(*by, *out)


def daily_ic(df: DataFrame, x: str, y: str, name: str = "ic", by: Sequence[str] = ("date",)) -> DataFrame:
    """Pearson correlation per date over the pairs where both sides are present."""
    return daily_correlations(df, {name: (x, y)}, by)


def daily_rank_ic(panel: Panel, x: str, y: str, name: str = "rank_ic") -> DataFrame:
    """Spearman correlation per date over the complete pairs."""
    paired = F.col(x).isNotNull() & F.col(y).isNotNull()
    pairs = panel.over(panel.df.filter(paired).select("symbol", "date", F.col(x).alias("_x"), F.col(y).alias("_y")))
    ranked = rank_average(rank_average(pairs, "_x", "_rx"), "_y", "_ry")
    return daily_ic(ranked.df, "_rx", "_ry", name)


def normalised_ic(df: DataFrame, x: Column, y: Column, by: Sequence[str]) -> DataFrame:
    """IC between z(x) and z(y), where z standardises per date and puts missing values at 0.

    The z-scores are never built: the means, spreads and co-moments of one aggregate give the same number, so
    the panel is not shuffled by date. With n rows on the date, z(x) has mean 0 and variance n_x / n, and the
    product sum is the co-moment of the complete pairs moved to the means of each side's own values.
    """
    paired = x.isNotNull() & y.isNotNull()
    agg = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(x).alias("nx"),
        F.count(y).alias("ny"),
        F.avg(x).alias("mx"),
        F.avg(y).alias("my"),
        F.stddev_pop(x).alias("sx"),
        F.stddev_pop(y).alias("sy"),
        F.covar_pop(x, y).alias("c"),
        F.count(F.when(paired, 1)).alias("nb"),
        F.avg(F.when(paired, x)).alias("bx"),
        F.avg(F.when(paired, y)).alias("by"),
    )
    c = F.col
    product = c("nb") * (c("c") + (c("bx") - c("mx")) * (c("by") - c("my")))
    cov = F.coalesce(F.try_divide(product, c("sx") * c("sy")), F.lit(0.0)) / c("n")
    zx = F.when(c("sx") > 0, F.sqrt(c("nx") / c("n"))).otherwise(0.0)
    zy = F.when(c("sy") > 0, F.sqrt(c("ny") / c("n"))).otherwise(0.0)
    return agg.select(*by, _guarded(cov, zx, zy).alias("ic"))


def alpha_daily_ic(panel: Panel, alpha: str, target: str) -> DataFrame:
    """Daily IC of one normalised alpha against the normalised target: (date, ic)."""
    return normalised_ic(panel.df, F.col(alpha), F.col(target), ["date"])


def alpha_daily_rank_ic(panel: Panel, alpha: str, target: str) -> DataFrame:
    z = zscore(panel.over(panel.df.select("symbol", "date", alpha, target)), [alpha, target])
    return daily_rank_ic(z, alpha, target)


def series_summary(daily: DataFrame, col: str, mean: str, ir: str | None = None) -> DataFrame:
    """Mean of a daily series and mean / sample std."""
    out = [F.avg(col).alias(mean)]
    if ir:
        out.append(F.try_divide(F.avg(col), F.stddev_samp(col)).alias(ir))
    return daily.agg(*out)


def daily_both(complete: Panel, x: str, y: str) -> DataFrame:
    """(date, ic, rank_ic) of two columns without missing values: the ranks ride along with the values, so both
    correlations come from one aggregate on rows that are already together by date."""
    ranked = rank_average(rank_average(complete, x, "_rx"), y, "_ry")
    return daily_correlations(ranked.df, {"ic": (x, y), "rank_ic": ("_rx", "_ry")})


def both_summary(daily: DataFrame) -> DataFrame:
    """One row: ic, icir, rank_ic, rank_icir."""
    return daily.agg(
        F.avg("ic").alias("ic"),
        F.try_divide(F.avg("ic"), F.stddev_samp("ic")).alias("icir"),
        F.avg("rank_ic").alias("rank_ic"),
        F.try_divide(F.avg("rank_ic"), F.stddev_samp("rank_ic")).alias("rank_icir"),
    )


def alpha_summary(panel: Panel, alpha: str, target: str) -> DataFrame:
    """One row: ic, icir, rank_ic, rank_icir of one normalised alpha."""
    z = zscore(panel.over(panel.df.select("symbol", "date", alpha, target)), [alpha, target])
    return both_summary(daily_both(z, alpha, target))


def lower_confidence_bound(daily: DataFrame, beta: float, col: str = "ic") -> DataFrame:
    return daily.agg((F.avg(col) - F.lit(float(beta)) * F.stddev_samp(col)).alias("lcb"))


# --- pairs of alphas -----------------------------------------------------------------------------


class Pairs(NamedTuple):
    """Which products of columns are summed: the upper triangle of one list, or all of ``left`` x ``right``."""

    left: int
    right: int | None = None

    def products(self, v: np.ndarray) -> np.ndarray:
        if self.right is None:
            return (v.T @ v)[np.triu_indices(self.left)]
        a, b = v[:, : self.left], v[:, self.left :]
        return np.concatenate(((a.T @ b).ravel(), (a * a).sum(axis=0), (b * b).sum(axis=0)))

    def correlations(self, mean: np.ndarray) -> np.ndarray:
        """(left, right) from the mean products of columns of mean 0."""
        if self.right is None:
            cov = np.zeros((self.left, self.left))
            cov[np.triu_indices(self.left)] = mean
            cov += np.triu(cov, 1).T
            sx = sy = np.sqrt(np.diag(cov))
        else:
            cov, squares = mean[: self.left * self.right].reshape(self.left, self.right), mean[self.left * self.right :]
            sx, sy = np.sqrt(squares[: self.left]), np.sqrt(squares[self.left :])
        scale = np.outer(sx, sy)
        scale[(sx < IC_STD_FLOOR)[:, None] | (sy < IC_STD_FLOOR)] = 1.0
        return cov / scale


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(date, n, dots) of successive rows of one date, added up."""
    day, n, dots = None, 0, None
    for b in batches:
        for date, count, row in zip(b.column("date").to_pylist(), b.column("n").to_pylist(), b.column("dots"), strict=True):
            if n and date != day:
                yield day, n, dots
                n, dots = 0, None
            values = row.values.to_numpy(zero_copy_only=False)
            day, n, dots = date, n + count, values.copy() if dots is None else dots + values
    if n:
        yield day, n, dots


def product_blocks(z: Panel, cols: Sequence[str], pairs: Pairs, salts: int | None = None) -> DataFrame:
    """(date, n, dots): sums of products of normalised columns as one array per part of a date; a date's parts are in one task, in order.

    Rows are spread by (date, hash of the symbol), so a wide date is shared by ``salts`` tasks; each task adds up one
    array per date. Only these arrays are shuffled by date.
    """
    ship(z.df.sparkSession)
    salts = salts or 1 + z.n_symbols // ROWS_PER_SALT
    slim = z.df.select("date", F.pmod(F.xxhash64("symbol"), F.lit(salts)).alias("_salt"), F.array(*[F.col(c) for c in cols]).alias("v"))
    date_type = slim.schema["date"].dataType.simpleString()

    def blocks(batches):
        held: dict = {}
        limit = 0
        for pdf in batches:
            for day, g in pdf.groupby("date", sort=False):
                made = pairs.products(np.stack(g["v"].to_numpy()))
                n, dots = held.get(day, (0, 0.0))
                held[day] = (n + len(g), dots + made)
                limit = max(1, HELD_NUMBERS // len(made))
            if len(held) > limit:
                yield emitted(held)
                held = {}
        if held:
            yield emitted(held)

    def emitted(held):
        return pd.DataFrame({"date": list(held), "n": [n for n, _ in held.values()], "dots": [d for _, d in held.values()]})

    parts = spread(slim, "date", "_salt").mapInPandas(blocks, f"date {date_type}, n long, dots array<double>")
    return spread(parts, "date").sortWithinPartitions("date")


def daily_products(z: Panel, cols: Sequence[str]) -> DataFrame:
    """(date, v): mean products of all pairs i <= j of normalised columns, one array per date."""
    blocks = product_blocks(z, cols, Pairs(len(cols)))
    date_type = blocks.schema["date"].dataType.simpleString()

    def means(batches):
        for day, n, dots in _summed(batches):
            yield pd.DataFrame({"date": [day], "v": [dots / n]})

    return blocks.mapInArrow(lambda batches: _as_arrow(means(batches), date_type, "v"), f"date {date_type}, v array<double>")


def _as_arrow(frames: Iterator[pd.DataFrame], date_type: str, name: str) -> Iterator[pa.RecordBatch]:
    kind = {"date": pa.date32(), "timestamp_ntz": pa.timestamp("us"), "timestamp": pa.timestamp("us", tz="UTC")}[date_type]
    for f in frames:
        columns = {c: pa.array(f[c].tolist(), kind if c == "date" else pa.list_(pa.float64()) if c == name else pa.int32()) for c in f}
        yield pa.RecordBatch.from_pydict(columns)


def daily_correlation_rows(z: Panel, cols: Sequence[str], pairs: Pairs) -> DataFrame:
    """(date, i, ics): correlations of left column i with every right column, one array per date and left column."""
    blocks = product_blocks(z, cols, pairs)
    date_type = blocks.schema["date"].dataType.simpleString()

    def rows(batches):
        for day, n, dots in _summed(batches):
            ics = pairs.correlations(dots / n)
            yield pd.DataFrame({"date": [day] * len(ics), "i": range(len(ics)), "ics": list(ics)})

    return blocks.mapInArrow(lambda batches: _as_arrow(rows(batches), date_type, "ics"), f"date {date_type}, i int, ics array<double>")


def mean_correlation_rows(z: Panel, cols: Sequence[str], pairs: Pairs) -> DataFrame:
    """(i, ics): mean over dates of the correlations of left column i with every right column.

    Dates are added up inside the tasks; what is shuffled is one array per task and left column.
    """
    blocks = product_blocks(z, cols, pairs)

    def partial(batches):
        total, days = 0.0, 0
        for _, n, dots in _summed(batches):
            total, days = total + pairs.correlations(dots / n), days + 1
        if days:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()), "days": pa.array([days] * len(total), pa.int64()), "ics": pa.array(list(total), pa.list_(pa.float64()))})

    def mean(pdf):
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "ics": [np.sum(np.stack(pdf["ics"].to_numpy()), axis=0) / pdf["days"].sum()]})

    parts = blocks.mapInArrow(partial, "i int, days long, ics array<double>")
    return parts.groupBy("i").applyInPandas(mean, "i int, ics array<double>")


def unpacked(rows: DataFrame) -> DataFrame:
    """(..., i, j, ic) for i < j of rows (..., i, ics)."""
    rest = [c for c in rows.columns if c != "ics"]
    return rows.select(*rest, F.posexplode("ics").alias("j", "ic")).filter("i < j")


def mutual_ic_daily(panel: Panel, cols: Sequence[str]) -> DataFrame:
    """(date, i, j, ic) for every pair i < j of normalised alphas (positions in ``cols``)."""
    z = zscore(panel.over(panel.df.select("symbol", "date", *cols)), cols)
    if len(cols) > WIDE_PAIRS:
        return unpacked(daily_correlation_rows(z, cols, Pairs(len(cols))))
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    agg = z.df.groupBy("date").agg(
        *[F.stddev_pop(c).alias(f"_s{i}") for i, c in enumerate(cols)],
        *[F.covar_pop(cols[i], cols[j]).alias(f"_c{i}_{j}") for i, j in pairs],
    )
    entries = [
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), _guarded(F.col(f"_c{i}_{j}"), F.col(f"_s{i}"), F.col(f"_s{j}")).alias("ic"))
        for i, j in pairs
    ]
    return agg.select("date", F.explode(F.array(*entries)).alias("_p")).select("date", "_p.*")


def mutual_ic_matrix(panel: Panel, cols: Sequence[str]) -> DataFrame:
    """(i, j, ic): mean over dates, symmetric, unit diagonal."""
    if len(cols) > WIDE_PAIRS:
        z = zscore(panel.over(panel.df.select("symbol", "date", *cols)), cols)
        mean = unpacked(mean_correlation_rows(z, cols, Pairs(len(cols))))
    else:
        mean = mutual_ic_daily(panel, cols).groupBy("i", "j").agg(F.avg("ic").alias("ic"))
    sides = F.array(F.struct("i", "j", "ic"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "ic"))
    off = mean.select(F.explode(sides).alias("_p")).select("_p.*")
    spark = panel.df.sparkSession
    return off.unionByName(spark.createDataFrame([(i, i, 1.0) for i in range(len(cols))], off.schema))


# --- combinations --------------------------------------------------------------------------------


def combine(panel: Panel, weights: Mapping[str, float], name: str = "score") -> Panel:
    """Sum of weight * column, as an ordinary projection."""
    total = None
    for c, w in weights.items():
        term = F.col(c) * F.lit(float(w))
        total = term if total is None else total + term
    return panel.over(panel.df.withColumn(name, total))


def pool_scores(panel: Panel, pool: Mapping[str, float], target: str, options: FormulaOptions = DEFAULT) -> Panel:
    """(symbol, date, date_idx, score, target): weighted sum of the normalised formulas, and the normalised target."""
    names = {f"_a{i}": f for i, f in enumerate(pool)}
    wide = add_factors(panel, {**names, "target": target}, options)
    slim = wide.over(wide.df.select("symbol", "date", "date_idx", *names, "target"))
    z = zscore(slim, [*names, "target"])
    scored = combine(z, {n: pool[f] for n, f in names.items()})
    return scored.over(scored.df.select("symbol", "date", "date_idx", "score", "target"))


def pool_daily(panel: Panel, pool: Mapping[str, float], target: str, options: FormulaOptions = DEFAULT) -> DataFrame:
    """(date, ic, rank_ic) of a pool."""
    return daily_both(pool_scores(panel, pool, target, options), "score", "target")


def pool_metrics(panel: Panel, pool: Mapping[str, float], target: str, options: FormulaOptions = DEFAULT) -> DataFrame:
    return both_summary(pool_daily(panel, pool, target, options))


def segment_metrics(daily: DataFrame, segments: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per-segment means weighted by the number of days. ``segments``: (segment, start_date, end_date)."""
    per = (
        join_in_span(daily, segments, "date", "start_date", "end_date")
        .groupBy("segment")
        .agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(c) for c in cols])
    )
    return per.agg(*[F.try_divide(F.sum(F.col(c) * F.col("_n")), F.sum("_n")).alias(c) for c in cols])


# --- candidates ----------------------------------------------------------------------------------


def score_candidates(
    panel: Panel,
    formulas: Sequence[str],
    target: str,
    options: FormulaOptions = DEFAULT,
    missing: float = -1.0,
    max_parentheses: int | None = None,
) -> DataFrame:
    """(expr, ic) for a list of formulas in one job; equal formulas are scored once.

    Formulas with more than ``max_parentheses`` parentheses get the ``missing`` score and are not evaluated. The
    panel is unpivoted to one row per (row, formula) and reduced map-side to one row per (formula, date).
    """
    distinct = list(dict.fromkeys(formulas))
    limit = max_parentheses if max_parentheses is not None else float("inf")
    formulas = [f for f in distinct if f.count("(") + f.count(")") <= limit]
    skipped = [(f, missing) for f in distinct if f not in set(formulas)]
    if skipped:
        rest = panel.df.sparkSession.createDataFrame(skipped, "expr string, ic double")
        return score_candidates(panel, formulas, target, options, missing).unionByName(rest) if formulas else rest
    parts = [formulas[a : a + CANDIDATE_BATCH] for a in range(0, len(formulas), CANDIDATE_BATCH)]
    scores = [_score_batch(panel, part, target, options, missing) for part in parts]
    return reduce(DataFrame.unionByName, scores)


def _score_batch(panel: Panel, formulas: Sequence[str], target: str, options: FormulaOptions, missing: float) -> DataFrame:
    """Rows carry a formula's number; its text comes back after the last shuffle."""
    names = {f"_f{i}": f for i, f in enumerate(formulas)}
    wide = add_factors(panel, {**names, "_y": target}, options).df
    pairs = F.array(*[F.struct(F.lit(i).alias("id"), F.col(n).alias("x")) for i, n in enumerate(names)])
    rows = wide.select("date", "_y", F.explode(pairs).alias("_p")).select("date", "_y", "_p.*")
    daily = normalised_ic(rows, F.col("x"), F.col("_y"), ["id", "date"])
    scores = daily.groupBy("id").agg(F.coalesce(F.avg("ic"), F.lit(missing)).alias("ic"))
    return scores.select(F.get(F.array(*[F.lit(f) for f in formulas]), F.col("id")).alias("expr"), "ic")


def score_rounds(
    panel: Panel, rounds: Iterable[Sequence[str]], target: str, hook: Callable[[int, DataFrame], None], options: FormulaOptions = DEFAULT
) -> None:
    """Score one list of formulas after another and call ``hook(round, scores)`` for each."""
    for i, formulas in enumerate(rounds):
        hook(i, score_candidates(panel, formulas, target, options))


def top_candidates(scores: DataFrame, n: int) -> DataFrame:
    return scores.orderBy(F.col("ic").desc(), "expr").limit(n)


# --- turnover and objective ----------------------------------------------------------------------


def selection_turnover_samples(
    panel: Panel, score: str, horizon: int = 1, top_k: int | None = None, ratio: float = 0.1
) -> DataFrame:
    """(date_idx, turnover): share of the top k that is not in the top k ``horizon`` dates later.

    Only every ``horizon``-th date is ranked. Each selected name is tagged with the (at most two) comparisons
    it takes part in; a name counted twice in a comparison stayed. No self join.
    """
    n_assets = panel.df.select("symbol").distinct().count()
    k = min(top_k, n_assets) if top_k else max(1, min(n_assets, round(n_assets * (ratio if ratio > 0 else 0.1))))
    h, last = max(1, horizon), panel.n_dates - max(1, horizon)
    step = panel.df.filter((F.col("date_idx") % h == 0) & F.col(score).isNotNull()).select("symbol", "date", "date_idx", score)
    valid = step.groupBy("date_idx").agg(F.count(F.lit(1)).alias("_n"))
    later = valid.select((F.col("date_idx") - h).alias("date_idx"), F.col("_n").alias("_n2"))
    sizes = (
        valid.join(small_side(later, panel.n_dates), "date_idx")
        .filter(F.col("date_idx") < last)
        .select(F.col("date_idx").alias("start"), F.least(F.lit(k), "_n", "_n2").alias("k"))
    )
    best = top_in_group(step, ["date_idx"], [F.col(score).desc(), F.col("symbol")], k, "_at")
    tagged = best.select(
        "symbol", "_at", F.explode(F.array(F.col("date_idx"), F.col("date_idx") - h)).alias("start")
    )
    stayed = (
        tagged.join(small_side(sizes, panel.n_dates), "start")
        .filter(F.col("_at") <= F.col("k"))
        .groupBy("start", "symbol", "k")
        .count()
        .groupBy("start", "k")
        .agg(F.count(F.when(F.col("count") == 2, 1)).alias("_stayed"))
    )
    return stayed.select(F.col("start").alias("date_idx"), (1.0 - F.col("_stayed") / F.col("k")).alias("turnover"))


def selection_turnover(panel: Panel, score: str, horizon: int = 1, top_k: int | None = None, ratio: float = 0.1) -> DataFrame:
    samples = selection_turnover_samples(panel, score, horizon, top_k, ratio)
    return samples.agg(F.coalesce(F.avg("turnover"), F.lit(0.0)).alias("turnover"))


def objective(ic_daily: DataFrame, turnover: DataFrame | None = None, use_icir: bool = False, penalty: float = 0.0) -> DataFrame:
    """IC [+ ICIR] [- penalty * turnover] in one row; plain IC when both switches are off."""
    s = F.stddev_samp("ic")
    icir = F.when(s.isNull() | (s < ICIR_STD_FLOOR), F.lit(0.0)).otherwise(F.avg("ic") / s) if use_icir else F.lit(0.0)
    base = ic_daily.agg(F.avg("ic").alias("ic"), icir.alias("icir"))
    cost = F.lit(0.0)
    if penalty > 0 and turnover is not None:
        cost = F.lit(float(penalty)) * turnover.select("turnover").scalar()
    return base.withColumn("penalty", cost).withColumn("objective", F.col("ic") + F.col("icir") - F.col("penalty"))


class FactorEvaluator:
    """What any evaluator offers; subclass it to plug in another way of scoring formulas."""

    def single_ic(self, formula: str | Node) -> float:
        raise NotImplementedError

    def single_rank_ic(self, formula: str | Node) -> float:
        raise NotImplementedError

    def mutual_ic(self, a: str | Node, b: str | Node) -> float:
        raise NotImplementedError

    def pool_metrics(self, pool: Mapping[str, float]) -> dict[str, float]:
        raise NotImplementedError


class SparkEvaluator(FactorEvaluator):
    """Scores formulas on a panel against a target formula; each call is one small-result job."""

    def __init__(self, panel: Panel, target: str, options: FormulaOptions = DEFAULT):
        self.panel, self.target, self.options = panel, target, options

    def _pair(self, a, b) -> Panel:
        wide = add_factors(self.panel, {"_a": a, "_b": b}, self.options)
        return wide.over(wide.df.select("symbol", "date", "date_idx", "_a", "_b"))

    def single_ic(self, formula) -> float:
        return alpha_daily_ic(self._pair(formula, self.target), "_a", "_b").agg(F.avg("ic")).first()[0]

    def single_rank_ic(self, formula) -> float:
        return alpha_daily_rank_ic(self._pair(formula, self.target), "_a", "_b").agg(F.avg("rank_ic")).first()[0]

    def mutual_ic(self, a, b) -> float:
        return alpha_daily_ic(self._pair(a, b), "_a", "_b").agg(F.avg("ic")).first()[0]

    def pool_metrics(self, pool) -> dict[str, float]:
        return pool_metrics(self.panel, pool, self.target, self.options).first().asDict()

    def scores(self, formulas: Sequence[str]) -> DataFrame:
        return score_candidates(self.panel, formulas, self.target, self.options)


