"""Operators over all symbols of a date.

Statistics per date are plain aggregates joined back, so rows never have to meet in one task per date; the
joined side has one row per date and is broadcast while the (measured) calendar is short enough. Orders inside
a date use a window only while the (measured) widest date fits a task, see ``scale``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import Panel
from . import scale
from .scale import average_rank, group_percentiles, position_in_group, small_side


def _standardised(
    panel: Panel,
    cols: Sequence[str],
    spread: Callable,
    divisor: Callable[[Column, Column], Column],
    by: Sequence[str] = ("date",),
    missing: float | None = 0.0,
) -> Panel:
    stats = panel.df.groupBy(*by).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in cols],
        *[spread(c).alias(f"_s_{c}") for c in cols],
        *[F.count(c).alias(f"_n_{c}") for c in cols],
    )
    joined = panel.df.join(small_side(stats, panel.n_dates), list(by))
    out = {}
    for c in cols:
        z = F.try_divide(F.col(c) - F.col(f"_m_{c}"), divisor(F.col(f"_s_{c}"), F.col(f"_n_{c}")))
        out[c] = z if missing is None else F.coalesce(z, F.lit(missing))
    return panel.over(joined.withColumns(out).select(*panel.df.columns))


def zscore(panel: Panel, cols: Sequence[str]) -> Panel:
    """(x - mean) / population std per date; missing values and constant dates give 0."""
    return _standardised(panel, cols, F.stddev_pop, lambda s, n: s)


def zscore_guarded(panel: Panel, cols: Sequence[str], min_valid: int = 2, floor: float = 1e-8) -> Panel:
    """As :func:`zscore`, but 0 also when a date has too few values or almost no spread."""
    return _standardised(panel, cols, F.stddev_pop, lambda s, n: F.when((n >= min_valid) & (s >= floor), s))


def zscore_sample(panel: Panel, cols: Sequence[str]) -> Panel:
    """(x - mean) / sample std per date; missing stays missing."""
    return _standardised(panel, cols, F.stddev_samp, lambda s, n: s, missing=None)


def _with_percentiles(panel: Panel, cols: Sequence[str], probs: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Columns ``_q_<col>`` with the percentiles of the row's date: one window pass over dates that fit a task
    (nothing upstream is computed twice), else the distributed percentiles joined back."""
    if panel.n_symbols * len(cols) <= scale.MAX_GROUP_ROWS:  # one buffer of a date's values for each column
        wanted, day = F.array(*[F.lit(float(p)) for p in probs]), Window.partitionBy(*by)
        return panel.df.withColumns({f"_q_{c}": F.percentile(c, wanted).over(day) for c in cols})
    limits = group_percentiles(panel.df, by, cols, probs, ["symbol"], panel.n_symbols * len(cols))
    limits = limits.select(*by, *[F.col(c).alias(f"_q_{c}") for c in cols])
    return panel.df.join(small_side(limits, panel.n_dates), list(by), "left")


def winsorize(panel: Panel, cols: Sequence[str], p: float = 0.01, by: Sequence[str] = ("date",)) -> Panel:
    """Clip to the p and 1-p quantiles of the date; missing stays missing."""
    joined = _with_percentiles(panel, cols, [p, 1 - p], by)
    clipped = {
        c: F.when(
            F.col(c).isNotNull(),
            F.least(F.greatest(F.col(c), F.get(f"_q_{c}", F.lit(0))), F.get(f"_q_{c}", F.lit(1))),
        )
        for c in cols
    }
    return panel.over(joined.withColumns(clipped).select(*panel.df.columns))


def rank_average(panel: Panel, col: str, name: str) -> Panel:
    return panel.over(average_rank(panel.df, ["date"], {col: name}, panel.n_symbols))


def median_fill(panel: Panel, cols: Sequence[str]) -> Panel:
    joined = _with_percentiles(panel, cols, [0.5], ["date"])
    filled = {c: F.coalesce(F.col(c), F.get(f"_q_{c}", F.lit(0))) for c in cols}
    return panel.over(joined.withColumns(filled).select(*panel.df.columns))


def rank_columns(panel: Panel, score: str) -> Panel:
    """``rank`` 1..n by score (best first, ties by symbol) and ``percentile`` = rank / n * 100."""
    valid = panel.df.filter(F.col(score).isNotNull())
    placed = position_in_group(valid, ["date"], [F.col(score).desc(), F.col("symbol")], "rank", panel.n_symbols)
    if panel.n_symbols <= scale.MAX_GROUP_ROWS:
        sized = placed.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("date")))
    else:
        sized = placed.join(small_side(valid.groupBy("date").agg(F.count(F.lit(1)).alias("_n")), panel.n_dates), "date")
    return panel.over(
        sized.withColumn("rank", F.col("rank") + 1).withColumn("percentile", F.col("rank") / F.col("_n") * 100.0).drop("_n")
    )


def argmin_label(labels: dict[str, Column | str]) -> Column:
    """The label of the first column that holds the smallest present value; NULL when none is present."""
    entries = F.array(
        *[
            F.when(F.col(c).isNotNull() if isinstance(c, str) else c.isNotNull(), F.struct((F.col(c) if isinstance(c, str) else c).alias("v"), F.lit(i).alias("i"), F.lit(name).alias("name")))
            for i, (name, c) in enumerate(labels.items())
        ]
    )
    return F.array_min(F.array_compact(entries))["name"]
