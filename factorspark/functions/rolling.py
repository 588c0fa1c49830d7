"""Rolling column functions.

Each takes the value column(s), the window length and a :class:`Frames`, and gives one column. A *strict*
function is NULL unless the whole frame is present; frames always end at the current row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

CORR_FLOOR = 1e-6  # fixed value: below this centred sum of squares the co-moment is not scaled
RSI_EPS = 1e-8  # fixed value: keeps the gain/loss ratio finite


@dataclass(frozen=True)
class Frames:
    """The row order of one time series: partition keys, order column."""

    keys: tuple[str, ...] = ("symbol",)
    order: str = "date_idx"

    def series(self):
        return Window.partitionBy(*self.keys).orderBy(self.order)

    def last(self, n: int):
        return self.series().rowsBetween(-(n - 1), 0)


def strict(x: Column, n: int, frames: Frames, value: Column) -> Column:
    return F.when(F.count(x).over(frames.last(n)) == n, value)


def full(n: int, frames: Frames, value: Column) -> Column:
    """NULL where the series has fewer than ``n`` rows so far, whatever they hold."""
    return F.when(F.count(F.lit(1)).over(frames.last(n)) == n, value)


def ref(x, d, frames):
    s = frames.series()
    return F.lag(x, d).over(s) if d >= 0 else F.lead(x, -d).over(s)


def delta(x, d, frames):
    return x - ref(x, d, frames)


def mean(x, n, frames):
    return strict(x, n, frames, F.avg(x).over(frames.last(n)))


def total(x, n, frames):
    return strict(x, n, frames, F.sum(x).over(frames.last(n)))


def std(x, n, frames):
    return strict(x, n, frames, F.stddev_samp(x).over(frames.last(n)))


def var(x, n, frames):
    return strict(x, n, frames, F.var_samp(x).over(frames.last(n)))


def skew(x, n, frames):
    return strict(x, n, frames, F.skewness(x).over(frames.last(n)))


def kurt(x, n, frames):
    """Population fourth moment over the squared *sample* variance, minus 3."""
    ratio = ((n - 1) / n) ** 2
    return strict(x, n, frames, (F.kurtosis(x).over(frames.last(n)) + 3.0) * F.lit(ratio) - 3.0)


def maximum(x, n, frames):
    return strict(x, n, frames, F.max(x).over(frames.last(n)))


def minimum(x, n, frames):
    return strict(x, n, frames, F.min(x).over(frames.last(n)))


def lower_median(x, n, frames):
    values = F.array_sort(F.collect_list(x).over(frames.last(n)))
    return strict(x, n, frames, F.get(values, F.lit((n - 1) // 2)))


def mad(x, n, frames):
    """Mean absolute deviation from the window mean."""
    values, centre = F.collect_list(x).over(frames.last(n)), F.avg(x).over(frames.last(n))
    spread = F.aggregate(values, F.lit(0.0), lambda s, v: s + F.abs(v - centre)) / F.lit(float(n))
    return strict(x, n, frames, spread)


def rank(x, n, frames):
    """Descending average-tie percentile of the last value: the largest of n gets 1/n."""
    values = F.collect_list(x).over(frames.last(n))
    above = F.size(F.filter(values, lambda v: v > x))
    reach = F.size(F.filter(values, lambda v: v >= x))
    return full(n, frames, (above + reach + F.when(reach > above, 1).otherwise(0)) / F.lit(2.0 * n))


def wma(x, n, frames):
    """Linear weights 0 .. n-1, oldest first."""
    if n < 2:
        return F.lit(None).cast("double")
    idx = F.col(frames.order).cast("double")
    w = frames.last(n)
    weighted = F.sum(idx * x).over(w) - (idx - (n - 1)) * F.sum(x).over(w)
    return strict(x, n, frames, weighted / F.lit(n * (n - 1) / 2.0))


def weighted_window(x: Column, weights: Sequence[float], frames: Frames) -> Column:
    """Dot product of a full frame with fixed weights, oldest first."""
    w = F.array(*[F.lit(float(v)) for v in weights])
    values = F.collect_list(x).over(frames.last(len(weights)))
    dot = F.aggregate(F.zip_with(values, w, lambda v, c: v * c), F.lit(0.0), lambda s, v: s + v)
    return strict(x, len(weights), frames, dot)


def ema_weights(n: int) -> list[float]:
    a = 1.0 - 2.0 / (1.0 + n)
    raw = [a**k for k in range(n, 0, -1)]
    norm = math.fsum(raw)
    return [v / norm for v in raw] if norm else []


def ema(x, n, frames):
    """Finite, normalised exponential mean over exactly n rows."""
    weights = ema_weights(n)
    return weighted_window(x, weights, frames) if weights else F.lit(None).cast("double")


def rsi(x, n, frames):
    """n - 1 changes; a missing change counts as 0."""
    if n < 2:
        return F.lit(None).cast("double")
    change = F.coalesce(x - F.lag(x, 1).over(frames.series()), F.lit(0.0))
    w = frames.last(n - 1)
    gain = F.avg(F.when(change > 0, change).otherwise(0.0)).over(w)
    loss = F.avg(F.when(change < 0, -change).otherwise(0.0)).over(w)
    return full(n, frames, 100.0 - F.lit(100.0) / (1.0 + gain / (loss + RSI_EPS)))


def _pair(x, y, n, frames, value):
    return F.when(F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).over(frames.last(n)) == n, value)


def cov(x, y, n, frames):
    return _pair(x, y, n, frames, F.covar_samp(x, y).over(frames.last(n)))


def corr(x, y, n, frames):
    w = frames.last(n)
    co = F.covar_pop(x, y).over(w) * n
    xx, yy = F.var_pop(x).over(w) * n, F.var_pop(y).over(w) * n
    scale = F.when((xx < CORR_FLOOR) | (yy < CORR_FLOOR), F.lit(1.0)).otherwise(F.sqrt(xx * yy))
    return _pair(x, y, n, frames, co / scale)


# --- partial windows -----------------------------------------------------------------------------

_PARTIAL = {
    "mean": F.avg,
    "sum": F.sum,
    "std": F.stddev_samp,
    "std_pop": F.stddev_pop,
    "var_pop": F.var_pop,
    "var": F.var_samp,
    "max": F.max,
    "min": F.min,
    "median": lambda x: F.percentile(x, F.lit(0.5)),
}


def partial(x: Column, n: int, how: str, frames: Frames, min_periods: int = 1) -> Column:
    """Aggregate of the last n rows; NULL when fewer than ``min_periods`` of them are present."""
    w = frames.last(n)
    seen = F.count(x).over(w)
    if how == "mad":
        centre = F.avg(x).over(w)
        value = F.aggregate(F.collect_list(x).over(w), F.lit(0.0), lambda s, v: s + F.abs(v - centre)) / seen
    else:
        value = _PARTIAL[how](x).over(w)
        if how in ("std", "var"):
            value = F.when(seen >= 2, value)
    return F.when(seen >= max(min_periods, 1), value)


def partial_corr(x: Column, y: Column, n: int, frames: Frames, min_periods: int) -> Column:
    """Correlation over the complete pairs of the last n rows."""
    w = frames.last(n)
    paired = x.isNotNull() & y.isNotNull()
    px, py = F.when(paired, x), F.when(paired, y)
    sx, sy = F.stddev_pop(px).over(w), F.stddev_pop(py).over(w)
    value = F.try_divide(F.covar_pop(px, py).over(w), sx * sy)
    return F.when(F.count(px).over(w) >= max(min_periods, 2), value)


def annualised_std(x: Column, n: int, frames: Frames, periods: float = 504.0, min_periods: int | None = None) -> Column:
    return partial(x, n, "std", frames, n // 2 if min_periods is None else min_periods) * F.lit(math.sqrt(periods))
