"""What differs between the three meanings of the same operator names.

``core`` is dense and strict. ``scoring`` uses partial windows over a symbol's own rows. ``deploy`` evaluates on
the last rows of a bounded history with population moments.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions import scalar as S
from .operators import Elementwise, Operator, PairRolling, Rolling, SeriesFrame, ema_reach, recursive_ema

EPS = 1e-8  # fixed value
DEPLOY_HISTORY = 120  # fixed value: rows of history a deployed formula sees


def _soft_div(a, b):
    return F.try_divide(a, b + EPS)


def _above(a, b):
    return S.both(a, b, F.when(a > b, 1.0).otherwise(0.0))


def _below(a, b):
    return S.both(a, b, F.when(a < b, 1.0).otherwise(0.0))


def _rolling(how):
    return lambda x, n, frames: R.partial(x, n, how, frames)


def _whole(x, n, frames, value):
    """Any missing value in the (possibly short) frame makes the result missing."""
    w = frames.last(n)
    return F.when(F.count(x).over(w) == F.count(F.lit(1)).over(w), value)


def _deploy(how):
    return lambda x, n, frames: _whole(x, n, frames, R.partial(x, n, how, frames))


def _values(x, n, frames):
    return F.collect_list(x).over(frames.last(n))


def _median(values):
    s = F.array_sort(values)
    n = F.size(s)
    low, high = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return (low + high) / 2.0


def _median_abs_dev(x, n, frames):
    values = _values(x, n, frames)
    centre = R.partial(x, n, "median", frames)
    return _whole(x, n, frames, _median(F.transform(values, lambda v: F.abs(v - centre))))


def _linear(x, n, frames):
    values = _values(x, n, frames)
    size = F.size(values)
    dot = F.aggregate(F.transform(values, lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return _whole(x, n, frames, F.try_divide(dot, size * (size + 1) / 2.0))


def _window_recursive(x, n, frames):
    values = _values(x, n, frames)
    a = F.lit(2.0) / (F.size(values) + 1)
    rest = F.slice(values, 2, n)
    run = F.aggregate(rest, F.get(values, F.lit(0)), lambda e, v: a * v + (F.lit(1.0) - a) * e)
    return _whole(x, n, frames, run)


def _nth_last(x, n, frames):
    return F.lag(x, n - 1).over(frames.series()) if n > 0 else F.lit(None).cast("double")


def _change(x, n, frames):
    if n <= 0:
        return F.when(x.isNotNull(), F.lit(0.0))
    short = F.count(F.lit(1)).over(frames.last(n)) < n
    return F.when(short, F.lit(0.0)).otherwise(x - _nth_last(x, n, frames))


def _history_rank(x, n, frames):
    """Average-tie ascending percentile of the last value in the history, whatever window is asked for."""
    values = _values(x, DEPLOY_HISTORY, frames)
    below, upto = F.size(F.filter(values, lambda v: v < x)), F.size(F.filter(values, lambda v: v <= x))
    return F.when(x.isNotNull(), F.try_divide(below + upto + 1, F.size(values) * 2.0))


def _short_zero(agg):
    def fn(x, y, n, frames):
        w = frames.last(n)
        seen = F.count(F.lit(1)).over(w)
        paired = F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).over(w)
        return F.when(seen < n, F.lit(0.0)).when(paired == n, agg(x, y, w))

    return fn


def _sample_cov(x, y, w):
    return F.covar_samp(x, y).over(w)


def _plain_corr(x, y, w):
    return F.try_divide(F.covar_pop(x, y).over(w), F.stddev_pop(x).over(w) * F.stddev_pop(y).over(w))


def _table(*ops: Operator) -> dict[str, Operator]:
    return {op.name: op for op in ops}


def _true_dema(x, n, frames):
    e = R.ema(x, n, frames)
    return 2.0 * e - R.ema(e, n, frames)


def _true_tema(x, n, frames):
    e = R.ema(x, n, frames)
    ee = R.ema(e, n, frames)
    return 3.0 * e - 3.0 * ee + R.ema(ee, n, frames)


_SCORING = _table(
    Elementwise("Div", _soft_div, 2),
    Elementwise("Log", lambda x: F.ln(F.abs(x) + EPS)),
    Elementwise("Greater", _above, 2),
    Elementwise("Less", _below, 2),
    *[
        Rolling(name, _rolling(how))
        for name, how in [
            ("Mean", "mean"),
            ("Sum", "sum"),
            ("Std", "std"),
            ("Var", "var"),
            ("Max", "max"),
            ("Min", "min"),
            ("Med", "median"),
            ("Mad", "mad"),
        ]
    ],
    SeriesFrame("EMA", recursive_ema, reach=ema_reach),
)

_DEPLOY = _table(
    Elementwise("Div", _soft_div, 2),
    Elementwise("Log", lambda x: F.when(x.isNotNull(), F.ln(F.greatest(x, F.lit(EPS))))),
    Elementwise("Sqrt", S.sqrt_floor),
    *[
        Rolling(name, _deploy(how))
        for name, how in [
            ("Mean", "mean"),
            ("Sum", "sum"),
            ("Std", "std_pop"),
            ("Var", "var_pop"),
            ("Max", "max"),
            ("Min", "min"),
            ("Med", "median"),
        ]
    ],
    Rolling("Mad", _median_abs_dev),
    Rolling("WMA", _linear),
    Rolling("EMA", _window_recursive),
    Rolling("Ref", _nth_last),
    Rolling("Delta", _change),
    Rolling("Rank", _history_rank, reach=lambda n: DEPLOY_HISTORY - 1),
    PairRolling("Cov", _short_zero(_sample_cov)),
    PairRolling("Corr", _short_zero(_plain_corr)),
)

# DEMA and TEMA as documented rather than as the plain EMA they reduce to.
_TRUE_MA = _table(
    Rolling("DEMA", _true_dema, reach=lambda n: 2 * (n - 1)),
    Rolling("TEMA", _true_tema, reach=lambda n: 3 * (n - 1)),
)

OVERRIDES: dict[str, dict[str, Operator]] = {
    "core": {},
    "core_true_ma": _TRUE_MA,
    "scoring": _SCORING,
    "deploy": _DEPLOY,
}

__all__ = ["OVERRIDES", "EPS", "DEPLOY_HISTORY"]
