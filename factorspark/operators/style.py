"""Benchmark-relative style features per (symbol, session).

All windows count a symbol's own rows. A series has one row per date, so a window task is calendar-long at
most; the benchmark table has one row per (date, session) and is broadcast only when its counted size allows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rolling import Frames, annualised_std, delta, partial_corr
from ..session import ship
from ..sources.store import write_store
from .cross_section import argmin_label, winsorize
from .panel import (
    Panel,
    benchmark_returns,
    downcast,
    measure,
    session_bars,
    session_return,
    sessions_to_long,
    sessions_to_wide,
    with_market_values,
)
from .scale import measured_side, small_side

# Benchmarks, windows in sessions and sessions per year.
BENCHMARKS = ["VBR", "QQQ", "SPY", "SPMO", "SPHQ", "SPYG"]
WINDOWS = [42, 126, 252]
ANNUAL = 504.0
EPS = 1e-8
DIFF_ROWS = 10
MIN_OLS_ROWS = 5
NATIVE_REGRESSORS = 3
SINGULAR = 1e-12  # a regressor's part that the earlier ones do not explain, beside its variance

SESSION = Frames(("symbol", "session"), "date")
DAY = Frames(("symbol",), "date")


def with_benchmarks(bars: DataFrame, bench: DataFrame, benchmarks: Sequence[str], n_dates: int | None = None) -> DataFrame:
    """Session return, the benchmark returns of the same session, and the differences.

    ``bench`` has two rows per date; with ``n_dates`` known its size need not be counted.
    """
    df = bars.withColumn("return", session_return(F.col("open"), F.col("close")))
    df = df.join(small_side(bench, 2 * n_dates) if n_dates else measured_side(bench), ["date", "session"], "left")
    return df.withColumns({f"rel_ret_{b}": F.col("return") - F.col(f"ret_{b}") for b in benchmarks})


def with_tracking(df: DataFrame, benchmarks: Sequence[str], windows: Sequence[int], annual: float = ANNUAL) -> DataFrame:
    """Tracking error and rolling correlation for each benchmark and window, all in one sorted pass."""
    cols = {}
    for b in benchmarks:
        for w in windows:
            cols[f"TE_{b}_{w}"] = annualised_std(F.col(f"rel_ret_{b}"), w, SESSION, annual)
            cols[f"CORR_{b}_{w}"] = partial_corr(F.col("return"), F.col(f"ret_{b}"), w, SESSION, w // 2)
    return df.withColumns(cols)


def with_volatility(wide: DataFrame, windows: Sequence[int], annual: float = ANNUAL) -> DataFrame:
    return wide.withColumns(
        {f"VOL_{w}_{s}": annualised_std(F.col(f"return_{s}"), w, DAY, annual) for w in windows for s in ("am", "pm")}
    )


def with_session_contrasts(wide: DataFrame, benchmarks: Sequence[str], windows: Sequence[int]) -> DataFrame:
    """Share of tracking error in volatility, AM against PM, correlations across sessions, 10-row changes."""
    cols: dict[str, Column] = {}
    for b in benchmarks:
        for w in windows:
            am, pm = F.col(f"TE_{b}_{w}_am"), F.col(f"TE_{b}_{w}_pm")
            for s in ("am", "pm"):
                cols[f"TEshare_{b}_{w}_{s}"] = F.try_divide(F.col(f"TE_{b}_{w}_{s}"), F.col(f"VOL_{w}_{s}") + EPS)
                cols[f"dTE_{b}_{w}_{s}"] = delta(F.col(f"TE_{b}_{w}_{s}"), DIFF_ROWS, DAY)
            cols[f"DTE_{b}_{w}"] = am - pm
            cols[f"RTE_{b}_{w}"] = F.try_divide(am, pm + EPS)
            cols[f"CROSS_CORR_{b}_{w}_AM_PM"] = partial_corr(F.col("return_am"), F.col(f"ret_{b}_pm"), w, DAY, w)
            cols[f"CROSS_CORR_{b}_{w}_PM_AM"] = partial_corr(F.col("return_pm"), F.col(f"ret_{b}_am"), w, DAY, w)
    return wide.withColumns(cols)


def with_closest_benchmark(wide: DataFrame, benchmarks: Sequence[str], windows: Sequence[int]) -> DataFrame:
    return wide.withColumns(
        {
            f"ARGMIN_TE_{w}_{s}": argmin_label({b: f"TE_{b}_{w}_{s}" for b in benchmarks})
            for w in windows
            for s in ("am", "pm")
        }
    )


def ols_residual_1(y: Column, x: Column, w: int, frames: Frames) -> Column:
    """Residual of the last row under the one-regressor fit of the last w rows (complete rows only, at least 5)."""
    frame = frames.last(w)
    pair = y.isNotNull() & x.isNotNull()
    py, px = F.when(pair, y), F.when(pair, x)
    fitted = F.regr_intercept(py, px).over(frame) + F.regr_slope(py, px).over(frame) * x
    ok = (F.count(F.lit(1)).over(frame) == w) & (F.count(py).over(frame) >= MIN_OLS_ROWS)
    return F.when(ok, y - fitted)


def with_rolling_residual(df: DataFrame, y: str, xs: Sequence[str], w: int, frames: Frames, name: str) -> DataFrame:
    """Residual of the last row under the least-squares fit (with intercept) on ``xs`` of the last w rows.

    Only complete rows take part: at least 5 and one more than regressors, the row itself among them. The window gives
    covariances and the row's distances from the means. Then each regressor in turn is cleared of the ones before it, in
    the covariances and in the row; what is left of y is the residual. A regressor that depends on earlier ones adds
    nothing. The steps are columns for up to three regressors, and one Arrow call on the moments beyond.
    """
    keep, k = [*df.columns, name], len(xs)
    complete = F.lit(True)
    for c in (y, *xs):
        complete = complete & F.col(c).isNotNull()
    df = df.withColumn("_ok", complete).withColumns({f"_v{i}": F.when(F.col("_ok"), F.col(c)) for i, c in enumerate((*xs, y))})
    frame = frames.last(w)
    cells = [(i, j) for i in range(k + 1) for j in range(i, k + 1) if i < k]
    df = df.withColumns(
        {f"_c{i}_{j}": F.covar_pop(f"_v{i}", f"_v{j}").over(frame) for i, j in cells}
        | {f"_d{i}": F.col(f"_v{i}") - F.avg(f"_v{i}").over(frame) for i in range(k + 1)}
        | {"_n": F.count(f"_v{k}").over(frame), "_rows": F.count(F.lit(1)).over(frame)}
    )
    if k <= NATIVE_REGRESSORS:
        for i in range(k):
            df = df.withColumn(f"_s{i}", F.col(f"_c{i}_{i}"))
        for j in range(k):
            clear = F.when(F.col(f"_c{j}_{j}") > SINGULAR * F.col(f"_s{j}"), F.lit(1.0) / F.col(f"_c{j}_{j}")).otherwise(0.0)
            df = df.withColumns({f"_f{i}": F.col(f"_c{j}_{i}") * clear for i in range(j + 1, k + 1)})
            df = df.withColumns(
                {f"_c{i}_{m}": F.col(f"_c{i}_{m}") - F.col(f"_f{i}") * F.col(f"_c{j}_{m}") for i, m in cells if i > j}
                | {f"_d{i}": F.col(f"_d{i}") - F.col(f"_f{i}") * F.col(f"_d{j}") for i in range(j + 1, k + 1)}
            )
        resid = F.col(f"_d{k}")
    else:
        ship(df.sparkSession)
        resid = _residual_of_moments(k)(F.array(*[F.col(f"_c{i}_{j}") for i, j in cells]), F.array(*[F.col(f"_d{i}") for i in range(k + 1)]))
    fits = F.col("_ok") & (F.col("_rows") == w) & (F.col("_n") >= max(MIN_OLS_ROWS, k + 1))
    return df.withColumn(name, F.when(fits, resid)).select(*keep)


def _residual_of_moments(k: int):
    """A column function of the packed covariances and the distances of a row."""
    upper = [(i, j) for i in range(k) for j in range(i, k + 1)]
    rows, cols = (np.array(x) for x in zip(*upper, strict=True))

    @F.arrow_udf("double")
    def residual(cov: pa.Array, distance: pa.Array) -> pa.Array:
        c = cov.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(upper))
        d = distance.flatten().to_numpy(zero_copy_only=False).reshape(-1, k + 1)
        full = np.zeros((len(c), k + 1, k + 1))
        full[:, rows, cols] = full[:, cols, rows] = c
        good = np.isfinite(full).all(axis=(1, 2)) & np.isfinite(d).all(axis=1)
        out = np.full(len(c), np.nan)
        beta = np.einsum("nij,nj->ni", np.linalg.pinv(full[good, :k, :k], rcond=SINGULAR, hermitian=True), full[good, :k, k])
        out[good] = d[good, k] - (beta * d[good, :k]).sum(axis=1)
        return pa.array(out, from_pandas=True)

    return residual


def with_idiosyncratic_vol(
    df: DataFrame, regressors: Sequence[str], windows: Sequence[int], keys: Sequence[str] = ("symbol", "session"), order: str = "date", annual: float = ANNUAL
) -> DataFrame:
    """``IDIOVOL_<w>``: annualised std of the rolling residuals, on rows that have a return.

    Rows without a return are a series of their own, so the others' windows skip them and nothing is joined back.
    """
    added = [f"IDIOVOL_{w}" for w in windows]
    frames = Frames((*keys, "_has"), order)
    keep = [*df.columns, *added]
    df = df.withColumn("_has", F.col("return").isNotNull())
    for w in windows:
        if len(regressors) == 1:
            df = df.withColumn(f"_r{w}", ols_residual_1(F.col("return"), F.col(regressors[0]), w, frames))
        else:
            df = with_rolling_residual(df, "return", regressors, w, frames, f"_r{w}")
    return df.withColumns({f"IDIOVOL_{w}": annualised_std(F.col(f"_r{w}"), w, frames, annual) for w in windows}).select(*keep)


def style_features(
    bars: DataFrame,
    bench: DataFrame,
    n_dates: int,
    n_symbols: int,
    benchmarks: Sequence[str] = tuple(BENCHMARKS),
    windows: Sequence[int] = tuple(WINDOWS),
    annual: float = ANNUAL,
) -> DataFrame:
    """All style features, one row per (symbol, date) with ``_am`` / ``_pm`` columns."""
    long = with_tracking(with_benchmarks(bars, bench, benchmarks, n_dates), benchmarks, windows, annual)
    long = with_idiosyncratic_vol(long, [f"ret_{b}" for b in benchmarks], windows, annual=annual)
    wide = with_volatility(sessions_to_wide(long), windows, annual)
    wide = with_session_contrasts(wide, benchmarks, windows)
    shares = [f"TEshare_{b}_{w}_{s}" for b in benchmarks for w in windows for s in ("am", "pm")]
    wide = winsorize(Panel(wide, n_dates, n_symbols), shares, 0.01).df
    return with_closest_benchmark(wide, benchmarks, windows)


def style_long(wide: DataFrame) -> DataFrame:
    """The store's long form: one row per (symbol, date, session), keys first."""
    return sessions_to_long(wide)


def build_feature_store(
    minute: DataFrame,
    path: str,
    benchmarks: Sequence[str],
    windows: Sequence[int] = tuple(WINDOWS),
    shares: DataFrame | None = None,
    benchmark_minute: DataFrame | None = None,
    ts: str = "datetime",
) -> None:
    """Minute bars to session bars, style features, long form and the partitioned store, in one job.

    ``benchmark_minute`` holds the bars of the benchmarks; by default they are among ``minute``.
    """
    _, n_dates, n_symbols = measure(minute, F.to_date(ts), F.col("symbol"))
    bars = session_bars(minute, ts)
    if shares is not None:
        bars = with_market_values(bars, shares)
    bench = benchmark_returns(session_bars(benchmark_minute if benchmark_minute is not None else minute, ts), benchmarks)
    wide = style_features(bars, bench, n_dates, n_symbols, benchmarks, windows)
    write_store(downcast(style_long(wide)), path)
