"""Pools of formulas: statistics come from Spark in one pass per batch, only K x K numbers reach the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.evaluate import add_factors
from ..plans.formula import DEFAULT, FormulaOptions, parse
from ..session import cut, ship
from .cross_section import zscore
from .metrics import CANDIDATE_BATCH, IC_STD_FLOOR, Pairs, daily_products, mean_correlation_rows, mutual_ic_matrix, score_candidates
from .panel import Panel
from .scale import top_in_group

MUTUAL_LIMIT = 0.99  # fixed value: a candidate this close to a member adds nothing
LOCAL_NUMBERS = 2_000_000  # per-date products up to this many numbers are read once instead of by a job per step
LEAST_BATCH = 16  # candidates of one job over the panel
ICIR_FLOOR = 1e-12


@dataclass
class PoolStatistics:
    """What weight fitting needs: per date the products of the K normalised formulas and the target."""

    exprs: list[str]
    ics: np.ndarray  # K
    mutual: np.ndarray  # K x K
    daily: DailyProducts | None = None  # per date (K+1) x (K+1) covariances, last row the target


def pool_statistics(
    panel: Panel, exprs: Sequence[str], target: str, options: FormulaOptions = DEFAULT, keep_daily: bool = False
) -> PoolStatistics:
    """Single ICs and mutual ICs of all formulas in one job over the panel."""
    z, cols = _standardised(panel, [*exprs, target], options)
    k = len(cols)
    if not keep_daily:
        # The mean over dates is taken in Spark: K * K numbers come back.
        full = _rows_to_matrix(mean_correlation_rows(z, cols, Pairs(k)), k, k)
        np.fill_diagonal(full, 1.0)
        return PoolStatistics(list(exprs), full[:-1, -1].copy(), full[:-1, :-1].copy())
    daily = DailyProducts(cut(daily_products(z, cols).withColumn("fold", F.lit(0))), k)
    ic = daily.mean_correlations()[0]
    return PoolStatistics(list(exprs), ic[:-1, -1].copy(), ic[:-1, :-1].copy(), daily)


def _standardised(panel: Panel, exprs: Sequence[str], options: FormulaOptions) -> tuple[Panel, list[str]]:
    """The formulas as standardised columns, and the names of these."""
    names = {f"_a{i}": f for i, f in enumerate(exprs)}
    wide = add_factors(panel, names, options)
    return zscore(wide.over(wide.df.select("symbol", "date", *names)), list(names)), list(names)


def _rows_to_matrix(rows: DataFrame, left: int, right: int) -> np.ndarray:
    out = np.full((left, right), np.nan)
    for r in rows.collect():
        out[r["i"]] = r["ics"]
    return out


def rectangle(panel: Panel, rows: Sequence[str], columns: Sequence[str], options: FormulaOptions = DEFAULT) -> DataFrame:
    """(i, ics): mean ICs of formula i of ``rows`` with every formula of ``columns``; nothing else is multiplied."""
    z, cols = _standardised(panel, [*rows, *columns], options)
    return mean_correlation_rows(z, cols, Pairs(len(rows), len(columns)))


def extended_statistics(
    panel: Panel, known: PoolStatistics, fresh: Sequence[str], target: str, options: FormulaOptions = DEFAULT
) -> PoolStatistics:
    """``known`` and its products with some more formulas: fresh x (known + fresh + target) numbers come back."""
    if not fresh:
        return known
    m, k = len(known.exprs), len(known.exprs) + len(fresh)
    block = _rows_to_matrix(rectangle(panel, fresh, [*known.exprs, *fresh, target], options), len(fresh), k + 1)
    mutual = np.ones((k, k))
    mutual[:m, :m] = known.mutual
    mutual[m:], mutual[:m, m:] = block[:, :-1], block[:, :m].T
    np.fill_diagonal(mutual, 1.0)
    return PoolStatistics([*known.exprs, *fresh], np.concatenate((known.ics, block[:, -1])), mutual)


def restricted(stats: PoolStatistics, keep: Sequence[int]) -> PoolStatistics:
    keep = list(keep)
    return PoolStatistics([stats.exprs[i] for i in keep], stats.ics[keep], stats.mutual[np.ix_(keep, keep)])


def _no_statistics() -> PoolStatistics:
    return PoolStatistics([], np.zeros(0), np.zeros((0, 0)))


def _batches(items: Sequence[str], capacity: int | None) -> list[Sequence[str]]:
    """Candidates asked for at a time: about as many as members, so a batch costs at most twice its products with them."""
    size = min(max(capacity or LEAST_BATCH, LEAST_BATCH), CANDIDATE_BATCH)
    return [items[a : a + size] for a in range(0, len(items), size)]


class DailyProducts:
    """Per date the covariances of K formulas and the target, as checkpointed rows.

    Each question (an objective with its gradient, mean correlations) is one pass that sends a few sums per task. Tables
    of up to ``LOCAL_NUMBERS`` numbers are read once, and the same sums are taken without a job.
    """

    def __init__(self, rows: DataFrame, k: int):
        self.rows, self.k = rows, k
        few = rows.limit(LOCAL_NUMBERS // (k * k) + 1).collect()
        self.local = _cubes(pd.DataFrame([r.asDict() for r in few]), k) if 0 < len(few) <= LOCAL_NUMBERS // (k * k) else None

    def in_folds(self, folds: int) -> DailyProducts:
        """The same dates in consecutive folds of equal length. Only dates pass the unpartitioned window."""
        fold = F.ntile(folds).over(Window.orderBy("date")) - 1
        return DailyProducts(cut(self.rows.drop("fold").join(self.rows.select("date").withColumn("fold", fold), "date")), self.k)

    def sums(self, of_day) -> np.ndarray:
        """Sum over dates of ``of_day(cov, fold)``, which gives one array per date."""
        if self.local is not None:
            return of_day(*self.local).sum(axis=0)
        k = self.k
        ship(self.rows.sparkSession)

        def partial(batches):
            total = None
            for pdf in batches:
                if len(pdf):
                    part = of_day(*_cubes(pdf, k)).sum(axis=0)
                    total = part if total is None else total + part
            if total is not None:
                yield pd.DataFrame({"total": [total.ravel()]})

        shape = of_day(np.zeros((1, k, k)), np.zeros(1, dtype=int)).shape[1:]
        parts = self.rows.mapInPandas(partial, "total array<double>").collect()
        return sum((np.array(r["total"]) for r in parts), np.zeros(int(np.prod(shape)))).reshape(shape)

    def mean_correlations(self, folds: int = 1) -> np.ndarray:
        """(folds, K + 1, K + 1): mean daily correlations of each fold's dates, ones on the diagonal."""
        k = self.k

        def of_day(cov, fold):
            hot = np.eye(folds)[fold]
            full = np.concatenate((_daily_correlations(cov).reshape(len(cov), -1), np.ones((len(cov), 1))), axis=1)
            return hot[:, :, None] * full[:, None, :]

        total = self.sums(of_day)
        out = (total[:, :-1] / np.maximum(total[:, -1:], 1)).reshape(folds, k, k)
        out[:, range(k), range(k)] = 1.0
        return out

    def objective(self, w: np.ndarray, lcb_beta: float | None = None) -> tuple[float, np.ndarray]:
        """ICIR of the combination, or mean - beta * std, and its gradient."""
        k = len(w)

        def of_day(cov, fold):
            ic, slope = _daily_ic(w, cov)
            return np.concatenate((np.ones((len(ic), 1)), ic[:, None], (ic**2)[:, None], slope, slope * ic[:, None]), axis=1)

        total = self.sums(of_day)
        n, s1, s2, g, ig = total[0], total[1], total[2], total[3 : 3 + k], total[3 + k :]
        mean = s1 / n
        std = float(np.sqrt(max(s2 - n * mean**2, 0.0) / max(n - 1, 1)))
        up = g / n
        wide = (ig - mean * g) / (max(n - 1, 1) * std) if std > ICIR_FLOOR else np.zeros(k)
        if lcb_beta is not None:
            return float(mean - lcb_beta * std), up - lcb_beta * wide
        low = max(std, ICIR_FLOOR)
        return float(mean / low), up / low - (mean / low**2) * wide


def _cubes(pdf: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Covariances (dates x k x k) and folds of some rows."""
    cov = np.zeros((len(pdf), k, k))
    i, j = np.triu_indices(k)
    cov[:, i, j] = cov[:, j, i] = np.stack(pdf["v"].to_numpy()).astype(float)
    return cov, pdf["fold"].to_numpy()


def _daily_ic(w: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per date the IC of the weighted sum and its gradient by the weights."""
    a, c = cov[:, :-1, :-1], cov[:, :-1, -1]
    aw = a @ w
    sx, sy = np.sqrt(np.maximum(aw @ w, 0)), np.sqrt(cov[:, -1, -1])
    flat = (sx < IC_STD_FLOOR) | (sy < IC_STD_FLOOR)
    scale = np.where(flat, 1.0, sx * sy)
    ic = (c @ w) / scale
    slope = c / scale[:, None] - np.where(flat, 0.0, ic / np.where(flat, 1.0, sx**2))[:, None] * aw
    return ic, slope


def _daily_correlations(cov: np.ndarray) -> np.ndarray:
    std = np.sqrt(np.einsum("tii->ti", cov))
    low = std < IC_STD_FLOOR
    scale = std[:, :, None] * std[:, None, :]
    scale[low[:, :, None] | low[:, None, :]] = 1.0
    return cov / scale


# --- weights -------------------------------------------------------------------------------------


def mse_loss(w: np.ndarray, mutual: np.ndarray, ics: np.ndarray, alpha: float = 0.0) -> float:
    return float(w @ mutual @ w - 2 * w @ ics + 1 + alpha * np.abs(w).sum())


def fit_weights(mutual: np.ndarray, ics: np.ndarray, alpha: float = 5e-3, steps: int = 10_000, tol: float = 1e-12) -> np.ndarray:
    """Minimise w'Mw - 2w'r + alpha * |w|_1: least squares without the penalty, else coordinate descent."""
    if np.isclose(alpha, 0.0):
        return np.linalg.lstsq(mutual, ics, rcond=None)[0]
    w = np.zeros(len(ics))
    for _ in range(steps):
        moved = 0.0
        for i in range(len(w)):
            pull = ics[i] - mutual[i] @ w + mutual[i, i] * w[i]
            new = np.sign(pull) * max(abs(pull) - alpha / 2, 0.0) / mutual[i, i]
            moved = max(moved, abs(new - w[i]))
            w[i] = new
        if moved < tol:
            break
    return w


def fit_weights_daily(
    stats: PoolStatistics, start: np.ndarray | None = None, alpha: float = 5e-3, lcb_beta: float | None = None, steps: int = 400
) -> np.ndarray:
    """Maximise the daily objective less alpha * |w|_1 by gradient steps that never make it worse."""
    w = np.array(stats.ics if start is None else start, dtype=float)

    def at(w):
        value, slope = stats.daily.objective(w, lcb_beta)
        return value - alpha * np.abs(w).sum(), slope - alpha * np.sign(w)

    (value, grad), rate = at(w), 0.05
    for _ in range(steps):
        while rate > 1e-9:
            trial = w + rate * grad
            got, slope = at(trial)
            if got > value:
                break
            rate /= 2
        else:
            break
        w, value, grad, rate = trial, got, slope, rate * 1.5
    return w


# --- the pool ------------------------------------------------------------------------------------


@dataclass
class Pool:
    capacity: int
    exprs: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    ics: np.ndarray = field(default_factory=lambda: np.zeros(0))
    mutual: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    log: list[dict] = field(default_factory=list)

    @property
    def ic_estimate(self) -> float:
        """IC of the weighted sum implied by the single and mutual ICs."""
        scale = self.weights @ self.mutual @ self.weights
        return float(self.weights @ self.ics / np.sqrt(scale)) if scale > 0 else 0.0

    def as_dict(self) -> dict[str, float]:
        return dict(zip(self.exprs, map(float, self.weights), strict=True))

    def to_rows(self, spark: SparkSession, pool_id: str = "pool") -> DataFrame:
        rows = [(pool_id, i, e, float(w), float(c)) for i, (e, w, c) in enumerate(zip(self.exprs, self.weights, self.ics, strict=True))]
        return spark.createDataFrame(rows, "pool_id string, idx int, expr string, weight double, ic double")


def admission_failure(ic: float, mutual: np.ndarray, lower_bound: float, limit: float = MUTUAL_LIMIT) -> str | None:
    """Why a candidate is not admitted. Bound and limit are signed."""
    if not np.isfinite(ic):
        return "ic is missing"
    if ic < lower_bound:
        return "ic below bound"
    if not np.isfinite(mutual).all():
        return "mutual ic is missing"
    if (mutual > limit).any():
        return "mutual ic above limit"
    return None


def extend_pool(
    panel: Panel,
    pool: Pool,
    candidates: Sequence[str],
    target: str,
    lower_bound: float = -1.0,
    alpha: float = 5e-3,
    limit: float | None = MUTUAL_LIMIT,
    options: FormulaOptions = DEFAULT,
) -> Pool:
    """Offer candidates one by one: admit, refit, and drop the smallest weight when over capacity.

    Candidates come in batches; a batch is multiplied with the members, itself and the target only, in one job, and
    what is known of the members is kept. So the work and the numbers read grow with candidates x capacity.
    """
    known = {str(parse(e, options)) for e in pool.exprs}
    fresh = [c for c in dict.fromkeys(str(parse(c, options)) for c in candidates) if c not in known]
    if not fresh:
        return pool
    held = pool_statistics(panel, pool.exprs, target, options) if pool.exprs else _no_statistics()
    weights = np.array(pool.weights, dtype=float)
    log = list(pool.log)
    for batch in _batches(fresh, pool.capacity):
        stats = extended_statistics(panel, held, batch, target, options)
        members, weights = _offer(stats, len(held.exprs), weights, pool.capacity, lower_bound, alpha, limit, log)
        held = restricted(stats, members)
    return Pool(pool.capacity, held.exprs, weights, held.ics, held.mutual, log)


def _offer(
    stats: PoolStatistics, n_members: int, weights: np.ndarray, capacity: int, lower_bound: float, alpha: float, limit: float | None, log: list[dict]
) -> tuple[list[int], np.ndarray]:
    """Offer the formulas after the first ``n_members`` of ``stats`` in turn: positions of the members left, and their weights."""
    members = list(range(n_members))
    for c in range(n_members, len(stats.exprs)):
        # An empty pool takes any candidate, and so does one whose only member is weak; that member then leaves.
        weak = not members or (len(members) == 1 and abs(stats.ics[members[0]]) < lower_bound)
        bound = -np.inf if weak else lower_bound
        why = admission_failure(stats.ics[c], stats.mutual[c, members], bound, limit if limit is not None else np.inf)
        entry = {"expr": stats.exprs[c], "ic": float(stats.ics[c]), "failure": why, "removed": None}
        log.append(entry)
        if why:
            continue
        if weak and members:
            entry["removed"] = stats.exprs[members[0]]
            members = []
        trial = [*members, c]
        fitted = (
            fit_weights(stats.mutual[np.ix_(trial, trial)], stats.ics[trial], alpha) if len(trial) > 1 else np.array([stats.ics[c]])
        )
        if len(trial) > capacity:
            worst = int(np.argmin(np.abs(fitted)))
            entry["removed"] = stats.exprs[trial[worst]]
            if worst == len(trial) - 1:
                continue
            trial.pop(worst)
            fitted = np.delete(fitted, worst)
        members, weights = trial, fitted
    return members, weights


def force_load(
    panel: Panel,
    exprs: Sequence[str],
    target: str,
    capacity: int | None = None,
    weights: Sequence[float] | None = None,
    alpha: float = 5e-3,
    options: FormulaOptions = DEFAULT,
) -> Pool:
    """Take formulas in order up to the capacity (equal ones once, undefined ones dropped), with given or fitted weights."""
    first = {}
    for i, e in enumerate(exprs):
        first.setdefault(str(parse(e, options)), i)
    held = _no_statistics()
    for batch in _batches(list(first), capacity):
        stats = extended_statistics(panel, held, batch, target, options)
        ok = list(range(len(held.exprs)))
        for i in range(len(ok), len(stats.exprs)):
            if np.isfinite(stats.ics[i]) and np.isfinite(stats.mutual[i, ok]).all() and len(ok) < (capacity or len(first)):
                ok.append(i)
        held = restricted(stats, ok)
        if len(ok) == capacity:
            break
    w = (
        np.array([weights[first[e]] for e in held.exprs], dtype=float)
        if weights is not None
        else fit_weights(held.mutual, held.ics, alpha)
    )
    return Pool(capacity or len(held.exprs), held.exprs, w, held.ics, held.mutual)


def most_significant(pool: Pool, k: int) -> list[int]:
    return [int(i) for i in np.argsort(-np.abs(pool.weights), kind="stable")[:k]]


def leave_only(pool: Pool, k: int) -> Pool:
    keep = sorted(most_significant(pool, k))
    return Pool(
        pool.capacity, [pool.exprs[i] for i in keep], pool.weights[keep], pool.ics[keep], pool.mutual[np.ix_(keep, keep)], pool.log
    )


def bulk_edit(
    panel: Panel, pool: Pool, remove: Sequence[int], add: Sequence[str], target: str, alpha: float = 5e-3, options: FormulaOptions = DEFAULT
) -> tuple[Pool, dict]:
    """Remove members by position, add formulas, refit; also the change record."""
    keep = [i for i in range(len(pool.exprs)) if i not in set(remove)]
    rest = Pool(pool.capacity, [pool.exprs[i] for i in keep], pool.weights[keep], pool.ics[keep], pool.mutual[np.ix_(keep, keep)], pool.log)
    if keep:
        rest.weights = fit_weights(rest.mutual, rest.ics, alpha)
    new = extend_pool(panel, rest, add, target, alpha=alpha, limit=None, options=options)
    old, now = set(pool.exprs), set(new.exprs)
    return new, {
        "added": sorted(now - old),
        "removed": sorted(old - now),
        "ic_before": pool.ic_estimate,
        "ic_after": new.ic_estimate,
    }


def merge_pools(
    panel: Panel,
    pools: Mapping[str, Mapping[str, float]],
    target: str,
    capacity: int,
    alpha: float = 5e-3,
    shrink: float = 1.0,
    options: FormulaOptions = DEFAULT,
) -> Pool:
    """One pool of the formulas of several windows, fitted on the panel given."""
    exprs = [e for p in pools.values() for e in p]
    merged = force_load(panel, exprs, target, capacity, alpha=alpha, options=options)
    merged.weights = merged.weights * shrink
    return merged


def window_contributions(collected: DataFrame, final: DataFrame) -> DataFrame:
    """(window, total_factors, in_final, percentage) for collected (window, expr) and the final formulas."""
    chosen = final.select("expr").distinct().withColumn("_in", F.lit(1))
    per_window = collected.groupBy("window", "expr").agg(F.count(F.lit(1)).alias("_n"))
    return (
        per_window.join(chosen, "expr", "left")
        .groupBy("window")
        .agg(F.sum("_n").alias("total_factors"), F.count("_in").alias("in_final"))
        .withColumn("percentage", F.try_divide(F.col("in_final") * 100.0, F.col("total_factors")))
    )


def shrink_weights(pool: DataFrame, factor: float = 0.9) -> DataFrame:
    """Weights times ``factor``."""
    return pool.withColumn("weight", F.col("weight") * F.lit(float(factor)))


def weight_norms(pool: DataFrame, factor: float = 0.9) -> DataFrame:
    l1 = F.sum(F.abs("weight"))
    return pool.agg(l1.alias("l1_before"), (l1 * F.lit(float(factor))).alias("l1_after"))


def cross_validated_weights(stats: PoolStatistics, folds: int = 5, alpha: float = 5e-3, shrink: float = 0.9) -> np.ndarray:
    """Mean of the weights fitted without one block of dates at a time, times ``shrink``."""
    daily = stats.daily.in_folds(folds)
    counts = daily.sums(lambda cov, fold: np.eye(folds)[fold])
    each = daily.mean_correlations(folds)
    fits = []
    for left_out in range(folds):
        share = np.where(np.arange(folds) == left_out, 0.0, counts)
        mean = np.tensordot(share / share.sum(), each, 1)
        np.fill_diagonal(mean, 1.0)
        fits.append(fit_weights(mean[:-1, :-1], mean[:-1, -1], alpha))
    return np.mean(fits, axis=0) * shrink


# --- selection -----------------------------------------------------------------------------------


def greedy_decorrelated(order: Sequence[int], mutual: np.ndarray, threshold: float = 0.7, capacity: int | None = None) -> list[int]:
    """Walk in ``order``; keep what is within the threshold of everything kept so far."""
    kept: list[int] = []
    for i in order:
        if all(abs(mutual[i, j]) <= threshold for j in kept):
            kept.append(i)
            if capacity and len(kept) >= capacity:
                break
    return kept


def decorrelated_hall_of_fame(corr: np.ndarray, n: int) -> list[int]:
    """``corr`` is sorted by fitness, best first: drop the worse of the closest pair until n remain."""
    better, worse = np.triu_indices(len(corr), 1)
    closest = np.argsort(-np.abs(np.asarray(corr, dtype=float))[better, worse], kind="stable")
    gone: set[int] = set()
    for b, w in zip(better[closest].tolist(), worse[closest].tolist(), strict=True):
        if len(corr) - len(gone) <= n:
            break
        if b not in gone and w not in gone:
            gone.add(w)
    return [i for i in range(len(corr)) if i not in gone]


def select_decorrelated(
    panel: Panel, formulas: Sequence[str], target: str, threshold: float = 0.7, capacity: int = 20, options: FormulaOptions = DEFAULT
) -> DataFrame:
    """(rank, expr, ic) of the greedy selection, best IC first, equal ones by text.

    All ICs come from one aggregate per batch of formulas. Then candidates are met in order, a batch at a time, with the
    formulas kept so far: Spark drops those that resemble one of them, so only rows that may still be kept come back.
    """
    exprs = list(dict.fromkeys(str(parse(f, options)) for f in formulas))
    found = score_candidates(panel, exprs, target, options, missing=float("nan")).collect()
    ics = {r["expr"]: r["ic"] for r in found if np.isfinite(r["ic"])}
    order = sorted(ics, key=lambda e: (-ics[e], e))
    kept: list[str] = []
    for batch in _batches(order, capacity):
        block = rectangle(panel, batch, [*kept, *batch], options)
        apart = F.forall(F.slice("ics", 1, len(kept)), lambda x: F.abs(x) <= threshold) if kept else F.lit(True)
        rows = {r["i"]: r["own"] for r in block.filter(apart).select("i", F.slice("ics", len(kept) + 1, len(batch)).alias("own")).collect()}
        left = sorted(rows)
        mutual = np.array([[rows[i][j] for j in left] for i in left]).reshape(len(left), len(left))
        chosen = greedy_decorrelated(range(len(left)), mutual, threshold, capacity - len(kept))
        kept += [batch[left[i]] for i in chosen]
        if len(kept) >= capacity:
            break
    rows = [(r, e, float(ics[e])) for r, e in enumerate(kept)]
    return panel.df.sparkSession.createDataFrame(rows, "rank int, expr string, ic double")


def admission_filter(
    candidates: DataFrame, mutual: DataFrame, lower_bound: float, limit: float = MUTUAL_LIMIT
) -> DataFrame:
    """Table form: candidates (expr, ic) that pass the bound and have no pair (expr, member, ic) above the limit."""
    bad = mutual.filter(F.col("ic").isNull() | (F.col("ic") > limit)).select("expr").distinct()
    return candidates.filter(F.col("ic").isNotNull() & (F.col("ic") >= lower_bound)).join(bad, "expr", "left_anti")


def significant_members(pool: DataFrame, k: int) -> DataFrame:
    """The k members with the largest absolute weights of each pool."""
    return top_in_group(pool, ["pool_id"], [F.abs("weight").desc(), F.col("idx")], k, "rank")


def pool_diagnostics(log: DataFrame) -> DataFrame:
    """(reason, n, percentage) of an admission log (expr, failure)."""
    total = log.agg(F.count(F.lit(1))).scalar()
    return (
        log.groupBy(F.coalesce("failure", F.lit("admitted")).alias("reason"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("percentage", F.col("n") * 100.0 / total)
    )


def objective_summary(log: DataFrame, value: str = "objective") -> DataFrame:
    return log.agg(
        F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.count(value).alias("count")
    )


def last_objectives(log: DataFrame, n: int = 10, order: str = "step") -> DataFrame:
    return log.orderBy(F.col(order).desc()).limit(n)


def error_statistics(programs: DataFrame) -> DataFrame:
    """Invalid programs by error type and node."""
    return programs.filter("invalid").groupBy("error_type", "error_node").agg(F.count(F.lit(1)).alias("n"))


def run_log(programs: DataFrame) -> DataFrame:
    """Per generation: mean and best fitness, mean length and the length of the best."""
    return programs.groupBy("generation").agg(
        F.avg("fitness").alias("mean_fitness"),
        F.max("fitness").alias("best_fitness"),
        F.avg("length").alias("mean_length"),
        F.max_by("length", F.struct(F.col("fitness"), -F.col("length"))).alias("best_length"),
    )


def success_rate(runs: DataFrame, flag: str = "success") -> DataFrame:
    return runs.agg(F.avg(F.col(flag).cast("double")).alias("success_rate"), F.count(F.lit(1)).alias("runs"))


def mutual_matrix(panel: Panel, formulas: Sequence[str], options: FormulaOptions = DEFAULT) -> DataFrame:
    names = {f"_a{i}": f for i, f in enumerate(formulas)}
    return mutual_ic_matrix(add_factors(panel, names, options), list(names))
