"""Prefix programs, polynomial models and class weights on tables.

A program such as ``add(mul(X0,X1),-0.5)`` becomes one column; least-squares models reduce the rows to their
cross products in Spark and solve the small system on the driver. Systems of many terms are never formed: their
solvers see the rows only through distributed matrix-vector products.
"""

from __future__ import annotations

import ast
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..plans.formula import FormulaError
from ..session import ship, stored
from .scale import measured_side

# Up to this many terms the cross products (terms x terms numbers) go to the driver; beyond, solvers iterate over the rows.
DIRECT_TERMS = 500
CHUNK_NUMBERS = 4_000_000  # numbers of the design matrix that a task holds at a time
SAME_SIGNS = 2  # steps that leave the signs of a lasso as they are before its system is solved
COLUMNS_AT_ONCE = 64  # columns of the inverse solved for together

_COMMON = {
    "add": (S.add, 2),
    "sub": (S.sub, 2),
    "mul": (S.mul, 2),
    "neg": (F.negative, 1),
    "abs": (F.abs, 1),
    "max": (S.greater, 2),
    "min": (S.less, 2),
    "sin": (F.sin, 1),
    "cos": (F.cos, 1),
    "tan": (F.tan, 1),
    "tanh": (F.tanh, 1),
    "harmonic": (S.harmonic, 1),
}
PROTECTED = {
    **_COMMON,
    "div": (S.protected_div, 2),
    "sqrt": (S.protected_sqrt, 1),
    "log": (S.protected_log, 1),
    "logabs": (S.protected_log, 1),
    "inv": (S.protected_inv, 1),
    "exp": (S.protected_exp, 1),
    "expneg": (S.protected_expneg, 1),
    "sig": (S.sigmoid, 1),
    "sigmoid": (S.protected_sigmoid, 1),
    "n2": (lambda x: S.protected_nth_power(x, 2), 1),
    "n3": (lambda x: S.protected_nth_power(x, 3), 1),
    "n4": (lambda x: S.protected_nth_power(x, 4), 1),
}
PLAIN = {
    **_COMMON,
    "div": (S.div, 2),
    "sqrt": (lambda x: F.when(x >= 0, F.sqrt(x)), 1),
    "log": (S.log, 1),
    "logabs": (S.log_abs, 1),
    "inv": (S.inverse, 1),
    "exp": (S.exp, 1),
    "expneg": (S.expneg, 1),
    "sig": (S.sigmoid, 1),
    "sigmoid": (S.sigmoid, 1),
    "n2": (lambda x: S.nth_power(x, 2), 1),
    "n3": (lambda x: S.nth_power(x, 3), 1),
    "n4": (lambda x: S.nth_power(x, 4), 1),
}


def program_column(text: str, inputs: Mapping[str, str] | Sequence[str], protected: bool = True) -> Column:
    """The column a program computes. ``inputs``: the columns behind X0, X1, ... or a name mapping."""
    names = dict(inputs) if isinstance(inputs, Mapping) else {f"X{i}": c for i, c in enumerate(inputs)}
    table = PROTECTED if protected else PLAIN

    def build(node) -> Column:
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return F.lit(float(node.value))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub) and isinstance(node.operand, ast.Constant):
            return F.lit(-float(node.operand.value))
        if isinstance(node, ast.Name) and node.id in names:
            return F.col(names[node.id])
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in table:
            fn, arity = table[node.func.id]
            if len(node.args) == arity:
                return fn(*[build(a) for a in node.args])
        raise FormulaError(f"{ast.unparse(node)!r} is not part of a program")

    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except SyntaxError as e:
        raise FormulaError(f"cannot read {text!r}") from e
    return build(tree)


def predict(df: DataFrame, program: str, inputs, name: str = "prediction", protected: bool = True) -> DataFrame:
    return df.withColumn(name, program_column(program, inputs, protected))


def classify(df: DataFrame, program: str, inputs, classes: Sequence = (0, 1)) -> DataFrame:
    """``p0``, ``p1`` = 1 - sigmoid, sigmoid of the program; ``label`` is the likelier class (the first on a tie)."""
    p = S.sigmoid(program_column(program, inputs))
    return df.withColumn("p1", p).withColumns(
        {"p0": 1.0 - F.col("p1"), "label": F.when(F.col("p1") > 0.5, F.lit(classes[1])).otherwise(F.lit(classes[0]))}
    )


def transform(df: DataFrame, programs: Mapping[str, str], inputs) -> DataFrame:
    """One column per program."""
    return df.withColumns({n: program_column(t, inputs) for n, t in programs.items()})


def class_weights(df: DataFrame, label: str, weight: str | None = None) -> DataFrame:
    """``balanced_weight``: n / (2 * class count) times the sample weight. Exactly two classes with weight > 0."""
    w = F.col(weight) if weight else F.lit(1.0)
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"), F.sum(w).alias("_w"))
    seen = counts.filter(F.col("_w") != 0).limit(3).count()
    if seen != 2:
        raise ValueError(f"{seen} classes have weight, two are required")
    total = df.agg(F.count(F.lit(1))).scalar()
    size = counts.agg(F.count(F.lit(1))).scalar()
    return (
        df.join(measured_side(counts.select(label, "_n")), label)
        .withColumn("balanced_weight", total / (size * F.col("_n")) * w)
        .drop("_n")
    )


# --- polynomial models ---------------------------------------------------------------------------


def monomials(n: int, degree: int) -> list[tuple[int, ...]]:
    """Exponents of all monomials of n variables up to a degree, the constant first."""
    out = []
    for d in range(degree + 1):
        for combo in combinations_with_replacement(range(n), d):
            out.append(tuple(combo.count(i) for i in range(n)))
    return out


@dataclass
class Polynomial:
    inputs: list[str]
    exponents: list[tuple[int, ...]]
    coefficients: np.ndarray
    p_values: np.ndarray | None = None

    def column(self) -> Column:
        kept = [(e, float(c)) for e, c in zip(self.exponents, self.coefficients, strict=True) if c != 0]
        return S.polynomial([F.col(c) for c in self.inputs], [e for e, _ in kept], [c for _, c in kept])


@dataclass
class _Moments:
    n: int
    xx: np.ndarray
    xy: np.ndarray
    y: float
    yy: float


def _factors(exponents: Sequence[tuple[int, ...]]) -> np.ndarray:
    """Each monomial as the list of its factors, filled up with the index of a column of ones."""
    n = len(exponents[0])
    degree = max(map(sum, exponents), default=0)
    out = np.full((len(exponents), degree), n)
    for row, powers in zip(out, exponents, strict=True):
        own = [i for i, e in enumerate(powers) for _ in range(e)]
        row[: len(own)] = own
    return out


def _design(x: np.ndarray, factors: np.ndarray) -> np.ndarray:
    wide = np.column_stack([x, np.ones(len(x))])
    out = np.ones((len(x), len(factors)))
    for slot in factors.T:
        out *= wide[:, slot]
    return out


def _summed(df: DataFrame, inputs: Sequence[str], exponents: Sequence[tuple[int, ...]], y: str, size: int, part) -> np.ndarray:
    """Sum over all complete rows of ``part(design block, target block)``, ``size`` numbers.

    A task holds one block of rows at a time and gives one row of numbers; Spark adds these up.
    """
    ship(df.sparkSession)
    factors = _factors(exponents)
    rows = max(CHUNK_NUMBERS // (len(factors) + 1), 1)
    inputs = list(inputs)

    def partial_sums(batches):
        total = np.zeros(size)
        for pdf in batches:
            pdf = pdf.dropna()
            x, target = pdf[inputs].to_numpy(float), pdf[y].to_numpy(float)
            for i in range(0, len(x), rows):
                total += part(_design(x[i : i + rows], factors), target[i : i + rows])
        yield pd.DataFrame({"v": [total]})

    parts = df.select(*dict.fromkeys([*inputs, y])).mapInPandas(partial_sums, "v array<double>")
    out = np.zeros(size)
    for r in parts.select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out


def _moments(df: DataFrame, inputs: Sequence[str], exponents: Sequence[tuple[int, ...]], y: str) -> _Moments:
    """Cross products of the monomials and the target."""
    k = len(exponents)

    def products(x, target):
        full = np.column_stack([x, target])
        return np.concatenate([(full.T @ full).ravel(), [len(x), target.sum()]])

    flat = _summed(df, inputs, exponents, y, (k + 1) ** 2 + 2, products)
    m = flat[:-2].reshape(k + 1, k + 1)
    return _Moments(int(flat[-2]), m[:k, :k], m[:k, k], float(flat[-1]), float(m[k, k]))


class _Rows:
    """Normal equations that are only ever multiplied with, in columns scaled to length one.

    ``df`` is read once per product, so it is stored first, as columns.
    """

    def __init__(self, df: DataFrame, inputs: Sequence[str], exponents: Sequence[tuple[int, ...]], y: str):
        self.source = (stored(df.select(*dict.fromkeys([*inputs, y]))), inputs, exponents, y)
        k = self.k = len(exponents)
        flat = _summed(
            *self.source, 2 * k + 3, lambda x, t: np.concatenate([(x * x).sum(axis=0), x.T @ t, [len(t), t.sum(), t @ t]])
        )
        self.n, self.y, self.yy = int(flat[-3]), float(flat[-2]), float(flat[-1])
        length = np.sqrt(flat[:k])
        self.scale = np.divide(1.0, length, out=np.zeros(k), where=length > 0)
        self.xy = flat[k : 2 * k] * self.scale

    def times(self, v: np.ndarray) -> np.ndarray:
        """X'X v for one or several columns v: one job over the rows."""
        columns = (self.scale * v.T).T.reshape(self.k, -1)
        flat = _summed(*self.source, columns.size, lambda x, t: (x.T @ (x @ columns)).ravel())
        return (self.scale * flat.reshape(self.k, -1).T).T.reshape(v.shape)

    def solve(self, b: np.ndarray, tolerance: float, steps: int) -> np.ndarray:
        """Conjugate gradients for the columns of ``b`` together. A column without a solution, or too close to one, raises."""
        x, r = np.zeros_like(b), b.copy()
        d, rr = r.copy(), (r * r).sum(axis=0)
        goal = tolerance**2 * np.maximum((b * b).sum(axis=0), 1e-300)
        for _ in range(steps):
            if (rr <= goal).all():
                return x
            ad = self.times(d)
            along = (d * ad).sum(axis=0)
            a = np.divide(rr, along, out=np.zeros_like(rr), where=(along > 0) & (rr > goal))
            x, r = x + a * d, r - a * ad
            now = (r * r).sum(axis=0)
            d = r + np.divide(now, rr, out=np.zeros_like(rr), where=rr > 0) * d
            rr = now
        raise ArithmeticError(f"no solution within {steps} steps; the terms are close to dependent")


def _solve_rows(rows: _Rows, tolerance: float, steps: int, errors: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Coefficients and, on request, the diagonal of the inverse of the cross products."""
    beta = rows.solve(rows.xy[:, None], tolerance, steps)[:, 0]
    if not errors:
        return beta * rows.scale, None
    diagonal = np.zeros(rows.k)
    for i in range(0, rows.k, COLUMNS_AT_ONCE):
        at = np.arange(i, min(i + COLUMNS_AT_ONCE, rows.k))
        unit = np.zeros((rows.k, len(at)))
        unit[at, at - i] = 1.0
        diagonal[at] = rows.solve(unit, tolerance, steps)[at, at - i]
    return beta * rows.scale, diagonal * rows.scale**2


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _incomplete_beta(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1), 1e-300)
    value = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 / ((1.0 + num * d) or 1e-300)
            c = (1.0 + num / c) or 1e-300
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * value


def t_test_p_value(t: float, dof: int) -> float:
    return _incomplete_beta(dof / 2.0, 0.5, dof / (dof + t * t))


def _p_values(beta: np.ndarray, diagonal: np.ndarray, rss: float, dof: int) -> np.ndarray:
    se = np.sqrt(np.maximum(diagonal, 0) * max(rss, 0.0) / dof)
    t = np.divide(beta, se, out=np.full_like(beta, np.inf), where=se > 0)
    return np.array([t_test_p_value(v, dof) if np.isfinite(v) else 0.0 for v in t])


def fit_polynomial(
    df: DataFrame,
    inputs: Sequence[str],
    y: str,
    degree: int,
    cutoff_p_value: float = 1.0,
    max_terms: int | None = None,
    tolerance: float = 1e-10,
    steps: int = 1_000,
    direct_terms: int = DIRECT_TERMS,
) -> Polynomial:
    """Least squares on all monomials; weak terms (by t-test) are dropped and the rest fitted again.

    Up to ``direct_terms`` terms the cross products are solved on the driver; more terms are fitted by conjugate gradients,
    one job over the rows a step (``tolerance``: length of the remainder against that of X'y). Rows with a missing value
    do not count. No complete row gives coefficients of 0.
    """
    exponents = monomials(len(inputs), degree)
    k = len(exponents)

    def wanted(beta):
        return cutoff_p_value < 1.0 or (max_terms is not None and np.count_nonzero(np.abs(beta) > 1e-12) > max_terms)

    if k <= direct_terms:
        m = _moments(df, inputs, exponents, y)
        inverse = np.linalg.pinv(m.xx, hermitian=True)
        beta, diagonal, n = inverse @ m.xy, np.diag(inverse), m.n
        rss = m.yy - 2 * beta @ m.xy + beta @ m.xx @ beta
        rows = None
    else:
        rows = _Rows(df, inputs, exponents, y)
        beta, diagonal = _solve_rows(rows, tolerance, steps, False)
        n, rss = rows.n, rows.yy - beta @ np.divide(rows.xy, rows.scale, out=np.zeros(k), where=rows.scale > 0)
        if wanted(beta):
            diagonal = _solve_rows(rows, tolerance, steps, True)[1]
    if not wanted(beta):
        return Polynomial(list(inputs), exponents, beta)
    p_values = _p_values(beta, diagonal, rss, n - k)
    order = np.argsort(p_values, kind="stable")
    keep = sorted([i for i in order if p_values[i] <= cutoff_p_value][: max_terms or k])
    beta = _refit(m, keep, k) if rows is None else _refit_rows(rows, keep, tolerance, steps)
    return Polynomial(list(inputs), exponents, beta, p_values)


def _refit(m: _Moments, keep: Sequence[int], k: int) -> np.ndarray:
    beta = np.zeros(k)
    if len(keep):
        beta[keep] = np.linalg.lstsq(m.xx[np.ix_(keep, keep)], m.xy[keep], rcond=None)[0]
    return beta


def _refit_rows(rows: _Rows, keep: Sequence[int], tolerance: float, steps: int) -> np.ndarray:
    """Least squares on some of the terms, directly when they are few."""
    df, inputs, exponents, y = rows.source
    beta = np.zeros(rows.k)
    if len(keep):
        some = [exponents[i] for i in keep]
        if len(some) <= DIRECT_TERMS:
            beta[keep] = _refit(_moments(df, inputs, some, y), range(len(some)), len(some))
        else:
            beta[keep] = _solve_rows(_Rows(df, inputs, some, y), tolerance, steps, False)[0]
    return beta


def fit_lasso(
    df: DataFrame,
    inputs: Sequence[str],
    y: str,
    degree: int,
    gamma: float = 0.1,
    refit: bool = True,
    steps: int = 100_000,
    tolerance: float = 1e-8,
    direct_terms: int = DIRECT_TERMS,
) -> Polynomial:
    """min |y - Xb|^2 / (2 n var y) + gamma / p * |b|_1.

    Up to ``direct_terms`` terms by coordinate descent on the cross products, beyond by accelerated proximal gradients, one
    product with the rows a step, until no optimality condition is missed by more than ``tolerance`` of the largest pull.
    """
    exponents = monomials(len(inputs), degree)
    k = len(exponents)
    if k > direct_terms:
        rows = _Rows(df, inputs, exponents, y)
        bound = rows.n / k * (rows.yy / rows.n - (rows.y / rows.n) ** 2) * gamma
        beta = _lasso_rows(rows, bound, tolerance, steps)
        return Polynomial(list(inputs), exponents, _refit_rows(rows, np.flatnonzero(beta).tolist(), tolerance, steps) if refit else beta)
    m = _moments(df, inputs, exponents, y)
    bound = m.n / k * (m.yy / m.n - (m.y / m.n) ** 2) * gamma
    beta = np.zeros(k)
    for _ in range(steps):
        moved = 0.0
        for i in range(k):
            if m.xx[i, i] == 0:
                continue
            pull = m.xy[i] - m.xx[i] @ beta + m.xx[i, i] * beta[i]
            new = np.sign(pull) * max(abs(pull) - bound, 0.0) / m.xx[i, i]
            moved = max(moved, abs(new - beta[i]) * math.sqrt(m.xx[i, i]))
            beta[i] = new
        if moved <= 1e-12 * math.sqrt(m.yy or 1.0):
            break
    return Polynomial(list(inputs), exponents, _refit(m, np.flatnonzero(beta).tolist(), k) if refit else beta)


def _lasso_rows(rows: _Rows, bound: float, tolerance: float, steps: int) -> np.ndarray:
    """Proximal gradients with momentum, started anew where the step turns back; in scaled columns each term has its own bound.

    Once the signs have stayed the same for some steps, the system that they leave is solved by conjugate gradients, and
    its solution is taken where it fulfils all conditions.
    """
    limit = bound * rows.scale
    v = np.random.default_rng(0).standard_normal(rows.k)
    v /= np.linalg.norm(v)
    curve = 0.0
    for _ in range(30):  # the largest eigenvalue from below; too small a value is noticed further down and doubled
        v = rows.times(v)
        before, curve = curve, float(np.linalg.norm(v))
        if curve <= 1.01 * before or curve == 0:
            break
        v = v / curve
    curve = 1.05 * curve or 1.0
    b = ahead = np.zeros(rows.k)
    product = np.zeros(rows.k)  # X'X b
    ahead_product, t = product, 1.0
    goal = tolerance * max(np.abs(rows.xy).max(initial=0.0), 1e-300)

    def solved(b, product) -> bool:
        pull = rows.xy - product
        return bool((np.where(b != 0, np.abs(pull - limit * np.sign(b)), np.maximum(np.abs(pull) - limit, 0.0)) <= goal).all())

    signs, since, tried = np.zeros(rows.k), 0, set()
    for _ in range(steps):
        if solved(b, product):
            return b * rows.scale
        since = since + 1 if (np.sign(b) == signs).all() else 0
        signs = np.sign(b)
        if since >= SAME_SIGNS and signs.any() and signs.tobytes() not in tried:
            tried.add(signs.tobytes())
            found = _lasso_with_signs(rows, limit, signs, b, product, goal)
            if found is not None and (np.sign(found) == signs).all() and solved(found, rows.times(found)):
                return found * rows.scale
        step = ahead + (rows.xy - ahead_product) / curve
        new = np.sign(step) * np.maximum(np.abs(step) - limit / curve, 0.0)
        new_product = rows.times(new)
        gap = new - ahead
        if gap @ (new_product - ahead_product) > curve * (gap @ gap) * (1 + 1e-9):
            curve *= 2
            continue
        if gap @ (new - b) < 0:
            t = 1.0
        t_next = (1 + math.sqrt(1 + 4 * t * t)) / 2
        w = (t - 1) / t_next
        # Products are linear, so the product of the point ahead needs no job of its own.
        ahead, ahead_product = new + w * (new - b), new_product + w * (new_product - product)
        b, product, t = new, new_product, t_next
    raise ArithmeticError(f"no solution within {steps} steps")


def _lasso_with_signs(rows: _Rows, limit: np.ndarray, signs: np.ndarray, b: np.ndarray, product: np.ndarray, goal: float) -> np.ndarray | None:
    """Where the pull on every term of the given signs equals its bound, the other terms at 0; None when it is not reached."""
    inside = signs != 0
    r = np.where(inside, rows.xy - limit * signs - product, 0.0)
    d, rr = r, r @ r
    for _ in range(2 * int(inside.sum()) + 2):
        if np.abs(r).max() <= 0.1 * goal:
            return b
        ad = np.where(inside, rows.times(d), 0.0)
        along = d @ ad
        if along <= 0:
            return None
        b, r = b + rr / along * d, r - rr / along * ad
        now = r @ r
        d, rr = r + now / rr * d, now
    return None
