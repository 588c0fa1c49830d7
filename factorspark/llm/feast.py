"""Leading eigenvectors of a symmetric matrix by FEAST: a contour around each interval of the spectrum, and an exact count.

The resolvent (z - A)^-1, integrated along a circle through both ends of an interval, projects onto the eigenvectors
of that interval. Quadrature makes it a sum of complex shifted solves of a block of vectors; Rayleigh-Ritz takes the
eigenvectors out of the block, and the rounds repeat until the residuals are down to rounding. How many eigenvalues
an interval holds is known before, by Sylvester's law: as many as negative pivots of A - s lie between its ends.
"""

from __future__ import annotations

import numpy as np

NODES = 8  # quadrature points on the upper half of a circle; the lower half is its conjugate
SLICE = 8  # eigenvalues of an interval, unless more lie closer together than GAP
GAP = 1e-6  # two eigenvalues nearer than this part of the norm are not separated by an interval's end
ROUNDS = 40
EPS = np.finfo(float).eps


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix with the inertia of every shift of ``a`` (Householder)."""
    a = np.array(a, dtype=float)
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size == 0 or not x[1:].any():
            continue
        x[0] += np.copysign(size, x[0])
        x /= np.linalg.norm(x)
        block = a[k + 1 :, k:]
        block -= 2 * np.outer(x, x @ block)
        block = a[k:, k + 1 :]
        block -= 2 * np.outer(block @ x, x)
    return np.diag(a).copy(), np.diag(a, -1).copy()


def below(t: tuple[np.ndarray, np.ndarray], shifts: np.ndarray) -> np.ndarray:
    """Number of eigenvalues under each shift: the negative pivots of the shifted matrix's LDL' factors."""
    diagonal, off = t
    shifts = np.atleast_1d(np.asarray(shifts, dtype=float))
    tiny = EPS * max(np.abs(diagonal).max(initial=0), np.abs(off).max(initial=0), np.finfo(float).tiny)
    count = np.zeros(len(shifts), dtype=np.int64)
    pivot = np.ones(len(shifts))
    for k, value in enumerate(diagonal):
        pivot = value - shifts - (off[k - 1] ** 2 / pivot if k else 0.0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        count += pivot < 0
    return count


def nth_largest(t, k: int, low: float, high: float, width: float) -> float:
    """The k-th largest eigenvalue (from 1) to within ``width``, by bisection on the counts."""
    n = len(t[0])
    while high - low > width:
        mid = (low + high) / 2
        if n - below(t, mid)[0] >= k:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def slices(t, low: float, high: float, width: float) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues) of intervals that cover [low, high); ends lie in gaps of the spectrum."""
    out, work = [], [(low, high)]
    while work:
        a, b = work.pop()
        grid = np.linspace(a, b, 65)
        counts = below(t, grid)
        held = int(counts[-1] - counts[0])
        if held == 0:
            continue
        if held <= SLICE or b - a < width:
            out.append((float(a), float(b), held))
            continue
        inner = np.flatnonzero((counts > counts[0]) & (counts < counts[-1]))
        if not len(inner):  # all of them lie within one step of the grid
            at = int(np.flatnonzero(np.diff(counts))[0])
            work.append((grid[at], grid[at + 1]) if grid[at + 1] - grid[at] >= width else (grid[at], grid[at] + 0.9 * width))
            continue
        # The longest stretch without an eigenvalue, preferring those that split evenly.
        values, first, length = np.unique(counts[inner], return_index=True, return_counts=True)
        share = (values - counts[0]) / held
        pick = int(np.argmax(length * share * (1 - share)))
        at = inner[first[pick]] + (length[pick] - 1) / 2
        middle = a + (b - a) * at / 64
        work += [(a, middle), (middle, b)]
    return sorted(out)


def project(a: np.ndarray, low: float, high: float, block: np.ndarray) -> np.ndarray:
    """The block, filtered by the contour integral of the resolvent around [low, high]."""
    points, weights = np.polynomial.legendre.leggauss(NODES)
    centre, radius = (low + high) / 2, (high - low) / 2
    out = np.zeros_like(block)
    for x, w in zip(points, weights, strict=True):
        turn = radius * np.exp(1j * np.pi / 2 * (1 - x))
        out += w / 2 * (turn * np.linalg.solve((centre + turn) * np.eye(len(a)) - a, block.astype(complex))).real
    return out


def ritz(a: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values, vectors and residual norms of the span of ``block``."""
    q, sizes, _ = np.linalg.svd(block, full_matrices=False)
    q = q[:, sizes > sizes[0] * 1e-13]
    h = q.T @ a @ q
    values, turn = np.linalg.eigh((h + h.T) / 2)
    x = q @ turn
    return values, x, np.linalg.norm(a @ x - x * values, axis=0)


def eigenpairs(a: np.ndarray, low: float, high: float, count: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs of ``a`` within [low, high), unit vectors as columns.

    A block that turns out too small for the count is doubled and the search starts again; ArithmeticError if even
    a block of the whole space does not give as many pairs as the inertia says.
    """
    n = len(a)
    norm = np.abs(a).sum(axis=1).max()
    size = min(n, max(count + 4, count * 3 // 2))
    while True:
        block = np.random.default_rng(seed).normal(size=(n, size))
        last = np.inf
        for _ in range(ROUNDS):
            values, vectors, wrong = ritz(a, project(a, low, high, block))
            inside = (values >= low) & (values < high)
            worst = wrong[inside].max(initial=0) / norm
            if inside.sum() == count and (worst <= 4 * EPS or (worst <= 1e-12 and worst > last / 4)):
                return values[inside], vectors[:, inside]
            last, block = worst, vectors
        if size == n:
            raise ArithmeticError(f"{count} eigenvalues counted in [{low}, {high}), {int(inside.sum())} found")
        size = min(n, 2 * size)


def leading_range(a: np.ndarray, k: int) -> tuple[float, float, tuple[np.ndarray, np.ndarray]]:
    """A range that holds the k largest positive eigenvalues, its low end in a gap; eigenvalues tied with the k-th are in it."""
    n, t = len(a), tridiagonal(a)
    norm = float(np.abs(a).sum(axis=1).max(initial=0))
    floor, top = 8 * n * EPS * norm, norm * 1.05 + np.finfo(float).tiny
    positive = int(n - below(t, floor)[0])
    k = min(k, positive)
    width = GAP * norm / 8
    while 0 < k < positive:
        here, after = nth_largest(t, k, floor, top, width), nth_largest(t, k + 1, floor, top, width)
        if here - after > GAP * norm:
            return (here + after) / 2, top, t
        k += 1
    last = nth_largest(t, k, floor, top, floor) if k else floor
    return ((floor + last) / 2 if last > 2 * floor else floor), top, t


def intervals(a: np.ndarray, k: int) -> list[tuple[float, float, int]]:
    """Intervals that together hold the k largest positive eigenvalues of ``a`` (all, if it has fewer)."""
    low, high, t = leading_range(a, k)
    return slices(t, low, high, GAP * high)


def combine(a: np.ndarray, blocks: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """One Rayleigh-Ritz step over the eigenvectors of all intervals, largest first: at most k pairs, orthogonal to rounding."""
    values, vectors, wrong = ritz(a, np.concatenate(blocks, axis=1))
    if len(values) != sum(b.shape[1] for b in blocks) or wrong.max() > 1e-11 * np.abs(a).sum(axis=1).max():
        raise ArithmeticError("eigenvectors of different intervals are not independent")
    return values[::-1][:k], vectors[:, ::-1][:, :k]
