"""Numeric routines on bounded numpy arrays: ranks, tests, neighbours, trees, clusters.

None of them sees more rows than a documented sample.
"""

from __future__ import annotations

import math

import numpy as np


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1; ties get their mean."""
    _, inverse, counts = np.unique(x, return_inverse=True, return_counts=True)
    ends = np.cumsum(counts)
    return (ends - (counts - 1) / 2)[inverse]


def auc(score: np.ndarray, positive: np.ndarray) -> float | None:
    p = int(positive.sum())
    q = len(positive) - p
    if not p or not q:
        return None
    return float((average_ranks(score)[positive].sum() - p * (p + 1) / 2) / (p * q))


def ks_p_value(d: float, n: float) -> float:
    """Chance of a one-sample Kolmogorov distance of at least d among n values: by the
    matrix power of Marsaglia, Tsang and Wang (2003) for n up to 400, else Stephens' series."""
    if d <= 0:
        return 1.0
    if d >= 1:
        return 0.0
    k_n = max(1, round(n))
    if k_n <= 400:
        k = int(k_n * d) + 1
        m, h = 2 * k - 1, k - k_n * d
        mat = np.tri(m, m, 1)
        mat[:, 0] -= h ** np.arange(1, m + 1)
        mat[-1, :] -= h ** np.arange(m, 0, -1)
        mat[-1, 0] += (2 * h - 1) ** m if 2 * h > 1 else 0
        i, j = np.indices((m, m))
        mat /= np.vectorize(lambda v: math.factorial(v) if v > 0 else 1, otypes=[float])(i - j + 1)
        power = np.linalg.matrix_power(mat, k_n)
        below = float(power[k - 1, k - 1]) * math.exp(math.lgamma(k_n + 1) - k_n * math.log(k_n))
        return min(1.0, max(0.0, 1 - below))
    z = d * (math.sqrt(k_n) + 0.12 + 0.11 / math.sqrt(k_n))
    return min(1.0, max(0.0, 2 * sum((-1) ** (i - 1) * math.exp(-2 * i * i * z * z) for i in range(1, 101))))


def chi2_p_value(statistic: float, dof: int) -> float:
    """Upper tail of the chi-square distribution: the regularised incomplete gamma function."""
    a, x = dof / 2, statistic / 2
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    # Continued fraction, modified Lentz.
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        f = -i * (i - a)
        b += 2
        d = 1 / (f * d + b or 1e-300)
        c = b + f / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, scale * h)


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    while (low := x < 6).any():
        out[low] -= 1 / x[low]
        x[low] += 1
    i = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i / 240)))


def _jittered(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    s = x.std()
    x = x / s if s > 0 else x
    return x + 1e-10 * max(1.0, float(np.abs(x).mean())) * rng.standard_normal(len(x))


def _kth_distance(x: np.ndarray, k: int) -> np.ndarray:
    """Distance of each value to its k-th nearest other, in one dimension."""
    order = np.argsort(x, kind="stable")
    s = x[order]
    n = len(s)
    best = np.full((n, 2 * k), np.inf)
    for j in range(1, k + 1):
        gap = s[j:] - s[:-j]
        best[j:, 2 * j - 2] = gap
        best[: n - j, 2 * j - 1] = gap
    out = np.empty(n)
    out[order] = np.partition(best, k - 1, axis=1)[:, k - 1]
    return out


def _within(x: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Values nearer than the radius, the value itself included; the radius shrinks by what rounding may add."""
    r = np.maximum(radius * (1 - 1e-12) - 1e-14 * np.abs(x).max(), 0)
    s = np.sort(x)
    return np.maximum(np.searchsorted(s, x + r, "right") - np.searchsorted(s, x - r, "left"), 1)


def mutual_information_mixed(x: np.ndarray, classes: np.ndarray, k: int = 3, seed: int = 42) -> float:
    """Nats between a number and a class (Ross 2014)."""
    x = _jittered(x, np.random.default_rng(seed))
    _, code, counts = np.unique(classes, return_inverse=True, return_counts=True)
    keep = counts[code] > 1
    x, code = x[keep], code[keep]
    if len(x) < 2:
        return 0.0
    radius, used, size = np.empty(len(x)), np.empty(len(x)), np.empty(len(x))
    for c in np.unique(code):
        at = np.flatnonzero(code == c)
        near = min(k, len(at) - 1)
        radius[at], used[at], size[at] = _kth_distance(x[at], near), near, len(at)
    m = _within(x, radius)
    n = len(x)
    return max(0.0, float(digamma(np.array([n]))[0] + digamma(used).mean() - digamma(size).mean() - digamma(m).mean()))


def mutual_information_numbers(x: np.ndarray, y: np.ndarray, k: int = 3, seed: int = 42) -> float:
    """Nats between two numbers (Kraskov, Stoegbauer, Grassberger 2004, first estimator, maximum norm)."""
    rng = np.random.default_rng(seed)
    x, y = _jittered(x, rng), _jittered(y, rng)
    n = len(x)
    if n <= k + 1:
        return 0.0
    radius = _joint_radius(x, y, k)
    nx, ny = _within(x, radius), _within(y, radius)
    return max(0.0, float(digamma(np.array([k]))[0] + digamma(np.array([n]))[0] - (digamma(nx) + digamma(ny)).mean()))


def _joint_radius(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """Maximum-norm distance to the k-th neighbour: windows in the order of x widen until no nearer point can lie outside."""
    order = np.argsort(x)
    sx, sy = x[order], y[order]
    n = len(sx)
    out = np.full(n, np.inf)
    left, width = np.arange(n), min(n - 1, 64)
    while len(left):
        for part in np.array_split(left, max(1, len(left) * width // 2_000_000)):
            start = np.clip(part - width // 2, 0, n - 1 - width)
            cols = start[:, None] + np.arange(width + 1)
            d = np.maximum(np.abs(sx[cols] - sx[part, None]), np.abs(sy[cols] - sy[part, None]))
            d[cols == part[:, None]] = np.inf
            out[part] = np.partition(d, k - 1, axis=1)[:, k - 1]
        low, high = np.clip(left - width // 2, 0, n - 1 - width), np.clip(left - width // 2, 0, n - 1 - width) + width
        edge = np.minimum(np.where(low > 0, sx[left] - sx[np.maximum(low - 1, 0)], np.inf), np.where(high < n - 1, sx[np.minimum(high + 1, n - 1)] - sx[left], np.inf))
        left = left[edge < out[left]]
        width = min(n - 1, width * 4)
    res = np.empty(n)
    res[order] = out
    return res


def mutual_information_classes(a: np.ndarray, b: np.ndarray) -> float:
    """Nats between two classes."""
    _, i = np.unique(a, return_inverse=True)
    _, j = np.unique(b, return_inverse=True)
    table = np.zeros((i.max() + 1, j.max() + 1))
    np.add.at(table, (i, j), 1)
    p = table / table.sum()
    q = p.sum(1, keepdims=True) * p.sum(0, keepdims=True)
    at = p > 0
    return max(0.0, float((p[at] * np.log(p[at] / q[at])).sum()))


def normalised(nats: float) -> float:
    """Mutual information between 0 and 1."""
    return 1 - math.exp(-2 * max(0.0, nats))


# ---- one-feature trees ----


def tree_of(x: np.ndarray, sums: np.ndarray, classes: bool, depth: int = 4) -> tuple[np.ndarray, list]:
    """A tree on one feature's distinct values in order, with the rows of each class at each value,
    or (regression) their number, sum and sum of squares of the target.

    Splits are at midpoints of neighbouring values, the best first in each node,
    exact by running sums; at a tie the lower cut.
    """
    one = np.concatenate([np.zeros((1, sums.shape[1])), np.cumsum(sums, 0)])

    def size(s: np.ndarray) -> np.ndarray:
        return s.sum(-1) if classes else s[..., 0]

    def purity(s: np.ndarray) -> np.ndarray:
        """What a split should make large; the impurity is a constant less this."""
        n = np.maximum(size(s), 1e-300)
        return (s * s).sum(-1) / n if classes else s[..., 1] ** 2 / n

    cuts, values = [], []

    def grow(lo: int, hi: int, left: int) -> None:
        whole = one[hi] - one[lo]
        if left and hi - lo > 1:
            at = np.arange(lo + 1, hi)
            gain = purity(one[at] - one[lo]) + purity(one[hi] - one[at]) - purity(whole)
            best = int(gain.argmax())
            impure = (whole > 0).sum() > 1 if classes else whole[2] - whole[1] ** 2 / whole[0] > 1e-12 * max(1.0, whole[2])
            if impure and gain[best] > -1e-9:
                cut = int(at[best])
                grow(lo, cut, left - 1)
                cuts.append((x[cut - 1] + x[cut]) / 2)
                grow(cut, hi, left - 1)
                return
        values.append(int(whole.argmax()) if classes else whole[1] / whole[0])

    grow(0, len(x), depth)
    return np.array(cuts), values


def tree_predict(tree: tuple[np.ndarray, list], x: np.ndarray) -> np.ndarray:
    cuts, values = tree
    return np.array(values)[np.searchsorted(cuts, x, "left")]


def weighted_f1(y: np.ndarray, p: np.ndarray, classes: int) -> float:
    hit = np.bincount(y[y == p], minlength=classes)
    true, said = np.bincount(y, minlength=classes), np.bincount(p, minlength=classes)
    f1 = 2 * hit / np.maximum(true + said, 1)
    return float((f1 * true).sum() / max(1, len(y)))


def gain_f1(model: float, naive: float) -> float:
    return max(0.0, (model - naive) / (1 - naive + 1e-9))


def gain_error(model: float, naive: float) -> float:
    return max(0.0, 1 - model / naive) if naive > 0 else 0.0


# ---- clusters ----


def average_linkage(distance: np.ndarray, cutoff: float) -> list[list[int]]:
    """Groups of average-linkage clustering, merged while the lowest mean distance is at most cutoff."""
    groups = [[i] for i in range(len(distance))]
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    while len(groups) > 1:
        i, j = divmod(int(d.argmin()), len(d))
        if d[i, j] > cutoff:
            break
        i, j = sorted((i, j))
        a, b = len(groups[i]), len(groups[j])
        row = (a * d[i] + b * d[j]) / (a + b)
        groups[i] += groups.pop(j)
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        d = np.delete(np.delete(d, j, 0), j, 1)
    return [sorted(g) for g in groups]
