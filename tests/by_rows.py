"""Figures by their definitions over rows in memory, which the tests hold the table-wide ones against."""

from __future__ import annotations

import math

import numpy as np

from riskloom.functions import numeric


def pearson(x: np.ndarray, y: np.ndarray) -> float | None:
    a, b = x - x.mean(), y - y.mean()
    spread = math.sqrt((a @ a) * (b @ b))
    return float(a @ b / spread) if spread > 0 else None


def spearman(x: np.ndarray, y: np.ndarray, least: int = 5) -> float | None:
    """Signed rank correlation with averaged ties; None below `least` rows or without spread."""
    ok = ~(np.isnan(x) | np.isnan(y))
    if ok.sum() < least:
        return None
    return pearson(numeric.average_ranks(x[ok]), numeric.average_ranks(y[ok]))


def ks_distance(a: np.ndarray, b: np.ndarray) -> float:
    at = np.concatenate([a, b])
    a, b = np.sort(a), np.sort(b)
    return float(np.abs(np.searchsorted(a, at, "right") / len(a) - np.searchsorted(b, at, "right") / len(b)).max())


def tree_intervals(x: np.ndarray, y: np.ndarray, classes: int, depth: int = 4) -> tuple[np.ndarray, list]:
    """A tree on one feature's rows: (cut points, value of each interval). classes 0: regression by squared error."""
    values, at = np.unique(x, return_inverse=True)
    if classes:
        sums = np.zeros((len(values), classes))
        np.add.at(sums, (at, y), 1)
    else:
        sums = np.stack([np.bincount(at, w, len(values)) for w in (np.ones(len(y)), y, y * y)], 1)
    return numeric.tree_of(values, sums, bool(classes), depth)


def folds(y: np.ndarray, k: int, stratified: bool) -> np.ndarray:
    """Fold of each row, in row order: contiguous, or contiguous within each class."""
    if not stratified:
        sizes = np.full(k, len(y) // k)
        sizes[: len(y) % k] += 1
        return np.repeat(np.arange(k), sizes)
    out = np.empty(len(y), int)
    for c in np.unique(y):
        at = np.flatnonzero(y == c)
        out[at] = folds(at, k, False)
    return out


def predictive_power(x: np.ndarray, y: np.ndarray, classes: int, test: np.ndarray | None = None) -> float:
    """How much better one feature predicts than no feature, 0 to 1.

    Classification: weighted F1 of a depth-4 tree against the majority class.
    Regression: mean absolute error against the median. Cross-validated over rows
    in their order, or judged on `test` rows with tree and baseline from the others.
    """
    if test is not None:
        train = ~test
        if test.sum() < 10 or train.sum() < (2 if classes else 10):
            return 0.0
        if classes:
            said = numeric.tree_predict(tree_intervals(x[train], y[train], classes), x[test])
            major = np.full(test.sum(), np.bincount(y[train], minlength=classes).argmax())
            return numeric.gain_f1(numeric.weighted_f1(y[test], said, classes), numeric.weighted_f1(y[test], major, classes))
        naive = np.abs(y[test] - np.median(y[train])).mean()
        return numeric.gain_error(np.abs(y[test] - numeric.tree_predict(tree_intervals(x[train], y[train], 0), x[test])).mean(), naive)
    if classes:
        counts = np.bincount(y, minlength=classes)
        least = counts[counts > 0].min() if (counts > 0).sum() > 1 else 0
        if least < 2:
            return 0.0
        fold = folds(y, max(2, min(4, int(least))), True)
        scores = []
        for f in range(fold.max() + 1):
            t = fold == f
            scores.append(numeric.weighted_f1(y[t], numeric.tree_predict(tree_intervals(x[~t], y[~t], classes), x[t]), classes))
        naive = numeric.weighted_f1(y, np.full(len(y), counts.argmax()), classes)
        return numeric.gain_f1(float(np.mean(scores)), naive)
    fold = folds(y, 4, False)
    errors = [np.abs(y[t] - numeric.tree_predict(tree_intervals(x[~t], y[~t], 0), x[t])).mean() for t in (fold == f for f in range(4))]
    return numeric.gain_error(float(np.mean(errors)), float(np.abs(y - np.median(y)).mean()))
