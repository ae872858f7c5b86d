"""Predictive power of every feature over all rows, from one table of counts.

A tree on one feature only cuts its values into intervals, so all it can see is how
often each value, or each of 256 quantile bins, meets each class (or bin of a numeric
target). One aggregate makes these histograms for all features; everything else is
a task a feature over its own histogram: trees level by level, folds, splits and
bootstraps. Rows of one bin and class can't be told apart by the tree, so dealing a
bin's count into folds by a seeded hypergeometric draw is dealing its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric
from ..functions.expr import as_text, col, number
from ..functions.kinds import NUMERIC
from .columns import ColumnStats

#: Bins of a number with more values than that, and rank accuracy of their bounds.
BINS, ACCURACY = 256, 5120
#: Classes of a target that a tree can predict: the most frequent. Rows of the others count, as missed.
CLASSES_KEPT = 256
#: Cells that a task holds before it hands them on.
HELD = 1_000_000


@dataclass
class Bins:
    """Values of a feature in order: all there are, or the upper bounds of its quantile bins."""

    number: bool
    values: list = field(default_factory=list)

    def codes(self, column: pa.Array) -> np.ndarray:
        """The bin of each row, -1 where the value is missing."""
        if not self.number:
            return pc.fill_null(pc.index_in(column, pa.array(self.values, pa.string())), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        x = column.to_numpy(zero_copy_only=False).astype(float)
        bounds = np.asarray(self.values, float)
        at = np.minimum(np.searchsorted(bounds, x, "left"), max(len(bounds) - 1, 0))
        return np.where(np.isnan(x) | (len(bounds) == 0), -1, at)

    @property
    def places(self) -> np.ndarray:
        """What cuts are halfway between."""
        return np.asarray(self.values, float) if self.number else np.arange(len(self.values), dtype=float)


def bins_of(df: DataFrame, stats: dict[str, ColumnStats], names: list[str], bins: int = BINS) -> dict[str, Bins]:
    """Bins of each named column, two aggregates at most. Columns of few values have one for each; levels follow their text."""
    few = [n for n in names if stats[n].kind != NUMERIC or stats[n].n_unique <= bins]
    many = [n for n in names if n not in few]
    found: dict[str, Bins] = {}
    if few:
        # At most `bins` numbers or as many levels as a feature may have.
        sets = df.agg(*[F.collect_set(number(n) if stats[n].kind == NUMERIC else as_text(df.schema[n])).alias(f"c{i}") for i, n in enumerate(few)]).first()
        found |= {n: Bins(stats[n].kind == NUMERIC, sorted(v)) for n, v in zip(few, sets)}
    if many:
        from .ranks import stacked

        shares = [k / (bins - 1) for k in range(bins)]
        rows = stacked(df, [number(n) for n in many]).groupBy("c").agg(F.percentile_approx("v", shares, ACCURACY).alias("q")).collect()
        found |= {many[r.c]: Bins(True, sorted(set(r.q))) for r in rows}
    return {n: found.get(n, Bins(True)) for n in names}


def histograms(df: DataFrame, stats: dict[str, ColumnStats], bins: dict[str, Bins], target: str | None, goal: Bins | None, classification: bool, late: Column | None = None) -> DataFrame:
    """(c, side, bin, y, n, s): rows of each feature (its place in bins) by its bin and the target's class or bin.

    s sums a numeric target. side is 1 where `late` holds. Rows without the feature or the
    target are out; a class that goal doesn't name has the number after the last.
    """
    names = list(bins)
    typed = lambda n: number(n) if stats[n].kind == NUMERIC and bins.get(n, goal).number else as_text(df.schema[n])
    y = F.lit(0.0) if target is None else (as_text(df.schema[target]) if classification else number(target))
    wide = df.select(*[typed(n).alias(f"c{i}") for i, n in enumerate(names)], y.alias("y"), (F.lit(False) if late is None else late).alias("late"))
    width = 1 if goal is None else len(goal.values) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {i: [] for i in range(len(names))}
        cells = 0
        for b in batches:
            if not b.num_rows:
                continue
            own = b.column(len(names))
            if goal is None:
                label, value = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            else:
                label = goal.codes(own)
                value = np.zeros(b.num_rows) if classification else own.to_numpy(zero_copy_only=False).astype(float)
                if classification:
                    label = np.where((label < 0) & own.is_valid().to_numpy(zero_copy_only=False), width - 1, label)
            side = b.column(len(names) + 1).to_numpy(zero_copy_only=False).astype(bool).astype(np.int64)
            for i, n in enumerate(names):
                at = bins[n].codes(b.column(i))
                ok = (at >= 0) & (label >= 0)
                keys, back = np.unique((at[ok] * width + label[ok]) * 2 + side[ok], return_inverse=True)
                held[i].append((keys, np.bincount(back, minlength=len(keys)), np.bincount(back, value[ok], len(keys))))
                cells += len(keys)
            if cells > 2 * HELD:
                held = {i: [_summed(x)] for i, x in held.items()}
                cells = sum(len(x[0][0]) for x in held.values())
                if cells > HELD:
                    yield from _cells(held, width)
                    held, cells = {i: [] for i in range(len(names))}, 0
        yield from _cells(held, width)

    found = wide.mapInArrow(run, "c int, side int, bin int, y int, n long, s double")
    return found.groupBy("c", "side", "bin", "y").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def _summed(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    add = lambda k: np.bincount(back, np.concatenate([p[k] for p in parts]), len(keys))
    return keys, add(1).astype(np.int64), add(2)


def _cells(held: dict[int, list], width: int) -> Iterator[pa.RecordBatch]:
    for i, parts in held.items():
        keys, n, s = _summed(parts)
        if len(keys):
            columns = (np.full(len(keys), i, np.int32), (keys % 2).astype(np.int32), (keys // 2 // width).astype(np.int32), (keys // 2 % width).astype(np.int32), n, s)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["c", "side", "bin", "y", "n", "s"])


# ---- one feature's histogram ----


def dealt(counts: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """`size` of the counted rows drawn without replacement; beyond what numpy draws exactly (1e9 rows), each cell by its share."""
    total = int(counts.sum())
    if size >= total:
        return counts.copy()
    if total < 1_000_000_000:
        return rng.multivariate_hypergeometric(counts.ravel(), size, method="marginals").reshape(counts.shape)
    return rng.binomial(counts, size / total)


def folded(counts: np.ndarray, k: int, rng: np.random.Generator) -> list[np.ndarray]:
    """The counts dealt into k parts of about equal size."""
    out, left = [], counts.copy()
    for f in range(k - 1):
        out.append(dealt(left, round(int(left.sum()) / (k - f)), rng))
        left = left - out[-1]
    return [*out, left]


class Classes:
    """Counts (bin, class) of a feature against classes; the last class is what the tree can't name."""

    def __init__(self, places: np.ndarray):
        self.places = places

    def judged(self, train: np.ndarray) -> np.ndarray:
        """The tree's class of each bin."""
        at = np.flatnonzero(train.sum(1))
        tree = numeric.tree_of(self.places[at], train[at, :-1].astype(float), True)
        return numeric.tree_predict(tree, self.places).astype(int)

    @staticmethod
    def f1(said: np.ndarray, test: np.ndarray) -> float:
        true, k = test.sum(0), test.shape[1]
        hit, named = np.zeros(k), np.zeros(k)
        np.add.at(named, said, test.sum(1))
        np.add.at(hit, said, test[np.arange(len(said)), said])
        return float((2 * hit / np.maximum(true + named, 1) * true).sum() / max(1, true.sum()))

    def power(self, counts: np.ndarray, rng: np.random.Generator) -> float:
        per = counts.sum(0)
        present = per[per > 0]
        if len(present) < 2 or present.min() < 2 or not per[:-1].any():
            return 0.0
        k = max(2, min(4, int(present.min())))
        parts = [np.stack(p, 1) for p in zip(*[folded(counts[:, c], k, rng) for c in range(counts.shape[1])])]
        scores = [self.f1(self.judged(counts - p), p) for p in parts]
        naive = self.f1(np.full(len(counts), per[:-1].argmax()), counts)
        return numeric.gain_f1(float(np.mean(scores)), naive)

    def held_out(self, train: np.ndarray, test: np.ndarray) -> float:
        if test.sum() < 10 or train[:, :-1].sum() < 2:
            return 0.0
        naive = self.f1(np.full(len(test), train[:, :-1].sum(0).argmax()), test)
        return numeric.gain_f1(self.f1(self.judged(train), test), naive)

    @staticmethod
    def enough(train: np.ndarray, test: np.ndarray, least: int) -> bool:
        per = (train + test).sum(0)
        per = per[per > 0]
        if (test.sum(0) > 0).sum() < 2:
            return False
        return per.min() >= least if len(per) == 2 else per.sum() >= least

    @staticmethod
    def area(counts: np.ndarray) -> float | None:
        """AUC of the greater of two classes, mean ranks within a bin."""
        used = counts[:, counts.sum(0) > 0]
        p, q = used[:, 1].sum(), used[:, 0].sum()
        size = used.sum(1)
        rank = np.cumsum(size) - (size - 1) / 2
        return float(((used[:, 1] * rank).sum() - p * (p + 1) / 2) / (p * q)) if p and q else None


class Numbers:
    """Counts (bin, bin of the target), with the target's mean in each cell."""

    def __init__(self, places: np.ndarray, mean: np.ndarray):
        self.places, self.mean = places, mean

    def judged(self, train: np.ndarray) -> np.ndarray:
        n, s, q = train.sum(1), (train * self.mean).sum(1), (train * self.mean**2).sum(1)
        at = np.flatnonzero(n)
        tree = numeric.tree_of(self.places[at], np.stack([n[at], s[at], q[at]], 1).astype(float), False)
        return numeric.tree_predict(tree, self.places)

    def error(self, said: np.ndarray, test: np.ndarray) -> float:
        return float((test * np.abs(self.mean - said[:, None])).sum() / max(1, test.sum()))

    def median(self, counts: np.ndarray) -> float:
        order = np.argsort(self.mean, axis=None)
        ends = np.cumsum(counts.ravel()[order])
        value = lambda k: self.mean.ravel()[order][np.searchsorted(ends, k, "right")]
        n = int(ends[-1])
        return float(value((n - 1) // 2) + value(n // 2)) / 2

    def power(self, counts: np.ndarray, rng: np.random.Generator) -> float:
        if counts.sum() < 4:
            return 0.0
        errors = [self.error(self.judged(counts - p), p) for p in folded(counts, 4, rng)]
        return numeric.gain_error(float(np.mean(errors)), self.error(np.full(len(counts), self.median(counts)), counts))

    def held_out(self, train: np.ndarray, test: np.ndarray) -> float:
        if test.sum() < 10 or train.sum() < 10:
            return 0.0
        return numeric.gain_error(self.error(self.judged(train), test), self.error(np.full(len(test), self.median(train)), test))

    @staticmethod
    def enough(train: np.ndarray, test: np.ndarray, least: int) -> bool:
        return True


def power_frame(df: DataFrame, stats: dict[str, ColumnStats], names: list[str], target: str, classification: bool, classes: list[str], late: Column | None = None, seeds: int = 1, replicates: int = 0, each_side: int = 50, least: int = 30) -> DataFrame:
    """(feature, n, positive_count, pps, pps_mean, pps_cov, auc_low, auc_high, pps_random, pps_time), a row a feature.

    pps: cross-validated over all rows that have feature and target. With `late`, pps_time
    learns from the other rows and is judged on the late ones, pps_random on as many at
    random; null where a side is too small. seeds: bootstraps of pps; replicates: of the AUC.
    classes: the target's, in the order that breaks ties. Three aggregates, whatever the number of features.
    """
    spark = df.sparkSession
    schema = "feature string, n long, positive_count long, pps double, pps_mean double, pps_cov double, auc_low double, auc_high double, pps_random double, pps_time double"
    if not names:
        return spark.createDataFrame([], schema)
    bins = bins_of(df, stats, names)
    goal = Bins(False, classes) if classification else bins_of(df, stats, [target])[target]
    shape, timed = (len(goal.values) + 1,), late is not None

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        i = int(cells.c.iloc[0])
        own = bins[names[i]]
        counts, sums = np.zeros((2, len(own.values), *shape), np.int64), np.zeros((2, len(own.values), *shape))
        where = (cells.side.to_numpy(), cells.bin.to_numpy(), cells.y.to_numpy())
        counts[where], sums[where] = cells.n.to_numpy(), cells.s.to_numpy()
        whole = counts.sum(0)
        kind = Classes(own.places) if classification else Numbers(own.places, sums.sum(0) / np.maximum(whole, 1))
        rng = np.random.default_rng(42 + i)
        out = dict.fromkeys(_COLUMNS)
        out |= {"feature": names[i], "n": int(whole.sum()), "pps": kind.power(whole, rng)}
        per = whole.sum(0)[whole.sum(0) > 0] if classification else []
        binary = len(per) == 2
        out["positive_count"] = int(min(per)) if binary else None
        # A bootstrap of rows is a multinomial draw of cells.
        again = lambda r: r.multinomial(int(whole.sum()), (whole / whole.sum()).ravel()).reshape(whole.shape)
        if seeds > 1:
            powers = [kind.power(again(r), r) for r in map(np.random.default_rng, range(seeds))]
            mean = float(np.mean(powers))
            out["pps_mean"], out["pps_cov"] = mean, float(np.std(powers) / mean) if mean > 0 else 0.0
        if replicates and binary and own.number and whole.sum() >= 50:
            r = np.random.default_rng(42)
            areas = [a for _ in range(replicates) if (a := Classes.area(again(r))) is not None]
            if areas:
                out["auc_low"], out["auc_high"] = np.percentile(areas, [2.5, 97.5])
        if timed:
            n_late = int(counts[1].sum())
            drawn = dealt(whole, n_late, rng)
            for name, test in (("pps_time", counts[1]), ("pps_random", drawn)):
                train = whole - test
                if min(train.sum(), test.sum()) >= each_side and kind.enough(train, test, least):
                    out[name] = kind.held_out(train, test)
        return pd.DataFrame([out], columns=list(_COLUMNS))

    found = histograms(df, stats, bins, target, goal, classification, late)
    # A feature's histogram: at most BINS or its levels times the target's classes or bins, twice.
    return found.groupBy("c").applyInPandas(run, schema)


_COLUMNS = ("feature", "n", "positive_count", "pps", "pps_mean", "pps_cov", "auc_low", "auc_high", "pps_random", "pps_time")
