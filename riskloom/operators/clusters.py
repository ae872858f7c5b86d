"""Groups of numeric features that say the same, and the one to keep of each."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric
from ..functions.expr import number
from ..functions.kinds import NUMERIC
from ..sources.sampling import capped
from .columns import ColumnStats
from .power import bins_of, histograms
from .target import TargetSignal

RANK_BINS, LEAST, CUTOFF = 2048, 30, 0.30
WEAK = {"pps": 0.05, "auc": 0.10, "mutual_info": 0.05, "permutation": 0.05}


@dataclass
class Cluster:
    id: int
    members: list[str]
    representative: str
    mean_abs_correlation: float


@dataclass
class ShortlistEntry:
    feature: str
    score: float
    method: str
    cluster: int
    weak: bool
    redundant: list[str] = field(default_factory=list)


@dataclass
class ClusterReport:
    cutoff: float
    clusters: list[Cluster] = field(default_factory=list)
    shortlist: list[ShortlistEntry] = field(default_factory=list)


def middle_ranks(n: np.ndarray, places: np.ndarray, missing: int) -> tuple[np.ndarray, float]:
    """(centred mean rank of each bin, that of missing values, which stand at the median)."""
    total, seen = int(n.sum()) + missing, int(n.sum())
    ends = np.cumsum(n)
    low, high = np.searchsorted(ends, (seen - 1) // 2, "right"), np.searchsorted(ends, seen // 2, "right")
    before = ends - n
    if low == high:
        at = n.astype(float).copy()
        at[low] += missing
        shifted = before + np.where(np.arange(len(n)) > low, missing, 0)
        rank = shifted + (at + 1) / 2
        return rank - (total + 1) / 2, float(rank[low] - (total + 1) / 2)
    rank = before + np.where(np.arange(len(n)) >= high, missing, 0) + (n + 1) / 2
    return rank - (total + 1) / 2, float(before[high] + (missing + 1) / 2 - (total + 1) / 2)


def rank_correlations(df: DataFrame, stats: dict[str, ColumnStats], names: list[str]) -> np.ndarray:
    """Absolute rank correlation of columns over all rows, missing values at the median; 0 without spread or below 30 values.

    Ranks are those of 2,048 quantile bins (of the values themselves where they are fewer), counted
    once; then each Arrow batch of ranks adds its matrix product, as for Pearson correlations.
    """
    bins = bins_of(df, stats, names, RANK_BINS)
    k = len(names)
    # At most RANK_BINS numbers a column.
    counts = [np.zeros(len(b.values), np.int64) for b in bins.values()]
    for r in histograms(df, stats, bins, None, None, False).select("c", "bin", "n").toLocalIterator():
        counts[r.c][r.bin] = r.n
    ranks = []
    for n, b, own in zip(names, bins.values(), counts):
        ranks.append(middle_ranks(own, b.places, stats[n].n - int(own.sum())) if own.sum() >= LEAST else (np.zeros(len(own)), 0.0))
    shared = df.sparkSession.sparkContext.broadcast((list(bins.values()), ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        of, rank = shared.value
        for batch in batches:
            if batch.num_rows:
                at = [b.codes(c) for b, c in zip(of, batch.columns)]
                x = np.stack([np.where(a < 0, r[1], np.r_[r[0], 0.0][a]) for a, r in zip(at, rank)], 1)
                total += x.T @ x
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "p"])

    wide = df.select(*[number(n).alias(f"c{i}") for i, n in enumerate(names)])
    gram = np.zeros((k, k))
    for r in wide.mapInArrow(run, "i int, j int, p double").groupBy("i", "j").agg(F.sum("p").alias("p")).toLocalIterator():
        gram[r.i, r.j] = gram[r.j, r.i] = r.p
    norm = np.sqrt(np.diag(gram))
    safe = np.where(norm > 0, norm, 1)
    rho = np.abs(gram / safe[:, None] / safe)
    np.fill_diagonal(rho, 1.0)
    return rho


def signal_score(s: TargetSignal | None) -> tuple[float, str]:
    """Best figure and its name."""
    if s is None:
        return 0.0, "no_target"
    options = [(s.pps, "pps"), (s.mutual_info, "mutual_info"), (s.auc_lift, "auc"), (s.permutation, "permutation")]
    best = max(((v, m) for v, m in options if v is not None), key=lambda t: t[0])
    return best


def cluster_features(df: DataFrame, stats: dict[str, ColumnStats], signals: list[TargetSignal], target: str | None = None, cutoff: float = CUTOFF, limit: int | None = None, max_cols: int | None = None, priority: list[str] | None = None) -> ClusterReport:
    names = capped([n for n, s in stats.items() if s.kind == NUMERIC and n != target and not s.is_constant], max_cols, priority or [])
    report = ClusterReport(cutoff)
    if len(names) < 2:
        return report
    rho = rank_correlations(df, stats, names)
    groups = sorted(numeric.average_linkage(1 - rho, cutoff), key=lambda g: min(names[i] for i in g))
    by = {s.feature: s for s in signals}
    for k, g in enumerate(groups):
        members = sorted(names[i] for i in g)
        inside = [rho[a, b] for x, a in enumerate(g) for b in g[:x]]
        if signals:
            head = min(members, key=lambda n: (-signal_score(by.get(n))[0], n))
        else:
            # Most values, but nearly constant columns last.
            head = min(members, key=lambda n: (stats[n].is_near_constant, -stats[n].n_unique, n))
        report.clusters.append(Cluster(k, members, head, float(np.mean(inside)) if inside else 1.0))
        score, method = signal_score(by.get(head))
        weak = bool(signals) and (method == "no_target" or score < WEAK[method])
        report.shortlist.append(ShortlistEntry(head, score, method, k, weak, [m for m in members if m != head]))
    report.shortlist.sort(key=lambda e: (-e.score, e.feature))
    report.shortlist = report.shortlist[:limit] if limit else report.shortlist
    return report
