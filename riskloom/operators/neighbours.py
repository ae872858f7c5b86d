"""Mutual information with classes over all rows: of numbers by nearest neighbours, of levels by counts.

Ross (2014) takes of each row the distance to the k-th nearest row of its class, and how many rows
of all classes are as near. Rows of one value and class can't be told apart, so they are a cell with
a count, and where several rows are equally far their order is drawn: not by noise on the values,
but by the mean over all orders, which has a closed form or a short sum. So nothing depends on a seed.

Two sorts in ranges. In the order of class and value a cell's nearest of its class are among K cells
on either side; the few at the ends of a range are settled together. In the order of values alone
running sums count the rows within that distance; where it leaves the chunk at hand, the place of
its ends among all values is looked up by one more sort.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric
from ..scratch import kept
from .ranks import with_before

#: The neighbour whose distance counts, the cells a task holds at once, and the largest number told apart.
K, HELD, LARGEST = 3, 200_000, 8e307

_CELL = "c int, y long, v double, n long"
_BALL = "c int, v double, n long, far double, near int, inside long, shell long"
_ENDS = ("below", "above", "under", "upto")


def number_information(df: DataFrame, pairs: list[tuple[Column, Column]]) -> DataFrame:
    """(c, n, mutual_info) of each pair (number, class), c its place: over all rows that have both. Rows alone in their class say nothing, as in Ross."""
    schema = "c int, n long, mutual_info double"
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    items = [F.struct(F.lit(i).alias("c"), F.xxhash64(y).alias("y"), (x.isNotNull() & y.isNotNull()).alias("has"), F.greatest(F.least(x, F.lit(LARGEST)), F.lit(-LARGEST)).alias("v")) for i, (x, y) in enumerate(pairs)]
    rows = df.select(F.inline(F.array(*items))).where("has")
    cells = rows.groupBy("c", "y", "v").agg(F.count(F.lit(1)).alias("n"))
    ordered = kept(_ranged(cells, "c", "y", "v").mapInArrow(_settled, f"{_CELL}, far double, near int, inside long, shell long, edge int"), "cells")
    # At most 4 K cells a range, so this single task is bounded.
    edges = ordered.where("edge > 0").repartition(1).sortWithinPartitions("c", "y", "v").select("c", "y", "v", "n", "edge")
    balls = ordered.where("edge < 2").select(*_names(_BALL)).unionByName(edges.mapInArrow(_joined, _BALL)).where("near > 0")
    found = kept(_ranged(balls, "c", "v").mapInArrow(_counted, f"c int, total double, id long, n long, near int, inside long, shell long, own int, {', '.join(f'{e} double' for e in _ENDS)}"), "near")
    left = found.where("id is not null")
    # Just below a value, at it, and just above it: so rows at an end of the distance are on the right side of it.
    ends = F.array(*[F.struct(F.lit(o).alias("o"), F.col(e).alias("v"), F.lit(w).alias("w")) for w, (e, o) in enumerate(zip(_ENDS, (0, 2, 0, 2)))])
    asked = left.select("c", F.inline(ends), F.lit(0).cast("long").alias("n"), "id").select("c", "v", "o", "n", "id", "w")
    values = balls.select("c", "v", F.lit(1).alias("o"), "n", F.lit(None).cast("long").alias("id"), F.lit(None).cast("int").alias("w"))
    placed = with_before(values.unionByName(asked), ["c", "v", "o"], ["n"]).where("id is not null")
    places = placed.groupBy("id").agg(*[F.max(F.when(F.col("w") == w, F.col("before_n"))).alias(e) for w, e in enumerate(_ENDS)])
    late = left.drop(*_ENDS).join(places, "id").select("c", "n", "near", "inside", "shell", "own", *_ENDS).mapInArrow(_looked_up, "c int, total double")
    said = found.where("id is null").select("c", "total").unionByName(late).groupBy("c").agg(F.sum("total").alias("total"))
    sizes = ordered.groupBy("c", "y").agg(F.sum("n").alias("n")).mapInPandas(_sizes, "c int, n long, used long, classes double")
    sizes = sizes.groupBy("c").agg(*[F.sum(x).alias(x) for x in ("n", "used", "classes")])
    # One row a pair.
    return sizes.join(F.broadcast(said), "c", "left").mapInPandas(_information, schema)


def level_information(df: DataFrame, pairs: list[tuple[Column, Column]]) -> DataFrame:
    """(c, n, mutual_info) of each pair (level, class), c its place: from the counts of all rows that have both."""
    if not pairs:
        return df.sparkSession.createDataFrame([], "c int, n long, mutual_info double")
    items = [F.struct(F.lit(i).alias("c"), F.xxhash64(x).alias("x"), F.xxhash64(y).alias("y"), (x.isNotNull() & y.isNotNull()).alias("has")) for i, (x, y) in enumerate(pairs)]
    counts = kept(df.select(F.inline(F.array(*items))).where("has").groupBy("c", "x", "y").agg(F.count(F.lit(1)).alias("n")), "levels")
    weight = lambda frame, name: frame.groupBy("c").agg(F.sum(F.col("n") * F.log("n")).alias(name))
    alone = [weight(counts.groupBy("c", k).agg(F.sum("n").alias("n")), f"_{k}") for k in ("x", "y")]
    out = counts.groupBy("c").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log("n")).alias("_xy"))
    for side in alone:
        # One row a pair.
        out = out.join(F.broadcast(side), "c")
    nats = F.greatest(F.log("n") + (F.col("_xy") - F.col("_x") - F.col("_y")) / F.col("n"), F.lit(0.0))
    return out.select("c", "n", (1 - F.exp(-2 * nats)).alias("mutual_info"))


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _ranged(rows: DataFrame, *by: str) -> DataFrame:
    return rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by)


def _arrays(b: pa.RecordBatch | pa.Table) -> list[np.ndarray]:
    return [b.column(i).to_numpy() if isinstance(b, pa.Table) else b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], list(columns))


def ends(v: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where rows as far from v as `far` begin and end below v, and above it. Rows between the second and the third are nearer.
    On the other side of v than `far`, rows are as far up to rounding."""
    d = np.abs(far - v)
    slack = np.where(d > 0, 1e-15 * np.abs(v) + 1e-15 * d, 0.0)
    left = far <= v
    with np.errstate(over="ignore"):
        return np.where(left, far, v - (d + slack)), np.where(left, far, v - (d - slack)), np.where(left, v + (d - slack), far), np.where(left, v + (d + slack), far)


def balls(c: np.ndarray, y: np.ndarray, v: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """Of each cell in the order of (c, y, v): which neighbour of its class counts (near: the K-th, or the last there is), its value (far),
    and the rows of the class that are nearer (inside) and as far (shell)."""
    size = len(v)
    at = np.arange(size)
    value, rows = [v], [n - 1]
    for j in (s * k for k in range(1, K + 1) for s in (-1, 1)):
        to = np.clip(at + j, 0, size - 1)
        same = (at + j == to) & (c[to] == c) & (y[to] == y)
        value.append(np.where(same, v[to], np.nan))
        rows.append(np.where(same, n[to], 0))
    value, rows = np.stack(value, 1), np.stack(rows, 1)
    # Of values that rounding makes equally far, the nearer in order comes first.
    order = np.where(np.isnan(value), np.inf, np.abs(value - v[:, None])).argsort(1, kind="stable")
    near = np.minimum(rows.sum(1), K)
    place = (np.take_along_axis(rows, order, 1).cumsum(1) >= near[:, None]).argmax(1)
    far = value[at, order[at, place]]
    below, above, under, upto = (e[:, None] for e in ends(v, far))
    inside = (rows * ((value > above) & (value < under))).sum(1)
    return {"far": far, "near": near.astype(np.int32), "inside": inside, "shell": (rows * ((value >= below) & (value <= upto))).sum(1) - inside}


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells with their balls. edge: 2 for the first and last K of the range, whose balls hold only what is in it; 1 for the K beside those."""
    held, done, seen = None, 0, 0

    def out(stop: int, last: bool) -> pa.RecordBatch:
        size, at = len(held[0]), np.arange(done, stop)
        place = np.minimum(seen + at, size - 1 - at if last else 2 * K)
        edge = np.where(place < K, 2, np.where(place < 2 * K, 1, 0)).astype(np.int32)
        found = balls(*held)
        return _batch(**dict(zip("cyvn", (x[at] for x in held))), **{k: x[at] for k, x in found.items()}, edge=edge)

    for b in batches:
        if not b.num_rows:
            continue
        own = _arrays(b)
        held = own if held is None else [np.concatenate(x) for x in zip(held, own)]
        stop, cut = len(held[0]) - 2 * K, len(held[0]) - 3 * K
        if cut > 0:
            yield out(stop, False)
            held, done, seen = [x[cut:] for x in held], stop - cut, seen + cut
    if held is not None:
        yield out(len(held[0]), True)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Balls of the cells at the ends of ranges, from the ends of all ranges in order."""
    got = [b for b in batches if b.num_rows]
    if got:
        c, y, v, n, edge = _arrays(pa.Table.from_batches(got))
        open_ = edge == 2
        yield _batch(**{k: x[open_] for k, x in {"c": c, "v": v, "n": n, **balls(c, y, v, n)}.items()})


def expected_digamma(inside: np.ndarray, shell: np.ndarray, own: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Mean of digamma(inside + r) over the orders of `shell` rows, where r is the place of the left-th of `own` among them."""
    first = np.where(inside == 0, left, inside + left)
    out = numeric.digamma(first)
    plain = inside == 0
    out[plain] += numeric.digamma(shell[plain] + 1) - numeric.digamma(own[plain] + 1)
    some = np.flatnonzero(~plain & (shell > own))
    if not len(some):
        return out
    asked, back = np.unique(np.stack([inside, shell, own, left], 1)[some], axis=0, return_inverse=True)
    out[some] += _beyond(asked.astype(float))[back.ravel()]
    return out


def _beyond(asked: np.ndarray) -> np.ndarray:
    """Sum over t, from left on, of the chance that r is more than t, over inside + t: what the mean has over digamma(inside + left)."""
    a, s, own, j = asked.T
    out, later = np.zeros(len(a)), np.ones(len(a))
    p = np.ones(len(a))
    for i in range(K):
        p = np.where(i < j, p * (own - i) / np.maximum(s - i, 1), p)
    # Short sums beside each other, long ones each for itself.
    on, t = np.arange(len(a)), j.copy()
    for _ in range(256):
        later[on] -= p[on]
        on = on[(later[on] > 1e-12) & (t[on] < s[on] - own[on] + j[on])]
        if not len(on):
            return out
        out[on] += later[on] / (a[on] + t[on])
        p[on] *= t[on] / (t[on] - j[on] + 1) * (s[on] - t[on] - own[on] + j[on]) / (s[on] - t[on])
        t[on] += 1
    for i in on.tolist():
        at, rest, chance, end = t[i], later[i], p[i], s[i] - own[i] + j[i]
        while at < end and rest > 1e-12:
            u = np.arange(at, min(at + HELD, end))
            grown = u / (u - j[i] + 1) * (s[i] - u - own[i] + j[i]) / (s[i] - u)
            each = chance * np.concatenate([[1.0], np.cumprod(grown[:-1])])
            after = np.maximum(rest - np.cumsum(each), 0.0)
            out[i] += (after / (a[i] + u)).sum()
            at, rest, chance = at + len(u), after[-1], each[-1] * grown[-1]
    return out


def _totals(n: np.ndarray, near: np.ndarray, inside: np.ndarray, shell: np.ndarray, closed: np.ndarray, inner: np.ndarray, own: np.ndarray) -> np.ndarray:
    """n (digamma(near) - digamma(rows as near)) of each cell. closed, inner: rows of all classes up to the distance and nearer, the cell's own row
    among them (own: it is among the nearer)."""
    nearer = inner - own
    return n * (numeric.digamma(near) - expected_digamma(nearer, closed - 1 - nearer, shell, near - inside))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of each c, chunk by chunk in the order of (c, v); cells whose distance may leave the chunk, with an id and the ends of it."""
    base, asked = TaskContext.get().partitionId() << 40, 0

    def chunk(got: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal asked
        c, v, n, far, near, inside, shell = _arrays(pa.Table.from_batches(got))
        starts = np.concatenate([[0], np.flatnonzero(np.diff(c)) + 1, [len(c)]])
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
            own = slice(lo, hi)
            x, rows = v[own], np.concatenate([[0], np.cumsum(n[own])])
            below, above, under, upto = ends(x, far[own])
            # The values of c begin or end in the chunk where another c stands beside them.
            whole = ((lo > 0) | (below > x[0])) & ((hi < len(c)) | (upto < x[-1]))
            closed = rows[np.searchsorted(x, upto, "right")] - rows[np.searchsorted(x, below, "left")]
            inner = np.maximum(rows[np.searchsorted(x, under, "left")] - rows[np.searchsorted(x, above, "right")], 0)
            mine = ((above < x) & (x < under)).astype(np.int64)
            given = [n[own], near[own].astype(np.int64), inside[own], shell[own]]
            total = _totals(*[z[whole] for z in (*given, closed, inner, mine)]).sum()
            open_ = np.flatnonzero(~whole)
            one = len(open_) + 1
            none = np.arange(one) == 0
            masked = lambda z, kind: pa.array(np.concatenate([np.zeros(1, z.dtype), z[open_]]), kind, mask=none)
            long = [masked(z, pa.int64()) for z in (given[0], given[2], given[3])]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(one, c[lo], np.int32)),
                    pa.array(np.where(none, total, 0.0)),
                    pa.array(base + asked + np.arange(one) - 1, pa.int64(), mask=none),
                    long[0],
                    masked(near[own], pa.int32()),
                    *long[1:],
                    masked(mine.astype(np.int32), pa.int32()),
                    *[masked(e, pa.float64()) for e in (below, above, under, upto)],
                ],
                ["c", "total", "id", "n", "near", "inside", "shell", "own", *_ENDS],
            )
            asked += len(open_)

    got, size = [], 0
    for b in batches:
        if b.num_rows:
            got.append(b)
            size += b.num_rows
        if size >= HELD:
            yield from chunk(got)
            got, size = [], 0
    if got:
        yield from chunk(got)


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            c, n, near, inside, shell, own, below, above, under, upto = _arrays(b)
            yield _batch(c=c, total=_totals(n, near.astype(np.int64), inside, shell, upto - below, np.maximum(under - above, 0), own.astype(np.int64)))


def _sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        used = p.n.where(p.n > 1, 0)
        yield pd.DataFrame({"c": p.c, "n": p.n, "used": used, "classes": used * numeric.digamma(p.n.to_numpy())})


def _information(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        used = np.maximum(p.used.to_numpy(), 1)
        nats = np.where(p.used > 0, numeric.digamma(used) + (p.total.fillna(0.0).to_numpy() - p.classes.to_numpy()) / used, 0.0)
        yield pd.DataFrame({"c": p.c, "n": p.n, "mutual_info": [numeric.normalised(x) for x in nats.tolist()]})
