"""Repeated substrings over all documents: which bytes lie in a string of W bytes
that also starts earlier in the corpus.

Sorting every suffix of the corpus to depth W would exchange many times its
size, so the sort is given distinguishing prefixes only (Bingmann, Sanders,
Schimek: Communication-Efficient String Sorting, 2020): a string that cannot
repeat, or whose repeats are known already, never enters it.

1. Every window of W bytes has an anchor, the smallest hash of the K-byte strings
   in it, so equal windows have their anchor at equal offsets. Windows of one
   anchor form a segment of consecutive starts. Anchors are exchanged as hashes
   (of the K bytes, and of the segment). Segments whose anchor hash is
   met once cannot repeat; a segment that occurs whole before repeats whole.
2. What remains are first occurrences whose anchor recurs in other segments: the
   borders of repeats. Their windows are suffixes cut at W. Each task sorts its
   own, keeps the first of equal ones, and front-codes the run: the length of the
   prefix shared with the string before, and the rest.
3. Runs are cut at splitters, exchanged, and combined by a loser tree over the
   runs that carries the known common prefix of each string with the last winner,
   so that bytes known to be equal aren't compared again. Equal neighbours are
   repeats of the earliest.
4. Repeated starts become byte ranges, which are cut out of the documents.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, shuffle_partitions, store

W = 100
K = 40
SPAN = W - K + 1
#: Bytes of text hashed at a time; a longer document is cut into overlapping pieces.
PIECE = 1 << 20
_LOW = np.uint64((1 << 22) - 1)


def gram_hashes(text: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the K and of the 64 bytes from each place on, as long as they fit; built by doubling.
    Byte values and multipliers are drawn from the seed."""
    rng = np.random.default_rng(seed)
    table = rng.integers(0, 2**64, 256, dtype=np.uint64)
    odd = rng.integers(0, 2**64, 6, dtype=np.uint64) | np.uint64(1)

    def join(a: np.ndarray, b: np.ndarray, step: int, k: int) -> np.ndarray:
        """Hash of `step` bytes hashed in a, and then those hashed in b."""
        n = max(0, len(b) - step)
        h = a[:n] * odd[k]
        h += b[step : step + n]
        h ^= h >> np.uint64(29)
        return h

    h = table[text]
    for k in range(3):
        h = join(h, h, 1 << k, k)
    h16 = join(h, h, 8, 3)
    h32 = join(h16, h16, 16, 4)
    return mix64(join(h32, h, 32, 5)), join(h32, h32, 32, 5)


def segments(text: np.ndarray, first: np.ndarray, last: np.ndarray, seeds: tuple[int, int]) -> tuple[np.ndarray, ...]:
    """Anchored segments of joined pieces of text.

    first, last: the first place of each piece and the end of its window starts.
    Returns (start, end) of the window starts of each segment, the offset of its
    anchor, the hash of the anchor and two of all its bytes with the offset, which
    have nothing in common but the bytes.
    """
    grams, h64 = gram_hashes(text, seeds[0])
    n = len(grams) - SPAN + 1
    none = np.empty(0, np.int64)
    if n <= 0:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(np.uint64)
    m = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    for step in (1, 2, 4, 8, 16):
        m = np.minimum(m[: len(m) - step], m[step:])
    rest = SPAN - 32
    m = np.minimum(m[: len(m) - rest], m[rest:])[:n]
    anchor = (m & _LOW).astype(np.int64)
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, first, 1)
    np.add.at(edge, last, -1)
    inside = np.cumsum(edge[:n]) > 0
    new = inside.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    new[first[first < last]] = True
    start = np.flatnonzero(new)
    stop = np.zeros(n + 1, bool)
    stop[start] = True
    stop[1:] |= inside & ~np.r_[inside[1:], False]
    ends = np.flatnonzero(stop)
    end = ends[np.searchsorted(ends, start, "right")]
    at = anchor[start]
    size = end - 1 - start
    shape = (size * 128 + at - start).astype(np.uint64)

    def whole(h64: np.ndarray, seed: int) -> np.ndarray:
        odd = np.random.default_rng(seed + 1).integers(0, 2**64, 3, dtype=np.uint64) | np.uint64(1)
        h = mix64(h64[start]) * odd[0]
        h = mix64(h + mix64(h64[start + (size + W - 64) // 2])) * odd[1]
        return mix64(h + mix64(h64[start + size + W - 64]) + shape * odd[2])

    one = whole(h64, seeds[0])
    return start, end, at - start, grams[at], one, whole(gram_hashes(text, seeds[1])[1], seeds[1])


def pieces(ids: list, own: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """Joined texts of bounded size: (bytes, document number, first place, end of window starts, offset of the place in its document)."""
    todo: list[tuple[int, int, bytes]] = []
    held = 0
    for i, t in enumerate(own):
        for at in range(0, max(len(t) - W + 1, 0), PIECE):
            part = t[at : at + PIECE + W - 1]
            if held + len(part) > 2 * PIECE and todo:
                yield _joined(todo)
                todo, held = [], 0
            todo.append((i, at, part))
            held += len(part)
    if todo:
        yield _joined(todo)


def _joined(todo: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    size = np.array([len(p) for _, _, p in todo])
    first = np.r_[0, np.cumsum(size)[:-1]]
    return np.frombuffer(b"".join(p for _, _, p in todo), np.uint8), np.array([i for i, _, _ in todo]), first, first + size - W + 1, np.array([a for _, a, _ in todo]) - first


#: One segment: anchor hash, two hashes of the whole, document, first window start, how many more follow, offset of the anchor.
SEGMENT = np.dtype([("a", "<u8"), ("h", "<u8"), ("g", "<u8"), ("doc", "<i8"), ("start", "<i8"), ("n", "u1"), ("o", "u1")])
RANGE = np.dtype([("doc", "<i8"), ("start", "<i8"), ("n", "<i8")])
#: An anchor that has more wholes in one task is hot: they are known to be borders,
#: are dealt by whole instead of by anchor, and one mark goes to the anchor's task.
HOT, BORDER, MARK = 8, 128, 127
#: Segments collected in a map task before they are sorted and sent.
HELD = 1_000_000
NULL_ID = -(1 << 63)


def earliest(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by anchor, whole, document and start; which are the first of their
    whole; which repeat it. A row equal to the first in document and start is neither."""
    s = s[np.lexsort((s["start"], s["doc"], s["g"], s["h"], s["a"]))]
    new = np.ones(len(s), bool)
    new[1:] = (s["a"][1:] != s["a"][:-1]) | (s["h"][1:] != s["h"][:-1]) | (s["g"][1:] != s["g"][:-1])
    head = s[np.flatnonzero(new)][np.cumsum(new) - 1] if len(s) else s
    return s, new, ~new & ((s["doc"] != head["doc"]) | (s["start"] != head["start"]))


def covered(s: np.ndarray) -> np.ndarray:
    """Bytes under the windows of segments, as disjoint ranges."""
    out = np.empty(len(s), RANGE)
    out["doc"], out["start"], out["n"] = s["doc"], s["start"], (s["n"] & 127).astype(np.int64) + W
    return joined(out)


def joined(r: np.ndarray) -> np.ndarray:
    """Disjoint ranges of the same bytes."""
    if not len(r):
        return r
    r = r[np.lexsort((r["start"], r["doc"]))]
    end = r["start"] + r["n"]
    # Ends within a document, kept apart between documents by their rank.
    rank = np.cumsum(np.r_[False, r["doc"][1:] != r["doc"][:-1]]).astype(np.int64) << 40
    reach = np.maximum.accumulate(end + rank)
    new = np.r_[True, r["start"][1:] + rank[1:] > reach[:-1]]
    at = np.flatnonzero(new)
    out = r[at].copy()
    out["n"] = (reach[np.r_[at[1:] - 1, len(r) - 1]] - rank[at]) - r["start"][at]
    return out


def pack_rows(s: np.ndarray) -> bytes:
    """Records column by column, which compresses better."""
    return b"".join([len(s).to_bytes(8, "little"), *[np.ascontiguousarray(s[c]).tobytes() for c in s.dtype.names]])


def unpack_rows(blob: bytes, kind: np.dtype) -> np.ndarray:
    n, at = int.from_bytes(blob[:8], "little"), 8
    out = np.empty(n, kind)
    for c in kind.names:
        size = n * kind[c].itemsize
        out[c] = np.frombuffer(blob, kind[c], n, at)
        at += size
    return out


# ---- strings: sorted runs, front coding, loser tree ----


def lcp(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of strings that agree in `known` bytes."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    low, high = known, n  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def front_code(run: list[bytes], shared: np.ndarray | None = None) -> tuple[bytes, bytes, bytes]:
    """(shared prefix lengths, lengths of the rest, rests) of a sorted run; lengths in 2 bytes. shared: where they are known."""
    if shared is None:
        shared = np.array([lcp(x, y) for x, y in zip([b"", *run], run)], np.int64)
    rest = [s[k:] for s, k in zip(run, shared.tolist())]
    return shared.astype("<u2").tobytes(), np.array([len(r) for r in rest], "<u2").tobytes(), b"".join(rest)


def front_decode(shared: bytes, sizes: bytes, rest: bytes) -> Iterator[tuple[bytes, int]]:
    """Strings of a run, each with the length of the prefix it shares with the one before."""
    last, at = b"", 0
    for k, n in zip(np.frombuffer(shared, "<u2").tolist(), np.frombuffer(sizes, "<u2").tolist()):
        last = last[:k] + rest[at : at + n]
        at += n
        yield last, k


class LoserTree:
    """Merge of sorted runs of (string, common prefix with the one before).

    Each contestant carries the length of its common prefix with the string that
    last beat it on its path, which is the last winner for all on the winner's
    path. Of two, the one that shares more with the last winner is smaller; only
    at a tie are bytes compared, and from that length on (Ng and Kakehi, 2008).
    """

    def __init__(self, runs: list[Iterator[tuple[bytes, int]]]):
        self.runs = runs
        self.n = max(1, 1 << (len(runs) - 1).bit_length()) if runs else 1
        self.text: list[bytes | None] = [None] * self.n
        self.known = [0] * self.n
        self.compared = 0
        for i, run in enumerate(runs):
            self._next(i, run)
        self.loser = [0] * self.n
        self.winner = self._build(1)

    def _next(self, i: int, run: Iterator[tuple[bytes, int]]) -> None:
        self.text[i], self.known[i] = next(run, (None, 0))

    def _beats(self, a: int, b: int) -> bool:
        """Whether contestant a goes before b; the loser keeps its common prefix with the winner."""
        s, t = self.text[a], self.text[b]
        if s is None or t is None:
            return s is not None or (t is None and a < b)
        x, y = self.known[a], self.known[b]
        if x != y:
            return x > y
        k = lcp(s, t, x)
        self.compared += k - x + 1
        first = s[k : k + 1] < t[k : k + 1] or (k == len(s) == len(t) and a < b) or (k == len(s) and k < len(t))
        self.known[b if first else a] = k
        return first

    def _build(self, node: int) -> int:
        if node >= self.n:
            return node - self.n
        a, b = self._build(2 * node), self._build(2 * node + 1)
        if self._beats(a, b):
            self.loser[node] = b
            return a
        self.loser[node] = a
        return b

    def __iter__(self) -> Iterator[tuple[bytes, int, int]]:
        """(string, common prefix with the string given before, run)."""
        beats, loser, half = self._beats, self.loser, self.n
        while self.runs and self.text[self.winner] is not None:
            w = self.winner
            yield self.text[w], self.known[w], w
            self._next(w, self.runs[w])
            node = (w + half) >> 1
            while node:
                if beats(loser[node], w):
                    w, loser[node] = loser[node], w
                node >>= 1
            self.winner = w


#: A string of the sort: the window from its anchor on, then its bytes before the
#: anchor, nearest first, then the anchor's offset. Windows are equal when these are,
#: and windows of one segment share long prefixes.
WIDE = W + 1


def strings_of(text: bytes, start: int, n: int, o: int) -> list[bytes]:
    """Strings of the windows start ... start + n, whose anchor is at start + o."""
    at = start + o
    before = text[start:at][::-1]
    return [text[at : p + W] + before[: at - p] + bytes((at - p,)) for p in range(start, start + n + 1)]


def sorted_run(strings: list[bytes], place: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(distinct strings in order, place of the earliest of each, places of the others, common prefix of each with the one before).

    place: (doc, start) records. Equal places with equal strings count once.
    """
    words = np.zeros((len(strings), 104), np.uint8)
    words[:, :WIDE] = np.frombuffer(b"".join(strings), np.uint8).reshape(-1, WIDE)
    order = np.lexsort((place["start"], place["doc"]))
    order = order[np.argsort(words.view("S104").ravel()[order], kind="stable")]
    differ = words[order[1:]] != words[order[:-1]]
    shared = np.r_[0, differ.argmax(1)] if len(order) > 1 else np.zeros(len(order), np.int64)
    new = np.ones(len(order), bool)
    new[1:] = differ.any(1)
    first = order[new]
    head = place[first][np.cumsum(new) - 1]
    own = place[order]
    return [strings[i] for i in first.tolist()], place[first], own[~new & ((own["doc"] != head["doc"]) | (own["start"] != head["start"]))], shared[new]


PLACE = np.dtype([("doc", "<i8"), ("start", "<i8")])


def window_ranges(place: np.ndarray) -> np.ndarray:
    out = np.empty(len(place), RANGE)
    out["doc"], out["start"], out["n"] = place["doc"], place["start"], W
    return joined(out)


def merge(runs: list[tuple[bytes, bytes, bytes, np.ndarray]]) -> np.ndarray:
    """Places of all strings but the earliest of each kind; runs: front-coded strings and their places."""
    tree = LoserTree([front_decode(*r[:3]) for r in runs])
    at = [0] * len(runs)
    order_run, order_at, new = [], [], []
    for _, shared, run in tree:
        order_run.append(run)
        order_at.append(at[run])
        at[run] += 1
        new.append(shared < WIDE)
    if not new:
        return np.empty(0, PLACE)
    base = np.cumsum([0] + [len(r[3]) for r in runs])
    place = np.concatenate([r[3] for r in runs])[base[order_run] + np.array(order_at)]
    new = np.array(new)
    new[0] = True
    group = np.cumsum(new) - 1
    order = np.lexsort((place["start"], place["doc"], group))
    own = place[order]
    head = own[np.searchsorted(group, np.arange(group[-1] + 1))][group]
    return own[(own["doc"] != head["doc"]) | (own["start"] != head["start"])]


# ---- the jobs ----

#: Strings of one sorted run, and of the sample that sets the splitters.
RUN, SAMPLE = 150_000, 20_000


def _hash_segments(parts: int, seeds: tuple[int, int]):
    """Segments and already known repeats of each task, by the part that decides about them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def send() -> pa.RecordBatch:
            s, new, again = earliest(np.concatenate(held))
            known, f = covered(s[again]), s[new]
            first = np.r_[True, f["a"][1:] != f["a"][:-1]]
            group = np.cumsum(first) - 1
            hot = (np.bincount(group) > HOT)[group]
            mark = f[hot & first].copy()
            mark["n"] = MARK
            f["n"][hot] |= BORDER
            f = np.concatenate([f, mark])
            part = (np.where(f["n"] >= BORDER, mix64(f["a"] ^ f["h"]), f["a"]) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(parts + 1))
            of_range = (mix64(known["doc"].view(np.uint64)) % np.uint64(parts)).astype(np.int64)
            rows = [(p, pack_rows(f[order[cut[p] : cut[p + 1]]]), pack_rows(known[of_range == p])) for p in np.union1d(part, of_range).tolist()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["part", "segments", "known"])

        size = 0
        for b in batches:
            ids = np.array([NULL_ID if x is None else x for x in b.column(0).to_pylist()], np.int64)
            own = [x or b"" for x in b.column(1).to_pylist()]
            for text, doc, first, last, off in pieces(ids, own):
                start, end, o, a, h, g = segments(text, first, last, seeds)
                piece = np.searchsorted(first, start, "right") - 1
                s = np.empty(len(start), SEGMENT)
                s["a"], s["h"], s["g"], s["doc"], s["start"], s["n"], s["o"] = a, h, g, ids[doc[piece]], start + off[piece], end - 1 - start, o
                held.append(s)
                size += len(s)
                if size >= HELD:
                    yield send()
                    size = 0
        if held:
            yield send()

    return run


def _decide_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per part: repeated bytes (border null), and the segments whose anchor has several wholes (border: the anchor's offset)."""
    blobs, known = [], []
    for b in batches:
        blobs += [unpack_rows(x, SEGMENT) for x in b.column(1).to_pylist()]
        known += [unpack_rows(x, RANGE) for x in b.column(2).to_pylist()]
    if not blobs:
        return
    s = np.concatenate(blobs)
    del blobs
    is_mark = s["n"] == MARK
    marks = np.unique(s["a"][is_mark])
    s, new, again = earliest(s[~is_mark])
    yield _range_rows(joined(np.concatenate([*known, covered(s[again])])))
    f = s[new]
    if len(f):
        same = f["a"][1:] == f["a"][:-1]
        border = np.r_[False, same] | np.r_[same, False] | (f["n"] >= BORDER)
        if len(marks):
            at = np.minimum(np.searchsorted(marks, f["a"]), len(marks) - 1)
            border |= marks[at] == f["a"]
        f = f[border]
        yield _rows([_ids(f["doc"]), pa.array(f["start"]), pa.array((f["n"] & 127).astype(np.int64)), pa.array(f["o"].astype(np.int32))])


def _ids(doc: np.ndarray) -> pa.Array:
    return pa.array(doc, mask=doc == NULL_ID)


def _rows(columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, ["id", "start", "n", "border"])


def _range_rows(r: np.ndarray) -> pa.RecordBatch:
    return _rows([_ids(r["doc"]), pa.array(r["start"]), pa.array(r["n"]), pa.nulls(len(r), pa.int32())])


_ROWS = "id long, start long, n long, border int"


def _border_strings(b: pa.RecordBatch) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Strings and places of the border segments of each document of a batch (id, text, list of segments)."""
    for i, text, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
        for g in own:
            got = strings_of(text, g["start"], g["n"], g["border"])
            place = np.empty(len(got), PLACE)
            place["doc"], place["start"] = NULL_ID if i is None else i, g["start"] + np.arange(len(got))
            yield got, place


def _sort_runs(splitters: list[bytes]):
    """Front-coded sorted runs of border windows, cut at the splitters; repeats within a run are known at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_left

        held, places = [], []

        def send() -> pa.RecordBatch:
            run_, place, known, shared = sorted_run(held, np.concatenate(places))
            cut = [0, *[bisect_left(run_, x) for x in splitters], len(run_)]
            rows = []
            for p, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
                if a < b or p == 0:
                    # The first string of a part has none before it.
                    rows.append((p, *front_code(run_[a:b], np.r_[0, shared[a + 1 : b]][: b - a]), pack_rows(place[a:b]), pack_rows(window_ranges(known)) if p == 0 else pack_rows(np.empty(0, RANGE))))
            held.clear()
            places.clear()
            kinds = (pa.int32(), *[pa.binary()] * 5)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["part", "shared", "sizes", "rest", "places", "known"])

        for b in batches:
            for got, place in _border_strings(b):
                held += got
                places.append(place)
                if len(held) >= RUN:
                    yield send()
        if held:
            yield send()

    return run


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs = []
    for b in batches:
        for shared, sizes, rest, place, known in zip(*[b.column(i).to_pylist() for i in range(1, 6)]):
            runs.append((shared, sizes, rest, unpack_rows(place, PLACE)))
            yield _range_rows(unpack_rows(known, RANGE))
    yield _range_rows(window_ranges(merge(runs)))


def _sample_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [x for got, _ in _border_strings(b) for x in got[:: max(1, len(got) // 2)]]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["s"])


#: Bytes of text behind one part of an exchange, at most: a part is held whole by its task.
PART = 64 << 20


def repeated_bytes(rows: DataFrame) -> DataFrame:
    """rows: (id long, text binary), ids different. (id, start, n): bytes in a string of W bytes that starts earlier as well; ranges of one id may touch or overlap."""
    spark = rows.sparkSession
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_partitions(spark), -(-total // PART))
    seeds = (secrets.randbits(60), secrets.randbits(60))  # hash functions of this run: no text can be made to collide
    hashed = rows.where(F.length("text") >= W).mapInArrow(_hash_segments(parts, seeds), "part int, segments binary, known binary")
    decided = store(hashed.repartitionById(parts, F.col("part")).mapInArrow(_decide_segments, _ROWS), "repeats")
    border = decided.df.where("border is not null")
    windows = border.agg(F.sum(F.col("n") + 1)).first()[0] or 0
    out = decided.df.where("border is null").select("id", "start", "n")
    if not windows:
        return out

    def with_text(segments_: DataFrame) -> DataFrame:
        lists = segments_.groupBy("id").agg(F.collect_list(F.struct("start", "n", "border")).alias("own"))
        return rows.withColumnRenamed("id", "doc").join(lists, F.col("doc").eqNullSafe(F.col("id"))).select("id", "text", "own")

    few = max(1, windows // (SAMPLE * 12))
    some = with_text(border.where(F.expr(f"pmod(xxhash64(id, start, 13), {few}) = 0")))
    seen = sorted({bytes(r.s) for r in some.mapInArrow(_sample_strings, "s binary").collect()})
    splitters = sorted({seen[len(seen) * i // parts] for i in range(1, parts)}) if seen else []
    runs = with_text(border).mapInArrow(_sort_runs(splitters), "part int, shared binary, sizes binary, rest binary, places binary, known binary")
    merged = store(runs.repartitionById(parts, F.col("part")).mapInArrow(_merge_runs, _ROWS), "repeats-borders")
    return out.unionByName(merged.df.select("id", "start", "n"))


def numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, key, text) with an id of its own for each row, in the order of keys, null first.

    The key is the id where no key repeats. Otherwise rows are written with a
    number each, and the numbers put in the order of key and text hash.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    if rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return rows.select(F.col("key").alias("id"), "key", "text")
    written = store(rows.withColumn("row", F.monotonically_increasing_id()), "repeats-rows").df
    order = written.select("key", F.xxhash64("text").alias("hash"), "row").orderBy("key", "hash", "row")
    number = store(order.select("row", F.monotonically_increasing_id().alias("id")), "repeats-numbers").df
    return written.join(number, "row").select("id", "key", "text")


def cut_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kept, spans, n_bytes, n_removed, n_spans), one row for each row of docs.

    Text as UTF-8 bytes, null as empty. Removed is each byte covered by a W-byte
    string that starts earlier too, in a smaller key or before in the same text,
    judged on the input. kept: the bytes left; spans: the removed runs (start, n),
    maximal. A null key is smaller than any. Rows that repeat a key are documents
    of their own, in the order of a hash of their texts. Texts shorter than W
    stay whole; no rows give no rows.
    """
    rows = numbered(docs, key, text)
    found = repeated_bytes(rows.select("id", "text")).groupBy("id").agg(F.collect_list(F.struct("start", "n")).alias("own"))
    both = rows.withColumnRenamed("id", "doc").join(found, F.col("doc").eqNullSafe(F.col("id")), "left").select("key", "text", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, spans = [], []
            for t, own in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                r = np.zeros(len(own or ()), RANGE)
                r["start"], r["n"] = [g["start"] for g in own or ()], [g["n"] for g in own or ()]
                r = joined(r)
                at, left = 0, []
                for s, n in zip(r["start"].tolist(), r["n"].tolist()):
                    left.append(t[at:s])
                    at = s + n
                kept.append(b"".join([*left, t[at:]]))
                spans.append([{"start": s, "n": n} for s, n in zip(r["start"].tolist(), r["n"].tolist())])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64())]))
            size = [len(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(kept, pa.binary()), pa.array(spans, kind), pa.array(size, pa.int64()), pa.array([n - len(k) for n, k in zip(size, kept)], pa.int64()), pa.array([len(x) for x in spans], pa.int64())],
                ["key", "kept", "spans", "n_bytes", "n_removed", "n_spans"],
            )

    out = both.mapInArrow(run, "key long, kept binary, spans array<struct<start: bigint, n: bigint>>, n_bytes long, n_removed long, n_spans long")
    return out.withColumnRenamed("key", key)


def digest(spark, sf_dir: str) -> DataFrame:
    """Query op4_suffix_array_dedup."""
    from .common import table

    out = cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
