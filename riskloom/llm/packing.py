"""Packing along a space-filling curve.

A document's hashed token vector is projected to a few dimensions and placed on
a Hilbert curve; rows are range-partitioned by the curve key, sorted, and cut
into sequences in that order, so that a sequence holds neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import append_columns, shuffle_partitions, texts

LENGTH = 2048
END_ID = 1
BUCKETS = 256
DIMENSIONS, BITS = 4, 10
#: Documents of the sample that sets the ranges, for each range; the bound of what is collected.
PER_RANGE = 30
#: Bytes of text of a range, and the number of ranges at most (the ids of larger ones are sorted on disk).
PART, MOST_PARTS = 256 << 20, 1 << 14


def _projection() -> np.ndarray:
    return np.random.default_rng(7).standard_normal((BUCKETS, DIMENSIONS)) / np.sqrt(DIMENSIONS)


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of rows of integer coordinates below 2**bits (Skilling 2004)."""
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            up = (x[:, i] & q) != 0
            swap = np.where(up, 0, (x[:, 0] ^ x[:, i]) & (q - 1))
            x[:, 0] = np.where(up, x[:, 0] ^ (q - 1), x[:, 0] ^ swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[:, n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """Hilbert key of each document's hashed token counts, damped, of unit length."""
    counts = np.zeros((len(ids), BUCKETS))
    for row, own in enumerate(ids):
        if len(own):
            counts[row] = np.bincount((own * np.uint32(2654435761)) >> np.uint32(24), minlength=BUCKETS)
    v = np.log1p(counts)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    cells = ((np.clip(v @ _projection(), -1.5, 1.5) + 1.5) / 3 * (2**BITS - 1)).astype(np.int64)
    return hilbert_key(cells)


#: Rows tokenised at a time within an Arrow batch.
STEP = 256
_TIE = 23


def _of_row(docs: DataFrame, key: str, text: str, seed: int):
    """A hash that differs between rows even if they are equal."""
    return F.xxhash64(docs[key], docs[text], F.monotonically_increasing_id(), F.lit(seed))


def tokenised(docs: DataFrame, key: str, text: str, path: str, edges: np.ndarray | None = None) -> DataFrame:
    """(key, place, n) of each document: its curve key with a hash of the row below it,
    so that equal documents spread over ranges too, those of equal or null keys as well, and its number of ids. With
    edges also (part, ids): the range between two edges that place lies in."""

    def make():
        enc = bpe.encoder(path)
        kind = id_type(enc)

        def fn(batch: pa.RecordBatch) -> list[pa.Array]:
            all_texts = texts(batch, "text")
            place, n, blobs = [], [], []
            for i in range(0, len(all_texts), STEP):
                ids = [enc.encode(t.decode()) for t in all_texts[i : i + STEP]]
                place.append(curve_keys(ids))
                n += [len(x) for x in ids]
                if edges is not None:
                    blobs += [x.astype(kind).tobytes() for x in ids]
            whole = (np.concatenate(place) << _TIE) | batch.column(batch.schema.get_field_index("tie")).to_numpy()
            out = [pa.array(whole), pa.array(n, pa.int64())]
            if edges is None:
                return out
            return [*out, pa.array(np.searchsorted(edges, whole, "right").astype(np.int32)), pa.array(blobs, pa.binary())]

        return fn

    fields = [T.StructField("place", T.LongType()), T.StructField("n", T.LongType())]
    fields += [] if edges is None else [T.StructField("part", T.IntegerType()), T.StructField("ids", T.BinaryType())]
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.pmod(_of_row(docs, key, text, 7), F.lit(1 << _TIE)).alias("tie"))
    return append_columns(rows, make, fields, ["key"])


def id_type(enc: bpe.Encoder):
    return np.uint16 if enc.n_ids <= 1 << 16 else np.uint32


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, length: int = LENGTH) -> DataFrame:
    """Pieces (key, start, length, ids, doc_tokens, sequence_id, offset) of all documents.

    A document is its ids and then END_ID. Every range of the curve is filled
    without gaps; its last sequence is cut into sequences whose lengths are
    powers of two, so nothing is padded. Null and empty texts are the end id
    alone. Repeated rows and null keys are documents of their own. No rows give
    no rows.
    """
    path = path or bpe.default_path()
    size = docs.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(text)).alias("bytes")).first()
    parts = max(shuffle_partitions(docs.sparkSession), min(MOST_PARTS, (size.bytes or 0) // PART + 1))
    # Some twice the sample wanted of any table, so that it is never empty.
    share = min(1.0, 2 * PER_RANGE * parts / max(size.rows, 1))
    dice = F.pmod(_of_row(docs, key, text, 11), F.lit(1 << 40))
    some = docs.withColumn("_dice_", dice).where(F.col("_dice_") < int(share * (1 << 40))) if share < 1 else docs
    order = sorted((r.place, r.n + 1) for r in tokenised(some, key, text, path).select("place", "n").collect())
    weight = np.cumsum([n for _, n in order])
    cuts = [order[min(len(order) - 1, int(np.searchsorted(weight, weight[-1] * i / parts)))][0] for i in range(1, parts)] if order else []
    rows = tokenised(docs, key, text, path, np.array(cuts, np.int64))
    dealt = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("place", "key")
    wide = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = id_type(bpe.encoder(path))
        at = 0
        tail: dict[str, list] = _pieces()
        for batch in batches:
            get = lambda c, b=batch: b.column(b.schema.get_field_index(c))
            part = get("part")[0].as_py()
            out = tail
            for k, blob in zip(get("key").to_pylist(), get("ids").to_pylist()):
                ids = np.append(np.frombuffer(blob, kind), END_ID).astype("<u4")
                done = 0
                while done < len(ids):
                    take = min(len(ids) - done, length - at % length)
                    _put(out, k, done, ids[done : done + take], len(ids), (part << 32) | at // length, at % length)
                    done += take
                    at += take
            whole = next((i for i in range(len(out["at"]) - 1, -1, -1) if out["at"][i] + out["length"][i] == length), -1) + 1
            yield _batch({c: v[:whole] for c, v in out.items()}, batch.schema)
            tail = {c: v[whole:] for c, v in out.items()}
        if tail["key"]:
            yield _batch(_cut_tail(tail, at % length), batch.schema)

    schema = T.StructType([T.StructField(key, wide), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def named(batches):
        for b in run(batches):
            yield b.rename_columns([f.name for f in schema])

    return dealt.mapInArrow(named, schema)


def _pieces() -> dict[str, list]:
    return {c: [] for c in ("key", "start", "length", "ids", "all", "seq", "at")}


def _put(out: dict[str, list], key, start: int, ids: np.ndarray, all_: int, seq: int, at: int) -> None:
    for c, v in zip(out, (key, start, len(ids), ids.tobytes(), all_, seq, at)):
        out[c].append(v)


def _cut_tail(tail: dict[str, list], n: int) -> dict[str, list]:
    """The pieces of an unfilled sequence of n ids, in sequences of falling powers of two."""
    ends = np.cumsum([1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1])
    out, seq = _pieces(), tail["seq"][0]
    for key, start, size, ids, all_, at in zip(*(tail[c] for c in ("key", "start", "length", "ids", "all", "at"))):
        done = 0
        while done < size:
            k = int(np.searchsorted(ends, at + done, "right"))
            take = min(size - done, int(ends[k]) - at - done)
            _put(out, key, start + done, np.frombuffer(ids, "<u4")[done : done + take], all_, seq + k, at + done - (int(ends[k - 1]) if k else 0))
            done += take
    return out


def _batch(out: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    kinds = [schema.field("key").type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))


def digest(spark, sf_dir: str) -> DataFrame:
    """Query op7_packing."""
    from .common import table

    packed = pack(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
