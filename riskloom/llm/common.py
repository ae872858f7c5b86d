"""What the training-data operators share: reading tables, written intermediate
tables in the shared folder, and appending columns with an Arrow function."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows and bytes of an Arrow batch, at most: what a task holds of its input at a time,
#: in the JVM and again in Python. Smaller settings of the session stay.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(name, None)
        size = _bytes(now)
        if size is None or size <= 0 or size > most:
            spark.conf.set(name, str(most))


def _bytes(value: str | None) -> int | None:
    """A size setting as a number; None where it is unset or has a unit."""
    try:
        return int((value or "").lower().removesuffix("b"))
    except ValueError:
        return None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of this machine only where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: executors and driver need a folder that all of them reach")
        found = f"file://{tempfile.mkdtemp(prefix='riskloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Stored:
    """A table written to the shared folder: lineage ends here, and a lost
    executor costs nothing that was finished. drop() frees the disk."""

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        bound_batches(self.spark)
        self.path = f"{shared_dir(self.spark)}/{label}-{uuid.uuid4().hex}"
        # Shuffle files of the write go with its end, not with the driver's next garbage collection.
        before = self.spark.conf.get(_CLEAN_UP, None)
        self.spark.conf.set(_CLEAN_UP, "true")
        try:
            df.write.parquet(self.path)
        finally:
            if before is None:
                self.spark.conf.unset(_CLEAN_UP)
            else:
                self.spark.conf.set(_CLEAN_UP, before)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        _LEFT.append(self)

    def drop(self) -> None:
        try:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        finally:
            if self in _LEFT:
                _LEFT.remove(self)


_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LEFT: list[Stored] = []


def release_all() -> None:
    """Delete every written table still on disk. Results that read them are void afterwards."""
    for stored in list(_LEFT):
        try:
            stored.drop()
        except Exception:  # the session may have ended; its folder goes with it
            pass


atexit.register(release_all)


def store(df: DataFrame, label: str) -> Stored:
    return Stored(df, label)


def append_columns(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
    fields: list[T.StructField],
    keep: list[str] | None = None,
) -> DataFrame:
    """Rows of df with the columns that make()(batch) returns.

    make runs once per task. keep: the columns passed on (default all); of those
    a column named like a new one is replaced by it.
    """
    bound_batches(df.sparkSession)
    new = {f.name for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    schema = T.StructType([df.schema[c] for c in kept] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        names = kept + [f.name for f in fields]
        for batch in batches:
            if batch.num_rows:
                columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays(columns + fn(batch), names)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())
    return [x or b"" for x in column.to_pylist()]


def as_list(column: pa.Array) -> list:
    return column.to_pylist()


def split_hot(rows: DataFrame, keys: list[str], item: str, most: int) -> DataFrame:
    """Deal groups into blocks of bounded size without losing a pair.

    rows of one key tuple form a group whose members all meet. A group of more
    than `most` rows is cut by the hash of `item` into parts of about that size,
    and each pair of parts becomes a block (part_a, part_b); a row is sent to
    every block of its part. Adds part_a, part_b, on_a, on_b (which sides the
    row stands on). Small groups are the single block (0, 0).
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    hot = sizes.select(*keys, F.ceil(F.col("_n") / F.lit(float(most))).cast("int").alias("_parts"))
    dealt = rows.join(hot, keys, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    dealt = dealt.withColumn("_own", F.expr(f"cast(pmod(xxhash64({item}, 7), _parts) as int)"))
    dealt = dealt.withColumn("_with", F.explode(F.expr("sequence(0, _parts - 1)")))
    return dealt.select(
        *rows.columns,
        F.least("_own", "_with").alias("part_a"),
        F.greatest("_own", "_with").alias("part_b"),
        (F.col("_own") <= F.col("_with")).alias("on_a"),
        (F.col("_own") >= F.col("_with")).alias("on_b"),
    )


def split_parts(rows: DataFrame, keys: list[str], item: str, most: int) -> DataFrame:
    """Blocks as by split_hot, but a row meets only its own part of a group: no row is
    copied, and what different parts share isn't seen. Parts are dealt anew for each
    key tuple. Adds part_a, part_b, on_a, on_b and cut, whether the group has parts."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    hot = sizes.select(*keys, F.ceil(F.col("_n") / F.lit(float(most))).cast("int").alias("_parts"))
    dealt = rows.join(hot, keys, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    own = F.pmod(F.xxhash64(item, *keys), F.col("_parts")).cast("int")
    yes = F.lit(True)
    return dealt.select(*rows.columns, own.alias("part_a"), own.alias("part_b"), yes.alias("on_a"), yes.alias("on_b"), (F.col("_parts") > 1).alias("cut"))


def deal_apart(rows: DataFrame, keys: list[str], component: str, item: str, most: int) -> DataFrame:
    """Blocks as by split_hot, but only members of different components need to meet.

    In a group of more than `most` rows a component of more than `most` rows has
    parts of its own, which don't meet each other; the rest is dealt by hash. So
    one large component costs a row a member and part of the rest, not its square.
    """
    sizes = rows.groupBy(*keys, component).agg(F.count(F.lit(1)).alias("_n"))
    parts = lambda n: F.ceil(n / F.lit(float(most))).cast("int")
    large = F.col("_n") > most
    groups = sizes.groupBy(*keys).agg(
        F.sum("_n").alias("_all"),
        parts(F.sum(F.when(~large, F.col("_n")).otherwise(0))).alias("_rest"),
        F.collect_list(F.when(large, F.struct(F.col(component).alias("c"), parts(F.col("_n")).alias("k")))).alias("_large"),
    )
    hot = groups.where(F.col("_all") > most).drop("_all")
    dealt = rows.join(hot, keys, "left").withColumn("_at", F.coalesce(F.expr(f"array_position(transform(_large, x -> x.c), {component})"), F.lit(0)).cast("int"))
    dealt = dealt.withColumn("_from", F.expr("if(_at = 0, 0, _rest + aggregate(slice(_large, 1, _at - 1), 0, (a, x) -> a + x.k))"))
    dealt = dealt.withColumn("_own_parts", F.expr("if(_at = 0, greatest(coalesce(_rest, 1), 1), _large[_at - 1].k)"))
    dealt = dealt.withColumn("_total", F.expr("greatest(coalesce(_rest + aggregate(_large, 0, (a, x) -> a + x.k), 1), 1)"))
    dealt = dealt.withColumn("_own", F.expr(f"_from + cast(pmod(xxhash64({item}, 7), _own_parts) as int)"))
    dealt = dealt.withColumn("_with", F.explode(F.expr("filter(sequence(0, _total - 1), p -> _at = 0 or p < _from or p >= _from + _own_parts)")))
    return dealt.select(
        *rows.columns,
        F.least("_own", "_with").alias("part_a"),
        F.greatest("_own", "_with").alias("part_b"),
        (F.col("_own") <= F.col("_with")).alias("on_a"),
        (F.col("_own") >= F.col("_with")).alias("on_b"),
    )


def in_blocks(batches: Iterator[pa.RecordBatch], keys: list[str], at_least: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Consecutive rows of sorted batches, cut only where the keys change and
    after at_least rows; with the number of each row's block."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < at_least:
            continue
        whole = pa.Table.from_batches(held)
        block = _numbered(whole, keys)
        last = int(np.searchsorted(block, block[-1]))
        if last:
            yield whole.slice(0, last), block[:last]
            held = whole.slice(last).combine_chunks().to_batches()
            n = whole.num_rows - last
    if held:
        whole = pa.Table.from_batches(held)
        yield whole, _numbered(whole, keys)


def _numbered(rows: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(rows.num_rows, bool)
    for k in keys:
        v = rows.column(k).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.cumsum(change)


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of the sets of a[i] and b[i] in a flat parent array; roots are smallest members."""
    while True:
        ra, rb = parent[a], parent[b]
        differ = ra != rb
        if not differ.any():
            return
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser on an uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
