"""Tables that a later step of the same analysis reads more than once, written where all executors reach them."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of this machine only where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: executors and driver need a folder that all of them reach")
        found = f"file://{tempfile.mkdtemp(prefix='riskloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: By thread, so that analyses that run beside each other don't release each other's tables.
_LEFT: dict[int, list[tuple[SparkSession, str]]] = {}


def _own() -> list[tuple[SparkSession, str]]:
    return _LEFT.setdefault(threading.get_ident(), [])


def place(spark: SparkSession, label: str) -> str:
    """A new path there. What is written to it goes at exit or by release()."""
    path = f"{folder(spark)}/{label}-{uuid.uuid4().hex}"
    _own().append((spark, path))
    return path


def kept(df: DataFrame, label: str) -> DataFrame:
    """df as a written table: computed once, and not again when an executor is lost."""
    path = place(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_lines(df: DataFrame, label: str) -> str:
    """The path of a frame of one text column, written as lines."""
    path = place(df.sparkSession, label)
    df.write.text(path)
    return path


def release(since: int = 0) -> None:
    """Delete this thread's written tables from the since-th on. Frames that read them are void afterwards."""
    _release(_own(), since)


def _release(left: list[tuple[SparkSession, str]], since: int) -> None:
    while len(left) > since:
        spark, path = left.pop()
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may have ended; its folder goes with it
            pass


def mark() -> int:
    """What release() takes to delete only tables this thread writes from here on."""
    return len(_own())


@atexit.register
def _release_all() -> None:
    for left in list(_LEFT.values()):
        _release(left, 0)
