"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset (local mode only) a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _own[app] = tempfile.mkdtemp(prefix="lexaudit-")
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no table has yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and return the table read back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.lexaudit_path = path
    return back


def discard(df: DataFrame) -> None:
    """Delete a table made by materialize."""
    remove(df.sparkSession, df.lexaudit_path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def bounded_batches(spark: SparkSession, size: int = 4_000_000) -> None:
    """Lower the bytes of an Arrow batch, so that batches of long texts fit into a Python worker; results do not change."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(key, "67108864")).rstrip("b")) > size:
        spark.conf.set(key, str(size))


def release() -> None:
    """Give memory that is free back to the system: Python workers live on and are used again."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def returned(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, which releases memory at its end."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
