"""Session settings and tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, so that a batch of long texts fits into a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


_cached: dict[object, object] = {}
_kernel: list[str] = []


def cached(key: object, make: Callable[[], T]) -> T:
    """What ``make`` gives, kept in this worker while its tasks run one kernel."""
    if key not in _cached:
        _cached[key] = make()
    return _cached[key]


def begin(kernel: str) -> None:
    """Drop what another kernel's tasks have cached in this worker."""
    if _kernel != [kernel]:
        _cached.clear()
        _kernel[:] = [kernel]


def lean(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The kernel, whose tasks drop other kernels' caches and give what they freed back to the system: Spark keeps workers, and what they hold, for later stages."""
    name = f"{kernel.__module__}.{kernel.__qualname__}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(name)
        try:
            yield from kernel(batches)
        finally:
            pa.default_memory_pool().release_unused()
            # glibc has it, other C libraries needn't
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return run


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. In local mode a new one is made where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = tempfile.mkdtemp(prefix="strata-shared-")
    atexit.register(shutil.rmtree, found, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` into the shared folder and read it again: lineage ends here, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strata-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path.rpartition("/")[0]
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the folders of staged tables that nothing reads any more."""
    for df in frames:
        if not getattr(df, "staged_at", None):
            continue
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
