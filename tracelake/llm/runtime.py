"""Where intermediate tables go, and how many parts a shuffle of packed rows gets."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; the session sets its own only where none is named."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_made: list[str] = []


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders of the tables that are stored inside the block."""
    paths, before = [], len(_made)
    yield paths
    paths += _made[before:]


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored tables; for when no result that reads them is needed any more."""
    for name in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _made[:] = [name for name in _made if name not in paths]


def lean(spark: SparkSession) -> None:
    """Arrow batches between the JVM and Python of at most 8 MB, unless the session has set a limit of its own below that."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not str(now).rstrip("bB").isdigit() or not 0 < int(str(now).rstrip("bB")) < BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def give_back() -> None:
    """Hand memory that a Python worker has freed back to the system: the worker stays for the next task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that nobody holds any more (it does so when the driver collects garbage)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def input_size(df: DataFrame, each: int = 8 << 20) -> int:
    """Bytes of the plan's inputs; one whose size Spark does not know counts as `each` for every shuffle partition."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    unknown = each * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x if x < 1 << 58 else unknown for x in sizes)


def parts(df: DataFrame, each: int, least: int = 32) -> int:
    """A power of two, such that a part gets about so many bytes of the plan's inputs.

    It follows the inputs' size, so the work of one part stays the same at any size; it never changes a result.
    """
    estimate = input_size(df, each)
    n = least
    while n * each < estimate and n < 1 << 20:
        n *= 2
    return n
