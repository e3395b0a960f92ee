"""Shared pieces of the training-data operators: staged tables, hashing, the learning split."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of bytes outside these (the ASCII white space of ``bytes.split``).
WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64
#: Bytes of texts that a worker gets at once, about (a longer text comes alone), and rows that a Parquet scan decodes at once.
BATCH_BYTES, SCAN_ROWS = 2 << 20, 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or a temporary one where that is unset and Spark is local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lattica.shared.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lattica-")
        spark.conf.set("lattica.shared.dir", base)
    return base


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back, so that lost executors cost one re-read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lattica_path = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more: all that was built on them is staged itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._lattica_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_broadcast(df: DataFrame, rows: int, limit: int = 1_000_000) -> DataFrame:
    """Hint a broadcast of an id table whose counted rows are few (some 40 MB); beyond ``limit`` the join shuffles.

    The rows that come out are the same either way.
    """
    return F.broadcast(df) if rows <= limit else df


def small_batches(spark: SparkSession) -> None:
    """Bound what is passed of long texts at once, in this session from now on; by Spark's defaults a batch is a whole task.

    Of a batch the JVM and the worker hold several copies, beside a heap that is full size already.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(SCAN_ROWS))


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id falls in no held-out fold (-1)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over uint64 arrays."""
    with np.errstate(over="ignore"):
        x = x.astype(U64, copy=True)
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


def give_back() -> None:
    """Return freed memory to the system at the end of a task: idle workers stay, beside those that run."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def texts_of(column) -> list[bytes]:
    """An Arrow string column as a list of UTF-8 byte strings, null as empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x if x is not None else b"" for x in column.cast(kind).to_pylist()]


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Offsets (n + 1) of consecutive runs of the given lengths."""
    out = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def sums_by(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each consecutive run; runs may be empty."""
    total = np.zeros(len(values) + 1, dtype=np.float64)
    np.cumsum(values, out=total[1:])
    at = starts_of(counts)
    return total[at[1:]] - total[at[:-1]]
