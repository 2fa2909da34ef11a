"""What the operators of this subpackage share: shared-folder tables, fold columns, word splitting."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch handed to Python; texts may be long, so batches are kept small.
ARROW_ROWS = 1000
#: ASCII white space; the words of a text are what stands between it.
WORD = r"[^\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for texts of 100 kB and more."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. A temporary one only where that is unset and the
    executors are threads of the driver; on a cluster, an unset one is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="weft-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def swept(spark: SparkSession, path: str) -> None:
    """Have a table removed when the driver ends."""
    _written.append((spark, path))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weft-{uuid.uuid4().hex}-{name}"
    df.write.option("compression", "zstd").parquet(path)
    swept(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _sweep() -> None:
    """Remove the tables of ``materialise`` when the driver ends."""
    for spark, path in _written:
        with contextlib.suppress(Exception):
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


atexit.register(_sweep)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def fold(column: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null for a null id."""
    return F.crc32(F.col(column).cast("string")) % mod


def in_fold(column: str, mod: int, rest: int) -> Column:
    """True where the fold is ``rest``; false for null ids."""
    return F.coalesce(fold(column, mod) == rest, F.lit(False))


def by_hash(df: DataFrame, column: str, share: float, seed: str = "") -> DataFrame:
    """A sample that depends on the ids alone: about ``share`` of the rows."""
    if share >= 1:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(column)), F.lit(1_000_000)) < int(share * 1_000_000))


def give_back() -> None:
    """Return to the system the memory that a worker has freed and its allocators would keep: an executor's idle
    workers hold theirs beside those that work."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # an allocator other than glibc's has no malloc_trim
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def words_of(text) -> list[bytes]:
    """ASCII-lower-cased words of a text (str, bytes or None), split at ASCII white space."""
    if text is None:
        return []
    if isinstance(text, str):
        text = text.encode("utf-8", "replace")
    return text.lower().split()
