"""Shared pieces: table access, shared scratch space, word rules, Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words in every contract: \x20 and \x09-\x0D.
WORD_SQL = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"
#: Bytes of an Arrow batch that goes to a Python worker.
BATCH = 8 << 20
#: Bytes A-Z to a-z, all else unchanged.
LOWER_ASCII = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share.

    ``spark.checkpoint.dir`` names it. Only where that is unset on a local master
    (tests) a folder in the driver's temp folder takes its place; a cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        root = f"file://{tempfile.gettempdir()}/weft_scratch"
    return f"{root.rstrip('/')}/weft_{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write and reread: cuts lineage and survives the loss of an executor."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a frame that :func:`stored` returned and nothing reads any more."""
    spark = df.sparkSession
    for folder in {x.rpartition("/")[0] for x in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of work that is stored: it does so only when the
    driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def crc32_of(col: Column) -> Column:
    """Unsigned crc32 of a value as text; null stays null."""
    return F.crc32(F.encode(col.cast("string"), "UTF-8"))


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; bytes.split() breaks at \\x20 and \\x09-\\x0D."""
    return utf8(text).split()


def utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


#: What this worker process keeps from task to task: one thing at a time, so that models of
#: earlier stages don't add up in workers that Spark uses again.
_kept: list[tuple] = []


def held(key: tuple, make: Callable):
    """What ``make`` returns, kept for later tasks until something else is held."""
    if not _kept or _kept[0][0] != key:
        _kept.clear()
        _kept.append((key, make()))
    return _kept[0][1]


def tidy() -> None:
    """At a task's end: give memory that isn't used any more back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps what it keeps
        pass


def batched(df: DataFrame) -> DataFrame:
    """The frame, with the session set to send at most ``BATCH`` bytes to Python at once: executors
    hold a batch several times over. A session that asks for less keeps its own figure."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    own = conf.get(name).rstrip("b")
    if not own.isdigit() or int(own) > BATCH:  # with another unit it is no small number
        conf.set(name, str(BATCH))
    return df


def parts_for(df: DataFrame, size: int = 64 << 20) -> int:
    """Partitions to deal a frame into: those of the session, or more, so that one holds about ``size`` bytes."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(n, known // size) if known < 1 << 60 else n  # Spark has no idea of the size


def slices(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` bytes, so that long texts don't add up."""
    n = batch.num_rows
    step = max(1, min(n, int(n * most / max(1, batch.nbytes)))) if n else 1
    for i in range(0, n, step):
        yield batch.slice(i, step)
