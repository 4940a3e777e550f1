"""Cutting lineage through the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a temp folder takes its
    place on a local master; a cluster must name one, as its executors don't share the driver's."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}/weft_scratch"
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write and reread: plans of loops stay short, and a lost executor costs no earlier step."""
    return reread(df.sparkSession, df.schema, [put(df)])


def put(df: DataFrame) -> str:
    """Write to a new folder and name it."""
    path = f"{shared_folder(df.sparkSession)}/weft_{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def reread(spark: SparkSession, schema: T.StructType, paths: list[str]) -> DataFrame:
    """Several folders as one relation: the plan doesn't grow with their number."""
    return spark.read.schema(schema).parquet(*paths)


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete folders that nothing reads any more."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def computed(df: DataFrame) -> bool:
    """Does the frame join or aggregate, so that a loop should not compute it again and again?"""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return "Join" in plan or "Aggregate" in plan


@contextmanager
def lenient(spark: SparkSession):
    """Analysis with ANSI mode off: integer arithmetic wraps and x/0 is NULL, as the query
    language has it. Expressions keep the mode they were analysed in."""
    key = "spark.sql.ansi.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)
