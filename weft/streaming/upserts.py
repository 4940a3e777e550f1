"""Structured Streaming into a graph: each micro-batch upserts edges as one version."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weft.operators.graph import EdgeTable
from weft.operators.storage import cut
from weft.operators.store import GraphStore


def upsert_edges(store: GraphStore, label: str, batch: DataFrame) -> None:
    """Rows (id, src, dst, properties): the last row of an id wins, by ``ts`` if there."""
    order = F.desc("ts") if "ts" in batch.columns else F.desc("src")
    new = batch.withColumn("__n", F.row_number().over(Window.partitionBy("id").orderBy(order))).filter("__n = 1").drop("__n")
    old = store.graph.edges.get(label, ())
    kept = tuple(replace(t, df=t.df.join(new.select("id"), "id", "left_anti").select(*t.df.columns)) for t in old)
    tables = (*kept, EdgeTable(cut(new)))
    store._changed(replace(store.graph, edges=store.graph.edges | {label: tables}), ("e", label))


def stream_edges(store: GraphStore, label: str, stream: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """A batch that is replayed after a failure upserts the same rows again."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: upsert_edges(store, label, df))
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def windowed_activity(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Tumbling counts per user and type with a watermark; for batch and stream alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
