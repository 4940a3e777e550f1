"""The query entry point: parse, lower, and return a DataFrame; guards for its execution."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, Row

from weft.operators.graph import PropertyGraph
from weft.operators.storage import lenient
from weft.plans import syntax as s
from weft.plans.lowering import Compiler
from weft.plans.parser import parse
from weft.plans.syntax import QueryError

#: Rows that a guarded result may have.
MOST_ROWS = 10_000_000


def query(graph: PropertyGraph, text: str, params: dict | None = None) -> DataFrame:
    """A read-only statement as a lazy DataFrame. Searches with an open depth run their
    levels when this is called; everything else runs with the caller's action."""
    statement = parse(text)
    if not isinstance(statement, s.Statement) or statement.writes:
        raise QueryError("this statement writes or declares; use a GraphStore")
    with lenient(graph.spark):
        return Compiler(graph, params).run(statement)


def validate(text: str) -> None:
    """Raise if the statement can't be parsed."""
    parse(text)


def fetch(df: DataFrame, most_rows: int = MOST_ROWS, seconds: float | None = None) -> list[Row]:
    """Rows for the driver, with guards: more rows than allowed or a run beyond the deadline
    is an error, not a truncated result."""
    context, group = df.sparkSession.sparkContext, f"weft-{uuid.uuid4().hex}"
    expired = threading.Event()

    def stop() -> None:
        expired.set()
        context.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop) if seconds is not None else None
    context.setJobGroup(group, "a guarded query", interruptOnCancel=True)
    try:
        if timer:
            timer.start()
        rows = df.limit(most_rows + 1).collect()
    except Exception as e:
        if expired.is_set():
            raise QueryError(f"the query took more than {seconds:g} s") from e
        raise
    finally:
        if timer:
            timer.cancel()
        for key in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            context.setLocalProperty(key, None)
    if len(rows) > most_rows:
        raise QueryError(f"the query gives more than {most_rows} rows")
    return rows
