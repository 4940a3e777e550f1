"""Results to files: CREATE scripts, JSON, CSV and tables."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.plans.syntax import QueryError


def _quoted(col: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(F.replace(col, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def _script_value(name: str, kind: T.DataType) -> Column:
    col = F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        return _quoted(col)
    if isinstance(kind, (T.BooleanType, T.NumericType)):
        return F.lower(col.cast("string")) if isinstance(kind, T.BooleanType) else col.cast("string")
    return _quoted(display(col, kind))


def _key(name: str) -> str:
    return name if re.fullmatch(r"[A-Za-z_]\w*", name) else f"`{name}`"


def create_script(df: DataFrame) -> DataFrame:
    """A CREATE statement for each row, without a label; nulls are left out."""
    pairs = [F.concat(F.lit(f"{_key(f.name)}: "), _script_value(f.name, f.dataType)) for f in df.schema.fields]
    body = F.concat_ws(", ", *pairs)  # skips nulls
    return df.select(F.concat(F.lit("CREATE ({"), body, F.lit("});")).alias("value"))


def display(col: Column, kind: T.DataType) -> Column:
    """A value as text: lists and maps as JSON, bytes in base 64."""
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(col)
    if isinstance(kind, T.BinaryType):
        return F.base64(col)
    return col.cast("string")


def export(df: DataFrame, path: str, format: str, mode: str = "error") -> None:
    """gql, json or csv (and parquet), written in parallel."""
    if format == "gql":
        create_script(df).write.mode(mode).text(path)
    elif format == "json":
        df.write.mode(mode).json(path, ignoreNullFields=False)
    elif format == "csv":
        df.select(*[display(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]).write.mode(mode).csv(path, header=True, emptyValue="", escape='"')
    elif format == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        raise QueryError(f"unknown format {format!r}: gql, json, csv or parquet")


def render(df: DataFrame, format: str = "table", limit: int = 1000) -> str:
    """A result for the terminal. A result of more rows than the limit is refused, not cut: it
    belongs into files (:func:`export`) or pages (:class:`Cursor`)."""
    rows = df.limit(limit + 1)
    if rows.count() > limit:
        raise QueryError(f"the result has over {limit} rows; export it, page through it or raise the limit")
    if format == "json":
        return "[" + ",\n ".join(r[0] for r in rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()) + "]"
    if format == "gql":
        return "\n".join(r[0] for r in create_script(rows).collect())
    text = rows.select(*[display(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]).collect()
    cells = [[("" if v is None else v) for v in r] for r in text]
    if format == "csv":
        quote = lambda v: '"' + v.replace('"', '""') + '"' if re.search(r'[",\r\n]', v) else v
        return "\n".join(",".join(map(quote, r)) for r in [df.columns, *cells])
    if format != "table":
        raise QueryError(f"unknown format {format!r}: table, json, csv or gql")
    widths = [max(map(len, column)) for column in zip(df.columns, *cells, strict=True)] if df.columns else []
    line = lambda r: "| " + " | ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)) + " |"
    return "\n".join([line(df.columns), "|" + "|".join("-" * (w + 2) for w in widths) + "|", *map(line, cells)])


def to_dicts(df: DataFrame) -> Iterator[dict]:
    """Rows as dictionaries, nodes and relationships too; one partition at a time."""
    for r in df.toLocalIterator():
        yield {k: _plain(v) for k, v in r.asDict(recursive=True).items()}


def _plain(v):
    if isinstance(v, (bytes, bytearray)):
        return base64.b64encode(bytes(v)).decode()
    if isinstance(v, list):
        return [_plain(x) for x in v]
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    return v


class Cursor:
    """Pages of a result: pull(n) gives the next rows and whether more follow."""

    def __init__(self, df: DataFrame):
        self.rows, self.held = to_dicts(df), []

    def pull(self, n: int) -> tuple[list[dict], bool]:
        while len(self.held) <= n:
            row = next(self.rows, None)
            if row is None:
                break
            self.held.append(row)
        out, self.held = self.held[:n], self.held[n:]
        return out, bool(self.held)

    def discard(self) -> None:
        self.rows, self.held = iter(()), []
