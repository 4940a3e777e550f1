"""Command line: query, exec, import and export over a stored graph.

    spark-submit -m weft query  STORE "MATCH (n) RETURN COUNT(*)" [--format table|json|csv|gql]
    python -m weft exec   STORE "CREATE (:A {x: 1})"
    python -m weft import STORE FILE --format gql|csv|json|csv-edges [--key name]
    python -m weft export STORE "MATCH (n) RETURN n.x" OUT --format gql|json|csv|parquet
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from weft.operators.session import query
from weft.operators.store import GraphStore
from weft.plans.syntax import QueryError
from weft.sources import exports, imports


def _open(spark: SparkSession, path: str) -> GraphStore:
    try:
        return GraphStore(imports.load_graph(spark, path))
    except Exception as e:  # noqa: BLE001  any store reports a missing path in its own way
        if "PATH_NOT_FOUND" in str(e):
            return GraphStore(spark)
        raise


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> str:
    p = argparse.ArgumentParser(prog="weft", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=["query", "exec", "import", "export"])
    p.add_argument("store")
    p.add_argument("what")
    p.add_argument("out", nargs="?")
    p.add_argument("--format", default=None)
    p.add_argument("--key", default="name", help="node property that csv-edges match by")
    own = p.parse_args(args)
    spark = spark or SparkSession.builder.appName("weft").getOrCreate()
    store = _open(spark, own.store)
    if own.command == "query":
        return exports.render(query(store.graph, own.what), own.format or "table")
    if own.command == "export":
        exports.export(query(store.graph, own.what), own.out, own.format or "json")
        return own.out
    if own.command == "exec":
        done = store.script(own.what)
    else:
        read = {"gql": imports.import_script, "csv": imports.import_csv_nodes, "json": imports.import_json, "csv-edges": lambda s, f: imports.import_csv_edges(s, f, own.key)}
        if (own.format or "gql") not in read:
            raise QueryError(f"unknown format {own.format!r}: {', '.join(read)}")
        done = read[own.format or "gql"](store, own.what)
    imports.save_graph(store.graph, own.store)
    return ", ".join(f"{k.replace('_', ' ')}: {v}" for k, v in vars(done).items() if v) or "no change"


if __name__ == "__main__":
    print(main())
