"""Every registered graph query against its SQL on the same tables."""

import math
import os

import duckdb
import pytest

from weft.plans import registry

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def shown(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    rel = duck.execute(registry.SQL[name])
    columns = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(columns)
    order = [columns.index(c) for c in df.columns]
    want = sorted(tuple(shown(r[i]) for i in order) for r in rel.fetchall())
    assert sorted(tuple(map(shown, r)) for r in df.collect()) == want


def test_hops_and_paths_run_over_all_customers(spark, sf_dir, duck):
    """No filter by id: every start of a hop and every target of a search has its rows."""
    ids = lambda sql: {k for (k,) in duck.execute(sql).fetchall()}
    customers = ids("SELECT c_custkey FROM customer")
    pairs = set(duck.execute("SELECT a.user_id, b.user_id FROM events a JOIN events b ON b.event_id = a.event_id + 1").fetchall())
    got = registry.QUERIES["j1c_both_loops"](spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted([*pairs, *((b, a) for a, b in pairs)])
    onward = {a: {b for x, b in pairs if x == a} for a, _ in pairs}
    far = {a: len(set().union(*(onward.get(b, set()) for b in near)) - near - {a}) for a, near in onward.items()}
    got = registry.QUERIES["j2_exact_length"](spark, sf_dir).collect()
    assert {r.a: r.n for r in got} == {a: n for a, n in far.items() if n}
    for name in ("g11_shortest_path_function", "g12_shortest_path_pattern"):
        assert sorted(r.k for r in registry.QUERIES[name](spark, sf_dir).collect()) == sorted(customers)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.SQL) <= set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("missing", ["folders", "library"])
def test_without_the_llm_folders(tmp_path, sf_dir, missing):
    """The rest imports and runs where the training-data operators are gone, or can't be
    imported for want of a library."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/weft", tmp_path / "weft", ignore=shutil.ignore_patterns("__pycache__", *(["llm"] if missing == "folders" else [])))
    if missing == "library":
        (tmp_path / "xxhash.py").write_text("raise ImportError('not here')")
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert e.oracle_sql(); from pyspark.sql import SparkSession as S; s = S.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate(); assert q['j1_one_hop'](s, SF).count() and q['m11_return_after_write'](s, SF).count() == 5".replace("SF", repr(sf_dir))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, check=True, timeout=300)
