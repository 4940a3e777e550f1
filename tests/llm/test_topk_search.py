import math

from pyspark.sql import functions as F

from weft.llm import topk_search
from weft.llm.common import table
from weft.llm.queries import op10_topk_search


def brute(rows, k=5, every=50):
    vecs = {}
    for i, v in rows:
        if v is not None and i is not None and all(x is not None and math.isfinite(x) for x in v):
            vecs[i] = [math.floor(256 * float(x)) for x in v]
    out = []
    for q in vecs:
        if q % every == 0:
            found = sorted(((-sum(a * b for a, b in zip(vecs[q], v, strict=False)), i) for i, v in vecs.items() if i != q))[:k]
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(found)]
    return sorted(out)


def run(df, every=50):
    rows = df.select("vec_id", topk_search.quantised(F.col("embedding")).alias("v"))
    return sorted(tuple(r) for r in topk_search.top_k(rows, rows.filter(F.col("vec_id") % every == 0)).collect())


def test_whole_table(spark, sf_dir):
    got = sorted(tuple(r) for r in op10_topk_search(spark, sf_dir).collect())
    assert got == brute([tuple(r)[:2] for r in table(spark, sf_dir, "embeddings").collect()])


def test_odd_rows_and_ties(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [0.5, 0.5]), (50, [0.5]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (None, [1.0, 1.0]), (5, []), *((i, [0.25, 0.25]) for i in range(6, 20)), (100, [-1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert run(df) == brute(rows)
    assert run(df.limit(0)) == []
    assert run(df.union(df.filter("vec_id = 0"))) == brute(rows)
    assert run(df.filter("vec_id in (0, 50)")) == brute([rows[0], rows[1]])


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "QUERIES", 7)
    monkeypatch.setattr(topk_search, "_LANES", 3)
    df = spark.range(300).selectExpr("id as vec_id", "array(sin(id), cos(id * 3), if(id % 3 = 0, 0, sin(id * 7))) as embedding").repartition(5)
    assert run(df, 4) == brute([tuple(r) for r in df.collect()], every=4)


def test_copies_within_a_block_take_no_places(spark):
    """Copies of the best rows, also ones that differ by zeros at the end only, in one block."""
    rows = [(0, [1.0, 1.0]), *((i, [i / 8, 0.5]) for i in range(1, 12))]
    copies = rows + [(11, [11 / 8, 0.5])] * 30 + [(10, [10 / 8, 0.5] + [0.0] * n) for n in range(1, 8)]
    df = spark.createDataFrame(copies, "vec_id long, embedding array<double>").coalesce(1)
    assert run(df) == brute(rows) and len(brute(rows)) == 5
    assert run(df.filter("vec_id in (0, 10, 11)")) == brute([r for r in rows if r[0] in (0, 10, 11)])
