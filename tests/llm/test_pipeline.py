import os
import re

import corpus_pipeline
from pyspark.sql import functions as F
from weft.llm.common import stored, table

from .test_ngram_join import brute


def test_stages_take_effect(spark, sf_dir):
    docs = before = stored(table(spark, sf_dir, "documents"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        kept[name] = (before, docs)
        if name != "tokens":
            assert docs.columns == before.columns
    before, after = kept["near_duplicates"]
    want = {c for _, _, c in brute([(r.doc_id, r.text) for r in before.collect()])}
    assert {r.doc_id for r in after.collect()} == want and after.count() == len(want)
    before, after = kept["quality"]
    for r in after.collect():
        assert len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) >= 50
    before, after = kept["mixture"]
    count = lambda df: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in df.collect())
    assert abs(count(after) - 1.5 * count(before)) <= 40
    assert kept["tokens"][1].count() == after.count()


def test_five_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "mixture", "tokens"]
    assert os.path.exists(corpus_pipeline.__file__)


def test_empty_and_odd_documents(spark, odd_docs, no_docs, sf_dir):
    clash = odd_docs.withColumns({c: F.lit(-7) for c in ("hash", "range", "inner", "before", "rank", "target", "taken", "position", "slope", "kept", "pass", "words")})
    assert {r["hash"] for r in corpus_pipeline.mixture(spark, clash, sf_dir).collect()} == {-7}
    for docs in (no_docs, odd_docs):
        for _, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, sf_dir))


def test_null_and_repeated_ids_are_not_copies(spark, no_docs, sf_dir):
    text = lambda s: " ".join(f"{s}{i}" for i in range(60))
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (None, text("c") + " x"), (3, text("c")), (7, text("d")), (7, text("e")), (7, text("e")), (8, text("d") + " x"), (9, ""), (9, " "), (9, text("f")), (None, ""), (None, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], no_docs.schema)
    got = sorted(((r.doc_id, (r.text or "").strip()) for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()), key=str)
    want = [(None, ""), (None, ""), (None, text("a")), (None, text("b")), (3, text("c")), (7, text("d")), (7, text("e")), (9, ""), (9, text("f"))]
    assert got == sorted(want, key=str)
