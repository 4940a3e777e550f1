import zlib

from weft.llm import toxicity
from weft.llm.common import table
from weft.llm.queries import op8_toxicity


def test_held_out_quality(spark):
    sf_dir = "/root/testdata/sf0.1"  # enough labels in each language
    labels = {r.doc_id: r.toxic for r in table(spark, sf_dir, "labels").collect()}
    rows = op8_toxicity(spark, sf_dir).collect()
    assert len(rows) == table(spark, sf_dir, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p for t, p in held if t) >= 0.85 * sum(t for t, _ in held)
    assert sum(p for t, p in held if not t) <= 0.01 * len(held)


def test_group_terms_do_not_move_the_score():
    """Toxic samples name one group more often; the penalty takes that group's weight away."""
    texts = ["the muslim baker is an idiot"] * 60 + ["the christian baker is an idiot"] * 20 + ["the muslim baker sells bread"] * 20 + ["the christian baker sells bread"] * 60
    labels = [1] * 80 + [0] * 80
    plain, fair = (toxicity.fit(texts, labels, [1.0] * 160, p).scorer() for p in (0.0, 20.0))
    gap = lambda s: abs(s("a muslim neighbour") - s("a christian neighbour"))
    assert gap(fair) < 0.5 * gap(plain)
    assert fair("you idiot") > 0.5 > fair("she sells bread")


def test_counterfactuals_of_the_table(spark):
    """The table's texts name no group; copies do. A group that stands in toxic texts alone
    gets less weight the more its swaps cost, and the other words keep theirs."""
    sf_dir = "/root/testdata/sf0.1"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels"), "doc_id").filter("length(text) < 20000").orderBy("doc_id").limit(1500).collect()
    texts, labels = [r.text for r in docs], [r.toxic for r in docs]
    assert toxicity.fit(texts, labels, [1.0] * len(texts)).twins > 3 * len(texts)
    told = [t + (" muslim" if y and i % 2 else "") for i, (t, y) in enumerate(zip(texts, labels, strict=True))]
    plain, fair = (toxicity.fit(told, labels, [1.0] * len(told), p) for p in (0.0, toxicity.SWAP_PENALTY))
    gap = lambda m: abs(m.weights.get("muslim", 0) - m.weights.get("christian", 0))
    assert gap(fair) < 0.3 * gap(plain) and gap(plain) > 0.5
    other = {f for f in plain.weights if f not in toxicity._KIND}
    assert sum(plain.weights[f] * fair.weights.get(f, 0) > 0 for f in other) > 0.95 * len(other)


def test_scores_against_brute_force(spark, sf_dir):
    """Every score of the query, from the model's weights and the text's words."""
    import math
    import re

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(~toxicity.held_out()).select("doc_id", "toxic"))
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.score(docs, model, keep=["doc_id"]).collect()}
    for r in docs.collect():
        words = set(re.findall(r"[^\W\d_]+", (r.text or "").lower()))
        parts = {f for w in words for f in [w, *(f"{w[:n]}~" for n in (4, 5, 6) if len(w) > n and w not in toxicity._KIND)]}
        z = model.intercept + sum(model.weights[f] for f in parts if f in model.weights)
        want = 0.0 if model.intercept == -math.inf else 1 / (1 + math.exp(-z))
        assert abs(got[r.doc_id][0] - want) < 1e-9 and got[r.doc_id][1] == int(got[r.doc_id][0] >= 0.3)


def test_training_on_odd_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (5, 1), (6, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    for docs in (odd_docs, no_docs):
        model = toxicity.train(docs, labels)
        assert all(0 <= r.score <= 1 for r in toxicity.score(odd_docs, model).collect())


def test_an_id_lends_one_text(spark):
    """Of the texts of a repeated id the least enters: more copies and later texts change nothing."""
    rows = [(i, f"good word{i % 3}" if i % 2 else f"nasty word{i % 3}") for i in range(60)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id long, toxic int")
    once = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    more = rows + [rows[0]] * 50 + [(1, f"zz nasty {k}") for k in range(50)]
    assert toxicity.train(spark.createDataFrame(more, "doc_id long, text string"), labels) == once


def test_odd_rows(spark, odd_docs, no_docs):
    model = toxicity.Model({"cat": 3.0}, -2.0)
    rows = toxicity.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.predicted == int("cat" in (r.text or "").lower()) for r in rows)
    assert toxicity.score(no_docs, model).collect() == []
    empty = toxicity.train(odd_docs, odd_docs.selectExpr("doc_id", "cast(null as int) as toxic"))
    assert {r.score for r in toxicity.score(odd_docs, empty).collect()} == {0.0}
