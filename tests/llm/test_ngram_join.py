import random
import re

from weft.llm import ngram_join
from weft.llm.common import table


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < 5 else (tuple(words[i : i + 5]) for i in range(len(words) - 4)))


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 75 * (len(a) + len(b) - both):
                    parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i))) for i, (d, s) in enumerate(sets)), key=str)


def run(df):
    return sorted((tuple(r) for r in ngram_join.similar_components(df).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def test_whole_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    assert run(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_families_around_the_threshold(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(60)]
    rows = []
    for _ in range(40):
        base = [word() for _ in range(rng.choice([3, 5, 7, 8, 9, 12, 20, 40, 80, 150, 300]))]
        if rng.random() < 0.5:
            base = base + passage
        for _ in range(rng.randrange(1, 9)):
            own = list(base)
            for _ in range(rng.randrange(0, 2 + len(own) // 30)):
                at = rng.randrange(len(own))
                own[at : at + rng.randrange(0, 3)] = [word() for _ in range(rng.randrange(0, 3))] or [word()]
            rows.append((len(rows) * 7 % 1009, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert run(df) == brute(rows)


def test_cut_groups(spark, monkeypatch):
    """Groups of many blocks and parts, lists of few places: the same links."""
    monkeypatch.setattr(ngram_join, "BLOCK", 60)
    monkeypatch.setattr(ngram_join, "PART", 150)
    monkeypatch.setattr(ngram_join, "PLACES", 2)
    monkeypatch.setattr(ngram_join, "SALTS", 3)
    rng = random.Random(8)
    rows = []
    for _ in range(3):
        base = [f"w{rng.randrange(900)}" for _ in range(60)]
        for k in range(25):
            own = list(base)
            for at in rng.sample(range(60), rng.choice([0, 1, 1, 2, 3])):
                own[at] = f"n{rng.randrange(3)}"
            rows.append((len(rows), " ".join(own)))
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    got = run(odd_docs)
    assert got == brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert run(no_docs) == []


def test_short_sets_use_the_prefix(spark, monkeypatch):
    """With plans that leave every set without units, only the prefix filter is left."""
    monkeypatch.setattr(ngram_join, "plan_of", lambda b: ngram_join.Plan(3 << b, (3 << b + 1) - 1, 1, 0))
    rng = random.Random(6)
    texts = [[f"w{rng.randrange(500)}" for _ in range(40)] for _ in range(10)]
    rows = []
    for t in texts:
        for k in range(4):
            own = list(t)
            own[rng.randrange(40)] = f"n{k}"
            rows.append((len(rows), " ".join(own)))
    import numpy as np

    elements, starts = ngram_join.sets_of([t for _, t in rows])
    made = ngram_join.signatures(elements, starts, ngram_join.nodes_of(elements, starts))
    owners = {}
    for sig, node in zip(made["sig"].tolist(), made["node"].tolist(), strict=True):
        owners.setdefault(sig, set()).add(node)
    nodes = ngram_join.nodes_of(elements, starts)
    for i in range(len(rows)):
        for j in range(i):
            a, b = (elements[starts[x] : starts[x + 1]] for x in (i, j))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 75 * (len(a) + len(b) - both) and nodes[i] != nodes[j]:
                assert any({nodes[i], nodes[j]} <= o for o in owners.values())


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "node long, hub long")
    got = {r.node: r.comp for r in ngram_join.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_batches_of_few_words():
    """Single documents of less than a shingle, each a batch of its own."""
    for text in (None, "", "one", "one two", "one two three", "one two three four", "a b c d e"):
        elements, starts = ngram_join.sets_of([text])
        together, places = ngram_join.sets_of(["x " * 20, text])
        assert starts.tolist() == [0, len(shingles(text))]
        assert elements.tolist() == together[places[1] :].tolist()
