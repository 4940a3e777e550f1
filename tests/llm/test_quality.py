import math
import re
from collections import Counter

import pytest

from weft.llm import quality
from weft.llm.common import table
from weft.llm.queries import op6_quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    dup, seen = 0, set()
    for x in lines:
        dup += x in seen
        seen.add(x)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_whole_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    rows = op6_quality(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, *rest = want = brute(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (n < 50 or 100 * rest[3] > 50 * n)
        assert not (r.base_failed and r.kept)


def test_verdicts_by_brute_force(spark, sf_dir):
    """Cutoffs and verdicts of the whole table, counted from the texts."""
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    good = Counter(r.doc_id for r in table(spark, sf_dir, "labels").filter("quality = 1").collect())
    facts = {}
    for i, text in docs:
        lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (text or "").split("\n"))
        facts[i] = dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), brute(text), strict=True)) | {"n_lines": lines}
    base = {i: f["n_words"] < 50 or 100 * f["n_repeat_words"] > 50 * f["n_words"] for i, f in facts.items()}
    ratio = lambda f, r: f[r.above] * r.per // f[r.below] if f[r.below] else 0
    band = lambda f: sum(f["n_words"] >= low for low in quality.STRATA[1:])
    alpha = (1 - quality.CONFIDENCE) / (len(quality.STRATA) * sum(len(r.grid) for r in quality.RULES))
    cut = {}
    for s in range(len(quality.STRATA)):
        held = [f for i, f in facts.items() for _ in range(good[i]) if not base[i] and band(f) == s]
        for r in quality.RULES:
            safe = [c for c in r.grid if quality.upper_bound(sum(ratio(f, r) > c for f in held), len(held), alpha) <= quality.RISK / len(quality.RULES)]
            if safe:
                cut[s, r.name] = min(safe)
    got = {r.doc_id: r.kept for r in op6_quality(spark, sf_dir).collect()}
    for i, f in facts.items():
        rejected = any(ratio(f, r) > cut.get((band(f), r.name), 1 << 60) for r in quality.RULES)
        assert got[i] == (not base[i] and not rejected)


def test_good_documents_stay(spark, sf_dir):
    good = {r.doc_id for r in table(spark, sf_dir, "labels").filter("quality = 1").collect()}
    rows = [r for r in op6_quality(spark, sf_dir).collect() if r.doc_id in good and not r.base_failed]
    assert sum(r.kept for r in rows) >= 0.97 * len(rows)


@pytest.mark.parametrize("k, n", [(0, 10), (3, 50), (49, 50), (5, 2000)])
def test_binomial_bound(k, n):
    p = quality.upper_bound(k, n, 0.05)
    tail = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    assert tail == pytest.approx(0.05, rel=1e-6)
    assert quality.upper_bound(n, n, 0.05) == 1.0 == quality.upper_bound(0, 0, 0.05)


def test_thresholds_hold_the_risk(spark):
    """Good documents with few symbols, bad ones with many: a cutoff lies between."""
    words = " ".join(f"w{i}" for i in range(100))
    rows = [(i, words + " #" * (i % 3)) for i in range(3000)] + [(i, words + " #" * 200) for i in range(3000, 3100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 3000)) for i in range(3100)], "doc_id long, quality int")
    measured = quality.measure(docs)
    found = quality.select_thresholds(measured, labels)
    kept = {r.doc_id for r in quality.judge(measured, found).filter("kept").collect()}
    assert kept == set(range(3000))
    none = quality.select_thresholds(measured, labels.filter("quality is null"))
    assert none.cut == {}


def test_odd_rows(spark, odd_docs, no_docs):
    rows = quality.judge(quality.measure(odd_docs), quality.Thresholds({}, 0)).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text)
    assert quality.measure(no_docs).collect() == []
    labels = spark.createDataFrame([(None, None), (5, 1), (5, 1)], "doc_id long, quality int")
    assert quality.select_thresholds(quality.measure(no_docs), labels).cut == {}
