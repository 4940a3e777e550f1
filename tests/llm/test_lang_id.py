import math
import zlib

import pytest

from weft.llm import lang_id
from weft.llm.common import table
from weft.llm.queries import op2_language_id


def naive_phrases(text, sample):
    """Longest phrases of the text that occur in the sample, lane by lane."""
    codes, sample = lang_id.classes_of(text).tolist(), lang_id.classes_of(sample).tolist()
    inside = {tuple(sample[i:j]) for i in range(len(sample)) for j in range(i + 1, min(len(sample), i + 12) + 1)}
    n = 0
    for at in range(0, len(codes), lang_id.LANE):
        lane, i = codes[at : at + lang_id.LANE], 0
        while i < len(lane):
            j = i + 1
            while j < len(lane) and tuple(lane[i : j + 1]) in inside:
                j += 1
            n, i = n + 1, j
    return n


def test_phrases_are_the_longest_matches():
    samples = {"a": "hello world, hold the hell", "b": "und der hund bellt"}
    model = lang_id.Model(samples)
    import numpy as np

    for text in ("hold the world und bellt zzz", "x", "Hello", "der hund der hund" * 90):
        codes = model.column[lang_id.classes_of(text)].astype(np.int64)
        parts = [codes[i : i + lang_id.LANE] for i in range(0, len(codes), lang_id.LANE)]
        sizes = np.array([len(p) for p in parts])
        lanes = np.zeros((lang_id.LANE, len(parts)), np.int64)
        for j, p in enumerate(parts):
            lanes[: len(p), j] = p
        got = model.phrases(lanes, sizes).sum(1).tolist()
        assert got == [naive_phrases(text, samples[k]) for k in ("a", "b")]


def longest_matches(lane: bytes, sample: bytes) -> int:
    """Phrases of a lane: each the longest that the sample holds, found by plain search."""
    n = i = 0
    while i < len(lane):
        at, j = sample.find(lane[i : i + 1]), i + 1
        while at >= 0 and j < len(lane) and (more := sample.find(lane[i : j + 1], at)) >= 0:
            at, j = more, j + 1
        n, i = n + 1, j
    return n


def test_predictions_by_brute_force(spark, sf_dir):
    """Language and score of every document, from plain substring searches in the samples."""
    docs = table(spark, sf_dir, "documents")
    samples = {k: lang_id.classes_of(v).tobytes() for k, v in lang_id.samples_of(docs.filter(~lang_id.held_out())).items()}
    got = {r.doc_id: r for r in op2_language_id(spark, sf_dir).collect()}
    for r in docs.collect():
        codes = lang_id.classes_of(r.text or "").tobytes()
        if not any(codes):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        lanes = [codes[i : i + lang_id.LANE] for i in range(0, len(codes), lang_id.LANE)]
        bits = {k: sum(longest_matches(x, v) for x in lanes) * math.log2(max(2, len(v))) / len(codes) for k, v in samples.items()}
        best = min(bits, key=lambda k: (bits[k], k))
        score = 1 / sum(2 ** ((bits[best] - b) * min(len(codes), lang_id.EVIDENCE)) for b in bits.values())
        assert got[r.doc_id].lang_pred == best and got[r.doc_id].score == pytest.approx(score, rel=1e-9)


def test_held_out_accuracy(spark, sf_dir):
    docs = {r.doc_id: r.lang for r in table(spark, sf_dir, "documents").collect()}
    rows = op2_language_id(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang_pred == docs[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark, odd_docs, no_docs):
    samples = {"en": "the cat sat on the mat " * 20, "de": "der hund und die katze " * 20}
    rows = lang_id.identify(odd_docs, samples).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters)
        assert 0 <= r.score <= 1 and (letters or r.score == 0)
    assert lang_id.samples_of(no_docs) == {}
    assert {r.lang_pred for r in lang_id.identify(odd_docs, {}).collect()} == {"und"}
    assert lang_id.identify(no_docs, samples).count() == 0


def test_samples_are_bounded(spark, odd_docs):
    samples = lang_id.samples_of(odd_docs)
    assert set(samples) == {"en", "fr", "de"}
    assert all(len(s) <= lang_id.SAMPLE_CHARS + lang_id.SAMPLE_TEXT for s in samples.values())


def test_samples_of_shared_keys(spark, monkeypatch):
    """Rows that share a null or repeated id are sampled like any others, copies once."""
    monkeypatch.setattr(lang_id, "SAMPLE_CHARS", 400)
    monkeypatch.setattr(lang_id, "SAMPLE_TEXT", 100)
    rows = [(None, f"some words of text {k}", "en") for k in range(3000)] + [(5, f"noch ein paar worte {k % 2}", "de") for k in range(3000)]
    samples = lang_id.samples_of(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert 300 <= len(samples["en"]) <= 500
    lines = samples.get("de", "").split("\n")
    assert len(lines) == len(set(lines)) <= 2


@pytest.mark.parametrize("text", ["a b", "A  B", "a\n\n\tb", "a1 2b"])
def test_breaks_count_once(text):
    assert lang_id.classes_of(text).tolist() == lang_id.classes_of("a b").tolist()
