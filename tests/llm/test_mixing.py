from pyspark.sql import functions as F
import re
from collections import defaultdict

import pytest

from weft.llm import mixing
from weft.llm.common import table


def brute_targets(sizes):
    """Share by weight, cap, share the excess again, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=str) + [None] * (None in sizes)
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}
    total, target, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    return target


def check(rows, docs):
    sizes = defaultdict(int)
    for r in docs:
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    want = brute_targets(sizes)
    taken = defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-9)
        assert 0 <= r.taken <= 2 * r["size"]
        assert (r.position is None) == (r.taken == 0)
        taken[r.source] += r.taken
    for s, n in taken.items():
        assert want[s] - 1 - 1e-6 <= n <= want[s] + 1e-6
    return want


def test_whole_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = mixing.range_sorted(mixing.mix(docs)).collect()
    assert len(rows) == docs.count()
    check(rows, docs.collect())
    again = mixing.mix(docs.repartition(7))
    assert sorted(map(str, rows)) == sorted(map(str, again.collect()))
    places = [r.position for r in rows if r.position is not None]
    assert places == sorted(places)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    check(rows, odd_docs.collect())
    assert mixing.mix(no_docs).collect() == []
    blank = odd_docs.filter("doc_id in (2, 3, 4)")
    assert {(r.target, r.taken) for r in mixing.mix(blank).collect()} == {(0.0, 0)}


def test_materialised_words_are_those_taken(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, keep=docs.columns)
    out = mixing.materialise(mixed, docs.columns).collect()
    want = {r.doc_id: r.taken for r in mixed.collect()}
    got = defaultdict(int)
    for r in out:
        got[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert r.n_chars == len(r.text)
    assert dict(got) == {d: n for d, n in want.items() if n}


def test_schedule_is_inverted(spark):
    """At the position t of a word the integral of the schedule is the words before it."""
    docs = spark.createDataFrame([(i, "a b c d", s, 0) for s in "xyz" for i in range(50)], "doc_id long, text string, source string, n_chars long")
    for r in mixing.mix(docs).collect():
        slope = dict(zip("xyz", mixing.SLOPES, strict=True))[r.source]
        if r.position is not None:
            t = r.position
            assert r.target * (t + slope * (t * t - t)) == pytest.approx(min(r.before, r.target), abs=1e-6)


def test_materialised_order_follows_the_schedule(spark):
    """Every row of the training order, second passes too, stands where its source's
    schedule reaches its first word."""
    docs = spark.createDataFrame([(100 * i + k, f"a b c d{k}", s, 0) for k, s in enumerate("xyz") for i in range(60)], "doc_id long, text string, source string, n_chars long")
    mixed = mixing.mix(docs, keep=docs.columns)
    want = defaultdict(list)
    for r in mixed.collect():
        slope = dict(zip("xyz", mixing.SLOPES, strict=True))[r.source]
        for offset in range(r.before, int(r.target), r.source_size):
            low, high = 0.0, 1.0
            for _ in range(60):  # the integral of the schedule, inverted by bisection
                t = (low + high) / 2
                low, high = (t, high) if r.target * (t + slope * (t * t - t)) < offset else (low, t)
            want[r.doc_id].append(high)
    got = [r.doc_id for r in mixing.materialise(mixed, docs.columns).collect()]
    assert sorted(got) == sorted(d for d, times in want.items() for _ in times) and len(got) > len(want)
    places = [want[d].pop(0) for d in got]  # a document's passes come one after the other
    assert all(a <= b + 1e-6 for a, b in zip(places, places[1:], strict=False))


def test_a_cut_text_keeps_its_white_space(spark):
    text = "\n one  two\n\n\tthree\x0b\u00e9\u2003four five \n"
    df = spark.createDataFrame([(text, n) for n in range(1, 6)], "text string, n long")
    ends = [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    got = df.select("n", mixing.first_words(df.text, df.n).alias("cut")).collect()
    assert {r.n: r.cut for r in got} == {n: text[: ends[n - 1]] for n in range(1, 6)}
    long = spark.createDataFrame([("a\n" * 200_000, 150_000)], "text string, n long")
    assert long.select(mixing.first_words(long.text, long.n)).first()[0] == "a\n" * 149_999 + "a"


def test_taken_and_position_by_brute_force(spark, sf_dir):
    """Each source's documents in the order of their hash, words counted up one by one."""
    import math
    import re
    from collections import defaultdict

    docs = table(spark, sf_dir, "documents")
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    sources = defaultdict(list)
    for r in docs.select("doc_id", "source", "text", F.xxhash64("doc_id").alias("h")).collect():
        sources[r.source].append((r.h % 2**64, r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))))
    for rank, source in enumerate(sorted(sources, key=lambda s: (s is None, s))):
        whole = sum(n for *_, n in sources[source])
        slope, before = mixing.SLOPES[rank % 3], 0
        for _, doc_id, n in sorted(sources[source]):
            r = got[doc_id]
            taken = sum(max(0, min(n, math.floor(r.target) - before - k * whole)) for k in range(2))
            assert (r.size, r.source_size, r.before, r.taken) == (n, whole, before, taken)
            if taken:  # the demand up to the position is what came before
                t = r.position
                assert abs(r.target * (t + slope * (t * t - t)) - before) < 1e-6 * r.target
            else:
                assert r.position is None
            before += n


def test_number_of_ranges_changes_nothing(spark, sf_dir, monkeypatch):
    docs = table(spark, sf_dir, "documents")
    want = sorted(map(str, mixing.mix(docs).collect()))
    for n in (8, 4096):
        monkeypatch.setattr(mixing, "RANGES", n)
        assert sorted(map(str, mixing.mix(docs).collect())) == want


def test_rows_of_one_id_keep_their_places(spark):
    """Rows that share a null or repeated id and a size are told apart by their texts."""
    rows = [(d, f"a b c{k}", "x", 0) for d in (None, 7) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    places = [{(r.doc_id, r.kept.text): r.before for r in mixing.mix(docs.repartition(n, "text"), keep=["text"]).collect()} for n in (1, 5)]
    assert places[0] == places[1] and len(places[0]) == len(rows)
