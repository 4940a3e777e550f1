import hashlib
import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from weft.llm import bpe, pieces, repair
from weft.llm.common import table
from weft.llm.pieces import PLAIN_BYTES
from weft.llm.queries import END_ID, model_path, op4_token_files, op5_bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(model_path())


def le(ids):
    return np.array(ids, "<u4").tobytes()


def test_op5_against_the_library(spark, sf_dir, library):
    docs = table(spark, sf_dir, "documents").collect()
    got = {r.doc_id: r for r in op5_bpe(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(le(ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op4_against_the_library(spark, sf_dir, library):
    docs = sorted(table(spark, sf_dir, "documents").collect(), key=lambda d: d.doc_id)
    got = sorted(op4_token_files(spark, sf_dir).collect(), key=lambda r: r.doc_id)
    start = 0
    for d, r in zip(docs, got, strict=True):
        ids = [*library.encode(d.text or "", add_special_tokens=False).ids, END_ID]
        assert tuple(r) == (d.doc_id, start, len(ids), zlib.crc32(le(ids)))
        start += len(ids)


def fuzz(n, seed):
    rng = random.Random(seed)
    letters = [*"ab's </|>!?é́ñ中ª1²ΣİIͅ \t\n  \x1c", "<|endoftext|>", "'ll", "the", "tion"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def rows_of(made):
    ids, starts = made
    return [ids[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)]


def test_both_encoders_on_odd_texts(library, monkeypatch):
    with open(model_path()) as f:
        model = f.read()
    texts = fuzz(4000, 3) + [None, "", "a" * 5000, "'" * 300, "\x85 \x1f", "ǅ ŉ ß ſ ǆ Ⴀ я Ё ё̈ א", "word " * 3000]
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    plain = library.decode_batch(want, skip_special_tokens=False)
    column = pa.array(texts)
    for window, kept in ((pieces.WINDOW, pieces.KEPT), (100, 4000)):
        monkeypatch.setattr(pieces, "WINDOW", window)
        own, other = bpe.Codec(model), repair.LibraryEncoder(model)
        own.pieces, other.pieces = pieces.Known(kept), pieces.Known(kept)
        for _ in range(2):  # the second time from what is known
            assert rows_of(own.encode(column)) == want and rows_of(other.encode(column)) == want
        assert rows_of(own.encode(column.slice(7, 1000))) == want[7:1007]
        assert own.pieces.young[0].nbytes <= 2 * kept + 100_000
        assert own.decode(*own.encode(column)).to_pylist() == plain
    assert own.decode(np.array([3, 1 << 20, 320], np.uint32), np.array([0, 3])).to_pylist() == [library.decode([3, 1 << 20, 320], skip_special_tokens=False)]


def other_models(library):
    """Another added token; a pre-tokenizer of other rules; one that keeps white space."""
    spec = json.loads(library.to_str())
    spec["added_tokens"].append(spec["added_tokens"][0] | {"id": 49408, "content": "[CLS]"})
    yield spec
    spec = json.loads(library.to_str())
    spec["normalizer"], spec["pre_tokenizer"] = {"type": "Lowercase"}, {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, PLAIN_BYTES]}
    yield spec
    with open(model_path("byte_bpe_50k.json")) as f:
        yield json.load(f)


def test_other_models(library):
    texts = [t and t.replace("<|", "[CLS]") for t in fuzz(800, 5)] + ["a[CLS]b [cls] Hi, world\n\n  it's  é", None, ""]
    for spec in other_models(library):
        model = json.dumps(spec)
        known = Tokenizer.from_str(model)
        want = [e.ids for e in known.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        own = bpe.Codec(model)
        assert rows_of(own.encode(pa.array(texts))) == want
        assert rows_of(repair.LibraryEncoder(model).encode(pa.array(texts))) == want
        assert own.decode(*own.encode(pa.array(texts))).to_pylist() == known.decode_batch(want, skip_special_tokens=False)


def naive_bpe(vocab, merges, word):
    rank = {(a, b): r for r, (a, b) in reversed(list(enumerate(merges)))}
    symbols = [c for c in word if c in vocab]
    while True:
        found = [(rank[p], i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in rank]
        if not found:
            return [vocab[s] for s in symbols]
        _, i = min(found)
        symbols[i : i + 2] = ["".join(symbols[i : i + 2])]


def test_pair_index_where_a_merge_makes_a_lower_rank():
    """Two ways to one symbol: a late merge makes a pair of an early rank."""
    vocab = {s: i for i, s in enumerate(["a", "b", "c", "ab", "abc", "bc", "abca", "aa", "aab"])}
    merges = [["ab", "c"], ["abc", "a"], ["b", "c"], ["a", "bc"], ["a", "b"], ["a", "a"], ["aa", "b"]]
    index = bpe.PairIndex(vocab, merges, "")
    rng = random.Random(1)
    words = ["".join(rng.choice("abcx") for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    ids, count = index.encode(np.array([ord(c) for w in words for c in w]), np.array([len(w) for w in words]))
    assert rows_of((ids, np.r_[0, np.cumsum(count)])) == [naive_bpe(vocab, merges, w) for w in words]
    assert index.alone.any()


def test_odd_rows(spark, odd_docs, no_docs, library):
    want = {}
    for r in odd_docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = len(ids)
    rows = bpe.round_trip(odd_docs, model_path()).collect()
    assert len(rows) == odd_docs.count() and all(want[r.doc_id] == r.n_tokens for r in rows)
    rows = repair.token_files(odd_docs, model_path(), END_ID).collect()
    assert len(rows) == odd_docs.count() and all(want[r.doc_id] + 1 == r.n_tokens for r in rows)
    order = sorted(rows, key=lambda r: r.start)
    assert [r.start for r in order] == [sum(r.n_tokens for r in order[:i]) for i in range(len(order))]
    assert [r.doc_id for r in order] == sorted((r.doc_id for r in order), key=lambda d: (d is not None, d))
    assert bpe.round_trip(no_docs, model_path()).collect() == []
    assert repair.token_files(no_docs, model_path(), END_ID).collect() == []


def test_columns_round_trip(spark, odd_docs, library):
    kept = bpe.encode(odd_docs.withColumnRenamed("size", "ids"), model_path())
    rows = bpe.decode(kept, model_path(), text="plain").collect()
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.plain == library.decode(ids, skip_special_tokens=False) and r.score == "mine"


@pytest.mark.parametrize("terminals", [50, 49408, 70000])
def test_shard_round_trip(terminals):
    rng = np.random.default_rng(terminals)
    docs = [rng.integers(0, 50, size=n).astype("<u4") for n in (1, 3000, 2, 500)] + [np.full(999, 7, "<u4")]
    docs += [docs[1]] * 3 + [rng.integers(0, terminals, size=200).astype("<u4")]
    payload, total = repair.pack([5, None, *range(len(docs) - 2)], [d.tobytes() for d in docs], terminals)
    shard = repair.Shard(payload)
    assert total == sum(map(len, docs)) and shard.doc_ids[:2] == [5, None]
    assert shard.documents() == [d.tobytes() for d in docs]
    for i, d in enumerate(docs):
        assert shard.document(i).tobytes() == d.tobytes()
        for k in rng.integers(0, len(d), 20).tolist():
            assert shard.id_at(i, k) == d[k]
    assert len(shard.rules) and len(shard.seq) < total
    with pytest.raises(IndexError):
        shard.id_at(0, 1)


@pytest.mark.parametrize("terminals", [2000, 65000])
def test_grammar_goes_on_until_no_pair_is_frequent(terminals, monkeypatch):
    """Long passages of many copies, and more rules than 16 bits have room for."""
    monkeypatch.setattr(repair, "STEP", 64)
    rng = np.random.default_rng(1)
    passages = [rng.integers(0, 2000, 700) for _ in range(3)]
    docs = [np.r_[passages[i % 3], rng.integers(0, 40, 200)].astype("<u4") for i in range(60)]
    starts = np.r_[0, np.cumsum([len(d) for d in docs])]
    seq, places, rules = repair.compress(np.concatenate(docs), starts, terminals)
    inner = np.ones(len(seq) - 1, bool)
    inner[places[1:-1] - 1] = False
    pairs, times = np.unique(np.stack([seq[:-1], seq[1:]], 1)[inner], axis=0, return_counts=True)
    # overlapping occurrences of a run of one symbol count as well
    assert times[pairs[:, 0] != pairs[:, 1]].max(initial=0) < repair.LEAST
    assert max(repair.lengths_of(rules, terminals)) > 100 and len(places) == len(docs) + 1
    payload, _ = repair.pack(list(range(60)), [d.tobytes() for d in docs], terminals)
    shard = repair.Shard(payload)
    assert shard.documents() == [d.tobytes() for d in docs]
    assert [shard.id_at(5, k) for k in range(0, 900, 50)] == docs[5][::50].tolist()


def test_rules_beyond_16_bits(monkeypatch):
    monkeypatch.setattr(repair, "STEP", 1000)
    rng = np.random.default_rng(2)
    doc = rng.integers(0, 120, 200_000).astype("<u4")
    payload, _ = repair.pack([1], [doc.tobytes()], (1 << 16) - 4096)
    shard = repair.Shard(payload)
    assert len(shard.rules) > 4096 and shard.seq.dtype == np.dtype("<u4")
    assert shard.documents() == [doc.tobytes()]
