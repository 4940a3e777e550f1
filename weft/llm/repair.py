"""Token ids in grammar-compressed shards (Re-Pair), with random access.

Documents are range-partitioned and sorted by id, encoded with the ``tokenizers``
library, and written in shards of at most about ``SHARD`` ids. A shard repeatedly
replaces its most frequent pairs of ids by nonterminals: each round counts all
adjacent pairs, gives the most frequent ones a rule, and replaces their occurrences
from left to right, until no pair occurs ``LEAST`` times. A pair never spans two documents, so a document is a run of the
compressed sequence of its own. The shard stores the rules, the expansion length of
every nonterminal, and where each document starts in ids and in the sequence: any
document, or any id of it, is decoded without the rest.

Shard layout (little endian): ``magic 8s, version u4, docs u4, terminals u4, rules u4,
length u4, bits u4, ids u8``, then rules (2 x u4 each), expansion lengths (u4 each),
per-document starts in ids (docs + 1 u8) and in the sequence (docs + 1 u4), document
ids (i8) with a null mask (u1), and the sequence: the low 16 bits of each symbol (u2), then
a plane of packed bits for each further one of its ``bits``.

A file set is a Parquet folder with a row per shard (``part``, ``seq``, ``docs``,
``ids``, ``payload``): Spark commits it as a whole, so lost executors leave no partial
file, and any store that Spark writes will do.

Defined results: a null text is empty (its document holds only the end id); null
document ids come first; equal ids stand in the order of a hash of their texts, then of the texts.
"""

from __future__ import annotations

import json
import os
import struct
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm.bpe import read_model
from weft.llm.common import batched, held, parts_for, scratch, slices, tidy
from weft.llm.pieces import Cutter, Known, gather
from weft.llm.pieces import encode as encode_pieces

SHARD = 4_000_000  # ids after which a shard is closed
LEAST = 8  # occurrences that earn a rule
STEP = 4096  # rules that a round makes at most
_SLOTS = 18  # bits of the table of a round's rules
JOINED = 400  # pieces that the library takes as one text
_HEAD = struct.Struct("<8sIIIIIIQ")
_MAGIC = b"WEFTGRAM"

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


# ---- grammar -----------------------------------------------------------------------


def _one_round(seq: np.ndarray, last: np.ndarray, live: np.ndarray, first_new: int, rules: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Replace the most frequent pairs once: new sequence, its document ends, its live places,
    the rules. live: ascending places whose pair may be frequent; a pair of known symbols only
    ever loses occurrences, so one that is rare stays so. bits: of a symbol, 16 or 32; a pair is
    one number of twice as many."""
    none = np.zeros((0, 2), np.uint32)
    wide = np.uint32 if bits == 16 else np.uint64
    pair = seq[live].astype(wide)
    pair <<= wide(bits)
    pair |= seq[live + 1]
    order = np.sort(pair)
    # a pair is frequent if the number LEAST - 1 places on is the same
    far = LEAST - 1
    found = np.flatnonzero(order[far:] == order[: len(order) - far]) if len(order) > far else live[:0]
    if not len(found) or rules < 1:
        return seq, last, live[:0], none
    found = found[np.r_[True, order[found[1:]] != order[found[:-1]]]]
    often = order[found]
    times = np.searchsorted(order, often, "right") - found
    chosen = np.sort(often[np.argsort(-times, kind="stable")[:rules]])
    # a hash table without chains: pairs that meet in a slot wait for a later round
    bits_of, shift = (np.uint32(0x9E3779B1), np.uint32(32 - _SLOTS)) if wide is np.uint32 else (np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - _SLOTS))
    where = (chosen * bits_of) >> shift
    _, keep = np.unique(where, return_index=True)
    keep.sort()
    chosen, where = chosen[keep], where[keep]
    keys, value = np.full(1 << _SLOTS, wide(0)), np.full(1 << _SLOTS, -1, np.int32)
    keys[where], value[where] = chosen, np.arange(len(chosen))
    here = (pair * bits_of) >> shift
    rule = np.where(keys[here] == pair, value[here], -1)
    hit = np.flatnonzero(rule >= 0)
    spots, rule = live[hit], rule[hit]
    # overlapping hits: every second one of a run, from the left
    run_start = np.maximum.accumulate(np.where(np.r_[True, np.diff(spots) > 1], spots, 0))
    take = (spots - run_start) % 2 == 0
    spots, rule = spots[take], rule[take]
    # pairs whose every occurrence went to others get no rule
    used = np.zeros(len(chosen), bool)
    used[rule] = True
    number = np.cumsum(used) - 1
    seq[spots] = number[rule] + first_new
    last[spots] = last[spots + 1]
    kept = np.ones(len(seq), bool)
    kept[spots + 1] = False
    again = np.zeros(len(seq), bool)
    again[spots] = True
    again[spots[spots > 0] - 1] = True
    beside = spots[spots > 1]
    again[beside[~kept[beside - 1]] - 2] = True  # the symbol before was made just now
    if len(chosen) < len(often):  # the others are live still, and what shares a slot with them
        waits = np.zeros(1 << _SLOTS, bool)
        waits[(often[~np.isin(often, chosen, assume_unique=True)] * bits_of) >> shift] = True
        again[live[waits[here]]] = True
    seq, last, again = seq[kept], last[kept], again[kept]
    chosen = chosen[used]
    return seq, last, np.flatnonzero(again & ~last), np.stack([chosen >> wide(bits), chosen & wide((1 << bits) - 1)], 1).astype(np.uint32)


def compress(ids: np.ndarray, starts: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence, document starts in it, and rules (left, right); rule r makes ``terminals + r``.
    Rounds go on until no pair occurs ``LEAST`` times. Symbols are of 16 bits as long as
    rules find room there, then of 32."""
    bits = 16 if terminals <= (1 << 16) - 4096 else 32
    seq = ids.astype(np.uint16 if bits == 16 else np.uint32)
    last = np.zeros(len(seq), bool)
    last[starts[1:] - 1] = True
    live = np.flatnonzero(~last)
    made = [np.zeros((0, 2), np.uint32)]
    count = 0
    while True:
        free = (1 << bits) - terminals - count
        if not free and bits == 16:
            bits, seq = 32, seq.astype(np.uint32)
            continue
        seq, last, live, more = _one_round(seq, last, live, terminals + count, min(free, STEP), bits)
        if not len(more):
            break
        made.append(more)
        count += len(more)
    return seq, np.r_[0, np.flatnonzero(last) + 1], np.concatenate(made)


def lengths_of(rules: np.ndarray, terminals: int) -> np.ndarray:
    """Ids that each nonterminal expands to."""
    length = np.ones(terminals + len(rules), np.int64)
    for r, (a, b) in enumerate(rules.tolist()):
        length[terminals + r] = length[a] + length[b]
    return length[terminals:]


class Expansions:
    """Every symbol's expansion, laid out once in a table; output is gathered from it."""

    def __init__(self, rules: np.ndarray, lengths: np.ndarray, terminals: int):
        self.size = np.r_[np.ones(terminals, np.int64), lengths]
        self.begin = np.r_[np.arange(terminals), terminals + np.cumsum(lengths) - lengths]
        self.flat = np.empty(terminals + int(lengths.sum()), "<u4")
        self.flat[:terminals] = np.arange(terminals)
        done = np.ones(terminals + len(rules), bool)
        done[terminals:] = False
        left = np.arange(len(rules))
        while len(left):  # rules of rules: a pass for each level of nesting
            may = done[rules[left, 0]] & done[rules[left, 1]]
            ready, left = left[may], left[~may]
            for side in (0, 1):
                part = rules[ready, side]
                at = self.begin[terminals + ready] + (self.size[rules[ready, 0]] if side else 0)
                _copy(self.flat, at, self.flat, self.begin[part], self.size[part])
            done[terminals + ready] = True

    def expand(self, seq: np.ndarray) -> np.ndarray:
        n = self.size[seq]
        out = np.empty(int(n.sum()), "<u4")
        _copy(out, np.cumsum(n) - n, self.flat, self.begin[seq], n)
        return out


def _copy(to: np.ndarray, at: np.ndarray, source: np.ndarray, begin: np.ndarray, n: np.ndarray) -> None:
    """to[at + j] = source[begin + j] for j < n, for all rows: a gather for some rows at a time."""
    ends = np.cumsum(n)
    row = 0
    while row < len(n):
        done = int(ends[row - 1]) if row else 0
        stop = max(row + 1, int(np.searchsorted(ends, done + (1 << 20), "right")))
        own = n[row:stop]
        j = np.arange(int(ends[stop - 1]) - done) - np.repeat(ends[row:stop] - own - done, own)
        to[np.repeat(at[row:stop], own) + j] = source[np.repeat(begin[row:stop], own) + j]
        row = stop


# ---- shards ------------------------------------------------------------------------


def pack(doc_ids: list[int | None], ids: list[bytes], terminals: int) -> tuple[bytes, int]:
    """One shard's bytes, and how many ids it holds. ids: little-endian u4 of each document, not empty."""
    sizes = np.array([len(x) // 4 for x in ids], np.int64)
    starts = np.r_[0, np.cumsum(sizes)]
    flat = np.frombuffer(b"".join(ids), "<u4")
    terminals = max(terminals, int(flat.max()) + 1 if len(flat) else 0)
    seq, places, rules = compress(flat, starts, terminals)
    bits = max(16, (terminals + len(rules) - 1).bit_length())
    head = _HEAD.pack(_MAGIC, 2, len(ids), terminals, len(rules), len(seq), bits, len(flat))
    planes = [np.packbits((seq >> b) & 1).tobytes() for b in range(16, bits)]
    null = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([head, rules.astype("<u4").tobytes(), lengths_of(rules, terminals).astype("<u4").tobytes(), starts.astype("<u8").tobytes(), places.astype("<u4").tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), null.tobytes(), (seq & 0xFFFF).astype("<u2").tobytes(), *planes]), len(flat)


class Shard:
    """Random access to a packed shard."""

    def __init__(self, payload: bytes):
        magic, version, docs, self.terminals, n_rules, length, bits, self.n_ids = _HEAD.unpack_from(payload)
        if magic != _MAGIC or version != 2:
            raise ValueError("not a shard")
        at = _HEAD.size

        def take(n, kind):
            nonlocal at
            found = np.frombuffer(payload, kind, n, at)
            at += found.nbytes
            return found

        self.rules = take(2 * n_rules, "<u4").reshape(-1, 2).astype(np.int64)
        self.lengths = take(n_rules, "<u4").astype(np.int64)
        self.starts, self.places = take(docs + 1, "<u8").astype(np.int64), take(docs + 1, "<u4").astype(np.int64)
        keys, null = take(docs, "<i8"), take(docs, "u1")
        self.doc_ids = [None if z else int(k) for k, z in zip(keys, null, strict=True)]
        self.seq = take(length, "<u2")
        if bits > 16:
            self.seq = self.seq.astype("<u4")
        for b in range(16, bits):
            self.seq |= np.unpackbits(take(-(-length // 8), "u1"), count=length).astype("<u4") << np.uint32(b)

    @cached_property
    def table(self) -> Expansions:
        return Expansions(self.rules, self.lengths, self.terminals)

    def document(self, i: int) -> np.ndarray:
        return self.table.expand(self.seq[self.places[i] : self.places[i + 1]])

    def documents(self) -> list[bytes]:
        """Every document's ids, in little-endian u4; the sequence is expanded in one go."""
        flat = self.table.expand(self.seq)
        return [flat[a:b].tobytes() for a, b in zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True)]

    def id_at(self, i: int, k: int) -> int:
        """The k-th id of document i: the stored expansion lengths lead to it without expanding the rest."""
        own = self.seq[self.places[i] : self.places[i + 1]].astype(np.int64)
        size = np.where(own < self.terminals, 1, self.lengths[np.maximum(own - self.terminals, 0)] if len(self.lengths) else 1)
        ends = np.cumsum(size)
        if not 0 <= k < (int(ends[-1]) if len(ends) else 0):
            raise IndexError(k)
        j = int(np.searchsorted(ends, k, "right"))
        k -= int(ends[j] - size[j])
        symbol = int(own[j])
        while symbol >= self.terminals:
            left, right = self.rules[symbol - self.terminals].tolist()
            n = 1 if left < self.terminals else int(self.lengths[left - self.terminals])
            symbol, k = (left, k) if k < n else (right, k - n)
        return symbol


# ---- encoding with the library -----------------------------------------------------


class LibraryEncoder:
    """The library's ids of whole texts: it encodes the distinct pieces of a window of text,
    many at a time, and the ids of the texts are gathered from them."""

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(model)
        self.library.no_truncation()
        self.library.no_padding()
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.cutter, self.pieces = Cutter(json.loads(model), self.library), Known()

    def _ids(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, plain: np.ndarray, hard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Plain pieces go to the library joined by a blank, and where an id starts tells its
        piece; the others go one by one."""
        own = np.flatnonzero(plain)
        # pieces and a blank after each
        length = size[own] + 1
        ends = np.cumsum(length)
        text = np.full(int(ends[-1]) if len(own) else 0, 32, np.uint8)
        text[np.arange(len(text) - len(own)) + np.repeat(np.arange(len(own)), size[own])] = gather(data, begin[own], size[own])
        cuts = np.r_[np.arange(0, len(own), JOINED), len(own)]
        marks = np.r_[0, ends]
        made, count = [], np.zeros(len(begin), np.int64)
        parts = [text[marks[a] : marks[b]].tobytes().decode() for a, b in zip(cuts, cuts[1:], strict=False)]
        signs = np.r_[0, np.cumsum((text & 0xC0) != 0x80)][marks]  # the library counts characters
        for a, b, e in zip(cuts, cuts[1:], self.library.encode_batch(parts, add_special_tokens=False), strict=False):
            first = np.fromiter((x for x, _ in e.offsets), np.int64, len(e.ids)) + signs[a]
            count[own[a:b]] = np.diff(np.searchsorted(first, signs[a : b + 1]))
            made.append(np.array(e.ids, np.uint32))
        rest = np.flatnonzero(hard)
        for i, e in zip(rest, self.library.encode_batch([data[begin[i] : begin[i] + size[i]].tobytes().decode() for i in rest.tolist()], add_special_tokens=False), strict=True):
            count[i] = len(e.ids)
            made.append(np.array(e.ids, np.uint32))
        piece = np.concatenate([own, rest])
        ids = np.concatenate(made) if made else np.zeros(0, np.uint32)
        n = count[piece]
        order = np.argsort(piece, kind="stable")
        return gather(ids, (np.cumsum(n) - n)[order], n[order]), count

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin (and the end)."""
        return encode_pieces(texts, self.cutter, self.pieces, self._ids)


def _encoder(model: bytes) -> LibraryEncoder:
    return held(("library", model), lambda: LibraryEncoder(model.decode()))


# ---- files -------------------------------------------------------------------------


def write_shards(docs: DataFrame, path: str, model_path: str, end_id: int, key: str = "doc_id", text: str = "text", partitions: int | None = None) -> None:
    """Encode, append ``end_id`` to each document, and write shards in ascending order of key.
    Rows of one key are dealt by a hash of their text, so that one key may hold many."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(read_model(model_path))
    narrow = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    order = [F.asc_nulls_first("doc_id"), F.asc("hash")]
    dealt = narrow.withColumn("hash", F.xxhash64("text")).repartitionByRange(partitions or parts_for(narrow), *order).sortWithinPartitions(*order, F.asc_nulls_first("text"))
    end = np.uint32(end_id).astype("<u4").tobytes()

    def run(batches):
        part, own = TaskContext.get().partitionId(), _encoder(model.value)
        keys: list = []
        ids: list[bytes] = []
        held = seq = 0

        def out():
            payload, total = pack(keys, ids, own.size)
            row = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([total], pa.int64()), pa.array([payload], pa.binary())]
            return pa.RecordBatch.from_arrays(row, names=["part", "seq", "docs", "ids", "payload"])

        for big in batches:
            for batch in slices(big):
                flat, starts = own.encode(batch.column(1))
                raw = flat.astype("<u4").tobytes()
                for k, a, b in zip(batch.column(0).to_pylist(), (4 * starts[:-1]).tolist(), (4 * starts[1:]).tolist(), strict=True):
                    keys.append(k)
                    ids.append(raw[a:b] + end)
                    held += (b - a) // 4 + 1
                    if held >= SHARD:
                        yield out()
                        keys, ids, held, seq = [], [], 0, seq + 1
        if keys:
            yield out()
        tidy()

    batched(dealt.select("doc_id", "text")).mapInArrow(run, "part int, seq int, docs long, ids long, payload binary").write.parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, decoded from the shards: doc_id, start, ids (little-endian u4)."""
    files = spark.read.parquet(path)
    # a row per shard; their running total needs one order over all shards, not over documents
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = files.select("part", "seq", "ids").withColumn("offset", before).drop("ids")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                shard, offset = Shard(batch.column(0)[i].as_py()), batch.column(1)[i].as_py()
                every = shard.documents()
                for at in range(0, len(every), 2000):
                    ids = every[at : at + 2000]
                    yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids[at : at + 2000], pa.int64()), pa.array(shard.starts[at : at + len(ids)] + offset, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "ids"])
        tidy()

    # shards meet their offsets before they are decoded: what is shuffled is compressed
    joined = files.select("part", "seq", "payload").join(offsets, ["part", "seq"]).select("payload", "offset")
    return batched(joined).mapInArrow(run, "doc_id long, start long, ids binary")


def token_files(docs: DataFrame, model_path: str, end_id: int) -> DataFrame:
    """Write the file set to the shared folder and digest what is read back from it."""
    spark = docs.sparkSession
    path = scratch(spark)
    write_shards(docs, path, model_path, end_id)
    back = read_shards(spark, path)
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
