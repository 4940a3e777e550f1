"""BPE encoding and decoding with a pair occurrence index.

The vocabulary file (the ``tokenizers`` library's JSON) is read once by the driver and
shipped as a broadcast of known size. Texts are cut into pieces (:mod:`weft.llm.pieces`)
whose ids don't depend on their neighbours. The words of all pieces that a worker meets
for the first time are laid out in one array; an index maps each mergeable pair to all
its positions; the active ranks are applied in ascending order at all of their positions,
and the lists of the pairs that this touches are updated (:class:`PairIndex`).

Pieces that aren't plain go through the library's own normalizer and pre-tokenizer, as
the model file declares them. Texts are handled whole. Null is the empty text and has no
ids. Equal rows give equal results.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import batched, held, slices, tidy
from weft.llm.pieces import BYTE_SIGN, Cutter, Known, gather, raw_bytes
from weft.llm.pieces import encode as encode_pieces

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


class PairIndex:
    """Merges of one model, applied to many words at once.

    ``index`` below is the pair occurrence index: numbers (rank, position) in ascending order,
    so that the positions of a pair are one run of it, and its ranks ascend. In each pass every
    word applies its least active rank at all of that rank's positions in the word, from the
    left; entries of positions that this touches leave the index, and the pairs that it makes
    enter it. Words are independent, so none waits for another's ranks.
    """

    def __init__(self, vocab: dict[str, int], merges: list, word_end: str):
        self.vocab, self.word_end = vocab, word_end
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.made = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.width = max(vocab.values()) + 1
        self.rank: dict[int, int] = {}
        for r, (a, b, _) in enumerate(self.made):
            self.rank.setdefault(a * self.width + b, r)
        keys = np.array(sorted(self.rank), np.int64)
        self._table(keys, np.array([self.rank[k] for k in keys.tolist()], np.int64))
        self.new = np.array([c for *_, c in self.made], np.int32)
        # a rank whose product stands in a pair of a lower rank is applied one position at a time
        least = np.full(self.width, len(self.made), np.int64)
        for (a, b, _), r in zip(reversed(self.made), range(len(self.made) - 1, -1, -1), strict=True):
            least[a] = least[b] = r
        self.alone = least[self.new] < np.arange(len(self.made)) if self.made else np.zeros(0, bool)
        top = max([0, *(ord(t[0]) for t in vocab if t)]) + 1
        self.inner, self.final = np.full(top + 1, -1, np.int32), np.full(top + 1, -1, np.int32)
        for t, i in vocab.items():
            if len(t) == 1:
                self.inner[ord(t)] = i
            if len(t) == 1 + len(word_end) and t.endswith(word_end):
                self.final[ord(t[0])] = i

    def _table(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """A hash table of pairs with chains of at most a few slots."""
        self.bits = max(4, int(len(keys)).bit_length() + 2)
        slots = 1 << self.bits
        self.slot_key, self.slot_rank = np.full(slots, -1, np.int64), np.full(slots, -1, np.int64)
        at, left = self._slot(keys), np.arange(len(keys))
        self.chain = 0
        while len(left):
            self.chain += 1
            free = left[self.slot_key[at[left]] < 0]
            self.slot_key[at[free]] = keys[free]  # of those that meet, the last one stays
            self.slot_rank[at[free]] = ranks[free]
            left = left[self.slot_key[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & (slots - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, -1 if it has none."""
        keys = left.astype(np.int64) * self.width + right
        at = self._slot(keys)
        here = self.slot_key[at]
        out = np.where(here == keys, self.slot_rank[at], -1)
        seek = np.flatnonzero((here != keys) & (here >= 0))
        for _ in range(self.chain - 1):
            if not len(seek):
                break
            at[seek] = (at[seek] + 1) & (len(self.slot_key) - 1)
            here = self.slot_key[at[seek]]
            hit = here == keys[seek]
            out[seek[hit]] = self.slot_rank[at[seek[hit]]]
            seek = seek[~hit & (here >= 0)]
        return out

    def symbols(self, letters: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words given as code points, and each word's length; letters that
        the vocabulary lacks are left out, as by the library without an unknown token."""
        letters = np.minimum(letters, len(self.inner) - 1)
        sym = self.inner[letters]
        ends = (begin + size - 1)[size > 0]
        sym[ends] = self.final[letters[ends]]
        if (sym >= 0).all():
            return sym, size
        word = np.repeat(np.arange(len(size)), size)[sym >= 0]
        return sym[sym >= 0], np.bincount(word, minlength=len(size))

    def encode(self, letters: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many of each. letters: the words' code points in a row."""
        size = size.astype(np.int64)
        sym, size = self.symbols(letters, np.cumsum(size) - size, size)
        sym = sym.copy()
        n, words = len(sym), len(size)
        word = np.repeat(np.arange(words, dtype=np.int32), size)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        ends = np.cumsum(size)[size > 0]
        after[ends - 1] = -1
        before[(ends - size[size > 0])] = -1

        def entries(at: np.ndarray) -> np.ndarray:
            at = at[after[at] >= 0]
            ranks = self.ranks_of(sym[at], sym[after[at]])
            return ((ranks << 32) | at)[ranks >= 0]

        index = np.sort(entries(np.arange(n)))
        least = np.zeros(words, np.int64)
        touched = np.zeros(n, bool)
        while len(index):
            rank, at = index >> 32, index & 0xFFFFFFFF
            own = word[at]
            least[own[::-1]] = rank[::-1]  # ranks ascend, so the first one of a word is written last
            active = rank == least[own]
            hits, ranks = at[active], rank[active]
            order = np.argsort(hits, kind="stable")
            hits, ranks = hits[order], ranks[order]
            # overlapping positions of one pair: every second one of a run, from the left
            joined = np.r_[False, after[hits[:-1]] == hits[1:]]
            run = np.maximum.accumulate(np.where(joined, 0, np.arange(len(hits))))
            take = (np.arange(len(hits)) - run) % 2 == 0
            alone = self.alone[ranks]
            if alone.any():
                take &= ~alone | np.r_[True, word[hits[1:]] != word[hits[:-1]]]
            hits, ranks = hits[take], ranks[take]
            gone = after[hits]
            sym[hits], sym[gone] = self.new[ranks], -1
            far = after[gone]
            after[hits] = far
            before[far[far >= 0]] = hits[far >= 0]
            near = before[hits]
            near = near[near >= 0]
            touched[hits] = touched[gone] = True
            near = near[~touched[near]]  # others are hits themselves
            touched[near] = True
            index = index[~touched[at]]
            touched[hits] = touched[gone] = touched[near] = False
            index = np.sort(np.concatenate([index, entries(hits), entries(near)]))
        alive = sym >= 0
        return sym[alive].astype(np.uint32), np.bincount(word[alive], minlength=words)


class Codec:
    """Encodes and decodes whole texts as the library's model file does."""

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        spec = json.loads(model)
        if spec["model"]["type"] != "BPE" or spec["model"].get("dropout") or spec["model"].get("unk_token") or spec["model"].get("continuing_subword_prefix") or spec["model"].get("ignore_merges"):
            raise ValueError("a plain BPE model is needed")
        self.library = Tokenizer.from_str(model)
        self.library.no_truncation()
        self.library.no_padding()
        self.index = PairIndex(spec["model"]["vocab"], spec["model"]["merges"], spec["model"].get("end_of_word_suffix") or "")
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec.get("added_tokens", ())):
            raise ValueError("added tokens must stand in the raw text")
        self.added = added
        self.splits = re.compile("(" + "|".join(re.escape(a) for a in sorted(added, key=lambda a: (-len(a), a))) + ")") if added else None
        self.cutter, self.pieces = Cutter(spec, self.library), Known()
        width = max([*spec["model"]["vocab"].values(), *added.values()]) + 1
        tokens: list[str | None] = [None] * width
        for t, i in (*spec["model"]["vocab"].items(), *added.items()):
            tokens[i] = t
        self.tokens = pa.array(tokens, pa.string())
        self.known = np.array([t is not None for t in tokens])
        self.joined = spec.get("decoder") is None

    def _hard(self, pieces: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The pre-tokenizer's words of pieces, how many each has, and ids of those that are
        added tokens (-1 for words)."""
        normal, split = self.library.normalizer, self.library.pre_tokenizer
        words: list[str] = []
        fixed: list[int] = []
        counts = []
        for piece in pieces:
            before = len(words)
            for p in self.splits.split(piece) if self.splits else [piece]:
                if p in self.added:
                    words.append("")
                    fixed.append(self.added[p])
                elif p:
                    p = normal.normalize_str(p) if normal else p
                    own = [w for w, _ in split.pre_tokenize_str(p)] if split else [p]
                    words += own
                    fixed += [-1] * len(own)
            counts.append(len(words) - before)
        return words, np.array(counts, np.int64), np.array(fixed, np.int64)

    def _ids(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, plain: np.ndarray, hard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces: plain ones are words, the others hold several."""
        own = np.flatnonzero(plain)
        letters = BYTE_SIGN[gather(data, begin[own], size[own])]
        rest = np.flatnonzero(hard)
        words, counts, fixed = self._hard([data[begin[i] : begin[i] + size[i]].tobytes().decode() for i in rest.tolist()])
        more = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        lengths = np.concatenate([size[own], np.array([len(w) for w in words], np.int64)])
        ids, n = self.index.encode(np.concatenate([letters, more]), lengths)
        if len(fixed):
            at = np.flatnonzero(fixed >= 0)
            place = (np.cumsum(n) - n)[len(own) + at]
            ids = np.insert(ids, place, fixed[at])
            n[len(own) + at] = 1
        # words to pieces, and pieces in their own order
        piece = np.concatenate([own, np.repeat(rest, counts)])
        count = np.zeros(len(begin), np.int64)
        np.add.at(count, piece, n)
        order = np.argsort(piece, kind="stable")
        return gather(ids, (np.cumsum(n) - n)[order], n[order]), count

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin (and the end)."""
        return encode_pieces(texts, self.cutter, self.pieces, self._ids)

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> pa.Array:
        """Texts, as the library's decode(ids, skip_special_tokens=False) of each."""
        if not self.joined:
            return pa.array([self.library.decode(ids[a:b].tolist(), skip_special_tokens=False) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)], pa.large_string())
        known = ids < len(self.known)
        known[known] = self.known[ids[known]]
        if not known.all():  # the library leaves out ids that it doesn't know
            starts = np.r_[0, np.cumsum(known)][starts]
            ids = ids[known]
        lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), self.tokens.take(pa.array(ids)))
        return pc.binary_join(lists, " ")


def codec(model: bytes) -> Codec:
    """One per worker process and model."""
    return held(("bpe", model), lambda: Codec(model.decode()))


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:  # a file of the installation, read by the driver alone
        return f.read()


def binaries(flat: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A binary column of each row's ids as little-endian unsigned 32-bit integers."""
    return pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(4 * starts.astype(np.int64)), pa.py_buffer(flat.astype("<u4"))]).cast(pa.binary())


def encode(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the ids of each row's text as a binary column of little-endian unsigned 32-bit integers."""
    return _mapped(df, model_path, text, ids, "binary", lambda c, column: binaries(*c.encode(column)))


def decode(df: DataFrame, model_path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Adds the decoded text of a binary column of ids; null is empty."""

    def step(c: Codec, column: pa.Array) -> pa.Array:
        flat, starts = raw_bytes(column)
        return c.decode(flat.view("<u4"), starts // 4)

    return _mapped(df, model_path, ids, text, "string", step)


def _mapped(df, model_path, source, target, kind, step):
    from pyspark.sql.types import BinaryType, StringType, StructField, StructType

    model = df.sparkSession.sparkContext.broadcast(read_model(model_path))
    kept = [f for f in df.schema.fields if f.name.lower() != target.lower()]
    ahead = df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{source}`").alias("__in"))
    schema = StructType([*kept, StructField(target, BinaryType() if kind == "binary" else StringType())])

    def run(batches):
        own = codec(model.value)
        for big in batches:
            for batch in slices(big):
                made = step(own, batch.column(batch.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=[*batch.schema.names[:-1], target])
        tidy()

    return batched(ahead).mapInArrow(run, schema)


def _digests(raw: memoryview, starts: list[int]) -> pa.Array:
    return pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(starts, starts[1:], strict=False)], pa.string())


def round_trip(df: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: the number of ids, and digests of the ids and of the text decoded from them."""
    model = df.sparkSession.sparkContext.broadcast(read_model(model_path))
    ahead = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches):
        own = codec(model.value)
        for big in batches:
            for batch in slices(big):
                ids, starts = own.encode(batch.column(1))
                plain, at = raw_bytes(own.decode(ids, starts))
                columns = [batch.column(0), pa.array(np.diff(starts), pa.int64()), _digests(memoryview(ids.astype("<u4")).cast("B"), (4 * starts).tolist()), _digests(memoryview(plain), at.tolist())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        tidy()

    return batched(ahead).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
