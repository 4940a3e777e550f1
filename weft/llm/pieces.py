"""Distinct pieces of a batch of texts, and ids gathered back from them.

Tokens of a model that drops white space never span it, and its pre-tokenizer breaks
plain ASCII at changes between letters, digits and other signs. So a column of texts is
cut where it lies, as bytes: a run of white space, a run of letters (ASCII, and those of
two bytes that the library treats alike) or of other signs, and a digit are pieces; a part
between white space that holds anything else (further scripts, apostrophes, control
characters, the first sign of an added token) is one piece that only the library may split. Arrow numbers the distinct pieces, the
caller encodes those it doesn't know yet, and ids are gathered by number. Texts are taken in
windows that end at white space, so memory follows the window and not the longest text;
what is remembered from window to window is bounded by bytes.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WINDOW = 4 << 20  # bytes of text that are cut at once
KEPT = 64 << 20  # bytes of pieces and ids that a worker remembers
_WHITE, _LETTER, _DIGIT, _OTHER, _HARD = range(5)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The character that a byte-level pre-tokenizer writes for a byte.
BYTE_SIGN = np.arange(256)
_UNSEEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
BYTE_SIGN[_UNSEEN] = 256 + np.arange(len(_UNSEEN))

#: The normalizer and the pre-tokenizer, as the model file declares them, for
#: which the rule above holds.
PLAIN_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PLAIN_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
PLAIN_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


class Cutter:
    """Cuts texts for one model. spec: the model file; library: its tokenizer."""

    def __init__(self, spec: dict, library):
        added = [t["content"] for t in spec.get("added_tokens", ())]
        kind = np.full(256, _HARD, np.uint8)
        self.pairs = None  # kinds of letters of two bytes, and their lower case
        if not _parts_at_space(library) or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", ())) or any(c.isspace() for t in added for c in t):
            self.kind = None  # the model sees white space: a text is one piece
            return
        kind[[9, 10, 11, 12, 13, 32]] = _WHITE
        split = {"type": "Sequence", "pretokenizers": [PLAIN_SPLIT, PLAIN_BYTES]}
        if spec.get("normalizer") == PLAIN_NORMALIZER and spec.get("pre_tokenizer") == split:
            kind[33:127] = _OTHER
            kind[48:58] = _DIGIT
            kind[65:91] = kind[97:123] = _LETTER
            kind[ord("'")] = _HARD
            for t in added:
                kind[t.encode()[0]] = _HARD
            if not any(t.encode()[0] > 127 for t in added):
                self.pairs = _letters(library)
        self.kind = kind

    def kinds(self, raw: np.ndarray, low: np.ndarray | None = None) -> np.ndarray:
        """Of each byte; low: takes the lower case of letters beyond ASCII."""
        kind = self.kind[raw]
        if self.pairs is not None:
            far = np.flatnonzero(raw >= 0x80)
            lead = far[(raw[far] >= 0xC2) & (raw[far] < 0xD8)]
            if len(lead):
                letter = ((raw[lead] & 0x1F).astype(np.int64) << 6) | (raw[lead + 1] & 0x3F)
                lower = self.pairs[letter]
                lead, lower = lead[lower > 0], lower[lower > 0]
                kind[lead] = kind[lead + 1] = _LETTER
                if low is not None:
                    low[lead], low[lead + 1] = 0xC0 | (lower >> 6), 0x80 | (lower & 0x3F)
        return kind

    def cut(self, raw: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces begin (and the end), and the bytes to look up. breaks: where texts begin."""
        if self.kind is None:
            return np.union1d(breaks, [0, len(raw)]).astype(np.int32), raw
        low = _LOWER[raw]
        kind = self.kinds(raw, low)
        edge = np.empty(len(raw) + 1, bool)
        edge[0] = edge[-1] = True
        np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
        edge[:-1] |= kind == _DIGIT
        edge[breaks] = True
        hard = np.flatnonzero(kind == _HARD)
        if len(hard):
            white = kind == _WHITE
            outer = np.empty(len(raw) + 1, bool)
            outer[0] = outer[-1] = True
            np.not_equal(white[1:], white[:-1], out=outer[1:-1])
            outer[breaks] = True
            at = np.flatnonzero(outer)
            part = np.unique(np.searchsorted(at, hard, "right") - 1)
            size = at[part + 1] - at[part]
            inside = np.arange(int(size.sum())) + np.repeat(at[part] - (np.cumsum(size) - size), size)
            edge[inside] = False
            edge[at[part]] = True
            low[inside] = raw[inside]  # added tokens are told by their case
        return np.flatnonzero(edge).astype(np.int32), low

    def classes(self, data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each distinct piece: is it plain, must it go through the library."""
        if self.kind is None:
            return np.zeros(len(begin), bool), np.ones(len(begin), bool)
        if not len(begin):
            return np.zeros(0, bool), np.zeros(0, bool)
        most = np.maximum.reduceat(self.kinds(data), begin)
        return (most != _WHITE) & (most != _HARD), most == _HARD


def _letters(library) -> np.ndarray:
    """For code points of two bytes: the lower case if the library takes the letter like an
    ASCII one, 0 otherwise."""
    out = np.zeros(0x600, np.int64)
    for c in range(0x80, 0x600):
        x = chr(c)
        if unicodedata.category(x)[0] == "L" and not unicodedata.combining(x):
            low = library.normalizer.normalize_str(f"a{x}a")
            if len(low) == 3 and 0x80 <= ord(low[1]) < 0x600 and len(library.pre_tokenizer.pre_tokenize_str(low)) == 1:
                out[c] = ord(low[1])
    return out


def _parts_at_space(library) -> bool:
    normal, split = library.normalizer, library.pre_tokenizer
    words = lambda s: [w for w, _ in split.pre_tokenize_str(normal.normalize_str(s) if normal else s)]
    return split is not None and words("ab cd") == words("ab") + words("cd") and words(" \t\n") == []


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and each text's begin (and the end); null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _windows(raw: np.ndarray, begins: np.ndarray, kind: np.ndarray | None):
    """Parts of about WINDOW bytes that end where a text does or after white space."""
    at, n = 0, len(raw)
    while at < n:
        end = min(n, at + WINDOW)
        if end < n:
            before = int(begins[np.searchsorted(begins, end, "right") - 1])
            if before > at:
                end = before
            elif kind is None:
                end = int(begins[np.searchsorted(begins, end)])
            else:
                stop = int(begins[np.searchsorted(begins, end)])
                while end < stop and kind[raw[end - 1]] != _WHITE:
                    end += 1
        yield at, end
        at = end


def gather(flat: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """flat[begin[i] : begin[i] + count[i]] of all i, in a row."""
    ends = np.cumsum(count)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    return flat[np.repeat(begin - (ends - count), count) + np.arange(ends[-1])]


class Known:
    """Ids of pieces met before, in two generations bounded by bytes: what a window needs
    moves to the young one, which becomes the old one when it is full."""

    def __init__(self, most: int = KEPT):
        self.most = most
        self.young, self.old = self._empty(), self._empty()

    @staticmethod
    def _empty() -> tuple:
        none = np.zeros(0, np.int64)
        return pa.array([], pa.binary()), np.zeros(0, np.uint32), none, none

    def places(self, distinct: pa.Array, encode: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A table of ids, and of each distinct piece where its ids begin there and how many they are.
        encode: ids of an array of pieces in a row, and how many of each."""
        values, flat, begin, count = self.young
        if 8 * len(values) + 4 * len(flat) + values.nbytes > self.most // 2:
            self.old, self.young = self.young, self._empty()
            values, flat, begin, count = self.young
        place = pc.index_in(distinct, value_set=values).fill_null(-1).to_numpy().astype(np.int64)
        miss = np.flatnonzero(place < 0)
        if len(miss):
            sought = distinct.take(pa.array(miss))
            before = pc.index_in(sought, value_set=self.old[0]).fill_null(-1).to_numpy()
            new = np.flatnonzero(before < 0)
            ids, n = np.zeros(0, np.uint32), np.zeros(len(miss), np.int64)
            if len(new):
                ids, n[new] = encode(sought.take(pa.array(new)))
            moved = np.flatnonzero(before >= 0)
            n[moved] = self.old[3][before[moved]]
            # the old ones' ids lie behind those of the new ones
            start = np.zeros(len(miss), np.int64)
            start[new] = np.cumsum(n[new]) - n[new]
            start[moved] = len(ids) + np.cumsum(n[moved]) - n[moved]
            place[miss] = len(values) + np.arange(len(miss))
            begin, count = np.r_[begin, len(flat) + start], np.r_[count, n]
            flat = np.concatenate([flat, ids, gather(self.old[1], self.old[2][before[moved]], n[moved])])
            values = pa.concat_arrays([values, sought])
            self.young = values, flat, begin, count
        return flat, begin[place], count[place]


def encode(column: pa.Array, cutter: Cutter, known: Known, ids_of: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and where each text's begin (and the end).

    ids_of(data, begin, size, plain, hard): ids of all distinct pieces in a row, and how many of
    each; pieces that are neither plain nor hard have none."""

    def of(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        places = np.frombuffer(distinct.buffers()[1], np.int32)[distinct.offset : distinct.offset + len(distinct) + 1]
        data = np.frombuffer(distinct.buffers()[2] or b"", np.uint8)[places[0] : places[-1]]
        places = places - places[0]
        return ids_of(data, places[:-1], np.diff(places), *cutter.classes(data, places[:-1]))

    raw, begins = raw_bytes(column)
    made, total = [], 0
    starts = np.zeros(len(begins), np.int64)
    for a, b in _windows(raw, begins, cutter.kind):
        first, last = np.searchsorted(begins, a, "left"), np.searchsorted(begins, b, "left")
        own = begins[first:last] - a
        offsets, low = cutter.cut(raw[a:b], own)
        values = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(low)]).dictionary_encode()
        codes = values.indices.to_numpy()
        flat, begin, count = known.places(values.dictionary, of)
        n = count[codes]
        if len(own):
            ends = np.cumsum(n)
            starts[first:last] = total + (ends - n)[np.searchsorted(offsets, own)]
        made.append(gather(flat, begin[codes], n))
        total += len(made[-1])
    starts[np.searchsorted(begins, len(raw), "left") :] = total
    return np.concatenate(made) if made else np.zeros(0, np.uint32), starts
