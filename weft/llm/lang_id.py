"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of a bounded sample of labelled text (see
``SAMPLE_CHARS``). A text is parsed against a language from left to right into the longest
phrases that occur in its sample (Ziv-Merhav cross-parsing); the fewer phrases, the
closer the language. Phrases are normalised per character with the log of the sample's
length, and the language of the lowest cross-entropy wins. The score is the winner's
posterior if the texts' code lengths are read as log-likelihoods, over at most
``EVIDENCE`` characters' worth of evidence.

Whole texts are parsed, in lanes of ``LANE`` characters side by side; a phrase also ends
where a lane ends, equally for all languages.

Defined results: a null text, or one without a letter, is ``und`` with score 0; without
any labelled text all are. Languages tie by code point order. Equal texts get equal
results.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import batched, crc32_of, held, slices, tidy

#: Bounds of the sample that a language is learned from: its characters, and those of one
#: of its texts (a longer text lends that many to the sample).
SAMPLE_CHARS, SAMPLE_TEXT = 40_000, 8_000
LANE, EVIDENCE = 1024, 400
CLASSES = 256  # character classes; the first is a break


def classes_of(text: str) -> np.ndarray:
    """A class for each character: letters (lower-cased) by code point, all else a break;
    runs of breaks count once."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    low = points < len(_CLASS)
    out = np.empty(len(points), np.uint8)
    out[low] = _CLASS[points[low]]
    if not low.all():
        out[~low] = [1 + (p % (CLASSES - 1)) if chr(p).isalpha() else 0 for p in points[~low].tolist()]
    if len(out) > 1:
        keep = np.ones(len(out), bool)
        keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
        out = out[keep]
    return out


_CLASS = np.array([1 + (p % (CLASSES - 1)) if chr(p).isalpha() else 0 for p in range(0x3000)], np.uint8)


class SuffixAutomaton:
    """All substrings of a sequence of classes; a dense row of transitions per state, -1: none."""

    def __init__(self, sequence: Iterable[int]):
        follow: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        last = 0
        for c in sequence:
            new = len(follow)
            follow.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in follow[p]:
                follow[p][c] = new
                p = link[p]
            if p >= 0:
                q = follow[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    twin = len(follow)
                    follow.append(dict(follow[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and follow[p].get(c) == q:
                        follow[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        self.length = length[last]
        self.follow = follow

    def dense(self, columns: np.ndarray, width: int) -> np.ndarray:
        out = np.full((len(self.follow), width), -1, np.int32)
        for s, row in enumerate(self.follow):
            for c, t in row.items():
                out[s, columns[c]] = t
        return out


class Model:
    """Parsers of all languages; samples: language to text."""

    def __init__(self, samples: dict[str, str]):
        self.names = sorted(samples)
        coded = [classes_of(samples[n]) for n in self.names]
        used = np.unique(np.concatenate(coded)) if coded else np.zeros(0, np.uint8)
        # classes that no sample holds share one column, without transitions
        self.column = np.full(CLASSES, len(used), np.uint8 if len(used) < 255 else np.int64)
        self.column[used] = np.arange(len(used))
        self.tables, self.lengths = [], []
        for c in coded:
            a = SuffixAutomaton(c.tolist())
            self.tables.append(a.dense(self.column, len(used) + 1).reshape(-1))
            self.lengths.append(max(2, a.length))
        self.width = len(used) + 1

    def phrases(self, lanes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """lanes: a column per lane, longest first; sizes: its characters. Phrases by language and lane."""
        n = lanes.shape[1]
        out = np.zeros((len(self.names), n), np.int64)
        for k, table in enumerate(self.tables):
            state, count, width = np.zeros(n, np.int64), out[k], self.width
            live = n
            for t in range(lanes.shape[0]):
                while live and sizes[live - 1] <= t:
                    live -= 1
                if not live:
                    break
                c = lanes[t, :live]
                to = table[state[:live] * width + c]
                dead = np.flatnonzero(to < 0)
                if len(dead):
                    # the phrase ends before this character; the next begins with it
                    count[dead] += state[dead] > 0
                    again = table[c[dead]]
                    count[dead] += again < 0  # a character that the sample lacks is a phrase
                    to[dead] = np.maximum(again, 0)
                state[:live] = to
            count += state > 0
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        coded = [classes_of(t) if t else _NONE for t in texts]
        letters = np.array([bool(c.any()) for c in coded], bool)
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.names or not letters.any():
            return names, scores
        owner, parts = [], []
        for i in np.flatnonzero(letters).tolist():
            for at in range(0, len(coded[i]), LANE):
                owner.append(i)
                parts.append(self.column[coded[i][at : at + LANE]])
        sizes = np.array([len(p) for p in parts])
        order = np.argsort(-sizes, kind="stable")
        lanes = np.zeros((LANE, len(parts)), np.int64)
        for j, o in enumerate(order.tolist()):
            lanes[: sizes[o], j] = parts[o]
        found = self.phrases(lanes, sizes[order])
        total = np.zeros((len(self.names), len(texts)))
        for k in range(len(self.names)):
            np.add.at(total[k], np.array(owner)[order], found[k])
        chars = np.array([max(1, len(c)) for c in coded])
        bits = total * np.array([math.log2(n) for n in self.lengths])[:, None] / chars  # per character
        win = bits.argmin(0)
        weight = np.exp2((bits.min(0) - bits) * np.minimum(chars, EVIDENCE))
        score = 1 / weight.sum(0)
        for i in np.flatnonzero(letters).tolist():
            names[i], scores[i] = self.names[win[i]], float(score[i])
        return names, scores


_NONE = np.zeros(0, np.uint8)
def model_of(samples: dict[str, str]) -> Model:
    """One per worker process and set of samples."""
    return held(("language", hashlib.sha256(repr(sorted(samples.items())).encode("utf-8", "surrogatepass")).hexdigest()), lambda: Model(samples))


def samples_of(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> dict[str, str]:
    """A bounded sample of each language's text, chosen by a hash of the key and text; a row
    that is repeated enters once.

    Counts per language come first; they set a hash limit for each language at which
    about twice the texts needed arrive, and only those reach the driver.
    """
    rows = labelled.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t"), F.col(f"`{lang}`").cast("string").alias("l")).filter(F.col("l").isNotNull() & F.col("t").isNotNull()).withColumn("t", F.substring("t", 1, SAMPLE_TEXT)).withColumn("n", F.length("t")).filter(F.col("n") > 0)
    found = rows.groupBy("l").agg(F.sum("n").alias("chars")).collect()  # a row per language
    if not found:
        return {}
    # the text is part of what is hashed: rows that share a null or repeated key don't come together
    spread = F.pmod(F.xxhash64(F.col("k"), F.col("t"), F.lit(17)), F.lit(1 << 40))
    limit = F.lit(0).cast("long")
    for r in found:
        share = min(1.0, 3 * SAMPLE_CHARS / max(1, r["chars"]) + 20 * SAMPLE_TEXT / max(1, r["chars"]))
        limit = F.when(F.col("l") == r["l"], F.lit(int(share * (1 << 40)))).otherwise(limit)
    taken: dict[str, list] = {}
    for r in rows.withColumn("h", spread).filter(F.col("h") < limit).select("l", "h", "k", "t").dropDuplicates().collect():
        taken.setdefault(r["l"], []).append((r["h"], r["k"] is None, r["k"] or 0, r["t"]))
    out = {}
    for name, texts in taken.items():
        own, size = [], 0
        for *_, t in sorted(texts):
            if size and size + len(t) > SAMPLE_CHARS:
                break
            own.append(t)
            size += len(t)
        out[name] = "\n".join(own)
    return out


def held_out(key: str = "doc_id"):
    return F.coalesce(F.pmod(crc32_of(F.col(f"`{key}`")), F.lit(3)) == 1, F.lit(False))


def identify(docs: DataFrame, samples: dict[str, str], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred and score to the kept columns (all by default)."""
    added = ("lang_pred", "score")
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in added]
    ahead = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in ahead.schema.fields[:-1]), "lang_pred string", "score double"])

    def run(batches):
        model = model_of(samples)
        for big in batches:
            for batch in slices(big, 4 << 20):
                made = model.predict(batch.column(batch.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made[0], pa.string()), pa.array(made[1], pa.float64())], names=[*batch.schema.names[:-1], *added])
        tidy()

    return batched(ahead).mapInArrow(run, schema)
