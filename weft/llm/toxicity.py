"""Toxicity by a counterfactual-regularised classifier.

A logistic model over the presence of words and of word beginnings is trained on a
bounded sample of labelled rows (``SAMPLE`` texts of each label, chosen by a hash of the
id, weighted back to the labels' true shares). Every sampled text also enters as a copy in
which a neutral word, one that is no candidate feature, gives its place to an identity
term, so that terms of all kinds stand in sentences of both labels whatever the sample
names. Wherever a text or a copy names a group, its counterfactuals swap the term for
each other one of its kind, and the squared change of the score is added to the loss: what
a text says about a group counts, which group it is does not. :attr:`Model.twins` tells how
many counterfactuals entered the fit. Scoring reads whole texts.

Longer texts than ``SAMPLE_TEXT`` characters take no part in the training, whole or cut.
Defined results: a null text is empty; texts without a known feature, empty ones too, get
the score of the intercept; labels that are null take no part; of the texts that share an
id the least one enters the training; without labels, or
without both of them, every score is 0. Equal texts get equal scores.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import batched, crc32_of, slices, tidy

#: Bounds of the training sample: texts of each label, characters of a text that may enter.
SAMPLE, SAMPLE_TEXT = 4000, 20_000
#: Features: at most so many, each in so many texts, and so unlikely by chance.
FEATURES, LEAST_TEXTS, CHANCE = 600, 4, 1e-5
BEGINNINGS = (4, 5, 6)
THRESHOLD, RIDGE, SWAP_PENALTY, STEPS = 0.3, 1e-4, 20.0, 500
#: Identity terms, by kind; terms of one kind are swapped for each other.
IDENTITY = (
    ("woman", "man", "girl", "boy", "transgender", "nonbinary"),
    ("women", "men", "girls", "boys"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "heterosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("immigrant", "native", "refugee", "foreigner"),
    ("old", "young", "elderly", "disabled", "blind", "deaf"),
)
_KIND = {w: kind for kind in IDENTITY for w in kind}
_TERMS = sorted(_KIND)
_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """The word, and its beginnings; identity terms stand for themselves alone."""
    if word in _KIND:
        return [word]
    return [word, *(f"{word[:n]}~" for n in BEGINNINGS if len(word) > n)]


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    intercept: float
    twins: int = 0  # counterfactuals that the fit compared

    def scorer(self):
        known: dict[str, tuple[str, ...]] = {}
        weights, intercept = self.weights, self.intercept

        def score(text: str | None) -> float:
            if len(known) > 500_000:
                known.clear()
            found: set[str] = set()
            for w in words_of(text):
                own = known.get(w)
                if own is None:
                    own = known[w] = tuple(f for f in features(w) if f in weights)
                if own:
                    found.update(own)
            return _sigmoid(intercept + sum(weights[f] for f in sorted(found)))

        return score


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def swaps(words: set[str]) -> list[tuple[str, str | None]]:
    """For each identity term among the words and each other term of its kind: the term that
    goes and the one that comes (None if it is there already)."""
    return [(w, other if other not in words else None) for w in sorted(words & _KIND.keys()) for other in _KIND[w] if other != w]


def with_term(words: set[str], neutral: list[str]) -> tuple[set[str], str | None]:
    """The words with a neutral one replaced by an identity term that isn't there yet; which
    ones follows from the words alone."""
    seed = zlib.crc32(" ".join(sorted(words)).encode("utf-8", "surrogatepass"))
    free = [t for t in _TERMS if t not in words]
    if not free:
        return words, None
    term = free[seed % len(free)]
    gone = {neutral[seed // 64 % len(neutral)]} if neutral else set()
    return (words - gone) | {term}, term


def _candidates(texts: list[str], labels: list[int]) -> dict[str, int]:
    """Numbers for the features that may enter: those of enough toxic texts, and identity
    terms. Bags of words aren't kept: the texts are few, their words many."""
    seen: Counter[str] = Counter()
    for t, label in zip(texts, labels, strict=True):
        if label:
            seen.update({f for w in words_of(t) - _KIND.keys() for f in features(w)})
    return {f: i for i, f in enumerate(sorted({f for f, n in seen.items() if n >= LEAST_TEXTS} | _KIND.keys()))}


def fit(texts: list[str], labels: list[int], weights: list[float], swap_penalty: float = SWAP_PENALTY) -> Model | None:
    """Weighted logistic regression with the counterfactual penalty, by gradient descent."""
    y, importance = np.array(labels, float), np.array(weights, float)
    if len(set(labels)) < 2:
        return None
    number = _candidates(texts, labels)
    held, copies, twins = [], [], []
    for t in texts:
        words, own, neutral = words_of(t), set(), []
        for w in sorted(words):
            found = [number[f] for f in features(w) if f in number]
            own.update(found)
            if not found:
                neutral.append(w)
        held.append(np.array(sorted(own), np.int64))
        copy, term = with_term(words, neutral)
        copies.append(np.array(sorted(own | ({number[term]} if term else set())), np.int64))
        twins += swaps(words) + (swaps(copy) if term else [])
    total = np.array([importance[y == 0].sum(), importance[y == 1].sum()])
    base = float(total[1] / total.sum())
    # weighted counts, in texts of the label that was sampled least thinly
    share = importance / importance.min()
    of = np.repeat(np.arange(len(held)), [len(h) for h in held])
    flat = np.concatenate(held) if held else np.zeros(0, np.int64)
    times = np.bincount(flat, share[of], len(number))
    toxic = np.bincount(flat, (share * y)[of], len(number))

    def chance(n: float, k: float) -> float:
        """Log probability that a word unrelated to the label is this often in toxic texts."""
        return _log_tail(k, n, base) if k > base * n else 0.0

    odds = {f: chance(times[i], toxic[i]) for f, i in number.items() if f not in _KIND}
    ranked = sorted((f for f, p in odds.items() if p < math.log(CHANCE)), key=lambda f: (odds[f], f))[:FEATURES]
    column = {f: i for i, f in enumerate([*ranked, *sorted(f for f in number if f in _KIND)])}
    place = np.full(len(number), -1, np.int64)
    for f, i in column.items():
        place[number[f]] = i

    def matrix(rows):
        at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        cols = place[np.concatenate(rows)] if rows else np.zeros(0, np.int64)
        return at[cols >= 0], cols[cols >= 0]

    # texts and their copies share a text's weight
    at, cols = matrix(held + copies)
    y, importance = np.tile(y, 2), np.tile(importance / 2, 2)
    goes = np.array([column[a] for a, _ in twins], np.int64)
    comes = np.array([column[b] if b else len(column) for _, b in twins], np.int64)  # the last: no term
    theta, bias = np.zeros(len(column)), math.log(total[1] / total[0])
    share = importance / importance.sum()
    scale = total.sum() / (2 * total[y.astype(int)])  # both labels pull alike while the direction is learned
    share = share * scale
    m1, m2 = np.zeros(len(column) + 1), np.zeros(len(column) + 1)
    n, k = len(y), len(column)
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(at, theta[cols], n)
        pull = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.bincount(cols, pull[at], k) + RIDGE * theta
        if len(twins):  # the score of a text less that of its twin: the terms' weights alone differ
            change = theta[goes] - np.r_[theta, 0.0][comes]
            part = 2 * swap_penalty * change / len(twins)
            grad += np.bincount(goes, part, k) - np.bincount(comes, part, k + 1)[:k]
        g = np.r_[grad, pull.sum()]
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        move = 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-9)
        theta -= move[:-1]
        bias -= move[-1]
    # the labels' true shares, for the intercept alone
    for _ in range(50):
        z = bias + np.bincount(at, theta[cols], n)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        w = importance / importance.sum()
        bias -= (w * (p - y)).sum() / max(1e-6, (w * p * (1 - p)).sum())
    return Model({f: float(theta[i]) for f, i in column.items() if abs(theta[i]) > 1e-6}, float(bias), len(twins))


def _log_tail(k: float, n: float, p: float) -> float:
    """Bound of log P(X >= k) for a binomial of n trials (Chernoff)."""
    a = k / n
    if a >= 1:
        return n * math.log(p)
    return -n * (a * math.log(a / p) + (1 - a) * math.log((1 - a) / (1 - p)))


def held_out(key: str = "doc_id"):
    return F.coalesce(F.pmod(crc32_of(F.col(f"`{key}`")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic. Counts per label set hash limits; the ids
    below them, of bounded number, pick the texts. Neither table is shuffled."""
    spark = docs.sparkSession
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return Model({}, -math.inf)
    spread = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(29)), F.lit(1 << 40))
    picked = []
    for label, n in sorted(counts.items()):
        limit = int(min(1.0, 1.2 * SAMPLE / n + 50 / n) * (1 << 40))
        picked += rows.filter(F.col("toxic") == label).withColumn("h", spread).filter(F.col("h") < limit).orderBy("h", "doc_id").limit(SAMPLE).collect()
    ids = spark.createDataFrame([(r["doc_id"], r["toxic"], r["h"]) for r in picked], "doc_id long, toxic int, h long").dropDuplicates()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_TEXT))
    # at most 2 * SAMPLE ids, and a text for each
    found = own.join(F.broadcast(ids), "doc_id").groupBy("h", "doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    texts, truth, weights = [], [], []
    for label in (0, 1):
        mine = sorted((r["h"], r["doc_id"], r["text"]) for r in found if r["toxic"] == label)[:SAMPLE]
        texts += [t for *_, t in mine]
        truth += [label] * len(mine)
        weights += [counts[label] / max(1, len(mine))] * len(mine)
    return fit(texts, truth, weights) or Model({}, -math.inf)


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Adds score and predicted to the kept columns (all by default)."""
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("score", "predicted")]
    ahead = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in ahead.schema.fields[:-1]), "score double", "predicted int"])

    def run(batches):
        one = model.scorer() if model.intercept > -math.inf else lambda _: 0.0
        for big in batches:
            for batch in slices(big):
                made = [one(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.float64()), pa.array([int(s >= threshold) for s in made], pa.int32())], names=[*batch.schema.names[:-1], "score", "predicted"])
        tidy()

    return batched(ahead).mapInArrow(run, schema)
