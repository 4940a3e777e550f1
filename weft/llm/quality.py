"""Quality rules with risk-controlled thresholds.

Each document gets counts of its whole text. Two fixed rules form the base verdict. On
top of it, cutoffs of the further rules are selected per stratum (a band of document
length) from labelled holdouts: a cutoff may be used only if the exact (Clopper-Pearson)
upper bound of the share of good documents that it rejects stays within ``RISK``, at a
confidence that is divided by the number of all tests made (Bonferroni). Of the cutoffs
that pass, each rule takes the strictest; a stratum or rule without one rejects nothing.

The holdout is every labelled document; what reaches the driver is one count for each
stratum, rule and grid cell, a table whose size the grids fix. Label joins run on
``doc_id`` over narrow rows.

Defined results: a null text has no words and fails the base rules; labels that are
null take no part; a document labelled twice counts twice; without labels no cutoff
passes and the base rules decide alone. Rows keep their number; repeated rows get equal
results.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import batched, slices, tidy

#: Symbols that the symbol count counts.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
RISK, CONFIDENCE = 0.02, 0.95
#: Lower ends of the strata, in words.
STRATA = (0, 200, 800)
_NOT_SYMBOL = re.compile(f"[^{re.escape(SYMBOLS)}]+")


@dataclass(frozen=True)
class Rule:
    """Rejects documents whose ratio (per thousand) is above a cutoff of the grid."""

    name: str
    above: str
    below: str
    per: int
    grid: tuple[int, ...]

    def ratio(self) -> Column:
        return F.when(F.col(self.below) > 0, F.floor(F.col(self.above) * self.per / F.col(self.below))).otherwise(F.lit(0)).cast("long")


RULES = (
    Rule("symbols", "n_symbols", "n_words", 1000, (50, 100, 200, 300, 500, 800, 1200, 2000)),
    Rule("dup_lines", "n_dup_lines", "n_lines", 1000, (100, 200, 300, 400, 500, 600, 700, 800)),
    Rule("repeats", "n_repeat_words", "n_words", 1000, (100, 150, 200, 250, 300, 350, 400, 450)),
    Rule("word_length", "word_chars", "n_words", 1000, (8000, 9000, 10000, 12000, 15000, 20000, 30000, 50000)),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def repeat_words(words: list[bytes]) -> int:
    """Words that stand in a window of three that the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, n)
    # windows as numbers: pairs first, so that three ids of any size fit
    pair = ids[:-1] * np.uint64(len(number)) + ids[1:]
    _, pair = np.unique(pair, return_inverse=True)
    window = pair[:-1].astype(np.uint64) * np.uint64(len(number)) + ids[2:]
    _, at, times = np.unique(window, return_inverse=True, return_counts=True)
    often = times[at] > 1
    covered = np.zeros(n, bool)
    covered[:-2] |= often
    covered[1:-1] |= often
    covered[2:] |= often
    return int(covered.sum())


def counts_of(text: str | None) -> tuple[int, int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text) - (len(raw) - sum(map(len, words)))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words), len(lines)


def measure(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds the counts to the kept columns (all by default); count names win over the input's."""
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in COUNTS]
    ahead = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in ahead.schema.fields[:-1]), *(f"{c} long" for c in COUNTS)])

    def run(batches):
        for big in batches:
            for batch in slices(big):
                made = [counts_of(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array([m[i] for m in made], pa.int64()) for i in range(len(COUNTS)))], names=[*batch.schema.names[:-1], *COUNTS])
        tidy()

    return batched(ahead).mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def stratum() -> Column:
    return sum((F.when(F.col("n_words") >= low, 1).otherwise(0) for low in STRATA[1:]), F.lit(0))


# ---- thresholds --------------------------------------------------------------------


def upper_bound(k: int, n: int, alpha: float) -> float:
    """Exact upper confidence bound of a binomial share: the p at which P(X <= k) = alpha."""
    if n == 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        if _at_most(k, n, p) > alpha:
            low = p
        else:
            high = p
    return high


def _at_most(k: int, n: int, p: float) -> float:
    if p <= 0:
        return 1.0
    if p >= 1:
        return 0.0 if k < n else 1.0
    first = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    total = term = 1.0  # from k downwards, each term relative to the one at k
    for i in range(k, 0, -1):
        term *= i / (n - i + 1) * (1 - p) / p
        total += term
        if term < total * 1e-17:
            break
    return min(1.0, math.exp(min(0.0, first + math.log(total))))


@dataclass(frozen=True)
class Thresholds:
    """cut[(stratum, rule)]: reject above it."""

    cut: dict[tuple[int, str], int]
    tests: int

    def rejects(self) -> Column:
        parts = [(stratum() == s) & (next(r for r in RULES if r.name == name).ratio() > c) for (s, name), c in sorted(self.cut.items())]
        out = F.lit(False)
        for p in parts:
            out = out | p
        return out


def select_thresholds(measured: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE) -> Thresholds:
    """measured: doc_id and counts; labels: doc_id, quality (1: good)."""
    good = labels.filter(F.col("quality") == 1).select("doc_id")
    held = measured.filter(~base_failed()).join(good, "doc_id")
    above = [F.sum(F.when(r.ratio() > c, 1).otherwise(0)).alias(f"{r.name}_{c}") for r in RULES for c in r.grid]
    rows = held.groupBy(stratum().alias("s")).agg(F.count(F.lit(1)).alias("n"), *above).collect()  # a row for each stratum
    tests = len(STRATA) * sum(len(r.grid) for r in RULES)
    alpha = (1 - confidence) / tests
    cut: dict[tuple[int, str], int] = {}
    for row in rows:
        for r in RULES:
            safe = [c for c in r.grid if upper_bound(row[f"{r.name}_{c}"], row["n"], alpha) <= risk / len(RULES)]
            if safe:
                cut[row["s"], r.name] = min(safe)
    return Thresholds(cut, tests)


def judge(measured: DataFrame, thresholds: Thresholds) -> DataFrame:
    return measured.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~thresholds.rejects())
