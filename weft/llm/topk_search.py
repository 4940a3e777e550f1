"""Exact top-k search by exhaustive term-at-a-time accumulation.

Rows are packed into blocks. A pair of a query block and a candidate block is one
unit of work: the candidates are held as postings per term (dimension), each query
row scatters ``weight * posting`` into a dense score array over the block, the k
best distinct (id, score) of the array are selected by partition, and the partial lists
of a query are merged by a window over (score descending, id ascending). The query set
is stated by the caller and meets all rows in blocks; blocks travel by an equi-join on
the numbers of the query block and of a group of candidate blocks, so neither side is
broadcast or collected, and a task's work stays the same however many rows there are.

Defined results: vectors that are null or hold a null or non-finite component take
no part, as query or candidate; vectors of other lengths are treated as zero beyond
their end; a candidate that bears the query's own id is not returned; equal query
rows are answered once, equal candidate rows count once; ties go to the smaller id; null
ids take no part. Weights are integers; a score is exact while it fits 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES = 8192  # rows in a candidate block
GROUP = 2  # candidate blocks that a task meets
QUERIES = 1024  # rows in a query block
_LANES = 64  # queries whose score arrays are held at once


def quantised(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component, as 64-bit integers; null if not finite."""
    fit = vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(fit, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


def _packed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Blocks of rows: ids, lengths and components as little-endian 64-bit integers."""
    held: list[pa.RecordBatch] = []

    def out() -> pa.RecordBatch:
        all_ = pa.Table.from_batches(held).combine_chunks()
        vec = all_.column(1).combine_chunks()
        vec = vec.chunk(0) if isinstance(vec, pa.ChunkedArray) else vec
        lengths = np.diff(vec.offsets.to_numpy())
        ids = all_.column(0).to_numpy().astype("<i8")
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([lengths.astype("<i4").tobytes()], pa.binary()), pa.array([vec.flatten().to_numpy(zero_copy_only=False).astype("<i8").tobytes()], pa.binary())], names=["n", "ids", "lengths", "weights"])

    n = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, most - n)
            batch = batch.slice(part.num_rows)
            held.append(part)
            n += part.num_rows
            if n == most:
                yield out()
                n = 0
    if n:
        yield out()


_BLOCK = "n int, ids binary, lengths binary, weights binary"


def _unpack(n: int, ids: bytes, lengths: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and a dense matrix with a row for each vector."""
    sizes, flat = np.frombuffer(lengths, "<i4"), np.frombuffer(weights, "<i8")
    wide = np.zeros((n, int(sizes.max()) if n else 0), np.int64)
    wide[np.arange(wide.shape[1]) < sizes[:, None]] = flat
    return np.frombuffer(ids, "<i8"), wide


def _postings(rows: np.ndarray) -> list[tuple[np.ndarray | slice, np.ndarray]]:
    """For each term the rows that have it, and their weights; all rows: a slice."""
    found = []
    for term in rows.T:
        where = np.flatnonzero(term)
        # nearly full lists are added without an index
        found.append((slice(None), np.ascontiguousarray(term)) if 2 * len(where) > len(term) else (where, term[where]))
    return found


def accumulate(queries: np.ndarray, postings: list, n: int) -> np.ndarray:
    """Dense scores of a few queries over n candidates, one term at a time."""
    scores = np.zeros((len(queries), n), np.int64)
    scratch = np.empty(n, np.int64)
    for q, row in enumerate(queries):
        score = scores[q]
        for t in np.flatnonzero(row[: len(postings)]):
            where, weights = postings[t]
            if isinstance(where, slice):
                np.multiply(weights, row[t], out=scratch)
                score += scratch
            else:
                score[where] += row[t] * weights
    return scores


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best; every tie at the cut is weighed by id, and an id that
    repeats with one score counts once."""
    may = ids != own
    if not may.all():
        scores, ids = scores[may], ids[may]
    rows = k
    while True:
        near = slice(None)
        if len(ids) > rows:
            near = np.flatnonzero(scores >= np.partition(scores, len(ids) - rows)[len(ids) - rows])
        a, b = ids[near], scores[near]
        order = np.lexsort((a, -b))
        a, b = a[order], b[order]
        first = np.ones(len(a), bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        if len(ids) <= rows or np.count_nonzero(first) >= k:
            return a[first][:k], b[first][:k]
        rows *= 4  # repeated rows took up places


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """rows, queries: (id long, vector array<long>). One output row for each query and rank."""
    def clean(df: DataFrame) -> DataFrame:
        a, b = df.columns[:2]
        return df.select(F.col(f"`{a}`").cast("long").alias("id"), F.col(f"`{b}`").alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))

    candidates = clean(rows).mapInArrow(lambda it: _packed(it, CANDIDATES), _BLOCK)
    # query blocks: numbered by hash range of the id, so that a rerun builds the same blocks
    asked = clean(queries).dropDuplicates()
    n_blocks = max(1, -(-asked.count() // QUERIES))
    asked = asked.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")).repartition(n_blocks, "qb").sortWithinPartitions("qb", "id")

    def pack_queries(batches):
        held: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            qb = batch.column(2).to_numpy()
            for b in np.unique(qb):
                where = np.flatnonzero(qb == b)
                part = batch.take(pa.array(where)).select([0, 1])
                if b not in held and held:
                    for key in list(held):
                        yield from stamped(key, held.pop(key))
                held.setdefault(int(b), []).append(part)
        for key in list(held):
            yield from stamped(key, held.pop(key))

    def stamped(key, parts):
        for block in _packed(iter(parts), 2 * QUERIES):
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), *block.columns], names=["qb", *block.schema.names])

    q = asked.mapInArrow(pack_queries, f"qb int, {_BLOCK}").select("qb", *[F.col(c).alias(f"q_{c}") for c in ("n", "ids", "lengths", "weights")])
    # groups of candidate blocks: by a hash of the block's content, so that a rerun deals them alike
    n_groups = max(1, -(-rows.count() // (GROUP * CANDIDATES)))
    dealt = candidates.withColumn("cg", F.pmod(F.xxhash64("ids"), F.lit(n_groups)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    pairs = dealt.join(q.withColumn("cg", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)))), ["qb", "cg"])

    def score(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pydict()
                ids, wide = _unpack(*(row[c][0] for c in ("n", "ids", "lengths", "weights")))
                own, asks = _unpack(*(row[f"q_{c}"][0] for c in ("n", "ids", "lengths", "weights")))
                postings = _postings(wide)
                found: list[list[np.ndarray]] = [[], [], []]
                for at in range(0, len(own), _LANES):
                    scores = accumulate(asks[at : at + _LANES], postings, len(ids))
                    for query, mine in zip(own[at : at + _LANES], scores, strict=True):
                        a, b = best(mine, ids, query, k)
                        for f, x in zip(found, (np.full(len(a), query), a, b), strict=True):
                            f.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(f) if f else np.zeros(0, np.int64), pa.int64()) for f in found], names=["query_id", "vec_id", "score"])

    partial = pairs.mapInArrow(score, "query_id long, vec_id long, score long")
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return partial.dropDuplicates(["query_id", "vec_id", "score"]).withColumn("rank", ranked).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
