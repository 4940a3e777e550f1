"""N-gram Jaccard join: universe-partition pigeonhole, verified exactly.

A document is the set of its word n-grams. Two sets within a Jaccard similarity t differ
in at most H elements, H following from their sizes. Hashing splits the universe of
n-grams into segments, by size band; if a set can spend more than H units on its segments
(1: a segment must be equal, 2: equal up to one deletion), any partner agrees with it in
a segment on which it spent. So:

1. Every set writes a signature per non-empty segment of its band, and of the band below
   if its partners may lie there; where the band's plan gives a segment two units, also
   one for each deletion of one element. The plan of a band (how many segments, how many
   of them with two units) is the cheapest by expected signatures that leaves enough
   units. A set whose own split falls short also writes the signatures of a prefix
   filter, so that no pair is lost.
2. Signatures that two different sets share form buckets; all others cost nothing. A set
   drops its most crowded signatures as far as its units allow (allocation by cost), so
   what thousands of documents quote is not compared, unless it makes up the document.
3. Buckets are joined by connectivity: each set is verified against one hub, the most
   connected set it meets; components follow. In a bucket that still holds several
   components, the sets outside of its largest one are then verified against all of the
   bucket's sets, component by component rather than pair by pair: a block of sets becomes
   an inverted index, the others stream past it, and every overlap is counted exactly.
   No link between components of one bucket goes untested, and no list of pairs is made.
4. Verification recomputes the sets from the whole texts. Groups are dealt in blocks of
   bounded size, so one large group becomes many tasks.

Equal sets are one node from the start. Elements are 64-bit hashes of the n-grams.

Defined results: words are split at \\x20 and \\x09-\\x0D after lower-casing A-Z; fewer
words than n make one n-gram; a null or blank text has no n-gram and is its own
component; a null doc_id never names a component unless all are null; repeated rows are
copies of each other.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import batched, drop_stored, release, slices, stored, tidy, utf8, LOWER_ASCII

N = 5
TIMES, OUT_OF = 75, 100  # similarity as a fraction
BLOCK, PART = 400_000, 2_000_000  # elements in an index, and that stream past one
SALTS, PLACES = 64, 1000  # tasks that meet a cut group's cuts, places of a group in a list

_FOREIGN, _ALWAYS = 1, 2
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _C[4]
    x = (x ^ (x >> np.uint64(33))) * _C[5]
    return x ^ (x >> np.uint64(33))


# ---- sets --------------------------------------------------------------------------


def sets_of(texts: list[str | None], n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Elements of all texts, sorted and distinct within each, and where each text's begin."""
    hashed, counts = [], []
    for t in texts:
        words = utf8(t).translate(LOWER_ASCII).split()
        counts.append(len(words))
        hashed += map(xxhash.xxh3_64_intdigest, words)
    flat = np.array(hashed, np.uint64)
    ends = np.cumsum(counts)
    grams = np.zeros(len(flat), np.uint64)
    for j in range(n):
        grams[: max(0, len(flat) - j)] += _mixed(flat[j:] + np.uint64(int(_C[j % 4]) * (j + 1) & 0xFFFFFFFFFFFFFFFF)) * _C[(j + 1) % 4]
    parts, starts, size = [], [0], 0
    for count, end in zip(counts, ends.tolist(), strict=True):
        if count >= n:
            own = np.unique(_mixed(grams[end - count : end - n + 1]))
        elif count:
            own = flat[end - count : end]
            own = _mixed(np.array([sum((int(h) * int(_C[k % 4]) + k) * (2 * k + 1) for k, h in enumerate(own)) + count & 0xFFFFFFFFFFFFFFFF], np.uint64))
        else:
            own = np.zeros(0, np.uint64)
        parts.append(own)
        size += len(own)
        starts.append(size)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.array(starts, np.int64)


def nodes_of(elements: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A number for each set; equal sets have equal numbers. Empty sets: 0."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(elements + _C[0]), dtype=np.uint64)])
    sizes = np.diff(starts).astype(np.uint64)
    out = _mixed(sums[starts[1:]] - sums[starts[:-1]] + sizes * _C[1])
    return np.where(sizes > 0, out, np.uint64(0)).view(np.int64)


# ---- bands and plans ---------------------------------------------------------------


def differ(a, b):
    """Elements in which sets of sizes a and b may differ."""
    return (a + b) * (OUT_OF - TIMES) // (OUT_OF + TIMES)


def least_partner(size):
    return -(-size * TIMES // OUT_OF)


@dataclass(frozen=True)
class Plan:
    low: int
    high: int
    segments: int
    double: int  # of them with two units


def band_of(size: np.ndarray) -> np.ndarray:
    """Bands 3-5, 6-11, 12-23, ... Smaller sets have no partner but equals."""
    return np.floor(np.log2(np.maximum(size, 3) / 3.0) + 1e-9).astype(np.int64)


@cache
def plan_of(band: int) -> Plan:
    """The cheapest split: expected signatures, dearer the fewer elements they hold."""
    low, high = 3 << band, (3 << band + 1) - 1
    best, least = Plan(low, high, max(1, high), 0), math.inf
    top = max(2, high)
    for m in sorted({max(1, round(top * x)) for x in (0.02, 0.04, 0.06, 0.08, 0.1, 0.13, 0.16, 0.2, 0.24, 0.28, 0.32, 0.36, 0.4, 0.44, 0.48, 0.52, 0.56, 0.6, 0.7, 0.8)}):
        for share in (0, 0.25, 0.5, 0.75, 1):
            double = round(m * share)
            cost, fit = 0.0, True
            for size in (low, (low + high) // 2, high):
                k = size / m
                some, one = 1 - math.exp(-k), k * math.exp(-k)
                if m == 1:
                    some, one = 1.0, 0.0
                units = (m - double) * some + double * (2 * some - one)
                spread = math.sqrt(max(0.0, (m - double) * some * (1 - some) + double * (some + 3 * (some - one) - (2 * some - one) ** 2))) if m > 1 else 0.0
                need = differ(size, size * OUT_OF // TIMES) + 1
                slack = 0.1 * need if high > 48 else 0
                fit &= units - 1.5 * spread >= need + slack
                cost += m * some + double * (k - one) + 0.5 * m * one
            if fit and cost < least:
                best, least = Plan(low, high, m, double), cost
    return best


def signatures(elements: np.ndarray, starts: np.ndarray, nodes: np.ndarray) -> dict[str, np.ndarray]:
    """sig, node, size, slack and flags of all sets.

    slack: how many of the set's single-unit segments in that band it may leave unused.
    """
    sizes = np.diff(starts)
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("sig", "node", "size", "slack", "flags")}
    weight = _mixed(elements ^ _C[2])
    home = band_of(sizes)
    short = np.zeros(len(sizes), bool)  # sets that lack units in one of their roles
    made = []
    for foreign in (False, True):
        bands = home - foreign
        lower_high = (3 << np.maximum(bands + 1, 0)) - 1
        takes = (sizes >= 3) & (bands >= 0)
        if foreign:
            takes &= least_partner(sizes) <= lower_high
        if not takes.any():
            continue
        plans = {b: plan_of(b) for b in np.unique(bands[takes]).tolist()}
        m = np.ones(len(sizes), np.uint64)
        double = np.zeros(len(sizes), np.int64)
        for b, p in plans.items():
            m[bands == b], double[bands == b] = p.segments, p.double
        chosen = np.flatnonzero(takes)
        which = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in chosen.tolist()])
        owner = np.repeat(chosen, sizes[chosen])
        u, w = elements[which], weight[which]
        segment = ((u >> np.uint64(32)) * m[owner]) >> np.uint64(32)
        begin = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (segment[1:] != segment[:-1])])
        held = np.diff(np.r_[begin, len(u)])
        total = np.add.reduceat(w, begin)
        by, seg = owner[begin], segment[begin]
        place = _mixed(bands[by].astype(np.uint64) * _C[3] + seg * _C[1] + np.uint64(1))
        two = seg.astype(np.int64) < double[by]
        units = np.bincount(by, np.where(two, np.minimum(held, 2), 1), len(sizes)).astype(np.int64)
        need = differ(sizes, np.where(foreign, lower_high, sizes)) + 1
        short |= takes & (units < need)
        if not foreign:
            short |= takes & (units < differ(sizes, sizes * OUT_OF // TIMES) + 1)
        slack = np.where(double > 0, 0, np.maximum(0, units - need))
        made.append((by, _mixed(total + place), slack, foreign))
        gone = two[np.repeat(np.arange(len(begin)), held)] & (np.repeat(held, held) > 1)
        if gone.any():
            run = np.repeat(np.arange(len(begin)), held)[gone]
            made.append((by[run], _mixed(total[run] - w[gone] + place[run]), slack, foreign))
    for i in np.flatnonzero(short).tolist():  # prefix filter among the sets that lack units
        own = elements[starts[i] : starts[i + 1]]
        own = own[: len(own) - least_partner(len(own)) + 1]
        made.append((np.full(len(own), i), _mixed(own ^ _C[5]), np.zeros(len(sizes), np.int64), False))
    for by, sig, slack, foreign in made:
        always = short[by] | (slack[by] == 0)
        out["sig"].append(sig.view(np.int64))
        out["node"].append(nodes[by])
        out["size"].append(sizes[by].astype(np.int32))
        out["slack"].append(np.where(always, 0, slack[by]).astype(np.int32))
        out["flags"].append((_FOREIGN * foreign + _ALWAYS * always).astype(np.int8))
    return {k: np.concatenate(v) if v else np.zeros(0, {"size": np.int32, "slack": np.int32, "flags": np.int8}.get(k, np.int64)) for k, v in out.items()}


# ---- passes over the texts ---------------------------------------------------------


def _texts(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def text_hash(text: str) -> Column:
    """With the id it tells rows apart that share a null or repeated id."""
    return F.xxhash64(F.col(text).cast("string")).alias("text_hash")


def profile(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node (null if empty) and a hash of the text of every document."""

    def run(batches):
        for big in batches:
            for batch in slices(big, 4 << 20):
                elements, starts = sets_of(batch.column(1).to_pylist())
                sizes = np.diff(starts)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes_of(elements, starts), pa.int64(), mask=sizes == 0), batch.column(2)], names=["doc_id", "n_shingles", "node", "text_hash"])
        tidy()

    return batched(_texts(docs, text_hash("text"))).mapInArrow(run, "doc_id long, n_shingles long, node long, text_hash long")


def _signed(docs: DataFrame) -> DataFrame:
    def run(batches):
        seen: set[int] = set()  # a set signs once a task; the rest is dropped after the shuffle
        for big in batches:
            for batch in slices(big, 2 << 20):
                elements, starts = sets_of(batch.column(0).to_pylist())
                nodes = nodes_of(elements, starts)
                fresh = np.array([not (x in seen or seen.add(x)) for x in nodes.tolist()], bool)
                if len(seen) > 1_000_000:
                    seen.clear()
                sizes = np.where(fresh, np.diff(starts), 0)
                elements = elements[np.repeat(fresh, np.diff(starts))]
                made = signatures(elements, np.r_[0, np.cumsum(sizes)], nodes)
                yield pa.RecordBatch.from_arrays([pa.array(made[k]) for k in ("sig", "node", "size", "slack", "flags")], names=["sig", "node", "size", "slack", "flags"])
        tidy()

    return batched(docs.select(F.col("text").cast("string").alias("text"))).mapInArrow(run, "sig long, node long, size int, slack int, flags byte")


def _linked(indexed: DataFrame, streamed: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (node, hub) between components, from the whole texts.

    indexed, streamed: (grp, node, comp). Within a group every indexed set is compared with
    every streamed one of another component; for each two components that link, one link
    is enough. Groups are cut by elements into blocks of the index and parts of the stream.
    """
    size = nodes.select("node", "size")
    few, all_ = indexed.join(size, "node"), streamed.join(size, "node")
    # most groups are one block and one part; the few that are cut are met salted, so that the
    # rows of a large group spread over tasks
    cuts = few.groupBy("grp").agg(F.ceil(F.sum("size") / BLOCK).cast("int").alias("blocks")).join(all_.groupBy("grp").agg(F.ceil(F.sum("size") / PART).cast("int").alias("parts")), "grp")
    cuts = cuts.filter("blocks > 1 or parts > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt, uncut = F.pmod(F.xxhash64("node", F.lit(2)), F.lit(SALTS)).cast("int"), {c: F.coalesce(c, F.lit(1)) for c in ("blocks", "parts")}
    few, all_ = (x.withColumn("salt", salt).join(cuts, ["grp", "salt"], "left").withColumns(uncut) for x in (few, all_))
    block, part = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")
    few = few.select("grp", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), "node", "comp")
    all_ = all_.select("grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), part.alias("part"), F.lit(1).alias("role"), "node", "comp")
    # a list holds at most so many places of a group
    far = [F.floor(F.col(c) / PLACES).alias(f"{c}s") for c in ("block", "part")]
    places = few.unionByName(all_).groupBy("node", "comp", *far).agg(F.collect_list(F.struct("grp", "block", "part", "role")).alias("places"))
    asked = places.join(nodes.select("node", F.col("doc_id").alias("rep")), "node")  # one document of the node
    rows = docs.join(asked, F.col("doc_id").eqNullSafe(F.col("rep"))).select("text", "node", "comp", "places")

    def to_sets(batches):
        names = ["grp", "block", "part", "role", "node", "comp", "elements"]
        for big in batches:
            for batch in slices(big, 2 << 20):
                elements, starts = sets_of(batch.column(0).to_pylist())
                # a doc_id may bear several texts: only the one that is the node counts
                own = nodes_of(elements, starts) == batch.column(1).to_numpy()
                places = batch.column(3)
                times = np.where(own, np.diff(places.offsets.to_numpy()), 0)
                flat = places.flatten().filter(pa.array(np.repeat(own, np.diff(places.offsets.to_numpy()))))
                raw = pa.array([elements[a:b].tobytes() if o else b"" for a, b, o in zip(starts[:-1].tolist(), starts[1:].tolist(), own.tolist(), strict=True)], pa.binary())
                at = np.repeat(np.arange(len(own)), times)
                step = 2000  # a set may go to many places
                for i in range(0, len(at), step):
                    part = pa.array(at[i : i + step])
                    yield pa.RecordBatch.from_arrays([*(flat.slice(i, step).field(k) for k in range(4)), batch.column(1).take(part), batch.column(2).take(part), raw.take(part)], names=names)
        tidy()

    sets = batched(rows).mapInArrow(to_sets, "grp long, block int, part int, role int, node long, comp long, elements binary")
    dealt = sets.repartition("grp", "block", "part").sortWithinPartitions("grp", "block", "part", "role", "node")

    def compare(batches):
        at, index = None, None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            nodes, comps = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            found: set[tuple[int, int]] = set()
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                *place, role = keys[a]
                sets = [np.frombuffer(x, np.uint64) for x in batch.column(6).slice(a, b - a).to_pylist()]
                if place != at:
                    at, index = place, _Index()
                if role == 0:
                    index.add(comps[a:b], sets)
                else:
                    found |= index.links(comps[a:b], sets)
            del nodes
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["node", "hub"])
        tidy()

    return batched(dealt).mapInArrow(compare, "node long, hub long").dropDuplicates()


class _Index:
    """An inverted index of a block of sets; counts overlaps with the sets that stream past."""

    def __init__(self):
        self.comps: list[int] = []
        self.sets: list[np.ndarray] = []
        self.values = None

    def add(self, comps: np.ndarray, sets: list[np.ndarray]) -> None:
        self.comps += comps.tolist()
        self.sets += sets
        self.values = None

    def _build(self) -> None:
        sizes = np.array([len(x) for x in self.sets], np.int64)
        values, owners = np.concatenate(self.sets), np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(values, kind="stable")
        self.values, self.owners, self.sizes, self.own = values[order], owners[order], sizes, np.array(self.comps)

    def links(self, comps: np.ndarray, sets: list[np.ndarray]) -> set[tuple[int, int]]:
        out: set[tuple[int, int]] = set()
        if not self.sets:
            return out
        if self.values is None:
            self._build()
        for mine, s in zip(comps.tolist(), sets, strict=True):
            low, high = np.searchsorted(self.values, s, "left"), np.searchsorted(self.values, s, "right")
            n = high - low
            if not n.any():
                continue
            # all places in the index at which an element of s stands
            ends = np.cumsum(n)
            spots = np.arange(ends[-1]) + np.repeat(low - (ends - n), n)
            both = np.bincount(self.owners[spots], minlength=len(self.sizes))
            near = np.flatnonzero((OUT_OF * both >= TIMES * (self.sizes + len(s) - both)) & (self.own != mine))
            out.update((mine, c) for c in set(self.own[near].tolist()))
        return out


# ---- components --------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """node, comp of every node of the edges (node, hub): the least node it reaches.

    Every pass takes the least label of all neighbours, then follows labels to labels;
    its result is written to the shared folder, so plans stay short.
    """
    both = stored(edges.select("node", "hub").union(edges.select("hub", "node")).toDF("a", "b").dropDuplicates())
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("comp")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("beyond"))
        new = stored(step.join(jump, "comp", "left").select("node", "old", F.least("comp", F.coalesce("beyond", "comp")).alias("comp")))
        labels = new.select("node", "comp")
        if new.filter("comp <> old").isEmpty():
            return labels


# ---- the join ----------------------------------------------------------------------


def _shared(docs: DataFrame) -> DataFrame:
    """Rows of signatures that several sets share, and how many share each."""
    by_sig = Window.partitionBy("sig")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _signed(docs).repartition(2 * n, "sig")
    shared = rows.withColumn("a", F.min("node").over(by_sig)).withColumn("b", F.max("node").over(by_sig)).filter("a <> b")
    shared = shared.groupBy("sig", "node").agg(F.first("size").alias("size"), F.max("slack").alias("slack"), F.min(F.col("flags").bitwiseAND(F.lit(_FOREIGN))).alias("foreign"), F.max(F.col("flags").bitwiseAND(F.lit(_ALWAYS))).alias("always"))
    return stored(shared.withColumn("n", F.count(F.lit(1)).over(by_sig)))


def _buckets(docs: DataFrame) -> DataFrame:
    """Rows of the shared signatures that some set still uses after dropping its most
    crowded ones."""
    by_sig = Window.partitionBy("sig")
    shared = _shared(docs)
    release(docs.sparkSession)
    own = Window.partitionBy("node", "foreign")
    ranked = shared.withColumn("crowd", F.row_number().over(own.orderBy(F.desc("n"), "sig"))).withColumn("weight", F.sum("n").over(own))
    ranked = ranked.withColumn("used", (F.col("always") > 0) | (F.col("crowd") > F.col("slack")))
    out = stored(ranked.withColumn("live", F.max("used").over(by_sig)).filter("live").select("sig", "node", "size", "weight"))
    drop_stored(shared)
    return out


def _fits(a: str, b: str):
    return (F.col(a) * OUT_OF >= F.col(b) * TIMES) & (F.col(b) * OUT_OF >= F.col(a) * TIMES)


def _hub_pairs(buckets: DataFrame) -> DataFrame:
    """(node, hub): for each set the most connected set that it meets most often."""
    by_sig = Window.partitionBy("sig")
    top = F.max(F.struct("weight", "node", "size")).over(by_sig)
    met = buckets.withColumn("top", top).filter((F.col("node") != F.col("top.node")) & _fits("size", "top.size"))
    counted = met.groupBy("node", F.col("top.node").alias("hub")).agg(F.count(F.lit(1)).alias("times"), F.max("top.weight").alias("weight"))
    return counted.groupBy("node").agg(F.max_by("hub", F.struct("times", "weight", "hub")).alias("hub"))


def _rest(buckets: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left to verify: for the largest component of each bucket that holds several
    (``grp``), the sets outside of it that such buckets hold, and all of their sets."""
    by_sig = Window.partitionBy("sig")
    rows = buckets.select("sig", "node").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    rows = stored(rows.withColumn("a", F.min("comp").over(by_sig)).withColumn("b", F.max("comp").over(by_sig)).filter("a <> b").select("sig", "node", "comp"))
    main = rows.groupBy("sig", "comp").count().groupBy("sig").agg(F.max_by("comp", F.struct("count", "comp")).alias("grp"))
    every = stored(rows.join(main, "sig").select("grp", "node", "comp").dropDuplicates())
    drop_stored(rows)
    return every.filter("comp <> grp"), every


def similar_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: the least doc_id reachable by links."""
    return grouped(docs).select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node, text_hash, comp and component_id, the least doc_id of the
    component; comp is null for documents without words, which have no partners."""
    docs = _texts(docs)
    profiled = stored(profile(docs))
    nodes = profiled.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("size"))
    reps = nodes.select("node", "doc_id")
    spark = docs.sparkSession
    buckets = _buckets(docs)
    release(spark)
    pairs = stored(_hub_pairs(buckets))
    release(spark)
    hubs = pairs.select(F.col("hub").alias("grp"), F.col("hub").alias("node"), F.col("hub").alias("comp")).dropDuplicates()
    edges = stored(_linked(hubs, pairs.select(F.col("hub").alias("grp"), "node", F.col("node").alias("comp")), docs, nodes))
    release(spark)
    labels = components(edges)
    few, every = _rest(buckets, labels)
    drop_stored(buckets)
    release(spark)
    if not few.isEmpty():
        more = stored(_linked(few, every, docs, nodes))
        if not more.isEmpty():
            labels = components(edges.unionByName(more))
    named = reps.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "comp").select("node", "comp", "component_id")
    return profiled.join(named, "node", "left")
