"""Breadth-first expansion as iterated joins, shared by every path search.

State is a row for each (start, node): the depth at which it was first reached, the edge
that reached it, and, where asked for, the path. A level joins the frontier with the
edges, keeps the least edge for each new node, and drops nodes seen before with an anti
join. Rows of the query that share a start share its expansion. Each level is a folder of
the shared one, and all of them are read as one relation, so the plan of a level is as
large as that of the first; a bound of one or two hops is planned lazily instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.storage import computed, cut, forget, put, reread

LAZY_LEVELS = 2


def oriented(edges: DataFrame, direction: str) -> DataFrame:
    """(eid, a, b): steps from a to b. Both directions hold a loop twice."""
    out = edges.select(F.col("id").alias("eid"), F.col("src").alias("a"), F.col("dst").alias("b"))
    back = edges.select(F.col("id").alias("eid"), F.col("dst").alias("a"), F.col("src").alias("b"))
    return out if direction == "out" else back if direction == "in" else out.unionAll(back)


def _seed(starts: DataFrame, path: bool) -> DataFrame:
    cols = [F.col("start"), F.col("start").alias("node"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("edge")]
    if path:
        cols += [F.array("start").alias("nodes"), F.array().cast("array<bigint>").alias("rels")]
    return starts.select("start").dropDuplicates().select(*cols)


def _next(frontier: DataFrame, steps: DataFrame, path: bool) -> DataFrame:
    """The least edge into each node one step on; not yet rid of nodes seen before."""
    kept = ["start", "depth", "node", *(["nodes", "rels"] if path else [])]
    # a start that is many rows' frontier meets the edges by node: one equi-join
    moved = frontier.select(*kept).join(steps, F.col("node") == F.col("a"))
    moved = moved.filter((F.col("b") != F.col("start")))  # the start is seen at depth 0
    if not path:
        return moved.groupBy("start", F.col("b").alias("node")).agg(F.min("depth").alias("depth"), F.min("eid").alias("edge")).withColumn("depth", F.col("depth") + 1)
    best = F.min_by(F.struct("depth", "eid", "nodes", "rels"), F.struct("eid", "node"))
    return moved.groupBy("start", F.col("b").alias("to")).agg(best.alias("m")).select("start", F.col("to").alias("node"), (F.col("m.depth") + 1).alias("depth"), F.col("m.eid").alias("edge"), F.concat("m.nodes", F.array("to")).alias("nodes"), F.concat("m.rels", F.array("m.eid")).alias("rels"))


def expand(starts: DataFrame, steps: DataFrame, low: int, high: int, path: bool = False) -> DataFrame:
    """(start, node, depth, edge[, nodes, rels]) of every node whose shortest depth lies in
    low..high; starts: a column ``start``."""
    seed = _seed(starts, path)
    if high == 0:
        return seed if low == 0 else seed.limit(0)
    if high <= LAZY_LEVELS:
        one = _next(seed, steps, path)
        levels = [seed, one]
        if high > 1:
            levels.append(_next(one, steps, path).join(one.select("start", "node"), ["start", "node"], "left_anti").select(*one.columns))
        out = levels[low] if low < len(levels) else seed.limit(0)
        for df in levels[low + 1 :]:
            out = out.unionAll(df.select(*out.columns))
        return out
    spark, schema = starts.sparkSession, seed.schema
    own = cut(steps) if computed(steps) else steps
    paths = [put(seed)]
    frontier = reread(spark, schema, paths)
    for _ in range(high):
        seen = reread(spark, schema, paths).select("start", "node")
        path_to = put(_next(frontier, own, path).join(seen, ["start", "node"], "left_anti").select(*schema.names))
        paths.append(path_to)
        frontier = reread(spark, schema, [path_to])
        if frontier.isEmpty():
            break
    return reread(spark, schema, paths).filter((F.col("depth") >= low) & (F.col("depth") <= high))


def shortest(pairs: DataFrame, steps: DataFrame, high: int | None = None) -> DataFrame:
    """(start, target, nodes, rels) of a shortest path for each pair (start, target) that
    has one; a start stops when all its targets are met."""
    spark = pairs.sparkSession
    pairs = cut(pairs.select("start", "target").filter("start is not null and target is not null").dropDuplicates())
    steps = cut(steps) if computed(steps) else steps
    found = pairs.filter("start = target").select("start", "target", F.array("start").alias("nodes"), F.array().cast("array<bigint>").alias("rels"))
    open_ = put(pairs.filter("start <> target"))
    still = lambda: reread(spark, pairs.schema, [open_])
    seed = _seed(still().select("start"), True)
    levels, hits = [put(seed)], [put(found)]
    frontier = reread(spark, seed.schema, levels)
    depth = 0
    while high is None or depth < high:
        depth += 1
        seen = reread(spark, seed.schema, levels).select("start", "node")
        levels.append(put(_next(frontier, steps, True).join(seen, ["start", "node"], "left_anti").select(*seed.columns)))
        frontier = reread(spark, seed.schema, levels[-1:])
        if frontier.isEmpty():
            break
        left = still().withColumnRenamed("start", "from")
        hits.append(put(frontier.join(left, (F.col("start") == F.col("from")) & (F.col("node") == F.col("target"))).select("start", "target", "nodes", "rels")))
        before, open_ = open_, put(still().join(reread(spark, found.schema, hits[-1:]).select("start", "target"), ["start", "target"], "left_anti"))
        forget(spark, before)
        if still().isEmpty():
            break
        frontier = frontier.join(still().select("start").dropDuplicates(), "start", "left_semi").select(*seed.columns)
    forget(spark, open_, *levels)
    return reread(spark, found.schema, hits)


def cheapest(pairs_or_starts: DataFrame, steps: DataFrame, target: int | None = None, path: bool = True) -> DataFrame:
    """Relaxation (Bellman-Ford over joins) for non-negative weights.

    steps: eid, a, b, w. Returns (start, node, cost[, nodes, rels]): the least cost of every
    node reached; paths are carried only where asked for. With a target, paths that already
    cost more than the best one to it are not extended. A round keeps narrow rows, and the
    files of the round before go.
    """
    spark = pairs_or_starts.sparkSession
    seed = pairs_or_starts.select("start").dropDuplicates().select("start", F.col("start").alias("node"), F.lit(0.0).alias("cost"), F.lit(1).alias("fresh"))
    if path:
        seed = seed.withColumns({"rels": F.array().cast("array<bigint>"), "nodes": F.array("start")})
    cols = seed.columns
    at = put(seed)
    while True:
        best = reread(spark, seed.schema, [at])
        changed = best.filter("fresh = 1")
        if changed.isEmpty():
            return best.drop("fresh")
        if target is not None:
            limit = best.filter(F.col("node") == target).groupBy("start").agg(F.min("cost").alias("limit"))
            changed = changed.join(limit, "start", "left").filter("limit is null or cost < limit").drop("limit")
        moved = changed.join(steps, F.col("node") == F.col("a")).filter(F.col("b") != F.col("start"))
        longer = [F.concat("rels", F.array("eid")).alias("rels"), F.concat("nodes", F.array("b")).alias("nodes")] if path else []
        offers = moved.select("start", F.col("b").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), F.lit(1).alias("fresh"), *longer)
        # one pass keeps the cheapest of what is known and what is offered; what is known wins ties
        both = best.withColumn("fresh", F.lit(0)).select(*cols).unionAll(offers)
        one = both.groupBy("start", "node").agg(F.min(F.struct(*cols[2:])).alias("m")).select("start", "node", *[f"m.{c}" for c in cols[2:]])
        before, at = at, put(one)
        forget(spark, before)
