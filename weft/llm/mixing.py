"""Mixing sources to target weights along a curriculum (DataFrame functions only).

1. Sizes (words) per source; the shares of the mix are weighted, capped at ``CAP`` times
   a source's size, and the excess goes to the others by weight until none is above:
   the level at which the capped shares add up to the total is found with running sums
   over the sources, sorted by where they reach their cap.
2. Every source has a weight schedule over training time t in [0, 1]: its weight times
   ``1 + slope * (2t - 1)``, whose integral is the weight. The integral of the schedule is
   the source's cumulative demand in words.
3. A source's documents stand in the order of a hash of their id, over and over: a
   document's first word has the cumulative offset ``before`` in each pass. Demand is
   inverted at the offset: the time at which the mix reaches that word. Documents are
   range-sorted by it.
4. A pass is taken as far as the target reaches; the document in which it ends is taken in
   part, so a source's taken words add up to its target, rounded down.

Running sums of a source run in two steps, over hash ranges and then within them, so a
source with most of the rows isn't sorted in one task.

Defined results: a null text has size 0; the null source is a source, the last one; a
source without words has target 0; no words at all: all targets 0; rows that share
a null or repeated id tie by size, then by a hash of the text; repeated rows are separate documents. Reruns give equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import WORD_SQL, parts_for

WEIGHTS = (3.0, 1.0, 2.0)
#: Slopes of the schedules, repeating like the weights: late, even, early.
SLOPES = (0.5, 0.0, -0.5)
SHARE, CAP = 1.5, 2
RANGES = 256  # least number of hash ranges a source is split into; large tables take more


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_SQL)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """sizes: source, source_size (a row per source). Adds rank, weight and target."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    everything = Window.partitionBy()
    # sources in the order in which a rising level fills them
    order = Window.orderBy(F.col("most") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("all_words", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("full", F.coalesce(F.sum("most").over(order), F.lit(0.0)))
        .withColumn("full_weight", F.coalesce(F.sum("weight").over(order), F.lit(0.0)))
        .withColumn("level", (F.col("all_words") - F.col("full")) / (F.col("all_weight") - F.col("full_weight")))
        # the level is right at the first source that it doesn't fill
        .withColumn("level", F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level")))
        .withColumn("level", F.min_by("level", F.when(F.col("level").isNotNull(), F.struct(F.col("most") / F.col("weight"), F.col("rank")))).over(everything))
    )
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("level") * F.col("weight")))
    return rows.select("source", "source_size", "rank", "weight", target.cast("double").alias("target"))


def _time(offset: Column, target: Column, slope: Column) -> Column:
    """The t at which the integral of target * (1 + slope * (2t - 1)) reaches the offset."""
    y = F.least(F.lit(1.0), offset / target)
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * y)
    return F.when(target > 0, F.when(F.abs(slope) < 1e-9, y).otherwise(F.greatest(F.lit(0.0), (root - (1 - slope)) / (2 * slope))))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES, share: float = SHARE, cap: int = CAP, keep: list[str] = ()) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, taken, before,
    slope, position (null if nothing is taken), and ``kept``, a struct of the columns to keep,
    whose names may be any."""
    held = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")] if keep else []
    d = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64(F.col("text")).alias("tie"), *held)
    # ranges are the hash's first bits: how many there are changes no result
    bits = max(RANGES, parts_for(docs)).bit_length() - 1
    own_range = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - bits).cast("int").alias("range")
    d = d.withColumns({"hash": F.xxhash64("doc_id"), "range": own_range})
    ranges = docs.select(F.col("source").cast("string").alias("source"), own_range, word_count(F.col("text")).alias("size")).groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    plan = targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, cap)
    by_range = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    plan = ranges.withColumn("range_before", F.coalesce(F.sum("range_size").over(by_range), F.lit(0))).alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source"))).select("r.source", "range", "range_before", "source_size", "rank", "target")
    within = Window.partitionBy("source", "range").orderBy("hash", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    both = d.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.range") == F.col("p.range")))
    slope = F.element_at(F.array(*map(F.lit, slopes)), (F.col("rank") % len(slopes) + 1).cast("int"))
    reach = F.floor("target")
    part = lambda k: F.greatest(F.lit(0), F.least(F.col("size"), reach - F.col("before") - k * F.col("source_size")))
    out = both.select("doc_id", "d.source", "size", "source_size", "target", "rank", (F.col("range_before") + F.col("inner")).alias("before"), *(["d.kept"] if keep else []))
    out = out.withColumn("taken", sum((part(k) for k in range(1, cap)), part(0)).cast("long"))
    out = out.withColumn("slope", slope).drop("rank")
    return out.withColumn("position", F.when(F.col("taken") > 0, _time(F.col("before"), F.col("target"), F.col("slope"))))


def range_sorted(mixed: DataFrame) -> DataFrame:
    """In the order of training; documents that aren't taken come last."""
    n = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col("position").asc_nulls_last(), F.col("doc_id").asc_nulls_last()]
    return mixed.repartitionByRange(n, *keys).sortWithinPartitions(*keys)


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, as it stands."""
    words = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # each with the white space before it
    return F.array_join(F.slice(words, F.lit(1), n.cast("int")), "")


def materialise(mixed: DataFrame, columns: list[str], cap: int = CAP) -> DataFrame:
    """A document for each time that it is taken, in the order of training: by the time at
    which its source's demand reaches its first word in that pass. What is taken in part is
    cut after its last word that is taken. columns: those of ``mix(keep=...)``, text among them."""
    passes = mixed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(cap - 1)))).withColumn("words", F.least(F.col("size"), F.floor("target") - F.col("before") - F.col("pass") * F.col("source_size"))).filter(F.col("words") > 0)
    at = _time(F.col("before") + F.col("pass") * F.col("source_size"), F.col("target"), F.col("slope"))
    parted, own = F.col("words") < F.col("size"), lambda c: F.col("kept")[c]
    cut = passes.withColumn("position", at).withColumn("text", F.when(parted, first_words(own("text"), F.col("words"))).otherwise(own("text")))
    made = {"text": F.col("text"), "n_chars": F.when(parted, F.length("text").cast("long")).otherwise(own("n_chars")) if "n_chars" in columns else None}
    return range_sorted(cut).select(*[(made[c] if c in made else own(c)).alias(c) for c in columns])
