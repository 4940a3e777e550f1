"""A corpus pipeline of five operators; each stage's output is the next one's documents.

Part of the ``llm`` subpackage. Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import bpe, lang_id, mixing, ngram_join, quality
from weft.llm.common import drop_stored, stored, table
from weft.llm.queries import model_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least posterior of the predicted language.
MIN_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go."""
    samples = lang_id.samples_of(docs.filter(~lang_id.held_out()))
    found = lang_id.identify(docs, samples)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select(*docs.columns)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a selected cutoff reject go."""
    narrow = quality.measure(docs, keep=["doc_id"])
    thresholds = quality.select_thresholds(narrow, table(spark, sf_dir, "labels"))
    return quality.judge(quality.measure(docs), thresholds).filter("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the least doc_id (null
    last), then of the least set of shingles and text. Rows that share a null or repeated
    doc_id are copies only if their texts are near. Documents without words have no
    copies but rows of the same id; those of a null id all stay."""
    found = ngram_join.grouped(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "node", "text_hash"))
    kept = found.filter(F.col("comp").isNotNull()).groupBy("comp").agg(first.alias("first")).select("first.doc_id", "first.text_hash")
    blank = found.filter(F.col("comp").isNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("text_hash").alias("text_hash"))
    kept = kept.unionByName(blank).select(F.col("doc_id").alias("__kept"), F.col("text_hash").alias("__kept_text"))
    own = docs.withColumn("__text", ngram_join.text_hash("text"))
    own = own.join(kept, F.col("doc_id").eqNullSafe(F.col("__kept")) & (F.col("__text") == F.col("__kept_text")), "left_semi")
    unnamed = docs.filter(F.col("doc_id").isNull() & (mixing.word_count(F.col("text")) == 0))
    return own.dropDuplicates(["doc_id", "__text"]).select(*docs.columns).unionByName(unnamed)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, in the order of training."""
    return mixing.materialise(mixing.mix(docs, keep=docs.columns), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and digests of what they decode to."""
    return bpe.round_trip(docs, model_path())


STAGES = [("language", language), ("quality", rules), ("near_duplicates", near_duplicates), ("mixture", mixture), ("tokens", tokens)]

#: SQL can't express the language model, the joins' verification or BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        if k:
            drop_stored(before)
    return STAGES[-1][1](spark, docs, sf_dir)
