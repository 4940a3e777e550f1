"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import bpe, chat_format, lang_id, mixing, ngram_join, quality, repair, topk_search, toxicity, url_filter
from weft.llm.common import stored, table

MODEL = "word_bpe_49k.json"
END_ID = 2

RULES = [
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    samples = lang_id.samples_of(docs.filter(~lang_id.held_out()))
    found = lang_id.identify(docs, samples, keep=["doc_id"])
    return found.select("doc_id", lang_id.held_out().alias("held_out"), "lang_pred", "score")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.range_sorted(mixing.mix(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "position")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.token_files(table(spark, sf_dir, "documents"), model_path(), END_ID)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), model_path())


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a row of numbers for each document, written once: thresholds and verdicts read no text again
    measured = stored(quality.measure(table(spark, sf_dir, "documents"), keep=["doc_id"]))
    thresholds = quality.select_thresholds(measured, table(spark, sf_dir, "labels"))
    return quality.judge(measured, thresholds).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~toxicity.held_out()).select("doc_id", "toxic")
    model = toxicity.train(docs, labels)
    found = toxicity.score(docs, model, keep=["doc_id"])
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planted rows belong to conversation -7; rows that bear this id already are part of it."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    planted = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", planted), (-7, 1, "assistant", planted)], "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.format_chats(rows.unionByName(more)))


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", topk_search.quantised(F.col("embedding")).alias("v"))
    return topk_search.top_k(rows, rows.filter(F.col("vec_id") % 50 == 0), 5)


def queries() -> dict:
    own = (op1_ngram_join, op2_language_id, op3_mixing, op4_token_files, op5_bpe, op6_quality, op7_url_filter, op8_toxicity, op9_chat_format, op10_topk_search)
    return {f.__name__: f for f in own}


_URL_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r(action, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (SELECT p.page_id, host, path, rhost || rpath AS rule, action, length(rhost || rpath) AS n
      FROM p LEFT JOIN r ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath)),
k AS (SELECT *, max(n) OVER (PARTITION BY page_id) AS top FROM m)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM k WHERE n = top OR top IS NULL
"""

_TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT * FROM v WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.v, v.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))) AS BIGINT) AS score
      FROM q JOIN v ON q.vec_id <> v.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

def oracle_sql() -> dict[str, str]:
    return {"op7_url_filter": _URL_SQL, "op10_topk_search": _TOPK_SQL}
