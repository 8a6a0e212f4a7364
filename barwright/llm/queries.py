"""Registered queries of the corpus operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.llm import op1_pivots, op2_minmax, op3_html, op4_pii, op5_chat, op6_packing, op7_toxicity, op8_repeats, op9_quality, op10_pieces

BYTE_TOKENIZER, PIECE_MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_pivots.top_k(_table(spark, sf_dir, "embeddings"))


def op2_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_minmax.near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=85)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_html.extract(_table(spark, sf_dir, "pages"))


def op4_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_pii.digests(op4_pii.find_spans(_table(spark, sf_dir, "documents")))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return op5_chat.digests(op5_chat.format_chats(rows))


def op6_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path(BYTE_TOKENIZER))


def op7_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_repeats.digests(_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_quality.quality(_table(spark, sf_dir, "documents"))


def op10_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_pieces.digests(_table(spark, sf_dir, "documents"), tokenizer_path(PIECE_MODEL))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_pivot_search, op2_minmax_near_dedup, op3_html_extraction, op4_pii_spans, op5_chat_format, op6_bin_packing, op7_toxicity_scores, op8_suffix_dedup, op9_quality_rules, op10_piece_round_trip)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_pivot_search": OP1_SQL, "op5_chat_format": OP5_SQL}


OP1_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r AS q, q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.r <> q.r AND len(c.e) = len(q.e)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP5_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT *, row_number() OVER w AS n, lag(role) OVER w AS before,
    length(regexp_replace(regexp_replace(regexp_replace(text, '\\', '\\\\', 'g'), '<(/?s>|/?INST|/?TURN|\|)', '<\\\1', 'g'), '\[(/?s>|/?INST|/?TURN|\|)', '[\\\1', 'g')) AS size,
    length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(role, '\\', '\\\\', 'g'), '<(/?s>|/?INST|/?TURN|\|)', '<\\\1', 'g'), '\[(/?s>|/?INST|/?TURN|\|)', '[\\\1', 'g'), '\]', '\\]', 'g')) AS role_size
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size + CASE WHEN before IS NOT DISTINCT FROM role AND n > 1 THEN 7 ELSE 9 + role_size + 2 + 5 END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
