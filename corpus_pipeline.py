"""A corpus pipeline over `documents`: toxic documents go, near duplicates go but one, repeated passages go but the first,
personal data is replaced, and what stays is packed into training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents. A stage
judges its own input only. Documents that lose their whole text stay as empty rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.llm import op2_minmax, op4_pii, op6_packing, op7_toxicity, op8_repeats
from barwright.llm.queries import BYTE_TOKENIZER, tokenizer_path
from barwright.llm.store import saved


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars of the texts as they are now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = op7_toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return op7_toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose document isn't its group's first go; of rows that are equal in id and text one stays."""
    found = op2_minmax.near_duplicates(docs, words=5, percent=80).where(~F.col("kept"))
    found = saved(found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct())
    gone = (F.col("doc_id").cast("long") == F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__hash"))
    once = docs.where("doc_id IS NOT NULL").join(found, gone, "left_anti").dropDuplicates(["doc_id", "text"])
    return once.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(op8_repeats.remove_repeats(docs))


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(op4_pii.sanitise(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op6_packing.pack(docs, tokenizer_path(BYTE_TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", drop_repeats),
    ("private_data", replace_private),
    ("packing", pack_sequences),
]

#: Near-duplicate search, repeated passages and packing are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's result is a table in the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
