"""The corpus pipeline: language, near-duplicates, benchmark passages, mixture, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.llm import decontaminate, langid, mixing, neardup, sharding
from tracewell.llm.common import stored, table, text_key

#: Share of a document's letters that its language must have at least.
LANGUAGE_SHARE = 0.5
#: Per cent of shared shingles from which documents are near-duplicates.
SIMILARITY = 80


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of a language that is learned from the labelled ones; what has no letters or no main language goes."""
    out = langid.identify(docs, langid.fit(docs))
    return out.where((F.col("lang_pred") != langid.UND) & (F.col("score") >= LANGUAGE_SHARE)).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates, that with the smallest id (null is the largest), and of rows that are the same in id and text."""
    row = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("id"), text_key(F.col("text")).alias("text"))
    named = docs.withColumn("_row", row)
    kept = neardup.near_duplicates(named.select(F.col("_row").alias("doc_id"), "text"), SIMILARITY).where("kept").select(F.col("doc_id").alias("_row")).distinct()
    found = named.join(kept, named["_row"].eqNullSafe(kept["_row"]), "left_semi")
    first = F.row_number().over(Window.partitionBy("_row").orderBy(*[c for c in docs.columns if c not in ("doc_id", "text")], "doc_id"))
    return found.withColumn("_n", first).where("_n = 1").select(*docs.columns)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark passages by the contract's rule."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select(*docs.columns)


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it; documents that it doesn't take go."""
    mixed = mixing.mix(docs).where("copies > 0")
    return mixed.withColumn("_", F.explode(F.sequence(F.lit(1), "copies"))).select(*docs.columns)


def to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives each row its shard and slot; equal texts are linked."""
    return sharding.shard_documents(docs)


STAGES = [
    ("language", by_language),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmarks),
    ("mixture", to_weights),
    ("shards", to_shards),
]

#: Language identification can't be stated in SQL. Tests hold near-duplicates and decontamination against brute force, mixture and shards against their bounds.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = stored(docs) if k < len(STAGES) - 1 else docs
    return docs
