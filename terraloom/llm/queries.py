"""Queries of this subpackage for the driver; each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary, counts, decontaminate, language_model, licenses, mixing, neardup, neighbours, periods, pii, quality, repeats, search

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(_table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_table(_table(spark, sf_dir, "documents")).select("doc_id", "n_tokens")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed(_table(spark, sf_dir, "documents")).drop("spans")


def op8_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.encode_table(_table(spark, sf_dir, "documents"))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogates(_table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def _with_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; a tenth of the texts, told by the crc32 of their doc_id, repeat a phrase from some word on to the end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", (h % 10 == 0).alias("planted"), F.floor(h / 10).alias("g"))
    rows = rows.withColumn("w", F.when(F.col("planted"), F.regexp_extract_all("text", F.lit("([^\\x20\\x09-\\x0D]+)"))))
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.element_at("w", (F.col("a") + (i - F.col("a")) % F.col("p") + 1).cast("int"))))
    return rows.select("doc_id", F.when(F.col("planted") & (F.col("n") > 0), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digest(periods.runs(_with_runs(_table(spark, sf_dir, "documents"))))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = _table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 3
    model = neighbours.fit(docs, _table(spark, sf_dir, "labels").where(fold != 1))
    return neighbours.score(docs, model).select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_ngram_jaccard_join, op2_lm_scoring, op3_quality_rules, op4_decontamination, op5_token_counts, op6_mixing, op7_suffix_array_dedup, op8_binary_output, op9_pii_surrogates, op10_license_scan, op11_periodic_runs, op12_lexical_search, op13_quality_classifier)
}
