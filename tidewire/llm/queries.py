"""The registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import filter_audit, language_model, line_rules, neighbours, pii, quality, secrets, source_audit, toxicity
from .common import fold, read
from .decontaminate import locate
from .packing import pack
from .simhash import near_duplicates
from .token_files import token_index, write_token_files


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = fold(F.col("doc_id"), 4) == 2
    weights = toxicity.fit(docs, labels, ~held_out)
    return toxicity.score(docs, weights).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("sentences").alias("n_offending"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = fold(F.col("doc_id"), 5) == 0
    weights = quality.fit(docs, labels, ~held_out)
    return quality.score(docs, weights).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op3_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge(read(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.summary(secrets.find(read(spark, sf_dir, "documents")))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_index(spark, write_token_files(read(spark, sf_dir, "documents")))


def op7_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = locate(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"), carry=["doc_id"])
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["item_id"], s["start"], s["end"], s["edits"])), ",")
    return found.select("doc_id", (F.size("spans") > 0).alias("contaminated"), F.size("spans").alias("n_spans"), F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["item_id"]))).alias("item_ids"), spans.alias("spans"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(pii.find(read(spark, sf_dir, "documents")))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(read(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5) == 1)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(read(spark, sf_dir, "documents"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_simhash, op3_line_rules, op4_secrets, op5_quality, op6_token_files, op7_best_two_fit, op8_decontaminate, op9_pii, op10_language_model, op11_filter_audit, op12_source_divergence, op13_neighbours)}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_rules": line_rules.SQL, "op11_filter_audit": filter_audit.SQL, "op12_source_divergence": source_audit.SQL}
