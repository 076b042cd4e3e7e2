"""Candidate summaries and model predictions as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.sources.json_objects import json_rows

SUMMARY = (
    "node_id long, variant_key string, v_pos int, v_type string, v_ref string, v_alt string, alt_allele_count int, ref_allele_count_at_locus int, other_allele_count_at_locus int, coverage_at_locus int, "
    "alt_allele_frequency double, mean_alt_allele_base_quality double, shard_index int, index_within_shard int"
)


def write_summary(rows: DataFrame, path: str) -> None:
    """JSON lines; frequency and quality are rounded here only."""
    rows.withColumn("alt_allele_frequency", F.round("alt_allele_frequency", 4)).withColumn("mean_alt_allele_base_quality", F.round("mean_alt_allele_base_quality", 2)).write.json(path)


def read_summary(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.schema(SUMMARY).option("mode", "DROPMALFORMED").json(path)


def shard_of(path: Column, last: bool = True) -> Column:
    """Shard number of a file name: after ``shard``, else its last (or first) integer."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    named = F.nullif(F.regexp_extract(name, r"(?i)shard[_-]?(\d+)", 1), F.lit(""))
    every = F.regexp_extract_all(name, F.lit(r"(\d+)"), F.lit(1))
    return F.coalesce(named, F.try_element_at(every, F.lit(-1 if last else 1))).try_cast("int")


def true_probability(probs: Column, pred_class: Column, pred_prob: Column) -> Column:
    """Probability of class ``true`` in any case; else that of the predicted class, turned around if it is another."""
    lowered = F.map_filter(F.transform_keys(probs, lambda k, _: F.lower(k)), lambda k, _: k == "true")
    return F.coalesce(F.element_at(lowered, "true"), F.when(F.lower(pred_class) == "true", pred_prob).otherwise(1 - pred_prob))


def read_predictions(spark: SparkSession, path: str, last: bool = True) -> DataFrame:
    """shard_index, index_within_shard, pred_class, p_true of JSON files in any layout; broken records cost themselves only."""
    rows = json_rows(spark, "shard_path string, index_in_shard int, pred_class string, probs map<string,double>, pred_prob double", path, "shard_path")
    return rows.select(shard_of(F.col("shard_path"), last).alias("shard_index"), F.col("index_in_shard").alias("index_within_shard"), "pred_class", true_probability(F.col("probs"), F.col("pred_class"), F.col("pred_prob")).alias("p_true"))
