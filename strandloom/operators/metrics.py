"""Evaluation metrics and label statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions.cigar import cigar_walk


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _scores(rows: DataFrame, label: int) -> DataFrame:
    tp, fp = F.count_if((F.col("label") == label) & (F.col("pred") == label)), F.count_if((F.col("label") != label) & (F.col("pred") == label))
    fn, n = F.count_if((F.col("label") == label) & (F.col("pred") != label)), F.count(F.lit(1))
    return rows.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), (n - tp - fp - fn).alias("tn"), _ratio(F.count_if(F.col("label") == F.col("pred")), n).alias("accuracy"))


def class_metrics(rows: DataFrame) -> DataFrame:
    """Confusion counts, precision, recall and F1 of class 1, per-class and overall accuracy of (label, pred)."""
    m = _scores(rows, 1)
    return m.select(
        "tp", "fp", "fn", "tn", _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), _ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), _ratio(F.col("tn"), F.col("tn") + F.col("fp")).alias("accuracy_0"), _ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("accuracy_1"), "accuracy",
    )


def class_metrics_avg(rows: DataFrame) -> DataFrame:
    """Macro and support-weighted precision, recall and F1 over the classes seen as labels or predictions."""
    pairs = rows.groupBy("label", "pred").agg(F.count(F.lit(1)).alias("n"))
    each = pairs.select(F.explode(F.array(F.struct(F.col("label").alias("c"), F.lit(1).alias("is_label")), F.struct(F.col("pred").alias("c"), F.lit(0).alias("is_label")))).alias("x"), "label", "pred", "n").select("x.*", "label", "pred", "n")
    per = each.groupBy("c").agg(
        F.sum(F.when((F.col("is_label") == 1) & (F.col("label") == F.col("pred")), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("is_label") == 1, F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(F.col("is_label") == 0, F.col("n")).otherwise(0)).alias("predicted")
    )
    per = per.select("support", _ratio(F.col("tp"), F.col("predicted")).alias("precision"), _ratio(F.col("tp"), F.col("support")).alias("recall"), _ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"))
    weighted = [_ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")]
    return per.agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")], *weighted)


def prediction_report(rows: DataFrame) -> DataFrame:
    """(outcome, key, n): each row's outcome, true or false positive or negative, and how many rows have it."""
    outcome = F.when(F.col("pred") == 1, F.when(F.col("label") == 1, "TP").otherwise("FP")).otherwise(F.when(F.col("label") == 1, "FN").otherwise("TN"))
    told = rows.select(outcome.alias("outcome"), "key")
    return told.join(F.broadcast(told.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))), "outcome")  # four rows


def fp_overlap(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """False positives that are, and aren't, in a list, and the rate."""
    fp = rows.where("pred = 1 AND label = 0").select("key").distinct().join(listed.select("key", F.lit(1).alias("hit")).distinct(), "key", "left")
    return fp.agg(F.count("hit").alias("overlap"), F.count_if(F.col("hit").isNull()).alias("rest"), _ratio(F.count("hit"), F.count(F.lit(1))).alias("rate"))


def label_distribution(rows: DataFrame) -> DataFrame:
    """Label counts and shares overall (null shard) and per shard."""
    counts = rows.groupingSets([[F.col("label")], [F.col("shard_index"), F.col("label")]], F.col("shard_index"), F.col("label")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("shard_index")))


def candidate_sites(bases: DataFrame, min_count: int = 2, min_af: float = 0.05) -> DataFrame:
    """Per chromosome: sites with coverage and SNV candidate sites, from base rows (chrom, pos, ref, base)."""
    alts = bases.groupBy("chrom", "pos", "ref", "base").agg(F.count(F.lit(1)).alias("n"))
    sites = alts.groupBy("chrom", "pos").agg(F.sum("n").alias("depth"), F.max(F.when(F.col("base") != F.col("ref"), F.col("n")).otherwise(0)).alias("alt"))
    hit = (F.col("alt") > min_count) & (F.col("alt") / F.col("depth") > min_af)
    return sites.groupBy("chrom").agg(F.count(F.lit(1)).alias("sites"), F.count_if(hit).alias("snv_sites"))


def indel_anchors(reads: DataFrame) -> DataFrame:
    """(chrom, pos 1-based, kind): the aligned base before each insertion (INS) and deletion (DEL) of reads (r_chrom, r_start 0-based, ops)."""
    rows = reads.select("r_chrom", cigar_walk(F.col("ops"), F.col("r_start")).alias("walk"))
    behind = "filter(walk, (w, i) -> w.op IN ('I', 'D') AND i > 0 AND get(walk, i - 1).op IN ('M', 'X', '='))"
    return rows.select(F.col("r_chrom").alias("chrom"), F.expr(f"explode({behind})").alias("w")).select("chrom", F.col("w.node_pos").cast("long").alias("pos"), F.when(F.col("w.op") == "I", "INS").otherwise("DEL").alias("kind"))


def candidate_kinds(bases: DataFrame, indels: DataFrame, min_count: int = 2, min_af: float = 0.05) -> DataFrame:
    """Per chromosome: sites with depth, and those with SNV, INS, DEL and any evidence; bases are (chrom, pos, ref, base), indels as ``indel_anchors`` gives them.

    Depth and mismatches count bases A, C, G and T where the reference has one of them; each kind needs more than ``min_count`` reads and
    more than ``min_af`` of the depth.
    """
    plain = bases.where("upper(ref) IN ('A', 'C', 'G', 'T') AND upper(base) IN ('A', 'C', 'G', 'T')")
    sites = plain.groupBy("chrom", "pos").agg(F.count(F.lit(1)).alias("depth"), F.count_if(F.upper("base") != F.upper("ref")).alias("snv"))
    found = indels.groupBy("chrom", "pos").agg(F.count_if(F.col("kind") == "INS").alias("ins"), F.count_if(F.col("kind") == "DEL").alias("del"))
    sites = sites.join(found, ["chrom", "pos"], "left")
    is_kind = {k: (F.coalesce(k, F.lit(0)) > min_count) & (F.coalesce(k, F.lit(0)) / F.col("depth") > min_af) for k in ("snv", "ins", "del")}
    counts = [F.count_if(hit).alias(f"{k}_sites") for k, hit in is_kind.items()]
    return sites.groupBy("chrom").agg(F.count(F.lit(1)).alias("sites"), *counts, F.count_if(is_kind["snv"] | is_kind["ins"] | is_kind["del"]).alias("any_sites"))
