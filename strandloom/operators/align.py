"""Alignments to mappings, node statistics and alignment statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.cigar import cigar_ops, edit_letter, edits_to_cigar, mapping_is_perfect, summed
from strandloom.operators.ranks import exact_median, lists_in_parts


def mapq_gate(df: DataFrame, least: int, column: str = "mapping_quality") -> DataFrame:
    """Rows of at least this mapping quality; the gate differs by use, so it is never a constant here."""
    return df.where(F.col(column) >= least)


def on_reference_path(reads: DataFrame, name: str) -> DataFrame:
    return reads.where(F.exists("refpos", lambda r: r["name"] == name))


def explode_mappings(reads: DataFrame) -> DataFrame:
    """One row per read and mapping with its part of the read; node 0 is left out but its bases count."""
    lengths = F.transform("path.mapping", lambda m: F.aggregate(m["edit"], F.lit(0), lambda t, e: t + e["to_length"]))
    ends = F.aggregate("lengths", F.array(F.lit(0)), lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n)))
    quality = F.col("quality") if "quality" in reads.columns else F.lit(None).cast("binary")
    # each mapping takes its own part of the read along, so that neither read nor path rides on every row
    own = F.transform("path.mapping", lambda m, i: F.struct(m.alias("m"), F.get("ends", i).alias("read_offset"), F.get("lengths", i).alias("read_length"), F.col("sequence").substr(F.get("ends", i) + 1, F.get("lengths", i)).alias("bases"), F.substring(quality, F.get("ends", i) + 1, F.get("lengths", i)).alias("quality")))
    steps = reads.withColumn("lengths", lengths).withColumn("ends", ends).select("name", "mapping_quality", "identity", F.posexplode(own).alias("map_no", "own"))
    rows = steps.select(
        "name", "mapping_quality", "identity", "map_no", F.col("own.m.position.node_id").alias("node_id"), F.col("own.m.position.offset").alias("offset"),
        F.col("own.m.position.is_reverse").alias("is_reverse"), F.col("own.m.edit").alias("edits"), "own.read_offset", "own.read_length", "own.bases", "own.quality",
    )
    return rows.where("node_id <> 0")


def with_cigar(mappings: DataFrame) -> DataFrame:
    return mappings.withColumn("cigar", edits_to_cigar(F.col("edits"))).withColumn("perfect", mapping_is_perfect(F.col("edits")))


def node_stats(reads: DataFrame, min_mapq: int = 6, chrom: str | None = None) -> DataFrame:
    """Perfect and imperfect mappings, longest read part and longest CIGAR text of each node; folds map-side."""
    kept = mapq_gate(reads, min_mapq)
    kept = on_reference_path(kept, chrom) if chrom else kept
    rows = with_cigar(explode_mappings(kept))
    return rows.groupBy("node_id").agg(
        F.count_if("perfect").alias("perfect"), F.count_if(~F.col("perfect")).alias("not_perfect"), F.max("read_length").alias("max_read_length"), F.max(F.length("cigar")).alias("max_cigar_length")
    )


def imperfect_nodes(stats: DataFrame, share: float = 0.05, least: int = 1) -> DataFrame:
    total = F.col("perfect") + F.col("not_perfect")
    return stats.where((total > 0) & (F.col("not_perfect") >= least) & (F.col("not_perfect") / total > share))


def scan_totals(reads: DataFrame, min_mapq: int = 6) -> DataFrame:
    """Reads, mappings of either kind, and their percentages of reads (which may exceed 100)."""
    kept = mapq_gate(reads, min_mapq)
    n = kept.agg(F.count(F.lit(1)).alias("reads"))
    kinds = with_cigar(explode_mappings(kept)).agg(F.count_if("perfect").alias("perfect"), F.count_if(~F.col("perfect")).alias("imperfect"))
    percent = [F.coalesce(F.try_divide(F.col(c) * 100.0, F.col("reads")), F.lit(0.0)).alias(f"{c}_percent") for c in ("perfect", "imperfect")]
    return n.join(F.broadcast(kinds)).select("reads", "perfect", "imperfect", *percent)  # one row each


def imperfect_reads(reads: DataFrame) -> DataFrame:
    """Under each touched node, the names of reads whose identity isn't 1, in ordered parts (``part``)."""
    return lists_in_parts(explode_mappings(reads.where("identity <> 1.0")), ["node_id"], "name", "names")


def segments_on_nodes(mappings: DataFrame, wanted: DataFrame) -> DataFrame:
    return mappings.join(wanted.select("node_id").distinct(), "node_id", "left_semi")


def reads_on_nodes(reads: DataFrame, wanted: DataFrame, min_mapq: int = 0) -> DataFrame:
    """Distinct names of reads that touch a wanted node."""
    return segments_on_nodes(explode_mappings(mapq_gate(reads, min_mapq)), wanted).select("name").distinct()


def reads_on_path(reads: DataFrame, steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each node of a path, in order: its length and the sorted names of the reads on it, in ordered parts (``part``)."""
    on_path = segments_on_nodes(explode_mappings(reads), steps)
    touched = lists_in_parts(on_path, ["node_id"], "name", "names")
    return steps.select("step", "node_id").join(nodes.select("node_id", "length"), "node_id").join(touched, "node_id")


def align_stats_graph(reads: DataFrame) -> DataFrame:
    """Totals over reads and bases per kind of edit. A read without mappings counts as perfect; insertions also count as soft clips."""
    edits = F.flatten(F.transform("path.mapping", lambda m: m["edit"]))

    def bases(letter: str, field: str) -> Column:
        return F.aggregate("edits", F.lit(0), lambda s, e: s + F.when(edit_letter(e) == letter, e[field]).otherwise(0))

    rows = reads.select(F.coalesce(edits, F.array()).alias("edits"), F.size("path.mapping").alias("n"))
    rows = rows.select(
        "n", F.forall("edits", lambda e: F.coalesce(edit_letter(e) == "M", F.lit(False))).alias("perfect"),
        F.forall("edits", lambda e: F.coalesce(edit_letter(e).isin("M", "X"), F.lit(False))).alias("gapless"),
        bases("M", "to_length").alias("match"), bases("X", "to_length").alias("mismatch"), bases("I", "to_length").alias("ins"), bases("D", "from_length").alias("del"),
    )
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("n") > 0).alias("aligned"), F.count_if("perfect").alias("perfect"), F.count_if("gapless").alias("gapless"), F.sum("match").alias("match_bp"),
        F.sum("mismatch").alias("substitution_bp"), F.sum("ins").alias("insertion_bp"), F.sum("del").alias("deletion_bp"), F.sum("ins").alias("softclip_bp"),
    )


def align_stats_linear(sam: DataFrame) -> DataFrame:
    """The same from SAM rows (flag, cigar, nm): secondary and supplementary rows are skipped, unmapped ones only counted.

    Substitutions come from NM less the indels; bases of X ops are added to that, as the source counts them.
    """
    rows = sam.where(F.expr("(flag & 2304) = 0")).withColumn("ops", cigar_ops(F.col("cigar"))).withColumn("mapped", F.expr("(flag & 4) = 0"))
    ins, dels, clip = (F.when(F.col("mapped"), summed(F.col("ops"), k)).otherwise(0) for k in ("I", "D", "S"))
    rows = rows.select("mapped", "nm", summed(F.col("ops"), "M=").alias("m"), summed(F.col("ops"), "X").alias("x"), ins.alias("ins"), dels.alias("del"), clip.alias("clip"))
    subst = F.when(F.col("mapped"), F.greatest(F.coalesce("nm", F.lit(0)) - F.col("ins") - F.col("del"), F.lit(0)) + F.col("x")).otherwise(0)
    rows = rows.withColumn("subst", subst)
    gapless = F.col("mapped") & (F.col("ins") == 0) & (F.col("del") == 0)
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("mapped").alias("aligned"), F.count_if(gapless & (F.col("subst") == 0) & (F.col("clip") == 0)).alias("perfect"), F.count_if(gapless).alias("gapless"),
        F.sum("subst").alias("substitution_bp"), F.sum("ins").alias("insertion_bp"), F.sum("del").alias("deletion_bp"), F.sum("clip").alias("softclip_bp"),
    )


def mapq_summary(df: DataFrame, column: str = "mapping_quality") -> DataFrame:
    """Mean, sample deviation (0 for one value), exact median and count."""
    c = F.col(column).cast("double")
    sd = F.when(F.count(c) == 1, 0.0).otherwise(F.stddev_samp(c))
    return df.agg(F.avg(c).alias("mean"), sd.alias("sd"), F.lit(exact_median(df, column)).cast("double").alias("median"), F.count(c).alias("n"))


def masked_segment(mappings: DataFrame) -> DataFrame:
    """Older segment text: substituted and inserted bases in lower case, other bases as they are; qualities as lower-case hex."""
    ends = F.aggregate(
        "edits", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, e: F.struct((s["at"] + e["to_length"]).alias("at"), F.concat(s["out"], F.when(edit_letter(e) == "M", F.substring(F.col("bases"), s["at"] + 1, e["to_length"])).otherwise(F.lower(F.substring(F.col("bases"), s["at"] + 1, e["to_length"])))).alias("out")),
        lambda s: s["out"],
    )
    return mappings.withColumn("masked", ends).withColumn("quality_hex", F.lower(F.hex("quality")))
