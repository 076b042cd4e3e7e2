"""Interval joins: both sides are dealt into bins of the contig, joined on equal bins and tested again.

Bins come in levels, each ``STEP`` times as wide as the one before. An interval's own level is the first whose bins are as long as it
is, so that it lies in at most two of them however long it is. Two intervals meet at the higher one's level, in the last first
bin of the two, so that each pair is made once. Only levels that the other side has are dealt out, for intervals of usual
lengths a single one. A bin of very many rows is a skewed key of a join, which adaptive execution splits over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.cigar import cigar_walk, summed
from strandloom.operators.ranks import lists_in_parts
from strandloom.session import materialize

BIN, STEP, LEVELS = 1_000, 8, 12


def _own_level(length: Column, width: int) -> Column:
    return sum(((length > width * STEP**k).cast("int") for k in range(1, LEVELS)), (length > width).cast("int"))


def _bins(rows: DataFrame, tag: str, level: Column, width: int) -> DataFrame:
    """``rows`` once for each bin that they touch at ``level``, with the first of them."""
    rows = rows.withColumn(f"__{tag}v", level)
    size = F.lit(float(width)) * F.pow(F.lit(float(STEP)), F.col(f"__{tag}v"))
    number = lambda c: F.floor(F.col(c) / size)
    rows = rows.withColumn(f"__{tag}f", number(f"__{tag}s"))
    return rows.withColumn(f"__{tag}b", F.explode(F.sequence(f"__{tag}f", F.greatest(F.floor((F.col(f"__{tag}e") - 1) / size), f"__{tag}f"))))


def overlap_join(left: DataFrame, right: DataFrame, lo: tuple[str, Column, Column], ro: tuple[str, Column, Column], how: str = "inner", width: int = BIN) -> DataFrame:
    """Pairs of rows with equal contig whose half-open intervals overlap; ``lo`` and ``ro`` are (contig column, start, end).

    ``width`` is that of the narrowest bins. ``how`` is inner, left, left_semi or left_anti. Column names of
    the two sides should differ, except that both may have the contig's.
    """

    def prepared(df: DataFrame, side: tuple[str, Column, Column], tag: str) -> DataFrame:
        contig, start, end = side
        rows = df.withColumn(f"__{tag}s", start).withColumn(f"__{tag}e", end).withColumn(f"__{tag}c", F.col(contig))
        return rows.withColumn(f"__{tag}o", _own_level(F.col(f"__{tag}e") - F.col(f"__{tag}s"), width))

    if how in ("left", "left_semi", "left_anti"):
        left = materialize(left.withColumn("__row", F.monotonically_increasing_id()), "overlap-left")  # the same row numbers on both uses
    l, r = prepared(left, lo, "l"), prepared(right, ro, "r")
    if ro[0] in left.columns:
        r = r.drop(ro[0])
    # at most LEVELS numbers a side
    on_left, on_right = (sorted(x[0] for x in df.select(f"__{t}o").distinct().collect() if x[0] is not None) for df, t in ((l, "l"), (r, "r")))

    def at_levels(rows: DataFrame, tag: str, levels: list[int], above: bool) -> DataFrame:
        own = F.col(f"__{tag}o")
        wanted = F.filter(F.array(*(F.lit(k) for k in levels)).cast("array<int>"), lambda k: k > own if above else k >= own)
        return _bins(rows, tag, F.explode(wanted), width)

    def met(l: DataFrame, r: DataFrame) -> DataFrame:
        pairs = l.join(r, (F.col("__lc") == F.col("__rc")) & (F.col("__lv") == F.col("__rv")) & (F.col("__lb") == F.col("__rb")))
        pairs = pairs.where((F.col("__ls") < F.col("__re")) & (F.col("__rs") < F.col("__le")) & (F.col("__lb") == F.greatest("__lf", "__rf")))
        return pairs.drop(*(f"__{t}{x}" for t in "lr" for x in "secofbv"))

    pairs = met(_bins(l, "l", F.col("__lo"), width), at_levels(r, "r", on_left, False))
    if on_left and on_right and on_right[-1] > on_left[0]:
        pairs = pairs.unionByName(met(at_levels(l, "l", on_right, True), _bins(r, "r", F.col("__ro"), width)))
    if how == "inner":
        return pairs
    rest = [c for c in pairs.columns if c not in left.columns]
    if how == "left":
        return left.join(pairs.select("__row", *rest), "__row", "left").drop("__row")
    return left.join(pairs.select("__row").distinct(), "__row", how).drop("__row")


def truth_label(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """Candidates (chrom, start, v_pos, v_type, v_ref, v_alt) with label 1 or 0, -1 without an anchor.

    They are looked up by their canonical key: a deletion lies at the base before it (at the node's first base where there
    is none, and then without its first base), an insertion's ALT begins with the base before it. The position is start +
    offset whatever the strand. Truth records, in capitals, that overlap the position or the next one are looked at: a
    deletion matches if its bases are within REF, an insertion if its REF is within REF and its ALT within an ALT, others
    if REF and an ALT are equal.
    """
    offset = F.expr("v_pos - IF(v_type = 'D' AND v_pos > 0, 1, 0)")
    calls = candidates.withColumn("__call", F.monotonically_increasing_id()).withColumn("genomic_position", F.col("start") + offset)
    calls = materialize(calls, "truth-calls")  # the same call numbers on both uses
    key_ref, key_alt = F.expr("upper(IF(v_type = 'D' AND v_pos <= 0, substring(v_ref, 2), v_ref))"), F.expr("upper(IF(v_type = 'I', concat(v_ref, v_alt), v_alt))")
    near = calls.where("chrom IS NOT NULL AND start IS NOT NULL").select("__call", "chrom", "genomic_position", "v_type", key_ref.alias("v_ref"), key_alt.alias("v_alt"))
    records = truth.select(F.col("chrom").alias("t_chrom"), F.col("pos").alias("t_pos"), F.upper("ref").alias("t_ref"), F.transform("alts", F.upper).alias("t_alts"))
    pos, t0 = F.col("genomic_position"), F.col("t_pos") - 1
    found = overlap_join(near, records, ("chrom", F.greatest(pos - 1, F.lit(0)), pos + 1), ("t_chrom", t0, t0 + F.length("t_ref")))
    match = F.expr("""CASE v_type WHEN 'D' THEN contains(t_ref, v_ref) WHEN 'I' THEN contains(t_ref, v_ref) AND exists(t_alts, a -> contains(a, v_alt)) ELSE t_ref = v_ref AND array_contains(t_alts, v_alt) END""")
    hits = found.where(match).select("__call").distinct().withColumn("hit", F.lit(1))
    label = F.when(F.col("start").isNull(), -1).otherwise(F.coalesce("hit", F.lit(0)))
    return calls.join(hits, "__call", "left").withColumn("label", label).drop("hit", "__call")


def nodes_with_variants(nodes: DataFrame, variants: DataFrame, start_is_one_based: bool = False) -> DataFrame:
    """Nodes (chrom, start, length) that overlap at least one variant, with the sorted hits.

    By default the start is used as if it were 0-based, as the source does.
    """
    start = F.col("start") - 1 if start_is_one_based else F.col("start")
    usable = nodes.where("start IS NOT NULL AND length > 0")
    v = variants.select("chrom", (F.col("pos") - 1).alias("v_start"), F.col("ref").alias("v_ref"), F.array_join("alts", ",").alias("v_alts"))
    found = overlap_join(usable, v, ("chrom", start, start + F.col("length")), ("chrom", F.col("v_start"), F.col("v_start") + F.length("v_ref")))
    return found.groupBy("node_id", "chrom").agg(F.array_sort(F.collect_list(F.struct("v_start", "v_ref", "v_alts"))).alias("variants"))


def nodes_in_bed(nodes: DataFrame, bed: DataFrame, start_is_one_based: bool = False) -> DataFrame:
    start = F.col("start") - 1 if start_is_one_based else F.col("start")
    regions = bed.select(F.col("chrom").alias("b_chrom"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    return overlap_join(nodes.where("length > 0"), regions, ("chrom", start, start + F.col("length")), ("b_chrom", F.col("b_start"), F.col("b_end")), "left_semi")


def regions_to_variants(regions: DataFrame, variants: DataFrame, keep_empty: bool = False) -> DataFrame:
    """Regions (region_id, chrom, start, length; both ends included) with their variants; invalid rows are skipped."""
    valid = regions.where("chrom IS NOT NULL AND start IS NOT NULL AND length > 0")
    v = variants.select(F.col("chrom").alias("v_chrom"), F.col("pos").alias("v_pos"), F.col("ref").alias("v_ref"))
    return overlap_join(valid, v, ("chrom", F.col("start"), F.col("start") + F.col("length") + 1), ("v_chrom", F.col("v_pos"), F.col("v_pos") + 1), "left" if keep_empty else "inner")


def reads_near_variant(variants: DataFrame, reads: DataFrame, flank: int = 200) -> DataFrame:
    """Per variant (chrom, pos 0-based), sorted names of reads (r_chrom, r_start, r_end, name) within ``flank``, in ordered parts (``part``)."""
    near = overlap_join(variants, reads, ("chrom", F.greatest(F.col("pos") - flank, F.lit(0)), F.col("pos") + flank), ("r_chrom", F.col("r_start"), F.col("r_end")))
    return lists_in_parts(near, ["chrom", "pos"], "name", "names")


def variants_to_nodes(variants: DataFrame, nodes: DataFrame, flank: int = 0) -> DataFrame:
    """Variants (chrom, pos, ref, kind) with the sorted nodes within ``flank`` of them; SNV and INS take one base, others their REF."""
    last = F.when(F.col("kind").isin("SNV", "INS"), F.col("pos")).otherwise(F.col("pos") + F.length("ref") - 1)
    spans = nodes.select(F.col("chrom").alias("n_chrom"), F.col("start").alias("n_start"), (F.col("start") + F.col("length")).alias("n_end"), "node_id")
    found = overlap_join(variants, spans, ("chrom", F.col("pos") - flank, last + 1 + flank), ("n_chrom", F.col("n_start"), F.col("n_end")))
    return found.groupBy("chrom", "pos", "ref", "kind").agg(F.array_sort(F.collect_set("node_id")).alias("node_ids")).withColumn("n_nodes", F.size("node_ids"))


def verify_alt_nodes(rows: DataFrame, stored: DataFrame, variants: DataFrame) -> DataFrame:
    """Rows (node_id, chrom, pos, alt) whose node is stored, and how many have a record in [pos - 1, pos + len(alt) + 1)."""
    kept = rows.join(stored.select("node_id").distinct(), "node_id", "left_semi")
    v = variants.select(F.col("chrom").alias("v_chrom"), (F.col("pos") - 1).alias("v_start"), F.length("ref").alias("v_len"))
    hit = overlap_join(kept, v, ("chrom", F.col("pos") - 1, F.col("pos") + F.length("alt") + 1), ("v_chrom", F.col("v_start"), F.col("v_start") + F.col("v_len")), "left_semi")
    total, hits = kept.agg(F.count(F.lit(1)).alias("checked")), hit.agg(F.count(F.lit(1)).alias("with_record"))
    return total.join(F.broadcast(hits)).withColumn("without_record", F.col("checked") - F.col("with_record"))  # one row each


def locus_counts(loci: DataFrame, reads: DataFrame) -> DataFrame:
    """Per locus (chrom, pos 1-based, ref, alt): depth, ref, alt, other and VAF from linear reads (r_chrom, r_start 0-based, r_end, bases)."""
    rows = overlap_join(loci, reads, ("chrom", F.col("pos") - 1, F.col("pos")), ("r_chrom", F.col("r_start"), F.col("r_end")))
    base = F.expr("substring(bases, int(pos - 1 - r_start) + 1, 1)")
    is_alt, is_ref = base == F.col("alt"), base == F.col("ref")
    counts = rows.groupBy("chrom", "pos", "ref", "alt").agg(F.count(F.lit(1)).alias("depth"), F.count_if(is_ref).alias("ref_count"), F.count_if(is_alt).alias("alt_count"), F.count_if(~is_alt & ~is_ref).alias("other_count"))
    return counts.withColumn("vaf", F.col("alt_count") / F.col("depth"))


def indel_counts(loci: DataFrame, reads: DataFrame) -> DataFrame:
    """Per INS or DEL locus (chrom, pos 1-based, ref, alt): depth, ref and alt counts and VAF from reads (r_chrom, r_start 0-based, seq, ops).

    A read counts where its base at the anchor is aligned. An indel follows its anchor: it is the ALT's if it has its length and, inserted, its
    bases; reads without one there count as REF, others in depth only.
    """
    placed = reads.withColumn("walk", cigar_walk(F.col("ops"), F.col("r_start"))).withColumn("r_end", F.col("r_start") + summed(F.col("ops"), "MX=DN"))
    anchors = loci.where("length(ref) <> length(alt)").withColumn("at", (F.col("pos") - 1).cast("int"))
    rows = overlap_join(anchors, placed, ("chrom", F.col("at"), F.col("at") + 1), ("r_chrom", F.col("r_start"), F.col("r_end")))
    rows = rows.withColumn("nth", F.expr("array_position(transform(walk, w -> w.op IN ('M', 'X', '=') AND w.node_pos <= at AND at < w.node_pos + w.n), true)")).where("nth > 0")
    rows = rows.withColumn("over", F.expr("get(walk, int(nth) - 1)")).withColumn("behind", F.expr("IF(at = over.node_pos + over.n - 1, get(walk, int(nth)), NULL)")).withColumn("q", F.expr("over.read_pos + at - over.node_pos")).where("q < length(seq)")
    rows = rows.withColumn("indel", F.expr("CASE behind.op WHEN 'I' THEN behind.n WHEN 'D' THEN -behind.n ELSE 0 END"))
    is_alt = F.expr("indel = length(alt) - length(ref) AND (indel < 0 OR upper(substring(seq, q + 2, indel)) = upper(substring(alt, length(ref) + 1)))")
    counts = rows.groupBy("chrom", "pos", "ref", "alt").agg(F.count(F.lit(1)).alias("depth"), F.count_if(F.col("indel") == 0).alias("ref_count"), F.count_if(is_alt).alias("alt_count"))
    return counts.withColumn("vaf", F.col("alt_count") / F.col("depth"))


def lift_query_pos(queries: DataFrame, blocks: DataFrame, query_shift: int = 0) -> DataFrame:
    """Assembly positions (contig, q_pos) to reference positions through aligned blocks; the first alignment in file order wins.

    blocks: q_contig, q_start, q_end (half-open), op, r_chrom, r_pos, file_order. An insertion maps to its left anchor.
    ``query_shift`` is added to a position before it is looked up.
    """
    at = F.col("q_pos") + query_shift
    found = overlap_join(queries, blocks, ("contig", at, at + 1), ("q_contig", F.col("q_start"), F.col("q_end")))
    mapped = F.when(F.col("op") == "I", F.col("r_pos") - 1).otherwise(F.col("r_pos") + at - F.col("q_start"))
    best = found.withColumn("ref_pos", mapped).groupBy("contig", "q_pos").agg(F.min_by(F.struct("r_chrom", "ref_pos", F.when(F.col("op") == "I", "anchor").otherwise("exact").alias("map_kind")), "file_order").alias("best"))
    return queries.join(best, ["contig", "q_pos"], "left").select("contig", "q_pos", "best.*")


def alignment_blocks(alignments: DataFrame) -> DataFrame:
    """Blocks of alignments (q_contig, q_start, r_chrom, r_start, ops, file_order) as ``lift_query_pos`` takes them."""
    rows = alignments.withColumn("w", F.explode(cigar_walk(F.col("ops"), F.lit(0)))).where("w.op IN ('M', 'X', '=', 'I')")
    return rows.select("q_contig", (F.col("q_start") + F.col("w.read_pos")).alias("q_start"), (F.col("q_start") + F.col("w.read_pos") + F.col("w.n")).alias("q_end"), F.col("w.op").alias("op"), "r_chrom", (F.col("r_start") + F.col("w.node_pos")).alias("r_pos"), "file_order")


def haplotype_targets(nodes: DataFrame, anchors: DataFrame) -> DataFrame:
    """Nodes (node_id, haplotypes[name, region, context[node_id, is_target]]): GRCh38 records with a region and a target, and its start."""
    haps = nodes.select("node_id", F.explode("haplotypes").alias("h")).where("startswith(h.name, 'GRCh38') AND h.region IS NOT NULL")
    targets = haps.select("node_id", "h.name", "h.region", F.explode("h.context").alias("c")).where("c.is_target").select("node_id", "name", "region", F.col("c.node_id").alias("target"))
    return targets.join(anchors.select(F.col("node_id").alias("target"), "start"), "target").select("node_id", "name", "region", "target", "start")
