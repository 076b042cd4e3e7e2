"""Variant tables: panels of normals, set comparison, repair, signatures, frequencies and node classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions.variants import canon_chrom, contig_alias, linear_position, sbs96_channel, vcf_pass
from strandloom.session import materialize

PANEL_MODES = ("allele", "allele", "position", "position")


def pon_match(calls: DataFrame, *panels: DataFrame) -> DataFrame:
    """Calls with ``panels``: names of the panels that hold them, in panel order.

    Allele mode needs an equal REF and a shared ALT, position mode an equal position; contigs by any of their names.
    """
    known = None
    for k, (panel, mode) in enumerate(zip(panels, PANEL_MODES, strict=False), 1):
        rows = panel.select(contig_alias(F.col("chrom")).alias("p_chrom"), F.col("pos").alias("p_pos"), F.upper("ref").alias("p_ref"), F.transform("alts", F.upper).alias("p_alts"), F.lit(k).alias("panel"), F.lit(mode == "allele").alias("by_allele"))
        known = rows if known is None else known.unionByName(rows)
    keyed = materialize(calls.withColumn("__call", F.monotonically_increasing_id()), "pon-calls")
    same = (contig_alias(F.col("chrom")) == F.col("p_chrom")) & (F.col("pos") == F.col("p_pos"))
    alleles = ~F.col("by_allele") | ((F.upper("ref") == F.col("p_ref")) & F.arrays_overlap(F.transform("alts", F.upper), F.col("p_alts")))
    hits = keyed.select("__call", "chrom", "pos", "ref", "alts").join(known, same & alleles).groupBy("__call").agg(F.array_sort(F.collect_set("panel")).alias("hit"))
    names = F.transform(F.coalesce("hit", F.array().cast("array<int>")), lambda k: F.concat(F.lit("PoN"), k.cast("string")))
    return keyed.join(hits, "__call", "left").withColumn("panels", names).drop("hit", "__call")


def pon_annotate(matched: DataFrame, drop: bool = False) -> DataFrame:
    """PanelOfNormals in FILTER (a lone PASS goes) and the panels' names in INFO; or without the matched rows."""
    hit = F.size("panels") > 0
    if drop:
        return matched.where(~hit).drop("panels")
    filters = F.when(hit, F.array_union(F.when(vcf_pass(F.col("filters")), F.array().cast("array<string>")).otherwise(F.col("filters")), F.array(F.lit("PanelOfNormals")))).otherwise(F.col("filters"))
    info = F.when(hit, F.map_concat("info", F.create_map(F.lit("PON"), F.array_join("panels", ",")))).otherwise(F.col("info"))
    return matched.withColumn("filters", filters).withColumn("info", info).drop("panels")


def pon_counts(matched: DataFrame, drop: bool = False) -> DataFrame:
    """(measure, n): total, matched, written and matches per panel."""
    per = matched.select(F.explode("panels").alias("measure")).groupBy("measure").agg(F.count(F.lit(1)).alias("n"))
    hit = F.size("panels") > 0
    total = matched.agg(F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("matched"), (F.count_if(~hit) if drop else F.count(F.lit(1))).alias("written"))
    return total.select(F.explode(F.create_map(*(x for c in ("total", "matched", "written") for x in (F.lit(c), F.col(c)))))).toDF("measure", "n").unionByName(per)


def site_keys(rows: DataFrame, by_allele: bool = True) -> DataFrame:
    """Distinct keys of a variant table: contigs without ``chr``, an ALT to a row, ``.`` left out."""
    keys = rows.select(canon_chrom(F.col("chrom")).alias("chrom"), "pos", F.upper("ref").alias("ref"), F.explode("alts").alias("alt")).where("alt <> '.'").withColumn("alt", F.upper("alt"))
    return (keys if by_allele else keys.select("chrom", "pos")).distinct()


def compare_variants(one: DataFrame, two: DataFrame, by_allele: bool = True) -> DataFrame:
    """Sizes of both sets, of what they share and of what only one has, by one full outer join."""
    a, b = site_keys(one, by_allele), site_keys(two, by_allele)
    both = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), a.columns, "full")
    return both.agg(F.count("a").alias("size_1"), F.count("b").alias("size_2"), F.count_if(F.expr("a = 1 AND b = 1")).alias("shared"), F.count_if(F.expr("b IS NULL")).alias("only_1"), F.count_if(F.expr("a IS NULL")).alias("only_2"))


def graph_key() -> Column:
    """NID, NSO, TYPE, REF and ALT if the record has them, else its own place."""
    alts = F.array_join("alts", ",")
    own = F.concat_ws("|", "chrom", F.col("pos").cast("string"), "ref", alts)
    graph = F.concat_ws("|", F.element_at("info", "NID"), F.element_at("info", "NSO"), F.coalesce(F.element_at("info", "TYPE"), F.lit("")), "ref", alts)
    return F.when(F.element_at("info", "NID").isNotNull() & F.element_at("info", "NSO").isNotNull(), graph).otherwise(own)


def recover_dropped(every: DataFrame, linear: DataFrame) -> DataFrame:
    """Records whose graph key isn't among the linear ones."""
    return every.withColumn("graph_key", graph_key()).join(linear.select(graph_key().alias("graph_key")).distinct(), "graph_key", "left_anti")


def anchor_lookup(calls: DataFrame, alt_ref: DataFrame, anchors: DataFrame) -> DataFrame:
    """Calls (node_id, ...) with an anchor: that of an ALT node's REF node first, then the node's own."""
    ref = anchors.select(F.col("node_id").alias("ref_node"), F.struct("chrom", "start", "strand", "length").alias("by_ref"))
    own = anchors.select("node_id", F.struct("chrom", "start", "strand", "length").alias("by_own"))
    joined = calls.join(alt_ref.withColumnRenamed("alt_node", "node_id"), "node_id", "left").join(ref, "ref_node", "left").join(own, "node_id", "left")
    return joined.withColumn("anchor", F.coalesce("by_ref", "by_own")).drop("by_ref", "by_own")


def split_linear_graph(calls: DataFrame, alt_ref: DataFrame, anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node calls (node_id, v_pos, ref, alts) as linear rows and leftover node rows, both with NID and NSO."""
    found = anchor_lookup(calls, alt_ref, anchors).withColumn("info", F.create_map(F.lit("NID"), F.col("node_id").cast("string"), F.lit("NSO"), F.col("v_pos").cast("string")))
    # anchors start at 1
    pos = linear_position(F.col("anchor.start") - 1, F.col("v_pos"), F.col("anchor.length"), F.col("anchor.strand"))
    linear = found.where("anchor IS NOT NULL").select(F.col("anchor.chrom").alias("chrom"), pos.alias("pos"), "ref", "alts", "info")
    graph = found.where("anchor IS NULL").select(F.col("node_id").cast("string").alias("chrom"), (F.col("v_pos") + 1).cast("long").alias("pos"), "ref", "alts", "info")
    return linear, graph


def node_class(rows: DataFrame, records: DataFrame, column: str = "node_id") -> DataFrame:
    """reference (the node's record has frequencies), ref-alt (it has a record) or alt-alt."""
    known = records.groupBy(F.col("node_id").alias(column)).agg(F.max("has_af").alias("has_af"))
    return rows.join(known, column, "left").withColumn("node_class", F.when(F.col("has_af"), "reference").when(F.col("has_af").isNotNull(), "ref-alt").otherwise("alt-alt")).drop("has_af")


def node_class_counts(calls: DataFrame, records: DataFrame) -> DataFrame:
    """Variants and distinct nodes by class; contigs that aren't node ids are tallied as ``non-numeric``."""
    rows = node_class(calls.withColumn("node_id", F.col("chrom").try_cast("long")), records)
    cls = F.when(F.col("node_id").isNull(), "non-numeric").otherwise(F.col("node_class"))
    return rows.groupBy(cls.alias("node_class")).agg(F.count(F.lit(1)).alias("variants"), F.count_distinct("node_id").alias("nodes"))


def tsv_coverage(classed: DataFrame, alt_ref: DataFrame) -> DataFrame:
    """ref-alt nodes found and not found among the table's ALT ids."""
    nodes = classed.where("node_class = 'ref-alt'").select("node_id").distinct().join(alt_ref.select(F.col("alt_node").alias("node_id"), F.lit(1).alias("hit")).distinct(), "node_id", "left")
    return nodes.agg(F.count("hit").alias("found"), F.count_if(F.col("hit").isNull()).alias("not_found"))


def fix_indel(rows: DataFrame, bases: DataFrame) -> DataFrame:
    """Repair I and D rows (chrom, pos, v_type, ref, alt): an I's ALT starts with its REF, a D starts one base earlier.

    bases: (chrom, pos, base). Several ALTs, and a D at position 1 or before, are dropped; ``note`` tells what was done.
    """
    single = rows.where("NOT contains(alt, ',')").where("v_type <> 'D' OR pos > 1")
    before = bases.select("chrom", (F.col("pos") + 1).alias("pos"), F.upper("base").alias("left_base"))
    # a row a base: their number can't be told from the table that they are split from, so they are never broadcast
    joined = single.join(before.hint("merge"), ["chrom", "pos"], "left")
    starts = F.col("alt").startswith(F.col("ref")) & (F.col("alt") != F.col("ref"))
    is_i, is_d = F.col("v_type") == "I", F.col("v_type") == "D"
    left = F.coalesce("left_base", F.lit("N"))
    return joined.select(
        "chrom", F.when(is_d, F.col("pos") - 1).otherwise(F.col("pos")).alias("pos"), "v_type", F.when(is_d, F.concat(left, "ref")).otherwise(F.col("ref")).alias("ref"),
        F.when(is_i & ~starts, F.concat("ref", "alt")).when(is_d, left).otherwise(F.col("alt")).alias("alt"), F.when(is_i & ~starts, "prefixed").when(is_d, "left base").otherwise("as is").alias("note"),
    )


def ad_to_adalt(info: Column) -> Column:
    """A single-valued AD becomes ADALT."""
    single = F.coalesce(~F.contains(F.element_at(info, "AD"), F.lit(",")), F.lit(False))
    moved = F.map_concat(F.map_filter(info, lambda k, v: ~k.isin("AD", "ADALT")), F.create_map(F.lit("ADALT"), F.element_at(info, "AD")))
    return F.when(single, moved).otherwise(info)


BIN_EDGES = (0.0001, 0.001, 0.01, 0.05, 0.1, 0.25, 0.5, 1.0)


def af_histogram(rows: DataFrame, max_af: float | None = None) -> DataFrame:
    """ALT frequencies (``afs``) in eight right-closed bins, 0 in the first: bin, n, proportion; empty bins too."""
    af = rows.select(F.explode("afs").alias("af")).where("af >= 0 AND af <= 1")
    af = af.where(F.col("af") <= max_af) if max_af is not None else af
    number = F.lit(len(BIN_EDGES) - 1)
    for k in reversed(range(len(BIN_EDGES) - 1)):
        number = F.when(F.col("af") <= BIN_EDGES[k], k).otherwise(number)
    counts = af.groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = rows.sparkSession.range(len(BIN_EDGES)).select(F.col("id").cast("int").alias("bin"))
    total = F.sum("n").over(Window.partitionBy())  # over eight rows
    out = grid.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    return out.withColumn("proportion", F.coalesce(F.try_divide("n", total), F.lit(0.0)))


def sbs96_reasons(rows: DataFrame, min_prob: float = 0.5, min_af: float = 0.05) -> DataFrame:
    """Rows (sample, chrom_class, ref, alt, left_base, right_base, filters, prob, af) with ``reason``, the first test that fails, or null."""
    base = ("A", "C", "G", "T")
    reason = (
        F.when(~vcf_pass(F.col("filters")), "not_pass").when(F.coalesce(F.length("ref"), F.lit(0)) != 1, "not_snv").when(F.length("alt") != 1, "not_snv").when(~F.col("ref").isin(*base) | ~F.col("alt").isin(*base), "bad_base")
        .when(F.col("prob").isNull(), "no_prob").when(F.col("prob") <= min_prob, "low_prob").when(F.col("af").isNull(), "no_af").when(F.col("af") < min_af, "low_af")
        .when(F.col("left_base").isNull() | F.col("right_base").isNull(), "no_context").when(~F.col("left_base").isin(*base) | ~F.col("right_base").isin(*base), "bad_context")
    )
    return rows.withColumn("reason", reason)


def skip_reasons(rows: DataFrame) -> DataFrame:
    return rows.where("reason IS NOT NULL").groupBy("sample", "reason").agg(F.count(F.lit(1)).alias("n"))


def skip_examples(rows: DataFrame, per_sample: int = 10) -> DataFrame:
    """The first examples of each sample, in the order of their place."""
    nth = F.row_number().over(Window.partitionBy("sample").orderBy("chrom", "pos", "alt"))
    return rows.where("reason IS NOT NULL").withColumn("nth", nth).where(F.col("nth") <= per_sample)


def channels() -> list[str]:
    return [f"{left}[{ref}>{alt}]{right}" for ref, alts in (("C", "AGT"), ("T", "ACG")) for alt in alts for left in "ACGT" for right in "ACGT"]


def sbs96_matrix(rows: DataFrame, samples: list[str]) -> DataFrame:
    """Counts of the 96 channels by sample, zeros filled, in fixed order."""
    kept = rows.where("reason IS NULL").withColumn("channel", sbs96_channel(F.col("left_base"), F.col("ref"), F.col("alt"), F.col("right_base")))
    counts = kept.groupBy("channel").pivot("sample", samples).agg(F.count(F.lit(1)))
    grid = rows.sparkSession.createDataFrame(list(enumerate(channels())), "channel_no int, channel string")
    return grid.join(counts, "channel", "left").select("channel_no", "channel", *(F.coalesce(s, F.lit(0)).alias(s) for s in samples)).orderBy("channel_no")


def vaf_values(format_af: Column, ad: Column, info_af: Column, mode: str = "max") -> Column:
    """Frequencies by FORMAT/AF, else AD, else INFO/AF; all of them, the first or the largest."""
    depth = F.aggregate(ad, F.lit(0.0), lambda s, x: s + x)
    from_ad = F.when((F.size(ad) > 1) & (depth > 0), F.transform(F.slice(ad, 2, F.greatest(F.size(ad) - 1, F.lit(0))), lambda x: x / depth))
    values = F.coalesce(format_af, from_ad, info_af)
    return {"all": values, "first": F.get(values, F.lit(0)), "max": F.array_max(values)}[mode]


def alt_nodes_from_traversal(rows: DataFrame) -> DataFrame:
    """Deconstructed records (chrom, pos, ref, alts, traversals[ref, alt...]) as SNP and insertion rows with the ALT's own nodes."""
    paths = F.transform("traversals", lambda p: F.regexp_extract_all(p, F.lit(r"(\d+)"), F.lit(1)))
    each = rows.withColumn("paths", paths).select("chrom", "pos", "ref", F.col("paths")[0].alias("ref_path"), F.explode(F.arrays_zip("alts", F.slice("paths", 2, 1_000_000).alias("own"))).alias("z"))
    out = each.select("chrom", "pos", "ref", F.col("z.alts").alias("alt"), F.array_except("ref_path", F.col("z.own")).alias("ref_nodes"), F.array_except("z.own", "ref_path").alias("alt_nodes"))
    kind = F.when((F.length("ref") == 1) & (F.length("alt") == 1), "SNP").when(F.length("alt") > F.length("ref"), "INS")
    return out.withColumn("kind", kind).where("kind IS NOT NULL AND size(alt_nodes) > 0").withColumn("alt_node", F.explode("alt_nodes")).drop("alt_nodes")


def chrom_rollup(rows: DataFrame) -> DataFrame:
    """(chrom, kind, n, shared) with an ``all`` row per kind over the autosomes."""
    autosomal = rows.where(F.col("chrom").rlike("^chr([1-9]|1[0-9]|2[0-2])$"))
    both = autosomal.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("shared").alias("shared")).withColumn("chrom", F.lit("all"))
    return rows.select("chrom", "kind", "n", "shared").unionByName(both)


def lift_summary(rows: DataFrame) -> DataFrame:
    """Counts by hap, map_kind, type_change and same_chrom each, and over all, by grouping sets."""
    dims = ["hap", "map_kind", "type_change", "same_chrom"]
    return rows.groupingSets([[F.col(d)] for d in dims] + [[]], *[F.col(d) for d in dims]).agg(F.count(F.lit(1)).alias("n"), F.count_if("exact").alias("exact"))
