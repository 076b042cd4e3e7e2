"""Queries of variant tables and interval joins: name -> (query, DuckDB twin)."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import variants as fv
from strandloom.functions.cigar import cigar_ops
from strandloom.operators import dataset, intervals, variants
from strandloom.operators.pileup import VARIANT
from strandloom.plans.fixtures import sql
from strandloom.plans.pileup_queries import _INDELS, _PASSING
from strandloom.session import scratch_path
from strandloom.sources import graph_files, vcf

_TRUTH_LABEL = """SELECT node_id, v_pos, v_alt, CASE WHEN start IS NULL THEN -1 ELSE coalesce((SELECT max(CASE WHEN t.ref = v_ref AND t.alt = v_alt THEN 1 ELSE 0 END) FROM truth AS t
    WHERE t.chrom = c.chrom AND t.pos - 1 < start + v_pos + 1 AND t.pos - 1 + length(t.ref) > start + v_pos - 1), 0) END AS label FROM (SELECT * FROM candidates LEFT JOIN coords USING (node_id)) AS c"""
#: candidates of every kind with the alleles that they are looked up by, and truth records of every kind
_ALL_KINDS = _INDELS | {
    "passing": f"SELECT * FROM summary WHERE {_PASSING}",
    "placed": """SELECT p.*, chrom, start, v_pos - CASE WHEN v_type = 'D' AND v_pos > 0 THEN 1 ELSE 0 END AS shifted, CASE WHEN v_type = 'D' AND v_pos <= 0 THEN substr(v_ref, 2) ELSE v_ref END AS key_ref,
        CASE WHEN v_type = 'I' THEN v_ref || v_alt ELSE v_alt END AS key_alt FROM passing AS p LEFT JOIN coords USING (node_id)""",
    "all_truth": """SELECT chrom, pos, ref, alt FROM truth UNION ALL SELECT chrom, CASE v_type WHEN 'D' THEN start + v_pos - 1 ELSE start + v_pos END,
        CASE v_type WHEN 'D' THEN substr(sequence, v_pos, 1) || v_ref ELSE v_ref END, CASE v_type WHEN 'D' THEN substr(sequence, v_pos, 1) ELSE v_ref || v_alt END
        FROM passing JOIN coords USING (node_id) JOIN nodes USING (node_id) WHERE v_type <> 'X' AND (node_id + v_pos) % 3 <> 0""",
}
_TRUTH_LABEL_ALL = """SELECT node_id, v_pos, v_type, v_ref, v_alt, CASE WHEN start IS NULL THEN -1 ELSE coalesce((SELECT max(CASE WHEN CASE v_type WHEN 'D' THEN contains(t.ref, key_ref)
    WHEN 'I' THEN contains(t.ref, key_ref) AND contains(t.alt, key_alt) ELSE t.ref = key_ref AND t.alt = key_alt END THEN 1 ELSE 0 END) FROM all_truth AS t
    WHERE t.chrom = c.chrom AND t.pos - 1 < start + shifted + 1 AND t.pos - 1 + length(t.ref) > start + shifted - 1), 0) END AS label FROM placed AS c"""
_SBS = """SELECT *, CASE WHEN filters <> ['PASS'] THEN 'not_pass' WHEN prob <= 0.3 THEN 'low_prob' WHEN af < 0.1 THEN 'low_af' WHEN left_base IS NULL OR right_base IS NULL THEN 'no_context' END AS reason FROM (
    SELECT chrom, start + v_pos AS pos, 's' || node_id % 3 AS sample, v_ref AS ref, v_alt AS alt, CASE WHEN node_id % 4 = 0 THEN ['RefCall'] ELSE ['PASS'] END AS filters, ((node_id * 37 + v_pos * 11) % 101) / 100.0 AS prob,
    alt_allele_frequency AS af, nullif(substr(sequence, v_pos, CASE WHEN v_pos = 0 THEN 0 ELSE 1 END), '') AS left_base, nullif(substr(sequence, v_pos + 2, 1), '') AS right_base FROM located JOIN nodes USING (node_id))"""
_PLACED_BASES = """SELECT chrom, start + p AS pos, substr(sequence, CAST(p + 1 AS BIGINT), 1) AS ref, substr(fseq, CAST(j + 1 AS BIGINT), 1) AS base FROM (SELECT *, CASE WHEN j < m THEN noff + j WHEN kind = 2 AND j >= m + 2 THEN noff + j - 2
    WHEN kind = 3 THEN noff + j + 1 END AS p FROM (SELECT *, unnest(range(length(fseq))) AS j FROM mappings JOIN (SELECT node_id, chrom, start FROM coords) USING (node_id))) WHERE p IS NOT NULL"""
_LIFTED = """SELECT q.contig, q.q_pos, b.r_chrom, b.ref_pos, b.map_kind FROM (SELECT *, 'ctg' || node_id % 20 AS contig, node_id * 40 + node_id % 30 AS q_pos, node_id % 30 AS d FROM nodes) AS q LEFT JOIN (
            SELECT q.node_id, arg_min(chrom, ord) AS r_chrom, arg_min(start + noff + CASE WHEN d < m THEN d WHEN kind = 2 AND d < m + 2 THEN m - 1 WHEN kind = 2 THEN d - 2 ELSE d + 1 END, ord) AS ref_pos,
            arg_min(CASE WHEN kind = 2 AND d >= m AND d < m + 2 THEN 'anchor' ELSE 'exact' END, ord) AS map_kind FROM (SELECT node_id, node_id % 30 AS d FROM nodes) AS q JOIN mappings AS a USING (node_id) JOIN coords USING (node_id)
            WHERE d < length(fseq) GROUP BY 1) AS b USING (node_id)"""
_LIFTED_BY_3 = _LIFTED.replace("node_id % 30 AS d", "node_id % 30 + 3 AS d")
_PON = """SELECT *, list_filter([1, 2, 3, 4], lambda k: list_contains(hits, k)) AS hit FROM (SELECT c.*, (SELECT list(DISTINCT p.panel) FROM panels AS p WHERE p.chrom = c.chrom AND p.pos = c.pos
    AND (p.panel > 2 OR (p.ref = c.ref AND list_contains(c.alts, p.alt)))) AS hits FROM calls AS c)"""


def _candidates(t):
    return t.candidates().join(t.coords().select("node_id", "chrom", "start", "strand", "length"), "node_id", "left")


def _labelled(t):
    return intervals.truth_label(_candidates(t), t.truth())


def _labelled_all(t):
    placed = t.candidates("all").join(t.coords().select("node_id", "chrom", "start"), "node_id", "left")
    return intervals.truth_label(placed, t.truth_of_all())


def _matched(t):
    return variants.pon_match(t.calls(), *(t.panel(k) for k in (1, 2, 3, 4)))


def _numbered(rows, order):
    """All rows with the place that the order gives them."""
    names = [f"order_{k}" for k in range(len(order))]
    keyed = rows.select("chrom", "pos", F.get("alts", 0).alias("alt"), *(c.alias(n) for c, n in zip(order, names, strict=True)))
    return dataset.global_rank(keyed, *names, column="place").drop(*names)


def _anchors(t):
    return t.coords().select("node_id", "chrom", "start", "strand", "length")


def _alt_ref(t):
    return t.nodes().where("node_id % 5 = 0").selectExpr("node_id AS alt_node", "node_id + 1 AS ref_node")


def _node_calls(t):
    return t.candidates().selectExpr("node_id", "v_pos", "v_ref AS ref", "array(v_alt) AS alts")


def _records(t):
    return t.nodes().where("node_id % 4 <> 0").selectExpr("node_id", "node_id % 3 = 0 AS has_af")


def _sbs(t):
    rows = t.candidates().join(t.coords().select("node_id", "chrom", "start"), "node_id").join(t.nodes().select("node_id", "sequence"), "node_id")
    rows = rows.selectExpr(
        "chrom", "start + v_pos AS pos", "concat('s', node_id % 3) AS sample", "v_ref AS ref", "v_alt AS alt", "IF(node_id % 4 = 0, array('RefCall'), array('PASS')) AS filters", "((node_id * 37 + v_pos * 11) % 101) / 100.0D AS prob",
        "alt_allele_frequency AS af", "nullif(IF(v_pos = 0, '', substr(sequence, v_pos, 1)), '') AS left_base", "nullif(substr(sequence, v_pos + 2, 1), '') AS right_base",
    )
    return variants.sbs96_reasons(rows, 0.3, 0.1)


def _linear_reads(t):
    """Reads in linear coordinates, 0-based and half-open."""
    return t.mappings().join(t.coords().select("node_id", "chrom", "start"), "node_id").selectExpr("chrom AS r_chrom", "start - 1 + noff AS r_start", "start - 1 + noff + span AS r_end", "concat('read', read_id) AS name")


def _read_blocks(t):
    """The aligned blocks of reads, without insertions and deletions: chrom, r_start, r_end, bases, ref_bases."""
    rows = t.mappings().join(t.coords().select("node_id", "chrom", "start"), "node_id")
    rows = rows.selectExpr("chrom", "start", "sequence", "fseq", "explode(IF(kind < 2, array(struct(noff AS p, 0 AS r, m AS n)), array(struct(noff AS p, 0 AS r, m AS n), struct(IF(kind = 2, noff + m, noff + m + 1) AS p, IF(kind = 2, m + 2, m) AS r, 6 AS n)))) AS b")
    cut = "substr(fseq, b.r + 1, b.n)"
    return rows.selectExpr("chrom", "start - 1 + b.p AS r_start", f"start - 1 + b.p + length({cut}) AS r_end", f"{cut} AS bases", "substr(sequence, b.p + 1, b.n) AS ref_bases").where("bases <> ''")


def _loci(t):
    return t.truth().where("length(ref) = 1").selectExpr("chrom", "pos", "ref", "alts[0] AS alt")


def _indel_loci(t):
    """The insertions and deletions of the derived reads, by the base before them."""
    rows = t.mappings().where("kind >= 2").join(t.coords().select("node_id", "chrom", "start"), "node_id")
    base = "substr(sequence, noff + m, 1)"
    return rows.selectExpr("chrom", "start + noff + m - 1 AS pos", f"IF(kind = 2, {base}, substr(sequence, noff + m, 2)) AS ref", f"IF(kind = 2, concat({base}, 'GT'), {base}) AS alt").where("length(ref) <> length(alt)").distinct()


def _cigar_reads(t):
    rows = t.mappings().join(t.coords().select("node_id", "chrom", "start"), "node_id")
    return rows.select(F.col("chrom").alias("r_chrom"), (F.col("start") - 1 + F.col("noff")).alias("r_start"), F.col("fseq").alias("seq"), cigar_ops(F.col("fcigar")).alias("ops"))


def _lifted(t, query_shift=0):
    rows = t.mappings().join(t.coords().select("node_id", "chrom", "start"), "node_id")
    aligned = rows.select(F.concat(F.lit("ctg"), F.col("node_id") % 20).alias("q_contig"), (F.col("node_id") * 40).alias("q_start"), F.col("chrom").alias("r_chrom"), (F.col("start") + F.col("noff")).alias("r_start"), cigar_ops(F.col("fcigar")).alias("ops"), F.col("ord").alias("file_order"))
    queries = t.nodes().selectExpr("concat('ctg', node_id % 20) AS contig", "node_id * 40 + node_id % 30 AS q_pos")  # many lie beyond the reads
    return intervals.lift_query_pos(queries, intervals.alignment_blocks(aligned), query_shift)


def _merged(t):
    paths = []
    for chrom in ("chr1", "chr2", "chr3"):
        paths.append(scratch_path(t.spark, "vcf"))
        vcf.write_vcf(t.calls().where(F.col("chrom") == chrom), paths[-1])
    return vcf.merge_vcf(t.spark, paths, scratch_path(t.spark, "merged"))


def _sites(t):
    path = scratch_path(t.spark, "sites")
    four = t.truth().where("pos % 2 = 0").selectExpr("concat_ws(' ', chrom, pos, ref, concat(alts[0], ',.')) AS value")
    five = t.truth().where("pos % 2 = 1").selectExpr("concat_ws('\t', chrom, pos, 'x', ref, alts[0]) AS value")
    four.union(five).union(t.spark.createDataFrame([("# note",), ("bad line",)], "value string")).write.text(path)
    return vcf.read_sites(t.spark, path)


def _haplotypes(t):
    context = "transform(sequence(0, 2), k -> named_struct('node_id', node_id + k, 'is_target', (node_id + k) % 4 = 1))"
    rows = t.nodes().selectExpr("node_id", f"array(named_struct('name', 'GRCh38#0', 'region', IF(node_id % 3 = 0, NULL, concat('r', node_id)), 'context', {context}), named_struct('name', 'HG002#1', 'region', 'q', 'context', {context})) AS haplotypes")
    return intervals.haplotype_targets(rows, t.coords())


_CALL_TEXT = "chrom, pos, id, ref, array_to_string(alts, ',') AS alts, array_to_string(filters, ';') AS filters, CAST(node_id AS VARCHAR) AS nid, CAST(coverage AS VARCHAR) AS dp"


def _shown(rows):
    return rows.select("chrom", "pos", "id", "ref", F.array_join("alts", ",").alias("alts"), F.array_join("filters", ";").alias("filters"), F.element_at("info", "NID").alias("nid"), F.element_at("info", "DP").alias("dp"))


QUERIES = {
    "a7_read_vcf": (lambda t: _shown(vcf.round_trip(t.calls())), sql(f"SELECT {_CALL_TEXT} FROM calls")),
    "a8_read_sites": (_sites, sql("SELECT chrom, pos, ref, alt FROM truth")),
    "a9_write_vcf": (lambda t: _shown(vcf.round_trip(t.calls().withColumn("chrom", F.element_at("info", "NID")), "node")), sql(f"SELECT {_CALL_TEXT} FROM (SELECT CAST(node_id AS VARCHAR) AS chrom, * EXCLUDE (chrom) FROM calls)")),
    "a10_merge_vcf": (lambda t: _shown(_merged(t)), sql(f"SELECT {_CALL_TEXT} FROM calls")),
    "a11_extract_vcf": (
        lambda t: vcf.extract_vcf(t.calls(), "2").select(F.get_json_object("value", "$.chrom").alias("chrom"), F.get_json_object("value", "$.pos").cast("long").alias("pos"), F.get_json_object("value", "$.alts[0]").alias("alt")),
        sql("SELECT chrom, pos, alts[1] AS alt FROM calls WHERE chrom = 'chr2'"),
    ),
    "b11_vcf_pass": (
        lambda t: t.calls().select("id", "pos", F.get("alts", 0).alias("alt"), fv.vcf_pass(F.col("filters")).alias("strict"), fv.vcf_pass(F.col("filters"), False).alias("lenient")),
        sql("SELECT id, pos, alts[1] AS alt, node_id % 3 = 0 AS strict, node_id % 3 <> 2 AS lenient FROM calls"),
    ),
    "b12_vcf_kind": (
        lambda t: t.truth().select("chrom", "pos", "ref", F.get("alts", 0).alias("alt"), fv.vcf_kind(F.col("ref"), F.when(F.col("pos") % 7 == 0, F.array(F.lit("<DEL>"))).otherwise(F.col("alts"))).alias("kind")),
        sql("SELECT chrom, pos, ref, alt, CASE WHEN pos % 7 = 0 THEN 'OTHER' WHEN length(ref) = 1 THEN 'SNV' ELSE 'INDEL' END AS kind FROM truth"),
    ),
    "b13_variant_class4": (
        lambda t: t.truth().select("chrom", "pos", "ref", F.get("alts", 0).alias("alt"), fv.variant_class4(F.col("ref"), F.get("alts", 0)).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("n")),
        sql("SELECT CASE WHEN length(ref) = 1 THEN 'SNV' WHEN substr(ref, 1, 1) = alt THEN 'DEL' ELSE 'COMPLEX' END AS cls, count(*) AS n FROM truth GROUP BY 1"),
    ),
    "b14_min_depth": (
        lambda t: t.candidates().where(fv.min_depth(F.expr("IF(node_id % 3 = 0, coverage, NULL)"), F.expr("IF(node_id % 3 = 1, coverage + 5, NULL)"), 20)).groupBy("node_id").agg(F.count(F.lit(1)).alias("n")),
        sql("SELECT node_id, count(*) AS n FROM candidates WHERE CASE node_id % 3 WHEN 0 THEN coverage >= 20 WHEN 1 THEN coverage + 5 >= 20 ELSE true END GROUP BY 1"),
    ),
    "b20_autosome_filter": (
        lambda t: t.calls().selectExpr("CASE pos % 4 WHEN 0 THEN 'chrX' WHEN 1 THEN 'chrUn_1' ELSE chrom END AS chrom").where(F.col("chrom").isin(*(f"chr{k}" for k in range(1, 23)))).groupBy("chrom").agg(F.count(F.lit(1)).alias("n")),
        sql("SELECT chrom, count(*) AS n FROM calls WHERE pos % 4 >= 2 GROUP BY 1"),
    ),
    "c7_truth_label": (lambda t: _labelled_all(t).select(*VARIANT, "label"), sql(_TRUTH_LABEL_ALL, **_ALL_KINDS)),
    "c8_pon_match": (
        lambda t: _matched(t).select("id", "pos", F.get("alts", 0).alias("alt"), F.array_join("panels", ",").alias("panels")),
        sql("SELECT id, pos, alts[1] AS alt, coalesce(array_to_string(list_transform(hit, lambda k: 'PoN' || k), ','), '') AS panels FROM pon", pon=_PON),
    ),
    "c9_nodes_with_variants": (
        lambda t: intervals.nodes_with_variants(_anchors(t), t.truth()).select("node_id", F.size("variants").alias("n"), F.get("variants", 0)["v_start"].alias("first")),
        sql("SELECT node_id, count(*) AS n, min(pos - 1) AS first FROM coords JOIN truth USING (chrom) WHERE pos - 1 < start + length AND pos - 1 + length(ref) > start GROUP BY 1"),
    ),
    "c10_nodes_in_bed": (
        lambda t: intervals.nodes_in_bed(_anchors(t), t.coords().where("node_id % 9 = 0").selectExpr("chrom", "start + 5 AS start", "start + 40 AS end")).select("node_id"),
        sql("SELECT node_id FROM coords AS n WHERE EXISTS (SELECT 1 FROM coords AS b WHERE b.node_id % 9 = 0 AND b.chrom = n.chrom AND n.start < b.start + 40 AND b.start + 5 < n.start + n.length)"),
    ),
    "c11_regions_to_variants": (
        lambda t: intervals.regions_to_variants(t.coords().where("node_id % 3 = 0").selectExpr("node_id AS region_id", "chrom", "start", "IF(node_id % 2 = 0, length, -1) AS length"), t.truth(), True).groupBy("region_id").agg(F.count("v_pos").alias("n")),
        sql("SELECT node_id AS region_id, count(t.pos) AS n FROM coords AS c LEFT JOIN truth AS t ON t.chrom = c.chrom AND t.pos BETWEEN c.start AND c.start + c.length WHERE node_id % 6 = 0 GROUP BY 1"),
    ),
    "c12_reads_near_variant": (
        lambda t: intervals.reads_near_variant(t.truth().selectExpr("chrom", "pos").distinct(), _linear_reads(t), 20).select("chrom", "pos", F.array_join("names", ",").alias("names")),
        sql("""SELECT v.chrom, v.pos, string_agg(DISTINCT 'read' || read_id, ',' ORDER BY 'read' || read_id) AS names FROM (SELECT DISTINCT chrom, pos FROM truth) AS v JOIN lin AS r ON r.chrom = v.chrom
            AND r.r_start < v.pos + 20 AND r.r_end > greatest(v.pos - 20, 0) GROUP BY ALL""", lin="SELECT m.*, chrom, start - 1 + noff AS r_start, start - 1 + noff + span AS r_end FROM mappings AS m JOIN coords USING (node_id)"),
    ),
    "c14_anchor_lookup": (
        lambda t: variants.anchor_lookup(_node_calls(t), _alt_ref(t), _anchors(t)).select("node_id", "v_pos", F.get("alts", 0).alias("alt"), "anchor.chrom", "anchor.start"),
        sql("SELECT c.node_id, v_pos, v_alt AS alt, coalesce(r.chrom, o.chrom) AS chrom, coalesce(r.start, o.start) AS start FROM candidates AS c LEFT JOIN coords AS r ON c.node_id % 5 = 0 AND r.node_id = c.node_id + 1 LEFT JOIN coords AS o ON o.node_id = c.node_id"),
    ),
    "c16_recover_dropped": (lambda t: variants.recover_dropped(t.calls(), t.calls().where("pos % 3 = 0")).select("id", "pos", F.get("alts", 0).alias("alt")), sql("SELECT id, pos, alts[1] AS alt FROM calls WHERE pos % 3 <> 0")),
    "c18_lift_query_pos": (
        _lifted,
        sql("SELECT * FROM lifted", lifted=_LIFTED),
    ),
    "c21_locus_counts": (
        lambda t: intervals.locus_counts(_loci(t), _read_blocks(t).select(F.col("chrom").alias("r_chrom"), "r_start", "r_end", "bases")),
        sql("""SELECT chrom, pos, t.ref, alt, count(*) AS depth, count(*) FILTER (base = t.ref) AS ref_count, count(*) FILTER (base = alt) AS alt_count, count(*) FILTER (base NOT IN (t.ref, alt)) AS other_count, count(*) FILTER (base = alt) / count(*) AS vaf
            FROM truth AS t JOIN placed_bases AS b USING (chrom, pos) WHERE length(t.ref) = 1 GROUP BY ALL""", placed_bases=_PLACED_BASES),
    ),
    "c21_indel_counts": (
        lambda t: intervals.indel_counts(_indel_loci(t), _cigar_reads(t)),
        sql("""SELECT chrom, pos, ref, alt, count(*) AS depth, count(*) FILTER (NOT here) AS ref_count, count(*) FILTER (here AND kind = own) AS alt_count, count(*) FILTER (here AND kind = own) / count(*) AS vaf FROM (
            SELECT l.*, r.kind, r.kind >= 2 AND r.noff + r.m - 1 = p AS here FROM (SELECT DISTINCT chrom, node_id, start + noff + m - 1 AS pos, noff + m - 1 AS p, kind AS own, CASE kind WHEN 2 THEN substr(sequence, noff + m, 1) ELSE substr(sequence, noff + m, 2) END AS ref,
                CASE kind WHEN 2 THEN substr(sequence, noff + m, 1) || 'GT' ELSE substr(sequence, noff + m, 1) END AS alt FROM mappings JOIN (SELECT node_id, chrom, start FROM coords) USING (node_id) WHERE kind >= 2) AS l
            JOIN mappings AS r ON r.node_id = l.node_id AND p >= r.noff AND (p < r.noff + r.m OR r.kind = 2 AND p < r.noff + r.m + 6 AND p - r.noff + 2 < length(r.fseq) OR r.kind = 3 AND p > r.noff + r.m AND p < r.noff + r.m + 7 AND p - r.noff - 1 < length(r.fseq))
            WHERE length(ref) <> length(alt)) GROUP BY ALL"""),
    ),
    "c18_lift_shifted": (lambda t: _lifted(t, 3), sql("SELECT * FROM lifted", lifted=_LIFTED_BY_3)),
    "c24_flanked_nodes": (
        lambda t: intervals.variants_to_nodes(t.truth().withColumn("kind", fv.variant_class4(F.col("ref"), F.get("alts", 0))).select("chrom", "pos", "ref", "kind").distinct(), _anchors(t), 100).select("chrom", "pos", "ref", "kind", F.array_join("node_ids", ",").alias("node_ids"), "n_nodes"),
        sql("""SELECT chrom, pos, ref, kind, string_agg(node_id, ',' ORDER BY node_id) AS node_ids, CAST(count(*) AS INT) AS n_nodes FROM (SELECT DISTINCT v.*, node_id FROM (SELECT chrom, pos, ref, CASE WHEN length(ref) = 1 THEN 'SNV' WHEN substr(ref, 1, 1) = alt
            THEN 'DEL' ELSE 'COMPLEX' END AS kind FROM truth) AS v JOIN coords AS c ON c.chrom = v.chrom AND c.start < v.pos + length(v.ref) + 100 AND c.start + c.length > v.pos - 100) GROUP BY ALL"""),
    ),
    "c22_verify_alt_nodes": (
        lambda t: intervals.verify_alt_nodes(_candidates(t).where("start IS NOT NULL").selectExpr("node_id", "chrom", "start + v_pos AS pos", "v_alt AS alt"), t.nodes().where("node_id % 2 = 0"), t.truth()),
        sql("""SELECT count(*) AS checked, count(*) FILTER (hit) AS with_record, count(*) FILTER (NOT hit) AS without_record FROM (SELECT EXISTS (SELECT 1 FROM truth AS t WHERE t.chrom = l.chrom AND t.pos - 1 < start + v_pos + 2
            AND t.pos - 1 + length(t.ref) > start + v_pos - 1) AS hit FROM located AS l WHERE node_id % 2 = 0)"""),
    ),
    "c24_variants_to_nodes": (
        lambda t: intervals.variants_to_nodes(t.truth().withColumn("kind", fv.variant_class4(F.col("ref"), F.get("alts", 0))).select("chrom", "pos", "ref", "kind").distinct(), _anchors(t)).select("chrom", "pos", "ref", "kind", F.array_join("node_ids", ",").alias("node_ids"), "n_nodes"),
        sql("""SELECT chrom, pos, ref, kind, string_agg(node_id, ',' ORDER BY node_id) AS node_ids, CAST(count(*) AS INT) AS n_nodes FROM (SELECT DISTINCT v.*, node_id FROM (SELECT chrom, pos, ref, CASE WHEN length(ref) = 1 THEN 'SNV' WHEN substr(ref, 1, 1) = alt
            THEN 'DEL' ELSE 'COMPLEX' END AS kind FROM truth) AS v JOIN coords AS c ON c.chrom = v.chrom AND c.start < v.pos + length(v.ref) AND c.start + c.length > v.pos) GROUP BY ALL"""),
    ),
    "c25_haplotype_targets": (
        _haplotypes,
        sql("""SELECT n.node_id, 'GRCh38#0' AS name, 'r' || n.node_id AS region, c.node_id AS target, start FROM nodes AS n JOIN coords AS c ON c.node_id BETWEEN n.node_id AND n.node_id + 2 WHERE n.node_id % 3 <> 0 AND c.node_id % 4 = 1"""),
    ),
    "d8_af_histogram": (
        lambda t: variants.af_histogram(t.candidates().selectExpr("array(alt_allele_frequency, -1.0D, CASE WHEN node_id % 2 = 0 THEN 0.0D ELSE 2.0D END) AS afs")),
        sql("""SELECT bin, count(af) AS n, count(af) / sum(count(af)) OVER () AS proportion FROM (SELECT unnest(range(8))::INT AS bin) LEFT JOIN (SELECT af, CASE WHEN af <= 0.0001 THEN 0 WHEN af <= 0.001 THEN 1 WHEN af <= 0.01 THEN 2 WHEN af <= 0.05 THEN 3 WHEN af <= 0.1 THEN 4
            WHEN af <= 0.25 THEN 5 WHEN af <= 0.5 THEN 6 ELSE 7 END AS bin FROM (SELECT alt_allele_frequency AS af FROM candidates UNION ALL SELECT 0.0 FROM candidates WHERE node_id % 2 = 0)) USING (bin) GROUP BY bin"""),
    ),
    "d9_sbs96_matrix": (
        lambda t: variants.sbs96_matrix(_sbs(t), ["s0", "s1", "s2"]),
        sql("""SELECT CAST(row_number() OVER (ORDER BY r, a, l, e) - 1 AS INT) AS channel_no, l || '[' || r || '>' || a || ']' || e AS channel, coalesce(s0, 0) AS s0, coalesce(s1, 0) AS s1, coalesce(s2, 0) AS s2 FROM
            (SELECT unnest(['C', 'T']) AS r) CROSS JOIN (SELECT unnest(['A', 'C', 'G', 'T']) AS a) CROSS JOIN (SELECT unnest(['A', 'C', 'G', 'T']) AS l) CROSS JOIN (SELECT unnest(['A', 'C', 'G', 'T']) AS e)
            LEFT JOIN (SELECT CASE WHEN ref IN ('A', 'G') THEN translate(right_base || '[' || ref || '>' || alt || ']' || left_base, 'ACGT', 'TGCA') ELSE left_base || '[' || ref || '>' || alt || ']' || right_base END AS channel,
            count(*) FILTER (sample = 's0') AS s0, count(*) FILTER (sample = 's1') AS s1, count(*) FILTER (sample = 's2') AS s2 FROM sbs WHERE reason IS NULL GROUP BY 1) AS c ON c.channel = l || '[' || r || '>' || a || ']' || e WHERE a <> r""", sbs=_SBS),
    ),
    "d10_skip_reasons": (lambda t: variants.skip_reasons(_sbs(t)), sql("SELECT sample, reason, count(*) AS n FROM sbs WHERE reason IS NOT NULL GROUP BY ALL", sbs=_SBS)),
    "d14_node_class_counts": (
        lambda t: variants.node_class_counts(_node_calls(t).selectExpr("IF(v_pos % 10 = 0, 'chrX', string(node_id)) AS chrom"), _records(t)),
        sql("""SELECT CASE WHEN v_pos % 10 = 0 THEN 'non-numeric' WHEN node_id % 4 = 0 THEN 'alt-alt' WHEN node_id % 3 = 0 THEN 'reference' ELSE 'ref-alt' END AS node_class, count(*) AS variants, count(DISTINCT CASE WHEN v_pos % 10 <> 0 THEN node_id END) AS nodes FROM candidates GROUP BY 1"""),
    ),
    "d15_tsv_coverage": (
        lambda t: variants.tsv_coverage(variants.node_class(t.nodes(), _records(t)), _alt_ref(t)),
        sql("SELECT count(*) FILTER (node_id % 5 = 0) AS found, count(*) FILTER (node_id % 5 <> 0) AS not_found FROM nodes WHERE node_id % 4 <> 0 AND node_id % 3 <> 0"),
    ),
    "d18_pon_counts": (
        lambda t: variants.pon_counts(_matched(t), True),
        sql("""SELECT 'total' AS measure, count(*) AS n FROM pon UNION ALL SELECT 'matched', count(*) FROM pon WHERE len(hit) > 0 UNION ALL SELECT 'written', count(*) FROM pon WHERE coalesce(len(hit), 0) = 0
            UNION ALL SELECT 'PoN' || k, count(*) FROM (SELECT unnest(hit) AS k FROM pon) GROUP BY ALL""", pon=_PON),
    ),
    "d21_lift_summary": (
        lambda t: variants.lift_summary(_lifted(t).selectExpr("IF(q_pos % 2 = 0, 'hap1', 'hap2') AS hap", "coalesce(map_kind, 'none') AS map_kind", "string(q_pos % 3) AS type_change", "coalesce(r_chrom = 'chr1', false) AS same_chrom", "coalesce(map_kind = 'exact', false) AS exact")),
        sql("""SELECT hap, map_kind, type_change, same_chrom, count(*) AS n, count(*) FILTER (exact) AS exact FROM (SELECT CASE WHEN q_pos % 2 = 0 THEN 'hap1' ELSE 'hap2' END AS hap, coalesce(map_kind, 'none') AS map_kind, CAST(q_pos % 3 AS VARCHAR) AS type_change,
            coalesce(r_chrom = 'chr1', false) AS same_chrom, coalesce(map_kind = 'exact', false) AS exact FROM lifted) GROUP BY GROUPING SETS ((hap), (map_kind), (type_change), (same_chrom), ())""", lifted=_LIFTED),
    ),
    "d23_chrom_rollup": (
        lambda t: variants.chrom_rollup(t.calls().groupBy("chrom", F.when(F.length("ref") == 1, "SNV").otherwise("INDEL").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pos") % 2 == 0).alias("shared"))),
        sql("SELECT coalesce(chrom, 'all') AS chrom, 'SNV' AS kind, count(*) AS n, count(*) FILTER (pos % 2 = 0) AS shared FROM calls GROUP BY GROUPING SETS ((chrom), ())"),
    ),
    "d24_vaf_values": (
        lambda t: t.candidates().select("node_id", "v_pos", "v_alt", fv.F.round(variants.vaf_values(F.expr("IF(node_id % 3 = 0, array(0.5D, 0.25D), NULL)"), F.expr("IF(node_id % 3 = 1, array(coverage - alt_allele_count, alt_allele_count), array(coverage))").cast("array<double>"), F.expr("array(0.125D)")), 9).alias("vaf")),
        sql("SELECT node_id, v_pos, v_alt, round(CASE node_id % 3 WHEN 0 THEN 0.5 WHEN 1 THEN alt_allele_count / coverage ELSE 0.125 END, 9) AS vaf FROM candidates"),
    ),
    "f3_sort_vcf_linear": (
        lambda t: _numbered(t.calls(), vcf.linear_order()), sql("SELECT chrom, pos, alts[1] AS alt, row_number() OVER (ORDER BY chrom, pos, ref, array_to_string(alts, ',')) - 1 AS place FROM calls")
    ),
    "f4_sort_vcf_node": (
        lambda t: _numbered(t.calls().withColumn("chrom", F.element_at("info", "NID")), vcf.node_order()),
        sql("SELECT CAST(node_id AS VARCHAR) AS chrom, pos, alts[1] AS alt, row_number() OVER (ORDER BY node_id, pos, ref, array_to_string(alts, ',')) - 1 AS place FROM calls"),
    ),
    "f5_sort_header_order": (
        lambda t: _numbered(t.calls().join(t.spark.createDataFrame([("chr2", 0), ("chr3", 1), ("chr1", 2)], "chrom string, contig_no int"), "chrom", "left"), vcf.header_order()),
        sql("SELECT chrom, pos, alts[1] AS alt, row_number() OVER (ORDER BY CASE chrom WHEN 'chr2' THEN 0 WHEN 'chr3' THEN 1 ELSE 2 END, pos, ref, array_to_string(alts, ',')) - 1 AS place FROM calls"),
    ),
    "f7_examples_limit": (
        lambda t: variants.skip_examples(_sbs(t)).select("sample", "nth", "chrom", "pos", "reason"),
        sql("SELECT sample, row_number() OVER (PARTITION BY sample ORDER BY chrom, pos, alt) AS nth, chrom, pos, reason FROM sbs WHERE reason IS NOT NULL QUALIFY nth <= 10", sbs=_SBS),
    ),
    "g1_compare_variants": (
        lambda t: variants.compare_variants(t.calls(), t.truth().withColumn("chrom", F.regexp_replace("chrom", "chr", ""))),
        sql("""SELECT count(a) AS size_1, count(b) AS size_2, count(*) FILTER (a = 1 AND b = 1) AS shared, count(*) FILTER (b IS NULL) AS only_1, count(*) FILTER (a IS NULL) AS only_2 FROM
            (SELECT DISTINCT chrom, pos, ref, unnest(alts) AS alt, 1 AS a FROM calls) FULL JOIN (SELECT DISTINCT chrom, pos, ref, alt, 1 AS b FROM truth) USING (chrom, pos, ref, alt)"""),
    ),
    "g1_compare_positions": (
        lambda t: variants.compare_variants(t.calls(), t.truth(), False),
        sql("""SELECT count(a) AS size_1, count(b) AS size_2, count(*) FILTER (a = 1 AND b = 1) AS shared, count(*) FILTER (b IS NULL) AS only_1, count(*) FILTER (a IS NULL) AS only_2 FROM
            (SELECT DISTINCT chrom, pos, 1 AS a FROM calls) FULL JOIN (SELECT DISTINCT chrom, pos, 1 AS b FROM truth) USING (chrom, pos)"""),
    ),
    "h18_contig_alias": (
        lambda t: t.calls().select("id", "pos", F.get("alts", 0).alias("alt"), fv.contig_alias(F.expr("CASE pos % 5 WHEN 0 THEN 'chrM' WHEN 1 THEN 'MT' ELSE chrom END")).alias("contig")),
        sql("SELECT id, pos, alts[1] AS alt, CASE WHEN pos % 5 < 2 THEN 'M' ELSE substr(chrom, 4) END AS contig FROM calls"),
    ),
    "h19_canon_chrom": (lambda t: t.calls().select(fv.canon_chrom(F.when(F.col("pos") % 2 == 0, F.upper("chrom")).otherwise(F.col("chrom"))).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")), sql("SELECT substr(chrom, 4) AS c, count(*) AS n FROM calls GROUP BY 1")),
    "h20_chrom_from_pattern": (
        lambda t: t.calls().select("id", "pos", F.get("alts", 0).alias("alt"), fv.chrom_from_pattern(F.expr("IF(pos % 3 = 0, 'none', concat('nodes_', chrom, '.v2.json'))")).alias("chrom")),
        sql("SELECT id, pos, alts[1] AS alt, CASE WHEN pos % 3 <> 0 THEN chrom END AS chrom FROM calls"),
    ),
    "h22_info": (
        lambda t: t.calls().select("id", "pos", F.get("alts", 0).alias("alt"), fv.info_map(fv.info_string({"A": F.element_at("info", "NID"), "B": F.when(F.col("pos") % 2 == 0, F.lit("x y;z"))})).alias("m")).select("id", "pos", "alt", F.element_at("m", "A").alias("a"), F.element_at("m", "B").alias("b")),
        sql("SELECT id, pos, alts[1] AS alt, CAST(node_id AS VARCHAR) AS a, CASE WHEN pos % 2 = 0 THEN 'x%20y%3Bz' END AS b FROM calls"),
    ),
    "h23_linear_position": (
        lambda t: _candidates(t).where("start IS NOT NULL").select("node_id", "v_pos", "v_alt", fv.linear_position(F.col("start") - 1, F.col("v_pos"), F.col("length"), F.col("strand")).alias("pos")),
        sql("SELECT node_id, v_pos, v_alt, CASE WHEN strand = '-' THEN start + length - 1 - v_pos ELSE start + v_pos END AS pos FROM located"),
    ),
    "h24_sbs96_channel": (
        lambda t: _sbs(t).where("left_base IS NOT NULL AND right_base IS NOT NULL").select(fv.sbs96_channel(F.col("left_base"), F.col("ref"), F.col("alt"), F.col("right_base")).alias("channel")).groupBy("channel").agg(F.count(F.lit(1)).alias("n")),
        sql("""SELECT CASE WHEN ref IN ('A', 'G') THEN translate(right_base || '[' || ref || '>' || alt || ']' || left_base, 'ACGT', 'TGCA') ELSE left_base || '[' || ref || '>' || alt || ']' || right_base END AS channel, count(*) AS n
            FROM sbs WHERE left_base IS NOT NULL AND right_base IS NOT NULL GROUP BY 1""", sbs=_SBS),
    ),
    "h25_pon_annotate": (
        lambda t: variants.pon_annotate(_matched(t)).select("id", "pos", F.get("alts", 0).alias("alt"), F.array_join("filters", ";").alias("filters"), F.element_at("info", "PON").alias("pon")),
        sql("""SELECT id, pos, alts[1] AS alt, CASE WHEN coalesce(len(hit), 0) = 0 THEN array_to_string(filters, ';') WHEN filters = ['PASS'] THEN 'PanelOfNormals' ELSE array_to_string(filters, ';') || ';PanelOfNormals' END AS filters,
            CASE WHEN len(hit) > 0 THEN array_to_string(list_transform(hit, lambda k: 'PoN' || k), ',') END AS pon FROM pon""", pon=_PON),
    ),
    "h26_fix_indel": (
        lambda t: variants.fix_indel(t.mappings().where("kind >= 2").selectExpr("concat('n', node_id) AS chrom", "IF(kind = 2, noff + m, noff + m + 1) AS pos", "IF(kind = 2, 'I', 'D') AS v_type", "IF(kind = 2, substr(sequence, noff + m, 1), substr(sequence, noff + m + 1, 1)) AS ref", "IF(kind = 2, 'GT', '*') AS alt").distinct(),
            t._dealt(t.nodes(), "node_id").select(F.concat(F.lit("n"), F.col("node_id")).alias("chrom"), F.posexplode(F.split("sequence", "")).alias("p", "base")).where("base <> ''").select("chrom", (F.col("p") + 1).alias("pos"), "base")),
        sql("""SELECT DISTINCT 'n' || node_id AS chrom, noff + m AS pos, CASE kind WHEN 2 THEN 'I' ELSE 'D' END AS v_type, CASE kind WHEN 2 THEN substr(sequence, noff + m, 1) ELSE substr(sequence, noff + m, 2) END AS ref,
            CASE WHEN kind = 3 THEN substr(sequence, noff + m, 1) WHEN substr(sequence, noff + m, 1) = 'G' THEN 'GT' ELSE substr(sequence, noff + m, 1) || 'GT' END AS alt,
            CASE WHEN kind = 3 THEN 'left base' WHEN substr(sequence, noff + m, 1) = 'G' THEN 'as is' ELSE 'prefixed' END AS note FROM mappings WHERE kind >= 2"""),
    ),
    "c23_left_base_fetch": (
        lambda t: graph_files.fasta_base(t.mappings().where("kind = 3").selectExpr("concat('n', node_id) AS contig", "bigint(noff + m) AS pos").distinct(), t.nodes().selectExpr("concat('n', node_id) AS contig", "explode(array(0L, 1L)) AS chunk_no", "sequence").selectExpr("contig", "chunk_no", "substr(sequence, int(chunk_no * 60) + 1, 60) AS bases")),
        sql("SELECT DISTINCT 'n' || node_id AS contig, CAST(noff + m AS BIGINT) AS pos, substr(sequence, noff + m, 1) AS base FROM mappings WHERE kind = 3"),
    ),
    "h27_ad_to_adalt": (
        lambda t: t.calls().select("id", "pos", F.get("alts", 0).alias("alt"), variants.ad_to_adalt(F.map_concat("info", F.create_map(F.lit("AD"), F.expr("IF(pos % 2 = 0, '7', '3,4')")))).alias("m")).select("id", "pos", "alt", F.element_at("m", "AD").alias("ad"), F.element_at("m", "ADALT").alias("adalt")),
        sql("SELECT id, pos, alts[1] AS alt, CASE WHEN pos % 2 = 1 THEN '3,4' END AS ad, CASE WHEN pos % 2 = 0 THEN '7' END AS adalt FROM calls"),
    ),
    "h28_node_class": (
        lambda t: variants.node_class(t.nodes(), _records(t)).select("node_id", "node_class"),
        sql("SELECT node_id, CASE WHEN node_id % 4 = 0 THEN 'alt-alt' WHEN node_id % 3 = 0 THEN 'reference' ELSE 'ref-alt' END AS node_class FROM nodes"),
    ),
    "h30_parse_annotation": (
        lambda t: t.truth().select("pos", "ref", F.get("alts", 0).alias("alt"), fv.parse_annotation(F.expr("IF(pos % 5 = 0, 'broken', concat('asm#', 1 + pos % 2, '#', chrom, ':', pos, '-', ref, '-', alts[0]))")).alias("a")).where("a IS NOT NULL").select("a.*"),
        sql("SELECT 'asm#' || (1 + pos % 2) || '#' || chrom AS contig, pos, ref, alt, 'hap' || (1 + pos % 2) AS hap FROM truth WHERE pos % 5 <> 0"),
    ),
    "h31_alt_nodes_from_traversal": (
        lambda t: variants.alt_nodes_from_traversal(t.truth().where("pos % 2 = 0").selectExpr("chrom", "pos", "ref", "array(alts[0], 'GGG') AS alts", "array(concat('>', pos, '>', pos + 1), concat('>', pos, '>', pos + 2), concat('>', pos, '>', pos + 3, '>', pos + 1)) AS traversals")).select("chrom", "pos", "ref", "alt", "kind", F.array_join("ref_nodes", ",").alias("ref_nodes"), "alt_node"),
        sql("""SELECT chrom, pos, ref, alt, 'SNP' AS kind, CAST(pos + 1 AS VARCHAR) AS ref_nodes, CAST(pos + 2 AS VARCHAR) AS alt_node FROM truth WHERE pos % 2 = 0 AND length(ref) = 1
            UNION ALL SELECT chrom, pos, ref, 'GGG', 'INS', '', CAST(pos + 3 AS VARCHAR) FROM truth WHERE pos % 2 = 0"""),
    ),
    "h35_parse_tensor_name": (
        lambda t: t.candidates().select(fv.parse_tensor_name(F.expr("IF(node_id % 2 = 0, concat_ws('_', node_id, v_pos, v_type, v_ref, v_alt), concat_ws('_', v_pos, v_type, v_ref, v_alt))"), F.col("node_id").cast("string")).alias("v")).select("v.*"),
        sql("SELECT node_id, v_pos, v_type, v_ref, v_alt FROM candidates"),
    ),
    "j9_split_linear_graph": (
        lambda t: (lambda parts: parts[0].withColumn("part", F.lit("linear")).unionByName(parts[1].withColumn("part", F.lit("graph"))))(variants.split_linear_graph(_node_calls(t), _alt_ref(t).where("alt_node % 2 = 0"), _anchors(t))).select("part", "chrom", "pos", F.get("alts", 0).alias("alt"), F.element_at("info", "NID").alias("nid")),
        sql("""SELECT CASE WHEN a.node_id IS NULL THEN 'graph' ELSE 'linear' END AS part, coalesce(a.chrom, CAST(c.node_id AS VARCHAR)) AS chrom, CASE WHEN a.node_id IS NULL THEN v_pos + 1 WHEN a.strand = '-' THEN a.start + a.length - 1 - v_pos ELSE a.start + v_pos END AS pos,
            v_alt AS alt, CAST(c.node_id AS VARCHAR) AS nid FROM candidates AS c LEFT JOIN coords AS a ON a.node_id = CASE WHEN c.node_id % 10 = 0 AND EXISTS (SELECT 1 FROM coords WHERE coords.node_id = c.node_id + 1) THEN c.node_id + 1 ELSE c.node_id END"""),
    ),
}
