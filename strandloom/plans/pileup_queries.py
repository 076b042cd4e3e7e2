"""Queries of alignments, segments and pileups on the derived tables: name -> (query, DuckDB twin)."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import cigar
from strandloom.operators import align, pileup
from strandloom.plans.fixtures import sql
from strandloom.session import materialize

_STATES = """SELECT c.node_id, c.v_pos, c.v_type, c.v_ref, c.v_alt, s.st AS state, s.q AS bq FROM c JOIN s ON c.node_id = s.node_id AND c.v_pos = s.p AND c.v_type = s.v_type AND c.v_ref = s.v_ref AND c.v_alt = s.v_alt"""
#: insertions and deletions of the derived mappings in closed form: both begin after the first m bases
_INDELS = {
    "indels": """SELECT node_id, ord, noff + m - 1 AS v_pos, 'I' AS v_type, substr(sequence, noff + m, 1) AS v_ref, 'GT' AS v_alt FROM mappings WHERE mapq >= 10 AND kind = 2
        UNION ALL SELECT node_id, ord, noff + m, 'D', substr(sequence, noff + m + 1, 1), '*' FROM mappings WHERE mapq >= 10 AND kind = 3""",
    "found": "SELECT node_id, ord, v_pos, v_type, v_ref, v_alt FROM indels UNION ALL SELECT node_id, ord, p, 'X', substr(sequence, p + 1, 1), base FROM bases WHERE p IS NOT NULL AND base <> substr(sequence, p + 1, 1)",
    "kept": "SELECT node_id, v_pos, v_type, v_ref, v_alt, count(*) AS supporting FROM found GROUP BY ALL",
    "at_sites": """SELECT c.*, b.ord, CASE WHEN c.v_type = 'X' THEN CASE base WHEN v_alt THEN 'alt' WHEN v_ref THEN 'ref' ELSE 'other' END
                         WHEN c.v_type = 'I' AND b.kind = 2 AND b.p = b.noff + b.m - 1 THEN 'alt' ELSE 'ref' END AS state,
            CASE WHEN c.v_type = 'I' AND b.kind = 2 AND b.p = b.noff + b.m - 1 THEN (2 * 10 + (b.read_id * 3 + b.m * 7) % 31 + (b.read_id * 3 + (b.m + 1) * 7) % 31) / 2.0 ELSE b.bq END AS bq
        FROM kept AS c JOIN bases AS b ON b.node_id = c.node_id AND b.p = c.v_pos
        UNION ALL
        SELECT c.*, m.ord, CASE WHEN c.v_type = 'D' AND c.v_ref = substr(m.sequence, m.noff + m.m + 1, 1) THEN 'alt' ELSE 'other' END, 10 + (m.read_id * 3 + (m.m - 1) * 7) % 31
        FROM kept AS c JOIN mappings AS m ON m.node_id = c.node_id AND m.mapq >= 10 AND m.kind = 3 AND m.noff + m.m = c.v_pos""",
    "summary": """SELECT node_id, v_pos, v_type, v_ref, v_alt, count(*) FILTER (state = 'alt') AS alt_allele_count, count(*) FILTER (state = 'ref') AS ref_allele_count_at_locus,
        count(*) FILTER (state = 'other') AS other_allele_count_at_locus, count(*) AS coverage_at_locus, count(*) FILTER (state = 'alt') / count(*) AS alt_allele_frequency,
        avg(bq) FILTER (state = 'alt') AS mean_alt_allele_base_quality FROM at_sites GROUP BY ALL""",
}
_PASSING = "alt_allele_count >= 3 AND alt_allele_frequency >= 0.05 AND mean_alt_allele_base_quality >= 10"


def _segments(t):
    return pileup.valid_segments(t.segments(), t.nodes())


def _ranked(t, kind="all"):
    return pileup.rank_segments(_segments(t), kind)


def _variants(t, kind="all"):
    return pileup.detect_variants(_ranked(t, kind), kind)


def _states(t):
    ranked = materialize(_ranked(t), "ranked")
    return pileup.allele_states(pileup.candidate_counts(pileup.detect_variants(ranked)), ranked)


def _summary(t):
    return pileup.variant_counts(_ranked(t))


QUERIES = {
    "b1_explode_mappings": (
        lambda t: align.explode_mappings(t.alignments()).select("name", "node_id", "offset", "is_reverse", "read_offset", "read_length", "bases"),
        sql("""SELECT 'read' || read_id AS name, node_id, CAST(noff AS BIGINT) AS "offset", strand = '-' AS is_reverse,
            CAST(coalesce(sum(length(fseq)) OVER (PARTITION BY read_id ORDER BY ord, node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS read_offset, length(fseq) AS read_length, fseq AS bases FROM mappings"""),
    ),
    "b2_edits_to_cigar": (
        lambda t: align.with_cigar(align.explode_mappings(t.alignments())).groupBy("node_id", "cigar").agg(F.count(F.lit(1)).alias("n")),
        sql("SELECT node_id, CASE WHEN kind = 1 THEN (m - 1) || 'M1X' ELSE fcigar END AS cigar, count(*) AS n FROM mappings GROUP BY ALL"),
    ),
    "b3_mapping_is_perfect": (
        lambda t: align.with_cigar(align.explode_mappings(t.alignments())).select("name", "node_id", "read_offset", "perfect"),
        sql("""SELECT 'read' || read_id AS name, node_id, CAST(coalesce(sum(length(fseq)) OVER (PARTITION BY read_id ORDER BY ord, node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS read_offset, kind = 0 AS perfect FROM mappings"""),
    ),
    "b4_mapq_gate": (
        lambda t: align.mapq_gate(t.alignments(), 11).groupBy("mapping_quality").agg(F.count(F.lit(1)).alias("n")),
        sql("SELECT mapping_quality, count(*) AS n FROM reads WHERE mapping_quality > 10 GROUP BY 1"),
    ),
    "b5_on_reference_path": (lambda t: align.on_reference_path(t.alignments(), "chr2").select("name"), sql("SELECT 'read' || read_id AS name FROM reads WHERE ref = 'chr2'")),
    "b6_imperfect_nodes": (
        lambda t: align.imperfect_nodes(align.node_stats(t.alignments())).select("node_id", "perfect", "not_perfect"),
        sql("SELECT node_id, perfect, not_perfect FROM node_stats WHERE not_perfect >= 1 AND not_perfect / (perfect + not_perfect) > 0.05"),
    ),
    "b6_imperfect_nodes_v1": (
        lambda t: align.imperfect_nodes(align.node_stats(t.alignments()), 0.10, 2).select("node_id"),
        sql("SELECT node_id FROM node_stats WHERE not_perfect > 1 AND not_perfect / (perfect + not_perfect) > 0.10"),
    ),
    "b7_imperfect_reads": (
        lambda t: align.imperfect_reads(t.alignments()).select("node_id", F.array_join("names", ",").alias("names")),
        sql("SELECT node_id, string_agg(DISTINCT 'read' || read_id, ',' ORDER BY 'read' || read_id) AS names FROM mappings JOIN reads USING (read_id) WHERE worst <> 0 GROUP BY 1"),
    ),
    "b8_segment_valid": (
        lambda t: _segments(t).select("node_id", "seg_order", "offset", "seq"),
        sql("""SELECT node_id, ord AS seg_order, noff AS "offset", fseq AS seq FROM mappings WHERE mapq >= 10"""),
    ),
    "b9_variant_type_filter": (
        lambda t: _variants(t, "indel").select("node_id", "seg_order", "v_pos", "v_type", "v_ref", "v_alt"), sql("SELECT node_id, ord AS seg_order, v_pos, v_type, v_ref, v_alt FROM indels", **_INDELS)
    ),
    "b10_candidate_thresholds": (
        lambda t: pileup.candidate_thresholds(_summary(t)).select(*pileup.VARIANT, "alt_allele_count"),
        sql(f"SELECT node_id, v_pos, v_type, v_ref, v_alt, alt_allele_count FROM summary WHERE {_PASSING}", **_INDELS),
    ),
    "c1_segments_on_nodes": (
        lambda t: align.segments_on_nodes(align.explode_mappings(t.alignments()), align.imperfect_nodes(align.node_stats(t.alignments()))).groupBy("node_id").agg(F.count(F.lit(1)).alias("n")),
        sql("SELECT node_id, count(*) AS n FROM mappings SEMI JOIN (SELECT node_id FROM node_stats WHERE not_perfect >= 1 AND not_perfect / (perfect + not_perfect) > 0.05) USING (node_id) GROUP BY 1"),
    ),
    "c13_allele_states": (
        lambda t: _states(t).groupBy(*pileup.VARIANT, "state").agg(F.count(F.lit(1)).alias("n"), F.sum("bq").alias("bq")),
        sql("SELECT node_id, v_pos, v_type, v_ref, v_alt, state, count(*) AS n, CAST(sum(bq) AS DOUBLE) AS bq FROM at_sites GROUP BY ALL", **_INDELS),
    ),
    "c19_reads_on_nodes": (
        lambda t: align.reads_on_nodes(t.alignments(), t.nodes().where("node_id % 50 = 0"), 20),
        sql("SELECT DISTINCT 'read' || read_id AS name FROM mappings JOIN reads USING (read_id) WHERE mapping_quality >= 20 AND node_id % 50 = 0"),
    ),
    "c20_reads_on_path": (
        lambda t: align.reads_on_path(t.alignments(), t.path_steps().where("chrom = 'chr1'"), t.nodes()).select("step", "node_id", "length", F.array_join("names", ",").alias("names")),
        sql("""SELECT step, node_id, path_steps.length, string_agg(DISTINCT 'read' || read_id, ',' ORDER BY 'read' || read_id) AS names FROM path_steps JOIN mappings USING (node_id) WHERE chrom = 'chr1' GROUP BY ALL"""),
    ),
    "d1_node_stats": (lambda t: align.node_stats(t.alignments()), sql("SELECT * FROM node_stats")),
    "d2_scan_totals": (
        lambda t: align.scan_totals(t.alignments()),
        sql("""SELECT (SELECT count(*) FROM reads WHERE mapping_quality > 5) AS reads, isum(perfect) AS perfect, isum(not_perfect) AS imperfect, sum(perfect) * 100.0 / (SELECT count(*) FROM reads WHERE mapping_quality > 5) AS perfect_percent,
            sum(not_perfect) * 100.0 / (SELECT count(*) FROM reads WHERE mapping_quality > 5) AS imperfect_percent FROM node_stats"""),
    ),
    "d3_candidate_counts": (lambda t: pileup.candidate_counts(_variants(t)), sql("SELECT * FROM kept", **_INDELS)),
    "d4_allele_summary": (lambda t: _summary(t), sql("SELECT * FROM summary", **_INDELS)),
    "d5_align_stats_graph": (
        lambda t: align.align_stats_graph(t.alignments()),
        sql("""SELECT count(*) AS total, count(*) AS aligned, count(*) FILTER (worst = 0) AS perfect, count(*) FILTER (NOT gaps) AS gapless, isum(mm) AS match_bp, isum(xx) AS substitution_bp, isum(ii) AS insertion_bp, isum(dd) AS deletion_bp,
            isum(ii) AS softclip_bp FROM (SELECT read_id, max(kind) AS worst, bool_or(kind >= 2) AS gaps, sum(CASE kind WHEN 1 THEN m - 1 WHEN 2 THEN m + 6 WHEN 3 THEN m + 6 ELSE m END) AS mm,
            count(*) FILTER (kind = 1) AS xx, 2 * count(*) FILTER (kind = 2) AS ii, count(*) FILTER (kind = 3) AS dd FROM mappings GROUP BY 1)"""),
    ),
    "d7_mapq_summary": (
        lambda t: align.mapq_summary(t.alignments()),
        sql("SELECT avg(mapping_quality) AS mean, stddev_samp(mapping_quality) AS sd, median(mapping_quality) AS median, count(*) AS n FROM reads"),
    ),
    "e2_rank_segments": (
        lambda t: _ranked(t, "indel").select("node_id", "seg_order", "weight", "rank"),
        sql("""SELECT node_id, ord AS seg_order, w AS weight, row_number() OVER (PARTITION BY node_id ORDER BY w DESC, ord) AS rank FROM (SELECT *, CASE kind WHEN 2 THEN 4 WHEN 3 THEN 2 ELSE 0 END AS w FROM mappings WHERE mapq >= 10)"""),
    ),
    "e6_dedupe_keys": (
        lambda t: pileup.dedupe_keys(pileup.candidate_thresholds(_summary(t)), t.nodes()).select(*pileup.VARIANT, "variant_key"),
        sql(f"""SELECT node_id, v_pos, v_type, v_ref, v_alt, CASE v_type WHEN 'X' THEN v_pos || '_X_' || v_ref || '_' || v_alt WHEN 'I' THEN v_pos || '_I_' || v_ref || '_' || v_ref || v_alt
            ELSE (v_pos - 1) || '_D_' || substr(sequence, v_pos, 1) || v_ref || '_' || substr(sequence, v_pos, 1) END AS variant_key FROM summary JOIN nodes USING (node_id) WHERE {_PASSING}""", **_INDELS),
    ),
    "f6_view_limit": (
        lambda t: pileup.pileup_view(_ranked(t), t.candidates(), variants_per_node=2, reads=5).select(*pileup.VARIANT, "row_no", F.length(F.regexp_replace("text", "[.]", "")).alias("shown")),
        sql("""SELECT v.node_id, v_pos, v_type, v_ref, v_alt, row_number() OVER (PARTITION BY v.node_id, v_pos, v_ref, v_alt ORDER BY ord) AS row_no, least(noff + span, v_pos + 50) - greatest(noff, v_pos - 50) AS shown
            FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY v_pos, v_type, v_ref, v_alt) AS nth FROM candidates) AS v JOIN mappings AS s ON s.node_id = v.node_id AND mapq >= 10 WHERE nth <= 2 QUALIFY row_no <= 5"""),
    ),
    "g8_pool_segments": (
        lambda t: pileup.candidate_counts(pileup.detect_variants(pileup.rank_segments(pileup.valid_segments(pileup.pool_segments(*(t.segments().where(f"seg_order div 10000000 % 3 = {k}") for k in range(3))).drop("file_no"), t.nodes())))),
        sql("SELECT * FROM kept", **_INDELS),
    ),
    "h1_cigar_ops": (
        lambda t: t.segments().withColumn("ops", cigar.cigar_ops(F.col("cigar"))).select("node_id", "seg_order", F.size("ops").alias("n"), cigar.summed(F.col("ops"), "M").alias("m"), cigar.summed(F.col("ops"), "ID").alias("gaps")),
        sql("SELECT node_id, ord AS seg_order, CASE WHEN kind >= 2 THEN 3 ELSE 1 END AS n, CASE WHEN kind >= 2 THEN m + 6 ELSE m END AS m, CASE kind WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS gaps FROM mappings"),
    ),
    "h2_cigar_walk": (
        lambda t: _segments(t).select("node_id", "seg_order", F.expr("element_at(walk, -1).node_pos").alias("node_pos"), F.expr("element_at(walk, -1).read_pos").alias("read_pos")),
        sql("SELECT node_id, ord AS seg_order, noff + CASE kind WHEN 2 THEN m WHEN 3 THEN m + 1 ELSE 0 END AS node_pos, CASE kind WHEN 2 THEN m + 2 WHEN 3 THEN m ELSE 0 END AS read_pos FROM mappings WHERE mapq >= 10"),
    ),
    "h3_reverse_complement": (lambda t: t.nodes().select("node_id", cigar.reverse_complement(F.col("sequence")).alias("rc")), sql("SELECT node_id, reverse(translate(sequence, 'ACGT', 'TGCA')) AS rc FROM nodes")),
    "h4_orient_segment": (
        lambda t: _segments(t).where("strand = '-'").select("node_id", "seg_order", "offset", F.array_join(F.transform("ops", lambda x: F.concat(x["n"].cast("string"), x["op"])), "").alias("cigar"), F.get("bq", 0).alias("first_bq")),
        sql("""SELECT node_id, ord AS seg_order, noff AS "offset", fcigar AS cigar, 10 + (read_id * 3) % 31 AS first_bq FROM mappings WHERE mapq >= 10 AND strand = '-'"""),
    ),
    "h5_detect_variants": (lambda t: _variants(t).select("node_id", "seg_order", "v_pos", "v_type", "v_ref", "v_alt"), sql("SELECT node_id, ord AS seg_order, v_pos, v_type, v_ref, v_alt FROM found", **_INDELS)),
    "h5b_detect_variants_v1": (
        lambda t: pileup.detect_variants_v1(_ranked(t)),
        sql("SELECT node_id, ord AS seg_order, v_pos, v_type, CASE v_type WHEN 'I' THEN '-' ELSE v_ref END AS v_ref, CASE v_type WHEN 'D' THEN '-' ELSE v_alt END AS v_alt FROM found", **_INDELS),
    ),
    "h6_allele_at": (
        lambda t: _states(t).where("v_type = 'D'").select(*pileup.VARIANT, "seg_order", "state", "bq"),
        sql("SELECT node_id, v_pos, v_type, v_ref, v_alt, ord AS seg_order, state, bq FROM at_sites WHERE v_type = 'D'", **_INDELS),
    ),
    "h7_variant_key": (
        lambda t: pileup.dedupe_keys(_variants(t, "indel").drop("seg_order").distinct(), t.nodes()).select("node_id", "variant_key"),
        sql("""SELECT DISTINCT node_id, CASE v_type WHEN 'I' THEN v_pos || '_I_' || v_ref || '_' || v_ref || v_alt ELSE (v_pos - 1) || '_D_' || substr(sequence, v_pos, 1) || v_ref || '_' || substr(sequence, v_pos, 1) END AS variant_key
            FROM indels JOIN nodes USING (node_id)""", **_INDELS),
    ),
    "h8_parse_variant_key": (
        lambda t: t.candidates().select("node_id", cigar.parse_variant_key(F.concat_ws("_", F.when(F.col("node_id") % 10 == 0, "x").otherwise(F.col("v_pos").cast("string")), "v_type", "v_ref", "v_alt")).alias("k")).where("k IS NOT NULL").select("node_id", "k.*"),
        sql("SELECT node_id, v_pos, v_type, v_ref, v_alt FROM candidates WHERE node_id % 10 <> 0"),
    ),
    "h9_non_m_weight": (
        lambda t: _segments(t).select("node_id", "seg_order", cigar.non_m_weight(F.col("ops"), "indel").alias("indel"), cigar.non_m_weight(F.col("ops"), "snp").alias("snp")),
        sql("SELECT node_id, ord AS seg_order, CASE kind WHEN 2 THEN 4 WHEN 3 THEN 2 ELSE 0 END AS indel, CASE kind WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS snp FROM mappings WHERE mapq >= 10"),
    ),
    "h13_window_start": (
        lambda t: _variants(t).select("node_id", "seg_order", "v_pos", "v_type", F.expr("v_pos + IF(v_type = 'I', 1, 0) - 50").alias("window_begin")).distinct(),
        sql("SELECT DISTINCT node_id, ord AS seg_order, v_pos, v_type, v_pos + CASE v_type WHEN 'I' THEN 1 ELSE 0 END - 50 AS window_begin FROM found", **_INDELS),
    ),
    "h17_pileup_view": (
        lambda t: pileup.pileup_view(_segments(t), t.candidates(rows=None)).select(*pileup.VARIANT, "row_no", F.expr("substring(text, 51, 1)").alias("center")),
        sql("""SELECT v.node_id, v_pos, v_type, v_ref, v_alt, row_number() OVER (PARTITION BY v.node_id, v_pos, v_ref, v_alt ORDER BY s.ord) AS row_no, coalesce(b.base, CASE WHEN kind = 3 AND noff + m = v_pos THEN '*' END, '.') AS center
            FROM candidates AS v JOIN mappings AS s ON s.node_id = v.node_id AND mapq >= 10 LEFT JOIN (SELECT ord, node_id, p, base FROM bases) AS b ON b.ord = s.ord AND b.node_id = s.node_id AND b.p = v_pos"""),
    ),
    "h34_masked_segment": (
        lambda t: align.masked_segment(align.explode_mappings(t.alignments())).select("name", "node_id", "read_offset", "masked"),
        sql("""SELECT 'read' || read_id AS name, node_id, CAST(coalesce(sum(length(fseq)) OVER (PARTITION BY read_id ORDER BY ord, node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS read_offset,
            CASE kind WHEN 1 THEN substr(fseq, 1, m - 1) || lower(substr(fseq, m, 1)) WHEN 2 THEN substr(fseq, 1, m) || 'gt' || substr(fseq, m + 3) ELSE fseq END AS masked FROM mappings"""),
    ),
    "h36_supporting_pileup": (
        lambda t: pileup.supporting_rows(_ranked(t), _variants(t, "snp")).select("node_id", "seg_order", "v_pos", "v_alt", "window_begin", "window_end"),
        sql("SELECT node_id, ord AS seg_order, v_pos, v_alt, greatest(v_pos - 50, 0) AS window_begin, least(v_pos + 50, nodes.length) AS window_end FROM found JOIN nodes USING (node_id) WHERE v_type = 'X'", **_INDELS),
    ),
    "h17_view_header": (
        lambda t: pileup.view_header(t.candidates(), t.nodes()),
        sql("""SELECT c.node_id, v_pos, v_type, v_ref, v_alt, repeat(' ', 50) || '^' || repeat(' ', 49) AS marker,
            repeat('0', greatest(50 - v_pos, 0)) || substr(sequence, greatest(v_pos - 50, 0) + 1, least(v_pos + 50, length) - greatest(v_pos - 50, 0)) || repeat('0', greatest(v_pos + 50 - length, 0)) AS reference FROM candidates AS c JOIN nodes USING (node_id)"""),
    ),
    "h34_quality_hex": (
        lambda t: align.masked_segment(align.explode_mappings(t.alignments())).groupBy("node_id").agg(F.count("quality_hex").alias("n"), F.sum(F.length("quality_hex")).alias("digits"), F.sum(F.length("masked")).alias("bases")),
        sql("SELECT node_id, count(*) AS n, CAST(sum(2 * length(fseq)) AS BIGINT) AS digits, CAST(sum(length(fseq)) AS BIGINT) AS bases FROM mappings GROUP BY 1"),
    ),
    "h36_coded_rows": (
        lambda t: pileup.coded_rows(pileup.supporting_rows(_ranked(t), _variants(t, "snp")).withColumn("begin", F.col("v_pos") - 50)).select(
            "node_id", "seg_order", "v_pos", "v_alt", F.size(F.filter("codes", lambda c: c < 6)).alias("cells"), F.expr("aggregate(filter(codes, c -> c < 6), 0, (s, c) -> s + c)").alias("code_sum"), F.expr("aggregate(qualities, 0, (s, q) -> s + q)").alias("quality_sum")),
        sql("""SELECT f.node_id, f.ord AS seg_order, v_pos, v_alt, CAST(count(*) AS INT) AS cells, CAST(sum(CASE s.base WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 5 END) AS INT) AS code_sum, CAST(sum(s.bq) AS INT) AS quality_sum
            FROM found AS f JOIN (SELECT node_id, ord, p, base, bq FROM bases WHERE p IS NOT NULL UNION ALL SELECT node_id, ord, noff + m, '*', 0 FROM mappings WHERE mapq >= 10 AND kind = 3 AND length(fseq) > m) AS s
            ON s.node_id = f.node_id AND s.ord = f.ord AND s.p BETWEEN v_pos - 50 AND v_pos + 49 WHERE v_type = 'X' GROUP BY ALL""", **_INDELS),
    ),
}
