"""Queries of dataset assembly, metrics, tensors, alignment files and the stream: name -> (query, DuckDB twin)."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions.variants import keep_decision, keep_decision_simple
from strandloom.operators import align, dataset, metrics, nodes, pileup, tensor
from strandloom.plans import gam_files
from strandloom.plans.fixtures import sql
from strandloom.plans.graph_queries import _AF, _DIGIT, _MORE, _af_bases
from strandloom.plans.pileup_queries import _ranked
from strandloom.plans.variant_queries import _PLACED_BASES, _anchors, _cigar_reads, _labelled, _read_blocks
from strandloom.session import scratch_path
from strandloom.sources import alignment_files, summary_files
from strandloom.streaming import node_stats

_V = "node_id, v_pos, v_ref, v_alt"
_LABELS = {
    "labelled": """SELECT c.*, CASE WHEN start IS NULL THEN -1 ELSE coalesce((SELECT max(CASE WHEN t.ref = v_ref AND t.alt = v_alt THEN 1 ELSE 0 END) FROM truth AS t
        WHERE t.chrom = c.chrom AND t.pos - 1 < start + v_pos + 1 AND t.pos - 1 + length(t.ref) > start + v_pos - 1), 0) END AS label FROM (SELECT * FROM candidates LEFT JOIN coords USING (node_id)) AS c""",
    "scored": "SELECT l.*, p.shard_index, p.index_within_shard, p.p_true, CASE WHEN p.pred_class = 'true' THEN 1 ELSE 0 END AS pred FROM labelled AS l JOIN predictions AS p USING (node_id, v_pos, v_ref, v_alt)",
}
#: what the derived mappings draw in SNV windows of 100 columns; a tensor has 201 rows, and -1 stands where nothing is drawn
_CODE = "CASE {b} WHEN 'A' THEN 20 WHEN 'C' THEN 30 WHEN 'G' THEN 50 WHEN 'T' THEN 70 WHEN '*' THEN 1 ELSE 5 END"
_DRAWN = {
    "shown": """SELECT node_id, ord, mapq, CASE WHEN j < m THEN noff + j WHEN kind = 2 THEN noff + j - 2 ELSE noff + j + 1 END AS p, substr(fseq, j + 1, 1) AS base, 10 + (read_id * 3 + j * 7) % 31 AS bq, 10 AS cig
        FROM (SELECT *, unnest(range(length(fseq))) AS j FROM mappings WHERE mapq >= 10) WHERE NOT (kind = 2 AND j >= m AND j < m + 2)
        UNION ALL SELECT node_id, ord, mapq, noff + m, '*', 0, 50 FROM mappings WHERE mapq >= 10 AND kind = 3""",
    "cells": f"""SELECT c.node_id, c.v_pos, c.v_ref, c.v_alt, p - c.v_pos + 51 AS col, ord, {_CODE.format(b='base')} AS b0, bq AS b1, CASE WHEN base = substr(sequence, p + 1, 1) THEN 0 WHEN p = c.v_pos THEN 5 ELSE 1 END AS b2, mapq AS b3, cig AS b4
        FROM candidates AS c JOIN shown AS s ON s.node_id = c.node_id AND p BETWEEN c.v_pos - 50 AND c.v_pos + 49 JOIN nodes AS n ON n.node_id = c.node_id
        UNION ALL SELECT c.node_id, v_pos, v_ref, v_alt, p - v_pos + 51, NULL, """ + _CODE.format(b="substr(sequence, p + 1, 1)") + """, 0, -1, -1, 0
        FROM (SELECT c.*, sequence, unnest(range(greatest(0, v_pos - 50), least(length(sequence), v_pos + 50))) AS p FROM candidates AS c JOIN nodes USING (node_id)) AS c""",
    # channels 2 and 3 are -1 where nothing is drawn: a drawn cell adds one to that
    "channel_sums": "SELECT node_id, v_pos, v_ref, v_alt, CAST(count(DISTINCT ord) AS INT) AS n_rows, "
    + ", ".join(f"CAST(sum(b{c}{' + 1' if c in (2, 3) else ''}) - {20100 if c in (2, 3) else 0} AS BIGINT) AS sum_{c}, CAST(sum((b{c}{' + 1' if c in (2, 3) else ''}) * col) - {201 * 5050 if c in (2, 3) else 0} AS BIGINT) AS placed_{c}" for c in range(5))
    + " FROM cells GROUP BY ALL",
    "squares": "SELECT count(DISTINCT (node_id, v_pos, v_ref, v_alt)) * 20100 AS n, "
    + ", ".join(f"sum(b{c}{' + 1' if c in (2, 3) else ''}) AS s{c}, sum(b{c} * b{c}{' - 1' if c in (2, 3) else ''}) AS q{c}" for c in range(5))
    + " FROM cells",
    "moments": " UNION ALL ".join(f"SELECT {c} AS channel, n, CAST(s{c}{' - n' if c in (2, 3) else ''} AS DOUBLE) AS s, CAST(q{c}{' + n' if c in (2, 3) else ''} AS DOUBLE) AS q FROM squares" for c in range(5)),
}
_MEANS, _SDS, _WEIGHTS = [10.0, 8.0, 0.0, 0.5, 0.0], [20.0, 15.0, 10.0, 1.0, 1.0], (1.0, -2.0, 30.0, 0.5, 1.5)
_LOGIT = " + ".join(f"({w}) * (sum_{c} / 20100.0 - {m}) / {d}" for c, (m, d, w) in enumerate(zip(_MEANS, _SDS, _WEIGHTS, strict=True)))
_KEY = "md5('{seed}|' || node_id || '|' || v_pos || '|' || v_ref || '|' || v_alt)"
_KEYS = ["node_id", "v_pos", "v_ref", "v_alt"]


def _scored(t):
    rows = t.predictions().select(*_KEYS, "shard_index", "index_within_shard", "p_true", F.expr("IF(pred_class = 'true', 1, 0)").alias("pred"))
    return _labelled(t).join(rows, _KEYS)


def _known(t):
    return dataset.known_labels(_scored(t)).select("label", "pred", F.concat_ws("_", *_KEYS).alias("key"), "shard_index")


def _drawable(t):
    """Candidates and the ranked segments of their nodes: no other node is ranked."""
    found = t.candidates()
    return found, pileup.rank_segments(pileup.valid_segments(t.segments(), t.nodes().join(found.select("node_id"), "node_id", "left_semi")), "snp")


def _tensors(t):
    return tensor.tensors(*_drawable(t))


def _gam_json(t):
    path = scratch_path(t.spark, "gam-json")
    alignment_files.write_gam_json(t.alignments(), path)
    return path


def _gam(t):
    folder = scratch_path(t.spark, "gam")
    gam_files.write_gam(t.alignments().repartition(max(5, t.spark.sparkContext.defaultParallelism)), folder)
    # of small ranges, so that groups lie across them; node statistics need these columns only
    return alignment_files.read_gam(t.spark, folder, ("name", "sequence", "mapping_quality", "identity", "path"), split=1 << 18)


def _sam(t):
    path = scratch_path(t.spark, "sam")
    flag = "CASE WHEN map_rank = 1 AND read_id % 7 = 0 THEN 4 WHEN map_rank = 2 THEN 256 WHEN map_rank = 3 THEN 2048 ELSE 0 END"
    rows = t.mappings().selectExpr(f"concat_ws('\t', concat('read', read_id), {flag}, concat('n', node_id), noff + 1, mapq, fcigar, '*', '0', '0', fseq, '*', concat('NM:i:', CASE kind WHEN 2 THEN 3 WHEN 3 THEN 1 WHEN 1 THEN 1 ELSE 0 END)) AS value")
    rows.unionByName(t.spark.createDataFrame([("@HD\tVN:1.6",), ("short\tline",)], "value string")).write.text(path)
    return alignment_files.read_sam(t.spark, path)


def _predictions_file(t):
    path = scratch_path(t.spark, "predictions")
    t.predictions().selectExpr("concat('/x7/shard_', shard_index, '_data.npy') AS shard_path", "index_within_shard AS index_in_shard", "pred_class", "IF(node_id % 2 = 0, map('True', p_true, 'False', 1 - p_true), NULL) AS probs", "IF(pred_class = 'true', p_true, 1 - p_true) AS pred_prob").write.json(path)
    return summary_files.read_predictions(t.spark, path)


def _summary_file(t):
    path = scratch_path(t.spark, "summary")
    summary_files.write_summary(t.candidates().withColumn("variant_key", F.concat_ws("_", "v_pos", "v_type", "v_ref", "v_alt")).drop("coverage"), path)
    return summary_files.read_summary(t.spark, path)


def _stream(t):
    folder = scratch_path(t.spark, "gam-stream")
    alignment_files.write_gam_json(t.alignments().repartition(5), folder)
    return node_stats.run_to_table(node_stats.node_stats_stream(t.spark, folder), scratch_path(t.spark, "stream-table"), scratch_path(t.spark, "stream-state"))


QUERIES = {
    "a1_read_gam": (lambda t: align.node_stats(_gam(t)), sql("SELECT * FROM node_stats")),
    "a2_read_gam_json": (lambda t: align.node_stats(alignment_files.read_gam_json(t.spark, _gam_json(t))), sql("SELECT * FROM node_stats")),
    "a3_read_gam_many": (
        lambda t: (lambda p: alignment_files.read_gam_many(t.spark, [p], f"# list\n{p}\n").groupBy("file_no").agg(F.count(F.lit(1)).alias("n")))(_gam_json(t)), sql("SELECT 0 AS file_no, count(*) AS n FROM reads"),
    ),
    "a6_summary": (
        lambda t: _summary_file(t).select("node_id", "variant_key", "alt_allele_count", "coverage_at_locus"), sql("SELECT node_id, v_pos || '_X_' || v_ref || '_' || v_alt AS variant_key, alt_allele_count, coverage_at_locus FROM candidates")
    ),
    "a12_read_sam": (lambda t: _sam(t).groupBy("flag", "nm").agg(F.count(F.lit(1)).alias("n")),
        sql("SELECT CASE WHEN map_rank = 1 AND read_id % 7 = 0 THEN 4 WHEN map_rank = 2 THEN 256 WHEN map_rank = 3 THEN 2048 ELSE 0 END AS flag, CASE kind WHEN 2 THEN 3 WHEN 3 THEN 1 WHEN 1 THEN 1 ELSE 0 END AS nm, count(*) AS n FROM mappings GROUP BY ALL")),
    "a18_read_predictions": (lambda t: _predictions_file(t).withColumn("p_true", F.round("p_true", 6)), sql("SELECT shard_index, index_within_shard, pred_class, round(p_true, 6) AS p_true FROM predictions")),
    "a20_tensor_shards": (
        lambda t: dataset.tensor_shards(t.candidates(), 256, *pileup.VARIANT).select(*_KEYS, "shard_index", "index_within_shard"),
        sql(f"SELECT {_V}, CAST(rn // 256 AS INT) AS shard_index, CAST(rn % 256 AS INT) AS index_within_shard FROM (SELECT *, row_number() OVER (ORDER BY node_id, v_pos, v_type, v_ref, v_alt) - 1 AS rn FROM candidates)"),
    ),
    "b15_keep_decision": (
        lambda t: t.predictions().join(_anchors(t), "node_id", "left").select(*_KEYS, keep_decision(F.when(F.col("v_pos") % 9 != 0, F.col("p_true")), F.col("pred_class") == "true", F.col("chrom").isNotNull(), 0.5, 0.2, 0.1).alias("filter")).where("filter IS NOT NULL"),
        sql(f"""SELECT * FROM (SELECT {_V}, CASE WHEN v_pos % 9 = 0 THEN NULL WHEN chrom IS NOT NULL AND p_true >= 0.5 THEN 'PASS' WHEN chrom IS NULL AND p_true >= 0.2 THEN 'PASS' WHEN p_true >= 0.1 THEN 'RefCall' END AS filter FROM predictions LEFT JOIN coords USING (node_id)) WHERE filter IS NOT NULL"""),
    ),
    "b16_keep_decision_simple": (
        lambda t: t.predictions().select(*_KEYS, keep_decision_simple(F.col("pred_class"), F.when(F.col("v_pos") % 9 != 0, F.col("p_true")), 0.7, 0.3).alias("filter")).where("filter IS NOT NULL"),
        sql(f"SELECT * FROM (SELECT {_V}, CASE WHEN p_true >= 0.5 AND (v_pos % 9 = 0 OR p_true >= 0.7) THEN 'PASS' WHEN v_pos % 9 <> 0 AND p_true >= 0.3 THEN 'RefCall' END AS filter FROM predictions) WHERE filter IS NOT NULL"),
    ),
    "b17_known_labels": (lambda t: dataset.known_labels(_labelled(t)).groupBy("label").agg(F.count(F.lit(1)).alias("n")), sql("SELECT label, count(*) AS n FROM labelled WHERE label >= 0 GROUP BY 1", **_LABELS)),
    "c15_score_to_meta": (
        lambda t: dataset.score_to_meta(t.predictions().select("shard_index", "index_within_shard", "p_true"), t.predictions().where("index_within_shard % 10 <> 3").selectExpr("shard_index", "index_within_shard", "node_id", "v_pos", "node_id AS row_no"))[0],
        sql("SELECT shard_index, index_within_shard, p_true, node_id, v_pos FROM predictions WHERE index_within_shard % 10 <> 3"),
    ),
    "d6_align_stats_linear": (
        lambda t: align.align_stats_linear(_sam(t)),
        sql("""SELECT count(*) AS total, count(*) FILTER (NOT un) AS aligned, count(*) FILTER (NOT un AND kind = 0) AS perfect, count(*) FILTER (NOT un AND kind < 2) AS gapless, isum(CASE WHEN un THEN 0 WHEN kind IN (1, 2) THEN 1 ELSE 0 END) AS substitution_bp,
            isum(CASE WHEN NOT un AND kind = 2 THEN 2 ELSE 0 END) AS insertion_bp, isum(CASE WHEN NOT un AND kind = 3 THEN 1 ELSE 0 END) AS deletion_bp, isum(0 * m) AS softclip_bp FROM (SELECT *, map_rank = 1 AND read_id % 7 = 0 AS un FROM mappings WHERE map_rank NOT IN (2, 3))"""),
    ),
    "d11_channel_moments": (
        lambda t: tensor.moments_of_arrays(t.raw("embeddings"), 4, "embedding"),
        "SELECT CAST(i * 4 // n AS INT) AS channel, count(x) AS n, avg(CAST(x AS DOUBLE)) AS mean, stddev_samp(CAST(x AS DOUBLE)) AS sd FROM (SELECT unnest(embedding) AS x, unnest(range(len(embedding))) AS i, len(embedding) AS n FROM embeddings) GROUP BY 1",
    ),
    "d11_tensor_moments": (
        lambda t: tensor.channel_moments(_tensors(t), tensor.CHANNELS),
        sql("SELECT CAST(channel AS INT) AS channel, CAST(n AS BIGINT) AS n, s / n AS mean, sqrt((q - s * s / n) / (n - 1)) AS sd FROM moments WHERE n > 0", **_DRAWN),
    ),
    "d12_class_metrics": (
        lambda t: metrics.class_metrics(_known(t)),
        sql("""SELECT tp, fp, fn, tn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, tn / (tn + fp) AS accuracy_0, tp / (tp + fn) AS accuracy_1, (tp + tn) / (tp + fp + fn + tn) AS accuracy FROM (
            SELECT count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label = 0 AND pred = 1) AS fp, count(*) FILTER (label = 1 AND pred = 0) AS fn, count(*) FILTER (label = 0 AND pred = 0) AS tn FROM scored WHERE label >= 0)""", **_LABELS),
    ),
    "d12b_class_metrics_avg": (
        lambda t: metrics.class_metrics_avg(t.raw("labels").select(F.col("quality").alias("label"), (1 - F.col("toxic")).alias("pred"))),
        """SELECT avg(p) AS macro_precision, avg(r) AS macro_recall, avg(f) AS macro_f1, sum(p * s) / sum(s) AS weighted_precision, sum(r * s) / sum(s) AS weighted_recall, sum(f * s) / sum(s) AS weighted_f1 FROM (
            SELECT tp / nullif(pr, 0) AS p, tp / nullif(s, 0) AS r, 2 * tp / (pr + s) AS f, s FROM (SELECT c, count(*) FILTER (quality = c AND 1 - toxic = c) AS tp, count(*) FILTER (quality = c) AS s, count(*) FILTER (1 - toxic = c) AS pr FROM labels, (SELECT unnest([0, 1]) AS c) GROUP BY c))""",
    ),
    "d13_prediction_report": (
        lambda t: metrics.prediction_report(_known(t)),
        sql("""SELECT outcome, key, count(*) OVER (PARTITION BY outcome) AS n FROM (SELECT node_id || '_' || v_pos || '_' || v_ref || '_' || v_alt AS key, CASE WHEN pred = 1 THEN CASE label WHEN 1 THEN 'TP' ELSE 'FP' END WHEN label = 1 THEN 'FN' ELSE 'TN' END AS outcome
            FROM scored WHERE label >= 0)""", **_LABELS),
    ),
    "d20_candidate_sites": (
        lambda t: metrics.candidate_sites(_read_blocks(t).selectExpr("chrom", "r_start + 1 AS first", "ref_bases", "bases", "explode(sequence(0, length(bases) - 1)) AS i").selectExpr("chrom", "first + i AS pos", "substr(ref_bases, i + 1, 1) AS ref", "substr(bases, i + 1, 1) AS base")),
        sql("""SELECT chrom, count(*) AS sites, count(*) FILTER (alt > 2 AND alt / depth > 0.05) AS snv_sites FROM (
            SELECT chrom, pos, sum(n) AS depth, max(CASE WHEN base <> ref THEN n ELSE 0 END) AS alt FROM (SELECT chrom, pos, ref, base, count(*) AS n FROM placed_bases GROUP BY ALL) GROUP BY 1, 2) GROUP BY 1""", placed_bases=_PLACED_BASES),
    ),
    "d20_candidate_kinds": (
        lambda t: metrics.candidate_kinds(_read_blocks(t).selectExpr("chrom", "r_start + 1 AS first", "ref_bases", "bases", "explode(sequence(0, length(bases) - 1)) AS i").selectExpr("chrom", "first + i AS pos", "substr(ref_bases, i + 1, 1) AS ref", "substr(bases, i + 1, 1) AS base"), metrics.indel_anchors(_cigar_reads(t))),
        sql("""SELECT chrom, count(*) AS sites, count(*) FILTER (snv > 2 AND snv / depth > 0.05) AS snv_sites, count(*) FILTER (ins > 2 AND ins / depth > 0.05) AS ins_sites, count(*) FILTER (del > 2 AND del / depth > 0.05) AS del_sites,
            count(*) FILTER (snv > 2 AND snv / depth > 0.05 OR ins > 2 AND ins / depth > 0.05 OR del > 2 AND del / depth > 0.05) AS any_sites FROM (SELECT chrom, pos, depth, snv, coalesce(ins, 0) AS ins, coalesce(del, 0) AS del
            FROM (SELECT chrom, pos, count(*) AS depth, count(*) FILTER (base <> ref) AS snv FROM placed_bases GROUP BY 1, 2) LEFT JOIN (SELECT chrom, start + noff + m - 1 AS pos, count(*) FILTER (kind = 2) AS ins, count(*) FILTER (kind = 3) AS del
                FROM mappings JOIN (SELECT node_id, chrom, start FROM coords) USING (node_id) WHERE kind >= 2 GROUP BY 1, 2) USING (chrom, pos)) GROUP BY 1""", placed_bases=_PLACED_BASES),
    ),
    "d22_label_distribution": (
        lambda t: metrics.label_distribution(_known(t)),
        sql("SELECT shard_index, label, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY shard_index) AS share FROM (SELECT * FROM scored WHERE label >= 0) GROUP BY GROUPING SETS ((label), (shard_index, label))", **_LABELS),
    ),
    "e3_tensor_row_no": (
        lambda t: tensor.tensor_row_no(t.candidates(), _ranked(t, "snp"), tensor.ROWS).select(*_KEYS, "seg_order", "row_no"),
        sql("""SELECT v.node_id, v_pos, v_ref, v_alt, ord AS seg_order, CAST(row_number() OVER (PARTITION BY v.node_id, v_pos, v_ref, v_alt ORDER BY CASE kind WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END DESC, ord) AS INT) AS row_no FROM candidates AS v JOIN mappings AS s ON s.node_id = v.node_id AND mapq >= 10
            WHERE noff < v_pos + 50 AND noff + span > v_pos - 50 QUALIFY row_no <= 200"""),
    ),
    "e4_shard_number": (
        lambda t: dataset.global_rank(t.candidates(), *pileup.VARIANT).select(*_KEYS, "rank"), sql(f"SELECT {_V}, row_number() OVER (ORDER BY node_id, v_pos, v_type, v_ref, v_alt) - 1 AS rank FROM candidates")
    ),
    "e8_dedupe_calls": (
        lambda t: dataset.dedupe_calls(t.predictions().withColumn("index_within_shard", F.expr("int(index_within_shard div 2)")).withColumn("ord", F.expr("node_id * 1000 + v_pos * 10 + ascii(v_alt) % 10")), "ord").select("shard_index", "index_within_shard", "ord"),
        sql("SELECT shard_index, CAST(index_within_shard // 2 AS INT) AS index_within_shard, min(node_id * 1000 + v_pos * 10 + ascii(v_alt) % 10) AS ord FROM predictions GROUP BY 1, 2"),
    ),
    "g6_fp_overlap": (
        lambda t: metrics.fp_overlap(_known(t), t.candidates().where("node_id % 2 = 0").select(F.concat_ws("_", *_KEYS).alias("key"))),
        sql("SELECT count(*) FILTER (node_id % 2 = 0) AS overlap, count(*) FILTER (node_id % 2 = 1) AS rest, count(*) FILTER (node_id % 2 = 0) / count(*) AS rate FROM scored WHERE label = 0 AND pred = 1", **_LABELS),
    ),
    "g7_merge_nodes": (
        lambda t: t.nodes().where("node_id % 2 = 0").select("node_id", "length").unionByName(_af_bases(t).where("node_id % 2 = 1").groupBy("node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", nodes.af_digit(F.col("af")).alias("d")))), lambda x: x["d"]), "").alias("af")), allowMissingColumns=True),
        sql(f"SELECT node_id, length, NULL AS af FROM nodes WHERE node_id % 2 = 0 UNION ALL SELECT node_id, NULL, string_agg({_DIGIT}, '' ORDER BY i) FROM af_bases WHERE node_id % 2 = 1 GROUP BY 1", **_MORE),
    ),
    "h12_af_channel": (
        lambda t: _af_bases(t).groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", nodes.af_digit(F.col("af")).cast("int").alias("d")))), lambda x: x["d"]).alias("levels")).select("node_id", F.array_join(tensor.af_channel(F.col("levels"), F.lit(10) - 50), "").alias("row")),
        sql(f"SELECT node_id, repeat('0', 40) || rpad(left(string_agg({_DIGIT}, '' ORDER BY i), 60), 60, '0') AS row FROM af_bases GROUP BY 1", **_MORE),
    ),
    "h14_tensor_rows": (lambda t: tensor.channel_sums(_tensors(t)).drop("v_type"), sql("SELECT * FROM channel_sums", **_DRAWN)),
    "h15_mismatch_flags": (
        lambda t: tensor.mismatch_counts(_tensors(t)).select(*_KEYS, "n_5", (F.col("n_0") + F.col("n_1") + F.col("n_5")).alias("cells")),
        sql("""SELECT v.node_id, v_pos, v_ref, v_alt, CAST(count(*) FILTER (p = v_pos AND base <> v_ref) AS INT) AS n_5, CAST(count(*) AS INT) AS cells FROM candidates AS v JOIN site_states AS s ON s.node_id = v.node_id
            WHERE p BETWEEN v_pos - 50 AND v_pos + 49 GROUP BY ALL"""),
    ),
    "h16_build_tensor": (
        lambda t: _tensors(t).select(*_KEYS, F.octet_length("data").alias("bytes"), "n_rows"),
        sql("SELECT v.node_id, v_pos, v_ref, v_alt, 100500 AS bytes, CAST(count(*) AS INT) AS n_rows FROM candidates AS v JOIN mappings AS s ON s.node_id = v.node_id AND mapq >= 10 WHERE noff < v_pos + 50 AND noff + span > v_pos - 50 GROUP BY ALL"),
    ),
    "h33_normalize_tensor": (
        lambda t: tensor.normalize(t.raw("embeddings"), [0.0, 0.1, 0.2, 0.3], [1.0, 2.0, 3.0, 4.0], "embedding").select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 6).alias("total")),
        "SELECT vec_id, round(sum((CAST(x AS DOUBLE) - (i * 4 // n) / 10.0) / (1 + i * 4 // n)), 6) AS total FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i, len(embedding) AS n FROM embeddings) GROUP BY 1",
    ),
    "j1_split_by_chrom": (
        lambda t: dataset.split_by_chrom(t.calls().select("chrom", "pos"), {"chr1": "train", "chr3": "val"}).groupBy("split").agg(F.count(F.lit(1)).alias("n")), sql("SELECT CASE chrom WHEN 'chr1' THEN 'train' ELSE 'val' END AS split, count(*) AS n FROM calls WHERE chrom <> 'chr2' GROUP BY 1")
    ),
    "j2_split_stratified": (
        lambda t: dataset.split_stratified(_labelled(t), "label", _KEYS, 0.7, 0.2, 3).select(*_KEYS, "split"),
        sql(f"""SELECT {_V}, CASE WHEN nth <= floor(n * 0.7) THEN 'train' WHEN nth <= floor(n * 0.7) + floor(n * 0.2) THEN 'val' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_KEY.format(seed=3)}) AS nth, count(*) OVER (PARTITION BY label) AS n FROM labelled)""", **_LABELS),
    ),
    "j2_split_genotype": (
        lambda t: dataset.split_stratified(t.candidates().select(*_KEYS).withColumn("genotype", dataset.genotype_of(F.expr("concat_ws('_', node_id, v_pos, concat('GT', node_id % 2, '|', v_pos % 2, '.npy'))"))), "genotype", _KEYS, 0.8, 0.1, 4).select(*_KEYS, "genotype", "split"),
        sql(f"""SELECT {_V}, genotype, CASE WHEN nth <= floor(n * 0.8) THEN 'train' WHEN nth <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY genotype ORDER BY {_KEY.format(seed=4)}) AS nth, count(*) OVER (PARTITION BY genotype) AS n
            FROM (SELECT {_V}, 'GT' || node_id % 2 || '|' || v_pos % 2 AS genotype FROM candidates))"""),
    ),
    "j3_downsample_false": (
        lambda t: dataset.downsample_false(_scored(t), 0.5, _KEYS, 5, True).select(*_KEYS, "label", "shard_index"),
        sql(f"""SELECT {_V}, label, shard_index FROM (SELECT *, row_number() OVER (PARTITION BY shard_index, label ORDER BY {_KEY.format(seed=5)}) AS nth, count(*) OVER (PARTITION BY shard_index, label) AS n FROM scored) WHERE label = 1 OR (label = 0 AND nth > round_even(n * 0.5, 0))""", **_LABELS),
    ),
    "j4_shuffle_shards": (
        lambda t: dataset.shuffle_shards(t.candidates(), 100, _KEYS, 7).select(*_KEYS, "shard_index", "index_within_shard"),
        sql(f"SELECT {_V}, CAST(rn // 100 AS INT) AS shard_index, CAST(rn % 100 AS INT) AS index_within_shard FROM (SELECT *, row_number() OVER (ORDER BY {_KEY.format(seed=7)}) - 1 AS rn FROM candidates)"),
    ),
    "j5_shard_labels": (
        lambda t: dataset.shard_labels(_scored(t).where("index_within_shard % 4 <> 1"), t.predictions().groupBy("shard_index").agg(F.count(F.lit(1)).alias("n"))).select("shard_index", F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels")),
        sql("SELECT shard_index, string_agg(CASE WHEN index_within_shard % 4 = 1 THEN -1 ELSE label END, ',' ORDER BY index_within_shard) AS labels FROM scored GROUP BY 1", **_LABELS),
    ),
    "j6_class_to_label": (
        lambda t: t.predictions().select(*_KEYS, dataset.class_to_label(F.initcap("pred_class")).alias("binary"), dataset.class_to_label(F.concat(F.lit("c"), F.col("node_id") % 4), ["c0", "c1", "c2"]).alias("many")),
        sql(f"SELECT {_V}, CASE pred_class WHEN 'true' THEN 1 ELSE 0 END AS binary, CASE WHEN node_id % 4 < 3 THEN CAST(node_id % 4 AS INT) END AS many FROM predictions"),
    ),
    "j7_batch_score": (
        lambda t: dataset.score_where_built(*_drawable(t), _MEANS, _SDS, dataset.mean_scorer(_WEIGHTS)).drop("v_type").withColumn("p_true", F.floor(F.col("p_true") * 1000 + 0.5) / 1000),
        sql(f"SELECT {_V}, floor(1000 / (1 + exp(-2 * t)) + 0.5) / 1000 AS p_true, CASE WHEN t > 0 THEN 'true' ELSE 'false' END AS pred_class FROM (SELECT *, {_LOGIT} AS t FROM channel_sums)", **_DRAWN),
    ),
    "j8_calls_to_vcf": (
        lambda t: dataset.calls_to_vcf(t.predictions().select(*_KEYS, "p_true", "pred_class"), _anchors(t), p_refcall=0.1).drop("info"),
        sql("""SELECT chrom, pos, ref, alt, filter, is_linear FROM (SELECT coalesce(chrom, CAST(node_id AS VARCHAR)) AS chrom, CASE WHEN chrom IS NULL THEN v_pos + 1 WHEN strand = '-' THEN start + length - 1 - v_pos ELSE start + v_pos END AS pos, v_ref AS ref, v_alt AS alt,
            CASE WHEN chrom IS NOT NULL AND p_true >= 0.5 THEN 'PASS' WHEN chrom IS NULL AND p_true >= 0.2 THEN 'PASS' WHEN p_true >= 0.1 THEN 'RefCall' END AS filter, chrom IS NOT NULL AS is_linear FROM predictions LEFT JOIN coords USING (node_id)) WHERE filter IS NOT NULL"""),
    ),
    "j11_pure_class_shards": (
        lambda t: dataset.pure_class_shards(_labelled(t), "label", 100, *_KEYS).select(*_KEYS, "label", "shard_index", "index_within_shard"),
        sql(f"""SELECT {_V}, label, CAST(first + nth // 100 AS INT) AS shard_index, CAST(nth % 100 AS INT) AS index_within_shard FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_V}) - 1 AS nth FROM labelled)
            JOIN (SELECT label, coalesce(sum(shards) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM (SELECT label, ceil(count(*) / 100) AS shards FROM labelled GROUP BY 1)) USING (label)""", **_LABELS),
    ),
    "k1_node_stats_stream": (_stream, sql("SELECT * FROM node_stats")),
}
