"""Queries of graph nodes, paths and their files: name -> (query, DuckDB twin)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from strandloom.operators import align, nodes
from strandloom.plans.fixtures import sql
from strandloom.session import scratch_path
from strandloom.sources import graph_files

_AF = "CASE (node_id + i) % 8 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.1 WHEN 3 THEN 0.05 WHEN 4 THEN 0.001 WHEN 5 THEN 0.0002 WHEN 6 THEN 0.000001 ELSE 0.0 END"
_LEVEL = "CASE WHEN af IS NULL THEN 0 WHEN af >= 1 THEN 1 WHEN af < 0.000001 THEN 1 WHEN af < 0.00001 THEN 2 WHEN af < 0.0001 THEN 3 WHEN af < 0.001 THEN 4 WHEN af < 0.01 THEN 5 WHEN af < 0.1 THEN 6 WHEN af < 0.5 THEN 7 ELSE 8 END"
_DIGIT = "CASE WHEN af IS NULL THEN '0' WHEN af < 0.000001 THEN '0' WHEN af < 0.00001 THEN '1' WHEN af < 0.0001 THEN '2' WHEN af < 0.001 THEN '3' WHEN af < 0.01 THEN '4' WHEN af < 0.1 THEN '5' WHEN af < 0.5 THEN '6' ELSE '7' END"
_MORE = {
    "af_bases": f"SELECT node_id, i, CASE WHEN (node_id + i) % 9 <> 0 THEN CAST({_AF} AS DOUBLE) END AS af FROM (SELECT node_id, unnest(range(length)) AS i FROM nodes)",
    "comp": "SELECT node_id, CASE WHEN node_id % 50 <= 47 AND node_id > 1 THEN greatest(node_id // 50 * 50 + node_id % 2, CASE WHEN node_id % 2 = 0 THEN 2 ELSE 1 END) ELSE node_id END AS component FROM nodes",
    "reached": "SELECT DISTINCT s.chrom, c.node_id FROM path_steps AS s JOIN comp AS t USING (node_id) JOIN comp AS c ON c.component = t.component",
}


def _stats(t):
    return align.node_stats(t.alignments())


def _af_bases(t):
    bases = t.nodes().select("node_id", F.explode(F.sequence(F.lit(0), F.col("length") - 1)).alias("i"))
    return bases.withColumn("af", F.expr(f"IF((node_id + i) % 9 <> 0, double({_AF}), NULL)"))


def _edges(t):
    ids = t.nodes().select("node_id")
    edges = ids.where("node_id % 50 < 46").select(F.col("node_id").alias("from_id"), F.lit("+").alias("from_orient"), (F.col("node_id") + 2).alias("to_id"), F.lit("+").alias("to_orient"))
    return edges.join(ids.withColumnRenamed("node_id", "to_id"), "to_id", "left_semi").select("from_id", "from_orient", "to_id", "to_orient")


def _gfa(t):
    path = scratch_path(t.spark, "gfa")
    graph_files.write_gfa(t.nodes(), t.path_steps(), _edges(t), path)
    return graph_files.read_gfa(t.spark, path)


def _a5(t):
    path = scratch_path(t.spark, "node-json")
    rows = t.nodes().join(t.coords().drop("length"), "node_id", "left").selectExpr("string(node_id) AS node_id", "start AS position_start", "IF(node_id % 11 = 0, '?', strand) AS strand", "sequence", "chrom")
    packed = rows.where("node_id % 2 = 0").groupBy(F.expr("node_id % 7")).agg(F.collect_list(F.struct("*")).alias("nodes")).select(F.to_json(F.struct("nodes")).alias("value"))
    rows.where("node_id % 2 = 1").select(F.to_json(F.struct("*")).alias("value")).union(packed).write.text(path)
    return graph_files.read_node_json(t.spark, path).select("node_id", "start", "strand", "length", "chrom")


def _a13(t):
    one, two = (scratch_path(t.spark, "ids") for _ in range(2))
    graph_files.write_node_ids(t.nodes().where("node_id % 3 = 0"), one)
    graph_files.write_node_ids(t.nodes().where("node_id % 4 = 0"), two)
    return graph_files.read_node_ids(t.spark, one, two)


def _text(t, rows, *lines):
    """Rows as text files that each begin with the header lines."""
    path = scratch_path(t.spark, "text")

    def headed(batches):
        begun = False
        for batch in batches:
            values = batch.column(0)
            yield pa.RecordBatch.from_arrays([values if begun else pa.concat_arrays([pa.array(lines, values.type), values])], ["value"])
            begun = True

    rows.mapInArrow(headed, "value string").write.text(path)
    return path


def _a14(t):
    rows = t.nodes().where("node_id % 5 = 0").orderBy("node_id").selectExpr("concat_ws('\t', node_id + 1, concat(node_id, '; ', node_id + 100000)) AS value")
    return graph_files.read_alt_ref_tsv(t.spark, _text(t, rows, "REF_NODE\tALT_NODE(S)"))


def _neighbours(t):
    rows = t.nodes().selectExpr("concat_ws('\t', node_id, IF(node_id % 10 = 1, '.', string(node_id - 1)), IF(node_id % 10 = 0, '', string(node_id + 1))) AS value")
    return graph_files.read_neighbor_tsv(t.spark, _text(t, rows, "Node_ID\tLEFT_NODE\tRight_Node"))


def _a16(t):
    rows = t.coords().where("node_id % 4 = 0").selectExpr("concat_ws('\t', chrom, start - 1, start - 1 + length) AS value")
    return graph_files.read_bed(t.spark, _text(t, rows, "#chrom\tstart\tend"))


def _a17(t):
    path = scratch_path(t.spark, "fasta")
    graph_files.write_fasta(t.nodes().selectExpr("concat('n', node_id % 4) AS contig", "(node_id - 1) div 4 AS chunk_no", "rpad(sequence, 60, 'N') AS bases"), path)
    spots = t.nodes().selectExpr("concat('n', node_id % 4) AS contig", "(node_id - 1) div 4 * 60 + 1 + node_id % 20 AS pos")
    return graph_files.fasta_base(spots, graph_files.read_fasta(t.spark, path))


def _a21(t):
    path = scratch_path(t.spark, "coords")
    graph_files.write_coord_table(t.coords(), path)
    return graph_files.read_coord_table(t.spark, path)


def _frequencies(t):
    spots = t.coords().select("chrom", F.explode(F.expr("sequence(start, start + length - 1)")).alias("pos")).where("pos % 3 = 0")
    return spots.selectExpr("chrom", "pos", "explode(array(struct(pos AS row_no, 0.25D AS af), struct(pos + 1000000000 AS row_no, 1.0D / (1 + pos % 97) AS af))) AS x").select("chrom", "pos", "x.*")


def _store(t):
    path = scratch_path(t.spark, "segment_store")
    return graph_files.segment_store(t.segments().drop("bq"), path.rsplit("/", 1)[1].replace("-", "_"), path, 8)


def _stored(t):
    return t.mappings().where("node_id % 2 = 0").select("node_id")


QUERIES = {
    "a4_read_gfa": (
        lambda t: _gfa(t)[0].select("node_id", "ln_tag", "length", F.length("sequence").alias("bases")), sql("SELECT node_id, length AS ln_tag, length, length AS bases FROM nodes")
    ),
    "a4_read_gfa_edges": (lambda t: _gfa(t)[2], sql("SELECT node_id AS from_id, '+' AS from_orient, node_id + 2 AS to_id, '+' AS to_orient FROM nodes WHERE node_id % 50 < 46 AND node_id + 2 IN (SELECT node_id FROM nodes)")),
    "a5_read_node_json": (_a5, sql("SELECT node_id, start, CASE WHEN node_id % 11 = 0 THEN '+' ELSE coalesce(strand, '+') END AS strand, nodes.length, chrom FROM nodes LEFT JOIN coords USING (node_id)")),
    "a13_node_ids": (_a13, sql("SELECT node_id FROM nodes WHERE node_id % 3 = 0 OR node_id % 4 = 0")),
    "a14_read_alt_ref_tsv": (_a14, sql("SELECT alt_node, arg_max(ref_node, node_id) AS ref_node FROM (SELECT node_id, unnest([node_id, node_id + 100000]) AS alt_node, node_id + 1 AS ref_node FROM nodes WHERE node_id % 5 = 0) GROUP BY 1")),
    "a15_read_neighbor_tsv": (_neighbours, sql("SELECT node_id, CASE WHEN node_id % 10 <> 1 THEN node_id - 1 END AS left_node, CASE WHEN node_id % 10 <> 0 THEN node_id + 1 END AS right_node FROM nodes")),
    "a16_read_bed": (_a16, sql('SELECT chrom, start - 1 AS start, start - 1 + length AS "end" FROM coords WHERE node_id % 4 = 0')),
    "a17_read_fasta": (_a17, sql("SELECT 'n' || node_id % 4 AS contig, (node_id - 1) // 4 * 60 + 1 + node_id % 20 AS pos, substr(sequence, CAST(node_id % 20 AS INT) + 1, 1) AS base FROM nodes")),
    "a19_segment_store": (
        lambda t: _store(t).groupBy("node_id").agg(F.count(F.lit(1)).alias("n"), F.min("mapq").alias("low"), F.max("seg_order").alias("last")),
        sql("SELECT node_id, count(*) AS n, min(mapq) AS low, max(ord) AS last FROM mappings GROUP BY 1"),
    ),
    "a21_coord_table": (_a21, sql("SELECT node_id, start, strand, length, chrom FROM coords")),
    "a22_node_stats_io": (lambda t: graph_files.node_stats_io(_stats(t), scratch_path(t.spark, "stats")), sql("SELECT * FROM node_stats")),
    "b18_fallback_columns": (
        lambda t: graph_files.canonical_nodes(t.nodes().join(t.coords().select("node_id", "start"), "node_id", "left").selectExpr("string(node_id) AS node_id", "IF(node_id % 2 = 0, start - 1, NULL) AS grch38_position_start", "start AS position_start",
            "CASE node_id % 3 WHEN 0 THEN '-' WHEN 1 THEN 'x' END AS strand_in_path", "'-' AS strand", "int(NULL) AS length", "string(NULL) AS chrom", "sequence", "array(0.5D) AS genomead_af")).select("node_id", "start", "strand", "length"),
        sql("SELECT node_id, CASE WHEN node_id % 2 = 0 THEN coalesce(start - 1, start) ELSE start END AS start, CASE WHEN node_id % 3 = 1 THEN '+' ELSE '-' END AS strand, nodes.length FROM nodes LEFT JOIN coords USING (node_id)"),
    ),
    "b19_drop_fields": (
        lambda t: nodes.enrich_nodes(t.nodes().select("node_id"), t.nodes().withColumn("genomead_af", F.lit(0.5)).withColumn("chrom", F.lit("chr9")), t.nodes(), "chr1").drop("sequence"),
        sql("SELECT node_id, length, 'chr9' AS chrom FROM nodes"),
    ),
    "c2_candidate_nodes": (
        lambda t: nodes.candidate_nodes(t.nodes(), _stored(t), t.nodes().where("node_id % 3 = 0"), t.nodes().where("node_id % 5 = 0")).select("node_id", "length"),
        sql("SELECT node_id, length FROM nodes WHERE node_id IN (SELECT node_id FROM mappings WHERE node_id % 2 = 0) AND (node_id % 3 = 0 OR node_id % 5 = 0)"),
    ),
    "c3_enrich_nodes": (
        lambda t: nodes.enrich_nodes(t.nodes().selectExpr("node_id + 3 AS node_id"), t.nodes().where("node_id % 3 <> 0").selectExpr("node_id", "IF(node_id % 4 = 0, '', upper(sequence)) AS sequence", "0.1D AS genomead_af", "IF(node_id % 2 = 0, 'chrA', NULL) AS chrom"),
            t.nodes().where("node_id % 7 <> 0"), "chrB"),
        sql("""SELECT i.node_id, CASE WHEN i.node_id % 3 <> 0 AND i.node_id % 4 <> 0 AND n.node_id IS NOT NULL THEN n.sequence WHEN i.node_id % 7 <> 0 AND n.node_id IS NOT NULL THEN n.sequence ELSE '' END AS sequence,
            CASE WHEN i.node_id % 3 <> 0 AND i.node_id % 2 = 0 AND n.node_id IS NOT NULL THEN 'chrA' ELSE 'chrB' END AS chrom FROM (SELECT node_id + 3 AS node_id FROM nodes) AS i LEFT JOIN nodes AS n ON n.node_id = i.node_id"""),
    ),
    "c4_attach_coordinates": (
        lambda t: nodes.attach_coordinates(t.nodes().select("node_id", "length"), t.coords().union(t.coords().where("node_id % 13 = 0"))),
        sql("SELECT nodes.node_id, nodes.length, chrom, start, strand FROM nodes LEFT JOIN coords ON coords.node_id = nodes.node_id AND coords.node_id % 13 <> 0"),
    ),
    "c5_path_lengths": (lambda t: nodes.path_lengths(t.path_steps(), t.nodes()), sql("SELECT chrom, step, node_id, strand, length FROM path_steps")),
    "c6_af_by_position": (
        lambda t: nodes.af_by_position(t.coords(), _frequencies(t)).select("node_id", F.size("af").alias("n"), F.aggregate("af", F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))).alias("total"), F.get("af", 0).alias("first")),
        sql("""SELECT node_id, max(length) AS n, sum(CASE WHEN (start + i) % 3 = 0 THEN 1.0 / (1 + (start + i) % 97) ELSE 0.0 END) AS total, max(CASE WHEN i = 0 AND start % 3 = 0 THEN 1.0 / (1 + start % 97) END) AS first
            FROM (SELECT *, unnest(range(length)) AS i FROM coords) GROUP BY 1"""),
    ),
    "c17_neighbor_context": (
        lambda t: nodes.neighbor_context(t.nodes(), _neighbours(t)),
        sql("""SELECT n.node_id, right(l.sequence, 1) AS left_base, left(r.sequence, 1) AS right_base FROM nodes AS n LEFT JOIN nodes AS l ON l.node_id = n.node_id - 1 AND n.node_id % 10 <> 1
            LEFT JOIN nodes AS r ON r.node_id = n.node_id + 1 AND n.node_id % 10 <> 0"""),
    ),
    "c26_stats_lengths": (
        lambda t: nodes.stats_lengths(_stats(t).select("node_id", "perfect"), t.nodes().where("node_id % 6 <> 0").selectExpr("node_id", "IF(node_id % 2 = 0, '*', sequence) AS sequence", "IF(node_id % 4 = 0, 77, NULL) AS ln_tag")),
        sql("""SELECT node_id, perfect, CASE WHEN node_id % 6 = 0 THEN 0 WHEN node_id % 4 = 0 THEN 77 WHEN node_id % 2 = 0 THEN 0 ELSE length END AS segment_length, node_id % 6 = 0 AS missing FROM node_stats JOIN nodes USING (node_id)"""),
    ),
    "d16_length_stats": (lambda t: nodes.length_stats(t.nodes()), sql("SELECT count(*) AS n, min(length) AS min, max(length) AS max, avg(length) AS mean, median(length) AS median, stddev_samp(length) AS sd FROM nodes")),
    "d17_length_bins": (
        lambda t: nodes.length_bins(t.nodes(), 7),
        sql("""SELECT bin, lo + bin * width AS low, lo + bin * width + width - 1 AS high, count(n.length) AS count, count(n.length) * 100.0 / max(total) AS percent FROM (SELECT *, unnest(range(7)) AS bin FROM (
            SELECT min(length) AS lo, CAST(ceil((max(length) - min(length) + 1) / 7) AS BIGINT) AS width, count(*) AS total FROM nodes)) LEFT JOIN nodes AS n ON (n.length - lo) // width = bin GROUP BY bin, lo, width"""),
    ),
    "d19_component_summary": (
        lambda t: nodes.component_summary(nodes.chrom_components(t.path_steps().where("node_id % 50 < 10"), _edges(t)), t.path_steps().select("chrom", "node_id")),
        sql("""SELECT chrom, count(l) AS component, count(r) AS path, count(*) FILTER (l = 1 AND r = 1) AS shared, count(*) FILTER (r IS NULL) AS only_component, count(*) FILTER (l IS NULL) AS only_path,
            round(coalesce(count(*) FILTER (l = 1 AND r = 1) * 100.0 / nullif(count(l), 0), 0), 6) AS shared_of_component, round(coalesce(count(*) FILTER (l = 1 AND r = 1) * 100.0 / nullif(count(r), 0), 0), 6) AS shared_of_path,
            round(coalesce(count(*) FILTER (r IS NULL) * 100.0 / nullif(count(l), 0), 0), 6) AS only_of_component
            FROM (SELECT DISTINCT s.chrom, c.node_id, 1 AS l FROM path_steps AS s JOIN comp AS t USING (node_id) JOIN comp AS c ON c.component = t.component WHERE s.node_id % 50 < 10)
            FULL JOIN (SELECT chrom, node_id, 1 AS r FROM path_steps) USING (chrom, node_id) GROUP BY chrom""", **_MORE),
    ),
    "e1_path_positions": (lambda t: t.coords(), sql("SELECT * FROM coords")),
    "e5_first_seen_union": (
        lambda t: nodes.first_seen_union(t.mappings().where("kind = 3").selectExpr("node_id", "ord AS row_no"), t.mappings().where("kind < 3").selectExpr("node_id", "ord AS row_no")),
        sql("SELECT node_id, min(file_no) AS file_no, min(ord) FILTER (file_no = low) AS row_no FROM (SELECT *, CASE WHEN kind = 3 THEN 0 ELSE 1 END AS file_no, min(CASE WHEN kind = 3 THEN 0 ELSE 1 END) OVER (PARTITION BY node_id) AS low FROM mappings) GROUP BY 1"),
    ),
    "e7_last_wins": (lambda t: nodes.last_wins(_frequencies(t), ["chrom", "pos"], "row_no").select("chrom", "pos", "af"), sql("SELECT chrom, pos, 1.0 / (1 + pos % 97) AS af FROM (SELECT chrom, unnest(range(start, start + length)) AS pos FROM coords) WHERE pos % 3 = 0")),
    "f1_top_nodes": (
        lambda t: nodes.top_nodes(_stats(t), 25, "imperfect_ratio", 5).select("rank", "node_id", "total", "imperfect_ratio"),
        sql("""SELECT row_number() OVER (ORDER BY imperfect_ratio DESC, node_id) AS rank, * FROM (SELECT node_id, perfect + not_perfect AS total, not_perfect / (perfect + not_perfect) AS imperfect_ratio FROM node_stats) WHERE total >= 5 ORDER BY 1 LIMIT 25"""),
    ),
    "f2_top_lengths": (lambda t: nodes.top_lengths(t.nodes(), 10), sql("SELECT length, count(*) AS n, count(*) * 100.0 / (SELECT count(*) FROM nodes) AS percent FROM nodes GROUP BY 1 ORDER BY n DESC, length LIMIT 10")),
    "g2_compare_node_sets": (
        lambda t: nodes.compare_node_sets(t.nodes().where("node_id % 2 = 0"), t.path_steps()),
        sql("SELECT count(*) FILTER (node_id % 2 = 0 AND node_id % 5 <> 0) AS shared, count(*) FILTER (node_id % 2 = 0 AND node_id % 5 = 0) AS only_left, count(*) FILTER (node_id % 2 = 1 AND node_id % 5 <> 0) AS only_right FROM nodes"),
    ),
    "g3_union_node_lists": (lambda t: nodes.union_node_lists(t.nodes().where("node_id % 2 = 0"), t.nodes().where("node_id % 3 = 0")), sql("SELECT node_id FROM nodes WHERE node_id % 2 = 0 OR node_id % 3 = 0")),
    "g4_idx_vs_tsv_nodes": (
        lambda t: nodes.idx_vs_tsv_nodes(_stored(t), t.nodes().selectExpr("IF(node_id % 10 = 0, '[bad', concat('[', node_id, ',', node_id + 1, ']')) AS graph_nodes")),
        sql("""SELECT count(*) FILTER (l AND r) AS shared, count(*) FILTER (r IS NULL) AS only_left, count(*) FILTER (l IS NULL) AS only_right, (SELECT count(*) FROM nodes WHERE node_id % 10 = 0) AS bad_rows
            FROM (SELECT DISTINCT node_id, true AS l FROM mappings WHERE node_id % 2 = 0) FULL JOIN (SELECT DISTINCT unnest([node_id, node_id + 1]) AS node_id, true AS r FROM nodes WHERE node_id % 10 <> 0) USING (node_id)"""),
    ),
    "g5_union_store_ids": (
        lambda t: nodes.candidate_nodes(t.nodes().select("node_id"), nodes.union_node_lists(t.mappings().where("kind = 2"), t.mappings().where("kind = 3"))),
        sql("SELECT DISTINCT node_id FROM mappings WHERE kind IN (2, 3)"),
    ),
    "h10_af_level": (
        lambda t: _af_bases(t).groupBy("node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", nodes.af_level(F.col("af")).alias("v")))), lambda x: x["v"].cast("string")), "").alias("levels")),
        sql(f"SELECT node_id, string_agg({_LEVEL}, '' ORDER BY i) AS levels FROM af_bases GROUP BY 1", **_MORE),
    ),
    "h11_af_digit": (
        lambda t: _af_bases(t).groupBy("node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", nodes.af_digit(F.col("af")).alias("v")))), lambda x: x["v"]), "").alias("digits")),
        sql(f"SELECT node_id, string_agg({_DIGIT}, '' ORDER BY i) AS digits FROM af_bases GROUP BY 1", **_MORE),
    ),
    "h21_walk_steps": (lambda t: graph_files.path_steps(_gfa(t)[1]).select("chrom", "step", "node_id", "strand"), sql("SELECT chrom, row_number() OVER (PARTITION BY chrom ORDER BY node_id) - 1 AS step, node_id, strand FROM path_steps")),
    "h29_segment_length": (
        lambda t: t.nodes().select("node_id", graph_files.segment_length(F.when(F.col("node_id") % 2 == 0, "*").otherwise(F.col("sequence")), F.when(F.col("node_id") % 3 == 0, F.col("length") * 2)).alias("n")),
        sql("SELECT node_id, CASE WHEN node_id % 3 = 0 THEN length * 2 WHEN node_id % 2 = 0 THEN 0 ELSE length END AS n FROM nodes"),
    ),
    "h32_ratios": (
        lambda t: nodes.with_ratios(_stats(t)).select("node_id", "perfect_ratio", "imperfect_ratio"),
        sql("SELECT node_id, perfect / (perfect + not_perfect) AS perfect_ratio, not_perfect / (perfect + not_perfect) AS imperfect_ratio FROM node_stats"),
    ),
    "j10_chrom_components": (lambda t: nodes.chrom_components(t.path_steps(), _edges(t)), sql("SELECT chrom, node_id FROM reached", **_MORE)),
}
