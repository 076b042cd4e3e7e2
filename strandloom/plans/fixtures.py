"""Genomics tables derived from the driver's parquet by integer arithmetic, in Spark and (``CTES``) in DuckDB.

part gives graph nodes, lineitem gives mappings of reads onto them: kind 2 has an insertion, kind 3 a deletion (only on
nodes divisible by 3, so that some nodes stay perfect), and reads divisible by 3 mismatch at fixed places.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions.cigar import reverse_complement
from strandloom.session import materialize


_CANDIDATES: dict[tuple, DataFrame] = {}


class Tables:
    """Derived tables of one data folder, built lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self._written: dict[str, DataFrame] = {}

    def _stored(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A derived table as a user has it: stored. Filters on its columns would otherwise derive them once more each."""
        if name not in self._written:
            self._written[name] = materialize(make(), name)
        return self._written[name]

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _dealt(self, rows: DataFrame, *keys: str) -> DataFrame:
        """Rows of files that can't be split as often as there are cores, dealt over them before anything is derived."""
        cores = self.spark.sparkContext.defaultParallelism
        return rows.repartition(cores, *keys) if rows.rdd.getNumPartitions() < cores else rows

    def nodes(self) -> DataFrame:
        """node_id, length, sequence."""
        # the base depends on p_partkey % 4 and comes again after twelve places
        unit = "element_at(array('AAGTCCAAGTCC', 'TTCGAATTCGAA', 'GGACTTGGACTT', 'CCTAGGCCTAGG'), int(p_partkey % 4) + 1)"
        return self.raw("part").selectExpr("p_partkey + 1 AS node_id", "p_size + 20 AS length", f"substr(repeat({unit}, int((p_size + 31) div 12)), 1, p_size + 20) AS sequence")

    def path_steps(self) -> DataFrame:
        """chrom, step, node_id, strand: nodes on the reference path, in order."""
        return self.nodes().where("node_id % 5 <> 0").selectExpr("concat('chr', 1 + node_id % 3) AS chrom", "node_id AS step", "node_id", "if(node_id % 7 = 0, '-', '+') AS strand")

    def coords(self) -> DataFrame:
        """node_id, chrom, start (1-based), strand, length."""
        from strandloom.operators.nodes import path_lengths, path_positions

        return path_positions(path_lengths(self.path_steps(), self.nodes())).select("node_id", "chrom", "start", "strand", "length")

    def mappings(self) -> DataFrame:
        """One row per read and node: offset and sequence along the node's forward strand."""
        items = self.raw("lineitem").selectExpr(
            "l_orderkey AS read_id", "l_linenumber AS map_rank", "l_partkey + 1 AS node_id", "int((l_orderkey + l_linenumber) % 4) AS noff", "int(7 + l_orderkey % 4) AS m",
            "if((l_partkey + 1) % 3 = 0, int(l_quantity) % 4, 0) AS kind", "int(5 + l_suppkey % 56) AS mapq", "if(l_suppkey % 5 = 0, '-', '+') AS strand",
            "(l_orderkey * 10 + l_linenumber) * 1000000 + l_suppkey * 100 + int(l_quantity) AS ord",
        )
        # of at most 10 bases one at most lies where (noff + i + node_id) % 13 = 0
        first = "int(pmod(-(noff + node_id), 13))"
        changed = f"concat(substr(sequence, noff + 1, {first}), translate(substr(sequence, noff + {first} + 1, 1), 'ACGT', 'CGTA'), substr(sequence, noff + {first} + 2, m - {first} - 1))"
        head = f"IF(read_id % 3 = 0 AND {first} < m, {changed}, substr(sequence, noff + 1, m))"
        tail = "CASE kind WHEN 2 THEN concat('GT', substr(sequence, noff + m + 1, 6)) WHEN 3 THEN substr(sequence, noff + m + 2, 6) ELSE '' END"
        return self._dealt(items, "read_id", "map_rank").join(self.nodes(), "node_id").selectExpr(
            "read_id", "map_rank", "node_id", "noff", "m", "kind", "mapq", "strand", "ord", "length", "sequence", f"concat({head}, {tail}) AS fseq",
            "CASE kind WHEN 2 THEN concat(m, 'M2I6M') WHEN 3 THEN concat(m, 'M1D6M') ELSE concat(m, 'M') END AS fcigar", "CASE kind WHEN 2 THEN m + 6 WHEN 3 THEN m + 7 ELSE m END AS span",
        )

    def segments(self) -> DataFrame:
        """The stored form: minus-strand rows hold the reverse complement and an offset from the other end."""
        return self._stored("segments", self._segments)

    def _segments(self) -> DataFrame:
        minus = F.col("strand") == "-"
        back = "CASE kind WHEN 2 THEN concat('6M2I', m, 'M') WHEN 3 THEN concat('6M1D', m, 'M') ELSE fcigar END"
        # 10 + (read_id * 3 + i * 7) % 31 for the at most 18 bases: a run of one sequence, as 27 * 7 leaves 3
        qualities = ", ".join(str(10 + i * 7 % 31) for i in range(31 + 18))
        quality = f"slice(array({qualities}), int(read_id * 27 % 31) + 1, length(fseq))"
        return self.mappings().select(
            "node_id", F.col("ord").alias("seg_order"), F.when(minus, F.col("length") - F.col("span") - F.col("noff")).otherwise(F.col("noff")).alias("offset"),
            F.when(minus, reverse_complement(F.col("fseq"))).otherwise(F.col("fseq")).alias("seq"), F.expr(f"if(strand = '-', reverse({quality}), {quality})").alias("bq"),
            F.expr(f"if(strand = '-', {back}, fcigar)").alias("cigar"), "mapq", "strand",
        )

    def alignments(self) -> DataFrame:
        """One row per read with its mappings as nested edits."""
        return self._stored("alignments", self._alignments)

    def _alignments(self) -> DataFrame:
        edits = """CASE WHEN kind = 2 THEN array(named_struct('from_length', m, 'to_length', m, 'sequence', ''), named_struct('from_length', 0, 'to_length', 2, 'sequence', 'GT'),
                                                 named_struct('from_length', 6, 'to_length', 6, 'sequence', ''))
                        WHEN kind = 3 THEN array(named_struct('from_length', m, 'to_length', m, 'sequence', ''), named_struct('from_length', 1, 'to_length', 0, 'sequence', ''),
                                                 named_struct('from_length', 6, 'to_length', 6, 'sequence', ''))
                        WHEN kind = 1 THEN array(named_struct('from_length', m - 1, 'to_length', m - 1, 'sequence', ''), named_struct('from_length', 1, 'to_length', 1, 'sequence', 'N'))
                        ELSE array(named_struct('from_length', m, 'to_length', m, 'sequence', '')) END"""
        rows = self.mappings().selectExpr(
            "read_id", "mapq", "fseq", "kind",
            f"struct(ord, struct(node_id, bigint(noff) AS offset, strand = '-' AS is_reverse) AS position, {edits} AS edit, bigint(map_rank) AS rank) AS mapping",
        )
        reads = rows.groupBy("read_id").agg(F.array_sort(F.collect_list("mapping")).alias("ms"), F.max("mapq").alias("mapping_quality"), F.max("kind").alias("worst"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("mapping.ord", "mapping.position.node_id", "fseq"))), lambda x: x["fseq"]), "").alias("sequence"))
        return reads.selectExpr(
            "concat('read', read_id) AS name", "sequence", "encode(repeat('I', length(sequence)), 'UTF-8') AS quality", "mapping_quality", "if(worst = 0, 1.0D, 0.9D) AS identity",
            "array(named_struct('name', concat('chr', 1 + read_id % 3), 'offset', read_id, 'is_reverse', false)) AS refpos",
            "named_struct('mapping', transform(ms, x -> named_struct('position', x.position, 'edit', x.edit, 'rank', x.rank))) AS path",
        )

    def _state(self) -> tuple:
        """The files that segments are derived from, with their times and sizes."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([f"{self.sf_dir}/{name}.parquet" for name in ("part", "lineitem")])
        return tuple(sorted(tuple(map(str, r)) for r in files.select("path", "modificationTime", "length").collect()))

    def candidates(self, kind: str = "snp", rows: int | None = 200) -> DataFrame:
        """Candidates of the pileup with counts: SNVs, or all kinds; without ``rows`` those of all segments, however deep a node is."""
        from strandloom.operators import pileup

        key = (self.spark.sparkContext.applicationId, kind, rows, self._state())
        if key not in _CANDIDATES:  # many queries start from it
            _CANDIDATES[key] = materialize(pileup.candidate_summary(self.segments(), self.nodes(), kind=kind, rows=rows), "candidates")
        return _CANDIDATES[key]

    def truth_of_all(self) -> DataFrame:
        """``truth``, and two thirds of the insertions and deletions, in small letters on even nodes."""
        indel = self.candidates("all").where("v_type <> 'X'").join(self.coords(), "node_id").join(self.nodes().select("node_id", "sequence"), "node_id").where("(node_id + v_pos) % 3 <> 0")
        anchor = "substr(sequence, v_pos, 1)"
        rows = indel.selectExpr(
            "chrom", "IF(v_type = 'D', start + v_pos - 1, start + v_pos) AS pos", f"IF(v_type = 'D', concat({anchor}, v_ref), v_ref) AS ref", f"IF(v_type = 'D', {anchor}, concat(v_ref, v_alt)) AS alt", "node_id % 2 = 0 AS small"
        )
        cased = rows.selectExpr("chrom", "pos", "IF(small, lower(ref), ref) AS ref", "array(IF(small, lower(alt), alt)) AS alts")
        return self.truth().select("chrom", F.col("pos").cast("long").alias("pos"), "ref", "alts").unionByName(cased.withColumn("pos", F.col("pos").cast("long"))).distinct()

    def truth(self) -> DataFrame:
        """chrom, pos, ref, alts: two thirds of the candidates on the path; odd nodes' with a base in front."""
        rows = self.candidates().join(self.coords(), "node_id").where("(node_id + v_pos) % 3 <> 0")
        return rows.selectExpr("chrom", "if(node_id % 2 = 1, start + v_pos - 1, start + v_pos) AS pos", "if(node_id % 2 = 1, concat('A', v_ref), v_ref) AS ref", "array(v_alt) AS alts").distinct()

    def calls(self) -> DataFrame:
        """Candidate calls in linear coordinates: chrom, pos, ref, alts, filters, info."""
        rows = self.candidates().join(self.coords(), "node_id")
        return rows.selectExpr(
            "chrom", "start + v_pos AS pos", "concat('n', node_id, '_', v_pos) AS id", "v_ref AS ref", "if(node_id % 4 = 0, array(v_alt, 'N'), array(v_alt)) AS alts", "'.' AS qual",
            "CASE node_id % 3 WHEN 0 THEN array('PASS') WHEN 1 THEN array('PASS', 'LowConf') ELSE array('RefCall') END AS filters",
            "map('NID', string(node_id), 'NSO', string(v_pos), 'DP', string(coverage)) AS info",
        )

    def panel(self, k: int) -> DataFrame:
        """Panel of normals ``k`` of 1..4: every 3rd, 5th, 7th, 11th candidate; 2 has other ALTs, 3 bare contig names."""
        rows = self.candidates().join(self.coords(), "node_id").where(f"(node_id + v_pos) % {(3, 5, 7, 11)[k - 1]} = 0")
        return rows.selectExpr("replace(chrom, 'chr', '') AS chrom" if k == 3 else "chrom", "start + v_pos AS pos", "v_ref AS ref", "array('G')" " AS alts" if k == 2 else "array(v_alt) AS alts")

    def predictions(self) -> DataFrame:
        """shard_index, index_within_shard, probs, pred_class, and the candidate's columns."""
        order = Window.partitionBy("shard_index").orderBy("node_id", "v_pos", "v_ref", "v_alt")
        rows = self.candidates().withColumn("shard_index", (F.col("node_id") % 8).cast("int")).withColumn("index_within_shard", F.row_number().over(order) - 1)
        rows = rows.withColumn("p_true", ((F.col("node_id") * 37 + F.col("v_pos") * 11) % 101) / F.lit(100.0))
        return rows.withColumn("pred_class", F.when(F.col("p_true") >= 0.5, "true").otherwise("false"))


CTES = {
    "nodes": """SELECT p_partkey + 1 AS node_id, p_size + 20 AS length,
        array_to_string(list_transform(range(p_size + 20), lambda i: substr('ACGT', 1 + (p_partkey * 7 + i * i * 3 + i * 5 + i // 3) % 4, 1)), '') AS sequence FROM part""",
    "path_steps": """SELECT 'chr' || (1 + node_id % 3) AS chrom, node_id AS step, node_id, CASE WHEN node_id % 7 = 0 THEN '-' ELSE '+' END AS strand, length FROM nodes WHERE node_id % 5 <> 0""",
    "coords": """SELECT node_id, chrom, 1 + CAST(coalesce(sum(length) OVER (PARTITION BY chrom ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, strand, length FROM path_steps""",
    "mappings": """SELECT read_id, map_rank, node_id, noff, m, kind, mapq, strand, ord, length, sequence,
        array_to_string(list_transform(range(m), lambda i: CASE WHEN (noff + i + node_id) % 13 = 0 AND read_id % 3 = 0 THEN translate(substr(sequence, noff + i + 1, 1), 'ACGT', 'CGTA')
                                                               ELSE substr(sequence, noff + i + 1, 1) END), '')
        || CASE kind WHEN 2 THEN 'GT' || substr(sequence, noff + m + 1, 6) WHEN 3 THEN substr(sequence, noff + m + 2, 6) ELSE '' END AS fseq,
        CASE kind WHEN 2 THEN m || 'M2I6M' WHEN 3 THEN m || 'M1D6M' ELSE m || 'M' END AS fcigar, CASE kind WHEN 2 THEN m + 6 WHEN 3 THEN m + 7 ELSE m END AS span
        FROM (SELECT l_orderkey AS read_id, l_linenumber AS map_rank, l_partkey + 1 AS node_id, CAST((l_orderkey + l_linenumber) % 4 AS INT) AS noff, CAST(7 + l_orderkey % 4 AS INT) AS m,
                     CASE WHEN (l_partkey + 1) % 3 = 0 THEN CAST(floor(l_quantity) AS INT) % 4 ELSE 0 END AS kind, CAST(5 + l_suppkey % 56 AS INT) AS mapq, CASE WHEN l_suppkey % 5 = 0 THEN '-' ELSE '+' END AS strand,
                     (l_orderkey * 10 + l_linenumber) * 1000000 + l_suppkey * 100 + CAST(floor(l_quantity) AS INT) AS ord FROM lineitem) JOIN nodes USING (node_id)""",
    "reads": """SELECT read_id, max(mapq) AS mapping_quality, max(kind) AS worst, string_agg(fseq, '' ORDER BY ord, node_id) AS sequence, 'chr' || (1 + read_id % 3) AS ref FROM mappings GROUP BY read_id""",
    # the bases of each mapping with their place on the node and their quality
    "bases": """SELECT node_id, ord, read_id, kind, noff, m, j, CASE WHEN j < m THEN noff + j WHEN kind = 2 AND j >= m + 2 THEN noff + j - 2 WHEN kind = 3 THEN noff + j + 1 END AS p,
        substr(fseq, j + 1, 1) AS base, 10 + (read_id * 3 + j * 7) % 31 AS bq, sequence FROM (SELECT *, unnest(range(length(fseq))) AS j FROM mappings WHERE mapq >= 10)""",
    "snv_found": """SELECT node_id, p AS v_pos, 'X' AS v_type, substr(sequence, p + 1, 1) AS v_ref, base AS v_alt FROM bases WHERE p IS NOT NULL AND base <> substr(sequence, p + 1, 1)""",
    "site_states": """SELECT node_id, p, base, CAST(bq AS DOUBLE) AS bq FROM bases WHERE p IS NOT NULL
        UNION ALL SELECT node_id, noff + m, '*', NULL FROM mappings WHERE mapq >= 10 AND kind = 3""",
    "snv_all": """SELECT c.node_id, c.v_pos, c.v_type, c.v_ref, c.v_alt, count(*) FILTER (base = v_alt) AS alt_allele_count, count(*) FILTER (base = v_ref) AS ref_allele_count_at_locus,
        count(*) FILTER (base <> v_alt AND base <> v_ref) AS other_allele_count_at_locus, count(*) AS coverage_at_locus, count(*) FILTER (base = v_alt) / count(*) AS alt_allele_frequency,
        avg(bq) FILTER (base = v_alt) AS mean_alt_allele_base_quality
        FROM (SELECT DISTINCT * FROM snv_found) AS c JOIN site_states AS s ON s.node_id = c.node_id AND s.p = c.v_pos GROUP BY ALL""",
    "candidates": """SELECT *, coverage_at_locus AS coverage FROM snv_all WHERE alt_allele_count >= 3 AND alt_allele_frequency >= 0.05 AND mean_alt_allele_base_quality >= 10""",
    "located": "SELECT c.*, chrom, start, strand, length FROM candidates AS c JOIN coords USING (node_id)",
    "truth": """SELECT DISTINCT chrom, CASE WHEN node_id % 2 = 1 THEN start + v_pos - 1 ELSE start + v_pos END AS pos, CASE WHEN node_id % 2 = 1 THEN 'A' || v_ref ELSE v_ref END AS ref, v_alt AS alt
        FROM located WHERE (node_id + v_pos) % 3 <> 0""",
    "calls": """SELECT chrom, start + v_pos AS pos, 'n' || node_id || '_' || v_pos AS id, v_ref AS ref, v_alt, CASE WHEN node_id % 4 = 0 THEN [v_alt, 'N'] ELSE [v_alt] END AS alts,
        CASE node_id % 3 WHEN 0 THEN ['PASS'] WHEN 1 THEN ['PASS', 'LowConf'] ELSE ['RefCall'] END AS filters, node_id, v_pos, coverage FROM located""",
    "panels": """SELECT 1 AS panel, chrom, start + v_pos AS pos, v_ref AS ref, v_alt AS alt FROM located WHERE (node_id + v_pos) % 3 = 0
        UNION ALL SELECT 2, chrom, start + v_pos, v_ref, 'G' FROM located WHERE (node_id + v_pos) % 5 = 0
        UNION ALL SELECT 3, chrom, start + v_pos, v_ref, v_alt FROM located WHERE (node_id + v_pos) % 7 = 0
        UNION ALL SELECT 4, chrom, start + v_pos, v_ref, v_alt FROM located WHERE (node_id + v_pos) % 11 = 0""",
    "predictions": """SELECT *, CASE WHEN p_true >= 0.5 THEN 'true' ELSE 'false' END AS pred_class FROM (SELECT *, CAST(node_id % 8 AS INT) AS shard_index,
        CAST(row_number() OVER (PARTITION BY node_id % 8 ORDER BY node_id, v_pos, v_ref, v_alt) - 1 AS INT) AS index_within_shard, ((node_id * 37 + v_pos * 11) % 101) / 100.0 AS p_true FROM candidates)""",
    "node_stats": """SELECT node_id, count(*) FILTER (kind = 0) AS perfect, count(*) FILTER (kind <> 0) AS not_perfect,
        max(length(fseq)) AS max_read_length, max(length(CASE WHEN kind = 1 THEN (m - 1) || 'M1X' ELSE fcigar END)) AS max_cigar_length
        FROM mappings JOIN reads USING (read_id) WHERE mapping_quality > 5 GROUP BY node_id""",
}


def _whole_sums(body: str) -> str:
    """``isum(x)`` as a 64-bit sum: DuckDB's own sum of integers is wider."""
    while (at := body.find("isum(")) >= 0:
        depth, end = 1, at + 5
        while depth:
            depth += {"(": 1, ")": -1}.get(body[end], 0)
            end += 1
        body = f"{body[:at]}CAST(sum({body[at + 5 : end - 1]}) AS BIGINT){body[end:]}"
    return body


def sql(body: str, **more: str) -> str:
    """``body`` after the CTEs that it needs, in order of need; ``more`` adds CTEs of its own."""
    known, used = CTES | more, {}

    def need(text: str) -> None:
        for name in known:
            if name not in used and re.search(rf"\b{name}\b", text):
                used[name] = None
                need(known[name])
                used[name] = used.pop(name)  # after what it needs

    body = _whole_sums(body)
    need(body)
    return (("WITH " + ",\n".join(f"{n} AS ({known[n]})" for n in used) + "\n") if used else "") + body
