"""VCF and site files: readers, writer, merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.variants import info_map
from strandloom.session import scratch_path

COLUMNS = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"


def read_vcf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """chrom, pos, id, ref, alts, qual, filters, info; headers and lines of fewer than 8 columns are dropped."""
    f = spark.read.text(path).where("NOT startswith(value, '#')").select(F.split("value", "\t").alias("f")).where("size(f) >= 8")
    at = lambda k: F.get("f", k)
    filters = F.when(at(6).isin(".", ""), F.array().cast("array<string>")).otherwise(F.split(at(6), ";"))
    return f.select(at(0).alias("chrom"), at(1).try_cast("long").alias("pos"), at(2).alias("id"), at(3).alias("ref"), F.split(at(4), ",").alias("alts"), at(5).alias("qual"), filters.alias("filters"), info_map(at(7)).alias("info"))


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, ref, alt of tolerant site files: any white space, 4 columns or more, several ALTs; bad lines are skipped."""
    f = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f")).where("size(f) >= 4 AND NOT startswith(f[0], '#')")
    with_id = F.size("f") >= 5
    ref, alts = F.when(with_id, F.get("f", 3)).otherwise(F.get("f", 2)), F.when(with_id, F.get("f", 4)).otherwise(F.get("f", 3))
    rows = f.select(F.get("f", 0).alias("chrom"), F.get("f", 1).try_cast("long").alias("pos"), ref.alias("ref"), F.explode(F.split(alts, ",")).alias("alt"))
    return rows.where("pos IS NOT NULL AND alt <> '.'")


def contig_rank(chrom: Column) -> list:
    """Sort columns: numbered contigs, X, Y, M, then others by name."""
    bare = F.regexp_replace(chrom, "(?i)^chr", "")
    rank = F.coalesce(bare.try_cast("int"), F.when(F.upper(bare) == "X", 23).when(F.upper(bare) == "Y", 24).when(F.upper(bare).isin("M", "MT"), 25), F.lit(1_000_000))
    return [rank, F.when(rank == 1_000_000, chrom).otherwise(F.lit(""))]


def linear_order() -> list[Column]:
    return [*contig_rank(F.col("chrom")), F.col("pos"), F.col("ref"), F.array_join("alts", ",")]


def node_order() -> list[Column]:
    """For rows whose contig is a node number; others come last, by name."""
    node = F.col("chrom").try_cast("long")
    return [node.isNull(), node, F.col("chrom"), F.col("pos"), F.col("ref"), F.array_join("alts", ",")]


def header_order() -> list[Column]:
    """By the contig's place in a header (contig_no; none: last), start, stop, REF and ALT."""
    return [F.col("contig_no").isNull(), F.col("contig_no"), F.col("pos"), F.col("pos") + F.length("ref") - 1, F.col("ref"), F.array_join("alts", ",")]


def sort_vcf_linear(rows: DataFrame) -> DataFrame:
    return rows.orderBy(*linear_order())


def sort_vcf_node(rows: DataFrame) -> DataFrame:
    return rows.orderBy(*node_order())


def sort_header_order(rows: DataFrame, contigs: DataFrame) -> DataFrame:
    """Rows in the order of a header's contigs (chrom, contig_no)."""
    return rows.join(contigs, "chrom", "left").orderBy(*header_order())


def body_line() -> Column:
    """The 8 columns of a row as text; INFO keys in order of name."""
    keys = F.array_sort(F.map_keys("info"))
    info = F.array_join(F.transform(keys, lambda k: F.concat(k, F.lit("="), F.element_at("info", k))), ";")
    dot = lambda c: F.when(F.coalesce(c, F.lit("")) == "", ".").otherwise(c)
    return F.concat_ws("\t", "chrom", F.col("pos").cast("string"), dot(F.col("id")), "ref", F.array_join("alts", ","), dot(F.col("qual")), dot(F.array_join("filters", ";")), dot(info))


def write_vcf(rows: DataFrame, path: str, meta: tuple[str, ...] = ("##fileformat=VCFv4.2",), sort: str = "linear") -> None:
    """Header lines, then the sorted body, both in parts whose names keep the order.

    Contigs are listed in first-seen order of the sorted body, that is in sort order.
    """
    spark = rows.sparkSession
    ordered = (sort_vcf_linear if sort == "linear" else sort_vcf_node)(rows)
    ordered.select(body_line().alias("value")).write.text(f"{path}/body")
    node = F.col("chrom").try_cast("long")
    keys = contig_rank(F.col("chrom")) if sort == "linear" else [F.coalesce(node, F.lit(1 << 62)), F.when(node.isNull(), F.col("chrom")).otherwise("")]
    contigs = rows.select("chrom").distinct().select(F.lit(1).alias("part"), keys[0].cast("long").alias("n"), keys[1].alias("name"), F.concat(F.lit("##contig=<ID="), "chrom", F.lit(">")).alias("value"))
    fixed = spark.createDataFrame([(0, k, "", x) for k, x in enumerate(meta)] + [(2, 0, "", COLUMNS)], "part int, n long, name string, value string")
    _write_header(contigs.unionByName(fixed), f"{path}/header")


def _write_header(lines: DataFrame, path: str) -> None:
    """Header lines (part, n, name, value) in parts whose names keep the order, like the body's."""
    lines.orderBy("part", "n", "name").select("value").write.text(path)


def read_written(spark: SparkSession, path: str) -> DataFrame:
    return read_vcf(spark, [f"{path}/header", f"{path}/body"])


def merge_vcf(spark: SparkSession, paths: list[str], out: str) -> DataFrame:
    """Union of files' records under their distinct header lines, written once; returns the records."""
    heads = spark.read.text([f"{p}/header" for p in paths]).where("startswith(value, '##')").distinct()
    part = F.when(F.col("value").startswith("##fileformat"), 0).when(F.col("value").startswith("##contig"), 2).otherwise(1)
    contig = contig_rank(F.regexp_extract("value", "ID=([^,>]+)", 1))
    n, name = (F.when(part == 2, c).otherwise(other) for c, other in zip(contig, (F.lit(0), F.col("value")), strict=True))
    last = spark.createDataFrame([(3, 0, "", COLUMNS)], "part int, n int, name string, value string")
    _write_header(heads.select(part.alias("part"), n.alias("n"), name.alias("name"), "value").unionByName(last), f"{out}/header")
    sort_vcf_linear(read_vcf(spark, [f"{p}/body" for p in paths])).select(body_line().alias("value")).write.text(f"{out}/body")
    return read_written(spark, out)


def extract_vcf(rows: DataFrame, chrom: str | None = None) -> DataFrame:
    """JSON rows of a VCF, of one chromosome if given; ``chr`` is put before a bare name."""
    if chrom is not None:
        rows = rows.where(F.col("chrom") == (chrom if chrom.startswith("chr") else f"chr{chrom}"))
    return rows.select(F.to_json(F.struct("chrom", "pos", "ref", "alts", "id", "qual")).alias("value"))


def round_trip(rows: DataFrame, sort: str = "linear") -> DataFrame:
    path = scratch_path(rows.sparkSession, "vcf")
    write_vcf(rows, path, sort=sort)
    return read_written(rows.sparkSession, path)
