"""Text sources and sinks of graphs: GFA lines, node-id lists, coordinate tables, neighbour and node tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.sources.json_objects import json_rows


def walk_steps(walk: Column) -> Column:
    """``>1<2`` or ``1+,2-`` as array<struct<node_id, strand>> in order."""
    marked = F.transform(F.regexp_extract_all(walk, F.lit(r"([><][^><]+)"), F.lit(1)), lambda x: F.struct(F.substring(x, 2, 1 << 30).try_cast("long").alias("node_id"), F.when(x.startswith(">"), "+").otherwise("-").alias("strand")))
    listed = F.transform(F.split(walk, ","), lambda x: F.struct(F.regexp_replace(x, "[+-]$", "").try_cast("long").alias("node_id"), F.when(x.endswith("-"), "-").otherwise("+").alias("strand")))
    return F.when(walk.rlike("^[><]"), marked).otherwise(listed)


def read_gfa(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(segments, paths, edges) of S, W and P, and L lines; ``.gz`` files are read as they are.

    segments: node_id, sequence, ln_tag, length; paths: kind, name, first (1-based), walk; edges: from_id, from_orient, to_id, to_orient.
    """
    parts = spark.read.text(path).select(F.split("value", "\t").alias("f"))
    kind, field = F.get("f", 0), lambda k: F.get("f", k)
    tag = F.regexp_extract(F.array_join("f", "\t"), r"\tLN:i:(\d+)", 1).try_cast("int")
    segments = parts.where(kind == "S").select(field(1).try_cast("long").alias("node_id"), field(2).alias("sequence"), tag.alias("ln_tag"))
    segments = segments.withColumn("length", segment_length(F.col("sequence"), F.col("ln_tag")))
    paths = parts.where(kind.isin("W", "P")).select(
        kind.alias("kind"), F.when(kind == "W", field(3)).otherwise(field(1)).alias("name"), F.when(kind == "W", field(4).try_cast("long") + 1).otherwise(1).alias("first"), F.when(kind == "W", field(6)).otherwise(field(2)).alias("walk")
    )
    edges = parts.where(kind == "L").select(field(1).try_cast("long").alias("from_id"), field(2).alias("from_orient"), field(3).try_cast("long").alias("to_id"), field(4).alias("to_orient"))
    return segments, paths, edges


def segment_length(sequence: Column, ln_tag: Column) -> Column:
    return F.coalesce(ln_tag, F.when(sequence != "*", F.length(sequence)), F.lit(0))


def path_steps(paths: DataFrame, prefer_walks: bool = True) -> DataFrame:
    """chrom, step, node_id, strand, first: of a chromosome with W and P lines the W lines count."""
    if prefer_walks:
        best = paths.groupBy("name").agg(F.max("kind").alias("kind"))
        paths = paths.join(best, ["name", "kind"], "left_semi")
    return paths.select(F.col("name").alias("chrom"), "first", F.posexplode(walk_steps(F.col("walk"))).alias("step", "s")).select("chrom", "first", "step", "s.*")


def write_gfa(nodes: DataFrame, steps: DataFrame, edges: DataFrame, path: str) -> None:
    """S, W and L lines; W lines come from each chromosome's steps in order."""
    lines = nodes.select(F.concat_ws("\t", F.lit("S"), F.col("node_id").cast("string"), "sequence", F.concat(F.lit("LN:i:"), F.length("sequence"))).alias("value"))
    step = F.concat(F.when(F.col("strand") == "-", "<").otherwise(">"), F.col("node_id").cast("string"))
    walks = steps.groupBy("chrom").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", step.alias("s")))), lambda x: x["s"]), "").alias("walk"))
    lines = lines.union(walks.select(F.concat_ws("\t", F.lit("W"), F.lit("GRCh38"), F.lit("0"), "chrom", F.lit("0"), F.lit("*"), "walk")))
    lines = lines.union(edges.select(F.concat_ws("\t", F.lit("L"), F.col("from_id").cast("string"), "from_orient", F.col("to_id").cast("string"), "to_orient", F.lit("0M"))))
    lines.write.text(path)


def read_node_ids(spark: SparkSession, *paths: str) -> DataFrame:
    """Distinct node ids of integer-per-line files; blank lines are skipped, any other line is an error."""
    lines = spark.read.text(list(paths)).select(F.trim("value").alias("v")).where("v <> ''")
    return lines.select(F.coalesce(F.col("v").try_cast("long"), F.raise_error(F.concat(F.lit("not a node id: "), F.col("v"))).cast("long")).alias("node_id")).distinct()


def write_node_ids(ids: DataFrame, path: str) -> None:
    ids.select("node_id").distinct().orderBy("node_id").select(F.col("node_id").cast("string").alias("value")).write.text(path)


def read_node_json(spark: SparkSession, path: str) -> DataFrame:
    """Node records of JSON files in any layout (see ``json_objects``); broken ones cost themselves only."""
    record = "node_id string, grch38_position_start long, position_start long, strand_in_path string, strand string, length int, chrom string, sequence string, genomead_af array<double>"
    return canonical_nodes(json_rows(spark, record, path, "node_id"))


def canonical_nodes(rows: DataFrame) -> DataFrame:
    """First present of the aliased fields; a strand that is neither sign is ``+``; ids are longs."""
    strand = F.coalesce("strand_in_path", "strand")
    return rows.select(
        F.col("node_id").try_cast("long").alias("node_id"), F.coalesce("grch38_position_start", "position_start").alias("start"), F.when(strand == "-", "-").otherwise("+").alias("strand"),
        F.coalesce("length", F.length("sequence")).alias("length"), "chrom", "sequence", "genomead_af",
    ).where("node_id IS NOT NULL")


def read_neighbor_tsv(spark: SparkSession, path: str) -> DataFrame:
    """node_id, left_node, right_node; ``.`` and empty are null; the header may be in any case."""
    rows = spark.read.csv(path, sep="\t", header=True)
    rows = rows.toDF(*(c.strip().lower() for c in rows.columns))
    value = lambda c: F.nullif(F.trim(c), F.lit(".")).try_cast("long").alias(c)
    return rows.select(*(value(c) for c in ("node_id", "left_node", "right_node")))


def read_alt_ref_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(alt_node, ref_node): ALT cells hold many ids with any separators; the last row of an ALT id counts."""
    rows = spark.read.csv(path, sep="\t", header=True)
    names = {c.strip().upper(): c for c in rows.columns}
    ref, alt = names.get("REF_NODE", rows.columns[0]), names.get("ALT_NODE(S)", names.get("ALT_NODES", rows.columns[-1]))
    # files are not read in the order of their names: the place of a row is its file, the part of it that a task reads, and its number there
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row_no"))
    rows = rows.select(F.col(f"`{ref}`").try_cast("long").alias("ref_node"), F.col(f"`{alt}`").alias("alts"), place.alias("place"))
    rows = rows.select("ref_node", "place", F.explode(F.regexp_extract_all("alts", F.lit(r"(\d+)"), F.lit(1))).alias("alt"))
    return rows.groupBy(F.col("alt").cast("long").alias("alt_node")).agg(F.max_by("ref_node", "place").alias("ref_node"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="chrom string, start long, end long", comment="#").where("start IS NOT NULL AND end IS NOT NULL")


def read_coord_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).csv(path, sep="\t", schema="node_id long, start long, strand string, length int, chrom string")


def write_coord_table(coords: DataFrame, path: str) -> None:
    coords.select("node_id", "start", "strand", "length", "chrom").write.partitionBy("chrom").csv(path, sep="\t")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(contig, chunk_no, bases): one row per sequence line of FASTA files, numbered from 0 in its contig.

    Files split: lines are numbered within their split, and what a split's first lines belong to is carried over from the
    splits before it, a row each.
    """
    meta = F.col("_metadata")
    lines = spark.read.text(path).select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("n")).where("trim(value) <> ''")
    head = F.when(F.col("value").startswith(">"), F.regexp_extract("value", r"^>\s*(\S*)", 1))
    within = Window.partitionBy("file", "block").orderBy("n")
    rows = lines.withColumn("head", head).withColumn("contig", F.last("head", True).over(within)).withColumn("section", F.count("head").over(within))
    numbered = rows.withColumn("nth", F.count_if(F.col("head").isNull()).over(Window.partitionBy("file", "block", "section").orderBy("n")) - 1)
    # by split: its last header, and the lines behind it
    splits = numbered.groupBy("file", "block").agg(F.max_by("contig", "n").alias("contig"), F.max_by("nth", "n").alias("last"))
    along = Window.partitionBy("file").orderBy("block")
    splits = splits.withColumn("run", F.count("contig").over(along))
    so_far = F.sum(F.col("last") + 1).over(Window.partitionBy("file", "run").orderBy("block"))
    splits = splits.withColumn("seen", so_far).withColumn("of", F.last("contig", True).over(along))
    carried = splits.select("file", "block", F.lag("of").over(along).alias("carried"), F.coalesce(F.lag("seen").over(along), F.lit(0)).alias("seen"))
    found = numbered.where("head IS NULL").join(carried, ["file", "block"])
    first = F.col("section") == 0
    return found.select(F.when(first, F.col("carried")).otherwise(F.col("contig")).alias("contig"), (F.col("nth") + F.when(first, F.col("seen")).otherwise(0)).alias("chunk_no"), F.trim("value").alias("bases"))


def write_fasta(chunks: DataFrame, path: str) -> None:
    """FASTA files of (contig, chunk_no, bases), each with whole contigs."""
    heads = chunks.select("contig").distinct().select("contig", F.lit(-1).cast("long").alias("chunk_no"), F.concat(F.lit(">"), "contig").alias("bases"))
    lines = chunks.select("contig", F.col("chunk_no").cast("long").alias("chunk_no"), "bases").unionByName(heads)
    lines.repartition("contig").sortWithinPartitions("contig", "chunk_no").select(F.col("bases").alias("value")).write.text(path)


def fasta_base(positions: DataFrame, fasta: DataFrame, chunk: int = 60) -> DataFrame:
    """The base at each (contig, pos), pos 1-based, by an equi-join on the number of the line of ``chunk`` bases."""
    keyed = positions.withColumn("chunk_no", F.expr(f"(pos - 1) div {chunk}"))
    return keyed.join(fasta, ["contig", "chunk_no"], "left").withColumn("base", F.expr(f"substring(bases, int((pos - 1) % {chunk}) + 1, 1)")).drop("bases", "chunk_no")


def node_stats_io(stats: DataFrame, path: str) -> DataFrame:
    """Statistics written as JSON lines and read back with their types."""
    stats.write.json(path)
    return stats.sparkSession.read.schema(stats.schema).json(path)


def segment_store(segments: DataFrame, table: str, path: str, buckets: int = 64) -> DataFrame:
    """Segments saved at ``path`` as a table bucketed and sorted by node: lookups prune, joins on node need no shuffle."""
    writer = segments.write.mode("overwrite").bucketBy(buckets, "node_id").sortBy("node_id").format("parquet")
    writer.option("path", path).saveAsTable(table)
    return segments.sparkSession.table(table)
