"""Graph nodes: coordinates along paths, annotation, node sets and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.operators.ranks import exact_median, running_sum


def path_lengths(steps: DataFrame, segments: DataFrame) -> DataFrame:
    """Steps with their node's length; a step on an unknown node is an error."""
    joined = steps.join(segments.select("node_id", "length"), "node_id", "left")
    return joined.withColumn("length", F.coalesce("length", F.raise_error(F.concat(F.lit("no segment for node "), F.col("node_id").cast("string"))).cast("int")))


def path_positions(steps: DataFrame, first: int = 1) -> DataFrame:
    """1-based start of each step: the path's first position and the lengths before it."""
    return running_sum(steps, "chrom", "step", value="length").withColumn("start", F.lit(first).cast("long") + F.col("before")).drop("before")


def candidate_nodes(nodes: DataFrame, stored: DataFrame, *wanted: DataFrame) -> DataFrame:
    """Nodes that are in the store and, if node-id sets are given, in one of them."""
    kept = nodes.join(stored.select("node_id").distinct(), "node_id", "left_semi")
    if wanted:
        kept = kept.join(union_node_lists(*wanted), "node_id", "left_semi")
    return kept


def enrich_nodes(ids: DataFrame, records: DataFrame, segments: DataFrame, chrom: str, drop: tuple[str, ...] = ("genomead_af",)) -> DataFrame:
    """Ids with their record; an empty sequence is filled from the graph, chrom only where it is absent."""
    records = records.drop(*drop).withColumnRenamed("sequence", "own_sequence").withColumnRenamed("chrom", "own_chrom")
    joined = ids.select("node_id").distinct().join(records, "node_id", "left").join(segments.select("node_id", F.col("sequence").alias("graph_sequence")), "node_id", "left")
    sequence = F.coalesce(F.nullif(F.col("own_sequence"), F.lit("")), F.col("graph_sequence"), F.lit(""))
    return joined.withColumn("sequence", sequence).withColumn("chrom", F.coalesce("own_chrom", F.lit(chrom))).drop("own_sequence", "own_chrom", "graph_sequence")


def attach_coordinates(nodes: DataFrame, coords: DataFrame) -> DataFrame:
    """Anchors of nodes that are on the paths exactly once; nodes seen more often get none."""
    once = coords.groupBy("node_id").agg(F.count(F.lit(1)).alias("seen"), F.min(F.struct("chrom", "start", "strand")).alias("anchor")).where("seen = 1")
    return nodes.join(once.select("node_id", "anchor.*"), "node_id", "left")


def af_by_position(nodes: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Per node the list of frequencies at its bases' positions; the last record of a position counts."""
    latest = frequencies.groupBy("chrom", "pos").agg(F.max_by("af", "row_no").alias("af"))
    bases = nodes.select("node_id", "chrom", "start", F.explode(F.sequence(F.lit(0), F.col("length") - 1)).alias("i"))
    found = bases.withColumn("pos", F.col("start") + F.col("i")).join(latest, ["chrom", "pos"], "left")
    return found.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("i", "af"))).alias("levels")).select("node_id", F.transform("levels", lambda x: x["af"]).alias("af"))


def af_level(af: Column) -> Column:
    """1 to 8 by decade, left-closed; null is 0; from 1.0 on the value itself as an integer."""
    edges = (1e-6, 1e-5, 1e-4, 1e-3, 1e-2, 1e-1, 0.5)
    level = F.when(af.isNull(), 0).when(af >= 1.0, af.cast("int"))
    for k, edge in enumerate(edges, 1):
        level = level.when(af < edge, k)
    return level.otherwise(8)


def af_digit(af: Column) -> Column:
    """Digits 0 to 7 by the same edges, for a list written as one string."""
    edges = (1e-6, 1e-5, 1e-4, 1e-3, 1e-2, 1e-1, 0.5)
    digit = F.when(af.isNull(), "0")
    for k, edge in enumerate(edges):
        digit = digit.when(af < edge, str(k))
    return digit.otherwise("7")


def union_node_lists(*lists: DataFrame) -> DataFrame:
    out = lists[0].select("node_id")
    for more in lists[1:]:
        out = out.union(more.select("node_id"))
    return out.distinct()


def compare_node_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """shared, only_left and only_right over two node sets, in one pass."""
    both = left.select("node_id").distinct().withColumn("l", F.lit(1)).join(right.select("node_id").distinct().withColumn("r", F.lit(1)), "node_id", "full")
    return both.agg(F.count_if(F.expr("l = 1 AND r = 1")).alias("shared"), F.count_if(F.expr("r IS NULL")).alias("only_left"), F.count_if(F.expr("l IS NULL")).alias("only_right"))


def component_summary(component: DataFrame, path: DataFrame) -> DataFrame:
    """Per chromosome: totals, shared, differences and three percentages to six decimals."""
    both = component.select("chrom", "node_id").distinct().withColumn("l", F.lit(1)).join(path.select("chrom", "node_id").distinct().withColumn("r", F.lit(1)), ["chrom", "node_id"], "full")
    rows = both.groupBy("chrom").agg(
        F.count("l").alias("component"), F.count("r").alias("path"), F.count_if(F.expr("l = 1 AND r = 1")).alias("shared"), F.count_if(F.expr("r IS NULL")).alias("only_component"), F.count_if(F.expr("l IS NULL")).alias("only_path")
    )
    share = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a) * 100.0, F.col(b)), F.lit(0.0)), 6)
    return rows.withColumn("shared_of_component", share("shared", "component")).withColumn("shared_of_path", share("shared", "path")).withColumn("only_of_component", share("only_component", "component"))


def first_seen_union(*lists: DataFrame) -> DataFrame:
    """Ids of several lists (node_id, row_no) in first-seen order."""
    out = None
    for file_no, rows in enumerate(lists):
        rows = rows.select("node_id", F.struct(F.lit(file_no).alias("file_no"), F.col("row_no").cast("long").alias("row_no")).alias("at"))
        out = rows if out is None else out.union(rows)
    return out.groupBy("node_id").agg(F.min("at").alias("at")).select("node_id", "at.file_no", "at.row_no")


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key, in ``order``."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("last")).select(*keys, "last.*")


def top_nodes(stats: DataFrame, k: int, by: str = "not_perfect", min_total: int = 1) -> DataFrame:
    """The first ``k`` nodes by a count or ratio, with their rank; ties by node id."""
    return ranked(with_ratios(stats).where(F.col("total") >= min_total), k, F.desc(by), F.asc("node_id"))


def ranked(df: DataFrame, k: int, *order: Column) -> DataFrame:
    top = df.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # over k rows


def with_ratios(stats: DataFrame) -> DataFrame:
    total = F.col("perfect") + F.col("not_perfect")
    ratio = lambda c: F.coalesce(F.try_divide(F.col(c), total), F.lit(0.0))
    return stats.withColumn("total", total).withColumn("perfect_ratio", ratio("perfect")).withColumn("imperfect_ratio", ratio("not_perfect"))


def length_stats(nodes: DataFrame) -> DataFrame:
    c = F.col("length")
    return nodes.agg(F.count(c).alias("n"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.lit(exact_median(nodes, "length")).cast("double").alias("median"), F.stddev_samp(c).alias("sd"))


def length_bins(nodes: DataFrame, bins: int = 10) -> DataFrame:
    """Equal bins from the shortest length on, empty ones included: bin, low, high, count, percent."""
    ends = nodes.agg(F.min("length").alias("lo"), F.max("length").alias("hi"), F.count("length").alias("total")).withColumn("width", F.ceil((F.col("hi") - F.col("lo") + 1) / bins))
    counts = nodes.select("length").join(F.broadcast(ends)).groupBy(F.floor((F.col("length") - F.col("lo")) / F.col("width")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # one row of ends
    grid = ends.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    low = F.col("lo") + F.col("bin") * F.col("width")
    n = F.coalesce("n", F.lit(0))
    return grid.join(counts, "bin", "left").select("bin", low.alias("low"), (low + F.col("width") - 1).alias("high"), n.alias("count"), (n * 100.0 / F.col("total")).alias("percent"))


def top_lengths(nodes: DataFrame, k: int) -> DataFrame:
    total = nodes.agg(F.count(F.lit(1)).alias("total"))
    counts = nodes.groupBy("length").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "length").limit(k)
    return counts.join(F.broadcast(total)).select("length", "n", (F.col("n") * 100.0 / F.col("total")).alias("percent"))  # one row of totals


def stats_lengths(stats: DataFrame, segments: DataFrame) -> DataFrame:
    """Statistics with segment lengths: the LN tag if there is one, else the sequence's length, else 0."""
    found = segments.select("node_id", F.coalesce("ln_tag", F.when(F.col("sequence") != "*", F.length("sequence"))).alias("segment_length"), F.lit(True).alias("found"))
    joined = stats.join(found, "node_id", "left")
    return joined.withColumn("segment_length", F.coalesce("segment_length", F.lit(0))).withColumn("missing", F.col("found").isNull()).drop("found")


def neighbor_context(nodes: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Last base of the left and first base of the right neighbour of each node."""
    ends = nodes.select("node_id", F.upper(F.right("sequence", F.lit(1))).alias("last"), F.upper(F.left("sequence", F.lit(1))).alias("first"))
    left = ends.select(F.col("node_id").alias("left_node"), F.col("last").alias("left_base"))
    right = ends.select(F.col("node_id").alias("right_node"), F.col("first").alias("right_base"))
    return neighbours.join(left, "left_node", "left").join(right, "right_node", "left").select("node_id", "left_base", "right_base")


def idx_vs_tsv_nodes(stored: DataFrame, rows: DataFrame, json_column: str = "graph_nodes") -> DataFrame:
    """Overlap of stored ids with ids held as JSON lists; rows whose JSON is bad are counted."""
    parsed = rows.select(F.from_json(json_column, "array<long>").alias("ids"))
    bad = parsed.agg(F.count_if(F.col("ids").isNull()).alias("bad_rows"))
    ids = parsed.select(F.explode("ids").alias("node_id")).distinct()
    return compare_node_sets(stored, ids).join(F.broadcast(bad))  # one row each


def chrom_components(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """(chrom, node_id): every node in a connected component that a chromosome's path touches."""
    from strandloom.operators.graph import connected

    labels = connected(edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")))
    touched = steps.select("chrom", "node_id").join(labels, "node_id").select("chrom", "component").distinct()
    alone = steps.select("chrom", "node_id").join(labels, "node_id", "left_anti")
    return labels.join(touched, "component").select("chrom", "node_id").unionByName(alone).distinct()
