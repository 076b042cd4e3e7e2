"""Dataset assembly: deterministic numbering, shards, splits, sampling, scoring and calls."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions.variants import info_string, keep_decision, linear_position
from strandloom.operators import tensor
from strandloom.operators.ranks import running_sum
from strandloom.session import materialize


def global_rank(df: DataFrame, *order: str, column: str = "rank") -> DataFrame:
    """Rows numbered from 0 in a total order without a one-partition window.

    Range partitioning sorts the rows; each partition's count gives the next ones' offset. Only one count a partition
    is gathered.
    """
    parts = materialize(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("__part", F.spark_partition_id()), "ranked")
    counts = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")  # a row a partition
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return parts.join(F.broadcast(before), "__part").withColumn(column, F.col("__before") + within).drop("__part", "__before")


def tensor_shards(df: DataFrame, size: int, *order: str) -> DataFrame:
    """shard_index and index_within_shard of rows in a total order; the last shard may be smaller."""
    ranked = global_rank(df, *order)
    return ranked.withColumn("shard_index", F.expr(f"int(rank div {size})")).withColumn("index_within_shard", F.expr(f"int(rank % {size})")).drop("rank")


def pure_class_shards(df: DataFrame, label: str, size: int, *order: str) -> DataFrame:
    """Shards that hold one class each; shard numbers go on from class to class."""
    per = df.groupBy(label).agg(F.ceil(F.count(F.lit(1)) / size).alias("shards"))
    first = per.withColumn("first", F.coalesce(F.sum("shards").over(Window.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("shards")  # a row a class
    rows = running_sum(df, label, *order, column="nth").join(F.broadcast(first), label)
    return rows.withColumn("shard_index", F.expr(f"int(first + nth div {size})")).withColumn("index_within_shard", F.expr(f"int(nth % {size})")).drop("nth", "first")


def hash_order(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def split_by_chrom(rows: DataFrame, routes: dict[str, str]) -> DataFrame:
    """Rows with their split by chromosome; chromosomes without a route are skipped, an empty split is an error."""
    table = rows.sparkSession.createDataFrame(list(routes.items()), "chrom string, split string")
    out = rows.join(F.broadcast(table), "chrom")  # a row a chromosome
    missing = set(routes.values()) - {r["split"] for r in out.select("split").distinct().collect()}
    if missing:
        raise ValueError(f"empty split: {', '.join(sorted(missing))}")
    return out


def genotype_of(name: Column) -> Column:
    """The genotype in a file's name: what stands behind its last underscore, without ``.npy``."""
    return F.regexp_replace(F.regexp_extract(name, r"([^_]*)$", 1), r"\.npy", "")


def split_stratified(rows: DataFrame, label: str, keys: list[str], train: float, val: float, seed: int = 0) -> DataFrame:
    """Per class in hash order the first floor(n * train) are train, the next floor(n * val) val, the rest test."""
    ranked = running_sum(rows.withColumn("hash", hash_order(seed, *keys)), label, "hash", *keys, column="earlier").withColumn("nth", F.col("earlier") + 1).drop("hash", "earlier")
    classes = rows.groupBy(F.col(label).alias("of_class")).agg(F.count(F.lit(1)).alias("n"))  # a row a class
    ranked = ranked.join(F.broadcast(classes), F.col(label).eqNullSafe(F.col("of_class"))).drop("of_class")
    a, b = F.floor(F.col("n") * train), F.floor(F.col("n") * val)
    return ranked.withColumn("split", F.when(F.col("nth") <= a, "train").when(F.col("nth") <= a + b, "val").otherwise("test")).drop("nth", "n")


def downsample_false(rows: DataFrame, fraction: float, keys: list[str], seed: int = 0, drop_unknown: bool = False) -> DataFrame:
    """Per shard, round(fraction * false rows) false rows removed by hash order."""
    by = Window.partitionBy("shard_index", "label")
    nth, n = F.row_number().over(by.orderBy(hash_order(seed, *keys), *keys)), F.count(F.lit(1)).over(by)
    ranked = rows.withColumn("nth", nth).withColumn("gone", F.bround(n * fraction))
    kept = ranked.where((F.col("label") != 0) | (F.col("nth") > F.col("gone"))).drop("nth", "gone")
    return known_labels(kept) if drop_unknown else kept


def known_labels(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("label").isin(0, 1))


def shuffle_shards(rows: DataFrame, size: int, keys: list[str], seed: int = 0) -> DataFrame:
    """Rows in a seeded order, in shards of ``size``."""
    return tensor_shards(rows.withColumn("__key", hash_order(seed, *keys)), size, "__key", *keys).drop("__key")


def shard_labels(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per shard its labels in index order, -1 where there is none. sizes: shard_index, n."""
    slots = sizes.where("n > 0").select("shard_index", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("index_within_shard"))
    filled = slots.join(rows.select("shard_index", "index_within_shard", "label"), ["shard_index", "index_within_shard"], "left")
    packed = filled.groupBy("shard_index").agg(F.array_sort(F.collect_list(F.struct("index_within_shard", F.coalesce("label", F.lit(-1)).alias("label")))).alias("x"))
    return packed.select("shard_index", F.transform("x", lambda v: v["label"]).alias("labels"))


def class_to_label(name: Column, classes: list[str] | None = None) -> Column:
    """true is 1 and false 0; else the place in the class list."""
    names = ["false", "true"] if classes is None else classes
    return F.nullif(F.array_position(F.array(*map(F.lit, names)), F.lower(name) if classes is None else name).cast("int") - 1, F.lit(-1))


#: tensors that a scorer is given at once, and where they are built: few, so that their values stay in a core's caches
SCORED, SCORED_WHERE_BUILT = 128, 16


def mean_scorer(weights: tuple[float, ...]) -> Callable[[np.ndarray], np.ndarray]:
    """Logits (false, true) from the weighted means of the channels."""

    def score(values: np.ndarray) -> np.ndarray:
        true = values.reshape(len(values), len(weights), -1).mean(2, dtype=np.float64) @ np.array(weights)
        return np.stack([-true, true], axis=1)

    return score


def linear_scorer(values: np.ndarray) -> np.ndarray:
    """Logits (false, true) by a fixed linear form; for tests."""
    weight = np.sin(np.arange(values.shape[1]))
    true = values @ weight / np.sqrt(values.shape[1])
    return np.stack([-true, true], axis=1)


def _scores(raw: np.ndarray, mean: list[float], std: list[float], scorer: Callable[[np.ndarray], np.ndarray], room: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(p_true, pred_class) of int8 tensors [n, size]; ``room`` takes their values, float32 [n or more, size]."""
    raw = raw.reshape(len(raw), len(mean), -1)
    values = np.subtract(raw, np.array(mean, np.float32)[:, None], out=None if room is None else room[: len(raw)].reshape(raw.shape))
    np.divide(values, np.array(std, np.float32)[:, None], out=values)
    logits = scorer(values.reshape(len(raw), -1)).astype(float)
    odds = np.exp(logits - logits.max(1, keepdims=True))
    p = (odds / odds.sum(1, keepdims=True))[:, 1]
    return p, np.where(p > 0.5, "true", "false")


def batch_score(rows: DataFrame, mean: list[float], std: list[float], scorer: Callable[[np.ndarray], np.ndarray] = linear_scorer, column: str = "data") -> DataFrame:
    """Softmax of the scorer's logits per tensor, normalised per channel: p_true, pred_class.

    ``data`` holds int8 tensors, channel after channel; the scorer is given at most ``SCORED`` of them at once.
    """
    keys = [f for f in rows.schema.fields if f.name != column]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (whole.iloc[at : at + SCORED] for whole in batches for at in range(0, len(whole), SCORED)):
            p, names = _scores(np.stack([np.frombuffer(d, np.int8) for d in batch[column]]), mean, std, scorer)
            yield batch.drop(columns=column).assign(p_true=p, pred_class=names)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys) + ", p_true double, pred_class string"
    return rows.mapInPandas(score, schema)


def score_where_built(candidates: DataFrame, segments: DataFrame, mean: list[float], std: list[float], scorer: Callable[[np.ndarray], np.ndarray] = linear_scorer, **shape: int) -> DataFrame:
    """``batch_score`` of the candidates' tensors, in the tasks that build them: scores leave a task, tensors don't."""

    kept: list[np.ndarray] = []  # a task's room for values, used again and again

    def score(made: pa.Table) -> pa.Table:
        raw, p, names = tensor.as_array(made), [], []
        if len(raw) and not kept:
            kept.append(np.empty((SCORED_WHERE_BUILT, raw.shape[1]), np.float32))
        for at in range(0, len(raw), SCORED_WHERE_BUILT):
            part = _scores(raw[at : at + SCORED_WHERE_BUILT], mean, std, scorer, kept[0])
            p, names = [*p, *part[0]], [*names, *part[1]]
        return made.drop_columns(["n_rows", "data"]).append_column("p_true", pa.array(p, pa.float64())).append_column("pred_class", pa.array(names, pa.string()))

    return tensor.tensors(candidates, segments, **shape, then=score, columns="node_id long, v_pos int, v_type string, v_ref string, v_alt string, p_true double, pred_class string")


def score_to_meta(predictions: DataFrame, summary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, misses): predictions with their summary row by shard and index; the last of a repeated key counts."""
    keys = ["shard_index", "index_within_shard"]
    last = summary.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in summary.columns if c not in (*keys, "row_no")]), "row_no").alias("meta"))
    return predictions.join(last, keys).select(*predictions.columns, "meta.*"), predictions.join(last, keys, "left_anti")


def dedupe_calls(calls: DataFrame, order: str) -> DataFrame:
    """The first call of each shard and index."""
    nth = F.row_number().over(Window.partitionBy("shard_index", "index_within_shard").orderBy(order))
    return calls.withColumn("nth", nth).where("nth = 1").drop("nth")


def calls_to_vcf(calls: DataFrame, anchors: DataFrame, emit: str = "all", **rule: float) -> DataFrame:
    """Scored candidates (node_id, v_pos, v_ref, v_alt, p_true, pred_class) as records; emit linear, graph or all of them."""
    found = calls.join(anchors, "node_id", "left")
    anchored = F.col("chrom").isNotNull()
    found = found.withColumn("filter", keep_decision(F.col("p_true"), F.lower("pred_class") == "true", anchored, **rule)).where("filter IS NOT NULL")
    pos = F.when(anchored, linear_position(F.col("start") - 1, F.col("v_pos"), F.col("length"), F.col("strand"))).otherwise(F.col("v_pos") + 1)
    info = info_string({"NID": F.col("node_id"), "NSO": F.col("v_pos"), "P": F.round("p_true", 4)})
    rows = found.select(F.coalesce("chrom", F.col("node_id").cast("string")).alias("chrom"), pos.cast("long").alias("pos"), F.col("v_ref").alias("ref"), F.col("v_alt").alias("alt"), "filter", info.alias("info"), anchored.alias("is_linear"))
    return {"all": rows, "linear": rows.where("is_linear"), "graph": rows.where("NOT is_linear")}[emit]
