"""Exact dedup by an extendible-hash index on shared files, in DataFrame operations only.

A text's key is its 64-bit hash; the directory maps the key's leading bits, its slot, to buckets. It starts as one
bucket; a bucket of more distinct keys than ``capacity`` is split by its next bit, and the directory doubles when a
bucket's bits outgrow it. Rows meet the directory first and are dealt by ranges of buckets: an owner task takes the rows of its key
range, chains texts of equal keys as entries of their own by comparing their bytes, and writes them. Directory and
entries are written to shared files; lookups and later batches find their entries through the directory only.

A bucket may hold many more rows than keys, as where a third of all rows are copies of one text. The directory tells each bucket's
rows, and a bucket of too many is dealt in slices by row; every slice is folded by its owner, and only the folded entries of such
buckets go once more to one owner. No group is collected.

The directory goes to all tasks. The capacity grows with the table so that there are at most about ``BUCKETS`` full
buckets, and slots have at most ``MAX_DEPTH`` bits; should hashes ever be so uneven that a bucket is overfull at that
depth, it stays so.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.session import materialize

MAX_DEPTH = 20
CAPACITY = 128
BUCKETS = 1 << 15
SLICE_ROWS = 4  # times the capacity: rows of a bucket that one owner takes


def _text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def _digest(body: str) -> Column:
    return F.sha2(F.col(body).cast("binary"), 256)


def _slot(depth: int) -> Column:
    return F.shiftrightunsigned("key", 64 - depth).cast("int") if depth else F.lit(0)


def directory_of(counts: dict[int, int], depth: int, capacity: int) -> list[tuple[int, int, int]]:
    """Split overfull buckets: (slot, bucket, local depth) for every slot of the directory.

    ``counts`` has the distinct keys of each slot of ``depth`` bits. Buckets are numbered in the order of their keys. The
    directory is as deep as its deepest bucket: 2 to the largest local depth is its number of slots.
    """
    slots = 1 << depth
    running = [0]
    for slot in range(slots):
        running.append(running[-1] + counts.get(slot, 0))
    buckets, todo = [], [(0, 0)]
    while todo:
        first, bits = todo.pop()
        width = slots >> bits
        if running[first + width] - running[first] > capacity and bits < depth:
            todo += [(first + width // 2, bits + 1), (first, bits + 1)]
        else:
            buckets.append((first, bits))
    deepest = max(bits for _, bits in buckets)
    return [(slot, number, bits) for number, (first, bits) in enumerate(buckets) for slot in range(first >> depth - deepest, (first >> depth - deepest) + (1 << deepest - bits))]


@dataclasses.dataclass
class ExactIndex:
    """``directory`` (slot, bucket, depth, slices) of slots of ``bits`` bits, and ``entries`` (bucket, key, digest, keep_id, group_size)."""

    directory: DataFrame
    bits: int
    entries: DataFrame
    capacity: int


def build_directory(keys: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int, int]:
    """The written directory, a slot's bits and the capacity, from the distinct keys of a table (key, n_rows)."""
    n = keys.count()
    capacity = max(capacity, n // BUCKETS)
    # so deep that a slot holds a small part of a bucket: at most 2 ** MAX_DEPTH counts reach the driver
    depth = min(MAX_DEPTH, (n // capacity).bit_length() + 3)
    told = keys.groupBy(_slot(depth).alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_rows").alias("n_rows")).collect()
    slots = directory_of({r["slot"]: r["n"] for r in told}, depth, capacity)
    bits = (len(slots) - 1).bit_length()
    rows_of: dict[int, int] = {}
    for r in told:
        bucket = slots[r["slot"] >> depth - bits][1]
        rows_of[bucket] = rows_of.get(bucket, 0) + r["n_rows"]
    slots = [(slot, bucket, local, -(-rows_of.get(bucket, 1) // (SLICE_ROWS * capacity))) for slot, bucket, local in slots]
    return materialize(keys.sparkSession.createDataFrame(slots, "slot int, bucket int, depth int, slices int"), "exact-directory"), bits, capacity


def _routed(rows: DataFrame, directory: DataFrame, bits: int) -> DataFrame:
    """``rows`` (key, ...) with the bucket that the directory gives their slot, and the bucket's slices."""
    return rows.withColumn("slot", _slot(bits)).join(F.broadcast(directory.select("slot", "bucket", "slices")), "slot").drop("slot")


def _chains(rows: DataFrame) -> DataFrame:
    """(bucket, key, body, keep_id, group_size) of routed rows (bucket, slices, key, body, id), folded by the owners of buckets."""
    owned = rows.withColumn("slice", F.pmod(F.xxhash64("id"), "slices")).repartitionByRange("bucket", "slice")
    folded = owned.groupBy("bucket", "slice", "slices", "key", "body").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    folded = materialize(folded.withColumn("digest", _digest("body")).withColumn("body", F.when(F.col("slices") > 1, F.col("body"))), "exact-slices")
    whole = folded.where("slices = 1").select("bucket", "key", "digest", "keep_id", "group_size")
    again = folded.where("slices > 1").repartitionByRange("bucket").groupBy("bucket", "key", "body").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    return whole.unionByName(again.select("bucket", "key", _digest("body").alias("digest"), "keep_id", "group_size"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), _text(text_col).alias("body")).withColumn("key", F.xxhash64("body"))


def _written(entries: DataFrame, label: str = "exact-index") -> DataFrame:
    return materialize(entries.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key", "digest"), label)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> ExactIndex:
    """The index of ``docs``: an entry per distinct text. Null text counts as empty; ``keep_id`` is the largest id of the
    copies (null only if all are null)."""
    rows = _rows(docs, id_col, text_col)
    keys = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows")), "exact-keys")
    directory, bits, capacity = build_directory(keys, capacity)
    return ExactIndex(directory, bits, _written(_chains(_routed(rows, directory, bits))), capacity)


def insert(index: ExactIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> ExactIndex:
    """The index with ``docs`` added: they are routed by its directory and folded into its entries by key and digest.

    Buckets that have become overfull are split, which may double the directory; only entries move then, no texts.
    """
    fresh = _chains(_routed(_rows(docs, id_col, text_col), index.directory, index.bits))
    both = index.entries.unionByName(fresh).repartitionByRange("bucket").groupBy("bucket", "key", "digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    entries = _written(both)
    keys = entries.groupBy("key").agg(F.sum("group_size").alias("n_rows"))
    directory, bits, capacity = build_directory(materialize(keys, "exact-keys"), index.capacity)
    return ExactIndex(directory, bits, _written(_routed(entries.drop("bucket"), directory, bits).select(index.entries.columns)), capacity)


def lookup(index: ExactIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, digest, keep_id, group_size) of every row, answered by the entries of the bucket that the directory names."""
    rows = docs.select(F.col(id_col).alias("doc_id"), _text(text_col).alias("body"))
    rows = rows.select("doc_id", F.xxhash64("body").alias("key"), _digest("body").alias("digest"))
    # entries are unique in (bucket, key, digest): a key with very many rows is a skewed stream side, which Spark splits
    return _routed(rows, index.directory, index.bits).drop("slices").join(index.entries, ["bucket", "key", "digest"], "left")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Defined results: null text equals empty text; an empty table gives no rows; rows that repeat id and text each
    count in group_size and are each returned (kept alike); a null id is kept only if its whole group has null ids.
    Other columns, whatever their names, are not read.
    """
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    found = lookup(build_index(docs, id_col, text_col, capacity), docs, id_col, text_col)
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Rows of ``docs`` that stay: of equal texts the one with the largest id; all columns unchanged, whatever their names.

    Of rows that repeat an id and its text one stays, whichever; of equal texts whose ids are all null likewise.
    """
    found = lookup(build_index(docs, id_col, text_col, capacity), docs, id_col, text_col)
    found = materialize(found.where("group_size > 1").select("doc_id", "digest", "keep_id"), "exact-found")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    gone = found.where(~stays).select("doc_id", "digest").distinct()
    repeated = found.where(stays).groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    packed = docs.select(F.col(id_col).alias("doc_id"), F.sha2(_text(text_col).cast("binary"), 256).alias("digest"), F.struct("*").alias("row"))
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.digest") == F.col("r.digest"))
    meet = lambda side, how: packed.alias("l").join(side.alias("r"), same, how)
    if repeated.isEmpty():
        return meet(gone, "left_anti").select("row.*")
    once = meet(repeated, "left_semi").dropDuplicates(["doc_id", "digest"]).select("row.*")
    return meet(gone.unionByName(repeated), "left_anti").select("row.*").unionByName(once)
