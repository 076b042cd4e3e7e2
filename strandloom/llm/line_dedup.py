"""Reversible line dedup: sharded cuckoo filters backed by exact reference counts.

A line's key is the line stripped of ASCII white space with A-Z lower-cased; keys of at least ``MIN_CHARS`` code
points found in at least ``MIN_DOCS`` documents lose their lines everywhere but in the document with the largest id.

State, all on shared files: ``postings`` (digest, doc_id; one row per document and key), ``counts`` (digest, n_docs,
last_doc: the exact reference-count table) and ``filters`` (shard, blob: a cuckoo filter of each shard's frequent
keys). ``insert`` and ``delete`` update all three; deleting what was inserted gives the earlier state back.

Rewriting documents asks the filters first, so that only postings that may be frequent meet the exact table. Filters of
at most ``FILTER_BYTES`` together go to every task. Beyond that postings and filters are dealt by shard, each shard over
``SALTS`` tasks so that one key's postings don't go to one, and a task reads the shard's filter ahead of its postings.
"""

from __future__ import annotations

import dataclasses
import hashlib
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.session import materialize

MIN_CHARS, MIN_DOCS = 40, 5
SHARD_KEYS = 1_000_000
FILTER_BYTES, SALTS = 64 << 20, 16
WHITE = " \t\n\x0b\f\r"

_SLOTS, _KICKS = 4, 500


class CuckooFilter:
    """Cuckoo filter of 64-bit hashes: 15-bit fingerprints, four to a bucket, two buckets to a fingerprint."""

    def __init__(self, capacity: int, table: np.ndarray | None = None) -> None:
        if table is None:
            buckets = 1 << max(4, int(np.ceil(np.log2(max(1, capacity) / (_SLOTS * 0.85)))))
            table = np.zeros((buckets, _SLOTS), np.uint16)
        self.table = table
        self.mask = np.uint64(len(table) - 1)

    @classmethod
    def loads(cls, blob: bytes) -> CuckooFilter:
        return cls(0, np.frombuffer(blob, np.uint16).reshape(-1, _SLOTS).copy())

    def dumps(self) -> bytes:
        return self.table.tobytes()

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes = np.asarray(hashes, np.uint64)
        return (hashes >> np.uint64(48) | np.uint64(1)).astype(np.uint16), hashes & self.mask

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return (bucket ^ (prints.astype(np.uint64) * np.uint64(0x5BD1E995))) & self.mask

    def insert(self, hashes: np.ndarray) -> bool:
        """Insert all; False if the table is too full (some may then be in)."""
        prints, at = self._places(hashes)
        rng = np.random.default_rng(0)
        for turn in range(_KICKS):
            if not len(prints):
                return True
            order = np.argsort(at, kind="stable")
            at, prints = at[order], prints[order]
            here = np.arange(len(at))
            starts = np.r_[True, at[1:] != at[:-1]]
            nth = here - np.maximum.accumulate(np.where(starts, here, 0))
            free = self.table[at] == 0
            fits = nth < free.sum(1)
            slots = np.argsort(~free, axis=1, kind="stable")[here[fits], nth[fits]]
            self.table[at[fits], slots] = prints[fits]
            at, prints = at[~fits], prints[~fits]
            if turn and len(at):  # both buckets are full: one newcomer to a bucket turns out an inhabitant
                _, first = np.unique(at, return_index=True)
                slots = rng.integers(0, _SLOTS, len(first))
                turned_out = self.table[at[first], slots]
                self.table[at[first], slots] = prints[first]
                prints[first] = turned_out
            at = self._other(at, prints)
        return not len(prints)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        prints, at = self._places(hashes)
        same = prints[:, None]
        return ((self.table[at] == same) | (self.table[self._other(at, prints)] == same)).any(1)

    def delete(self, hashes: np.ndarray) -> None:
        """Take out hashes that are in: one copy of each fingerprint."""
        prints, at = self._places(hashes)
        for fingerprint, buckets in zip(prints, zip(at, self._other(at, prints), strict=True), strict=True):
            for bucket in buckets:
                found = np.flatnonzero(self.table[bucket] == fingerprint)
                if len(found):
                    self.table[bucket, found[0]] = 0
                    break


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), string.ascii_uppercase, string.ascii_lowercase)


def key_digest(key: Column) -> Column:
    """256 bits of a key that is long enough, else null."""
    return F.when(F.length(key) >= MIN_CHARS, F.unhex(F.sha2(key.cast("binary"), 256)))


def lines_of(text_col: str) -> Column:
    return F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)


def line_postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(digest, doc_id): each row's distinct long keys. No shuffle."""
    # as hex, of which Spark keeps a hash set: binary values would be compared in pairs
    keys = F.array_distinct(F.array_compact(F.transform(lines_of(text_col), lambda x: F.hex(key_digest(line_key(x))))))
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(keys).alias("digest")).select(F.unhex("digest").alias("digest"), "doc_id")


def reference_counts(postings: DataFrame) -> DataFrame:
    return postings.groupBy("digest").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))


def _hashes(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 4)[:, 0]


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")


def build_filters(frequent: DataFrame, shards: int) -> DataFrame:
    """(shard, blob): a cuckoo filter of each shard's digests, doubled until all fit."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        hashes, capacity = _hashes(rows["digest"]), len(rows)
        while not (made := CuckooFilter(capacity)).insert(hashes):
            capacity *= 2
        return pd.DataFrame({"shard": [key[0]], "blob": [made.dumps()]})

    return frequent.select("digest", _shard(shards).alias("shard")).groupBy("shard").applyInPandas(build, "shard int, blob binary")


def update_filters(filters: DataFrame, changes: DataFrame, frequent: DataFrame, shards: int) -> DataFrame:
    """Filters after ``changes`` (digest, delta: +1 newly frequent, -1 no longer). An overfull shard is built anew."""

    def update(key: tuple, old: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        made = CuckooFilter.loads(old["blob"].iloc[0]) if len(old) else CuckooFilter(1)
        made.delete(_hashes(rows["digest"][rows["delta"] < 0]))
        if not made.insert(_hashes(rows["digest"][rows["delta"] > 0])):
            every, capacity = _hashes(rows["digest"][rows["delta"] >= 0]), len(rows)
            while not (made := CuckooFilter(capacity)).insert(every):
                capacity *= 2
        return pd.DataFrame({"shard": [key[0]], "blob": [made.dumps()]})

    told = frequent.select("digest").join(changes.select("digest"), "digest", "left_anti").withColumn("delta", F.lit(0)).unionByName(changes.select("digest", "delta"))
    told = told.withColumn("shard", _shard(shards))
    return filters.groupBy("shard").cogroup(told.groupBy("shard")).applyInPandas(update, "shard int, blob binary")


@dataclasses.dataclass
class LineIndex:
    """Postings, exact reference counts and filters of the documents indexed so far."""

    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int

    @property
    def frequent(self) -> DataFrame:
        return self.counts.where(F.col("n_docs") >= MIN_DOCS)


def index_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
    postings = materialize(line_postings(docs, id_col, text_col), "line-postings")
    counts = materialize(reference_counts(postings), "line-counts")
    frequent = counts.where(F.col("n_docs") >= MIN_DOCS)
    shards = max(1, -(-frequent.count() // SHARD_KEYS))
    return LineIndex(postings, counts, materialize(build_filters(frequent, shards), "line-filters"), shards)


def _changed(index: LineIndex, postings: DataFrame, counts: DataFrame) -> LineIndex:
    counts = materialize(counts, "line-counts")
    after = counts.where(F.col("n_docs") >= MIN_DOCS)
    shards = max(1, -(-after.count() // SHARD_KEYS))
    if shards > 2 * index.shards or index.shards > 2 * shards:  # deal the keys anew
        return LineIndex(postings, counts, materialize(build_filters(after, shards), "line-filters"), shards)
    keys = index.frequent.select("digest", F.lit(True).alias("was")).join(after.select("digest", F.lit(True).alias("is")), "digest", "full")
    changes = keys.where("was is null or is is null").select("digest", F.expr("if(was is null, 1, -1)").alias("delta"))
    filters = update_filters(index.filters, changes, after, index.shards)
    return LineIndex(postings, counts, materialize(filters, "line-filters"), index.shards)


def insert(index: LineIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
    """The index with ``docs`` added: only their own lines are read. An id that the index has already is an error."""
    fresh = materialize(line_postings(docs, id_col, text_col), "line-postings")
    again = fresh.select("doc_id").distinct().join(index.postings.select("doc_id").distinct(), "doc_id").first()
    if again is not None:
        raise ValueError(f"document {again['doc_id']} is in the index already")
    both = index.counts.unionByName(reference_counts(fresh)).groupBy("digest").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))
    return _changed(index, index.postings.unionByName(fresh), both)


def delete(index: LineIndex, ids: DataFrame) -> LineIndex:
    """The index without the documents in ``ids`` (doc_id)."""
    ids = ids.select("doc_id").distinct()
    postings = materialize(index.postings.join(ids, "doc_id", "left_anti").select("digest", "doc_id"), "line-postings")
    touched = index.postings.join(ids, "doc_id", "left_semi").select("digest").distinct()
    anew = reference_counts(postings.join(touched, "digest", "left_semi"))
    return _changed(index, postings, index.counts.join(touched, "digest", "left_anti").unionByName(anew))


def _contains(filters: dict[int, CuckooFilter], batch: pa.RecordBatch) -> np.ndarray:
    """Which postings of a batch (digest, shard) the filters let through."""
    hashes = _hashes(batch.column("digest").to_pylist()) if batch.num_rows else np.zeros(0, np.uint64)
    shard, hit = np.array(batch.column("shard").to_pylist(), np.int32), np.zeros(batch.num_rows, bool)
    for k in np.unique(shard).tolist():
        if k in filters:
            hit[shard == k] = filters[k].contains(hashes[shard == k])
    return hit


def _probe_everywhere(index: LineIndex, postings: DataFrame) -> DataFrame:
    blobs = postings.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["blob"]) for r in index.filters.collect()})  # at most FILTER_BYTES

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = {shard: CuckooFilter.loads(blob) for shard, blob in blobs.value.items()}
        for batch in batches:
            yield batch.select(["digest", "doc_id"]).filter(pa.array(_contains(filters, batch)))

    return postings.mapInArrow(probe, index.postings.schema)


def _probe_by_shard(index: LineIndex, postings: DataFrame) -> DataFrame:
    salted = postings.select("shard", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"), F.lit(None).cast("binary").alias("blob"), "digest", "doc_id")
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    filters = index.filters.select("shard", every, "blob", F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("doc_id"))
    tasks = max(index.shards * SALTS, postings.sparkSession.sparkContext.defaultParallelism)
    # a shard's filter sorts before its postings
    dealt = salted.unionByName(filters).repartition(tasks, "shard", "salt").sortWithinPartitions("shard", "salt", F.col("blob").isNull())

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: dict[int, CuckooFilter] = {}
        for batch in batches:
            blobs = batch.column("blob")
            edges = sorted({0, *np.flatnonzero(blobs.is_valid().to_pylist()).tolist(), batch.num_rows})
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if blobs[lo].is_valid:
                    filters = {batch.column("shard")[lo].as_py(): CuckooFilter.loads(blobs[lo].as_py())}
                    lo += 1
                part = batch.slice(lo, hi - lo)
                if part.num_rows:
                    yield part.select(["digest", "doc_id"]).filter(pa.array(_contains(filters, part)))

    return dealt.mapInArrow(probe, index.postings.schema)


def _maybe_frequent(index: LineIndex) -> DataFrame:
    """Postings that the filters let through."""
    size = index.filters.agg(F.sum(F.octet_length("blob"))).first()[0] or 0
    postings = index.postings.withColumn("shard", _shard(index.shards))
    return _probe_by_shard(index, postings) if size > FILTER_BYTES else _probe_everywhere(index, postings)


def line_drops(index: LineIndex) -> DataFrame:
    """(doc_id, drop: the digests whose lines this document loses)."""
    exact = index.frequent.select("digest", "last_doc")
    lost = _maybe_frequent(index).join(exact, "digest").where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
    return lost.groupBy("doc_id").agg(F.collect_set("digest").alias("drop"))


def _kept_lines(body: pd.Series, drop: pd.Series) -> pd.DataFrame:
    """Each text without the lines whose keys are in ``drop``."""
    white, lower = WHITE, str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    out = []
    for text, digests in zip(body, drop, strict=True):
        if digests is None:
            out.append((None, None))
            continue
        gone, lines = {bytes(d) for d in digests}, text.split("\n")
        keys = (line.strip(white).translate(lower) for line in lines)
        kept = [line for line, key in zip(lines, keys, strict=True) if len(key) < MIN_CHARS or hashlib.sha256(key.encode()).digest() not in gone]
        out.append(("\n".join(kept), len(lines) - len(kept)))
    return pd.DataFrame({"kept_text": pd.Series([k for k, _ in out], dtype=object), "n_dropped": pd.Series([n for _, n in out], dtype="Int64")})


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, kept_text.

    Defined results: a null or empty text is one empty line; rows that repeat an id count as documents of that id
    each and are all returned; a key held by null ids only stays in those; an empty table gives no rows; other
    columns are not read. A line kept by the largest id keeps all its occurrences there.
    """
    drops = line_drops(index_lines(docs, id_col, text_col)).select(F.col("doc_id").alias("of_doc"), "drop")
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), body.alias("body"), F.size(lines_of(text_col)).cast("long").alias("n_lines"))
    rows = rows.join(drops, F.col("doc_id").eqNullSafe(F.col("of_doc")), "left")
    # only texts that lose lines go to Python
    rows = rows.withColumn("left", F.pandas_udf(_kept_lines, "kept_text string, n_dropped long")(F.when(F.col("drop").isNotNull(), F.col("body")), F.col("drop")))
    return rows.select("doc_id", "n_lines", F.coalesce("left.n_dropped", F.lit(0).cast("long")).alias("n_dropped"), F.coalesce("left.kept_text", "body").alias("kept_text"))
