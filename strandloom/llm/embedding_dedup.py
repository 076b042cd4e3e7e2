"""Near-duplicate embeddings by spherical-cap filters.

A filter is a direction of a structured random product code: the dimensions are dealt into ``PARTS`` parts, each with
the same number of random unit vectors, and a direction is one codeword per part. List decoding gives each vector all
directions whose inner product with it exceeds a cap, and a number of its best ones, by bounding the sum part by
part. The cap and the number of directions grow with the largest label (``filters_for``): each vector keeps about
``FILTERS`` filters and some more in large tables, a filter about ``MEMBERS`` vectors spread at random, so that work
grows in proportion to the table but for a power of its logarithm. Vectors of one label that share a filter are candidates and are compared
exactly, in double precision. Equal vectors are one class throughout.

Buckets are cut into blocks of ``BLOCK`` rows and pairs of blocks are dealt over tasks, so a bucket of any size is
split. A pair is counted in the first filter that it shares. Tasks return sums of links and spanning links, never pairs.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.graph import connected
from strandloom.session import materialize

PARTS, CAP, FILTERS, MEMBERS, LEAST_FILTERS = 3, 3.75, 78, 4.5, 32
BLOCK, TASK_ROWS, TASK_BYTES = 512, 20_000, 64 << 20
TOGETHER = 1_024


def filters_for(n: int) -> tuple[int, float, int]:
    """(codewords of a part, cap in standard deviations, least filters of a vector) for labels of up to ``n`` vectors.

    The higher the cap, the smaller the part of a filter's vectors that a neighbour shares, so that vectors get more
    filters then, by a power of log n, for the same recall.
    """
    usual = 1 - NormalDist().cdf(CAP)
    share = min(usual, MEMBERS / max(1, n))
    more = (math.log(share) / math.log(usual)) ** 3
    return math.ceil((FILTERS * more / share) ** (1 / PARTS)), -NormalDist().inv_cdf(share), round(LEAST_FILTERS * more)


@functools.lru_cache(maxsize=8)
def product_code(dim: int, codewords: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(dimensions, codewords as rows) of each part; a direction's parts have equal lengths that sum to one."""
    rng = np.random.default_rng(dim)
    parts = [p for p in np.array_split(rng.permutation(dim), min(PARTS, dim)) if len(p)]
    code = []
    for dims in parts:
        words = rng.standard_normal((codewords, len(dims)))
        code.append((dims, words / np.linalg.norm(words, axis=1, keepdims=True) / len(parts) ** 0.5))
    return code


def list_decode(vector: np.ndarray, codewords: int, cap: float, least: int) -> np.ndarray:
    """Numbers of all filters that the unit vector exceeds, and of its ``least`` best ones, sorted."""
    scores = [words @ vector[dims] for dims, words in product_code(len(vector), codewords)]
    cut = cap / len(vector) ** 0.5
    # the best directions are among combinations of each part's best codewords
    top = [np.sort(s)[::-1][:least] for s in scores]
    sums = functools.reduce(lambda a, b: np.sort((a[:, None] + b).ravel())[::-1][:least], top)
    cut = min(cut, sums[-1]) - 1e-12
    rest = [sum(s.max() for s in scores[k + 1 :]) for k in range(len(scores))]
    number, total = np.zeros(1, np.int64), np.zeros(1)
    for s, later in zip(scores, rest, strict=True):
        both = total[:, None] + s
        a, b = np.nonzero(both >= cut - later)
        number, total = number[a] * codewords + b, both[a, b]
    return np.sort(number)


def unit(values: list | None) -> np.ndarray | None:
    """The vector scaled to length one; None if it is null, empty, zero or holds a null or non-finite component."""
    if not values or any(v is None for v in values):
        return None
    vector = np.array(values, np.float64)
    if not np.isfinite(vector).all() or not (largest := np.abs(vector).max()):
        return None
    vector = vector / largest
    return vector / np.linalg.norm(vector)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        units = [unit(v) for v in batch.column("embedding").to_pylist()]
        data = [None if u is None else u.tobytes() for u in units]
        keys = [d and hashlib.blake2b(d, digest_size=16).digest() for d in data]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(keys, pa.binary()), pa.array(data, pa.binary())], ["vec_id", "label", "key", "unit"])


def _filters(batches: Iterator[pa.RecordBatch], codewords: int, cap: float, least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [list_decode(np.frombuffer(u, np.float64), codewords, cap, least) for u in batch.column("unit").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int64()))], [*batch.schema.names, "filters"])


def _earlier(filters: list[np.ndarray], now: int) -> np.ndarray:
    """Which pairs of rows share a filter before ``now``; ``TOGETHER`` filters at a time are laid out."""
    before = [f[: np.searchsorted(f, now)] for f in filters]
    names, column = np.unique(np.concatenate(before), return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = np.repeat(np.arange(len(filters)), [len(b) for b in before])[order], column[order]
    shared = np.zeros((len(filters), len(filters)), bool)
    for lo in range(0, len(names), TOGETHER):
        part = slice(*np.searchsorted(column, (lo, lo + TOGETHER)))
        has = np.zeros((len(filters), TOGETHER), np.float32)
        has[row[part], column[part] - lo] = 1
        shared |= has @ has.T > 0
    return shared


def _compare(rows: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """(rep, links, root) of the rows with links, over all pairs of blocks in ``rows``."""
    rows = rows.sort_values(["label", "dim", "filter", "first", "second", "rep"], kind="stable").reset_index(drop=True)
    group = rows.groupby(["label", "dim", "filter", "first", "second"], sort=False).ngroup().to_numpy()
    edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    rep, weight, block = rows["rep"].to_numpy(np.int64), rows["size"].to_numpy(np.int64), rows["block"].to_numpy()
    units, filters = rows["unit"].to_numpy(), rows["filters"].to_numpy()
    name, first, second = rows["filter"].to_numpy(), rows["first"].to_numpy(), rows["second"].to_numpy()
    out = []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        if hi - lo < 2:
            continue
        vectors = np.frombuffer(b"".join(units[lo:hi]), np.float64).reshape(hi - lo, -1)
        link = vectors @ vectors.T >= cosine
        np.fill_diagonal(link, False)
        if first[lo] != second[lo]:
            link &= block[lo:hi, None] != block[lo:hi]
        if not link.any():
            continue
        link &= ~_earlier(list(filters[lo:hi]), name[lo])
        mine = np.flatnonzero(link.any(1))
        if not len(mine):
            continue
        link = link[np.ix_(mine, mine)]
        ids = rep[lo:hi][mine]
        root = ids.copy()
        while True:
            lower = np.minimum(root, np.where(link, root, np.iinfo(np.int64).max).min(1))
            if (lower == root).all():
                break
            root = lower
        out.append(pd.DataFrame({"rep": ids, "links": link @ weight[lo:hi][mine], "root": root}))
    return pd.concat(out) if out else pd.DataFrame({"rep": [], "links": [], "root": []}, dtype="int64")


def near_vectors(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors are linked if their labels are equal and their cosine is at least ``cosine``. Defined results: null labels,
    and vectors that are null, empty, zero or hold null or non-finite components, are linked with nothing; vectors of
    different lengths are not linked; equal vectors, also repeated rows, count one link each; a null id is
    never another's component; an empty table gives no rows; other columns are not read.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    rows = materialize(rows.mapInArrow(_units, "vec_id long, label string, key binary, unit binary"), "vectors")
    valid = rows.where("label is not null and key is not null")
    classes = materialize(valid.groupBy("label", "key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size")), "vector-classes")
    largest = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    codewords, cap, least = filters_for(largest or 0)
    firsts = classes.where("rep is not null")
    reps = valid.join(firsts.withColumnRenamed("rep", "vec_id"), ["label", "key", "vec_id"]).dropDuplicates(["label", "vec_id", "key"])
    reps = reps.select(F.col("vec_id").alias("rep"), "label", "size", "unit").mapInArrow(lambda b: _filters(b, codewords, cap, least), "rep long, label string, size long, unit binary, filters array<long>")
    reps = materialize(reps.withColumn("dim", F.octet_length("unit")), "vector-filters")

    posts = reps.select("rep", "label", "dim", F.explode("filters").alias("filter"))
    shared = posts.groupBy("label", "dim", "filter").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = posts.join(shared, ["label", "dim", "filter"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    members = members.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = materialize(members.select("rep", "label", "dim", "filter", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second")), "filter-members")
    told = members.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("dim").cast("long")), F.lit(0)).alias("n_bytes")).first()
    tasks = max(1, told["n"] // TASK_ROWS, told["n_bytes"] // TASK_BYTES)
    dealt = members.withColumn("task", F.pmod(F.xxhash64("label", "dim", "filter", "first", "second"), F.lit(tasks)))
    compared = dealt.join(reps.select("rep", "label", "size", "unit", "filters"), ["rep", "label"]).groupBy("task").applyInPandas(lambda r: _compare(r, cosine), "rep long, links long, root long")
    compared = materialize(compared, "vector-links")

    found = connected(compared.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = compared.groupBy("rep").agg(F.sum("links").alias("links"))
    told = classes.join(links, "rep", "left").join(found.withColumnRenamed("node_id", "rep"), "rep", "left")
    told = told.select("label", "key", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"), F.lit(True).alias("valid"))
    result = rows.select("vec_id", "label", "key").join(told, ["label", "key"], "left")
    component = F.when(F.col("valid"), F.col("component")).otherwise(F.col("vec_id"))
    return result.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
