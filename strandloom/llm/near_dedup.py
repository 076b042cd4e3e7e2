"""Near-duplicate documents by b-bit min-hash.

1. Every whole text becomes its set of distinct word shingles. Equal sets are one class from here on; only the
   class's smallest id goes on, so any number of copies costs one row.
2. Min-hashes give band keys, and their low ``BITS`` bits are packed into a signature of 64-bit words. Bands are chosen so
   that a pair at the threshold shares none with a probability of at most ``MISS``.
3. Round one links each member of a band's bucket with the bucket's smallest id: as many candidates as members.
   Equal lanes are counted on the words' bits; candidates whose count is more than ``SIGMAS`` deviations below what a
   pair at the threshold has, chance agreement included, go; the rest are confirmed on the full sets.
4. Round two looks only at buckets whose members are still in several components. There, members outside the
   bucket's largest component are compared with all members in other components. Both kinds are cut into blocks of
   ``BLOCK`` rows, and tasks get pairs of blocks, one of them at least from outside the largest component: first by
   signature, then, for rows with a surviving pair, on the full sets. A pair of blocks emits a link only if it joins two
   components. No pair within a component is made, and none that can join two is left out.
5. Components of the confirmed links are found by contraction.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.shingles import min_hashes, mix, shingle_sets, slices
from strandloom.operators.graph import connected
from strandloom.session import materialize

BITS, HASHES, MISS, SIGMAS, BLOCK = 4, 128, 1e-6, 5.0, 512


def bands_for(percent: int) -> tuple[int, int]:
    """(bands, rows): the longest bands that miss a pair at the threshold with a probability of at most ``MISS``."""
    t = percent / 100
    fit = [r for r in range(1, 17) if (1 - t**r) ** (HASHES // r) <= MISS]
    if not fit:
        raise ValueError(f"{HASHES} hashes miss pairs at {percent} % with a probability above {MISS}")
    return HASHES // max(fit), max(fit)


def least_matches(percent: int) -> int:
    """Signature lanes that must agree for a pair to be confirmed on its sets.

    Lanes of unequal minima agree by chance once in ``2 ** BITS``, so a pair at the threshold t agrees in a lane with
    probability t + (1 - t) / 2 ** BITS.
    """
    bands, rows = bands_for(percent)
    n, t = bands * rows, percent / 100
    agree = t + (1 - t) * 2.0**-BITS
    return int(np.floor(n * agree - SIGMAS * (n * agree * (1 - agree)) ** 0.5))


def packed(minima: np.ndarray) -> np.ndarray:
    """[rows, words] of 64 bits: the low ``BITS`` bits of each minimum, side by side; lanes left over are zero."""
    per_word = 64 // BITS
    low = np.zeros((len(minima), -(-minima.shape[1] // per_word) * per_word), np.uint64)
    low[:, : minima.shape[1]] = minima & np.uint32((1 << BITS) - 1)
    shifts = np.arange(per_word, dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(low.reshape(len(minima), -1, per_word) << shifts, axis=2)


def unequal_lanes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many lanes packed signatures differ, by counting bits."""
    differ = a ^ b
    for k in (1 << j for j in range(BITS.bit_length() - 1)):
        differ |= differ >> np.uint64(k)
    lowest = np.uint64(((1 << 64) - 1) // ((1 << BITS) - 1))
    return np.bitwise_count(differ & lowest).sum(axis=-1, dtype=np.int64)


def band_keys(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.empty((len(minima), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(minima), band + 1, np.uint64)
        for r in range(rows):
            key = mix(key * np.uint64(31) + minima[:, band * rows + r])
        keys[:, band] = key
    return keys.view(np.int64)


FEATURES = "doc_id long, n_shingles long, set_id binary, signature binary, bands array<long>"


def _features(batches: Iterator[pa.RecordBatch], words: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "body"):
            sets = shingle_sets(part.column("body").to_pylist(), words)
            full = [i for i, s in enumerate(sets) if len(s)]
            minima = min_hashes([sets[i] for i in full], bands * rows)
            low, keys = packed(minima), band_keys(minima, bands, rows)
            signature, band_list, set_id = ([None] * len(sets) for _ in range(3))
            for k, i in enumerate(full):
                signature[i], band_list[i] = low[k].tobytes(), keys[k]
                set_id[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(set_id, pa.binary()), pa.array(signature, pa.binary()), pa.array(band_list, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_id", "signature", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "body"):
            sets = [s.tobytes() for s in shingle_sets(part.column("body").to_pylist(), words)]
            keys = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([part.column("rep"), pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], ["rep", "set_id", "shingles"])


def _words(column: pd.Series | pa.Array) -> np.ndarray:
    values = column.to_pylist() if isinstance(column, pa.Array) else list(column)
    return np.frombuffer(b"".join(values), np.uint64).reshape(len(values), -1) if values else np.zeros((0, 1), np.uint64)


def _likely(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = unequal_lanes(_words(batch.column("a_signature")), _words(batch.column("b_signature"))) <= most
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    inter = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * inter >= percent * (len(a) + len(b) - inter)


def _confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "a_set", "b_set"):
            pairs = zip(part.column("a_set").to_pylist(), part.column("b_set").to_pylist(), strict=True)
            keep = [linked(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent) for a, b in pairs]
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


BLOCK_ROW = "key long, first int, second int, rep long, component long, pivot long, outer boolean, block int, signature binary, bands array<long>"


def _open_pairs(rows: pd.DataFrame, key: tuple, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row outside the main component, the rows of this pair of blocks it must still be compared with.

    A pair is looked at in the first band that it shares, not again with the bucket's pivot, and from one side.
    """
    band, first, second = (int(k) for k in key)
    lanes, bands = _words(rows["signature"]), np.array(rows["bands"].tolist(), np.int64)
    rep, component, pivot = (rows[c].to_numpy(np.int64) for c in ("rep", "component", "pivot"))
    outer, block = rows["outer"].to_numpy(bool), rows["block"].to_numpy(np.int64)
    for x in np.flatnonzero(outer & (rep != pivot)):
        there = (component != component[x]) & (rep != pivot) & (~outer | (rep > rep[x]))
        if first != second:
            there &= block != block[x]
        at = np.flatnonzero(there)
        at = at[unequal_lanes(lanes[at], lanes[x]) <= most]
        shared = bands[at] == bands[x]
        at = at[bands[x][shared.argmax(1)] == band] if len(at) else at
        if len(at):
            yield int(x), at


def _mark_blocks(key: tuple, rows: pd.DataFrame, most: int) -> pd.DataFrame:
    marked = np.zeros(len(rows), bool)
    for x, at in _open_pairs(rows, key, most):
        marked[x] = True
        marked[at] = True
    return rows[marked]


def _link_blocks(key: tuple, rows: pd.DataFrame, most: int, percent: int) -> pd.DataFrame:
    sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"]]
    rep, component = rows["rep"].to_numpy(np.int64), rows["component"].to_numpy(np.int64)
    joined: dict[int, int] = {}

    def root(c: int) -> int:
        while c in joined:
            c = joined[c]
        return c

    links = []
    for x, at in _open_pairs(rows, key, most):
        at = np.array([r for r in at if root(component[r]) != root(component[x])], np.int64)
        if not len(at):
            continue
        own, sizes = sets[x], np.array([len(sets[r]) for r in at])
        other = np.concatenate([sets[r] for r in at])
        place = np.minimum(np.searchsorted(own, other), len(own) - 1)
        inter = np.add.reduceat(own[place] == other, np.cumsum([0, *sizes])[:-1], dtype=np.int64)
        for r in at[100 * inter >= percent * (len(own) + sizes - inter)]:
            a, b = root(component[x]), root(component[r])
            if a != b:
                joined[max(a, b)] = min(a, b)
                links.append((min(rep[x], rep[r]), max(rep[x], rep[r])))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _pair_up(pairs: DataFrame, side: DataFrame, column: str, suffix: str) -> DataFrame:
    for end in ("a", "b"):
        pairs = pairs.join(side.select(F.col("rep").alias(end), F.col(column).alias(f"{end}_{suffix}")), end)
    return pairs


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Texts are linked if 100 * |intersection| >= percent * |union| of their shingle sets; component_id is the smallest id
    reachable, kept says whether it is the row's own. Defined results: null, empty and blank texts have no shingles,
    are linked with nothing and stay; texts of fewer words are one shingle; rows that repeat an id are one document
    and are all returned; a null id is never another's component; an empty table gives no rows; other columns are
    not read.
    """
    bands, rows = bands_for(percent)
    most = bands * rows - least_matches(percent)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))
    features = materialize(texts.mapInArrow(lambda b: _features(b, words, bands, rows), FEATURES), "minhash")
    classes = materialize(features.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep")), "shingle-classes")
    firsts = classes.where("rep is not null").select("set_id", F.col("rep").alias("doc_id"))
    # rows that repeat id and text are one
    reps = features.join(firsts, ["set_id", "doc_id"], "left_semi").groupBy("set_id", F.col("doc_id").alias("rep")).agg(F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    reps = materialize(reps.drop("set_id"), "minhash-reps")

    in_bands = reps.select("rep", F.explode("bands").alias("key"))
    buckets = in_bands.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("pivot")).where("n > 1")
    members = materialize(in_bands.join(buckets, "key").select("key", "rep", "pivot", "n"), "bucket-members")

    # the sets of those that are in a bucket with others, from their whole texts
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = texts.join(wanted, "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "body").mapInArrow(lambda b: _sets(b, words), "rep long, set_id binary, shingles binary")
    sets = materialize(sets.groupBy("rep", "set_id").agg(F.first("shingles").alias("shingles")).drop("set_id"), "shingle-sets")

    star = members.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    likely = _pair_up(star, reps, "signature", "signature").mapInArrow(lambda b: _likely(b, most), "a long, b long")
    links = _pair_up(likely, sets, "shingles", "set").mapInArrow(lambda b: _confirmed(b, percent), "a long, b long")
    found = connected(links)

    labelled = members.where("n > 2").join(found.select(F.col("node_id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    labelled = materialize(labelled, "bucket-components")
    shares = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("share"))
    unsettled = shares.groupBy("key").agg(F.sum("share").alias("n"), F.max("share").alias("in_main"), F.max_by("component", F.struct("share", "component")).alias("main")).where("n > in_main")
    blocks = lambda rows: F.ceil(rows / BLOCK).cast("int")
    unsettled = unsettled.select("key", "main", blocks(F.col("n") - F.col("in_main")).alias("outer_blocks"), blocks(F.col("in_main")).alias("main_blocks"))
    open_rows = labelled.drop("n").join(unsettled, "key").withColumn("outer", F.col("component") != F.col("main"))
    # blocks outside the main component come first; each is paired with itself and with every other block
    every = F.col("outer_blocks") + F.col("main_blocks")
    own_block = F.when(F.col("outer"), F.pmod(F.xxhash64("rep"), "outer_blocks")).otherwise(F.col("outer_blocks") + F.pmod(F.xxhash64("rep"), "main_blocks")).cast("int")
    dealt = open_rows.withColumn("block", own_block).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("outer"), every).otherwise(F.col("outer_blocks")) - 1)))
    dealt = dealt.withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other"))
    dealt = dealt.join(reps, "rep").select("key", "first", "second", "rep", "component", "pivot", "outer", "block", "signature", "bands")
    marked = materialize(dealt.groupBy("key", "first", "second").applyInPandas(lambda k, r: _mark_blocks(k, r, most), BLOCK_ROW), "bucket-open")
    more = marked.join(sets, "rep").groupBy("key", "first", "second").applyInPandas(lambda k, r: _link_blocks(k, r, most, percent), "a long, b long")
    more = materialize(more, "bucket-links")
    if not more.isEmpty():
        found = connected(found.select(F.col("node_id").alias("a"), F.col("component").alias("b")).unionByName(more))

    of_class = classes.join(found.select(F.col("node_id").alias("rep"), "component"), "rep", "left").select("set_id", F.coalesce("component", "rep").alias("component"))
    result = features.select("doc_id", "n_shingles", "set_id").join(of_class, "set_id", "left")
    component = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return result.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose document is its component's smallest id; all columns unchanged."""
    gone = near_groups(docs, words, percent, id_col, text_col).where("not kept").select(F.col("doc_id").alias("__dropped_id")).distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(gone["__dropped_id"]), "left_anti")
