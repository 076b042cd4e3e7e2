"""Byte-level BPE encoding and decoding of whole texts.

Texts of up to ``CHUNK`` characters are one chunk, which has no seam, and are encoded where they are. Longer ones are cut into overlapping chunks, which
tasks pre-tokenise in parallel. Two neighbouring chunks are stitched at the first pre-token boundary on which
both agree: a match of the pattern depends on nothing before its start, so from a common boundary on the later
chunk's matches are those of the whole text. The pieces between such boundaries are then encoded in parallel.
Where two chunks never agree (a run longer than the overlap) the piece goes on into the following chunks.
Decoding concatenates the bytes of the ids, piece after piece.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.llm.shingles import slices

CHUNK = 32_768
OVERLAP = 1_024
#: a contraction is known to be one only after three characters
LOOKAHEAD = 3

RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@functools.lru_cache(maxsize=2)
def encoder(vocab_path: str, pattern: str) -> tiktoken.Encoding:
    with open(vocab_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, vocab_path: str, pattern: str) -> np.ndarray:
    """Ids of one text, little-endian unsigned 32-bit."""
    return np.asarray(encoder(vocab_path, pattern).encode_ordinary(text), dtype="<u4")


def decode(ids: np.ndarray, vocab_path: str, pattern: str) -> bytes:
    return encoder(vocab_path, pattern).decode_bytes(ids.tolist())


def boundaries(text: str, pattern: str) -> np.ndarray:
    """Starts of the pattern's matches, and the end of the last: every character is in a match."""
    return np.cumsum([0, *map(len, regex.findall(pattern, text))])


def _cut(batches: Iterator[pd.DataFrame], chunk: int, overlap: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            starts = range(0, max(1, len(row.body) - overlap), chunk)
            yield pd.DataFrame(
                {"rid": row.rid, "doc_id": row.doc_id, "k": np.arange(len(starts)), "start": list(starts),
                 "body": [row.body[s : s + chunk + overlap] for s in starts]}
            )


def _zones(batches: Iterator[pd.DataFrame], pattern: str, chunk: int, overlap: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        left, right = [], []
        for start, body in zip(batch["start"], batch["body"], strict=True):
            at = boundaries(body, pattern)
            sure = at[at <= len(body) - LOOKAHEAD]
            left.append((sure[sure <= overlap - LOOKAHEAD] + start).tolist())
            right.append((sure[sure >= chunk] + start).tolist())
        yield batch.assign(left_at=left, right_at=right)


def _encode_pieces(batches: Iterator[pd.DataFrame], vocab_path: str, pattern: str) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            begin, text, reached = row.begin, [], row.begin
            for part in row.parts:
                text.append(part["body"][reached - part["start"] :])
                reached = max(reached, part["start"] + len(part["body"]))
            whole = "".join(text)
            whole = whole if pd.isna(row.stop) else whole[: int(row.stop) - begin]
            ids = encode(whole, vocab_path, pattern)
            out.append((row.rid, row.doc_id, begin, len(ids), ids.tobytes(), decode(ids, vocab_path, pattern)))
        yield pd.DataFrame(out, columns=["rid", "doc_id", "begin", "n", "ids", "raw"])


def _digest_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            ids, raw, n = hashlib.sha256(), hashlib.sha256(), 0
            for piece in row.pieces:
                ids.update(piece["ids"])
                raw.update(piece["raw"])
                n += piece["n"]
            out.append((row.doc_id, n, ids.hexdigest(), raw.hexdigest()))
        yield pd.DataFrame(out, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]).astype({"doc_id": "Int64"})


def _digest_texts(batches: Iterator[pa.RecordBatch], vocab_path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "body"):
            n, ids_sha, raw_sha = [], [], []
            for text in part.column("body").to_pylist():
                ids = encode(text, vocab_path, pattern)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                raw_sha.append(hashlib.sha256(decode(ids, vocab_path, pattern)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(raw_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )


def encode_pieces(docs: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Encode texts by overlapping chunks: (rid, doc_id, begin, n, ids, raw), a row per stitched piece.

    ``ids`` are little-endian unsigned 32-bit, ``raw`` the decoded bytes, ``begin`` the piece's first character;
    ``rid`` tells rows with equal ids apart. A null text is empty and gives one piece of no ids.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    chunks = rows.mapInPandas(lambda b: _cut(b, chunk, overlap), "rid long, doc_id long, k int, start long, body string")
    zoned = chunks.repartition("rid", "k").mapInPandas(
        lambda b: _zones(b, pattern, chunk, overlap), "rid long, doc_id long, k int, start long, body string, left_at array<long>, right_at array<long>"
    )
    along = Window.partitionBy("rid").orderBy("k")
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = F.when(F.col("k") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("left_at", F.lag("right_at").over(along))))
    # after a chunk that doesn't agree with its neighbour no later boundary is sure, so its piece takes the rest
    pieces = (
        zoned.withColumn("cut", cut)
        .withColumn("sure", F.min(F.col("cut").isNotNull()).over(so_far))
        .withColumn("begin", F.max(F.when(F.col("sure"), F.col("cut"))).over(so_far))
        .withColumn("stop", F.lead(F.when(F.col("sure"), F.col("cut"))).over(along))
        .groupBy("rid", "doc_id", "begin")
        .agg(F.array_sort(F.collect_list(F.struct("start", "body"))).alias("parts"), F.max("stop").alias("stop"))
    )
    return pieces.mapInPandas(lambda b: _encode_pieces(b, vocab_path, pattern), "rid long, doc_id long, begin long, n long, ids binary, raw binary")


def round_trip_digests(docs: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256 (see the module's text).

    Defined results: null and empty texts have no tokens and the digests of no bytes; repeated rows and ids are
    returned each; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    short = rows.where(F.length("body") <= chunk).mapInArrow(lambda b: _digest_texts(b, vocab_path, pattern), RESULT)
    pieces = encode_pieces(rows.where(F.length("body") > chunk), vocab_path, pattern, "doc_id", "body", chunk, overlap)
    long = pieces.groupBy("rid", "doc_id").agg(F.array_sort(F.collect_list(F.struct("begin", "n", "ids", "raw"))).alias("pieces")).mapInPandas(_digest_pieces, RESULT)
    return short.unionByName(long)
