"""Framed protobuf files of derived alignments, for the queries and tests of their reader."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame

from strandloom.sources.alignment_files import ALIGNMENT_COLUMNS


def _put_varint(value: int) -> bytes:
    value &= (1 << 64) - 1
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def _put(number: int, value: int | bytes | float | str) -> bytes:
    if isinstance(value, float):
        return _put_varint(number << 3 | 1) + struct.pack("<d", value)
    if isinstance(value, int):
        return _put_varint(number << 3) + _put_varint(value) if value else b""
    value = value.encode() if isinstance(value, str) else bytes(value)
    return _put_varint(number << 3 | 2) + _put_varint(len(value)) + value


def encode_alignment(row: dict) -> bytes:
    mappings = b""
    for m in row["path"]["mapping"]:
        p = m["position"]
        edits = b"".join(_put(2, _put(1, e["from_length"]) + _put(2, e["to_length"]) + _put(3, e["sequence"])) for e in m["edit"])
        mappings += _put(2, _put(1, _put(1, p["node_id"]) + _put(2, p["offset"]) + _put(4, int(p["is_reverse"]))) + edits + _put(5, m["rank"]))
    refpos = b"".join(_put(20, _put(2, r["offset"]) + _put(4, int(r["is_reverse"])) + _put(5, r["name"])) for r in row["refpos"])
    return _put(1, row["sequence"]) + _put(2, mappings) + _put(3, row["name"]) + _put(4, row["quality"]) + _put(5, row["mapping_quality"]) + _put(16, float(row["identity"])) + refpos


def encode_group(rows: list[dict], tag: bytes = b"GAM") -> bytes:
    pieces = [tag, *map(encode_alignment, rows)]
    return _put_varint(len(pieces)) + b"".join(_put_varint(len(p)) + p for p in pieces)


def bgzf(content: bytes, block: int = 65_280) -> bytes:
    """``content`` as BGZF: gzip members of at most 64 KB that tell their size, and an empty one at the end."""
    out = []
    for at in [*range(0, len(content), block), None]:
        part = b"" if at is None else content[at : at + block]
        packed = (deflate := zlib.compressobj(wbits=-15)).compress(part) + deflate.flush()
        head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(packed) + 25)
        out.append(head + packed + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


def write_gam(reads: DataFrame, folder: str, group: int = 1_000) -> None:
    """Framed protobuf files from tasks, every other one packed; a task that runs again writes the same files again."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get().partitionId()
        for k, batch in enumerate(batches):
            rows = batch.to_pylist()
            content = encode_group([], b"OTHER") + b"".join(encode_group(rows[at : at + group]) for at in range(0, len(rows), group))
            with fs.open_output_stream(f"{base}/{task:05d}-{k:05d}.gam", compression=None) as out:
                out.write(bgzf(content) if (task + k) % 2 else content)
            yield pa.RecordBatch.from_pydict({"reads": pa.array([len(rows)], pa.int64())})

    reads.select(*ALIGNMENT_COLUMNS).mapInArrow(write, "reads long").agg({"reads": "sum"}).first()
