"""Alignment sources: framed protobuf groups, JSON lines, several files, and SAM text."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Collection, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDIT = "struct<from_length: int, to_length: int, sequence: string>"
POSITION = "struct<node_id: long, offset: long, is_reverse: boolean>"
MAPPING = f"struct<position: {POSITION}, edit: array<{EDIT}>, rank: long>"
ALIGNMENT = f"name string, sequence string, quality binary, mapping_quality int, identity double, refpos array<struct<name: string, offset: long, is_reverse: boolean>>, path struct<mapping: array<{MAPPING}>>"


def read_gam_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One alignment JSON per line, ``quality`` in base64; absent lists are empty, absent numbers 0."""
    rows = spark.read.schema(ALIGNMENT.replace("quality binary", "quality string")).json(path)
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    edits = lambda m: F.transform(empty(m["edit"], f"array<{EDIT}>"), lambda e: F.struct(F.coalesce(e["from_length"], F.lit(0)).alias("from_length"), F.coalesce(e["to_length"], F.lit(0)).alias("to_length"), F.coalesce(e["sequence"], F.lit("")).alias("sequence")))
    place = lambda m: F.struct(F.coalesce(m["position"]["node_id"], F.lit(0)).cast("long").alias("node_id"), F.coalesce(m["position"]["offset"], F.lit(0)).cast("long").alias("offset"), F.coalesce(m["position"]["is_reverse"], F.lit(False)).alias("is_reverse"))
    mappings = F.transform(empty(F.col("path.mapping"), f"array<{MAPPING}>"), lambda m: F.struct(place(m).alias("position"), edits(m).alias("edit"), m["rank"].alias("rank")))
    return rows.select("name", "sequence", F.unbase64("quality").alias("quality"), F.coalesce("mapping_quality", F.lit(0)).alias("mapping_quality"), F.coalesce("identity", F.lit(0.0)).alias("identity"), empty(F.col("refpos"), "array<struct<name: string, offset: long, is_reverse: boolean>>").alias("refpos"), F.struct(mappings.alias("mapping")).alias("path"))


def write_gam_json(reads: DataFrame, path: str) -> None:
    reads.withColumn("quality", F.base64("quality")).write.json(path)


def read_gam_many(spark: SparkSession, files: list[str], list_text: str = "") -> DataFrame:
    """JSON alignments of several files and of a list (a path a line, ``#`` comments); a path counts once, in first-seen order."""
    listed = [x.strip() for x in list_text.splitlines() if x.strip() and not x.strip().startswith("#")]
    paths = list(dict.fromkeys([*files, *listed]))
    out = None
    for file_no, path in enumerate(paths):
        rows = read_gam_json(spark, path).withColumn("file_no", F.lit(file_no))
        out = rows if out is None else out.unionByName(rows)
    return out


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """qname, flag, rname, pos, mapq, cigar, seq, tags, nm of SAM lines with at least 11 fields."""
    f = spark.read.text(path).where("NOT startswith(value, '@')").select(F.split("value", "\t").alias("f")).where("size(f) >= 11")
    tags = F.slice("f", 12, F.greatest(F.size("f") - 11, F.lit(0)))
    nm = F.get(F.filter(tags, lambda x: x.startswith("NM:i:")), F.lit(0))
    at = lambda k: F.get("f", k)
    return f.select(at(0).alias("qname"), at(1).try_cast("int").alias("flag"), at(2).alias("rname"), at(3).try_cast("long").alias("pos"), at(4).try_cast("int").alias("mapq"), at(5).alias("cigar"), at(9).alias("seq"), tags.alias("tags"), F.substring(nm, 6, 20).try_cast("int").alias("nm"))


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at += 1
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one protobuf message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        yield key >> 3, value


def _signed(value: int, bits: int = 64) -> int:
    return value - (1 << bits) if value >> (bits - 1) else value


ALIGNMENT_COLUMNS = ("name", "sequence", "quality", "mapping_quality", "identity", "refpos", "path")
# Field numbers of the public alignment schema.
_ALIGNMENT = {"sequence": 1, "path": 2, "name": 3, "quality": 4, "mapping_quality": 5, "identity": 16, "refpos": 20}


def _position(data: bytes) -> dict:
    out = {"node_id": 0, "offset": 0, "is_reverse": False, "name": ""}
    for number, value in _fields(data):
        if number in (1, 2):
            out["node_id" if number == 1 else "offset"] = _signed(value)
        elif number == 4:
            out["is_reverse"] = bool(value)
        elif number == 5:
            out["name"] = value.decode()
    return out


def decode_alignment(data: bytes, columns: Collection[str] = tuple(_ALIGNMENT)) -> dict:
    """The wanted columns of one alignment; other fields are stepped over undecoded."""
    empty = {"name": "", "sequence": "", "quality": b"", "mapping_quality": 0, "identity": 0.0}
    row = {c: {"mapping": []} if c == "path" else [] if c == "refpos" else empty[c] for c in columns}
    names = {_ALIGNMENT[c]: c for c in columns}
    for number, value in _fields(data):
        name = names.get(number)
        if name in ("name", "sequence"):
            row[name] = value.decode()
        elif name == "quality":
            row[name] = value
        elif name == "mapping_quality":
            row[name] = _signed(value)
        elif name == "identity":
            row[name] = struct.unpack("<d", value)[0]
        elif name == "refpos":
            p = _position(value)
            row["refpos"].append({k: p[k] for k in ("name", "offset", "is_reverse")})
        elif name == "path":
            for field, mapping in _fields(value):
                if field == 2:
                    row["path"]["mapping"].append(_mapping(mapping))
    return row


def _mapping(data: bytes) -> dict:
    out = {"position": {"node_id": 0, "offset": 0, "is_reverse": False}, "edit": [], "rank": 0}
    for number, value in _fields(data):
        if number == 1:
            p = _position(value)
            out["position"] = {k: p[k] for k in ("node_id", "offset", "is_reverse")}
        elif number == 2:
            edit = {"from_length": 0, "to_length": 0, "sequence": ""}
            for k, v in _fields(value):
                if k in (1, 2):
                    edit["from_length" if k == 1 else "to_length"] = _signed(v)
                elif k == 3:
                    edit["sequence"] = v.decode()
            out["edit"].append(edit)
        elif number == 5:
            out["rank"] = _signed(value)
    return out


def _is_message(data: bytes) -> bool:
    """Whether ``data`` is made of whole protobuf fields."""
    at, end = 0, len(data)
    try:
        while at < end:
            key, at = _varint(data, at)
            kind = key & 7
            if not key >> 3 or kind not in (0, 1, 2, 5):
                return False
            if kind == 0:
                _, at = _varint(data, at)
            else:
                n, at = _varint(data, at) if kind == 2 else (8 if kind == 1 else 4, at)
                at += n
    except IndexError:
        return False
    return at == end


TAG = b"\x03GAM"
PIECE = 1 << 18
SPLIT = 64 << 20


def _bgzf_size(header: bytes) -> int:
    """Bytes of the BGZF block that ``header`` begins, 0 if it begins none."""
    if len(header) < 18 or header[:4] != b"\x1f\x8b\x08\x04":
        return 0
    at, end = 12, 12 + int.from_bytes(header[10:12], "little")
    while at + 6 <= min(end, len(header)):
        size = int.from_bytes(header[at + 2 : at + 4], "little")
        if header[at : at + 4] == b"BC\x02\x00":
            return int.from_bytes(header[at + 4 : at + 6], "little") + 1
        at += 4 + size
    return 0


def _bgzf_pieces(file: pa.NativeFile, size: int, lo: int) -> Iterator[tuple[int, bytes]]:
    """(place in the file, content) of the BGZF blocks from the first that begins at or behind ``lo``."""
    held, at = b"", lo

    def need(n: int) -> None:
        nonlocal held
        if len(held) < n and at + len(held) < size:
            file.seek(at + len(held))
            held += file.read(max(n - len(held), PIECE))

    while lo and at < size:  # a block is one that ends at another or at the file's end
        need(2 * PIECE)
        found = held.find(b"\x1f\x8b\x08\x04")
        if found >= 0 and (n := _bgzf_size(held[found : found + 64])):
            held, at = held[found:], at + found
            need(n + 64)
            if at + n == size or _bgzf_size(held[n : n + 64]):
                break
            found = 0
        drop = found + 1 if found >= 0 else max(1, len(held) - 3)
        held, at = held[drop:], at + drop
    while at < size:
        need(64)
        n = _bgzf_size(held[:64])
        if not n:
            raise ValueError(f"no BGZF block at byte {at}")
        need(n)
        yield at, zlib.decompress(held[:n], 31)
        held, at = held[n:], at + n


def _pieces(file: pa.NativeFile, size: int, lo: int) -> Iterator[tuple[int, bytes]]:
    """Content in order, each piece with its place in the file; nothing if another range owns all of the file."""
    head = file.read(64) if size else b""
    if head[:2] != b"\x1f\x8b":
        for at in range(lo, size, PIECE):
            file.seek(at)
            yield at, file.read(min(PIECE, size - at))
    elif _bgzf_size(head):
        yield from _bgzf_pieces(file, size, lo)
    elif lo == 0:  # plain gzip has no places to begin at: its first range reads all of it
        file.seek(0)
        unpacked = zlib.decompressobj(31)
        while part := unpacked.unconsumed_tail or unpacked.unused_data or file.read(PIECE):
            if unpacked.eof:
                unpacked = zlib.decompressobj(31)
            yield 0, unpacked.decompress(part, 16 * PIECE)
        while not unpacked.eof and (part := unpacked.decompress(b"", 16 * PIECE)):
            yield 0, part


class _Frames:
    """Groups of framed messages in content that comes piece by piece."""

    def __init__(self, pieces: Iterator[tuple[int, bytes]], exact: bool):
        self.pieces, self.exact = pieces, exact
        self.data, self.base, self.ended = bytearray(), 0, False
        self.marks: list[tuple[int, int]] = []  # where a piece begins in the content, and in the file

    def more(self) -> bool:
        place, piece = next(self.pieces, (0, None))
        if piece is None:
            self.ended = True
            return False
        self.marks.append((self.base + len(self.data), place))
        self.data += piece
        return True

    def place(self, at: int) -> int:
        """The file's place of a byte: its own in plain files, its block's in packed ones."""
        begin, place = next(m for m in reversed(self.marks) if m[0] <= at)
        return place + (at - begin if self.exact else 0)

    def forget(self, at: int) -> None:
        if at - self.base > PIECE:
            del self.data[: at - self.base]
            self.base = at
            while len(self.marks) > 1 and self.marks[1][0] <= at:
                self.marks.pop(0)

    def has(self, end: int) -> bool:
        while self.base + len(self.data) < end:
            if not self.more():
                return False
        return True

    def varint(self, at: int) -> tuple[int, int]:
        """(value, end); raises EOFError where the content ends."""
        value = shift = 0
        while self.has(at + 1) and shift < 64:
            byte = self.data[at - self.base]
            value |= (byte & 127) << shift
            at += 1
            if byte < 128:
                return value, at
            shift += 7
        raise EOFError

    def piece(self, at: int) -> tuple[int, int]:
        """(begin, end) of the length-prefixed piece at ``at``."""
        n, begin = self.varint(at)
        if n > 1 << 30 or not self.has(begin + n):
            raise EOFError
        return begin, begin + n

    def is_group(self, at: int, others: int = 8) -> bool:
        """Whether a ``GAM`` group begins at ``at``: its first pieces are messages, and all of them are whole and lead to the content's
        end or to the next one, over some groups of other kinds at most."""
        if not self.has(at + 1):
            return True
        try:
            count, at = self.varint(at)
            begin, at = self.piece(at)
            tag = bytes(self.data[begin - self.base : at - self.base])
            if tag == TAG[1:] and others < 8:
                return True
            if count < 1 or len(tag) > 32 or not tag.isalnum() or not others:
                return False
            for k in range(count - 1):
                begin, at = self.piece(at)
                if k < 8 and tag == TAG[1:] and not _is_message(bytes(self.data[begin - self.base : at - self.base])):
                    return False
        except EOFError:
            return False
        return self.is_group(at, others - 1)

    def first_group(self, hi: int) -> int | None:
        """Where the first ``GAM`` group begins that can be told, if before ``hi``."""
        at = 0
        while self.has(at + len(TAG) + 1):
            found = self.data.find(TAG, at - self.base)
            if found < 0:
                at = max(at, self.base + len(self.data) - len(TAG) + 1)
                if self.place(min(at, self.base + len(self.data) - 1)) >= hi or not self.more():
                    return None
                self.forget(at - 16)
                continue
            found += self.base
            for width in (5, 4, 3, 2, 1):
                begin = found - width
                if begin >= self.base:
                    count = self.data[begin - self.base : found - self.base]
                    if count[-1] < 128 and all(b >= 128 for b in count[:-1]) and (width == 1 or count[-1]) and self.is_group(begin):
                        return begin
            at = found + 1
        return None

    def messages(self, lo: int, hi: int) -> Iterator[bytes]:
        """Messages of the ``GAM`` groups that begin in the file's range from ``lo`` to before ``hi``."""
        at = 0 if lo == 0 else self.first_group(hi)
        while at is not None and self.has(at + 1) and self.place(at) < hi:
            try:
                count, at = self.varint(at)
                tag = None
                for k in range(count):
                    begin, at = self.piece(at)
                    piece = bytes(self.data[begin - self.base : at - self.base])
                    if k == 0:
                        tag = piece
                    elif tag == TAG[1:]:
                        yield piece
                    self.forget(at)
            except EOFError:
                raise ValueError("the file ends within a group") from None


def range_messages(path: str, size: int, lo: int, hi: int) -> Iterator[bytes]:
    """Messages that the range from ``lo`` to before ``hi`` of a file owns, in bounded memory."""
    local = path.startswith("file:")
    fs, name = (pyarrow.fs.LocalFileSystem(), re.sub("^file:/+", "/", path)) if local else pyarrow.fs.FileSystem.from_uri(path)
    with fs.open_input_file(name) as file:
        exact = file.read(2) != b"\x1f\x8b"
        file.seek(0)
        yield from _Frames(_pieces(file, size, lo), exact).messages(lo, hi)


def read_gam(spark: SparkSession, path: str | list[str], columns: Collection[str] = tuple(_ALIGNMENT), split: int = SPLIT) -> DataFrame:
    """Alignments of framed protobuf files, plain or packed, with the given columns; a task reads a range of ``split`` bytes.

    A group belongs to the range in which it begins, in packed (BGZF) files the range in which its block begins; a range finds its first
    group by frames that lead to further ones. Plain gzip is read by one task, piece by piece. Paths need a file system that
    ``pyarrow.fs`` opens; a file that ends within a group is an error.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = [c for c in ALIGNMENT_COLUMNS if c in columns]
    schema = spark.createDataFrame([], ALIGNMENT).select(*wanted).schema
    arrow = to_arrow_schema(schema)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                rows: list[dict] = []
                for message in range_messages(part["path"], part["length"], part["lo"], part["lo"] + split):
                    rows.append(decode_alignment(message, wanted))
                    if len(rows) == 2_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length").where("length > 0")
    ranges = files.select("path", "length", F.explode(F.expr(f"sequence(0L, length - 1, {split}L)")).alias("lo"))
    # a number of partitions is given: adaptive execution would put all these small rows into one task
    size, tasks = files.agg(F.sum("length"), F.sum(F.expr(f"(length - 1) div {split} + 1"))).first()
    tasks = min(tasks or 1, max(4 * spark.sparkContext.defaultParallelism, (size or 0) // SPLIT))
    return ranges.repartition(tasks).mapInArrow(decode, schema)
