"""JSON records of files in any layout: an object a line, arrays, ``{"nodes": [...]}``, an object over many lines, broken ones between.

Lines come from Spark's text reader, so that files split and ``.gz`` files are read as they are. A JSON string never holds a raw
line break, so at the start of a line a scanner is outside any string, and an unclosed quote ends with its line. A record is a
balanced object that parses, has the marker key and holds no other record; whatever braces are still open around one belong to a
container or to a broken object, and no longer matter. So a broken object costs itself only.

What precedes a split's first record and what follows its last one may be halves of one record. These ends, two short texts a
split, are joined in the file's order and scanned alike.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.session import materialize

_TOKEN = re.compile(r'"(?:[^"\\\n]|\\[^\n])*(?:"|\\?$)|[{}]', re.M)


class ObjectScanner:
    """Finds records in text fed by whole lines. ``rejected`` counts marker keys that stand outside records.

    ``head`` keeps what precedes the first record, None if that isn't wanted (``keep_head``) or no record has come.
    """

    def __init__(self, marker: str, keep_head: bool = False):
        self.marker, self.key = marker, json.dumps(marker)
        self.rejected, self.head = 0, None
        self.keeps = keep_head
        self.text, self.scanned = "", 0  # text since the last record, how much of it is scanned
        self.open: list[int] = []  # where open braces stand in the text

    def feed(self, more: str) -> Iterator[str]:
        self.text += more
        done = 0
        for token in _TOKEN.finditer(self.text, self.scanned):
            if token[0] == "{":
                self.open.append(token.start())
            elif token[0] == "}" and self.open:
                start, end = self.open.pop(), token.end()
                if self._is_record(self.text[start:end]):
                    yield self.text[start:end]
                    self._drop(self.text[done:start])
                    done, self.open = end, []
        self.text, self.open = self.text[done:], [at - done for at in self.open]
        self.scanned = len(self.text)
        if not self.open and not self.keeps:
            self._drop(self.text)
            self.text, self.scanned = "", 0

    def _is_record(self, text: str) -> bool:
        if self.key not in text:
            return False
        try:
            found = json.loads(text)
        except (ValueError, RecursionError):
            return False
        return isinstance(found, dict) and self.marker in found

    def _drop(self, text: str) -> None:
        """Text before a record goes: the first is the head if that is wanted, others count."""
        if self.keeps:
            self.head, self.keeps = text, False
        else:
            self.rejected += text.count(self.key)


def _sections(batch: pa.RecordBatch) -> Iterator[tuple[str, int, str]]:
    """(file, block, text) of the runs of lines of a split."""
    n = batch.num_rows
    files, blocks = batch.column("file"), batch.column("block")
    cuts = pc.or_(pc.not_equal(files.slice(1), files.slice(0, n - 1)), pc.not_equal(blocks.slice(1), blocks.slice(0, n - 1))).to_numpy(zero_copy_only=False).nonzero()[0] if n else []
    bounds = [0, *(int(c) + 1 for c in cuts), n]
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if lo < hi:
            yield files[lo].as_py(), blocks[lo].as_py(), "\n".join(batch.column("value").slice(lo, hi - lo).to_pylist()) + "\n"


_FOUND = pa.schema([("file", pa.string()), ("block", pa.int64()), ("part", pa.int32()), ("text", pa.string()), ("rejected", pa.int64())])
_RECORD, _HEAD, _WHOLE, _TAIL = range(4)
_ROWS = 4_096


def _told(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FOUND, strict=True)], schema=_FOUND)


def _scan(marker: str, batches: Iterator[pa.RecordBatch], splits: bool) -> Iterator[pa.RecordBatch]:
    """Rows of _FOUND. ``splits``: texts are parts of splits, whose ends are told too; else each text is one by itself."""
    rows: list[tuple] = []
    at, scanner = None, None

    def ended() -> Iterator[tuple]:
        if scanner is not None:
            file, block = at
            left = scanner.text
            if splits:
                ends = [(_WHOLE, left)] if scanner.keeps else [(_HEAD, scanner.head)] * (scanner.head is not None) + [(_TAIL, left)]
                yield from ((file, block, part, text, 0) for part, text in ends)
            else:
                scanner._drop(left)
            if scanner.rejected:
                yield file, block, _RECORD, None, scanner.rejected

    for batch in batches:
        for file, block, text in _sections(batch):
            if (file, block) != at:
                rows += ended()
                at, scanner = (file, block), ObjectScanner(marker, splits and block > 0)
            for record in scanner.feed(text):
                rows.append((file, block, _RECORD, record, 0))
            if len(rows) >= _ROWS:
                yield _told(rows)
                rows = []
    rows += ended()
    if rows:
        yield _told(rows)


def json_objects(spark: SparkSession, path: str | list[str], marker: str) -> DataFrame:
    """(file, text, rejected): each record's text with rejected 0, and rows without text that count rejected ones."""
    meta = F.col("_metadata")
    lines = spark.read.text(path).select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("block"))
    kind = "file string, block long, part int, text string, rejected long"
    found = materialize(lines.mapInArrow(lambda batches: _scan(marker, batches, True), kind), "json-objects")
    ends = found.where(f"part <> {_RECORD}")
    along = Window.partitionBy("file").orderBy("block", "part")
    seams = ends.withColumn("seam", F.count_if(F.col("part") == _TAIL).over(along)).groupBy("file", "seam")
    joined = seams.agg(F.array_join(F.array_sort(F.collect_list(F.struct("block", "part", "text"))).getField("text"), "").alias("value"))
    joined = joined.select("value", "file", F.col("seam").alias("block"))
    between = joined.mapInArrow(lambda batches: _scan(marker, batches, False), kind)
    return found.where(f"part = {_RECORD}").unionByName(between).select("file", "text", "rejected")


def json_rows(spark: SparkSession, schema: str, path: str | list[str], marker: str) -> DataFrame:
    """Records of JSON files in any layout as columns of ``schema``; a value of another type is null, broken objects are skipped."""
    found = json_objects(spark, path, marker).where("text IS NOT NULL")
    return found.select(F.from_json("text", schema).alias("r")).select("r.*")


def rejected_objects(spark: SparkSession, path: str | list[str], marker: str) -> DataFrame:
    """(file, records, rejected): how many records a file has, and how many objects have the marker and aren't whole."""
    return json_objects(spark, path, marker).groupBy("file").agg(F.count("text").alias("records"), F.sum("rejected").alias("rejected"))
