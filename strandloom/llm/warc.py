"""WARC archives: a writer with one gzip member per record, and a splittable reader.

Writing: of records with equal payloads of at least ``REVISIT_BYTES`` the smallest id becomes a response, the
others become revisits of it. Each task writes files of its own under names of its own and returns them; only files
that a finished task has returned count, so a task that ran twice or was lost leaves nothing that is read.

Reading: archives are cut into byte ranges. A task looks in its range for the gzip magic, takes a place for a record
only if inflating there yields the headers of a WARC record, and owns the records that start inside the range,
reading on past its end to finish the last one. Records follow each other without a gap: the first must be at the
file's start, and behind each one, also the last of a range, must be another or the file's end. So a damaged member is
noticed by the task that owns it or the one before it, and raises. Payload digests are checked.

Archives are opened with pyarrow.fs, which reads local, HDFS, S3 and GCS paths.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.session import materialize, scratch_path

REVISIT_BYTES = 100
SPLIT_BYTES, FILE_BYTES, RANGES_PER_TASK = 8 << 20, 256 << 20, 8
READ_AHEAD, MAX_HEAD = 1 << 20, 1 << 16
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."

RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _one_line(value: str) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in value)


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record: WARC headers, then the block. A revisit's block has the HTTP headers without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = _record_id(page_id, digest) if refers_to is None else _record_id(page_id, f"revisit {digest}")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name}", "WARC-Date: 1970-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {_one_line(url)}"] if url is not None else []
    head += [f"Page-ID: {page_id}"] if page_id is not None else []
    head += [f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if refers_to is not None else []
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple:
    """The columns of ``RECORD``; raises if the payload doesn't have its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line[15:]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind, page = fields["WARC-Type"], fields.get("Page-ID")
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record of page {page}: the payload doesn't match its digest")
    refers = fields.get("Refers-To-Page-ID")
    return (page and int(page), fields.get("WARC-Target-URI"), size, digest, kind, refers and int(refers), payload if kind == "response" else None)


def _write(batches: Iterator[pd.DataFrame], folder: str, file_bytes: int) -> Iterator[pd.DataFrame]:
    fs, base = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    done, out = [], None
    for batch in batches:
        for row in batch.itertuples(index=False):
            if out is None:
                name, size, records = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                out = fs.open_output_stream(f"{base}/{name}", compression=None)
            page = None if pd.isna(row.page_id) else int(row.page_id)
            refers = None if pd.isna(row.refers_to) else int(row.refers_to)
            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = packer.compress(record_bytes(page, row.url, row.payload, row.digest, refers)) + packer.flush()
            out.write(member)
            size, records = size + len(member), records + 1
            if size >= file_bytes:
                out.close()
                done, out = [*done, (f"{folder}/{name}", size, records)], None
    if out is not None:
        out.close()
        done.append((f"{folder}/{name}", size, records))
    if done:
        yield pd.DataFrame(done, columns=["file", "size", "records"])


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per row; returns the manifest (file, size, records).

    Null html is an empty payload, a null url or id is left out of its record. Rows that repeat the smallest id and
    its payload are responses each. A payload whose ids are all null is a response each time.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = rows.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    # a payload with very many copies makes a skewed key on the many side only, which Spark splits
    told = rows.join(first.where("n > 1").drop("n"), "digest", "left").withColumn("refers_to", F.expr("if(first_id = page_id, null, first_id)"))
    manifest = told.select("page_id", "url", "payload", "digest", "refers_to").mapInPandas(lambda b: _write(b, folder, file_bytes), "file string, size long, records long")
    return materialize(manifest, "warc-manifest")


def _has_headers(head: bytes) -> bool:
    """Whether the decoded beginning of a member is a WARC record's, with the headers that every record has."""
    lines = head.split(b"\r\n\r\n", 1)[0].split(b"\r\n")
    fields = {name.strip().lower(): value.strip() for name, _, value in (line.partition(b":") for line in lines[1:])}
    return lines[0].startswith(VERSION) and {b"warc-type", b"warc-record-id", b"warc-date"} <= fields.keys() and fields.get(b"content-length", b"").isdigit()


def read_range(source: pa.NativeFile, start: int, end: int, ahead: int = READ_AHEAD) -> Iterator[bytes]:
    """The records that start in the bytes from ``start`` to before ``end``.

    Raises EOFError where a record is cut off, and ValueError where records don't follow each other without a gap.
    """
    source.seek(start)
    data, base, at = source.read(end - start), start, 0

    def more() -> bool:
        nonlocal data
        source.seek(base + len(data))
        data += (got := source.read(ahead))
        return bool(got)

    def member(found: int, whole: bool) -> tuple[bytes, int] | None:
        """(decoded bytes, place behind it) of the member at ``found``, or None if its headers aren't a record's."""
        inflate, parts, fed, told = zlib.decompressobj(31), [], found, False
        try:
            while not inflate.eof:
                if fed >= len(data) and not more():
                    if told:
                        raise EOFError(f"the record at {base + found} is cut off")
                    return None
                step = data[fed : fed + (65536 if told else 4096)]
                parts.append(inflate.decompress(step))
                fed += len(step)
                if not told and (inflate.eof or b"\r\n\r\n" in (head := b"".join(parts)) or len(head) > MAX_HEAD):
                    if not _has_headers(b"".join(parts)):
                        return None
                    told = True
                    if not whole:
                        break
        except zlib.error as error:
            if told:
                raise ValueError(f"the record at {base + found} is damaged: {error}") from error
            return None
        return b"".join(parts), fed - len(inflate.unused_data)

    known = start == 0  # the place of the next record is known
    while base + at < end or known:
        if at >= len(data) and not more():
            return
        if known:
            if (found := member(at, base + at < end)) is None:
                raise ValueError(f"no record at {base + at}, where one should be")
            if base + at >= end:
                return
        else:
            place = data.find(MAGIC, at)
            if place < 0:  # the magic may begin in the range and end beyond it
                if base + len(data) >= end + len(MAGIC) - 1 or not more():
                    return
                continue
            if base + place >= end:
                return
            if (found := member(place, True)) is None:
                at = place + 1
                continue
            known = True
        body, at = found
        yield body


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    for batch in batches:
        for row in batch.itertuples(index=False):
            fs, path = pyarrow.fs.FileSystem.from_uri(row.file)
            with fs.open_input_file(path) as source:
                rows: list[tuple] = []
                for data in read_range(source, row.start, row.end):
                    rows.append(parse_record(data))
                    if len(rows) == 500:
                        yield frame(rows)
                        rows = []
                if rows:
                    yield frame(rows)


def read_archives(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All records of the archives listed in ``manifest`` (file, size), read by byte ranges.

    There are as many tasks as ``RANGES_PER_TASK`` ranges each make, and one for each range of a small job.
    """
    starts = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))
    ranges = manifest.where("size > 0").select("file", "size", F.explode(starts).alias("start"))
    ranges = ranges.select("file", "start", F.least(F.col("start") + split_bytes, "size").alias("end"))
    n = manifest.select(F.sum(F.ceil(F.col("size") / split_bytes))).first()[0] or 1
    tasks = max(int(n) // RANGES_PER_TASK, min(int(n), 4 * manifest.sparkSession.sparkContext.defaultParallelism))
    return ranges.repartition(tasks, "file", "start").mapInPandas(_read, RECORD)


def archive_round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` as archives and read them back: a row per record, without the payload."""
    manifest = write_archives(pages, folder or scratch_path(spark, "warc"))
    return read_archives(manifest).drop("payload", "url")
