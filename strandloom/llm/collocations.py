"""Collocations of each language by top-order marginalisation.

A text is cut into pieces and words; each word opens a window of the ``ORDER`` words from it on, padded with 0 behind its
piece. Only these longest windows are counted; one ROLLUP over their columns then sums successively shorter prefixes, which
gives every phrase's occurrences, the words' and the language's total at once.

Most windows of a text occur once. Before they are counted, a sketch of 2 ** ``SLOT_BITS`` slots counts the occurrences of
all pairs and triples of words that fall into a slot; where a slot holds fewer than ``least``, none of its pairs or triples
can be a candidate or part of one, and windows are padded from there on. Counts of frequent phrases are exact at any
load of the sketch; a full one only pads less. Its bits, at most 32 MB, go to every task.

Words are 64-bit hashes while they are counted. The words themselves are gathered too; should two share a hash, all is counted
anew with other hashes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.llm.shingles import SLICE, mix, slices, span_hashes
from strandloom.session import materialize

ORDER = 5
SLOT_BITS, SEGMENT_BITS = 28, 16
CHUNK = 1 << 18  # bytes that are cut into words at once
HELD = 1 << 19  # words or slots that a task gathers before it folds them
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xAEF17502108EF2D9)
CHECK = 0xC2B2AE3D27D4EB4F

SPACES, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, np.uint8)
_KIND[list(SPACES)], _KIND[list(BREAKS)] = 1, 2
_GAP = re.compile(rb"[ \t.,;:!?\n-\r]")
_AHEAD = re.compile(rb"(?:[ \t]*[^ \t.,;:!?\n-\r]+){0,%d}" % (ORDER - 1))

COLUMNS = [f"w{i}" for i in range(1, ORDER + 1)]
WINDOWS = "lang string, " + ", ".join(f"{c} long" for c in COLUMNS) + ", n long, word string"


class _Words:
    """The words of one chunk: hash, piece and language of each, of which the first ``own`` open windows here."""

    def __init__(self, data: bytes, own_bytes: int, begins: np.ndarray, langs: np.ndarray, base: int):
        self.bytes, codes = data, np.frombuffer(data, np.uint8)
        kind = _KIND[codes]
        word = np.concatenate([[False], kind == 0, [False]])
        edges = np.flatnonzero(word[1:] != word[:-1])
        self.first, self.after = edges[::2], edges[1::2]
        self.codes, self.hash = codes, span_hashes(codes, self.first, self.after, base)
        piece = np.cumsum(kind == 2)[self.first]
        self.lang = langs[np.searchsorted(begins, self.first, "right") - 1]
        self.own = int(np.searchsorted(self.first, own_bytes))
        self.same = piece[1:] == piece[:-1]

    def distinct(self) -> Iterator[tuple[int, int, bytes]]:
        """(pair of hashes, hash, word) of the own words that differ in either of two hashes."""
        hashes = self.hash[: self.own]
        pairs = mix(span_hashes(self.codes, self.first[: self.own], self.after[: self.own], CHECK)) + hashes
        pairs, at = np.unique(pairs, return_index=True)
        for pair, h, a, b in zip(pairs.tolist(), hashes[at].tolist(), self.first[at].tolist(), self.after[at].tolist(), strict=True):
            yield pair, h, self.bytes[a:b]

    def slots(self, salts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sketch's slots of the pairs and of the triples of words that begin at each word."""
        h = self.hash
        pairs = mix(h[:-1] * np.uint64(BASES[1]) + h[1:] + salts[self.lang[:-1]])
        triples = mix(pairs[:-1] * np.uint64(BASES[2]) + h[2:])
        return tuple((x >> np.uint64(64 - SLOT_BITS)).astype(np.uint32) for x in (pairs, triples))


def _chunks(data: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(bytes, number of own bytes, place) of the chunks of ``data``: each also holds the words that its last windows reach."""
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + CHUNK)
        end = gap.end() if gap else len(data)
        yield data[at : _AHEAD.match(data, end).end()], end - at, at
        at = end


def _words(batches: Iterator[pa.RecordBatch], codes: dict[str, int], base: int) -> Iterator[_Words]:
    """Words of all texts (lang, body); ``codes`` numbers the languages as they come."""
    for batch in batches:
        for part in slices(batch, "body"):
            texts = part.column("body").to_pylist()
            langs = np.array([codes.setdefault(x, len(codes)) for x in part.column("lang").to_pylist()], np.int64)
            begins = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
            for data, own, at in _chunks(b"\n".join(texts).lower()):
                words = _Words(data, own, begins - at, langs, base)
                if words.own:
                    yield words


def _salts(codes: dict[str, int]) -> np.ndarray:
    return mix(np.array([zlib.crc32(x.encode()) + 1 for x in codes], np.uint64))


def _folded(slots: np.ndarray, least: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(segment, places, counts) of sorted slots; counts stop at ``least``."""
    new = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]]))
    counts = np.minimum(np.diff(np.append(new, len(slots))), least).astype(np.uint16)
    slots = slots[new]
    segments, places = slots >> np.uint32(SEGMENT_BITS), (slots & np.uint32((1 << SEGMENT_BITS) - 1)).astype(np.uint16)
    bounds = np.append(np.flatnonzero(np.concatenate([[True], segments[1:] != segments[:-1]])), len(slots))
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield int(segments[lo]), places[lo:hi].tobytes(), counts[lo:hi].tobytes()


def _frequent_slots(docs: DataFrame, least: int, base: int) -> bytes:
    """The sketch's bits, packed: set where a slot's pairs and triples occur ``least`` times at least."""
    schema = pa.schema([("segment", pa.int32()), ("places", pa.binary()), ("counts", pa.binary())])
    top = min(least, 60_000)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[str, int] = {}
        held: list[np.ndarray] = []
        for words in _words(batches, codes, base):
            pairs, triples = words.slots(_salts(codes))
            same = words.same.copy()
            held += [pairs[: words.own][same[: words.own]], triples[: words.own][(same[:-1] & same[1:])[: words.own]]]
            if sum(map(len, held)) >= HELD:
                yield from packed(held)
                held = []
        yield from packed(held)

    def packed(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        slots = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint32)
        if len(slots):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*_folded(slots, top), strict=True), schema.types, strict=True)], schema=schema)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, sums = None, np.zeros(1 << SEGMENT_BITS, np.int64)

        def told() -> Iterator[pa.RecordBatch]:
            if segment is not None and (sums >= top).any():
                yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([zlib.compress(np.packbits(sums >= top).tobytes(), 1)])], names=["segment", "bits"])

        for batch in batches:
            for number, places, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if number != segment:
                    yield from told()
                    segment = number
                    sums[:] = 0
                sums[np.frombuffer(places, np.uint16)] += np.frombuffer(counts, np.uint16)
        yield from told()

    parts = docs.mapInArrow(sketch, "segment int, places binary, counts binary").repartition("segment").sortWithinPartitions("segment")
    bits = np.zeros((1 << SLOT_BITS - SEGMENT_BITS, 1 << SEGMENT_BITS - 3), np.uint8)
    for row in parts.mapInArrow(total, "segment int, bits binary").collect():
        bits[row["segment"]] = np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
    return zlib.compress(bits.tobytes(), 1)


def _windows(docs: DataFrame, bits: bytes, base: int) -> DataFrame:
    """Padded longest windows (lang, w1 to w5, n) as each task has counted them, and its words (lang, w1, word) with n null."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)
    schema = pa.schema([("lang", pa.string()), *((c, pa.int64()) for c in COLUMNS), ("n", pa.int64()), ("word", pa.string())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.frombuffer(zlib.decompress(sent.value), np.uint8)
        codes: dict[str, int] = {}
        held: list[np.ndarray] = []
        texts: dict[int, tuple[int, bytes]] = {}  # by pairs of hashes, so that words that share one of them are both told
        n = 0
        for words in _words(batches, codes, base):
            held.append(opened(words, often, _salts(codes)))
            texts |= {pair: (h, word) for pair, h, word in words.distinct() if pair not in texts}
            n += words.own
            if n >= HELD:
                yield from folded(held, [*codes])
                yield from told([*texts.values()])
                held, texts, n = [], {}, 0
        if held:
            yield from folded(held, [*codes])
            yield from told([*texts.values()])

    def opened(words: _Words, often: np.ndarray, salts: np.ndarray) -> np.ndarray:
        """[1 + ORDER, own]: language and windows of the own words."""
        def known(slots: np.ndarray) -> np.ndarray:
            return (often[slots >> np.uint32(3)] >> (np.uint32(7) - (slots & np.uint32(7))).astype(np.uint8) & 1).astype(bool)

        pairs, triples = words.slots(salts)
        goes = words.same & known(pairs)
        far = goes[:-1] & goes[1:] & known(triples)
        out = np.zeros((1 + ORDER, words.own), np.uint64)
        out[0], out[1] = words.lang[: words.own], words.hash[: words.own]
        on = np.ones(words.own, bool)
        for k in range(1, ORDER):  # lead columns: the k-th word behind each, as long as every pair and triple on the way is frequent
            step = (goes if k == 1 else far[k - 2 :])[: words.own]
            on[len(step) :] = False
            on[: len(step)] &= step
            at = np.flatnonzero(on)
            out[1 + k, at] = words.hash[at + k]
        return out

    def folded(held: list[np.ndarray], langs: list[str]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(held, axis=1)
        key = rows[0]
        for column in rows[1:]:
            key = mix(key * np.uint64(BASES[0]) + column)
        order = np.argsort(key)
        rows = rows[:, order]
        new = np.flatnonzero(np.concatenate([[True], (rows[:, 1:] != rows[:, :-1]).any(0)]))
        counts, rows = np.diff(np.append(new, rows.shape[1])), rows[:, new]
        names = pa.array(langs, pa.string())
        for lo in range(0, len(new), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            columns = [names.take(pa.array(rows[0, part].astype(np.int64))), *(pa.array(c[part].view(np.int64)) for c in rows[1:]), pa.array(counts[part])]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(columns[0]), pa.string())], schema=schema)

    def told(texts: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        hashes, found = np.array([h for h, _ in texts], np.uint64).view(np.int64), pa.array([w for _, w in texts], pa.binary())
        size = max(1, len(texts) * SLICE // max(1, sum(len(w) for _, w in texts)))
        for lo in range(0, len(texts), size):
            own = hashes[lo : lo + size]
            none = pa.nulls(len(own), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(own), pa.string()), pa.array(own), *[none] * ORDER, found.slice(lo, size).cast(pa.string())], schema=schema)

    return docs.mapInArrow(count, WINDOWS)


def _counted(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Every phrase with ``least`` occurrences and each language's total (lang, words, f; no words: the total), and the words (w1, word)."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"))
    for base in BASES:
        windows = materialize(_windows(rows, _frequent_slots(rows, least, base), base), "windows")
        words = materialize(windows.where("word IS NOT NULL").select("w1", "word").distinct(), "words")
        shared = words.groupBy("w1").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR w1 = 0")
        if shared.isEmpty():
            break
    else:
        raise ValueError("words share their hashes under every base")
    sums = windows.where("word IS NULL").rollup("lang", *COLUMNS).agg(F.sum("n").alias("f"), F.grouping_id().alias("g")).where("g < 63")
    size = ORDER - F.bit_count("g")  # columns that the rollup has kept, without the language
    sums = sums.where((F.col("g") == 31) | (F.col("f") >= least)).select("lang", F.slice(F.array(*COLUMNS), F.lit(1), size).alias("words"), "f")
    return materialize(sums.where(~F.array_contains("words", F.lit(0).cast("long"))), "phrases"), words


def _parts(words: Column) -> Column:
    """Contiguous phrases of two words or more that are shorter than ``words``."""
    return F.flatten(F.transform(F.sequence(F.lit(2), F.size(words) - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.slice(words, i, n))))


def collocations(docs: DataFrame, least: int = 100, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to 5 words by their lowest-scoring cut.

    Defined results: null text counts as empty, null lang as ``und``; repeated rows count as often as they stand there; texts
    without words, and an empty table, give no phrases; ties end with the phrase in byte order. Only lang and text are read.
    """
    phrases, words = _counted(docs, least)
    totals = phrases.where("size(words) = 0").select("lang", F.col("f").alias("n"))
    known = phrases.where("size(words) > 0")
    candidates = known.where("size(words) > 1").withColumnRenamed("f", "a")

    longer = candidates.where("size(words) > 2").select("lang", F.explode(_parts(F.col("words"))).alias("words"), "a")
    longer = longer.groupBy("lang", "words").agg(F.max("a").alias("within"))
    kept = candidates.join(longer, ["lang", "words"], "left").where("within IS NULL OR within < a").drop("within")

    cuts = kept.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("*", F.expr("slice(words, 1, k)").alias("first"), F.expr("slice(words, k + 1, size(words) - k)").alias("rest"))
    cuts = cuts.join(known.select("lang", F.col("words").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("words").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(totals, "lang")
    whole = [F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r")]
    cuts = cuts.withColumns({"top": whole[0] * whole[1] * 1000, "bottom": whole[2] * whole[3]}).withColumn("score", F.expr("top div bottom"))
    scored = cuts.groupBy("lang", "words").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x")).select("lang", "words", "x.*").drop("k")

    by_score = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    first = materialize(scored.withColumn("place", F.rank().over(by_score)).where(F.col("place") <= top).drop("place"), "collocations")
    texts = first.select("lang", "words", F.posexplode("words").alias("at", "w1")).join(words, "w1")
    texts = texts.groupBy("lang", "words").agg(F.array_join(F.array_sort(F.collect_list(F.struct("at", "word"))).getField("word"), " ").alias("phrase"))
    by_score = by_score.orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = first.join(texts, ["lang", "words"]).withColumn("rank", F.row_number().over(by_score).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle() -> str:
    return r"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
        starts AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM lists),
        sizes AS (SELECT unnest(range(1, 6)) AS k),
        known AS (SELECT lang, k, words[i : i + k - 1] AS words, count(*) AS f FROM starts JOIN sizes ON i + k - 1 <= len(words) GROUP BY ALL),
        totals AS (SELECT lang, sum(f) AS n FROM known WHERE k = 1 GROUP BY lang),
        candidates AS (SELECT * FROM known WHERE k > 1 AND f >= 100),
        inside AS (SELECT lang, c.words[p.k : p.k + s.k - 1] AS words, max(f) AS f
                   FROM candidates c JOIN sizes s ON s.k > 1 AND s.k < c.k JOIN sizes p ON p.k + s.k - 1 <= c.k GROUP BY ALL),
        kept AS (SELECT c.* FROM candidates c LEFT JOIN inside i USING (lang, words) WHERE i.f IS NULL OR i.f < c.f),
        cuts AS (SELECT lang, c.words, s.k, c.f AS a, l.f AS l, r.f AS r, n, (1000::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f) AS score
                 FROM kept c JOIN sizes s ON s.k < c.k JOIN known l USING (lang) JOIN known r USING (lang) JOIN totals USING (lang)
                 WHERE l.words = c.words[1 : s.k] AND r.words = c.words[s.k + 1 : c.k]),
        lowest AS (SELECT *, array_to_string(words, ' ') AS phrase FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
        FROM lowest QUALIFY rank <= 2000"""
