"""Best-fit packing of token sequences by the sum-of-squares rule.

A document is its ids and then the end id. Documents longer than ``CAPACITY`` are cut into pieces of that length;
the last may be shorter. Pieces are dealt by a hash into groups of about ``GROUP`` and each group is packed by one
task: longest first, each piece goes where the sum over gaps of (open sequences with that gap) squared becomes
smallest. Once a group has opened as many sequences as its tokens need at least, it opens another one only for a
piece that fits nowhere. A group fills all but a few of its sequences, so dealing costs next to nothing.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandloom.llm.shingles import SLICE, slices, span_hashes
from strandloom.session import materialize

CAPACITY, END_ID, GROUP = 4096, 1, 16_384
#: how many parts of words a Python worker remembers, of at most so many ids each
SLOTS, SLOT_IDS = 1 << 19, 8
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


CLOSE = "\x00"
_WHITE, _LETTER, _FIGURE, _SIGN, _OTHER = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
for _kind, _members in ((_SIGN, range(33, 127)), (_LETTER, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"), (_FIGURE, b"0123456789"), (_WHITE, b" \t\n\v\f\r"), (_LETTER, range(0xC3, 0xCA))):
    _CLASS[list(_members)] = _kind


@functools.lru_cache(maxsize=2)
def rank_table(path: str) -> tuple[list[bytes], np.ndarray]:
    """(tokens in the order in which they merge, their ids) of a word-level BPE, as ranks over bytes.

    ``CLOSE`` stands for the end-of-word mark; only tokens that their own merge builds are in, so both ways of merging
    agree. Takes seconds, so the driver makes it once and sends it along (its size is that of the vocabulary).
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, specials = spec["model"], {t["content"] for t in spec["added_tokens"]}
    mark, close = model["end_of_word_suffix"], CLOSE.encode()
    shown = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}

    def raw(token: str) -> bytes:
        ended = token.endswith(mark)
        return bytes(byte_of[c] for c in (token[: -len(mark)] if ended else token)) + close * ended

    vocab = model["vocab"]
    # a byte and the mark join first, as the tokenizer starts from letters that already bear it
    ranks, ids = {}, []
    for token, i in vocab.items():
        if (len(token) == 1 or token.endswith(mark) and len(token) == 1 + len(mark)) and token not in specials:
            if raw(token).endswith(close) and len(raw(token)) == 2:
                ranks[raw(token)] = len(ids)
                ids.append(i)
    for merge in model["merges"]:
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        joined = raw(a + b)
        if _builds(joined, raw(a), raw(b), ranks):
            ranks[joined] = len(ids)
            ids.append(vocab[a + b])
    for token, i in vocab.items():
        if len(token) == 1:
            ranks[raw(token)] = len(ids)
            ids.append(i)
    for b in range(256):
        if bytes([b]) not in ranks:
            ranks[bytes([b])] = len(ids)
            ids.append(vocab.get("", 0))
    return list(ranks), np.array([ids[r] for r in ranks.values()], "<u4")


def _builds(joined: bytes, a: bytes, b: bytes, ranks: dict[bytes, int]) -> bool:
    """Whether merging ``joined`` by the earlier ranks stops at exactly the two parts."""
    state = [joined[i : i + 1] for i in range(len(joined))]
    while len(state) > 1:
        found = min(((ranks[x + y], k) for k, (x, y) in enumerate(zip(state, state[1:], strict=False)) if x + y in ranks), default=None)
        if found is None:
            break
        k = found[1]
        state[k : k + 2] = [state[k] + state[k + 1]]
    return state == [a, b]


def parts_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte after, whether to be split further) of the parts of ``data``, UTF-8 that begins and ends with white space.

    Parts are contractions, runs of Latin letters, single figures and runs of plain signs. A run free of white space that
    has anything else in it, or could hold a special token, is one part that has to be split further.
    """
    kind, before = _CLASS[data], np.concatenate([data[:1], data[:-1]])
    # of the letters of two bytes, U+00C0 to U+024F count, but for the signs of multiplication and division and the dotted I
    second = (data & 0xC0 == 0x80) & (before >= 0xC3) & (before <= 0xC9)
    kind[second] = _LETTER
    odd = second & ((before == 0xC3) & ((data == 0x97) | (data == 0xB7)) | (before == 0xC4) & (data == 0xB0) | (before == 0xC9) & (data > 0x8F))
    kind[odd] = _OTHER
    kind[(data == ord("|")) & (before == ord("<"))] = _OTHER
    past = np.concatenate([kind[:1], kind[:-1]])
    white = kind == _WHITE
    starts = ~white & ((kind != past) | (kind == _FIGURE))
    quote = np.flatnonzero((data == ord("'")) & (past != _SIGN))
    next_two = [data[np.minimum(quote + k, len(data) - 1)] | 32 for k in (1, 2)]
    short = np.isin(next_two[0], np.frombuffer(b"stmd", np.uint8)) & (kind[np.minimum(quote + 1, len(data) - 1)] == _LETTER)
    pair = next_two[0].astype(np.int64) << 8 | next_two[1]
    long = np.isin(pair, [int.from_bytes(p) for p in (b"re", b"ve", b"ll")]) & (kind[np.minimum(quote + 2, len(data) - 1)] == _LETTER) & (kind[np.minimum(quote + 1, len(data) - 1)] == _LETTER)
    for found, length in ((quote[short], 2), (quote[long], 3)):
        starts[found + 1] = False
        starts[found + length] = ~white[found + length]
    # runs with other characters in them
    edges = np.flatnonzero(white[1:] != white[:-1]) + 1
    run, run_end = edges[::2], edges[1::2]
    others = np.concatenate([[0], np.cumsum(kind == _OTHER)])
    whole = others[run_end] > others[run]
    inside = np.zeros(len(data) + 1, np.int8)
    inside[run[whole]] = 1
    inside[run_end[whole]] = -1
    starts &= ~np.cumsum(inside[:-1], dtype=np.int8).view(bool)
    starts[run[whole]] = True
    further = np.zeros(len(data), bool)
    further[run[whole]] = True
    ends = np.flatnonzero(starts | white & (past != _WHITE))
    ends = np.append(ends, len(data))
    first = np.flatnonzero(starts)
    return first, ends[np.searchsorted(ends, first) + 1], further[first]


class WordEncoder:
    """Ids of text under a word-level BPE whose splits never cross white space: each distinct part of a slice once.

    Parts of Latin letters, figures and plain signs go through the rank table, all others through the tokenizer itself.
    Parts are told apart by two 64-bit hashes. The ids of up to ``SLOTS`` parts are remembered, a new one in the place of the
    one that has its slot; what is remembered has no influence on ids.
    """

    PLAIN = re.compile("[!-~\u00a1-\u012f\u0131-\u024f]+")
    WHITE = re.compile(rb"[\x20\x09-\x0D]")

    def __init__(self, path: str, table: tuple[list[bytes], np.ndarray]) -> None:
        self.path = path
        tokens, self.id_of = table
        self.closes = np.array([t.endswith(CLOSE.encode()) for t in tokens])
        self.table = tiktoken.Encoding("words", pat_str=f"[^{CLOSE}]*{CLOSE}", mergeable_ranks={t: r for r, t in enumerate(tokens)}, special_tokens={})
        self.keys, self.sizes, self.ids = np.zeros((2, SLOTS), np.uint64), np.zeros(SLOTS, np.int64), np.zeros((SLOTS, SLOT_IDS), "<u4")

    @functools.cached_property
    def whole(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    @functools.cached_property
    def pattern(self) -> regex.Pattern:
        with open(self.path, encoding="utf-8") as f:
            return regex.compile(json.load(f)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])

    def _through_table(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts, how many each has)"""
        if not parts:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        ranks = self.table.encode_to_numpy(CLOSE.join(parts).lower() + CLOSE, disallowed_special=())
        return self.id_of[ranks], np.diff(np.flatnonzero(self.closes[ranks]) + 1, prepend=0)

    def _split(self, run: str) -> np.ndarray:
        """Ids of a run that has to be split further."""
        if self.PLAIN.fullmatch(run) and "<|" not in run:
            return self._through_table(self.pattern.findall(run.lower()))[0]
        return np.array(self.whole.encode(run, add_special_tokens=False).ids, "<u4")

    def learn(self, data: bytes, first: np.ndarray, after: np.ndarray, further: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all these parts, how many each has)"""
        part = [data[a:b].decode() for a, b in zip(first.tolist(), after.tolist(), strict=True)]
        flat, sizes = self._through_table([p for p, split in zip(part, further, strict=True) if not split])
        if not further.any():
            return flat, sizes
        own = iter(np.split(flat, np.cumsum(sizes)[:-1]))
        ids = [self._split(p) if split else next(own) for p, split in zip(part, further, strict=True)]
        return np.concatenate(ids), np.array([len(i) for i in ids], np.int64)

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, little-endian unsigned 32-bit."""
        raw = b" ".join([b"", *texts, b""])
        data = np.frombuffer(raw, np.uint8)
        first, after, further = parts_of(data)
        keys = np.stack([span_hashes(data, first, after, base) for base in BASES]) if len(first) else np.zeros((2, 0), np.uint64)
        names, one, which = np.unique(keys[0], return_index=True, return_inverse=True)
        if (keys[1][one][which] != keys[1]).any():  # equal first hashes of different parts
            names, one, which = np.arange(len(first)), np.arange(len(first)), np.arange(len(first))
        keys, slot = keys[:, one], (keys[0][one] & np.uint64(SLOTS - 1)).astype(np.int64)
        known = (self.keys[:, slot] == keys).all(0)
        sizes, begin = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        old, new = np.flatnonzero(known), np.flatnonzero(~known)
        sizes[old], begin[old] = self.sizes[slot[old]], np.arange(len(old)) * SLOT_IDS
        flat, sizes[new] = self.learn(raw, first[one[new]], after[one[new]], further[one[new]])
        begin[new] = len(old) * SLOT_IDS + np.cumsum(sizes[new]) - sizes[new]
        pool = np.concatenate([self.ids[slot[old]].ravel(), flat])
        self._remember(keys[:, new], slot[new], sizes[new], begin[new], pool)

        size = sizes[which]
        ends = np.cumsum(size)
        ids = pool[np.repeat(begin[which] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        owner = np.searchsorted(first, np.cumsum([1, *(len(t) + 1 for t in texts)]))
        at = np.concatenate([[0], ends])[owner]
        return [ids[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def _remember(self, keys: np.ndarray, slot: np.ndarray, sizes: np.ndarray, begin: np.ndarray, pool: np.ndarray) -> None:
        _, last = np.unique(slot[::-1], return_index=True)
        mine = len(slot) - 1 - last
        mine = mine[sizes[mine] <= SLOT_IDS]
        slot = slot[mine]
        self.keys[:, slot], self.sizes[slot] = keys[:, mine], sizes[mine]
        reach = begin[mine][:, None] + np.arange(SLOT_IDS)
        self.ids[slot] = np.append(pool, np.zeros(SLOT_IDS, "<u4"))[np.minimum(reach, len(pool))]

    def encode(self, text: bytes) -> Iterator[bytes]:
        """Ids of one text of any length, in pieces cut at white space."""
        at = 0
        while at < len(text):
            gap = self.WHITE.search(text, at + SLICE)
            end = gap.end() if gap else len(text)
            yield self.encode_all([text[at:end]])[0]
            at = end


_coders: dict[str, WordEncoder] = {}


def word_encoder(path: str, table: tuple[list[bytes], np.ndarray] | None = None) -> WordEncoder:
    """The one encoder of a Python worker: what it remembers serves the worker's later tasks too."""
    if path not in _coders:
        _coders[path] = WordEncoder(path, table or rank_table(path))
    return _coders[path]


def _pieces(ids: Iterator[bytes], capacity: int) -> Iterator[bytes]:
    """A document's ids and the end id, dealt into pieces; no more than a piece and a part of the ids is held."""
    held = bytearray()
    for some in ids:
        held += some
        whole = (len(held) - 4) // (4 * capacity) * 4 * capacity if len(held) > 4 else 0
        for at in range(0, whole, 4 * capacity):
            yield bytes(held[at : at + 4 * capacity])
        del held[:whole]
    held += END_ID.to_bytes(4, "little")
    for at in range(0, len(held), 4 * capacity):
        yield bytes(held[at : at + 4 * capacity])


def _cut(batches: Iterator[pa.RecordBatch], path: str, table: tuple[list[bytes], np.ndarray], capacity: int) -> Iterator[pa.RecordBatch]:
    coder = word_encoder(path, table)
    for batch in batches:
        for part in slices(batch, "body"):
            texts = part.column("body").to_pylist()
            ids = [[i] for i in coder.encode_all(texts)] if len(texts) > 1 else [coder.encode(texts[0])]
            out: list[list] = [[], [], [], [], []]
            for doc_id, of_text in zip(part.column("doc_id").to_pylist(), ids, strict=True):
                start = 0
                for piece, data in enumerate(_pieces(of_text, capacity)):
                    for column, value in zip(out, (doc_id, piece, start, len(data) // 4, zlib.crc32(data)), strict=True):
                        column.append(value)
                    start += len(data) // 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])


def cut_documents(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents, not yet placed. A null text is empty: one piece with the end id alone."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))
    table = rank_table(vocab_path)
    return rows.mapInArrow(lambda b: _cut(b, vocab_path, table, capacity), PIECES)


def place(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece by the sum-of-squares rule, longest pieces first."""
    open_at = np.zeros(capacity + 1, np.int64)  # how many open sequences have each gap
    with_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    opened, least = 0, -(-int(lengths.sum()) // capacity)
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        gap, change = capacity, 2 * int(open_at[capacity - size]) + 1 if size < capacity else 0
        fits = np.flatnonzero(open_at[size:capacity])  # the gaps that would be left
        if len(fits):
            changes = 2 * (open_at[fits] - open_at[fits + size]) + 2
            if fits[0] == 0:  # a full sequence is no longer open
                changes[0] = 1 - 2 * int(open_at[size])
            best = int(np.argmin(changes))
            if opened >= least or changes[best] <= change:
                gap = size + int(fits[best])
        if gap == capacity:
            at, opened = opened, opened + 1
        else:
            at = with_gap[gap].pop()
            open_at[gap] -= 1
        sequence[i], offset[i] = at, capacity - gap
        if gap > size:
            with_gap[gap - size].append(at)
            open_at[gap - size] += 1
    return sequence, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``pieces`` (as ``cut_documents`` makes them) with sequence_id and offset.

    Every piece is placed; sequences hold at most ``capacity`` ids without gaps between their pieces.
    """
    pieces = materialize(pieces, "pieces")
    groups = max(1, -(-pieces.count() // group))

    def place_group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable")
        sequence, offset = place(rows["length"].to_numpy(np.int64), capacity)
        return rows.drop(columns="part").assign(sequence_id=(int(key[0]) << 32) + sequence, offset=offset)

    # the row's number in the written table deals out rows that repeat an id too
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("part").applyInPandas(place_group, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Defined results: null and empty texts are the end id alone; repeated rows and ids are packed each; null ids
    stay null; an empty table gives no rows; other columns are not read.
    """
    return pack(cut_documents(docs, vocab_path, id_col, text_col, capacity), capacity)
