"""Secrets in whole texts: three fixed kinds by pattern, further ones by sliding-window entropy.

Candidate strings are runs of one character class. A window of fixed size slides along a run; its Shannon entropy follows from
the counts of its characters, which change by one character in and one out, in whole numbers so that no rounding
adds up. Windows at or above the class's entropy are joined to spans. An allow-list then takes away what is known to be harmless:
published example keys, digests named as such, identifiers, alphabets and repeated patterns. Spans inside a fixed kind's match aren't
told twice; fixed kinds are never suppressed.

Everything is per text and runs in slices of bytes. Array code finds the long runs and plain searches the keywords, so that
patterns are only tried where they can match; the work is linear in a text but for the sorting of its spans.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.shingles import slices

#: fixed kinds, in the order in which spans that begin together are told
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_LEAST = 8
ACCESS = re.compile(rb"AKIA[A-Z0-9]{12,}")  # a run that begins with AKIA and has 16 characters
HEX = re.compile(rb"[0-9a-f]{32,}")
BASE = ("assign", "access", "hex")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")  # what ``ASSIGN`` begins with
RUN = 24  # hex strings and candidates are, or lie in, runs of as many of these characters
_IN_RUN = np.zeros(256, bool)
_IN_RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True

Span = tuple[int, int, int]
Runs = list[tuple[int, int]]

#: the entropy of a window is kept as a sum of whole numbers of 2 ** -SCALE bits
SCALE = 32


@dataclass(frozen=True)
class CharClass:
    """A character class: its runs of at least ``window`` characters that ``needs`` finds something in are candidates.

    ``bits`` is the least Shannon entropy of a window, in bits a character.
    """

    kind: str
    run: re.Pattern[bytes]
    needs: tuple[re.Pattern[bytes], ...]
    window: int
    bits: float


_DIGIT, _LETTER, _LOWER, _UPPER = (re.compile(x) for x in (rb"[0-9]", rb"[A-Za-z]", rb"[a-z]", rb"[A-Z]"))

#: random hex has some 3.6 bits in a window of 32, random base64 4.3 in one of 24, random lower-case letters and digits 4.0
CLASSES = (
    CharClass("entropy_hex", re.compile(rb"[0-9A-Fa-f]{32,}"), (_DIGIT, _LETTER), 32, 3.0),
    CharClass("entropy_alnum", re.compile(rb"[a-z0-9]{24,}|[A-Z0-9]{24,}"), (_DIGIT, _LETTER), 24, 3.7),
    CharClass("entropy_base64", re.compile(rb"[A-Za-z0-9+/_-]{24,}={0,2}"), (_DIGIT, _LOWER, _UPPER), 24, 4.0),
)

#: a span is harmless if a pattern is found in it, or in the ``BEFORE`` bytes in front of its candidate
ALLOWED_TEXT = (
    rb"(?i)example|sample|dummy|placeholder|changeme|your[_-]?(?:api|key|token|secret)",
    rb"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    rb"(?i)abcdefghij|0123456789|qwertyuiop|xxxxxx",
    rb"^(.{1,8}?)\1{2,}",
    rb"^[/_-]?(?:[A-Za-z]+[0-9]{0,4}[/_-])+(?:[A-Za-z]+[0-9]{0,4})?$",
)
ALLOWED_BEFORE = (
    rb"(?i)(?:sha-?(?:1|224|256|384|512)|md5|crc32|checksum|digest|etag|commit|revision|integrity|fingerprint|uuid|guid)[\"']?[ ]*[:=-]?[ ]*[\"']?$",
    rb"(?i)(?:https?:|www\.)[^\s?]*$",
    rb"(?i)base64,$",
)
BEFORE = 24


def _costs(window: int) -> np.ndarray:
    """count * log2(count) for all counts of a window, in whole numbers."""
    return np.array([round(c * math.log2(c) * 2**SCALE) if c else 0 for c in range(window + 1)], np.int64)


def most_cost(window: int, bits: float) -> int:
    """The largest sum of costs at which a window still has ``bits`` bits a character."""
    return math.floor((math.log2(window) - bits) * window * 2**SCALE)


def high_windows(run: bytes, window: int, bits: float) -> list[tuple[int, int]]:
    """Joined spans of ``run``'s windows with at least ``bits`` bits of Shannon entropy a character."""
    costs, most = _costs(window).tolist(), most_cost(window, bits)
    counts, total, spans = [0] * 256, 0, []
    for i, code in enumerate(run):
        counts[code] += 1
        total += costs[counts[code]] - costs[counts[code] - 1]
        if i >= window:
            out = run[i - window]
            counts[out] -= 1
            total += costs[counts[out]] - costs[counts[out] + 1]
        if i >= window - 1 and total <= most:
            start = i - window + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def long_runs(text: bytes) -> Runs:
    """(start, end) of all runs of ``RUN`` and more of the characters that strings of these kinds are made of."""
    inside = np.concatenate([[False], _IN_RUN[np.frombuffer(text, np.uint8)], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)
    return [(a, b) for a, b in edges[edges[:, 1] - edges[:, 0] >= RUN].tolist()]


class Scanner:
    def __init__(self, classes: Iterable[CharClass] = CLASSES, allowed_text: Iterable[bytes] = ALLOWED_TEXT, allowed_before: Iterable[bytes] = ALLOWED_BEFORE):
        self.classes = tuple(classes)
        self.allowed_text, self.allowed_before = ([re.compile(x) for x in given] for given in (allowed_text, allowed_before))
        self.kinds = (*BASE, *(c.kind for c in self.classes))

    def base(self, text: bytes, runs: Runs, assigned: bool = True) -> list[Span]:
        """(start, kind's place, end) of the fixed kinds, in bytes; ``runs`` are the text's long runs."""
        found = [(m.start(), 0, m.end()) for m in (ASSIGN.finditer(text) if assigned else ()) if m.end(1) - m.start(1) >= ASSIGN_LEAST]
        if b"AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
        found += [(m.start(), 2, m.end()) for run in runs for m in HEX.finditer(text, *run)]
        return sorted(found)

    def allowed(self, text: bytes, run: int, start: int, end: int) -> bool:
        """Whether a span, within a candidate that begins at ``run``, is known to be harmless."""
        return any(p.search(text[start:end]) for p in self.allowed_text) or any(p.search(text[max(0, run - BEFORE) : run]) for p in self.allowed_before)

    def added(self, text: bytes, runs: Runs, base: list[Span]) -> list[Span]:
        """(start, kind's place, end) of high-entropy spans that no span told before holds."""
        told, out = base, []
        for number, kind in enumerate(self.classes, len(BASE)):
            held, new = _Held(told), []
            for m in (m for run in runs for m in kind.run.finditer(text, *run)):
                if not all(p.search(text, *m.span()) for p in kind.needs):
                    continue
                for start, end in high_windows(m[0], kind.window, kind.bits):
                    start, end = start + m.start(), end + m.start()
                    if all(p.search(text, start, end) for p in kind.needs) and not held.covers(start, end) and not self.allowed(text, m.start(), start, end):
                        new.append((start, number, end))
            out += new
            told = sorted([*told, *new])
        return out

    def spans(self, text: bytes, runs: Runs | None = None, assigned: bool = True) -> tuple[list[Span], list[Span]]:
        """The fixed kinds' spans and all spans, by start and kind, in code points."""
        runs = long_runs(text) if runs is None else runs
        base = self.base(text, runs, assigned)
        every = sorted([*base, *self.added(text, runs, base)])
        if every and not text.isascii():
            begins = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
            base, every = ([(int(begins[a]), k, int(begins[b])) for a, k, b in spans] for spans in (base, every))
        return base, every

    def slice_spans(self, texts: list[bytes]) -> Iterator[tuple[list[Span], list[Span]]]:
        """``spans`` of each text; runs and keywords are looked for in all of them at once."""
        joined = b"\n".join(texts)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        runs: dict[int, Runs] = {}
        for start, end in long_runs(joined):
            i = int(np.searchsorted(begins, start, "right")) - 1
            runs.setdefault(i, []).append((start - int(begins[i]), end - int(begins[i])))
        words = [w for w in KEYWORDS if w in (lower := joined.lower())]
        for i, text in enumerate(texts):
            at = int(begins[i])
            assigned = any(lower.find(w, at, at + len(text)) >= 0 for w in words)
            yield self.spans(text, runs.get(i, []), assigned) if assigned or i in runs or b"AKIA" in text else ([], [])

    def told(self, spans: list[Span]) -> str:
        return ",".join(f"{self.kinds[k]}:{a}:{b}" for a, k, b in spans)


class _Held:
    """Whether one of some spans holds a given one."""

    def __init__(self, spans: list[Span]):
        self.starts = np.array([s for s, _, _ in spans], np.int64)
        self.ends = np.maximum.accumulate(np.array([e for _, _, e in spans], np.int64)) if spans else self.starts

    def covers(self, start: int, end: int) -> bool:
        i = int(np.searchsorted(self.starts, start, "right"))
        return i > 0 and int(self.ends[i - 1]) >= end


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scanner: Scanner | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy) of every row.

    Spans are kind:start:end in code points, end exclusive, by start and kind. Defined results: null text counts as empty; a text
    without secrets has zero counts, the digest of the empty string and no spans; rows that repeat are each returned; a null id
    stays null. Other columns, whatever their names, are not read.
    """
    scanner = scanner or Scanner()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))
    kind = dict(rows.dtypes)["doc_id"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "body"):
                out = []
                for base, every in scanner.slice_spans(part.column("body").to_pylist()):
                    counts = [sum(k == n for _, k, _ in base) for n in range(len(BASE))]
                    out.append((*counts, hashlib.sha256(scanner.told(base).encode()).hexdigest(), scanner.told(every), len(every) - len(base)))
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(),) * 3 + (pa.string(),) * 2 + (pa.int64(),), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"])

    return rows.mapInArrow(scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long")
