"""Word shingles of whole texts as 64-bit hashes, and their min-hashes; array code that runs inside tasks.

Arrays are some twenty times as large as the bytes they are made from, so work goes in slices of ``SLICE`` bytes and long
texts in pieces of that size, cut at white space.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
WHITE = re.compile(rb"[\x20\x09-\x0D]")

_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64's last steps)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, *columns: str | int) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose binary ``columns`` hold at most ``SLICE`` bytes, or in single rows."""
    sizes = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        after = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
        yield batch.slice(at, after - at)
        at = after


def _power_tables(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = (np.full(n, v, np.uint64) for v in (base, pow(base, -1, 1 << 64)))
    up[:1] = down[:1] = 1
    return np.cumprod(up), np.cumprod(down)


_usual_powers = functools.lru_cache(maxsize=4)(functools.partial(_power_tables, 2 * SLICE))


def span_hashes(data: np.ndarray, first: np.ndarray, after: np.ndarray, base: int = _BASE) -> np.ndarray:
    """64-bit hashes of the bytes from ``first`` to before ``after``: a polynomial in ``base`` (odd), mixed with the length."""
    up, down = _usual_powers(base) if len(data) <= 2 * SLICE else _power_tables(len(data), base)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
    return mix((sums[after] - sums[first]) * down[first] + (after - first).astype(np.uint64))


def _hashes_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word of ``data``, which begins and ends with white space."""
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edges = np.flatnonzero(word[1:] != word[:-1]) + 1
    first, after = edges[::2], edges[1::2]
    return span_hashes(data, first, after), first


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, text of each word): words are runs free of ASCII white space, A-Z lower-cased."""
    data = b" ".join([b"", *texts, b""]).lower()
    begins = np.cumsum([1, *(len(t) + 1 for t in texts)])[:-1]
    hashes, firsts, at = [], [], 0
    while at < len(data):
        gap = WHITE.search(data, at + SLICE)
        end = gap.end() if gap else len(data)
        of_piece, first = _hashes_of(np.frombuffer(data[max(0, at - 1) : end], np.uint8))
        hashes.append(of_piece)
        firsts.append(first + max(0, at - 1))
        at = end
    return np.concatenate(hashes), np.searchsorted(begins, np.concatenate(firsts), "right") - 1


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Each text's distinct shingles of ``words`` words, sorted; of a shorter text its whole sequence of words."""
    hashes, owner = word_hashes(texts)
    counts = np.bincount(owner, minlength=len(texts))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    rolled = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for k in range(words):
        rolled = mix(rolled + hashes[k : k + len(rolled)] + np.uint64(k + 1))
    sets = []
    for i, n in enumerate(counts):
        lo = bounds[i]
        if n >= words:
            sets.append(np.unique(rolled[lo : lo + n - words + 1]))
        elif n:
            one = np.zeros(1, np.uint64)
            for k in range(n):
                one = mix(one + hashes[lo + k] + np.uint64(k + 1))
            sets.append(mix(one + np.uint64(n)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def min_hashes(sets: list[np.ndarray], n: int) -> np.ndarray:
    """[len(sets), n] unsigned 32-bit minima of ``n`` random functions; sets may not be empty."""
    rng = np.random.default_rng(20_240_229)
    factors, shifts = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)
    out = np.empty((n, len(sets)), np.uint32)
    if not sets:
        return out.T
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    joined = np.concatenate(sets)
    for j in range(n):
        out[j] = np.minimum.reduceat(((joined * factors[j] + shifts[j]) >> np.uint64(32)).astype(np.uint32), starts)
    return out.T
