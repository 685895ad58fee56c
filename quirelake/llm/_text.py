"""Vectorised text helpers for Arrow batches: word spans and 64-bit hashes of words, grams and shingles.

Everything works on the bytes of a whole Arrow column at once, so no Python string is made per word.
Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``; only A-Z are lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed))


_BYTES = [_table(1), _table(2)]


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n + 1:
        steps = np.full(max(n + 1, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n <= 1 << 22:  # do not hold on to the powers of one very long text
            _powers[int(base)] = have
    return have[: n + 1]


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "").cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    body = col.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text (one row at least), which bounds memory."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(at, upto - at)
            at = upto


class Words:
    """Word spans of a string column with hashes of any byte span inside a word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True):
        self.raw, self.offsets = data, offsets
        self.data = LOWER[data] if lower else data
        n = len(data)
        if n:
            blank = SPACE[data]
            first, last = np.empty(n, bool), np.empty(n, bool)
            first[0], last[-1] = True, True
            first[1:], last[:-1] = blank[:-1], blank[1:]
            inner = offsets[1:-1]
            first[inner[inner < n]] = True
            last[inner[inner > 0] - 1] = True
            self.starts = np.flatnonzero(first & ~blank)
            self.ends = np.flatnonzero(last & ~blank) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.doc = np.searchsorted(offsets, self.starts, side="right") - 1
        self.bounds = np.searchsorted(self.doc, np.arange(len(offsets)))  # of each text's words
        self._sums: dict[int, np.ndarray] = {}

    def span_hash(self, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
        """A hash of the bytes in each span, the same wherever the span stands."""
        if which not in self._sums:
            sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_BYTES[which][self.data] * _power(_BASE, len(self.data))[:-1], out=sums[1:], dtype=np.uint64)
            self._sums[which] = sums
        sums = self._sums[which]
        return mix((sums[ends] - sums[starts]) * _power(_BACK, len(self.data))[starts] + (ends - starts).astype(np.uint64))

    def hashes(self, which: int = 0) -> np.ndarray:
        return self.span_hash(self.starts, self.ends, which)


_ORDER = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` items of ``h``, over the ends of texts too; runs of different lengths differ."""
    n = max(len(h) - k + 1, 0)
    total = np.full(n, np.uint64(k))
    for j in range(k):
        total += h[j : j + n] * _ORDER[j]
    return mix(total)


def shingles(words: Words, k: int, h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of each run of ``k`` words; a text with 1 to k-1 words has its whole sequence as one."""
    h = words.hashes() if h is None else h
    doc = words.doc
    out_h, out_d = [], []
    if len(h) >= k:
        whole = np.flatnonzero(doc[k - 1 :] == doc[: len(doc) - k + 1])
        total = np.zeros(len(whole), np.uint64)
        for j in range(k):
            total += h[whole + j] * _ORDER[j]
        out_h.append(mix(total))
        out_d.append(doc[whole])
    counts = np.diff(words.bounds)
    for m in range(1, k):
        few = np.flatnonzero(counts == m)
        if len(few):
            total = np.full(len(few), np.uint64(m))
            for j in range(m):
                total += h[words.bounds[few] + j] * _ORDER[j]
            out_h.append(mix(total))
            out_d.append(few)
    if not out_h:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out_h), np.concatenate(out_d)


def distinct_by_text(h: np.ndarray, doc: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text and the offsets of the texts in them."""
    if not len(h):
        return h, np.zeros(n_texts + 1, np.int64)
    if (doc[1:] < doc[:-1]).any():
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
    h = h.copy()
    bounds = np.searchsorted(doc, np.arange(n_texts + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]


def large_binary(parts: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column over one numpy buffer; offsets count items."""
    size = parts.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(parts))])
