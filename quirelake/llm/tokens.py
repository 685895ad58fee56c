"""Token ids of whole texts, a batch at a time, with every distinct word encoded once by the tokenizers library.

The vocabulary's pre-tokenizer never joins characters across white space, so a text's ids are the ids of its
white-space separated chunks in order. A chunk that ends in one full stop or comma after a Latin letter is two
pieces for the pre-tokenizer, so its two parts are encoded apart, which makes the distinct parts far fewer.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np

from quirelake.llm._text import Words

END_ID = 1
_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """Keeps the ids of the parts seen so far in sorted arrays, at most ``keep`` parts; past that it starts anew."""

    def __init__(self, path: str, keep: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.dtype("<u4")
        self.reset()

    def reset(self) -> None:
        self.key = np.zeros(0, np.uint64)
        self.check = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.ids = np.zeros(0, self.dtype)

    def _encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts in a row, and each part's number of ids."""
        ids, counts = [], []
        for at in range(0, len(parts), 4096):
            some = parts[at : at + 4096]
            begins = np.zeros(len(some), np.int64)
            np.cumsum([len(p) + 1 for p in some[:-1]], out=begins[1:])
            got = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids.append(np.array(got.ids, self.dtype))
            first = np.fromiter((o[0] for o in got.offsets), np.int64, len(got.ids))
            counts.append(np.bincount(np.searchsorted(begins, first, side="right") - 1, minlength=len(some)))
        return np.concatenate(ids), np.concatenate(counts)

    def _learn(self, words: Words, starts: np.ndarray, ends: np.ndarray, key: np.ndarray, check: np.ndarray) -> None:
        raw = words.raw.tobytes()
        ids, counts = self._encode([raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        where = np.searchsorted(self.key, key)
        begins = len(self.ids) + np.cumsum(counts) - counts
        self.key, self.check = np.insert(self.key, where, key), np.insert(self.check, where, check)
        self.start, self.length = np.insert(self.start, where, begins), np.insert(self.length, where, counts)
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets of the texts in them), without an end id."""
        words = Words(data, offsets, lower=False)
        starts, ends = words.starts, words.ends
        if not len(starts):
            return np.zeros(0, self.dtype), np.zeros(len(offsets), np.int64)
        last, before = data[ends - 1], data[np.maximum(ends - 2, 0)]
        lead = data[np.maximum(ends - 3, 0)]
        letter = ((before | 32) >= 97) & ((before | 32) <= 122) | (lead == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)
        cut = ((last == 0x2E) | (last == 0x2C)) & (ends - starts >= 2) & letter & ((before < 0x80) | (ends - starts >= 3))
        order = np.arange(len(starts)) + np.cumsum(cut) - cut
        n = len(starts) + int(cut.sum())
        part_start, part_end = np.empty(n, np.int64), np.empty(n, np.int64)
        part_start[order], part_end[order] = starts, ends - cut
        part_start[order[cut] + 1], part_end[order[cut] + 1] = ends[cut] - 1, ends[cut]
        key, check = words.span_hash(part_start, part_end), words.span_hash(part_start, part_end, 1)
        distinct, first, which = np.unique(key, return_index=True, return_inverse=True)
        if len(self.key) + len(distinct) > self.keep:
            self.reset()
        at = np.minimum(np.searchsorted(self.key, distinct), max(len(self.key) - 1, 0))
        new = np.flatnonzero(self.key[at] != distinct) if len(self.key) else np.arange(len(distinct))
        if len(new):
            f = first[new]
            self._learn(words, part_start[f], part_end[f], distinct[new], check[f])
        at = np.searchsorted(self.key, distinct)
        if (self.check[at][which] != check).any():  # two parts under one key: encode this batch part by part
            ids, length = self._encode([bytes(data[a:b]).decode() for a, b in zip(part_start.tolist(), part_end.tolist(), strict=True)])
        else:
            begin, length = self.start[at][which], self.length[at][which]
            shift = np.cumsum(length) - length
            ids = self.ids[np.repeat(begin - shift, length) + np.arange(int(length.sum()))]
        upto = np.zeros(n + 1, np.int64)
        np.cumsum(length, out=upto[1:])
        bounds = np.append(order, n)[words.bounds]
        return ids, upto[bounds]


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker; its parts stay known from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def texts(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> Iterator[np.ndarray]:
    """Each text's ids with the end id."""
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield np.append(ids[a:b], ids.dtype.type(end_id))
