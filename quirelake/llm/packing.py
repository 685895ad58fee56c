"""Operator 7: packing documents into fixed windows by best-fit decreasing.

Overlong documents are first cut into full windows, each a sequence of its own. What remains is placed longest
first into the open window with the least room that still takes it; a segment tree over the remaining capacity
finds that window. Packing runs in many tasks, each over a hash share of the pieces, and within a task over ROUND pieces
at a time, so no task holds more than that many however large its share; what that costs is one open window a round or so.

Defined results: null text is an empty text (its end id alone); repeated rows are packed like others; an empty
table gives no pieces; other columns are ignored; null ids are kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm._text import slices, utf8
from quirelake.llm.tokens import END_ID, encoder, texts


#: Pieces that a task packs at a time.
ROUND = 200_000


class OpenWindows:
    """Open windows by remaining capacity: a segment tree whose leaves are the capacities 0 to ``size``."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.count = [0] * (2 * self.width)
        self.stacks: list[list[int]] = [[] for _ in range(self.width)]

    def _add(self, room: int, by: int) -> None:
        at = room + self.width
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, window: int, room: int) -> None:
        self.stacks[room].append(window)
        self._add(room, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out (window, room) with the least room >= need."""
        count, at = self.count, need + self.width
        if not count[at]:
            while at > 1 and not (at & 1 == 0 and count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.width:
                at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.width
        self._add(room, -1)
        return self.stacks[room].pop(), room


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset in it) of each piece; ties go in the order given."""
    windows, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, opened = OpenWindows(size), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = tree.tightest(n) if n < size else None
        if found is None:
            window, room = opened, size
            opened += 1
        else:
            window, room = found
        windows[i], offsets[i] = window, size - room
        if room > n:
            tree.put(window, room - n)
    return windows, offsets


def cut(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = END_ID, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of at most ``size`` ids: doc_id, start, length, ids_crc32, doc_tokens, and ids (32-bit, binary) if asked for."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in slices(batches, "text", 1 << 20):
            ids, bounds = enc.encode(*utf8(batch.column("text")))
            rows, starts, lengths, crcs, totals, payloads = [], [], [], [], [], []
            for k, one in enumerate(texts(ids, bounds, end_id)):
                one = one.astype("<u4")
                for a in range(0, len(one), size):
                    piece = one[a : a + size].tobytes()
                    rows.append(k)
                    starts.append(a)
                    lengths.append(len(piece) // 4)
                    crcs.append(zlib.crc32(piece))
                    totals.append(len(one))
                    if with_ids:
                        payloads.append(piece)
            columns = [batch.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(payloads, pa.binary())] * with_ids, names=names + ["ids"] * with_ids)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(pieces, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids)


def pack(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` of 1 to ``size``."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, held, n = TaskContext.get().partitionId() << 40, [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal first
            table = pa.Table.from_batches(held)
            windows, offsets = best_fit_decreasing(table.column("length").to_numpy(), size)
            table = table.append_column("sequence_id", pa.array(windows + first, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))
            first += int(windows.max()) + 1
            yield from table.to_batches(max_chunksize=50_000)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= ROUND:
                yield from packed()
                held, n = [], 0
        if held:
            yield from packed()

    shared = pieces.repartition(F.xxhash64(*[c for c in ("doc_id", "start") if c in pieces.columns], "length")).sortWithinPartitions("doc_id", "start", "length")
    return shared.mapInArrow(place, ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, `offset` long")
