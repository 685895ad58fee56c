"""Operator 11: exact token counts of texts of any size, huge ones from overlapping chunks that are spliced.

Texts of at most ``chunk`` bytes are counted where they are read. A longer one is cut into chunks that each run ``overlap``
bytes into the next; chunks are rows of their own, so one huge text is counted by many tasks, none of which holds it whole.
Each chunk is encoded with byte offsets, and two neighbours are spliced at the first common boundary of their overlap that
is proven stable: tokens before it come from the left chunk, tokens after it from the right one. Where an overlap holds
no such boundary (one endless word, a run of blanks), it is widened to the whole next chunk: the two are encoded again
as one, and so on, in the worst case up to the whole text.

Why a boundary is stable: a byte-level vocabulary's pre-tokenizer cuts a text from left to right by a pattern without
look-behind, and pieces are encoded apart. So from a position where both chunks begin a piece, both go on alike, and as
the whole text does, but for the last bytes of the left chunk, where a look-ahead or an added token is cut off; a margin
longer than these is left out. The left chunk is right up to there because it was spliced itself.

Counting is vectorised: where white space follows anything else a piece begins in every context, so texts are cut there
(and before a full stop or comma that ends a word after a Latin letter), and each distinct unit is encoded once by a worker.

Defined results: null text is empty and has 0 tokens; the strings of added tokens count as the library's default has it,
one token; texts that are no valid UTF-8 are mended first; repeated rows and null ids give a row each; an empty table
stays empty; other columns are ignored, whatever their names. A vocabulary with a normalizer, a prefix space or added
tokens that depend on their surroundings is an error, as the proof does not hold for it.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirelake.llm._spark import written
from quirelake.llm._text import SPACE, Words, slices, utf8

#: Bytes of a chunk and of its overlap with the next.
CHUNK, OVERLAP = 1 << 16, 512
#: Units of more bytes are encoded each time they come.
LONG_UNIT = 256
#: Code points of two and three bytes that patterns count as white space, as their UTF-8 bytes in a number. Fixed values.
WIDE_BLANKS = [int.from_bytes(chr(c).encode()) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_COUNTERS: dict[str, Counter] = {}


class Counter:
    """Counts tokens of texts and chunks; keeps the counts of at most ``keep`` distinct units, past that it starts anew."""

    def __init__(self, path: str, keep: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        cutter, added = rules["pre_tokenizer"] or {}, rules["added_tokens"]
        plain = cutter.get("type") == "ByteLevel" and cutter.get("use_regex") and not cutter["add_prefix_space"] and not rules["normalizer"]
        if not plain or any(t["lstrip"] or t["rstrip"] or t["single_word"] or SPACE[list(t["content"].encode())].any() for t in added):
            raise ValueError("the vocabulary must be byte-level, without normalizer, prefix space or added tokens with conditions")
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.n_bytes = np.zeros(max(names.values()) + 1, np.int64)
        for name, i in names.items():
            self.n_bytes[i] = len(name)  # one letter of the byte alphabet for each byte
        for t in added:
            self.n_bytes[t["id"]] = len(t["content"].encode())
        self.margin = max([len(t["content"].encode()) for t in added], default=0) + 16
        self.reset()

    def reset(self) -> None:
        self.key, self.check, self.count = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def _count(self, units: list[str]) -> np.ndarray:
        found = []
        for at in range(0, len(units), 4096):
            found += map(len, self.tokenizer.encode_batch_fast(units[at : at + 4096], add_special_tokens=False))
        return np.array(found, np.int64)

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the units of all texts, and the tokens of each."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        blank = SPACE[data]
        starts_here = np.zeros(n, bool)
        starts_here[1:] = blank[1:] & ~blank[:-1]
        wide = np.flatnonzero(starts_here[1:] & (data[:-1] >= 0x80)) + 1  # after a character of several bytes
        two = (data[np.maximum(wide - 2, 0)].astype(np.int64) << 8) | data[wide - 1]
        three = (data[np.maximum(wide - 3, 0)].astype(np.int64) << 16) | two
        starts_here[wide[np.isin(two, WIDE_BLANKS) | np.isin(three, WIDE_BLANKS)]] = False
        last = np.zeros(n, bool)  # a stop or comma before white space, after a letter
        last[1:-1] = ((data[1:-1] == 0x2E) | (data[1:-1] == 0x2C)) & (((data[:-2] | 32) >= 97) & ((data[:-2] | 32) <= 122)) & blank[2:]
        starts_here |= last
        starts_here[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(starts_here)
        ends = np.append(starts[1:], n)
        spans = Words(data, np.array([0, n]), lower=False)
        key, check = spans.span_hash(starts, ends), spans.span_hash(starts, ends, 1)
        raw, counts = data.tobytes(), np.zeros(len(starts), np.int64)
        text_of = lambda some: [raw[a:b].decode() for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]
        long = ends - starts > LONG_UNIT
        if long.any():
            counts[long] = self._count(text_of(long))
        short = np.flatnonzero(~long)
        distinct, first, which = np.unique(key[short], return_index=True, return_inverse=True)
        if len(self.key) + len(distinct) > self.keep:
            self.reset()
        where = np.searchsorted(self.key, distinct)
        new = np.append(self.key, np.uint64(0))[where] != distinct
        new |= where == len(self.key)
        if new.any():
            some, where = short[first[new]], where[new]
            self.count = np.insert(self.count, where, self._count(text_of(some)))
            self.check = np.insert(self.check, where, check[some])
            self.key = np.insert(self.key, where, distinct[new])
        at = np.searchsorted(self.key, distinct)[which]
        if (self.check[at] != check[short]).any():  # two units under one key
            counts[short] = self._count(text_of(short))
        else:
            counts[short] = self.count[at]
        return starts, counts

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of tokens of each text."""
        starts, counts = self.units(data, offsets)
        return np.diff(np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, offsets)])

    def boundaries(self, data: np.ndarray, zones: list[tuple[int, int]]) -> tuple[int, list[tuple[np.ndarray, np.ndarray]]]:
        """The tokens of one chunk and, for each zone [a, b) of it, the places where a piece begins and the tokens before."""
        starts, counts = self.units(data, np.array([0, len(data)]))
        before = np.concatenate([[0], np.cumsum(counts)])
        found = []
        for a, b in zones:
            places, tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            first = max(int(np.searchsorted(starts, a, side="right")) - 1, 0)
            for u in range(first, int(np.searchsorted(starts, b))):
                end = int(starts[u + 1]) if u + 1 < len(starts) else len(data)
                coded = self.tokenizer.encode(data[int(starts[u]) : end].tobytes().decode(), add_special_tokens=False)
                at = int(starts[u]) + np.concatenate([[0], np.cumsum(self.n_bytes[coded.ids])])[:-1]
                piece = np.array(coded.word_ids)
                begins = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
                begins = begins[(at[begins] >= a) & (at[begins] < b)]
                places.append(at[begins])
                tokens.append(before[u] + begins)
            found.append((np.concatenate(places), np.concatenate(tokens)))
        return int(before[-1]), found


def counter(path: str) -> Counter:
    """One counter for each Python worker; its units stay known from task to task."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def cuts(body: memoryview, chunk: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, start of the next, end) of the chunks of a text; the last is at least an overlap long."""

    def at(x: int) -> int:
        while 0 < x < len(body) and body[x] & 0xC0 == 0x80:
            x -= 1
        return x

    found, start = [], 0
    while len(body) - start > chunk + overlap:
        stop = at(start + chunk)
        found.append((start, stop, at(stop + overlap)))
        start = stop
    return [*found, (start, len(body), len(body))]


def _read(docs: DataFrame, tokenizer: str, chunk: int, overlap: int) -> DataFrame:
    """Counts of short texts, and the chunks of long ones: (row, no, size) with ``size`` the bytes before the next chunk."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in slices(batches, "text", 1 << 20):
            data, offsets = utf8(batch.column("text"))
            sizes = np.diff(offsets)
            short = np.flatnonzero(sizes <= chunk)
            if len(short):
                keep = np.repeat(sizes <= chunk, sizes)
                n = count.counts(data[keep], np.concatenate([[0], np.cumsum(sizes[short])]))
                none = [None] * len(short)
                yield batch_of(batch.column("doc_id").take(pa.array(short)), sizes[short], n, none, none, none, none)
            for i in np.flatnonzero(sizes > chunk).tolist():
                body, row = memoryview(data[offsets[i] : offsets[i + 1]]), uuid.uuid4().hex
                for no, (start, stop, end) in enumerate(cuts(body, chunk, overlap)):
                    yield batch_of(batch.column("doc_id").slice(i, 1), sizes[i : i + 1], [None], [row], [no], [stop - start], [bytes(body[start:end])])

    def batch_of(doc_id: pa.Array, n_bytes, n, row, no, size, body) -> pa.RecordBatch:
        columns = [doc_id, pa.array(n_bytes, pa.int64()), pa.array(n, pa.int64()), pa.array(row, pa.string()), pa.array(no, pa.int64()), pa.array(size, pa.int64()), pa.array(body, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "row", "no", "size", "body"])

    return docs.mapInArrow(read, f"doc_id {kind}, n_bytes long, n_tokens long, row string, no long, size long, body binary")


def _encoded(chunks: DataFrame, tokenizer: str, overlap: int) -> DataFrame:
    """(row, no, next, total, head, head_n, tail, tail_n) of rows (row, no, parts): places are bytes after the start of
    the chunk (head), or of the next one (tail); ``no`` of a merged chunk is that of its first part."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in batches:
            for i in range(batch.num_rows):
                parts = sorted(batch.column("parts")[i].as_py(), key=lambda p: p["no"])
                data = np.frombuffer(b"".join([*(p["body"][: p["size"]] for p in parts[:-1]), parts[-1]["body"]]), np.uint8)
                size = sum(p["size"] for p in parts)
                total, ((head, head_n), (tail, tail_n)) = count.boundaries(data, [(0, overlap), (size, max(size, len(data) - count.margin))])
                lists = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (head, head_n, tail - size, tail_n)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(i, 1), pa.array([parts[0]["no"]]), pa.array([parts[-1]["no"] + 1]), pa.array([total]), *lists],
                    names=["row", "no", "next", "total", "head", "head_n", "tail", "tail_n"],
                )

    lists = ", ".join(f"{x} array<long>" for x in ("head", "head_n", "tail", "tail_n"))
    return chunks.mapInArrow(encode, f"row string, no long, next long, total long, {lists}")


def _splices(known: DataFrame) -> DataFrame:
    """(row, no, surplus) of each pair of neighbours, ``no`` being that of the right one: the tokens that both count, null
    where their overlap holds no stable boundary."""
    left = known.select("row", F.col("next").alias("no"), "total", "tail", "tail_n")
    right = known.select("row", "no", "head", "head_n")
    first = F.array_min(F.array_intersect("tail", "head"))
    of = lambda places, tokens: F.get(tokens, (F.array_position(places, first) - 1).cast("int"))
    surplus: Column = F.col("total") - of(F.col("tail"), F.col("tail_n")) + of(F.col("head"), F.col("head_n"))
    return left.join(right, ["row", "no"]).select("row", "no", surplus.alias("surplus"))


def count_tokens(docs: DataFrame, tokenizer: str, chunk: int = CHUNK, overlap: int = OVERLAP, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each row, without begin, end or other special tokens added."""
    if chunk < 2 * overlap or overlap < 4:
        raise ValueError("a chunk must be at least two overlaps long")
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.make_valid_utf8(F.col(text)), F.lit("")).alias("text"))
    pieces = written(_read(own, tokenizer, chunk, overlap), "token-pieces")
    done = pieces.filter("row is null").select("doc_id", "n_bytes", "n_tokens")
    chunks = pieces.filter("row is not null")
    # spread anew, as all chunks of a text lie in one file
    one = chunks.select("row", "no", F.array(F.struct("no", "size", "body")).alias("parts")).repartition("row", "no")
    known = written(_encoded(one, tokenizer, overlap), "token-chunks")
    while True:
        splices = written(_splices(known), "token-splices")
        apart = splices.filter("surplus is null").select("row", F.col("no").alias("bad")).distinct()
        if apart.isEmpty():
            break
        # a chunk goes to the last one at or before it whose left splice holds
        texts = known.join(apart.select("row").distinct(), "row", "left_semi").select("row", "no").join(apart, (F.col("no") == F.col("bad")) & (known["row"] == apart["row"]), "left").select(known["row"], "no", "bad")
        in_text = W.partitionBy("row").orderBy("no").rowsBetween(W.unboundedPreceding, 0)
        to = texts.withColumn("to", F.last(F.when(F.col("bad").isNull(), F.col("no")), ignorenulls=True).over(in_text))
        sized = to.withColumn("n", F.count("*").over(W.partitionBy("row", "to"))).filter("n > 1").select("row", "no", "to")
        moved = written(sized.join(known.select("row", "no", "next"), ["row", "no"]).select("row", F.explode(F.sequence(F.col("no"), F.col("next") - 1)).alias("no"), "to", F.col("no").alias("was")), "token-merges")
        parts = chunks.select("row", "no", "size", "body").join(moved, ["row", "no"]).groupBy("row", "to").agg(F.collect_list(F.struct("no", "size", "body")).alias("parts"))
        merged = _encoded(parts.select("row", F.col("to").alias("no"), "parts"), tokenizer, overlap)
        gone = moved.select("row", F.col("was").alias("no")).distinct()
        known = written(known.join(gone, ["row", "no"], "left_anti").unionByName(merged), "token-chunks")
    ids = chunks.filter("no = 0").select("row", "doc_id", "n_bytes")
    sums = known.select("row", F.col("total").alias("n")).unionByName(splices.select("row", (-F.col("surplus")).alias("n"))).groupBy("row").agg(F.sum("n").alias("n_tokens"))
    return done.unionByName(ids.join(sums, "row").select("doc_id", "n_bytes", "n_tokens"))
