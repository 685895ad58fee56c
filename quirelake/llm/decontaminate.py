"""Operator 3: benchmark decontamination by n-gram seeds and Smith-Waterman alignment.

One pass over the texts finds every place where a text has a word n-gram of any test item and cuts the passages
around these places. Each n-gram of an item is a seed, common or rare, so a passage meets every item with which it
shares one. A pair whose passage holds too few of the item's words to reach ``min_score`` is dropped, which loses
nothing; the others are aligned word by word (match +2, mismatch or gap -1), so edited, reordered and paraphrased
copies score too. The score is the best local alignment as a share of the item's own; a pair at ``min_score`` or
more is a leak. A copy that keeps no run of GRAM words of its item shares no n-gram with it and is not seen.

Words are compared without case (ASCII and Latin-1 letters) and without punctuation at their ends.

Defined results: null or wordless texts and items match nothing; an item shorter than the n-gram is found by its
whole sequence of words wherever that stands in a text; repeated rows are each found; a null doc_id is reported as
null, and a row with one is judged by its own text; rows that share a doc_id are told apart by their texts; a repeated item_id stands for
all its texts, with the best score; empty tables give no rows; other columns are ignored. Items are handled in
blocks of bounded size, each sent to all tasks, so any number of items is possible.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm._spark import spread_join, written
from quirelake.llm._text import Words, runs, slices, utf8

GRAM = 3
MIN_SCORE = 0.5
#: n-grams of a block of items: 8 bytes each in every task.
BLOCK_GRAMS = 2_000_000
MATCH, OTHER = 2, -1

PUNCT = np.zeros(256, bool)
PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def folded(col: pa.Array) -> Words:
    """Words with Latin-1 letters lower-cased too, and without punctuation at their ends."""
    data, offsets = utf8(col)
    if len(data) > 1:
        data = data.copy()
        tail = data[1:]
        tail[(data[:-1] == 0xC3) & (tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)] += 32
    words = Words(data, offsets)
    starts, ends = words.starts, words.ends
    while (more := (starts < ends) & PUNCT[words.data[np.minimum(starts, max(len(data) - 1, 0))]]).any():
        starts = starts + more
    while (more := (starts < ends) & PUNCT[words.data[ends - 1]]).any():
        ends = ends - more
    keep = starts < ends
    words.starts, words.ends, words.doc = starts[keep], ends[keep], words.doc[keep]
    words.bounds = np.searchsorted(words.doc, np.arange(len(offsets)))
    return words


def item_rows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Items (item_id, item, n, words), a row for each text with words, and their n-grams (item, gram, at, n); ``item``
    numbers an item's text, n is its number of words."""
    kind = benchmark.schema[item_id].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = folded(batch.column("text"))
            h, n = words.hashes(), np.diff(words.bounds)
            some = np.flatnonzero(n > 0)
            grams, ats = [], []
            for i in some.tolist():
                own = h[words.bounds[i] : words.bounds[i + 1]]
                grams.append(runs(own, min(GRAM, len(own))).tobytes())
                ats.append(own.tobytes())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(some)) for c in ("item_id", "item")), pa.array(n[some], pa.int64()), pa.array(ats, pa.binary()), pa.array(grams, pa.binary())], names=["item_id", "item", "n", "words", "grams"]
            )

    def unrolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, n, grams in zip(batch.column("item"), batch.column("n"), batch.column("grams"), strict=True):
                g = np.frombuffer(grams.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(g), pa.int64()), pa.array(g), pa.array(np.arange(len(g))), pa.array([n.as_py()] * len(g), pa.int64())], names=["item", "gram", "at", "n"])

    own = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).filter("item_id is not null").dropDuplicates()
    made = written(own.withColumn("item", F.xxhash64("item_id", "text")).mapInArrow(split, f"item_id {kind}, item long, n long, words binary, grams binary"), "items")
    return made.drop("grams"), written(made.select("item", "n", "grams").mapInArrow(unrolled, "item long, gram long, at long, n long"), "item-grams")


def _passages(docs: DataFrame, known: np.ndarray, longest: np.ndarray, sizes: list[int]) -> DataFrame:
    """(doc_id, of, start, words, hits): word hashes around the places with a known n-gram. ``longest`` is the length of
    the longest item with the n-gram: twice as many words on both sides are kept; places whose surroundings overlap
    share a passage. ``sizes``: lengths of the n-grams to look for."""
    order = np.argsort(known)
    sent = docs.sparkSession.sparkContext.broadcast((known[order], 2 * longest[order]))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, reach = sent.value
        for batch in slices(batches, "text"):
            words = folded(batch.column("text"))
            h = words.hashes()
            grams, places, reaches = [], [], []
            for k in sizes:
                gram = runs(h, k)
                at = np.minimum(np.searchsorted(known, gram), len(known) - 1)
                hit = np.flatnonzero((known[at] == gram) & (words.doc[k - 1 :] == words.doc[: len(gram)]))
                grams.append(gram[hit])
                places.append(hit)
                reaches.append(reach[at[hit]])
            gram, place, around = np.concatenate(grams), np.concatenate(places), np.concatenate(reaches)
            if not len(gram):
                continue
            owner = words.doc[place]
            low = np.maximum(place - around, words.bounds[owner])
            high = np.minimum(place + GRAM + around, words.bounds[owner + 1])
            by = np.argsort(low, kind="stable")
            gram, place, owner, low, high = gram[by], place[by], owner[by], low[by], high[by]
            upto = np.maximum.accumulate(high)
            begins = np.flatnonzero(np.concatenate([[True], low[1:] >= upto[:-1]]))
            ends = np.append(begins[1:], len(gram))
            at = [low[a] for a in begins.tolist()]
            bodies = [h[low[a] : upto[b - 1]].tobytes() for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
            shift = np.repeat(low[begins], ends - begins)
            hits = pa.ListArray.from_arrays(pa.array(np.append(begins, len(gram)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(gram.view(np.int64)), pa.array(place - shift)], ["gram", "place"]))
            rows = pa.array(owner[begins])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows), batch.column("of").take(rows), pa.array(at - words.bounds[owner[begins]], pa.int64()), pa.array(bodies, pa.binary()), hits],
                names=["doc_id", "of", "start", "words", "hits"],
            )

    return docs.mapInArrow(find, f"doc_id {kind}, of long, start long, words binary, hits array<struct<gram: long, place: long>>")


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment scores and end positions in the passages, for a batch of pairs at once.

    Row by row over the item; within a row the running maximum of (score + position) gives runs of gaps at once.
    """
    n, m = max(map(len, items)), max(map(len, passages))
    count = len(items)
    x = np.zeros((count, n), np.uint64)
    y = np.zeros((count, m), np.uint64)
    has_x, has_y = np.zeros((count, n), bool), np.zeros((count, m), bool)
    for i, (a, b) in enumerate(zip(items, passages, strict=True)):
        x[i, : len(a)], has_x[i, : len(a)] = a, True
        y[i, : len(b)], has_y[i, : len(b)] = b, True
    row = np.zeros((count, m + 1), np.int32)
    best, end = np.zeros(count, np.int32), np.zeros(count, np.int64)
    steps = np.arange(m + 1, dtype=np.int32)
    for j in range(n):
        same = (y == x[:, j : j + 1]) & has_y & has_x[:, j : j + 1]
        new = np.zeros_like(row)
        new[:, 1:] = np.maximum(row[:, :-1] + np.where(same, MATCH, OTHER), row[:, 1:] + OTHER)
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new + steps, axis=1) - steps
        top = new.argmax(axis=1)
        score = new[np.arange(count), top]
        better = (score > best) & has_x[:, j]
        best[better], end[better] = score[better], top[better]
        row = np.where(has_x[:, j : j + 1], new, row)
    return best, end


def leaking_rows(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, of, item_id, score, word_end): pairs of a text and a test item that it holds; ``of`` is the text's 64-bit
    hash, word_end is where the best alignment ends in the text, in words."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("of", F.xxhash64("text"))
    items, grams = item_rows(benchmark, item_id, item_text)
    blocks = max(1, -(-grams.count() // BLOCK_GRAMS))
    mine = lambda rows, block: rows.filter(F.pmod("item", F.lit(blocks)) == block)
    found = _leaks_of(own, mine(items, 0), mine(grams, 0), min_score)
    for block in range(1, blocks):
        found = found.unionByName(_leaks_of(own, mine(items, block), mine(grams, block), min_score))
    return found


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, word_end): pairs of a document and a test item that it holds, with the best score."""
    rows = leaking_rows(docs, benchmark, min_score, doc_id, text, item_id, item_text)
    return rows.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "word_end")).alias("best")).select("doc_id", "item_id", "best.score", "best.word_end")


def _leaks_of(own: DataFrame, items: DataFrame, grams: DataFrame, min_score: float) -> DataFrame:
    # a block's n-grams are few by BLOCK_GRAMS, whatever the number of documents: 16 bytes each come here as one table
    seeds = grams.groupBy("gram").agg(F.max("n").alias("n")).toArrow()
    known, longest = seeds.column("gram").to_numpy().view(np.uint64), seeds.column("n").to_numpy()
    if not len(known):
        known, longest = np.zeros(1, np.uint64), np.zeros(1, np.int64)
    doc_kind, item_kind = own.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    sizes = sorted(r[0] for r in grams.select(F.least("n", F.lit(GRAM))).distinct().collect()) or [GRAM]
    passages = written(_passages(own, known, longest, sizes), "passages")
    hits = passages.select("doc_id", "of", "start", F.explode("hits").alias("hit")).select("doc_id", "of", "start", "hit.gram", "hit.place")
    held = hits.groupBy("gram").agg(F.count("*").alias("rows"))
    known_items = written(grams.groupBy("gram").agg(F.collect_list(F.struct("item", "at")).alias("found")).join(held, "gram"), "seeds")
    met = spread_join(hits, known_items, ["gram"], "rows", ["doc_id", "of", "start", "place"])
    pairs = met.select("doc_id", "of", "start", "place", F.explode("found").alias("found")).groupBy("doc_id", "of", "start", "found.item")
    pairs = pairs.agg(F.min(F.col("place") - F.col("found.at")).alias("low"), F.max(F.col("place") - F.col("found.at")).alias("high"))
    key = F.struct("doc_id", "of", "start")
    work = pairs.select(key.alias("key"), "item", "low", "high").join(items.select("item", "item_id", F.col("words").alias("item_words")), "item")
    # structs compare null-safe inside, so a null id meets itself
    work = work.join(passages.select(key.alias("key"), "words"), "key")
    work = work.select("key.doc_id", "key.of", "key.start", "item_id", "low", "high", F.col("item_words").alias("item"), "words")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, items, texts, shifts = [], [], [], []
            for i, (low, high, item, words) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("low", "high", "item", "words")), strict=True)):
                item, words = np.frombuffer(item, np.uint64), np.frombuffer(words, np.uint64)
                a = max(0, low - len(item))
                near = words[a : high + 2 * len(item)]
                if np.isin(item, near).sum() / len(item) < min_score:  # all its matches would not do
                    continue
                rows.append(i)
                items.append(item)
                texts.append(near)
                shifts.append(a)
            if not rows:
                continue
            batch = batch.take(pa.array(rows))
            best, end = np.zeros(len(items)), np.zeros(len(items), np.int64)
            order = sorted(range(len(items)), key=lambda i: (len(items[i]), len(texts[i])))
            at = 0
            while at < len(order):  # pairs of like size together, about 2**21 cells of a matrix row at once
                longest, upto = 0, at
                while upto < len(order) and (upto - at + 1) * max(longest, len(texts[order[upto]])) <= 1 << 18 or upto == at:
                    longest = max(longest, len(texts[order[upto]]))
                    upto += 1
                some = order[at:upto]
                best[some], end[some] = align([items[i] for i in some], [texts[i] for i in some])
                at = upto
            share = best / np.array([MATCH * len(i) for i in items])
            keep = np.flatnonzero(share >= min_score)
            word_end = np.array(batch.column("start").to_numpy()) + np.array(shifts) + end
            keep_ = pa.array(keep)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(keep_) for c in ("doc_id", "of", "item_id")), pa.array(share[keep]), pa.array(word_end[keep], pa.int64())], names=["doc_id", "of", "item_id", "score", "word_end"])

    return work.mapInArrow(score, f"doc_id {doc_kind}, of long, item_id {item_kind}, score double, word_end long")


def remove_leaks(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds a test item; other rows of the same id stay."""
    leaked = leaking_rows(docs, benchmark, min_score, doc_id, text).select(F.struct("doc_id", "of").alias("leaked")).distinct()
    return docs.join(leaked, F.struct(docs[doc_id], F.xxhash64(docs[text])).eqNullSafe(leaked["leaked"]), "left_anti")
