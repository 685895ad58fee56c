"""Operator 8: n-gram Jaccard join by a prefix tree over globally ordered shingle sets.

1. Each text becomes its set of word-shingle hashes (64 bit). Equal sets (by size and two 64-bit sums) are one class;
   the smallest id stands for it.
2. Sets of like size are cut by a hash of the shingles into more segments than they can differ in shingles, so two
   similar sets agree wholly in one segment at least (pigeonhole). A row for each segment, with a hash of its
   shingles, is all that is shuffled. Agreeing on an empty segment says nothing: a set with more filled segments than
   it can differ in shingles agrees with every similar set in a filled one; the rare others add their prefix shingles
   under each empty segment's number, so that two of those meet there. No link depends on chance, whatever the sizes,
   but for collisions of 64-bit hashes. Common shingles make no two sets meet unless a whole segment is alike.
3. Sets that share a segment are tied to the smallest there, and the connected components of these ties are blocks:
   similar sets are always in one block. A task ties what it has met itself and passes on one row for each segment it
   knows, so a group of copies of any size is spread over all tasks.
4. In a block the whole sets go into a prefix tree, frequent shingles first. A set walks the tree with the overlap it
   shares so far; subtrees are pruned by set size, by the overlap that the remaining lengths allow, and where all
   sets below are already in its component. A union-find over the links gives the components.
5. A block of more than ``most`` shingles or PART_SETS sets is blocked anew by the rarest shingles of its sets. What
   is still larger is dealt into parts, each joined alone; then one set for each component is joined among them, and
   only while a block still has several components, all pairs of its parts are joined.

Defined results: null or wordless text has an empty set and no links; shorter texts than the shingle have their whole
sequence as one; repeated rows are equal sets; a repeated doc_id gets a row for each of its rows; a null doc_id
takes no part in links; other columns are ignored; an empty table stays empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirelake.llm._spark import components, spread_join, written
from quirelake.llm._text import Words, distinct_by_text, large_binary, mix, shingles, slices, utf8

#: Shingles of a part of a block that one task joins.
PART_SHINGLES = 4_000_000
PART_SETS = 2_000
#: Size classes grow by this, or by a little more than 1 / threshold if that is more.
GROWTH = 1.3
#: How many segments more than differences a set should fill on average, and how many at most it is cut into.
SPARE, MOST_SEGMENTS = 1.03, 1.7
#: Signatures that a task gathers before it ties and passes them on.
GATHER = 1_000_000


def text_sets(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in a row, and offsets."""
    data, offsets = utf8(batch.column("text"))
    h, doc = shingles(Words(data, offsets), k)
    return distinct_by_text(h, doc, batch.num_rows)


def _prints(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that stand for each set."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h ^ np.uint64(salt)), out=sums[1:], dtype=np.uint64)
        out.append((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def size_classes(most: int, t: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower ends of the classes of set sizes up to ``most``, in how many shingles their sets can differ, and their
    numbers of segments. Sets of n and m with Jaccard >= t differ in at most (1 - t) / (1 + t) * (n + m) shingles.
    Classes grow by no less than 1 / t, so that partners are in one class or in neighbours; segments are so many
    that few sets, down to the smallest that join a class from below, fill no more than they can differ in."""
    lows, growth = [1], max(GROWTH, 1.04 / t)
    while lows[-1] <= most:
        lows.append(max(lows[-1] + 1, math.ceil(lows[-1] * growth)))
    lows.append(max(lows[-1] + 1, math.ceil(lows[-1] * growth)))
    differ = [int((1 - t) / (1 + t) * 2 * (high - 1)) for high in lows[1:]]
    segments = []
    for low, d in zip(lows[:-1], differ, strict=True):
        n, smallest = d + 1, math.ceil(low * t)
        while d and n < MOST_SEGMENTS * (d + 1) and n * (1 - (1 - 1 / n) ** smallest) < SPARE * (d + 1) + 1:
            n += max(1, d // 50)
        segments.append(n)
    return np.array(lows[:-1]), np.array(differ), np.array(segments)


def signatures(h: np.ndarray, bounds: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set number): sets of Jaccard >= t share one signature at least."""
    sizes = np.diff(bounds)
    lows, differ, segments = size_classes(int(sizes.max(initial=1)), t)
    own = np.searchsorted(lows, sizes, side="right") - 1
    following = np.minimum(own + 1, len(lows) - 1)
    # the smaller set of a pair may be of the class below: near its upper end it joins the next class too
    up = (sizes > 0) & (following > own) & (sizes * t.denominator >= lows[following] * t.numerator)
    place, value = (mix(h ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(33)).astype(np.int64), mix(h ^ np.uint64(0xE7037ED1A0B428DB))
    out, of = [], []
    for cls, chosen in ((own, sizes > 0), (following, up)):
        who = np.flatnonzero(chosen)
        if not len(who):
            continue
        n = sizes[who]
        at = np.repeat(bounds[:-1][who] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        count = segments[cls[who]]
        first = np.cumsum(count) - count
        cell = np.repeat(first, n) + place[at] % np.repeat(count, n)
        total, filled = np.zeros(int(count.sum()), np.uint64), np.zeros(int(count.sum()), bool)
        np.add.at(total, cell, value[at])
        filled[cell] = True
        owner = np.repeat(np.arange(len(who)), count)
        number = np.arange(len(owner)) - first[owner]
        tag = mix(cls[who][owner].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + number.astype(np.uint64))
        out.append(mix(total[filled] + tag[filled]))
        of.append(who[owner[filled]])
        short = np.bincount(owner[filled], minlength=len(who)) <= differ[cls[who]]
        for empty in np.flatnonzero(~filled & short[owner]).tolist():
            i = int(who[owner[empty]])
            prefix = int(sizes[i]) - -(-int(sizes[i]) * t.numerator // t.denominator) + 1
            out.append(mix(h[bounds[i] : bounds[i] + prefix] ^ mix(tag[empty : empty + 1] + np.uint64(1))))
            of.append(np.full(prefix, i))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(of)


def _texts(docs: DataFrame, k: int) -> DataFrame:
    """(id, n, p0, p1) of each text: its set's size and the two sums that stand for the set."""
    kind = docs.schema["id"].dataType.simpleString()

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            h, bounds = text_sets(batch, k)
            p0, p1 = _prints(h, bounds)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(bounds).astype(np.int64)), pa.array(p0), pa.array(p1)], names=["id", "n", "p0", "p1"])

    return docs.select("id", "text").mapInArrow(summarise, f"id {kind}, n long, p0 long, p1 long")


def _tied(signature: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct signatures, the least name of each, names that share one with a lesser name, those lesser names)."""
    order = np.lexsort((name, signature))
    signature, name = signature[order], name[order]
    new = np.ones(len(signature), bool)
    new[1:] = signature[1:] != signature[:-1]
    least = name[new][np.cumsum(new) - 1]
    pairs = np.unique(np.stack([name, least], axis=1)[name != least], axis=0)
    return signature[new], name[new], pairs[:, 0], pairs[:, 1]


def _tie(rows: DataFrame) -> DataFrame:
    """(a, b): names of rows (signature, name) that share a signature, each with the least name there. Rows are read in
    order, so a task holds a batch and one signature's least name, however many rows share it."""

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            signature, name = batch.column("signature").to_numpy(), batch.column("name").to_numpy()
            new = np.ones(len(signature), bool)
            new[1:] = signature[1:] != signature[:-1]
            least = name[new][np.cumsum(new) - 1]
            if last is not None and signature[0] == last:
                least[signature == last] = first
            last, first = signature[-1], least[-1]
            some = name != least
            pairs = np.unique(np.stack([name[some], least[some]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return rows.repartition("signature").sortWithinPartitions("signature", "name").mapInArrow(tie, "a long, b long")


def _passed(signature: np.ndarray, name: np.ndarray) -> pa.RecordBatch:
    """Rows (signature, name): one for each signature, with its least name, and two for each name tied to a lesser one,
    under a signature of their own."""
    signature, least, a, b = _tied(signature, name)
    own = mix(mix(a.view(np.uint64)) + b.view(np.uint64))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([signature.view(np.int64), own.view(np.int64), own.view(np.int64)])), pa.array(np.concatenate([least, a, b]))], names=["signature", "name"])


def _met(rows: DataFrame) -> DataFrame:
    """Rows (signature, name) tied among themselves a batch at a time, so that a signature is passed on once a batch."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _passed(batch.column("signature").to_numpy(), batch.column("name").to_numpy())

    return rows.mapInArrow(meet, "signature long, name long")


def _ties(docs: DataFrame, k: int, t: Fraction) -> DataFrame:
    """(a, b): names (p0) of sets that share a segment, each tied to the least name there. p0 is only a 64-bit name:
    two sets under one would share a block, no more."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def passed() -> pa.RecordBatch:
            return _passed(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))

        for batch in slices(batches, "text", 1 << 20):
            h, bounds = text_sets(batch, k)
            p0, _ = _prints(h, bounds)
            _, first = np.unique(p0, return_index=True)
            sizes = np.zeros(len(p0), np.int64)
            sizes[first] = np.diff(bounds)[first]
            signature, of = signatures(h[np.repeat(sizes > 0, np.diff(bounds))], np.concatenate([[0], np.cumsum(sizes)]), t)
            held.append((signature, p0[of]))
            if sum(len(x) for x, _ in held) > GATHER:
                yield passed()
                held = []
        if held:
            yield passed()

    rows = docs.filter("id is not null").select("text").mapInArrow(gather, "signature long, name long")
    return _tie(rows)


class Node:
    __slots__ = ("children", "least", "members", "most", "segment", "uniform")

    def __init__(self, segment: np.ndarray, size: int):
        self.segment, self.children, self.members = segment, {}, []
        self.least = self.most = size
        self.uniform = -1  # a set below, if all sets below are in one component


def trie_components(sets: list[np.ndarray], t: Fraction) -> list[int]:
    """For each set (distinct sets of hashes) the smallest position that links of Jaccard >= t reach."""
    parent = list(range(len(sets)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    values, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(values))  # frequent first: long shared paths
    cuts = np.cumsum([len(s) for s in sets])[:-1]
    ordered = [np.sort(x) for x in np.split(rank[inverse], cuts)]
    mark = np.zeros(len(values), np.int8)
    root = Node(np.zeros(0, np.int64), 0)
    root.least, root.most = 1 << 62, 0
    num, den = t.numerator, t.denominator
    for i in sorted(range(len(sets)), key=lambda j: len(ordered[j])):
        own = ordered[i]
        n = len(own)
        mark[own] = 1
        low = -(-n * num // den)
        stack = [(c, 0, 0) for c in root.children.values()]
        while stack:
            node, depth, shared = stack.pop()
            if node.most < low:  # all sets here are no longer than this one, as sizes ascend
                continue
            if node.uniform >= 0 and find(node.uniform) == find(i):
                continue
            least = max(node.least, low)
            need = -(-(least + n) * num // (num + den))
            depth += len(node.segment)
            shared += int(mark[node.segment].sum())
            # what is left of either set bounds the overlap to come
            rest = min(node.most - depth, n - int(np.searchsorted(own, node.segment[-1], side="right")))
            if shared + rest < need:
                continue
            for j in node.members:
                if find(j) != find(i) and (num + den) * shared >= num * (len(ordered[j]) + n):
                    a, b = sorted((find(i), find(j)))
                    parent[b] = a
            stack.extend((c, depth, shared) for c in node.children.values())
        mark[own] = 0
        _insert(root, own, i, find)
    return [find(i) for i in range(len(sets))]


def _insert(root: Node, own: np.ndarray, i: int, find) -> None:
    node, at, n = root, 0, len(own)
    while True:
        node.least, node.most = min(node.least, n), max(node.most, n)
        if node is not root and node.uniform >= 0 and find(node.uniform) != find(i):
            node.uniform = -1
        if at == n:
            node.members.append(i)
            return
        child = node.children.get(int(own[at]))
        if child is None:
            leaf = Node(own[at:], n)
            leaf.members.append(i)
            leaf.uniform = i
            node.children[int(own[at])] = leaf
            return
        m = min(len(child.segment), n - at)
        differ = np.flatnonzero(child.segment[:m] != own[at : at + m])
        same = int(differ[0]) if len(differ) else m
        if same < len(child.segment):  # part the edge
            upper = Node(child.segment[:same], child.least)
            upper.most, upper.uniform = child.most, child.uniform
            child.segment = child.segment[same:]
            upper.children[int(child.segment[0])] = child
            node.children[int(own[at])] = upper
            child = upper
        node, at = child, at + same


def _sets_of(docs: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(id, block, n, parts, grams): the members with their sets, written once; texts move once."""
    kind = docs.schema["id"].dataType.simpleString()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            h, bounds = text_sets(batch, k)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "block", "n", "parts")), large_binary(h, bounds)], names=["id", "block", "n", "parts", "grams"])

    # by a merge join at every size: which side is small depends on how many texts have partners
    rows = docs.hint("merge").join(members, "id").select("id", "block", "n", "parts", "text")
    return written(rows.mapInArrow(sets, f"id {kind}, block long, n long, parts long, grams binary"), "sets")


def _join_parts(parts: DataFrame, t: Fraction) -> DataFrame:
    """Links (a, b) that span the components within each part; ``parts``: (id, part, grams). One row a part gathers
    its sets, of which a part has at most PART_SHINGLES shingles (or two parts' worth)."""
    kind = parts.schema["id"].dataType.simpleString()

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for members in batch.column("members"):
                rows = sorted(members.as_py(), key=lambda r: r["id"])
                found = trie_components([np.frombuffer(r["grams"], np.uint64) for r in rows], t)
                for i, j in enumerate(found):
                    if i != j:
                        a.append(rows[i]["id"])
                        b.append(rows[j]["id"])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    grouped = parts.groupBy("part").agg(F.collect_list(F.struct("id", "grams")).alias("members"))
    return grouped.select("members").mapInArrow(link, f"a {kind}, b {kind}")


def jaccard_components(docs: DataFrame, k: int = 3, threshold: Fraction = Fraction(9, 10), most: int = PART_SHINGLES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row; component_id is the smallest doc_id that links reach."""
    own = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    texts = written(_texts(own, k), "texts")
    classes = texts.filter("id is not null and n > 0").groupBy("n", "p0", "p1").agg(F.min("id").alias("rep"))
    classes = written(classes, "classes")
    blocks = components(_ties(own, k, threshold)).select(F.col("id").alias("p0"), F.col("component_id").alias("block"))
    members = classes.join(blocks, "p0").groupBy(F.col("rep").alias("id"), "block").agg(F.max("n").alias("n"))
    sets = _sets_of(own, _dealt(members, most), k)
    links = written(_join_parts(_parts(sets.filter("parts = 1")), threshold), "links")
    sets = sets.filter("parts > 1").select("id", "n", "grams")
    if not sets.isEmpty():
        large = written(_dealt(_tighter(sets, threshold), most), "large")
        links = written(links.unionByName(_join_parts(_parts(large, sets), threshold)), "links")
        large = large.filter("parts > 1")
        if not large.isEmpty():
            links = _join_large(sets, large, links, threshold, most)

    found = components(links) if not links.isEmpty() else links.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    # an id's class, then the component of the class: both tables are keyed by id
    rep = texts.filter("id is not null and n > 0").join(classes.select("n", "p0", "p1", "rep"), ["n", "p0", "p1"]).select("id", "n", "p0", "p1", "rep")
    merged = rep.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("id", "n", "p0", "p1", F.coalesce("component_id", "rep").alias("component_id"))
    empty = texts.filter("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"))
    return merged.select("id", "n", "component_id").unionByName(empty).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def _dealt(members: DataFrame, most: int) -> DataFrame:
    """Adds ``parts`` to (id, block, n): into how many parts the block is dealt."""
    parts = F.greatest(F.ceil(F.sum("n") / F.lit(most)), F.ceil(F.count("*") / F.lit(PART_SETS))).cast("long")
    return members.join(members.groupBy("block").agg(parts.alias("parts")), "block").select("id", "block", "n", "parts")


def _parts(members: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """(id, part, grams): each block's sets dealt into its parts; ``sets`` has the grams where ``members`` has not."""
    rows = members if sets is None else members.join(sets.select("id", "grams"), "id")
    return rows.select("id", F.concat_ws("/", "block", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("part"), "grams")


def _tighter(sets: DataFrame, t: Fraction) -> DataFrame:
    """Smaller blocks (id, block, n) for the sets of large ones, by their rarest shingles.

    Shingles are counted over these sets; one that a single set holds links nothing. A set of n with r shared
    shingles has a link only if it shares one of its r - ceil(t * n) + 1 rarest, so passages that many texts share
    count only where little else is in a text. Sets meet within a size class and the next, and a set's place in each
    class is a node of its own: blocks do not grow together over sizes."""
    kind = sets.schema["id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                grams = [np.frombuffer(g.as_py(), np.int64) for g in some.column("grams")]
                counts = np.array([len(g) for g in grams])
                chosen = np.repeat(np.arange(some.num_rows), counts)
                yield pa.RecordBatch.from_arrays([some.column("id").take(pa.array(chosen)), pa.array(np.concatenate(grams))], names=["id", "gram"])

    grams = sets.select("id", "grams").mapInArrow(rows, f"id {kind}, gram long")
    held = written(grams.groupBy("gram").agg(F.count("*").alias("held")).filter("held > 1"), "held")
    shared = spread_join(grams, held.withColumn("rows", F.col("held")), ["gram"], "rows", ["id"])
    need = F.ceil(F.col("n") * F.lit(t.numerator) / F.lit(t.denominator) - F.lit(1e-9))
    rank = F.row_number().over(W.partitionBy("id").orderBy("held", "gram"))
    ranked = shared.select("id", "gram", rank.alias("rank"), F.count("*").over(W.partitionBy("id")).alias("r"))
    keys = ranked.join(sets.select("id", "n"), "id").filter(F.col("rank") <= F.col("r") - need + 1)
    # classes are a little wider than 1 / t, so the partners of a set are in its own class or a neighbour
    size_class = F.floor(F.log("n") / F.lit(1.0001 * max(math.log(t.denominator / t.numerator), 1e-3)))
    placed = keys.select("id", "n", "gram", F.explode(F.array(size_class, size_class + 1)).alias("class"))
    nodes = written(placed.select("id", "n", F.xxhash64("id", "class").alias("name"), F.xxhash64("gram", "class").alias("signature")), "places")
    # a task's own rows of a signature become one first: a name and its signature's least name there
    found = components(_tie(_met(nodes.select("signature", "name")))).select(F.col("id").alias("name"), F.col("component_id").alias("block"))
    return nodes.select("id", "n", "name").distinct().join(found, "name").select("id", "block", "n").distinct()


def _join_large(sets: DataFrame, large: DataFrame, links: DataFrame, t: Fraction, most: int) -> DataFrame:
    """More links for blocks in several parts: among one set of each component, then between all parts of a block
    that is still in several components."""
    for last in (False, True):
        labels = large.join(components(links), "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))
        several = labels.groupBy("block").agg(F.min("component_id").alias("x"), F.max("component_id").alias("y")).filter("x <> y").select("block")
        open_ = written(labels.join(several, "block"), "open")
        if open_.isEmpty():
            return links
        if not last:
            heads = open_.groupBy("block", "component_id").agg(F.min(F.struct("id", "n")).alias("head")).select("head.id", "block", "head.n")
            parts = _parts(_dealt(heads, most), sets)
        else:
            mine = F.pmod(F.xxhash64("id"), F.col("parts"))
            other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
            pair = open_.select("id", "block", mine.alias("mine"), other.alias("other"))
            part = F.concat_ws("/", "block", F.least("mine", "other"), F.greatest("mine", "other"))
            parts = pair.select("id", part.alias("part")).join(sets.select("id", "grams"), "id")
        links = written(links.unionByName(_join_parts(parts, t)), "links")
    return links

