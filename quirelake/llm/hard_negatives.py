"""Operator 13: hard negatives from Hilbert-ordered Parquet blocks with per-dimension zone maps.

Vectors of integers are put in the order of a Hilbert curve inside their label and written as Parquet, a row for each block
of ``BLOCK`` vectors and a folder for each range of the order, with the smallest and largest value of every dimension
beside it: the zone map. Interval arithmetic over a zone gives the least and the largest inner product that an anchor can
have with any row of the block, so a block is read for an anchor only if one of the anchor's score windows can hold one of
its rows. A search reads in two steps: first the few blocks with the highest bounds, whose best rows tighten each window
from below (ties included: a block that can only tie is read if it holds a smaller id), then all blocks that may still
hold a better row. The result is exact. Anchors are packed in groups of neighbours on the curve, so a group's blocks
are read once for all its anchors, and only folders that hold a wanted block are read.

Positives are one search (own label, all scores), negatives another (other labels, a window for each positive). Anchors
meet zones, which are ``BLOCK`` times fewer than rows, and then the blocks they need; equal vectors, whatever their number,
fill blocks of their own. What is wanted is kept as pairs of names with a bit for each anchor; vectors and windows are not
repeated in it but dealt once for each tile, a part of the groups by a part of the blocks. A task holds a tile's groups and takes
its blocks one by one; it keeps the best ``k`` rows of each window it meets, never all scores. Tables that grow with the rows are
joined by sorting, as the size of their files says little of their rows: nothing that grows goes through the driver.

Defined results: rows with a null id, label or vector, an empty vector or a null component take no part; repeated rows and ids are rows of their own, but no
row with the anchor's id is its positive; vectors of different lengths never meet; ties go to the smaller id; a positive
with a negative score has an empty window; an anchor without positives, or a positive without negatives, gives no row; an
empty table gives none; other columns are ignored, whatever their names. Scores are exact; one beyond 64 bits is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirelake.llm._spark import new_folder, written

#: Vectors of a block, anchors of a group, zones that a group meets at a time, blocks read first for each of them.
BLOCK, GROUP, ZONES, SEEDS = 256, 64, 256, 2
#: Groups of a tile, blocks at most, and tiles for each core where there are blocks enough.
TILE_GROUPS, TILE_BLOCKS, TILES = 64, 256, 8
#: Bits of the curve for each dimension, over the mean and SPREAD deviations to both sides; what lies outside counts as the edge.
BITS, SPREAD = 4, 3.0
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Windows whose best rows a task keeps before it hands them on.
KEPT = 100_000


def quantised(rows: DataFrame, scale: int = 256, vector: str = "embedding", label: str = "label") -> DataFrame:
    """The rows whose label and vector are not null and whose components are all finite, with floor(scale * x) for each."""
    sound = F.col(label).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(sound).withColumn(vector, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of rows of integers below 2**bits, as bytes that sort like them (rows x bytes)."""
    axes = [cells[:, d].astype(np.int64) for d in range(cells.shape[1])]
    for b in range(bits - 1, 0, -1):  # turn each sub-cube back, the largest first
        below = (1 << b) - 1
        for d in range(len(axes)):
            flips = (axes[d] >> b & 1).astype(bool)
            swap = np.where(flips, 0, (axes[0] ^ axes[d]) & below)
            axes[0] = axes[0] ^ np.where(flips, below, swap)
            axes[d] = axes[d] ^ (swap if d else 0)
    for d in range(1, len(axes)):
        axes[d] = axes[d] ^ axes[d - 1]
    turn = np.zeros(len(cells), np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(axes[-1] >> b & 1, (1 << b) - 1, 0)
    planes = [(axis ^ turn) >> b & 1 for b in range(bits - 1, -1, -1) for axis in axes]
    return np.packbits(np.array(planes, np.uint8).T, axis=1)


def _flat(col: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a column of lists without nulls."""
    offsets = np.asarray(col.offsets)
    return np.asarray(col.values)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _keyed(rows: DataFrame, centre: float, step: float) -> DataFrame:
    """The rows with their place on the curve; vectors of each length have a curve of their own."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = _flat(batch.column("vector"))
            sizes, keys = np.diff(offsets), [b""] * batch.num_rows
            for n in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == n)
                cells = values[offsets[at][:, None] + np.arange(n)]
                cells = np.clip(np.floor((cells - centre) / step) + (1 << BITS - 1), 0, (1 << BITS) - 1).astype(np.int64)
                for i, key in zip(at.tolist(), hilbert_keys(cells), strict=True):
                    keys[i] = key.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=[*batch.schema.names, "place"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(keyed, f"{kinds}, place binary")


def _packed(rows: DataFrame, size: int, width: str) -> DataFrame:
    """Rows in the order of (dim, label, place) as blocks of at most ``size`` with their zones; ``shelf`` is the range."""
    kind = rows.schema["label"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf, made, held, held_key = TaskContext.get().partitionId(), 0, [], None

        def full(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal held, made
            if not held:
                return
            ids, cells = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            at = 0
            while len(ids) - at >= least and at < len(ids):
                some = slice(at, at + size)
                order = np.argsort(ids[some], kind="stable")
                part, own = cells[some][order], ids[some][order]
                lists = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (part.min(axis=0), part.max(axis=0), own)]
                heads = [pa.array([(shelf << 32) + made]), pa.array([shelf], pa.int32()), pa.array([held_key[0]], pa.int32()), held_key[1], pa.array([len(own)], pa.int32()), pa.array(own[:1])]
                yield pa.RecordBatch.from_arrays([*heads, *lists, pa.array([part.astype(width).tobytes()], pa.binary())], names=["block", "shelf", "dim", "label", "n", "first", "lo", "hi", "ids", "body"])
                made += 1
                at += size
            held = [(ids[at:], cells[at:])] if at < len(ids) else []

        for batch in batches:
            if not batch.num_rows:
                continue
            values, offsets = _flat(batch.column("vector"))
            dims, labels, ids = batch.column("dim").to_pylist(), batch.column("label").to_pylist(), batch.column("id").to_numpy()
            edges = [0, *(i for i in range(1, len(ids)) if dims[i] != dims[i - 1] or labels[i] != labels[i - 1]), len(ids)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                key = (dims[a], batch.column("label").slice(a, 1))
                if held_key is None or key[0] != held_key[0] or key[1] != held_key[1]:
                    yield from full(1)
                    held_key = key
                held.append((ids[a:b], values[offsets[a] : offsets[b]].reshape(b - a, dims[a])))
                yield from full(size)
        yield from full(1)

    lists = ", ".join(f"{x} array<long>" for x in ("lo", "hi", "ids"))
    ordered = rows.repartitionByRange("dim", "label", "place", "id").sortWithinPartitions("dim", "label", "place", "id")
    return ordered.mapInArrow(pack, f"block long, shelf int, dim int, label {kind}, n int, first long, {lists}, body binary")


WINDOW = "array<struct<a:int,w:int,low:long,high:long,upto:long>>"


def _met(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """The join of two tables that grow with the rows; neither is sent to the driver."""
    return left.join(right.hint("merge"), on, how)


def _asking(groups: DataFrame, windows: DataFrame) -> DataFrame:
    """(group, own, own_dim, n, ids, body, windows) of each group whose anchors have windows."""
    of_group = windows.groupBy("group").agg(F.collect_list(F.struct("a", "w", "low", "high", "upto")).alias("windows"))
    return _met(groups.select(F.col("block").alias("group"), F.col("label").alias("own"), F.col("dim").alias("own_dim"), "n", "ids", "body"), of_group, "group")


def _wanted(own: DataFrame, zones: DataFrame, same: bool, width: str, seeds: int | None) -> DataFrame:
    """(block, shelf, group, members) of each block that a window of the group's anchors can need, with a bit for each anchor: of all
    such blocks, or the ``seeds`` with the highest bounds among the zones that a group meets at a time."""
    parts = -(-zones.count() // ZONES) or 1
    zone = F.struct("block", "shelf", "dim", "label", "first", "lo", "hi")
    laid = zones.select(F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("part"), zone.alias("zone")).groupBy("part").agg(F.collect_list("zone").alias("zones"))
    met = _met(own.drop("ids").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), laid, "part")

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _single(batches):
            dim, label, n = batch.column("own_dim")[0].as_py(), batch.column("own")[0], batch.column("n")[0].as_py()
            zone = batch.column("zones").flatten()
            fits = np.array([x == label for x in zone.field("label")]) == same
            fits &= zone.field("dim").to_numpy() == dim
            at = np.flatnonzero(fits)
            if not len(at):
                continue
            zone = zone.take(pa.array(at))
            anchors = np.frombuffer(batch.column("body")[0].as_buffer(), width).reshape(n, dim)
            most, least = bounds(anchors, *(_flat(zone.field(x))[0].reshape(-1, dim) for x in ("lo", "hi")))
            first = zone.field("first").to_numpy()
            needed = np.zeros(most.shape, bool)
            asked = batch.column("windows").flatten()
            a, low, high, upto = (asked.field(x).to_numpy() for x in ("a", "low", "high", "upto"))
            for i in range(0, len(a), 1024):
                some = slice(i, i + 1024)
                reached = (most[a[some]] > low[some, None]) | (most[a[some]] == low[some, None]) & (first[None, :] <= upto[some, None])
                np.logical_or.at(needed, a[some], reached & (least[a[some]] <= high[some, None]))
            if seeds is not None and needed.shape[1] > seeds:
                ranked = np.where(needed, most.astype(float), -np.inf)
                top = np.argpartition(-ranked, seeds, axis=1)[:, :seeds]
                chosen = np.zeros_like(needed)
                np.put_along_axis(chosen, top, True, axis=1)
                needed &= chosen
            used = np.flatnonzero(needed.any(axis=0))
            if len(used):
                of_zone = zone.take(pa.array(used))
                members = pa.array([x.tobytes() for x in np.packbits(needed[:, used].T, axis=1)], pa.binary())
                group = pa.array(np.full(len(used), batch.column("group")[0].as_py()))
                yield pa.RecordBatch.from_arrays([of_zone.field("block"), of_zone.field("shelf"), group, members], names=["block", "shelf", "group", "members"])

    return written(met.mapInArrow(reach, "block long, shelf int, group long, members binary"), "wanted-blocks")


def _tiled(wanted: DataFrame, blocks: DataFrame, own: DataFrame) -> DataFrame:
    """The wanted pairs dealt by tile, each tile's groups first (kind 0: key, ids, body, windows), then the pairs (1: key, other, body: the
    bits), then its blocks (2: key, ids, body), each once."""
    cores = wanted.sparkSession.sparkContext.defaultParallelism
    n_groups, n_blocks = wanted.agg(F.approx_count_distinct("group"), F.approx_count_distinct("block")).first()
    across = -(-n_groups // TILE_GROUPS) or 1
    down = max(-(-n_blocks // TILE_BLOCKS), min(-(-TILES * cores // across), n_blocks), 1)
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    pairs = wanted.select(part("group", across).alias("g"), part("block", down).alias("z"), "block", "group", "members")
    null = lambda kind: F.lit(None).cast(kind)
    held = _met(pairs.select("g", "z", "group").distinct(), own.select("group", "ids", "body", "windows"), "group")
    taken = _met(pairs.select("g", "z", "block").distinct(), blocks.select("block", "ids", "body"), "block")
    laid = held.select("g", "z", F.lit(0).alias("kind"), F.col("group").alias("key"), null("long").alias("other"), "ids", "body", "windows")
    laid = laid.union(pairs.select("g", "z", F.lit(1), "block", "group", null("array<long>"), "members", null(WINDOW)))
    laid = laid.union(taken.select("g", "z", F.lit(2), "block", null("long"), "ids", "body", null(WINDOW)))
    n_parts = min(across * down, max(TILES * cores, int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return laid.repartition(n_parts, "g", "z").sortWithinPartitions("g", "z", "kind", "key")


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1)


def _numbers(x: np.ndarray, most: int) -> np.ndarray:
    """In the fastest type whose sums of products stay exact if no component is above ``most``."""
    return x.astype(float if most * most * x.shape[1] < 1 << 53 else object)


def _largest(*arrays: np.ndarray) -> int:
    return max((max(int(x.max()), -int(x.min())) for x in arrays if x.size), default=0)


def _exact(x: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """Vectors as they are, their largest component, and the same as floats."""
    return x, _largest(x), x.astype(float)


def _scores(anchors: tuple, members: np.ndarray, block: tuple) -> np.ndarray:
    """Inner products of some of the anchors with all rows of a block: of floats where their sums stay exact."""
    size = max(anchors[1], block[1])
    if size * size * block[0].shape[1] < 1 << 53:
        return anchors[2][members] @ block[2].T
    return _numbers(anchors[0][members], size) @ _numbers(block[0], size).T


def bounds(anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest and least inner products of each anchor with any vector inside each zone."""
    size = _largest(anchors, lo, hi)
    a, lo, hi = _numbers(anchors, size), _numbers(lo, size), _numbers(hi, size)
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return up @ hi.T + down @ lo.T, up @ lo.T + down @ hi.T


def _best(wanted: DataFrame, blocks: DataFrame, own: DataFrame, k: int, same: bool, width: str) -> DataFrame:
    """(group, a, w, score, id, rank): the best ``k`` rows of each window in the wanted blocks, by score, then id."""
    shelves = [r["shelf"] for r in wanted.select("shelf").distinct().collect()]  # at most one for each range
    bodies = blocks.filter(F.col("shelf").isin(shelves))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
        tile, groups, asking = None, {}, {}
        for batch in _single(batches):
            g, z, kind, key, other = (batch.column(i)[0].as_py() for i in range(5))
            if (g, z) != tile:
                tile, groups, asking = (g, z), {}, {}
            if kind == 1:
                asking.setdefault(key, []).append((other, batch.column("body")[0].as_py()))
                continue
            ids = batch.column("ids").flatten().to_numpy()
            vectors = np.frombuffer(batch.column("body")[0].as_buffer(), width).reshape(len(ids), -1)
            if kind == 0:
                asked = batch.column("windows").flatten()
                a, w, low, high = (asked.field(x).to_numpy().copy() for x in ("a", "w", "low", "high"))
                keys = [(key, *x) for x in zip(a.tolist(), w.tolist(), strict=True)]
                for i, x in enumerate(keys):
                    if len(have := best.get(x, [])) == k:
                        low[i] = max(low[i], -have[-1][0])
                groups[key] = (ids, _exact(vectors), a, keys, low, high)
                continue
            block = _exact(vectors)
            for group, bits in asking[key]:
                anchor_ids, anchors, a, keys, low, high = groups[group]
                members = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=len(anchor_ids)))
                scores = _scores(anchors, members, block)
                place = np.full(len(anchor_ids), -1)
                place[members] = np.arange(len(members))
                at = np.flatnonzero(place[a] >= 0)
                at = at[scores.max(axis=1)[place[a[at]]] >= low[at]]
                of = place[a[at]]
                inside = (scores[of] >= low[at, None]) & (scores[of] <= high[at, None])
                if same:
                    inside &= anchor_ids[a[at], None] != ids[None, :]
                row, column = np.nonzero(inside)
                if not len(row):
                    continue
                got = scores[of[row], column].astype(np.int64)
                order = np.lexsort((ids[column], -got, row))
                row, column, got = row[order], column[order], got[order]
                keep = np.arange(len(row)) - np.searchsorted(row, row) < k
                for i, s, v in zip(at[row[keep]].tolist(), got[keep].tolist(), ids[column[keep]].tolist(), strict=True):
                    best.setdefault(keys[i], []).append((-s, v))
                for i in at[np.unique(row)].tolist():
                    have = best[keys[i]] = sorted(best[keys[i]])[:k]
                    if len(have) == k:
                        low[i] = max(low[i], -have[-1][0])
            if len(best) > KEPT:
                yield from handed(best)
                best = {}
        yield from handed(best)

    def handed(best: dict) -> Iterator[pa.RecordBatch]:
        rows = [(*key, -s, v) for key, found in best.items() for s, v in found]
        if rows:
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["group", "a", "w", "score", "id"])

    found = _tiled(wanted, bodies, own).mapInArrow(score, "group long, a int, w int, score long, id long")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("group", "a", "w").orderBy(F.desc("score"), "id")))
    return written(ranked.filter(F.col("rank") <= k), "best-rows")


def _search(groups: DataFrame, windows: DataFrame, zones: DataFrame, blocks: DataFrame, k: int, same: bool, width: str) -> DataFrame:
    """The best ``k`` rows of each window: seeds first, then all blocks that may hold a better row than theirs."""
    windows = written(windows.withColumn("upto", F.lit(MOST)), "windows")
    own = written(_asking(groups, windows), "asking-groups")
    seen = _best(_wanted(own, zones, same, width, SEEDS), blocks, own, k, same, width)
    worst = seen.filter(F.col("rank") == k).select("group", "a", "w", "score", "id")
    tight = _met(windows, worst, ["group", "a", "w"], "left").select("group", "a", "w", F.coalesce("score", "low").alias("low"), "high", F.coalesce("id", "upto").alias("upto"))
    own = written(_asking(groups, tight), "asking-groups")
    return _best(_wanted(own, zones, same, width, None), blocks, own, k, same, width)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 5, low_percent: int = 80, high_percent: int = 100, block: int = BLOCK, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row that fits ``is_anchor``, a
    condition on the column ``id``, and each of its best ``n_positives`` rows of its label, the best ``n_negatives`` rows of other labels
    whose score is between ``low_percent`` and ``high_percent`` of the positive's. ``vector`` holds integers."""
    own = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<long>").alias("vector"))
    own = own.filter("id is not null and label is not null and vector is not null and size(vector) > 0").filter(F.forall("vector", lambda x: x.isNotNull())).withColumn("dim", F.size("vector"))
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    shape = own.select("dim", total.alias("s"), square.alias("q"), F.array_max("vector").alias("hi"), F.array_min("vector").alias("lo"))
    n, s, q, hi, lo = shape.agg(F.sum("dim"), F.sum("s"), F.sum("q"), F.max("hi"), F.min("lo")).first()
    centre = s / n if n else 0.0
    step = max(SPREAD * 2 * max(q / n - centre * centre, 0.0) ** 0.5 / (1 << BITS), 1e-9) if n else 1.0
    width = "<i4" if n and max(hi, -lo) < 1 << 31 else "<i8"
    keyed = written(_keyed(own, centre, step), "hilbert-places")
    path = new_folder(rows.sparkSession, "hilbert-blocks")
    packed = _packed(keyed, block, width)
    packed.write.partitionBy("shelf").parquet(path)
    blocks = rows.sparkSession.read.schema(packed.schema).parquet(path)
    zones = blocks.select("block", "shelf", "dim", "label", "first", "lo", "hi")
    groups = written(_packed(keyed.filter(is_anchor), GROUP, width), "anchor-groups")
    everyone = groups.select(F.col("block").alias("group"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("a"), F.lit(0).alias("w"), F.lit(LEAST).alias("low"), F.lit(MOST).alias("high"))
    positives = _search(groups, everyone, zones, blocks, n_positives, True, width).select("group", "a", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    edge = lambda percent, round_: round_(F.col("positive_score").cast("decimal(20,0)") * percent / F.lit(100)).cast("long")
    asked = positives.filter("positive_score >= 0").select("group", "a", "w", edge(low_percent, F.ceil).alias("low"), edge(high_percent, F.floor).alias("high"))
    negatives = _search(groups, asked, zones, blocks, n_negatives, False, width).select("group", "a", "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    anchors = groups.select(F.col("block").alias("group"), F.posexplode("ids").alias("a", "anchor_id"))
    found = _met(_met(negatives, positives, ["group", "a", "w"]), anchors, ["group", "a"])
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
