"""Operator 4: near-duplicate vectors by Euclidean p-stable hashing, then exact cosines.

Vectors are normalised; each of several tables has a number of Gaussian projections, cut into steps of ``width``. On
unit vectors cosine >= c is distance <= sqrt(2 - 2c), so the chance that a linked pair misses all tables is known.
The projections follow from the largest label's number of distinct vectors (see ``table_plan``): so many that a vector
meets about CHANCE_MATES vectors at a right angle to it in a table, whatever the size, and so many tables that a pair
at the threshold exactly is missed with a chance below MISS; far less above it. Candidates of a vector hence stay
bounded as the corpus grows, up to the vectors that are truly near. Equal vectors of one label are one class, so
copies never meet in a bucket. Buckets of one class are dropped before vectors move. A bucket of more than ``block``
classes is dealt into blocks and every pair of its blocks is compared, as the exact number of links needs it, so no
task holds a bucket whole and nothing in it is skipped. A pair counts in the first table only in which its keys
agree. What a task returns is a count for each vector and edges that span the components it has seen, so rows grow
with the vectors even where all are alike.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null
label link with nothing; finite vectors of any magnitude are scaled before their norms are taken; vectors of different
lengths never link; repeated rows are linked copies; a null id is kept
and takes no part; an empty table stays empty; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm._spark import components, written

WIDTH, SEED = 1.5, 20240607
#: Chance that a pair at the threshold is missed, and vectors at a right angle that a vector meets by chance in a table.
MISS, CHANCE_MATES = 1e-4, 0.05
BLOCK = 512


def agreement(cosine: float, width: float = WIDTH) -> float:
    """Chance that unit vectors at this cosine fall in one step of a projection."""
    r = width / math.sqrt(max(2 - 2 * cosine, 1e-12))
    phi = 0.5 * (1 + math.erf(-r / math.sqrt(2)))
    return 1 - 2 * phi - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def miss_probability(cosine: float, tables: int, projections: int, width: float = WIDTH) -> float:
    """Chance that a pair at this cosine agrees in no table."""
    return (1 - agreement(cosine, width) ** projections) ** tables


def table_plan(n: int, cosine: float, width: float = WIDTH) -> tuple[int, int]:
    """(tables, projections) for n vectors: the projections grow with log n, the tables with a small power of n."""
    projections = max(4, math.ceil(math.log(max(n, 2) / CHANCE_MATES) / -math.log(agreement(0, width))))
    hit = agreement(cosine, width) ** projections
    return math.ceil(math.log(MISS) / math.log1p(-hit)), projections


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; divided by their largest component first, so that no square is too large or small."""
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _keys(unit: np.ndarray, tables: int, projections: int, width: float) -> np.ndarray:
    """Bucket keys (rows x tables, 64 bit) of unit vectors."""
    rng = np.random.default_rng([SEED, unit.shape[1]])
    a = rng.standard_normal((unit.shape[1], tables * projections))
    shift = rng.uniform(0, width, tables * projections)
    steps = np.floor((unit @ a + shift) / width).astype(np.int64).reshape(len(unit), tables, projections)
    weights = rng.integers(1, 1 << 62, projections, dtype=np.int64) | 1
    return (steps * weights).sum(axis=2)


def _classes(vectors: DataFrame) -> DataFrame:
    """(label, vector, rep, copies) of the vectors that can link."""
    usable = vectors.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0))
    usable = usable.filter(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0))
    return usable.groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))


def _links_of(members: list[dict], others: list[dict] | None, cosine: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(positions, linked copies) and spanning edges among members, or between members and others."""
    rows = members + (others or [])
    unit = unit_rows(np.array([r["vector"] for r in rows], float))
    keys = np.array([r["keys"] for r in rows])
    t = rows[0]["t"]
    left = np.arange(len(members))
    right = np.arange(len(members), len(rows)) if others else left
    alike = unit[left] @ unit[right].T >= cosine
    if not others:
        alike &= left[:, None] < right[None, :]
    i, j = np.nonzero(alike)
    i, j = left[i], right[j]
    first = ~(keys[i, :t] == keys[j, :t]).any(axis=1) if t else np.ones(len(i), bool)
    i, j = i[first], j[first]
    copies = np.array([r["copies"] for r in rows])
    gained = np.bincount(i, copies[j], len(rows)) + np.bincount(j, copies[i], len(rows))
    parent = list(range(len(rows)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        a_, b_ = find(a), find(b)
        if a_ != b_:
            parent[b_] = a_
            edges.append((a, b))
    return np.flatnonzero(gained), gained[gained > 0], edges


def near_vectors(vectors: DataFrame, cosine: float = 0.98, width: float = WIDTH, block: int = BLOCK, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row."""
    own = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    classes = written(_classes(own), "vector-classes")
    kind = classes.schema["label"].dataType.simpleString()
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0  # one number
    tables, projections = table_plan(largest, cosine, width)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [np.array(v, float) for v in batch.column("vector").to_pylist()]
            sizes = np.array([len(v) for v in rows])
            keys = np.zeros((len(rows), tables), np.int64)
            for n in np.unique(sizes).tolist():
                of = np.flatnonzero(sizes == n)
                x = np.stack([rows[i] for i in of])
                keys[of] = _keys(unit_rows(x), tables, projections, width)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * tables), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("rep"), pa.array(sizes), flat], names=["label", "rep", "dim", "keys"])

    keyed = written(classes.select("label", "rep", "vector").mapInArrow(hashed, f"label {kind}, rep long, dim long, keys array<long>"), "vector-keys")
    rows = keyed.select("label", "dim", "rep", F.posexplode("keys").alias("t", "key"))
    bucket = ["label", "dim", "t", "key"]
    sizes = rows.groupBy(*bucket).agg(F.count("*").alias("n")).filter("n > 1").withColumn("blocks", F.ceil(F.col("n") / F.lit(block)).cast("int"))
    met = rows.join(sizes, bucket).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = F.struct(*bucket, F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"))
    met = met.select("rep", "t", "mine", task.alias("task"))
    full = met.join(keyed.select("rep", "label", "keys").join(classes.select("label", "rep", "vector", "copies"), ["label", "rep"]).drop("label"), "rep")
    grouped = full.groupBy("task").agg(F.collect_list(F.struct("mine", "rep", "t", "keys", "vector", "copies")).alias("members"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, gains, a, b = [], [], [], []
            for task_, members in zip(batch.column("task").to_pylist(), batch.column("members"), strict=True):
                members = sorted(members.as_py(), key=lambda r: r["rep"])
                x, y = task_["x"], task_["y"]
                left = [r for r in members if r["mine"] == x]
                right = [r for r in members if r["mine"] == y] if x != y else None
                if not left or right == []:
                    continue
                at, gained, edges = _links_of(left, right, cosine)
                both = left + (right or [])
                ids += [both[i]["rep"] for i in at.tolist()]
                gains += gained.astype(np.int64).tolist()
                a += [both[i]["rep"] for i, _ in edges]
                b += [both[j]["rep"] for _, j in edges]
            none = [None] * len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids + [None] * len(a), pa.int64()), pa.array(gains + [None] * len(a), pa.int64()), pa.array(none + a, pa.int64()), pa.array(none + b, pa.int64())], names=["rep", "gained", "a", "b"])

    found = written(grouped.mapInArrow(compare, "rep long, gained long, a long, b long"), "vector-links")
    gained = found.filter("rep is not null").groupBy("rep").agg(F.sum("gained").alias("gained"))
    edges = found.filter("a is not null").select("a", "b")
    of_rep = components(edges).withColumnRenamed("id", "rep")
    known = classes.join(gained, "rep", "left").join(of_rep, "rep", "left")
    known = known.select("label", "vector", (F.col("copies") - 1 + F.coalesce("gained", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    # a row's class is found by its label and vector; -0.0 and 0.0 are one value for Spark's keys
    result = own.withColumn("usable", F.col("id").isNotNull()).join(known.withColumn("usable", F.lit(True)), ["label", "vector", "usable"], "left")
    component = F.coalesce("component_id", "id")
    return result.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))
