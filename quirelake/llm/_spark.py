"""Spark helpers of the subpackage: the shared folder, written intermediate tables and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local master, whose tasks run in the
    driver's process, may do without: it gets a folder of its own; on a cluster an unset folder is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quirelake-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """The rows of ``df``, written as Parquet in the shared folder and read again: cuts the lineage, and a lost
    executor costs nothing that was computed before."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key that holds more than this share of the rows is dealt over several tasks.
HOT_SHARE = 1 / 2000


def spread_join(rows: DataFrame, keyed: DataFrame, keys: list[str], weight: str, by: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keyed`` on ``keys``, where one key may hold any share of ``rows``.

    ``keyed`` has a row for each key with ``weight``, the key's number of rows, and should be a written table, as it is
    read twice. A key above HOT_SHARE of all rows is cut into parts of about that share: it is repeated once for each
    part, and its rows are dealt over the parts by a hash of the columns ``by``. There are at most 1 / HOT_SHARE such
    keys, whatever the data, so sending them to all tasks is bounded. Every row meets its key once.
    """
    total = keyed.agg(F.sum(weight)).first()[0] or 0
    parts = F.greatest(F.ceil(F.col(weight) / F.lit(max(total * HOT_SHARE, 1.0))), F.lit(1)).cast("int")
    sized = keyed.withColumn("_parts", parts)
    hot = sized.filter("_parts > 1").select(*keys, "_parts")
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*by), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    right = sized.select("*", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part")).drop("_parts", weight)
    return dealt.join(right, [*keys, "_part"], how).drop("_part")


#: Edges that one task may join; more are contracted first.
FEW_EDGES = 200_000


def components(edges: DataFrame, a: str = "a", b: str = "b", few: int = FEW_EDGES) -> DataFrame:
    """(id, component_id) of every node in an undirected edge list; component_id is the smallest id reachable.

    While there are more than ``few`` edges, a round maps every node to the neighbour (or itself) that comes first in
    an order drawn anew, by a hash of the id and the round, and contracts the graph along that map. In such an order
    a fixed share of the nodes of any graph, chains of ascending ids included, goes in each round, so the rounds grow
    with the logarithm of the edges. All steps are joins and map-side combined aggregates; hubs need no neighbour
    lists. What is left, of bounded size, is joined by a union-find in one task. An empty edge list gives an empty
    result; loops and repeated edges are harmless. Ids are long.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    while n := pairs.count():
        if n <= few:
            maps.append(written(pairs.coalesce(1).mapInArrow(_joined, "node long, to long"), "step"))
            break
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        place = lambda c: F.struct(F.xxhash64(c, F.lit(len(maps))).alias("h"), F.col(c).alias("id"))
        first = both.groupBy(F.col("a").alias("node")).agg(F.min(place("b")).alias("near"))
        step = written(first.select("node", F.least(place("node"), F.col("near"))["id"].alias("to")), "step")
        maps.append(step)
        left = pairs.join(step.withColumnRenamed("to", "x"), F.col("a") == F.col("node")).select("x", "b")
        right = left.join(step.withColumnRenamed("to", "y"), F.col("b") == F.col("node")).select("x", "y").filter("x <> y")
        pairs = written(right.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not maps:
        return pairs.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    labels = maps[0].select(F.col("node").alias("id"), F.col("to").alias("root"))
    for step in maps[1:]:
        labels = labels.join(step, F.col("root") == F.col("node"), "left").select("id", F.coalesce("to", "root").alias("root"))
    if len(maps) == 1:
        return labels.withColumnRenamed("root", "component_id")
    # roots come in drawn orders: the least id of each component is found last
    labels = written(labels, "labels")
    least = written(labels.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("n")), "roots")
    return spread_join(labels, least, ["root"], "n", ["id"]).select("id", "component_id")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    if parent:
        yield pa.RecordBatch.from_arrays([pa.array(list(parent), pa.int64()), pa.array([find(x) for x in parent], pa.int64())], names=["node", "to"])
