"""A catalogue as versions: parts that are written once, and a manifest for each version that says which of them count.

``put`` writes a batch's rows as a delta of their own and then a manifest, one small file that names the parts that count
from now on. What no manifest names is of no account, so a batch that fails before its manifest changes nothing, and
one that runs again only adds rows that are there already. Readers lay the parts over each other: a row counts unless a newer
one, by columns of the rows themselves, has its paper_id or its rel_path. Deltas keep a batch's rows as they came, folded parts
what is the newest of either key, so that a row that was replaced itself still replaces older ones that come late. So neither repeats nor the order in
which batches come make a difference. Two writers at once: the second finds its version taken and fails.

A batch writes its own rows. Once more than ``most`` deltas count they are folded, into one delta while that holds less
than half the rows of the base, else into a new base: a row is written again a number of times that grows with the
logarithm of the catalogue, and a read lays at most ``most`` + 1 parts over each other. A fold goes county by county where there are
many rows, and the parts it takes the place of are deleted once its manifest is there, so what a catalogue takes of the disk follows its
size: who began to read an older version reads again. Parts are partitioned by county,
large counties in several files and small ones in few, so a read of some counties opens their folders only.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quirelake.operators import catalog as jobs

#: Rows that a fold deals at a time, if their counties are not larger.
FOLD_ROWS = 500_000
MANIFEST = "place int, batch long, kind string, path string, n_rows long, clean boolean, schema string"


class Versions:
    """The catalogue below ``root``, a folder that Spark's file systems reach; ``order`` names the columns whose greatest
    values make a row the newest."""

    def __init__(self, spark: SparkSession, root: str, order: list[str] | None = None, most: int = 8):
        self.spark, self.root, self.order, self.most = spark, root.rstrip("/"), order or jobs.NEWEST, most

    def _version(self) -> int:
        """The number of the newest whole manifest, -1 without one; only names are listed."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return -1
        found = [int(s.getPath().getName()) for s in files.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(folder, "[0-9]*"))]
        whole = (n for n in sorted(found, reverse=True) if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(folder, f"{n:012d}/_SUCCESS")))
        return next(whole, -1)

    def parts(self) -> list[dict]:
        """The parts that count, at most ``most`` + 1."""
        version = self._version()
        if version < 0:
            return []
        return [r.asDict() for r in self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/{version:012d}").orderBy("place").collect()]

    def _write(self, rows: DataFrame, kind: str, batch: int, *more: DataFrame, clean: bool = False) -> dict:
        """A part of the rows, and of ``more`` one after another; ``clean``: no key is known to be there twice."""
        path = f"{kind}/{batch:012d}-{uuid.uuid4().hex}"
        for some in (rows, *more):
            dealt = some.withColumn("of_county", F.coalesce("county", F.lit(""))).hint("rebalance", "of_county")
            dealt.sortWithinPartitions("of_county", "school_name").write.mode("append").option("compression", "zstd").partitionBy("of_county").parquet(f"{self.root}/{path}")
        part = {"batch": batch, "kind": kind, "path": path, "schema": rows.schema.json()}
        if clean:
            return part | {"n_rows": self._rows(part).count(), "clean": True}
        # as many hashes as rows: no key is there twice; hashes that meet by chance only call a clean part unclean
        n, ids, paths = self._rows(part).agg(F.count("*"), F.count_distinct(F.xxhash64("paper_id")), F.count_distinct(F.xxhash64("rel_path"))).first()
        return part | {"n_rows": n, "clean": n == ids == paths}

    def _rows(self, part: dict, counties: list[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(part["schema"])).add("of_county", "string")
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/{part['path']}")
        # a folder's name can't be blank: rows without a county come back with a null
        return (rows if counties is None else rows.filter(F.coalesce("of_county", F.lit("")).isin(counties))).drop("of_county")

    def _together(self, parts: list[dict], counties: list[str] | None = None) -> DataFrame:
        each = [self._rows(p, counties) for p in parts]
        both = each[0]
        for more in each[1:]:
            both = both.unionByName(more, allowMissingColumns=True)
        return both

    def _fold(self, parts: list[dict], kind: str, batch: int) -> dict:
        """A part of the rows that are the last of either key. Where each id goes with one path, each path with one id, and both with one
        county, as hashes tell, one key decides: whole rows are dealt once, those of some counties after those of others."""
        rows, county = self._together(parts), F.coalesce("county", F.lit(""))
        pairs = rows.select(F.xxhash64("paper_id").alias("i"), F.xxhash64("rel_path").alias("p"), F.xxhash64(county).alias("c")).distinct()
        n, ids, paths = pairs.agg(F.count("*"), F.count_distinct("i"), F.count_distinct("p")).first()
        if not n == ids == paths:
            return self._write(jobs.last_by_either_key(rows, self.order), kind, batch)
        slices, held = [[]], 0
        for r in rows.groupBy(county.alias("c")).agg(F.count("*").alias("n")).orderBy("c").collect():
            if slices[-1] and held + r["n"] > FOLD_ROWS:
                slices, held = [*slices, []], 0
            slices[-1].append(r["c"])
            held += r["n"]
        first, *more = [jobs.last_by_key(self._together(parts, some), self.order) for some in slices]
        return self._write(first, kind, batch, *more, clean=True)

    def _delete(self, paths: set[str]) -> None:
        for path in paths:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def put(self, rows: DataFrame, batch: int) -> None:
        """Adds the rows of a batch. A batch whose delta counts already takes its place."""
        version = self._version() + 1
        before = self.parts()
        live = [p for p in before if (p["kind"], p["batch"]) != ("delta", batch)]
        live.append(self._write(rows, "delta", batch))  # as it is: what it holds of older rows goes when deltas are folded
        there = {p["path"] for p in [*before, *live]}
        base, deltas = [p for p in live if p["kind"] == "base"], [p for p in live if p["kind"] != "base"]
        if len(deltas) > self.most:
            small = base and 2 * sum(p["n_rows"] for p in deltas) < base[0]["n_rows"]
            live = [*base, self._fold(deltas, "folded", batch)] if small else [self._fold(live, "base", batch)]
        named = [(i, p["batch"], p["kind"], p["path"], p["n_rows"], p["clean"], p["schema"]) for i, p in enumerate(live)]
        self.spark.createDataFrame(named, MANIFEST).coalesce(1).write.parquet(f"{self.root}/manifest/{version:012d}")
        self._delete(there - {p["path"] for p in live})  # what this version no longer names, and only once it is there

    def read(self, counties: list[str] | None = None) -> DataFrame:
        """The catalogue as of now. With ``counties`` only their folders are read: a row and those it replaces are of one
        county, as the path, and the id made of it, name it."""
        parts = self.parts()
        rows = self._together(parts, counties)
        return rows if len(parts) == 1 and parts[0]["clean"] else jobs.last_by_both_keys(rows, self.order)
