"""A catalogue that is searched by parts of school names without a scan: an index of letter pairs over shelves of rows.

Rows lie in shelves, folders that a hash of the school's name picks, in the order of the names. The index has a row for each pair
of neighbouring letters of each distinct name. A search takes the names that hold all pairs of its token, checks the few
that are left for the token itself, and reads their shelves only. Names are far fewer than rows, and the index is read by
pair. A search without a token, as the rules for tokens have it for short names, reads all shelves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.functions import schools
from quirelake.operators.catalog import matches

SHELVES = 128


def letter_pairs(name: Column) -> Column:
    """The distinct pairs of neighbouring letters; a name of one letter is its own."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - 1, F.lit(1))), lambda i: F.substr(name, i, F.lit(2))))


class NameIndex:
    """Rows and the index of their names below ``root``; ``write`` makes both, ``search`` reads what a token needs."""

    def __init__(self, spark: SparkSession, root: str, shelves: int = SHELVES):
        self.spark, self.root, self.shelves = spark, root.rstrip("/"), shelves

    def write(self, rows: DataFrame) -> NameIndex:
        name = F.lower(F.coalesce("school_name", F.lit("")))
        placed = rows.withColumn("name_key", name).withColumn("shelf", F.pmod(F.xxhash64("name_key"), F.lit(self.shelves)).cast("int"))
        placed.hint("rebalance", "shelf").sortWithinPartitions("shelf", "name_key").write.partitionBy("shelf").parquet(f"{self.root}/rows")
        names = self.rows().select("name_key", "shelf").distinct().filter("name_key <> ''")
        pairs = names.select(F.explode(letter_pairs(F.col("name_key"))).alias("pair"), "name_key", "shelf")
        pairs.repartitionByRange("pair").sortWithinPartitions("pair", "name_key").write.parquet(f"{self.root}/pairs")
        return self

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/rows")

    def names(self, token: str) -> DataFrame:
        """(name_key, shelf) of the names that hold the token, whatever its case."""
        token, pairs = token.lower(), self.spark.read.parquet(f"{self.root}/pairs")
        if len(token) < 2:
            return pairs.filter(F.contains("pair", F.lit(token))).select("name_key", "shelf").distinct()
        wanted = sorted({token[i : i + 2] for i in range(len(token) - 1)})
        known = pairs.filter(F.col("pair").isin(wanted))
        full = known.groupBy("name_key", "shelf").agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted))
        return full.filter(F.contains("name_key", F.lit(token))).select("name_key", "shelf")

    def search(self, filters: dict[str, str], keyword: str | None = None) -> DataFrame:
        """The rows that equal all filters and whose school holds the core of ``keyword``, as a scan would find them."""
        asked = self.spark.range(1).select(schools.core_token(F.lit(keyword)).alias("t")).first()["t"] if keyword else None
        rows = self.rows()
        if asked:
            names = self.names(asked)
            shelves = [r["shelf"] for r in names.select("shelf").distinct().collect()]  # at most as many as there are shelves
            rows = rows.filter(F.col("shelf").isin(shelves)).join(names.select("name_key"), "name_key", "left_semi")
        return rows.filter(matches(filters)).drop("name_key", "shelf")
