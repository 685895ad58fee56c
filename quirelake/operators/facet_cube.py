"""Cascading facets from cells: what each county and school has of each facet, kept up to date by changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirelake.operators.catalog import FACETS


def facet_cells(rows: DataFrame, sign: int = 1) -> DataFrame:
    """(county, school_name, field, value, n, depth) from one pass: cells of a school (depth 0), of a county (1) and of
    the whole catalogue (3), so that each step of a cascade reads cells of its own depth. Blank values have no cell."""
    each = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in FACETS])
    long = rows.select("county", "school_name", F.explode(each).alias("x")).select("county", "school_name", "x.*").filter("value is not null and value <> ''")
    sets = [[F.col("county"), F.col("school_name"), F.col("field"), F.col("value")], [F.col("county"), F.col("field"), F.col("value")], [F.col("field"), F.col("value")]]
    cells = long.groupingSets(sets, "county", "school_name", "field", "value").agg((F.count("*") * sign).alias("n"), (F.grouping("county") * 2 + F.grouping("school_name")).cast("int").alias("depth"))
    return cells.select("county", "school_name", "field", "value", "n", "depth")


def changed_cells(cells: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The cells after rows came and went: only the changes are counted anew; a cell that comes to zero is dropped."""
    both = cells.unionByName(facet_cells(added)).unionByName(facet_cells(removed, -1))
    summed = both.groupBy("county", "school_name", "field", "value", "depth").agg(F.sum("n").alias("n"))
    return summed.filter("n <> 0").select(*cells.columns)


def cascade(cells: DataFrame, county: str | None = None, names: DataFrame | None = None) -> DataFrame:
    """(field, value, n, place): the lists of the whole catalogue, of a county, or of the schools (name_key) of a county or
    of all; years from the last, others by value. A school's lists need the school's cells only."""
    if names is not None:
        found = cells.filter("depth = 0").join(names.select("name_key").distinct(), F.lower("school_name") == F.col("name_key"), "left_semi")
    else:
        found = cells.filter(F.col("depth") == (1 if county else 3))
    found = found if county is None else found.filter(F.col("county") == county)
    listed = found.groupBy("field", "value").agg(F.sum("n").alias("n"))
    falling = F.when(F.col("field") == "school_year", F.col("value"))
    place = F.row_number().over(W.partitionBy("field").orderBy(F.desc(falling), "value"))
    return listed.withColumn("place", place)


def school_lists(cells: DataFrame) -> DataFrame:
    """(county, school_name, field, values): the lists of every school, in order."""
    own = cells.filter("depth = 0").groupBy("county", "school_name", "field").agg(F.sort_array(F.collect_set("value")).alias("values"))
    return own.withColumn("values", F.when(F.col("field") == "school_year", F.reverse("values")).otherwise(F.col("values")))
