"""Statistics of schools whose names are first read from file names and known in full only later.

A call tells that a file (fileid, filetype) is of a school. A name with the mark is a placeholder. When a file that was first
told of under a placeholder is told of again under another name, all that the placeholder holds by then goes to that name;
later calls begin the placeholder anew. Calls are counted under the name they were made with.

All calls of a placeholder up to its next change go together, so changes are found in rounds, one for each time that the
same placeholder is given up: a minimum by placeholder, combined before its shuffle, and a join with these few rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.functions import schools
from quirelake.sources import store

#: The mark of a placeholder, and what a missing name counts as.
MARK, UNNAMED = "(from filename)", "未註明"


def _told(calls: DataFrame) -> DataFrame:
    """Calls with the name they count under and the file as one value."""
    name = F.coalesce(F.nullif("school_name", F.lit("")), F.lit(UNNAMED))
    return calls.select("seq", name.alias("name"), F.concat_ws("_", F.col("fileid").cast("string"), "filetype").alias("file"), "grade", (F.coalesce("school_name", F.lit("")) != "").alias("named"))


def merged_schools(calls: DataFrame) -> DataFrame:
    """Calls (seq, fileid, filetype, school_name, grade) to (school, county, short_name, grade, total_files). A school's
    grade is that of the call that last gave it a placeholder's files, or else of its first call."""
    told = store.kept(_told(calls), "told")
    mark = F.contains("name", F.lit(MARK))
    # a file gives its placeholder up at its next call under another name, if its first call of all was under it
    first = told.groupBy("file").agg(F.min_by(F.struct("name", "seq"), "seq").alias("f")).select("file", F.col("f.name").alias("name"), F.col("f.seq").alias("seq")).filter(mark)
    other = told.filter("named").select("file", F.col("name").alias("to"), F.col("seq").alias("at"), F.col("grade").alias("to_grade"))
    later = first.join(other, "file").filter("at > seq and to <> name").groupBy("file", "name", "seq").agg(F.min(F.struct("at", "to", "to_grade")).alias("change"))
    left = told.filter(mark).join(later, ["file", "name", "seq"], "left")
    gone = None
    while True:
        left = store.kept(left, "told-left")
        change = store.kept(left.filter("change is not null").groupBy("name").agg(F.min("change").alias("c")), "told-changes")
        if change.isEmpty():
            break
        moved = left.join(change, "name").filter(F.col("seq") < F.col("c.at"))
        moved = moved.select(F.col("c.to").alias("name"), "file", F.col("c.at").alias("at"), F.col("c.to_grade").alias("to_grade"))
        gone = moved if gone is None else gone.unionByName(moved)
        left = left.join(change, "name", "left").filter(F.col("c").isNull() | (F.col("seq") > F.col("c.at"))).drop("c")
    own = told.filter(~mark).unionByName(left.select(*told.columns)).select("name", "file", "seq", "grade", F.lit(None).cast("long").alias("at"), F.lit(None).cast("string").alias("to_grade"))
    if gone is not None:
        own = own.unionByName(gone.select("name", "file", F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("grade"), F.col("at").cast("long"), "to_grade"))
    by_call = F.min_by("grade", F.when(F.col("seq").isNotNull(), F.col("seq")))
    given = F.max(F.when(F.col("at").isNotNull(), F.struct("at", "to_grade")))
    out = own.groupBy("name").agg(F.count_distinct("file").alias("total_files"), by_call.alias("first_grade"), given.alias("given"))
    return out.select(F.col("name").alias("school"), schools.county_of(F.col("name")).alias("county"), schools.short_name(F.col("name")).alias("short_name"), F.when(F.col("given").isNotNull(), F.col("given.to_grade")).otherwise(F.col("first_grade")).alias("grade"), "total_files")


def counted_calls(calls: DataFrame) -> DataFrame:
    """(county, school, calls): of each county and school, of each county (school null) and of all (both null), in one pass."""
    told = _told(calls).select(schools.county_of(F.col("name")).alias("county"), F.col("name").alias("school"))
    return told.rollup("county", "school").agg(F.count("*").alias("calls"))
