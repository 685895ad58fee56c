"""Jobs over a raw dump: classification, conflicts with the archive, reports, what to apply. DataFrame to DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirelake.functions import dump, names
from quirelake.operators.catalog import archive_top

#: Columns of a classified dump, as its report files have them.
REPORT = ["paper_id", "rel_path", "filename", "county", "school_name", "school_year", "school_term", "exam_type", "level", "grade", "grade_parse_pattern", "subject", "filetype", "confidence", "target_rel", "target_filename", "skip_reason", "conflict_target", "size_kb"]
SCHOOL = ["county", "school_name"]
#: What makes a dump's file the same as one of the archive.
SAME = ["county", "school_year", "grade", "subject", "filetype", "exam_type", "school_name"]


def parsed(files: DataFrame) -> DataFrame:
    """Files (paper_id, path, county, school_name, size_kb) with the fields that their paths and names tell: all that is searched
    for. A missing exam is 未註明, other missing fields are blank."""
    c = F.col
    blank = lambda x: F.coalesce(x, F.lit(""))
    named = names.computed(files, filename=names.file_name(c("path")))
    stemmed = names.computed(named, stem=dump.stem(c("filename")))  # once a file, for all that search it
    rows = names.computed(stemmed, hit=dump.grade_of(c("path"), c("stem"), c("county"), c("school_name")))
    told = names.computed(
        rows,
        grade=blank(c("hit.grade")),
        grade_parse_pattern=blank(c("hit.rule")),
        subject=blank(dump.subject_of(c("stem"), c("hit.grade"), c("county"), c("school_name"))),
        school_year=blank(dump.year_of(c("stem"), c("county"), c("school_name"))),
        school_term=blank(dump.term_of(c("stem"), c("county"), c("school_name"))),
        exam_type=F.coalesce(dump.exam_of(c("stem")), F.lit(dump.UNKNOWN)),
        filetype=names.guess_filetype(c("filename")),
    )
    return told.drop("filename", "stem", "hit")


def finished(parsed: DataFrame, *more: str) -> DataFrame:
    """Parsed files with what follows from their fields: name, level, confidence, target, and with ``more`` columns of their own.
    Nothing is searched for. Files without a grade go to the review folder."""
    c = F.col
    levelled = names.computed(parsed, filename=names.file_name(c("path")), level=F.coalesce(names.level_of(c("grade")), F.lit("")))
    judged = names.computed(levelled, confidence=dump.confidence(c("level"), c("subject")), to=dump.target_name(c("county"), c("school_year"), c("school_term"), c("exam_type"), c("subject"), c("grade"), c("school_name"), F.lit(dump.UNKNOWN)))
    low = c("confidence") == "LOW"
    return judged.select(
        "paper_id",
        c("path").alias("rel_path"),
        "filename",
        *SCHOOL,
        *["school_year", "school_term", "exam_type", "level", "grade", "grade_parse_pattern", "subject", "filetype", "confidence"],
        F.when(low, dump.pending_path(c("county"), c("school_name"), c("filename"))).otherwise(dump.target_path(c("county"), c("level"), c("grade"), c("subject"), c("filetype"), c("to"))).alias("target_rel"),
        F.when(low, "").otherwise(c("to")).alias("target_filename"),
        F.when(low, "no_grade").otherwise("").alias("skip_reason"),
        "size_kb",
        *more,
    )


def classify(files: DataFrame) -> DataFrame:
    """Files (paper_id, path, county, school_name, size_kb) to fields, confidence and target. A missing exam is 未註明,
    other missing fields are blank; files without a grade go to the review folder."""
    return finished(parsed(files))


def _with_same(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds by_keys: the first path of the archive with the same seven keys."""
    main = catalog.filter("level <> ''").withColumnRenamed("paper_or_daan", "filetype")
    whole = main.filter(" and ".join(f"coalesce({k}, '') <> ''" for k in SAME if k != "exam_type")).withColumn("exam_type", F.coalesce("exam_type", F.lit("")))
    return rows.join(whole.groupBy(*SAME).agg(F.min("rel_path").alias("by_keys")).hint("merge"), SAME, "left")


def _with_path(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds by_path: the archive's file on the target path. The archive's paths take many times the room of their files, by which
    they would be taken for few and sent through the driver."""
    on_path = catalog.filter("level <> ''").select(F.col("rel_path").alias("target_rel"), F.col("rel_path").alias("by_path"))
    return rows.join(on_path.hint("merge"), "target_rel", "left")


def _judged(rows: DataFrame) -> DataFrame:
    found = F.when(F.col("confidence") == "LOW", "").otherwise(F.coalesce("by_path", "by_keys", F.lit("")))
    return rows.withColumn("conflict_target", found).select(*REPORT)


def find_conflicts(classified: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds conflict_target: the archive's file on the target path, else the first by path with the same seven keys; blank
    where there is none or the file has no grade. Both sides meet by hash joins on whole keys."""
    return _judged(_with_path(_with_same(classified, catalog), catalog))


def classify_and_find(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """``find_conflicts`` of ``classify``. Only what names tell is dealt, files of a school beside each other, as their texts are alike and
    take little room then; what follows from it is made where the report's rows are, and the target path once before, to meet by."""
    rows = _with_same(parsed(files.sortWithinPartitions(*SCHOOL, "path")), catalog)
    columns = rows.columns
    aimed = finished(rows, "by_keys").withColumnRenamed("rel_path", "path").select(*columns, "target_rel")
    return _judged(finished(_with_path(aimed, catalog).drop("target_rel"), "by_keys", "by_path"))


def confidence_report(classified: DataFrame) -> DataFrame:
    """(confidence, n, percent) of all files."""
    counted = classified.groupBy("confidence").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))  # one row
    return counted.join(F.broadcast(total)).select("confidence", "n", F.round(F.col("n") * 100 / F.col("total"), 1).alias("percent"))


def school_report(classified: DataFrame) -> DataFrame:
    """Files of each confidence by school, the share of HIGH, and conflicts."""
    kind = lambda k: F.count_if(F.col("confidence") == k)
    return classified.groupBy(*SCHOOL).agg(
        F.count("*").alias("total"),
        kind("HIGH").alias("high"),
        kind("MEDIUM").alias("medium"),
        kind("LOW").alias("low"),
        F.round(kind("HIGH") * 100 / F.count("*"), 1).alias("high_percent"),
        F.count_if(F.col("conflict_target") != "").alias("conflicts"),
    )


def coverage_report(classified: DataFrame, k: int = 15) -> DataFrame:
    """(field, value, n, place): the ``k`` most frequent subjects, grades and grade rules."""
    return archive_top(classified, {"subject": k, "grade": k, "grade_parse_pattern": k})


def gap_report(classified: DataFrame) -> DataFrame:
    """One row: files without a grade, files with a target but no subject, files that a system left behind."""
    return classified.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("grade") == "").alias("no_grade"),
        F.count_if((F.col("confidence") != "LOW") & (F.col("subject") == "")).alias("no_subject"),
        F.count_if(F.startswith(F.col("filename"), F.lit("._"))).alias("system_files"),
    )


def config_and_index(configured: DataFrame, indexed: DataFrame) -> DataFrame:
    """(county, school_name, configured, indexed, n): configured schools beside those with files."""
    left = configured.select(*SCHOOL).distinct().withColumn("configured", F.lit(True))
    right = indexed.groupBy(*SCHOOL).agg(F.count("*").alias("n"))
    no = F.lit(False)
    return left.join(right, SCHOOL, "full").select(*SCHOOL, F.coalesce("configured", no).alias("configured"), F.col("n").isNotNull().alias("indexed"), F.coalesce("n", F.lit(0)).alias("n"))


def school_sets(configured: DataFrame, indexed: DataFrame) -> DataFrame:
    """(what, county, school_name): schools that are configured only, indexed only or both, nulls being alike. One aggregate over
    both sides, combined before its shuffle: a school may hold any share of the files."""
    side = lambda rows, config: rows.select(*SCHOOL, F.lit(config).alias("config"))
    sides = side(configured, True).unionByName(side(indexed, False)).groupBy(*SCHOOL).agg(F.count_if("config").alias("config"), F.count_if(~F.col("config")).alias("index"))
    what = F.when(F.col("index") == 0, "config_minus_index").when(F.col("config") == 0, "index_minus_config").otherwise("both")
    return sides.select(what.alias("what"), *SCHOOL)


def apply_reasons(classified: DataFrame, include_medium: bool = False, school: str | None = None) -> DataFrame:
    """Adds reason: apply, or why a file is left out: a system's file, its confidence, another school."""
    levels = ["HIGH", "MEDIUM"] if include_medium else ["HIGH"]
    other = F.lit(False) if school is None else F.col("school_name") != school
    reason = F.when(F.startswith(F.col("filename"), F.lit("._")), "system_file").when(~F.col("confidence").isin(*levels), F.lower("confidence")).when(other, "other_school").otherwise("apply")
    return classified.withColumn("reason", reason)


def plan_moves(classified: DataFrame, catalog: DataFrame) -> DataFrame:
    """(paper_id, target_rel, action): what a move to the target would do. A file of the same size there already is a
    duplicate (dedup), one of another size stops the move (size_mismatch); of several files of the batch with one
    target the first by id moves and the others collide."""
    there = catalog.select(F.col("rel_path").alias("target_rel"), F.col("size_kb").alias("size_there"))
    rows = classified.join(there, "target_rel", "left")
    place = F.row_number().over(W.partitionBy("target_rel").orderBy("paper_id"))
    action = F.when(F.col("size_there") == F.col("size_kb"), "dedup").when(F.col("size_there").isNotNull(), "size_mismatch").when(place > 1, "collision").otherwise("move")
    return rows.select("paper_id", "target_rel", action.alias("action"))
