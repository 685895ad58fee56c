"""Catalogue jobs: build, upsert, search, pair, facets, joins, statistics. DataFrame to DataFrame, no actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirelake.functions import names, schools
from quirelake.operators import skew

#: Top folders that a listing leaves out.
SKIP = ["state", "logs", "_inbox", "_internal", "_待分類", "其他X", "未分類", "cap_exam", "ceec"]
KEYS = ["school_name", "school_year", "school_term", "exam_type", "grade", "subject", "version", "county"]
FACETS = ["school_year", "grade", "subject", "exam_type", "school_term", "version"]


#: What makes a row newer than another of the same key, in this order.
NEWEST = ["mtime", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey"]


def newest_paths(listing: DataFrame, faithful_dump_path: bool = False, order: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """The newest row of each catalogued path, with paper_id and the path it was found at (``found_at``). A maximum by
    the order columns, combined before the one shuffle; nothing is parsed for rows that go. The catalogued path, which
    follows from the one found, is made again behind the shuffle. ``parts``: to how many tasks the paths are dealt, which the
    names are then read in; without it to as many as any shuffle has, whatever the listing's size."""
    rows = listing.filter(~names.pruned(F.col("rel_path"), SKIP)).withColumnRenamed("rel_path", "found_at")
    path = names.canonical_path(F.col("found_at"), faithful_dump_path)
    order = [c for c in order or NEWEST if c in listing.columns]
    rest = [c for c in rows.columns if c not in order]
    known = names.computed(rows, paper_id=names.paper_id(path))
    kept = (known.repartition(parts, "paper_id") if parts else known).groupBy("paper_id").agg(F.max(F.struct(*order, *rest)).alias("x"))
    return names.computed(kept.select("paper_id", "x.*"), rel_path=path)


def placed(listing: DataFrame, faithful_dump_path: bool = False, order: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """The newest row of each path that is an archive file's, with its layout (``at``); no name is parsed."""
    return names.computed(newest_paths(listing, faithful_dump_path, order, parts), at=names.layout(F.col("found_at"))).filter("at is not null")


def build_catalog(listing: DataFrame, faithful_dump_path: bool = False, order: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """Listing rows (rel_path, size_kb, mtime, ...) to catalogue rows with ids, parsed fields, title and flags, one for
    each path."""
    rows = names.computed(placed(listing, faithful_dump_path, order, parts), filename=names.file_name(F.col("found_at")))
    rows = names.computed(rows, of=names.parse_file_name(F.col("filename"), F.col("at.county")))
    blank = names.blank_to_null
    folder = F.when(F.col("at.layout") == "dump", F.get(F.split("found_at", "/"), F.lit(3)))
    rows = names.computed(rows, school=F.coalesce(folder, F.col("of.school_name"), names.fallback_school(F.col("rel_path"), F.col("filename"))))
    kept = [c for c in listing.columns if c not in ("rel_path", "size_kb", "mtime")]
    out = rows.select(
        *kept,
        "paper_id",
        "rel_path",
        "filename",
        F.col("at.layout").alias("layout"),
        F.col("at.county").alias("county"),
        F.col("at.level").alias("level"),
        F.coalesce(blank(F.col("at.grade")), F.col("of.grade")).alias("grade"),
        blank(F.col("at.subject")).alias("subject"),
        "of.school_year",
        "of.school_term",
        "of.exam_type",
        "of.fileid",
        F.col("school").alias("school_name"),
        "of.version",
        F.col("at.filetype").alias("paper_or_daan"),
        "size_kb",
        "mtime",
    )
    titled = names.title(*[F.col(c) for c in ("school_name", "school_year", "school_term", "exam_type", "grade", "subject", "version")])
    flags = {"is_paper": F.col("paper_or_daan") == "paper", "has_school": F.col("school_name").isNotNull(), "has_school_name": F.coalesce(F.length("school_name"), F.lit(0)) > 4}
    return out.select("*", titled.alias("title"), *[c.cast("int").alias(n) for n, c in flags.items()])


def last_by_both_keys(rows: DataFrame, order: list[str], keys: tuple[str, str] = ("paper_id", "rel_path")) -> DataFrame:
    """What is left when rows go in one after another, in ``order`` (ties by the keys), and each replaces all that share
    either key with it. A row goes as soon as a later one shares a key, whatever becomes of that one, so it stays just if
    it is the last of all rows both in its id group and in its path group. Two maxima, each combined before its shuffle,
    and one join of their results; a key may hold any share of the rows. Neither key is null."""
    one, other = keys
    rest = [c for c in rows.columns if c not in (one, other, *order)]
    last = rows.groupBy(one).agg(F.max(F.struct(*order, other, *rest)).alias("x")).select(one, "x.*")
    by_other = rows.groupBy(other).agg(F.max(F.struct(*order, one)).alias("last_here"))
    # no row is later than its group's last; said this way, rows meet by the key alone and not by all that orders them
    kept = last.join(by_other, other).filter(F.struct(*order, one) >= F.col("last_here"))
    return kept.select(*rows.columns)


def last_by_either_key(rows: DataFrame, order: list[str], keys: tuple[str, str] = ("paper_id", "rel_path")) -> DataFrame:
    """The rows that are the last of their id or of their path: all that can matter once more rows come, of any age.
    A row that is the last of one key only is gone itself, but what shares that key and is older goes by it."""
    one, other = keys
    rest = lambda key: [c for c in rows.columns if c != key and c not in order]
    last = [rows.groupBy(k).agg(F.max(F.struct(*order, *sorted(rest(k), key=lambda c: c not in keys))).alias("x")).select(k, "x.*") for k in keys]
    here = last[0].select(one, F.struct(*order, other).alias("last_here"))
    gone = last[1].join(here, one).filter(~F.struct(*order, other).eqNullSafe(F.col("last_here")))
    return last[0].select(*rows.columns).unionByName(gone.select(*rows.columns))


def last_by_key(rows: DataFrame, order: list[str], key: str = "paper_id") -> DataFrame:
    """The last row of each key, from one maximum."""
    rest = [c for c in rows.columns if c != key and c not in order]
    return rows.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("x")).select(key, "x.*").select(*rows.columns)


def upsert(current: DataFrame, batch: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Batch rows put into the current ones in ascending ``order`` of these columns, each in place of all rows, old or of
    the batch, that share its paper_id or its rel_path."""
    both = current.withColumn("_turn", F.lit(0)).unionByName(batch.withColumn("_turn", F.lit(1)))
    return last_by_both_keys(both, ["_turn", *(order or NEWEST)]).drop("_turn")


def delete_paths(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows without those whose path is listed; paths that are not there are ignored."""
    return rows.join(paths.select("rel_path"), "rel_path", "left_anti").select(rows.columns)


def matches(filters: dict[str, str], keyword: str | None = None) -> Column:
    """All equality filters, and every token of the keyword's core in the school's name (none if the core is short)."""
    out = F.lit(True)
    for name, value in filters.items():
        out &= F.col(name) == value
    if keyword:
        token = schools.core_token(F.lit(keyword))
        out &= token.isNull() | F.contains(F.lower(F.coalesce("school_name", F.lit(""))), F.lower(F.coalesce(token, F.lit(""))))
    return out


def page_order() -> list[Column]:
    return [F.asc("county"), F.desc("school_year"), F.asc("exam_type"), F.asc("grade"), F.asc("subject"), F.asc("paper_id")]



def page(rows: DataFrame, number: int, per_page: int, order: list[Column] | None = None) -> DataFrame:
    """One page of a result in a total order: a top-k, not a full sort."""
    return rows.orderBy(*(order or page_order())).offset((number - 1) * per_page).limit(per_page)


def pair_groups(rows: DataFrame) -> DataFrame:
    """One row per 8-column key (null-safe) with the last paper and answer id, the types and a flag for a whole pair."""
    paper, daan = F.col("paper_or_daan") == "paper", F.col("paper_or_daan") == "daan"
    out = rows.groupBy(*KEYS).agg(
        F.max(F.when(paper, F.col("paper_id"))).alias("paper_file"),
        F.max(F.when(daan, F.col("paper_id"))).alias("daan_file"),
        F.count("*").alias("n_files"),
    )
    kinds = F.array_join(F.array_compact(F.array(F.when(F.col("paper_file").isNotNull(), "paper"), F.when(F.col("daan_file").isNotNull(), "daan"))), ",")
    return out.withColumn("filetype_set", kinds).withColumn("has_daan", F.when(F.col("daan_file").isNotNull(), "有").otherwise("無"))


def facets(rows: DataFrame) -> DataFrame:
    """(field, value, n) of all facet columns in one pass."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in FACETS])).alias("x")).select("x.*")
    return long.filter("value is not null and value <> ''").groupBy("field", "value").agg(F.count("*").alias("n"))


def school_dropdown(rows: DataFrame) -> DataFrame:
    """(county, school_name, n) of named schools."""
    return rows.filter((F.col("school_name") != "") & (F.col("school_name") != F.col("county"))).groupBy("county", "school_name").agg(F.count("*").alias("n"))


def school_stats(rows: DataFrame) -> DataFrame:
    """Calls and distinct files by county and school, with the county and grand totals."""
    county = schools.county_of(F.col("school_name"))
    return rows.withColumn("of_county", county).rollup("of_county", "school_name").agg(F.count("*").alias("calls"), F.count_distinct("paper_id").alias("distinct_files"), F.grouping_id().alias("depth"))


def archive_counts(rows: DataFrame) -> DataFrame:
    """One row of totals."""
    level = lambda x: F.count_if(F.col("level") == x)
    return rows.agg(
        F.count("*").alias("files"),
        level("國小").alias("elementary"),
        level("國中").alias("junior"),
        level("高中").alias("senior"),
        F.count_if(F.col("layout") == "dump").alias("dump"),
        F.count_if(F.col("paper_or_daan") == "daan").alias("answers"),
        F.count_distinct("school_name").alias("schools"),
        F.sum("size_kb").alias("size_kb"),
    )


def status_counts(rows: DataFrame, national: DataFrame) -> DataFrame:
    """One row of the archive's status: PDF files of the catalogue by level, those of them that are question sheets, and
    PDF files of national exams (rel_path), which lie in folders of their own; generic ones of ceec are left out. The
    total counts both."""
    pdf = lambda c: F.endswith(F.col(c), F.lit(".pdf"))
    parts = F.split("rel_path", "/")
    top = F.get(parts, F.lit(0))
    counted = (top == "cap_exam") | (top == "ceec") & ~F.array_contains(F.slice(parts, 1, F.size(parts) - 1), "_generic")
    here = rows.filter(pdf("filename")).select("level", (F.col("paper_or_daan") == "paper").alias("paper"), F.lit(None).cast("string").alias("exam"))
    there = national.filter(pdf("rel_path") & counted).select(F.lit(None).cast("string").alias("level"), F.lit(False).alias("paper"), top.alias("exam"))
    levels = {"primary": "國小", "junior": "國中", "senior": "高中"}
    each = [F.count_if(F.col("level") == v).alias(f"{k}_count") for k, v in levels.items()] + [F.count_if((F.col("level") == v) & F.col("paper")).alias(f"{k}_papers") for k, v in levels.items()]
    exams = [F.count_if(F.col("exam") == v).alias(f"{k}_count") for k, v in (("cap", "cap_exam"), ("ceec", "ceec"))]
    return here.unionByName(there).agg(F.count("*").alias("pdf_count"), *exams, *each)


def archive_top(rows: DataFrame, most: dict[str, int]) -> DataFrame:
    """(field, value, n, place): the largest values of each field, as many as ``most`` says, ties by name."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in most])).alias("x")).select("x.*")
    counted = long.filter("value is not null and value <> ''").groupBy("field", "value").agg(F.count("*").alias("n"))
    return counted.withColumn("place", F.row_number().over(W.partitionBy("field").orderBy(F.desc("n"), "value"))).filter(F.col("place") <= names.lookup(F.col("field"), most))


def archive_years(rows: DataFrame) -> DataFrame:
    """(school_year, place): the years of files outside dumps and national exams, latest first."""
    path = F.col("rel_path")
    main = ~(F.contains(path, F.lit("_drivefolder/")) | F.contains(path, F.lit("/cap_exam/")) | F.contains(path, F.lit("/ceec/")))
    found = rows.filter(main).select(F.expr("try_cast(school_year as int)").alias("school_year")).filter("school_year is not null").distinct()
    return found.withColumn("place", F.row_number().over(W.orderBy(F.desc("school_year"))))  # years are few


def metadata_density(rows: DataFrame) -> DataFrame:
    """(field, filled, total) of the metadata columns, from one aggregate."""
    fields = ["county", "level", "grade", "subject", "school_year", "school_term", "exam_type", "school_name", "version"]
    one = rows.agg(F.count("*").alias("total"), *[F.count_if(F.coalesce(F.col(c), F.lit("")) != "").alias(c) for c in fields])
    return one.unpivot(["total"], fields, "field", "filled").select("field", "filled", "total")


def companion(rows: DataFrame) -> DataFrame:
    """(paper_id, paper_or_daan, companion_id): the other sheet of the same null-safe key, the first by id. The first of
    either kind comes from one aggregate, combined before its shuffle, and goes back to the rows by a join that cuts hot
    keys: the mostly null key of raw dumps may hold any share of the rows."""
    own = rows.select("paper_id", "paper_or_daan", *KEYS)
    first = lambda kind: F.min(F.when(F.col("paper_or_daan") == kind, F.col("paper_id")))
    firsts = own.groupBy(*KEYS).agg(first("paper").alias("first_paper"), first("daan").alias("first_daan"), F.count("*").alias("n"))
    both = skew.spread_null_safe(own, firsts, KEYS, "n", "paper_id")
    return both.select("paper_id", "paper_or_daan", F.when(F.col("paper_or_daan") == "paper", F.col("first_daan")).otherwise(F.col("first_paper")).alias("companion_id"))


def missing_answers(rows: DataFrame) -> DataFrame:
    """Files with an id that have a question sheet and no answer sheet."""
    paper = rows.filter("fileid is not null and paper_or_daan = 'paper'").select("fileid", "county").distinct()
    return paper.join(rows.filter("paper_or_daan = 'daan'").select("fileid", "county"), ["fileid", "county"], "left_anti")


def fill_empty(rows: DataFrame, updates: DataFrame, fields: list[str]) -> DataFrame:
    """Updates fill blank fields only."""
    new = updates.select("paper_id", *[F.col(f).alias(f"_{f}") for f in fields])
    joined = rows.join(new, "paper_id", "left")
    return joined.select(*[F.coalesce(names.blank_to_null(F.col(c)), F.col(f"_{c}")).alias(c) if c in fields else F.col(c) for c in rows.columns])


def prefer_new(rows: DataFrame, updates: DataFrame, fields: list[str]) -> DataFrame:
    """Any update that is not blank wins."""
    new = updates.select("paper_id", *[F.col(f).alias(f"_{f}") for f in fields])
    joined = rows.join(new, "paper_id", "left")
    return joined.select(*[F.coalesce(names.blank_to_null(F.col(f"_{c}")), F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns])


def field_diffs(parsed: DataFrame, rows: DataFrame, fields: list[str]) -> DataFrame:
    """(paper_id, field, old, new) where both sides have a value and differ."""
    new = parsed.select("paper_id", *[F.col(f).alias(f"_{f}") for f in fields])
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("old"), F.col(f"_{f}").alias("new")) for f in fields])
    return rows.join(new, "paper_id").select("paper_id", F.explode(each).alias("x")).select("paper_id", "x.*").filter("old <> '' and new <> '' and old <> new")
