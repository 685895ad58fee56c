"""Searches over the catalogue: pages with totals, groups, a relaxing fallback, lookups by id. DataFrame to DataFrame.

A page is a top-k in a total order; totals are one-row aggregates over the same filter, so no search sorts or counts
through one task what it does not return.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions import names, schools
from quirelake.operators.catalog import KEYS, matches

#: Filters that a search may drop when nothing fits.
METADATA = ["grade", "subject", "school_year", "school_term", "exam_type", "version", "paper_or_daan"]


def row_order() -> list[Column]:
    return [F.desc("school_year"), *[F.asc(c) for c in ("county", "school_name", "grade", "subject", "paper_id")]]


def _with_total(found: DataFrame, one_page: DataFrame, per_page: int) -> DataFrame:
    """Adds total and pages, one at least."""
    total = found.agg(F.count("*").alias("total"))
    return one_page.join(F.broadcast(total)).withColumn("pages", F.greatest(F.ceil(F.col("total") / per_page), F.lit(1)))


def search(rows: DataFrame, filters: dict[str, str], name: str | None = None, page: int = 1, per_page: int = 8) -> DataFrame:
    """Rows that equal all filters and whose school holds ``name``, whatever its case; one page, with total and pages."""
    found = rows.filter(matches(filters))
    if name:
        found = found.filter(F.contains(F.lower("school_name"), F.lit(name.lower())))
    return _with_total(found, found.orderBy(*row_order()).offset((page - 1) * per_page).limit(per_page), per_page)


def pairs(rows: DataFrame) -> DataFrame:
    """One row per eight keys with the last question and answer sheet by id, the sheet that stands for it, and a flag."""
    of = lambda kind: F.max(F.when(F.col("paper_or_daan") == kind, F.col("paper_id")))
    out = rows.filter(F.col("paper_or_daan").isin("paper", "daan")).groupBy(*KEYS).agg(of("paper").alias("paper_id_paper"), of("daan").alias("paper_id_daan"))
    return out.select(F.coalesce("paper_id_paper", "paper_id_daan").alias("paper_id"), *KEYS, "paper_id_paper", "paper_id_daan", F.when(F.col("paper_id_daan").isNotNull(), "有").otherwise("無").alias("download_answer"))


def search_relaxed(rows: DataFrame, filters: dict[str, str], school: str | None = None, page: int = 1, per_page: int = 8) -> DataFrame:
    """A page of rows, then paired. Where no row fits, a school is named and a metadata filter given, the county and the
    school's core alone decide: then fallback is true and dropped names the filters left out. Both totals come from one
    aggregate, and one filter takes the rows of whichever applies."""
    given = {k: v for k, v in filters.items() if v}
    dropped = [k for k in METADATA if k in given]
    wide = matches({k: v for k, v in given.items() if k not in dropped}, school)
    strict = F.coalesce(wide & matches({k: given[k] for k in dropped}), F.lit(False))
    near = rows.filter(wide).withColumn("_fits", strict)
    counts = near.agg(F.count_if("_fits").alias("exact"), F.count("*").alias("relaxed"))
    may = F.lit(bool(school and dropped)) & (F.col("exact") == 0) & (F.col("relaxed") > 0)
    info = counts.select(may.alias("fallback"), F.when(may, F.col("relaxed")).otherwise(F.col("exact")).alias("total"))
    found = near.join(F.broadcast(info)).filter(F.col("fallback") | F.col("_fits"))
    shown = pairs(found.orderBy(*row_order()).offset((page - 1) * per_page).limit(per_page))
    told = info.withColumn("dropped", F.when(F.col("fallback"), ",".join(dropped)).otherwise(""))
    return shown.join(F.broadcast(told)).withColumn("pages", F.greatest(F.ceil(F.col("total") / per_page), F.lit(1)))


def search_groups(rows: DataFrame, filters: dict[str, str], school: str | None = None, filetype: str | None = None, page: int = 1, per_page: int = 8) -> DataFrame:
    """A page of groups of eight keys, with the number of groups. A group is shown by its first question sheet, else its
    first sheet, PDF first, then by id; ``filetype`` asks for a member of that kind."""
    first = F.struct((F.col("paper_or_daan") != "paper").alias("a"), (names.extension(F.col("filename")) != ".pdf").alias("b"), F.col("paper_id").alias("id"))
    kind = lambda k: F.min(F.when(F.col("paper_or_daan") == k, F.struct((names.extension(F.col("filename")) != ".pdf").alias("b"), F.col("paper_id").alias("id"))))["id"]
    found = rows.filter(matches(filters))
    if school:
        found = found.filter(schools.school_matches(F.lit(school), F.col("school_name")))
    groups = found.groupBy(*KEYS).agg(F.min(first)["id"].alias("paper_id"), kind("paper").alias("paper_id_paper"), kind("daan").alias("paper_id_daan"))
    if filetype:
        groups = groups.filter(F.col(f"paper_id_{filetype}").isNotNull())
    groups = groups.withColumn("download_answer", F.when(F.col("paper_id_daan").isNotNull(), "有").otherwise("無"))
    order = [F.asc("county"), F.desc(F.coalesce(F.expr("try_cast(school_year as int)"), F.lit(0))), *[F.asc(c) for c in ("exam_type", "grade", "subject", "paper_id")]]
    return _with_total(groups, groups.orderBy(*order).offset((page - 1) * per_page).limit(per_page), per_page)


def lookup_pairs(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """(paper_id, kind, chosen_id, actual): ``wanted`` asks for the question or answer sheet of the group that an id is
    in; where the group has no such sheet, its other sheet is chosen."""
    ids = wanted.join(rows.select("paper_id", *KEYS), "paper_id")
    sheets = pairs(rows).select(*[F.col(k).alias(f"_{k}") for k in KEYS], "paper_id_paper", "paper_id_daan")
    same = F.lit(True)
    for k in KEYS:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    own, other = F.when(F.col("kind") == "paper", F.col("paper_id_paper")).otherwise(F.col("paper_id_daan")), F.coalesce("paper_id_paper", "paper_id_daan")
    actual = F.when(own.isNotNull(), F.col("kind")).when(F.col("kind") == "paper", "daan").otherwise("paper")
    return ids.join(sheets, same).select("paper_id", "kind", F.coalesce(own, other).alias("chosen_id"), actual.alias("actual"))


def grade_bands(rows: DataFrame) -> DataFrame:
    """(county, school_name, bands): the levels that a school's grades belong to, in order; all where none is known."""
    level = names.level_of(F.col("grade"))
    got = rows.filter("school_name is not null").groupBy("county", "school_name").agg(F.collect_set(level).alias("of"))
    order = F.array(*map(F.lit, names.LEVELS))
    return got.select("county", "school_name", F.array_join(F.when(F.size("of") == 0, order).otherwise(F.filter(order, lambda x: F.array_contains("of", x))), ",").alias("bands"))


def needs_text_pass(rows: DataFrame, only_dump: bool = False, only_blank: bool = False) -> DataFrame:
    """Rows whose cover is to be read: of dumps only, or with a blank among five fields only."""
    out = rows
    if only_dump:
        out = out.filter(F.contains("rel_path", F.lit("/_drivefolder/")))
    if only_blank:
        out = out.filter(" or ".join(f"coalesce({c}, '') = ''" for c in ("school_year", "school_term", "exam_type", "school_name", "county")))
    return out


def without_takedowns(rows: DataFrame, takedowns: DataFrame) -> DataFrame:
    """Rows that no takedown names; takedowns (paper_id) may repeat."""
    return rows.join(takedowns.select("paper_id"), "paper_id", "left_anti")
