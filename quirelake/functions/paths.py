"""Expressions that build paths and file names: archive, re-home, download. Column to Column only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirelake.functions.names import GRADES, LEVELS, UNKNOWN, blank_to_null, level_of, lookup, safe_name
from quirelake.functions.schools import normalise_county, strip_placeholders

UNSORTED, NOWHERE = "未分類", "_未分類"


def _wide(c: Column) -> Column:
    return F.translate(c, "/:", "／：")


def archive_folder(county: Column, grade: Column, subject: Column, filetype: Column) -> Column:
    """county/level/grade/subject/filetype; null without a level, a subject or one of the two kinds of sheet."""
    fits = level_of(grade).isNotNull() & filetype.isin("paper", "daan") & blank_to_null(subject).isNotNull()
    return F.when(fits, F.concat_ws("/", normalise_county(county), level_of(grade), grade, safe_name(subject), filetype))


def archive_name(county: Column, year_term: Column, exam: Column, fileid: Column, school: Column, version: Column) -> Column:
    """county_year_exam_id_school_version, without ending."""
    return F.concat_ws("_", normalise_county(county), year_term, exam, fileid, _wide(school), F.coalesce(blank_to_null(_wide(version)), F.lit(UNKNOWN)))


def level_of_exam(grade: Column, exam: Column) -> Column:
    """The level of a grade, where a primary grade with an exam that only higher schools have is 國中; so is an unknown
    grade."""
    higher = reduce(lambda a, b: a | b, [F.contains(F.coalesce(exam, F.lit("")), F.lit(w)) for w in ("段考", "階段", "評量")])
    level = level_of(grade)
    return F.when((level == LEVELS[0]) & higher, LEVELS[1]).otherwise(F.coalesce(level, F.lit(LEVELS[1])))


def grade_for_level(grade: Column, level: Column) -> Column:
    """The first to third grade counted from the level's own first; others stay."""
    junior, senior = (lookup(grade, dict(zip(GRADES[:3], GRADES[i : i + 3], strict=True))) for i in (6, 9))
    return F.coalesce(F.when(level == LEVELS[1], junior).when(level == LEVELS[2], senior), grade)


def level_of_school(name: Column, category: Column) -> Column:
    """The level by a source's category, else by words in the school's name, else 其他."""
    has = lambda *words: reduce(lambda a, b: a | b, [F.contains(name, F.lit(w)) for w in words])
    by_name = F.when(has("國小", "國民小學"), LEVELS[0]).when(has("國中", "國民中學"), LEVELS[1]).when(has("高中", "高級中學", "高工", "高商"), LEVELS[2])
    return F.coalesce(lookup(category, {"elementary": LEVELS[0], "junior": LEVELS[1], "senior": LEVELS[2]}), by_name, F.lit("其他"))


def _without_county(school: Column, county: Column) -> Column:
    """A school's name without its county at the beginning, however often it is said there."""
    times = F.lit("^(?:")
    pattern = F.concat(times, county, F.lit(")+"))
    return F.when(F.coalesce(county, F.lit("")) == "", school).otherwise(F.regexp_replace(school, pattern, ""))


def home_folder(county: Column, grade: Column, exam: Column, subject: Column) -> Column:
    """county/level/grade/subject without blank or unknown parts; without a county _未分類/grade/subject."""
    level = level_of_exam(grade, exam)
    g = F.when(grade.isin("", UNKNOWN), grade).otherwise(grade_for_level(grade, level))
    keep = lambda parts: F.array_join(F.filter(parts, lambda p: p.isNotNull() & ~p.isin("", UNKNOWN, UNSORTED)), "/")
    nowhere = (F.coalesce(county, F.lit("")) == "") | F.startswith(county, F.lit(NOWHERE))
    return F.when(nowhere, keep(F.array(F.lit(NOWHERE), g, subject))).otherwise(keep(F.array(county, level, g, subject)))


def home_name(county: Column, school: Column, grade: Column, year: Column, term: Column, exam: Column, subject: Column, version: Column, filetype: Column) -> Column:
    """county_school_grade_year_term_exam_subject_version.pdf without blank or unknown parts; an answer sheet ends in _daan
    once; a missing county is _未分類. The county is not said again in the school's name."""
    g = F.when(F.coalesce(grade, F.lit("")) == "", grade).otherwise(grade_for_level(grade, level_of_exam(grade, exam)))
    s = _without_county(strip_placeholders(school), county)
    where = F.when((F.coalesce(county, F.lit("")) == "") | F.startswith(county, F.lit(NOWHERE)), NOWHERE).otherwise(county)
    parts = F.filter(F.array(_wide(s), _wide(g), year, term, _wide(exam), _wide(subject), version), lambda p: p.isNotNull() & ~p.isin("", UNKNOWN, UNSORTED))
    daan = F.when((filetype == "daan") & ~F.endswith(F.coalesce(version, F.lit("")), F.lit("_daan")), F.array(F.lit("daan"))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array_join(F.concat(F.array(where), parts, daan), "_"), F.lit(".pdf"))


def term_of_title(title: Column) -> Column:
    """上學期 or 下學期 if the title names it."""
    return F.when(F.contains(title, F.lit("上學期")), "上學期").when(F.contains(title, F.lit("下學期")), "下學期")


def download_name(school: Column, grade: Column, year: Column, term: Column, title: Column, category: Column, subject: Column, exam: Column, version: Column, filetype: Column) -> Column:
    """The name a reader's download gets: parts joined by underscores, blank ones and a category that repeats the subject
    left out, 試卷 or 答案 last; a missing term comes from the title; characters a name may not hold become wide."""
    when = F.concat(blank_to_null(year), F.coalesce(blank_to_null(term), term_of_title(title), F.lit("")))
    kind = F.when(filetype == "daan", "答案").otherwise("試卷")
    other = F.when(~F.coalesce(category == subject, F.lit(False)), blank_to_null(category))
    joined = F.concat(F.concat_ws("_", blank_to_null(school), blank_to_null(grade), when, other, blank_to_null(subject), blank_to_null(exam), blank_to_null(version), kind), F.lit(".pdf"))
    return F.trim(F.regexp_replace(F.translate(joined, '/\\:*?"<>|', "／＼：＊？＂＜＞｜"), r"[\x00-\x1F]", ""))
