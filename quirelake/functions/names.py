"""Expressions over paths and file names: ids, layout, file-name fields, display titles. Column to Column, but for
``computed`` and ``computed_once``.

Blank and null mean the same on input; a field that is not found is null unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Grade names and the level they belong to.
GRADES = ["一年級", "二年級", "三年級", "四年級", "五年級", "六年級", "七年級", "八年級", "九年級", "十年級", "十一年級", "十二年級"]
LEVELS = ["國小", "國中", "高中"]
#: Publishers of textbooks, as they stand at the end of a file name, and the mark of an unknown one.
PUBLISHERS = ["康軒", "南一", "翰林", "育成", "奇鼎", "全華", "何嘉仁"]
UNKNOWN = "未註明"
#: Kinds of files that an archive holds.
KINDS = [".pdf", ".docx", ".doc"]
#: Characters that a directory name may not hold, and their full-width forms.
UNSAFE, SAFE = '/\\:*?"<>|', "／＼：＊？＂＜＞｜"


def computed(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with more columns, each computed once however often it is read: a generator of one row keeps the
    optimiser from writing a long expression out again at every use, or into a filter. It is given values only: a
    projection, which Spark compiles, makes them; a generator's own expressions may be interpreted row by row."""
    values = rows.select("*", F.struct(*[c.alias(n) for n, c in columns.items()]).alias("_value"))
    return values.select(*rows.columns, F.explode(F.array("_value")).alias("_made")).select(*rows.columns, "_made.*")


def computed_once(rows: DataFrame, key: str, **columns: Column) -> DataFrame:
    """``rows`` with more columns that follow from ``key`` alone, made once for each of its values. Good where many rows share
    a value; few values are sent to the rows, many are joined."""
    each = computed(rows.select(key).distinct(), **columns).withColumnRenamed(key, "_key")
    return rows.join(each, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once: it is bound to the variable of a function over an array of one element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """The group's text, or null if the pattern does not match or the group is empty. The text is searched once: a nullif
    would read the match twice."""
    return F.get(F.filter(F.array(F.regexp_extract(c, pattern, group)), lambda t: t != ""), F.lit(0))


def found_with(c: Column, word: str, pattern: str, group: int = 1) -> Column:
    """``found`` by a pattern that needs ``word``: a text without the word, which costs little to see, is not searched."""
    return F.when(F.contains(c, F.lit(word)), found(c, pattern, group))


def first_of(c: Column, words: list[str]) -> Column:
    """The first word, in the order of the list, that the text holds."""
    return F.get(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(c, w)), F.lit(0))


def lookup(c: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), c)


def paper_id(path: Column) -> Column:
    """Id of a file by its relative path, whatever its case."""
    return F.substring(F.sha1(F.lower(path)), 1, 16)


def content_id(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 12)


def level_of(grade: Column) -> Column:
    return lookup(grade, {g: LEVELS[i // 6 if i < 6 else 1 + (i - 6) // 3] for i, g in enumerate(GRADES)})


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.coalesce(found(path, r"(\.[^./]+)$"), F.lit("")))


def safe_name(c: Column) -> Column:
    """A name fit for a directory: full-width forms, no control characters, blank becomes a placeholder."""
    cleaned = F.trim(F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), UNSAFE, SAFE), r"[\x00-\x1F]", ""))
    return F.coalesce(blank_to_null(cleaned), F.lit("_未分類"))


def is_answer(path: Column) -> Column:
    return F.contains(path, F.lit("解答")) | F.contains(path, F.lit("答案")) | F.contains(F.lower(path), F.lit("answer"))


def guess_filetype(name: Column) -> Column:
    return F.when(is_answer(name), "daan").otherwise("paper")


def layout(path: Column) -> Column:
    """struct(layout, county, level, grade, subject, filetype) of a relative path; null: not an archive file.

    ``dump``: _未分類/DriveFolder/county/school/.../name, PDF only; ``full``: county/level/grade/subject/filetype/.../name;
    ``legacy``: county/level/grade/subject/.../name, a question sheet; ``school``: county/.../name with two folders or
    more, of which only the county is known.
    """
    return bound(F.split(path, "/"), lambda parts: _layout(path, parts))


def _layout(path: Column, parts: Column) -> Column:
    part = lambda i: F.get(parts, F.lit(i))
    dirs = F.size(parts) - 1
    dump = (dirs >= 4) & (part(0) == "_未分類") & (part(1) == "DriveFolder")
    legacy = (dirs >= 4) & part(1).isin(*LEVELS)
    full = legacy & (dirs >= 5) & F.coalesce(part(4), F.lit("")).isin("paper", "daan")
    none = F.lit("")

    def made(kind: str, *fields: Column) -> Column:
        names = ["county", "level", "grade", "subject", "filetype"]
        return F.struct(F.lit(kind).alias("layout"), *[f.alias(n) for n, f in zip(names, fields, strict=True)])

    return (
        F.when(dump & (extension(path) != ".pdf"), None)
        .when(dump, made("dump", part(2), none, none, none, guess_filetype(F.element_at(parts, -1))))
        .when(full, made("full", *[part(i) for i in range(5)]))
        .when(legacy, made("legacy", *[part(i) for i in range(4)], F.lit("paper")))
        .when((dirs >= 2) & (part(0) != ""), made("school", part(0), none, none, none, none))
    )


def canonical_path(path: Column, faithful: bool = False) -> Column:
    """The path under which a file is catalogued: a dump's file moves to county/school/_drivefolder/rest. ``faithful``
    leaves out the file's name there, so that all files of a folder share one path."""
    parts = F.split(path, "/")
    dump = (F.size(parts) >= 5) & (F.get(parts, F.lit(0)) == "_未分類") & (F.get(parts, F.lit(1)) == "DriveFolder")
    rest = F.slice(parts, 5, F.greatest(F.size(parts) - (5 if faithful else 4), F.lit(0)))
    return F.when(dump, F.array_join(F.concat(F.slice(parts, 3, 2), F.array(F.lit("_drivefolder")), rest), "/")).otherwise(path)


def pruned(path: Column, skip: list[str]) -> Column:
    """True for a file that a listing leaves out: skipped top folders, generic folders, unsorted ones but the dump,
    other kinds of files."""
    parts = F.split(path, "/")
    top, second = F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    return F.lower(top).isin(*[x.lower() for x in skip]) | F.array_contains(F.slice(parts, 1, F.size(parts) - 1), "_generic") | ((top == "_未分類") & (second != "DriveFolder")) | ~extension(path).isin(*KINDS)


def fallback_year(name: Column) -> Column:
    """A year from 100 to 115 in any text: the first before 學年度, 學年, 年, 上 or 下, else the first at all."""
    year = "(10[0-9]|11[0-5])"
    return F.coalesce(found(name, year + "(?:學年度|學年|年|[下上])"), found(name, year))


def parse_file_name(name: Column, county: Column | None = None) -> Column:
    """struct(school_year, school_term, exam_type, fileid, school_name, version, grade, subject) of an archive file name.

    The parts between underscores decide, after the county (any first part where none is given):
    year, exam, fileid, school, version; the same with a term behind the year; year, 第N學期, exam, school, grade,
    subject (the term stays absent); year, exam, school, grade, subject; the latter two may end in 解答. A version is
    a known publisher, or up to four word characters. Other names give a year only, see ``fallback_year``.
    """
    rest = F.regexp_extract(name, "^[^_]+_(.*)$", 1) if county is None else F.when(F.startswith(name, F.concat(county, F.lit("_"))), F.substring(name, F.length(county) + 2, F.length(name))).otherwise("")
    known = F.regexp_extract(rest, r"^(.*)\.(?:pdf|docx|doc)$", 1)
    fields = ["school_year", "school_term", "exam_type", "fileid", "school_name", "version", "grade", "subject"]
    none = F.lit(None).cast("string")

    def of(x: Column) -> Column:
        part = lambda i: F.coalesce(F.get(x, F.lit(i)), F.lit(""))
        tail = lambda i: F.array_join(F.slice(x, i + 1, F.greatest(F.size(x) - i, F.lit(0))), "_")
        year, with_term = part(0).rlike(r"^\d{3}$"), part(0).rlike("^\\d{3}[下上]學期$")
        version = tail(4)
        standard = (F.size(x) >= 5) & part(2).rlike(r"^\d+$") & (part(1) != "") & (part(3) != "") & (version.isin(*PUBLISHERS, UNKNOWN) | version.rlike(r"(?U)^\w{1,4}$"))
        answer = lambda n: (F.size(x) == n) | ((F.size(x) == n + 1) & (part(n) == "解答"))
        nth = year & answer(6) & part(1).rlike(r"^第\d學期$") & part(4).isin(*GRADES[:9]) & (part(2) != "") & (part(3) != "") & (part(5) != "")
        plain = year & answer(5) & part(3).isin(*GRADES) & (part(1) != "") & (part(2) != "") & (part(4) != "")

        def made(**given: Column) -> Column:
            return F.struct(*[given.get(f, none).alias(f) for f in fields])

        digits, term = F.substring(part(0), 1, 3), blank_to_null(F.substring(part(0), 4, 3))
        return (
            F.when(standard & (year | with_term), made(school_year=digits, school_term=term, exam_type=part(1), fileid=part(2), school_name=part(3), version=version))
            .when(nth, made(school_year=part(0), exam_type=part(2), school_name=part(3), version=F.lit(UNKNOWN), grade=part(4), subject=part(5)))
            .when(plain, made(school_year=part(0), exam_type=part(1), school_name=part(2), version=F.lit(UNKNOWN), grade=part(3), subject=part(4)))
            .otherwise(made(school_year=fallback_year(name)))
        )

    return bound(F.split(known, "_"), of)


def fallback_school(path: Column, name: Column) -> Column:
    """A school's name where the file name does not parse: ...市 or 縣...國中, 國小 or 高中 in the path, else any such ending
    in the file's name."""
    return F.coalesce(found(path, r"(?U)(\w+(?:市|縣)\w*(?:國中|國小|高中))"), found(name, r"(?U)(\w*(?:國中|國小|高中))"))


def counted_school(name: Column, county: Column) -> Column:
    """The school that statistics read from a file's name after its county: by the place before grade and subject in
    第N學期 names, before the publisher in names with an id, else before the last part; grades that stand there are none."""
    rest = F.when(F.startswith(name, F.concat(county, F.lit("_"))), F.substring(name, F.length(county) + 2, F.length(name)))
    maker, ending, exam = "(?:" + "|".join(PUBLISHERS) + r"|\w{1,4})", r"\.(?:pdf|docx|doc)$", "(?:期中考|期末考|段考|考試)"
    forms = [rf"^\d{{3}}_第\d學期_\w+_(.+?)_.+?_.+?(?:_解答)?{ending}", rf"^\d{{3}}_{exam}_\d+_(.+?)_{maker}{ending}", rf"^\d{{3}}[下上]學期_{exam}_\d+_(.+?)_{maker}{ending}", rf"^\d{{3}}_\w+_(?:\d+_)?(.+?)_{maker}(?:_解答)?{ending}"]
    return bound(rest, lambda r: bound(F.coalesce(*[found(r, "(?U)" + f) for f in forms]), lambda s: F.when(~s.isin(*GRADES[:3], *GRADES[6:9]), s)))


def title(school: Column, year: Column, term: Column, exam: Column, grade: Column, subject: Column, version: Column) -> Column:
    """Fields joined by blanks, empty ones and an unknown version left out."""
    year_text = F.concat(blank_to_null(year), F.lit("學年度"))
    version_text = F.concat(F.lit("("), F.nullif(blank_to_null(version), F.lit(UNKNOWN)), F.lit(")"))
    return F.concat_ws(" ", blank_to_null(school), year_text, blank_to_null(term), blank_to_null(exam), blank_to_null(grade), blank_to_null(subject), version_text)


def parse_fixed_name(name: Column) -> Column:
    """struct(school_year, school_term, exam_type, subject, grade, school_name, version) of a name that ends in
    _drivefolder.pdf and has before that county, year with or without term, exam, subject, grade, school, version, or
    the same without the exam; an unknown year, exam or version counts as absent; null for other names."""
    parts = F.split(F.regexp_extract(name, r"^(.*)_drivefolder\.pdf$", 1), "_")
    exam = F.size(parts) - 6  # one more part where the exam is named
    part = lambda i: F.get(parts, F.lit(i) if isinstance(i, int) else i)
    known = lambda c: F.nullif(c, F.lit(UNKNOWN))
    year = r"^(\d{3})(?:上學期|下學期)?$"
    made = F.struct(
        found(part(1), year).alias("school_year"),
        found(part(1), r"^\d{3}(上學期|下學期)$").alias("school_term"),
        F.when(exam == 1, known(part(2))).alias("exam_type"),
        part(exam + 2).alias("subject"),
        part(exam + 3).alias("grade"),
        part(exam + 4).alias("school_name"),
        known(part(exam + 5)).alias("version"),
    )
    return F.when(F.endswith(name, F.lit("_drivefolder.pdf")) & F.size(parts).isin(6, 7), made)


def minimal_parse(name: Column) -> Column:
    """struct(county, school_year, school_term, exam_type, subject, grade, school_name) of a PDF name of seven parts or
    more, by their places; an unknown subject is 未分類, an unknown grade 未註明, other unknown parts are absent."""
    parts = F.split(F.regexp_extract(name, r"^(.*)\.pdf$", 1), "_")
    known = lambda i: F.nullif(F.get(parts, F.lit(i)), F.lit(UNKNOWN))
    made = F.struct(
        known(0).alias("county"),
        found(known(1), r"^(\d{3})(?:上學期|下學期)?$").alias("school_year"),
        found(known(1), r"^\d{3}(上學期|下學期)$").alias("school_term"),
        known(2).alias("exam_type"),
        F.coalesce(known(3), F.lit("未分類")).alias("subject"),
        F.coalesce(known(4), F.lit(UNKNOWN)).alias("grade"),
        known(5).alias("school_name"),
    )
    return F.when(F.size(parts) >= 7, made)
