"""Expressions over files in the inbox: fields from names and folders, and their merge by priority. Column to Column only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirelake.functions.links import any_word
from quirelake.functions.names import GRADES, blank_to_null, bound, file_name, found, level_of, lookup
from quirelake.functions.schools import archive_name, first_that, normalise_year

_N = "一二三四五六七八九"
_CN = dict(zip("123456789", GRADES, strict=False))
#: Grades as names spell them, in order.
SPELLED_GRADES = {
    **{f"國{c}": GRADES[6 + i] for i, c in enumerate("一二三四五六")},
    **{f"小{c}": GRADES[i] for i, c in enumerate("一二三四五六")},
    **{g[:-1]: g for g in GRADES},
    **{f"高{c}": GRADES[9 + i] for i, c in enumerate("一二三")},
}
#: Subjects, other names of some, and single characters behind a grade.
SUBJECTS = ["國文", "國語", "英文", "英語", "數學", "自然", "社會", "理化", "生物", "歷史", "地理", "公民", "健康", "體育", "音樂", "美術", "家政", "生活", "綜合", "資訊", "科技", "作文", "閱讀"]
OTHER_NAMES = {"國語文": "國文", "英語": "英文", "國語": "國文"}
SIGNS = {"國": "國文", "社": "社會", "自": "自然", "英": "英文", "數": "數學", "理": "理化"}
#: Exams and the words that mean them, in order.
EXAMS = [
    ("第一次段考", ["第一次段考", "第一次段", "一段", "第1次段考", "第1次段"]),
    ("第二次段考", ["第二次段考", "第二次段", "二段", "第2次段考", "第2次段"]),
    ("第三次段考", ["第三次段考", "第三次段", "三段", "第3次段考", "第3次段"]),
    ("第一次定期考", ["第一次定期考", "第一次定期", "一定", "第1次定期考"]),
    ("第二次定期考", ["第二次定期考", "第二次定期", "二定", "第2次定期考"]),
    ("第三次定期考", ["第三次定期考", "第三次定期", "三定", "第3次定期考"]),
    ("第一次月考", ["第一次月考", "第一次月", "一月", "第1次月考"]),
    ("第二次月考", ["第二次月考", "第二次月", "二月", "第2次月考"]),
    ("第三次月考", ["第三次月考", "第三次月", "三月", "第3次月考"]),
    ("期中考", ["期中"]),
    ("期末考", ["期末"]),
    ("第一次評量", ["第一次評", "一評", "第1次評量"]),
    ("第二次評量", ["第二次評", "二評", "第2次評量"]),
    ("第三次評量", ["第三次評", "三評", "第3次評量"]),
    ("階段評量", ["階段評量", "第1階段", "第2階段", "第3階段", "第一階段", "第二階段", "第三階段"]),
]
#: Endings of answer sheets' names.
ANSWERS = ["解答", "答案", "正解", "解答卷", "答案卷", "正解卷"]


def is_answer_name(name: Column) -> Column:
    """_daan in the name, or a word for answers at the end of its stem or in brackets."""
    base = F.regexp_replace(name, r"\.(?:pdf|docx?)", "")
    words = "|".join(sorted(ANSWERS, key=len, reverse=True))
    return F.contains(name, F.lit("_daan")) | base.rlike(f"(?:{words})$|\\((?:{words})\\)|（(?:{words})）")


def _grade(name: Column) -> Column:
    digit = lambda p: lookup(found(name, p), _CN)
    chinese = lambda p: F.concat(found(name, p), F.lit("年級"))
    by_number = lambda n: F.coalesce(lookup(n, _CN), F.when(n.isin("10", "11", "12"), F.concat(n, F.lit("年級"))))
    return F.coalesce(
        lookup(first_that(list(SPELLED_GRADES), lambda w: F.contains(name, w)), SPELLED_GRADES),
        chinese(f"([{_N}])[國社自英數理]"),
        digit(r"(\d)[國社自英數理]"),
        digit("([1-9])年級"),
        F.concat(first_that(["七", "八", "九"], lambda w: F.contains(name, w)), F.lit("年級")),
        bound(found(name, r"(\d+)年(?!級)"), by_number),
    )


def _year(name: Column) -> Column:
    return F.coalesce(*[found(name, p) for p in (r"(1\d{2})學年度", r"(1\d{2})[上下123](?:段|學期|期中考|期末|考|月)", r"^(1\d{2})[\d_-]", r"(1\d{2})")])


def _term(name: Column) -> Column:
    near = lambda t: name.rlike(rf"\d{{3}}{t}(?:[123{_N}]段|[123]?(?:學期|$|_[^0-9])|(?=[{_N}\d]年級))")
    by_number = lookup(F.coalesce(found(name, r"-(\d)-(?:\d|$)").cast("string"), F.lit("")), {"1": "上學期", "2": "下學期"})
    return F.coalesce(
        F.when(any_word(name, ["第一學期", "上學", "上1學期"]), "上學期"),
        F.when(any_word(name, ["第二學期", "下學", "上2學期", "下1學期"]), "下學期"),
        F.when(F.contains(name, F.lit("第1學期")), "上學期").when(F.contains(name, F.lit("第2學期")), "下學期"),
        F.when(near("上"), "上學期").when(near("下"), "下學期"),
        by_number,
        lookup(found(name, r"^1\d{2}([123])"), {"1": "上學期", "2": "下學期"}),
    )


def _exam(name: Column) -> Column:
    by_answer = lookup(found(name, r"解答(\d)"), {d: f"第{c}次段考" for d, c in zip("123", "一二三", strict=True)})
    return F.coalesce(by_answer, *[F.when(any_word(name, words), exam) for exam, words in EXAMS])


def _subject(name: Column) -> Column:
    long = first_that(SUBJECTS, lambda w: F.contains(name, w))
    sign = found(name, f"^[^國社自英數理]*[{_N}\\d]([國社自英數理])")
    return F.coalesce(plain_subject(long), lookup(sign, SIGNS))


def plain_subject(subject: Column) -> Column:
    return F.coalesce(lookup(subject, OTHER_NAMES), subject)


def name_fields(name: Column) -> Column:
    """struct(grade, school_year, school_term, exam_type, subject) of a file's name, each by ordered rules of its own."""
    stem = F.regexp_replace(F.regexp_replace(name, r"\.(?:pdf|docx?)$", ""), "_(?:daan|paper)$", "")
    return bound(stem, lambda s: F.struct(_grade(s).alias("grade"), _year(s).alias("school_year"), _term(s).alias("school_term"), _exam(s).alias("exam_type"), _subject(s).alias("subject")))


def path_fields(path: Column) -> Column:
    """struct(grade, subject, filetype, school_name) of _inbox/county/level/grade/subject/kind/file, or of
    _inbox/place/school/...; fields that are not there are null."""
    none = F.lit(None).cast("string")

    def of(parts: Column) -> Column:
        part = lambda i: F.get(parts, F.lit(i))
        sorted_ = (F.size(parts) >= 6) & part(2).isin("國小", "國中", "高中")
        kind = F.when(part(5).isin("daan", "paper"), part(5))
        subject = F.when(~part(4).isin("daan", "paper"), plain_subject(part(4)))
        return F.when(sorted_, F.struct(part(3).alias("grade"), subject.alias("subject"), kind.alias("filetype"), none.alias("school_name"))).when(
            F.size(parts) >= 4, F.struct(none.alias("grade"), none.alias("subject"), none.alias("filetype"), blank_to_null(part(2)).alias("school_name"))
        )

    return bound(F.split(path, "/"), of)


def exam_folder(name: Column) -> Column:
    """struct(school_year, school_term, exam_type) of folders such as 108下學期第一次段考, 108下學期 or 108下2段."""
    nth = {**{c: c for c in "一二三"}, **dict(zip("123", "一二三", strict=True))}
    full, term, short = r"^(\d{2,3})([上下])學期第?([一二三123])次", r"^(\d{2,3})([上下])學期", r"^(\d{2,3})([上下])?([一二三123])段"

    def made(pattern: str, exam: bool) -> Column:
        part = F.coalesce(found(name, pattern, 2), F.lit("下"))
        number = F.concat(F.lit("第"), lookup(found(name, pattern, 3), nth), F.lit("次段考")) if exam else F.lit(None).cast("string")
        return F.struct(normalise_year(found(name, pattern)).alias("school_year"), F.concat(part, F.lit("學期")).alias("school_term"), number.alias("exam_type"))

    return F.when(name.rlike(full), made(full, True)).when(name.rlike(term), made(term, False)).when(name.rlike(short), made(short, True))


def drive_path(path: Column) -> Column:
    """struct(county, school_name, subject, school_year, school_term, exam_type) of
    _inbox/_未分類/DriveFolder/county/school/year/exam[/subject]/.../file.pdf; null for other paths and for files in the making."""
    parts = F.split(path, "/")
    part = lambda i: F.get(parts, F.lit(i))
    fits = (F.size(parts) >= 9) & (F.array_join(F.slice(parts, 1, 3), "/") == "_inbox/_未分類/DriveFolder") & F.lower(path).rlike(r"\.pdf$")
    made = ~F.array_contains(parts, "_converted") & ~F.startswith(file_name(path), F.lit(".~lock"))
    exam = exam_folder(part(6))
    year = F.coalesce(exam["school_year"], found(part(5), r"^(\d{2,3})學年度"))
    return F.when(fits & made, F.struct(part(3).alias("county"), part(4).alias("school_name"), plain_subject(part(7)).alias("subject"), year.alias("school_year"), exam["school_term"].alias("school_term"), exam["exam_type"].alias("exam_type")))


def merged(name: Column, side: Column, path: Column, county: Column) -> Column:
    """struct of a file's fields: those of its name first, then of its side file (subject, school_name, grade), then of its
    path; 社會 is told closer by the name; missing lists the required fields that are blank, and action says whether the
    file can be kept."""
    return bound(read_name(name), lambda of: merged_with(of, side, path, county))


def read_name(name: Column) -> Column:
    """struct of all that a merge takes from a file's name: its fields, the subject that tells 社會 closer, and whether it is
    an answer sheet's."""
    closer = first_that(["公民", "地理", "歷史"], lambda w: F.contains(name, w))
    return F.struct(name_fields(name).alias("fields"), closer.alias("closer"), is_answer_name(name).alias("answer"))


def merged_with(of: Column, side: Column, path: Column, county: Column) -> Column:
    """``merged``, given what was read from the name. Each step's values are bound, so each is made once a file."""
    fields = bound(path_fields(path), lambda at: _joined(of, side, county, at))

    def judged(x: Column) -> Column:
        missing = F.array_join(F.array_compact(F.array(*[F.when(x[n].isNull(), n) for n in ("county", "grade", "subject", "school_year")])), ",")
        kept = [x[n].alias(n) for n in ("county", "school_name", "grade", "level", "subject", "school_year", "school_term", "exam_type", "filetype")]
        return bound(missing, lambda m: F.struct(*kept, m.alias("missing"), F.when(m == "", "keep").otherwise("skip_low_quality").alias("action")))

    return bound(fields, judged)


def _joined(read: Column, side: Column, county: Column, at: Column) -> Column:
    of = read["fields"]
    subject = F.coalesce(of["subject"], plain_subject(blank_to_null(side["subject"])), at["subject"])
    subject = F.when(subject == "社會", F.coalesce(read["closer"], subject)).otherwise(subject)
    grade = F.coalesce(of["grade"], blank_to_null(side["grade"]), at["grade"])
    where = F.coalesce(blank_to_null(county), F.lit("_未分類"))
    school = F.coalesce(blank_to_null(side["school_name"]), at["school_name"])
    school = F.when(where != "_未分類", archive_name(school, where)).otherwise(school)
    kind = F.coalesce(at["filetype"], F.when(read["answer"], "daan").otherwise("paper"))
    fields = {"county": where, "school_name": school, "grade": grade, "level": level_of(grade), "subject": subject, "school_year": of["school_year"], "school_term": of["school_term"], "exam_type": of["exam_type"], "filetype": kind}
    return F.struct(*[c.alias(n) for n, c in fields.items()])
