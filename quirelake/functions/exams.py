"""Expressions over national exams and exam banks: file names, listings, urls, destinations. Column to Column only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirelake.functions.links import any_word, unquoted
from quirelake.functions.names import blank_to_null, found, lookup
from quirelake.functions.schools import COUNTIES, first_that

#: Subjects and kinds of sheet of the junior exam.
CAP_SUBJECTS, CAP_KINDS = ["國文", "英語", "數學", "社會", "自然", "寫作測驗"], ["參考答案", "其他", "試題說明"]
#: Words of a listing's title and the subject they mean, in order.
CAP_WORDS = {"國文": "國文", "國語": "國文", "英語": "英語", "英文": "英語", "數學": "數學", "社會": "社會", "自然": "自然", "寫作": "寫作測驗", "參考答案": "參考答案", "試題說明": "試題說明"}
#: Subjects of the senior exams, and longer names of some.
CEEC_SUBJECTS = ["國文", "英文", "數學", "社會", "自然", "國綜", "國寫", "數a", "數b", "數甲", "數乙", "物理", "化學", "生物", "歷史", "地理", "公民與社會"]
CEEC_LONG = {"國語文綜合能力測驗": "國綜", "國語文寫作能力測驗": "國寫", "數學a": "數a", "數學b": "數b", "數學甲": "數甲", "數學乙": "數乙", "公民": "公民與社會"}
CEEC_SHORT = {"國": "國文", "數": "數學", "社": "社會", "自": "自然", "英": "英文"}
#: Words of a listed file's name and the subject they mean, in order.
GSAT_WORDS = {"國綜": "國綜", "國寫": "國寫", "國語": "國綜", "國文": "國綜", "英文": "英文", "英語": "英文", "數A": "數A", "數B": "數B", "數學A": "數A", "數學B": "數B", "社會": "社會", "自然": "自然", "寫作": "國寫"}
#: Words of national exams and of mock exams.
NATIONAL, MOCK = ["學測", "指考", "分科測驗", "統測", "英聽"], ["會考", "模擬考"]


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.pdf$", "")


def _pair(subject: Column, kind: Column) -> Column:
    return F.struct(subject.alias("subject"), kind.alias("file_type"))


def cap_name(name: Column) -> Column:
    """struct(subject, file_type) of year_subject_kind[_id] names; a third part that looks like an id is no kind; blank
    where nothing is known."""
    parts = F.split(_stem(name), "_")
    what, third = F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    is_id = (F.length(third) >= 6) & third.rlike(r"(?U)^[\p{L}\p{N}-]+$") & F.replace(third, F.lit("-"), F.lit("")).rlike(r"(?U)^[\p{L}\p{N}]+$") & ~third.rlike("[一-鿿]")
    known = F.when(what.isin(*CAP_KINDS), _pair(F.lit(""), what)).otherwise(_pair(F.when(what.isin(*CAP_SUBJECTS), what).otherwise(""), F.when(is_id, "").otherwise(third)))
    return F.when((F.size(parts) >= 3) & F.get(parts, F.lit(0)).rlike(r"^\d+$"), known).otherwise(_pair(F.lit(""), F.lit("")))


def _longest(text: Column) -> Column:
    """The longest subject's name, short or long, that the text begins with."""
    names = sorted([*CEEC_SUBJECTS, *CEEC_LONG], key=len, reverse=True)
    return first_that(names, lambda n: F.startswith(text, n))


def _shortened(subject: Column) -> Column:
    return F.coalesce(lookup(subject, CEEC_LONG), subject)


def ceec_name(name: Column) -> Column:
    """struct(subject, file_type) of the four layouts of senior exam files; blank for other names."""
    stem = _stem(name)
    parts = F.split(stem, "_")
    last, before = F.element_at(parts, -1), F.get(parts, F.size(parts) - 2)
    track = F.contains(stem, F.lit("_")) & F.contains(stem, F.lit("音軌對照表"))
    titled = F.contains(stem, F.lit("試題音軌對照表"))
    numbered = blank_to_null(F.regexp_extract(stem, r"^\d{1,3}-\d{2,3}(?:學測|分科(?:測驗)?|指考)(.+)$", 1))
    plain = blank_to_null(F.regexp_extract(stem, r"^\d{2,3}(?:學測|分科(?:測驗)?|指考)(.+)$", 1))
    spoken = (F.size(parts) >= 3) & F.get(parts, F.lit(0)).rlike(r"sat$|^\d+$")
    voice = F.get(parts, F.lit(1)) == "語音"
    middle = lambda at: F.array_join(F.slice(parts, at, F.greatest(F.size(parts) - at, F.lit(0))), "_")

    def cut(rest: Column) -> Column:
        hit = _longest(rest)
        return _pair(F.coalesce(_shortened(hit), F.lit("")), F.when(hit.isNull(), rest).otherwise(F.substring(rest, F.length(hit) + 1, F.length(rest))))

    return (
        F.when(track & titled, _pair(F.coalesce(_shortened(_longest(last)), last), F.lit("試題音軌對照表")))
        .when(track, _pair(F.coalesce(lookup(before, CEEC_SHORT), before), F.concat(F.lit("音軌對照表_"), last)))
        .when(numbered.isNotNull(), cut(numbered))
        .when(spoken & voice, _pair(_shortened(middle(3)), F.concat(F.lit("語音_"), last)))
        .when(spoken, _pair(_shortened(middle(2)), last))
        .when(plain.isNotNull(), cut(plain))
        .otherwise(_pair(F.lit(""), F.lit("")))
    )


def gsat_name(name: Column) -> Column:
    """struct(year, subject, file_type) of a listed file's name: the year by the first of five rules that gives one, from
    80 to 130 but for the first; 0 and blank where unknown."""
    text = F.replace(unquoted(name), F.lit(".pdf"), F.lit(""))
    fits = lambda y: F.when(y.between(80, 130), y)
    number = lambda p: found(text, p).cast("int")
    all_ = F.transform(F.regexp_extract_all(text, F.lit(r"(?<!\d)(\d{2,3})(?!\d)"), F.lit(1)), lambda x: x.cast("int"))
    last = F.element_at(F.concat(F.array(F.lit(None).cast("int")), F.filter(all_, lambda y: y.between(80, 130))), -1)
    year = F.coalesce(
        number(r"(?i)(?:^|\D)(\d{2,3})(?:學測|分科|指考|學年度|sat)"),
        fits(number(r"(?:^|\D)(\d{2})\s*(?=[a-zA-Z一-鿿])")),
        fits(number(r"[-_](\d{2,3})(?:[a-zA-Z一-鿿.]|$)")),
        last,
        fits(number(r"^(\d{2})\d{2,4}")),
        F.lit(0),
    )
    kind = F.when(any_word(text, ["試題", "試卷"]), "試題")
    for word in ("答題卷", "評分原則", "答案"):
        kind = kind.when(F.contains(text, F.lit(word)), word)
    subject = lookup(first_that(list(GSAT_WORDS), lambda w: F.contains(text, w)), GSAT_WORDS)
    return F.struct(year.alias("year"), F.coalesce(subject, F.lit("")).alias("subject"), F.coalesce(kind.otherwise(None), F.lit("")).alias("file_type"))


def cap_listing(url: Column, title: Column) -> Column:
    """struct(file_id, subject) of a listed link; null if it is no file of the drive."""
    subject = F.coalesce(lookup(first_that(list(CAP_WORDS), lambda w: F.contains(title, w)), CAP_WORDS), F.lit("其他"))
    file_id = found(url, r"drive\.google\.com/file/d/([a-zA-Z0-9_-]+)")
    return F.when(file_id.isNotNull(), F.struct(file_id.alias("file_id"), subject.alias("subject")))


def cap_destination(exam: Column, year: Column, subject: Column, title: Column, file_id: Column) -> Column:
    """Where a junior exam's file goes: exam/year年/year_subject[_title]_id.pdf, thirty characters of a title that says
    more than the subject."""
    y = F.when((exam == "基測") & (F.coalesce(year, F.lit(0)) == 0), "未分類").otherwise(F.concat(year, F.lit("年")))
    text = F.trim(title)
    more = (text != "") & (text != subject)
    safe = F.substring(F.regexp_replace(text, r'[<>:"/\\|?*\x00-\x1f]', "_"), 1, 30)
    name = F.when(more, F.concat_ws("_", year, subject, safe, F.substring(file_id, 1, 6))).otherwise(F.concat_ws("_", year, subject, F.substring(file_id, 1, 8)))
    return F.concat_ws("/", F.when(exam == "基測", "基測").otherwise("會考"), y, F.concat(name, F.lit(".pdf")))


def cap_priority(subject: Column, title: Column) -> Column:
    """1 for core papers, 2 for samples and answer sheets, 3 for the rest."""
    core = [*CAP_SUBJECTS, "參考答案", "試題說明"]
    return F.when(subject.isin(*core), 1).when(any_word(title, ["樣卷", "答題卷", "級分"]), 2).otherwise(3)


def bank_url(url: Column) -> Column:
    """struct(year, school, grade, subject, exam_term, level) of an exam bank's paper url (year-title-hash): a senior or
    junior school's title, or a mock exam's; null for others."""
    whole = r"^https?://[^/]+/paper/(\d+)-(.+)-[a-f0-9]{8}$"
    title, year = F.regexp_extract(url, whole, 2), found(url, whole).cast("int")
    nth = F.coalesce(found(title, r"第(\d+)"), F.lit("?"))
    senior, junior, mock = r"^\d+年(.+?)(高[一二三])([^第]+)第", r"^\d+年(.+?)([七八九])年級([^第]+)第", r"^\d+年(.+?)(?:會考|模擬考)"
    part = lambda p, i: F.trim(F.regexp_extract(title, p, i))

    def made(school: Column, grade: Column, subject: Column, term: Column, level: str) -> Column:
        return F.struct(year.alias("year"), school.alias("school"), grade.alias("grade"), subject.alias("subject"), term.alias("exam_term"), F.lit(level).alias("level"))

    return F.when(
        year.isNotNull(),
        F.when(title.rlike(senior), made(part(senior, 1), F.concat(part(senior, 2), F.lit("年級")), part(senior, 3), nth, "senior"))
        .when(title.rlike(junior), made(part(junior, 1), F.concat(part(junior, 2), F.lit("年級")), part(junior, 3), nth, "junior"))
        .when(title.rlike(mock), made(F.lit("(模擬考)"), F.lit("九年級"), part(mock, 1), F.lit("模擬"), "junior")),
    )


def is_national(title: Column) -> Column:
    return any_word(title, NATIONAL)


def is_mock(title: Column) -> Column:
    return any_word(title, MOCK)


def guessed_county(school: Column, table: dict[str, str]) -> Column:
    """A school's county by a table, by the table without the name's beginning, as a county itself, by the beginning; a mere
    市立 or 縣立 is 未分類; else null."""
    bare = F.regexp_replace(school, "^(?:國立|市立|縣立|私立|臺北市立|臺中市立|高雄市立)", "")
    at = first_that(COUNTIES[:6], lambda c: F.startswith(school, F.concat(c, F.lit("立"))))
    return F.coalesce(lookup(school, table), lookup(bare, table), F.when(school.isin(*COUNTIES), school), at, F.when(F.startswith(school, F.lit("市立")) | F.startswith(school, F.lit("縣立")), "未分類"))


def bank_status(done: Column, of: Column, title: Column, county: Column) -> Column:
    """What becomes of a paper: done, parse_fail, national_exam_skip, mock_exam, no_county or ready, in this order."""
    return F.when(done, "done").when(of.isNull(), "parse_fail").when(is_national(title), "national_exam_skip").when(county.isNull() & is_mock(title), "mock_exam").when(county.isNull(), "no_county").otherwise("ready")
