"""Expressions over text: covers, titles, messages, home pages, bytes. Column to Column only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirelake.functions.links import any_word
from quirelake.functions.names import GRADES, LEVELS, blank_to_null, bound, found, found_with, level_of, lookup
from quirelake.functions.schools import ALIASES, COUNTIES, OTHER, first_that, full_year, strip_placeholders

#: Counties as covers spell them.
COVER_COUNTIES = [*COUNTIES, "台北市", "台中市", "台南市", "台東縣"]
#: Counties as titles spell them, in the order in which they are looked for.
TITLE_COUNTIES = ["臺北市", "台北市", "北市", "新北市", "桃園市", "桃園縣", "臺中市", "台中市", "臺南市", "台南市", *COUNTIES[5:]]
#: Grades that covers of senior schools name otherwise.
SPOKEN = {"高一": "十年級", "高二": "十一年級", "高三": "十二年級"}
#: Subjects in the order in which a cover is searched for them.
COVER_SUBJECTS = [
    "自然與生活科技", "健康與體育", "綜合活動領域", "語文學習領域", "健康教育", "資訊科技", "生活科技", "國文", "國語", "英語", "英文", "數學", "自然", "社會", "理化", "生物", "歷史", "地理", "公民", "健康",
    "健體", "體育", "音樂", "美術", "家政", "生活", "綜合", "資訊", "科技", "作文", "閱讀", "童軍",
]
#: Exams of a cover, in order: a word that the pattern needs, the pattern, what it is called around the captured number.
COVER_EXAMS = [
    ("階段", r"第\s*([1-3一二三])\s*次\s*階段\s*評量", "第", "次階段評量"),
    ("階段", r"第\s*([1-3一二三])\s*階段\s*評量", "第", "階段評量"),
    ("定期", r"第\s*([1-3一二三])\s*次\s*定期\s*(?:考|評量)", "第", "次定期考"),
    ("段考", r"第\s*([1-3一二三])\s*次\s*段考", "第", "次段考"),
    ("模擬考", r"第\s*([1-3一二三])\s*次\s*模擬考", "第", "次模擬考"),
    ("月考", r"第\s*([1-3一二三])\s*次\s*月考", "第", "次月考"),
    *[(w, f"({w})", "", "") for w in ("期中考", "期末考", "模擬考", "月考", "複習考")],
    ("定期", r"(定期)(?:評量|考)", "", "評量"),
    ("階段評量", "(階段評量)", "", ""),
]
#: Terms by number.
COVER_TERMS = {"1": "上學期", "一": "上學期", "2": "下學期", "二": "下學期", "3": "第3學期", "三": "第三學期"}
#: Words of which a usable cover has two.
COVER_WORDS = ["學年度", "學年", "學期", "段考", "考試", "年級", "考", "學校", "國民", "縣立", "市立", "附設"]
#: Words of a message that a limit was hit.
LIMIT_WORDS = ["下載太頻繁", "太多次", "明天再試", "稍後再試", "訪問過於頻繁"]


def _first_found(patterns: list[tuple[str, str, str, str]], *texts: Column) -> Column:
    """The first pattern in the first text that has any, its number between the words that go with it."""
    return F.coalesce(*[F.concat(F.lit(before), found_with(t, word, p), F.lit(after)) for t in texts for word, p, before, after in patterns])


def cover_fields(text: Column) -> Column:
    """struct(county, school_name, school_year, school_term, exam_type, filetype, grade, level, subject) of a cover's text;
    a field that is not found is null, and so is all of a missing or empty text. Text set in columns is read once more
    without line ends and blanks."""
    both = F.struct(text.alias("text"), F.translate(text, "\n ", "").alias("compact"))
    fields = lambda x: bound(_school_and_grade(x["text"], x["compact"]), lambda y: _cover_fields(x["text"], x["compact"], y["school"], y["grade"]))
    return F.when(F.coalesce(text, F.lit("")) != "", bound(both, fields))


def _school_and_grade(text: Column, compact: Column) -> Column:
    """struct(school, grade): what the level follows from as well."""
    named = r"([一-鿿]{2,3}[市縣]立?[一-鿿]{2,15}(?:國[民中小]|高中|高工|商職|家商|工商|高商|高職))"
    bare = r"([一-鿿]{2,15}(?:國民中學|國民小學|國中部|國小部|高中部|高級中學|國中|國小|高中|高工|高商|高職|家商|工商))"
    school = bound(F.coalesce(found(compact, named), found(text, named), found(text, bare)), lambda s: F.when(F.contains(s, F.lit("_")), blank_to_null(strip_placeholders(s))).otherwise(s))
    seen = lambda w: F.contains(text, w) | F.contains(compact, w)
    grade = F.coalesce(lookup(first_that(list(SPOKEN), seen), SPOKEN), first_that(GRADES, seen))
    return F.struct(school.alias("school"), grade.alias("grade"))


def _cover_fields(text: Column, compact: Column, school: Column, grade: Column) -> Column:
    tw = lambda c: F.translate(c, "台", "臺")
    county_in = lambda t: tw(bound(F.substring(t, 1, 300), lambda start: first_that(COVER_COUNTIES, lambda c: F.contains(start, c))))
    county = F.coalesce(county_in(text), county_in(compact))
    year = bound(F.coalesce(found_with(text, "學年", r"(\d{2,3})\s*學年"), found_with(compact, "學年", r"(\d{2,3})\s*學年")), full_year)
    number = lambda t: found_with(t, "學期", r"第\s*([1-3一二三])\s*學期")
    half = lambda t: F.coalesce(lookup(number(t), COVER_TERMS), found_with(t, "學期", "([上下]學期)"), F.concat(found_with(t, "半", r"([上下])半\s*年"), F.lit("學期")))
    term = F.coalesce(half(text), half(compact), F.concat(found(text, r"[(（]\s*([上下])\s*[)）]"), F.lit("學期")))
    by_name = F.when(F.contains(school, F.lit("高級中學")) | F.endswith(school, F.lit("高中部")), LEVELS[2])
    by_name = by_name.when(any_word(school, ["國民中學", "國中部"]) | F.endswith(school, F.lit("國中")), LEVELS[1])
    by_name = by_name.when(any_word(school, ["國民小學", "國小部"]) | F.endswith(school, F.lit("國小")), LEVELS[0])
    civics = F.contains(text, F.lit("公民")) & ~F.contains(text, F.lit("社會科"))
    subject = F.replace(first_that(COVER_SUBJECTS, lambda w: F.contains(text, w) & ~((w == "社會") & civics)), F.lit("科"), F.lit(""))
    return F.struct(
        county.alias("county"),
        school.alias("school_name"),
        year.alias("school_year"),
        term.alias("school_term"),
        _first_found(COVER_EXAMS, text, compact).alias("exam_type"),
        F.when(any_word(text, ["解答", "答案"]), "daan").otherwise("paper").alias("filetype"),
        grade.alias("grade"),
        F.coalesce(by_name, level_of(grade)).alias("level"),
        subject.alias("subject"),
    )


def title_school(text: Column) -> Column:
    """struct(county, school_name, school_short, title) by the first ten lines: the first county within a hundred
    characters, and what follows it up to a school's ending within fifty, else twelve characters."""
    lines = F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, 10)
    read = lambda x: F.struct(F.regexp_replace(F.array_join(x, "\n"), r"(?U)\s+", "").alias("whole"), F.get(x, F.lit(0)).alias("first"))
    spelled = lambda whole: bound(F.substring(whole, 1, 100), lambda start: first_that(TITLE_COUNTIES, lambda c: F.contains(start, c)))
    title = lambda first: F.when(F.coalesce(text, F.lit("")) != "", F.trim(first))
    return bound(bound(lines, read), lambda x: bound(spelled(x["whole"]), lambda s: _title_school(x["whole"], s, title(x["first"]))))


def _title_school(whole: Column, spelled: Column, title: Column) -> Column:
    county = F.coalesce(lookup(spelled, {c: c for c in COUNTIES} | ALIASES), F.lit(OTHER))
    after = F.substring(whole, F.instr(whole, spelled) + F.length(spelled), F.lit(50))
    endings = "國民中學|國民小學|國中|國小|高中|高商|高工|高職|完全中學|附屬中學|附設國中|附設國小|實驗國中|實驗國小|高級中學|高級職業|高級商業|高級工業"
    name = bound(after, lambda rest: F.coalesce(found(rest, f"^((?:市立|縣立|私立|國立|鄉立|鎮立)?[^0-9]+?(?:{endings}))"), F.substring(rest, 1, 12)))
    if_named = lambda c: F.when(spelled.isNull(), "未註明").otherwise(c)
    return bound(name, lambda n: F.struct(county.alias("county"), if_named(F.concat(county, n)).alias("school_name"), if_named(n).alias("school_short"), title.alias("title")))


def accepted_school(text: Column, scanned: Column) -> Column:
    """title_school of the text where that knows the county, else of the scanned text, whose title is marked."""
    marked = lambda x: F.struct(*[x[n].alias(n) for n in ("county", "school_name", "school_short")], F.concat(F.lit("[OCR] "), F.coalesce(x["title"], F.lit(""))).alias("title"))
    none = F.struct(F.lit(OTHER).alias("county"), F.lit("未註明").alias("school_name"), F.lit("未註明").alias("school_short"), F.lit(None).cast("string").alias("title"))
    other = F.when(F.coalesce(scanned, F.lit("")) != "", bound(title_school(scanned), marked)).otherwise(none)
    return bound(title_school(text), lambda first: F.when(first["county"] != OTHER, first).otherwise(other))


def usable_cover(text: Column) -> Column:
    """Fifty characters or more and two of the words of covers."""
    words = F.size(F.filter(F.array(*map(F.lit, COVER_WORDS)), lambda w: F.contains(text, w)))
    return F.coalesce((F.length(text) >= 50) & (words >= 2), F.lit(False))


def homepage_total(html: Column) -> Column:
    """The number that a home page says it has papers: before 份中小學試卷, tags and repeated blanks left out."""
    plain = F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " ")
    return found(plain, r"(\d+)\s*份\s*中小學試卷").cast("int")


def limit_minutes(message: Column) -> Column:
    """Minutes to wait that a short message about a limit asks for: those it names, a day for tomorrow, else 25; null for
    any other message."""
    named = found(message, r"等待\s*(\d+)\s*分鐘").cast("int")
    minutes = F.coalesce(named, F.when(F.contains(message, F.lit("明天")), 24 * 60).otherwise(25))
    return F.when((F.octet_length(message) < 500) & any_word(message, LIMIT_WORDS), minutes)


def file_kind(content: Column) -> Column:
    """PDF, DOC, DOCX, EMPTY or OTHER by a file's first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(F.startswith(head, F.lit("25504446")), "PDF").when(F.startswith(head, F.lit("D0CF11E0")), "DOC").when(F.startswith(head, F.lit("504B0304")), "DOCX").when(head == "", "EMPTY").otherwise("OTHER")


def valid_download(content: Column, extension: Column) -> Column:
    """Whether a download's first bytes fit its ending; other endings need content at all."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(extension == ".pdf", head == "25504446").when(extension.isin(".docx", ".xlsx", ".zip"), F.startswith(head, F.lit("504B"))).otherwise(head != "")


def cache_key(*fields: Column) -> Column:
    """A search's key: the digest of its fields, blank where missing, between bars."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in fields]), 256)


def address_pseudonym(address: Column, salt: str) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt + ":"), address), 256), 1, 32)


def freshness(seconds: Column) -> Column:
    """How long ago, in words."""
    n = lambda s: F.floor(seconds / s).cast("string")
    return F.when(seconds < 60, "剛剛更新").when(seconds < 3600, F.concat(n(60), F.lit(" 分鐘前"))).when(seconds < 86400, F.concat(n(3600), F.lit(" 小時前"))).otherwise(F.concat(n(86400), F.lit(" 天前")))

