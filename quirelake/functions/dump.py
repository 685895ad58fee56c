"""Expressions that classify the files of a raw dump: grade, subject, year, term, exam, confidence, target path."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirelake.functions.names import GRADES, blank_to_null, bound, file_name, found, lookup
from quirelake.functions.schools import first_that

#: What a captured sign stands for. A: digits, C: Chinese digits, G: a year of junior school, J: the
#: same in digits.
SIGNS = {
    "A": {str(i + 1): g for i, g in enumerate(GRADES)},
    "C": {c: g for c, g in zip("一二三四五六七八九十", GRADES, strict=False)},
    "G": {"一": "七年級", "二": "八年級", "三": "九年級", "七": "七年級", "八": "八年級", "九": "九年級"},
    "J": {"1": "七年級", "2": "八年級", "3": "九年級"},
}
_ONE, _SHORT = "[一二三四五六七八九]", "[公國英數自社理化生歷地健體音美]"
#: Rules for a folder's name, in order: name, pattern, signs.
FOLDER_RULES = [
    ("path_arabic_年級", rf"([0-9]|{_ONE})\s*年級", "A"),
    ("path_chinese_年級", rf"([0-9]|{_ONE})\s*年級", "C"),
    ("path_guo_chinese", r"國\s*([一二三123])(?![一二三四五六七八九十])", "G"),
    ("path_guo_arabic", r"國\s*([一二三123])(?![一二三四五六七八九十])", "J"),
    ("path_single_digit", r"^([789])$", "A"),
    ("path_digit_letter", r"^([789])[A-Z]$", "A"),
    ("path_arabic_年_only", r"^([789])年$", "A"),
]
#: Rules for a file's name, in order: name, pattern, signs, whether for one school only.
NAME_RULES = [
    ("arabic_年級", rf"([0-9]|{_ONE})\s*年級", "A", False),
    ("chinese_年級", rf"([0-9]|{_ONE})\s*年級", "C", False),
    ("guo_chinese", rf"國\s*({_ONE})(?=段|全科|科|答案|解答|試題|數|[(（]|$)", "G", False),
    ("taoyuan_7digit_dash", r"^[0-9]{7}-([0-9])", "A", True),
    ("taoyuan_7digit_chinese_subject", rf"^[0-9]{{7}}({_ONE}){_SHORT}", "C", True),
    ("taoyuan_7digit_2char_subject", rf"^[0-9]{{7}}({_ONE})(?:寫作|作文)", "C", True),
    ("taoyuan_bare", rf"^([0-9]){_SHORT}", "A", True),
    ("taoyuan_6digit_bare_arabic_subject", rf"^[0-9]{{6}}[\s_]([0-9]){_SHORT}", "A", True),
    ("taoyuan_chinese_term", rf"[_\s]({_ONE})[上下][一二三四]?段", "C", True),
    ("chinese_grade_term", rf"(?<![0-9年])([七八九十一])[上下](?!{_ONE})", "C", False),
    ("guo_term", r"國\s*([一二三123])\s*[上下]", "G", False),
    ("guo_term_arabic", r"國\s*([一二三123])\s*[上下]", "J", False),
    ("paren_grade", rf"[（(]({_ONE})(?:年級|級)?[)）]", "C", False),
    ("chinese_digit_prefix", rf"^({_ONE})[上下英段公數理]", "C", False),
    ("chinese_year_then_subject", rf"({_ONE})(?:\s*年|(?=社會|公民|國文|英文|英語|數學|自然|理化|歷史|地理|生物|健康|體育|音樂|美術|健體))", "C", False),
    ("taoyuan_6digit_chinese_grade", rf"^[0-9]{{6}}({_ONE})", "C", True),
    ("3digit_year_grade_term", r"[0-9]{3}([七八九十一])[上下]", "C", False),
    ("old_format_yy_tt_grade_exam", r"^[0-9]{4}\s+([789])-[0-9]", "A", False),
    ("taoyuan_yyyy_term_exam_chinese_subject", rf"^[0-9]{{3}}[上下][0-9]{{2}}({_ONE})[一-鿿]", "C", True),
    ("jinhe_yyyy_term_guo_grade_exam", r"^[0-9]{3}[上下]國([七八九])段", "C", False),
    ("taoyuan_7digit_loose_subject", rf"^[0-9]{{7}}({_ONE})[一-鿿]", "C", True),
    ("taoyuan_yyyy_exam_chinese_subject", rf"^[0-9]{{5,8}}({_ONE})[一-鿿]", "C", True),
    ("zhongping_2digit_year_term_grade", rf"^[0-9]{{2}}上\s*(?:第[0-9]次)?\s*([0-9]|{_ONE})(?![0-9])", "789", False),
    ("taoyuan_typo_year_exam_arabic_subject", rf"^[0-9]{{10}}-([789]){_SHORT}", "A", True),
]
#: The school that has rules of its own.
ONE_SCHOOL = ("桃園市", "桃園市桃園國中")
#: Subjects as names spell them; the first in this order that a name holds counts.
SUBJECTS = [
    "自然與生活科技", "社會學習領域", "綜合活動", "資訊科技", "地球科學", "地科學", "地科", "健康與體育", "健康教育", "英聽", "英語聽力", "生物科", "自然科", "數非選", "英文科", "國文科", "數學科", "歷史科", "地理科",
    "公民科", "生科", "自科", "數科", "社科", "英科", "國科", "歷科", "全科", "英語科", "社會科", "理化科", "生活科技", "作文", "寫作", "國文", "英語", "英文", "數學", "自然", "社會", "理化", "生物",
    "歷史", "地理", "公民", "健康", "健體", "體育", "音樂", "美術", "家政", "生活", "綜合", "資訊", "科技", "閱讀",
]
#: Subjects of one character.
SHORT_SUBJECTS = {"公": "公民", "國": "國文", "英": "英語", "數": "數學", "自": "自然", "社": "社會", "理": "理化", "化": "理化", "生": "生物", "歷": "歷史", "地": "地理", "健": "健康教育", "體": "體育", "音": "音樂", "美": "美術", "作": "作文", "聽": "英語"}
#: Exams as names spell them; the first in this order counts.
EXAMS = [
    "第一次段考", "第二次段考", "第三次段考", "第1次段考", "第2次段考", "第3次段考", "第一次定期考", "第二次定期考", "第三次定期考", "第1次定期考", "第2次定期考", "第3次定期考", "第一次定期評量", "第二次定期評量",
    "第三次定期評量", "第1次定期評量", "第2次定期評量", "第3次定期評量", "第1階段評量", "第2階段評量", "第3階段評量", "第一階段評量", "第二階段評量", "第三階段評量", "期末考", "期中考", "模擬考", "月考", "複習考", "段考",
    "定期考", "定期評量", "評量",
]
#: Signs of the terms, and exams by number.
TERM_SIGNS = {"上": "上學期", "1": "上學期", "一": "上學期", "下": "下學期", "2": "下學期", "二": "下學期"}
NUMBERED = {"1": "第一次段考", "2": "第二次段考", "3": "第三次段考"}
#: Years that a dump can have.
_YEAR = "(?:10[0-9]|11[0-5])"
UNSORTED, UNKNOWN = "未分類", "未註明"


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.pdf$", "")


def _is_one_school(county: Column, school: Column) -> Column:
    return F.coalesce((county == ONE_SCHOOL[0]) & (school == ONE_SCHOOL[1]), F.lit(False))


def _signs(kind: str) -> dict[str, str]:
    return SIGNS[kind] if kind in SIGNS else {d: SIGNS["A"][d] for d in kind}


def _first_hit(text: Column, rules: list[tuple[str, str, str]], when: Column | None = None) -> list[Column]:
    """struct(grade, rule) of each rule in turn, null where it does not hit. Rules with one pattern share its search: a sign
    belongs to the first of them that knows it."""
    hits = []
    for pattern, alike in groupby(rules, lambda rule: rule[1]):
        table: dict[str, Column] = {}
        for rule, _, kind in alike:
            table = {s: F.struct(F.lit(g).alias("grade"), F.lit(rule).alias("rule")) for s, g in _signs(kind).items()} | table
        hit = lookup(F.regexp_extract(text, pattern, 1), table)
        hits.append(hit if when is None else F.when(when, hit))
    return hits


def dump_grade(path: Column, county: Column, school: Column) -> Column:
    """struct(grade, rule): the first rule that hits, for the folders below the school's in turn, then for the file's
    name; null if none does. ``path``: _未分類/DriveFolder/county/school/.../name."""
    return bound(stem(file_name(path)), lambda base: grade_of(path, base, county, school))


def grade_of(path: Column, base: Column, county: Column, school: Column) -> Column:
    """``dump_grade`` by the path and the name without its ending."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 5, F.greatest(F.size(parts) - 5, F.lit(0)))
    by_folder = F.get(F.filter(F.transform(folders, lambda c: F.coalesce(*_first_hit(c, FOLDER_RULES))), lambda x: x.isNotNull()), F.lit(0))
    one, by_name = _is_one_school(county, school), []
    for only, rules in groupby(NAME_RULES, lambda rule: rule[3]):
        by_name += _first_hit(base, [rule[:3] for rule in rules], one if only else None)
    return F.coalesce(by_folder, *by_name)


def dump_subject(name: Column, grade: Column, county: Column, school: Column) -> Column:
    """A subject's name in the file's name, else one of a single character at places that forms of names have."""
    return bound(stem(name), lambda base: subject_of(base, grade, county, school))


def subject_of(base: Column, grade: Column, county: Column, school: Column) -> Column:
    """``dump_subject`` by the name without its ending."""
    one = _is_one_school(county, school)
    short = lambda pattern: lookup(F.regexp_extract(base, pattern, 1), SHORT_SUBJECTS)
    more, rest = "[公國英數自社理化生歷地健體音美聽作]", r"(?:[一-鿿\sA-Z0-9].*)?$"
    return F.coalesce(
        first_that(SUBJECTS, lambda w: F.contains(base, w)),
        F.when(F.contains(base, F.lit("健教")), "健康教育"),
        F.when(one, F.coalesce(short(rf"^[0-9]{{6,7}}{_ONE}({_SHORT})"), short(rf"^[0-9]({_SHORT})"))),
        short(rf"^[1-9]({more})"),
        F.when(blank_to_null(grade).isNotNull(), F.coalesce(short(rf"^\s*({more}){rest}"), short(rf"^{_ONE}({_SHORT}){rest}"))),
    )


def dump_year(name: Column, county: Column, school: Column) -> Column:
    """A year from 100 to 115: before 學年度, 學年 or 年度; at the beginning; before 上 or 下. One school has six digits
    or more, of which the first three count whatever they are."""
    return bound(stem(name), lambda base: year_of(base, county, school))


def year_of(base: Column, county: Column, school: Column) -> Column:
    """``dump_year`` by the name without its ending."""
    return F.coalesce(
        F.when(_is_one_school(county, school), found(base, r"^([0-9]{3})[0-9]{3}")),
        found(base, rf"({_YEAR})(?:學年度|學年|年度)"),
        found(base, rf"^({_YEAR})"),
        found(base, rf"(?<![0-9])({_YEAR})[下上]"),
    )


def dump_term(name: Column, county: Column, school: Column) -> Column:
    """上學期 or 下學期 by the first form of term that the name has."""
    return bound(stem(name), lambda base: term_of(base, county, school))


def term_of(base: Column, county: Column, school: Column) -> Column:
    """``dump_term`` by the name without its ending."""
    forms = [r"第([12])\s*學期", r"第([一二])\s*學期", r"([上下])(?:學期|半)", rf"(?<![0-9]){_YEAR}([上下])(?![學期半0-9])", rf"(?<![0-9]){_YEAR}-([12])(?![0-9])", rf"(?<![0-9]){_YEAR}([12])(?=-)"]
    sign = lambda pattern: lookup(F.regexp_extract(base, pattern, 1), TERM_SIGNS)
    return F.coalesce(F.when(_is_one_school(county, school), sign("^[0-9]{3}0([12])")), *[sign(f) for f in forms])


def dump_exam(name: Column) -> Column:
    """An exam's name in the file's name, else the number behind year, term and a dash."""
    return bound(stem(name), exam_of)


def exam_of(base: Column) -> Column:
    """``dump_exam`` by the name without its ending."""
    number = F.regexp_extract(base, rf"{_YEAR}[12]-([123])(?![0-9])", 1)
    return F.coalesce(first_that(EXAMS, lambda w: F.contains(base, w)), lookup(number, NUMBERED))


def confidence(level: Column, subject: Column) -> Column:
    """LOW without a level, MEDIUM without a subject, else HIGH."""
    return F.when(blank_to_null(level).isNull(), "LOW").when(blank_to_null(subject).isNull(), "MEDIUM").otherwise("HIGH")


def _wide(c: Column) -> Column:
    return F.translate(c, "/:", "／：")


def target_name(county: Column, year: Column, term: Column, exam: Column, subject: Column, grade: Column, school: Column, version: Column) -> Column:
    """The name, without ending, that a dump's file gets in the archive."""
    known = lambda c, other: _wide(F.coalesce(blank_to_null(c), F.lit(other)))
    when = F.coalesce(F.concat(blank_to_null(year), F.coalesce(term, F.lit(""))), F.lit(UNKNOWN))
    return F.concat_ws("_", county, when, known(exam, UNKNOWN), known(subject, UNSORTED), known(grade, UNKNOWN), _wide(school), F.coalesce(blank_to_null(version), F.lit(UNKNOWN)), F.lit("drivefolder"))


def target_path(county: Column, level: Column, grade: Column, subject: Column, filetype: Column, name: Column) -> Column:
    return F.concat_ws("/", county, level, _wide(grade), _wide(F.coalesce(blank_to_null(subject), F.lit(UNSORTED))), filetype, F.concat(name, F.lit(".pdf")))


def pending_path(county: Column, school: Column, name: Column) -> Column:
    """Where a file without a grade waits for a reviewer."""
    return F.concat_ws("/", F.lit("_未分類"), F.lit("_pending_review"), county, school, name)


