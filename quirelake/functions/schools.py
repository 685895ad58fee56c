"""Expressions over school and county names. Column to Column only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirelake.functions.names import blank_to_null, bound, lookup

#: The 22 counties.
COUNTIES = ["臺北市", "新北市", "桃園市", "臺中市", "臺南市", "高雄市", "基隆市", "新竹市", "嘉義市", "新竹縣", "苗栗縣", "彰化縣", "南投縣", "雲林縣", "嘉義縣", "屏東縣", "宜蘭縣", "花蓮縣", "臺東縣", "澎湖縣", "金門縣", "連江縣"]
#: Other spellings that a school's name may begin with.
ALIASES = {"桃園縣": "桃園市", "台北市": "臺北市", "台中市": "臺中市", "台南市": "臺南市", "北市": "臺北市"}
#: Counties that became cities.
UPGRADED = {"臺北縣": "臺北市", "台北縣": "臺北市", "桃園縣": "桃園市", "臺中縣": "臺中市", "台中縣": "臺中市", "臺南縣": "臺南市", "台南縣": "臺南市", "高雄縣": "高雄市"}
#: Beginnings and endings that a search leaves out of a school's name.
SEARCH_PREFIXES = [*COUNTIES, "台北市", "台中市", "台南市", "台東縣"]
SUFFIXES = ["國民中學", "高級中學", "國民小學", "國中", "國小", "高中", "高職"]
#: Beginnings of schools' names that tell a county where its name is not said, in order.
SHORT_NAMES = {
    "台北": "台北市", "北市": "台北市", "新北": "新北市", "桃園": "桃園市", "新竹": "新竹市", "台中": "台中市", "中市": "台中市", "彰化": "彰化縣", "嘉義": "嘉義市", "台南": "台南市", "南市": "台南市",
    "高雄": "高雄市", "屏東": "屏東縣", "宜蘭": "宜蘭縣", "花蓮": "花蓮縣", "台東": "台東縣", "基隆": "基隆市", "南投": "南投縣", "建中": "台北市", "北一女": "台北市", "雄中": "高雄市", "金門": "金門縣",
    "興大附": "台中市", "蘭陽女": "宜蘭縣", "竹女": "新竹市", "竹男": "新竹市", "武陵": "桃園市", "彰中": "彰化縣",
}
#: Words of a county that a school's name may hold, beside the county itself and its 立.
MORE_WORDS = {"臺北市": ["台北市", "臺北縣(舊)", "臺北"], "新北市": ["新北", "臺北縣(舊)"], "新竹市": ["新竹市私立"], "新竹縣": ["新竹"], "嘉義市": ["嘉義市私立"], "嘉義縣": ["嘉義"], "臺中市": ["台中市", "臺中", "台中"], "臺南市": ["台南市", "臺南", "台南"], "臺東縣": ["台東縣", "臺東", "台東"], "連江縣": ["連江", "馬祖"]}
#: What stands for an unknown county.
UNKNOWN_COUNTIES = ["未註明", "其他縣市", "其他X", "未知"]
OTHER, NOWHERE = "其他縣市", "其他X"


def first_that(values: list[str], test) -> Column:
    """The first value, in the order of the list, for which ``test`` holds; else null."""
    return F.get(F.filter(F.array(*map(F.lit, values)), test), F.lit(0))


def county_prefix(school: Column) -> Column:
    """The county's name or other spelling that the school's name begins with."""
    return first_that(COUNTIES + list(ALIASES), lambda p: F.startswith(F.coalesce(school, F.lit("")), p))


def county_of(school: Column) -> Column:
    """The county of a school by the beginning of its name; else OTHER."""
    return F.coalesce(lookup(county_prefix(school), {c: c for c in COUNTIES} | ALIASES), F.lit(OTHER))


def short_name(school: Column) -> Column:
    """A school's name without its county; a missing name is 未註明."""
    rest = F.substring(school, F.length(county_prefix(school)) + 1, F.length(school))
    return F.coalesce(rest, blank_to_null(school), F.lit("未註明"))


def normalise_county(county: Column) -> Column:
    """A missing or unknown county becomes 其他X; others stay."""
    return F.when(F.coalesce(county, F.lit("")).isin("", *UNKNOWN_COUNTIES), NOWHERE).otherwise(county)


def upgraded_county(county: Column) -> Column:
    """Former counties by the name of their city; others stay."""
    return F.coalesce(lookup(county, UPGRADED), county)


def core_token(name: Column) -> Column:
    """What is left of a school's name without county, 立 and the longest ending; null if shorter than two characters."""
    rest = F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), "^(?:" + "|".join(SEARCH_PREFIXES) + ")", "")
    rest = F.regexp_replace(rest, "^立", "")
    longest = sorted(SUFFIXES, key=len, reverse=True)
    rest = F.trim(F.regexp_replace(rest, "(?:" + "|".join(longest) + ")$", ""))
    return F.when(F.length(rest) >= 2, rest)


def search_name(name: Column) -> Column:
    """A school's name without two or three characters and 市 or 縣 at its beginning, and without a 立 after that."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?U)^\w{2,3}[市縣]", ""), "^立", ""))


def school_matches(query: Column, candidate: Column) -> Column:
    """Whether a school that is searched for is the candidate. A missing query fits all, a missing candidate none; a
    query inside the candidate fits; a candidate inside the query only if both are equal without county; else either
    must hold the other without county."""
    q, c = search_name(query), search_name(candidate)
    both = (q != "") & (c != "")
    return (
        F.when(F.coalesce(query, F.lit("")) == "", True)
        .when(F.coalesce(candidate, F.lit("")) == "", False)
        .when(F.contains(candidate, query), True)
        .when(F.contains(query, candidate), both & (q == c))
        .otherwise(both & (F.contains(c, q) | F.contains(q, c)))
    )


def archive_name(school: Column, county: Column) -> Column:
    """A school's name as the archive keeps it: without 國立, and without the longest beginning that names its county
    (with 立, 國立, 縣立 or 市立), as long as something is left."""
    bare = F.translate(county, "市縣", "")
    public = F.when(F.endswith(county, F.lit("縣")), "縣立").otherwise("市立")
    given = F.array(*[F.concat(county, F.lit(x)) for x in ("立", "國立", "")], *[F.concat(bare, F.lit(x)) for x in ("縣立", "市立", "縣", "市")], public)

    def of(plain: Column) -> Column:
        fits = F.filter(given, lambda p: F.startswith(plain, p) & (F.length(plain) > F.length(p)))
        longest = F.coalesce(F.array_max(F.transform(fits, lambda p: F.length(p))), F.lit(0))
        return F.when(F.coalesce(county, F.lit("")) == "", plain).otherwise(F.substring(plain, longest + 1, F.length(plain)))

    return bound(F.regexp_replace(school, "^國立", ""), of)


def strip_placeholders(name: Column, county: Column | None = None) -> Column:
    """Without _local_..._ and _unknown_..._ parts, inside or at the end, a county said twice at the beginning, repeated
    underscores and underscores at the ends."""
    mark = "_(?:local_[a-z0-9_]+|unknown_[^_]+)"
    rest = F.regexp_replace(F.regexp_replace(name, mark + "_", "_"), mark + "$", "")
    if county is not None:
        twice = F.startswith(rest, F.concat(county, county)) & (county != "")
        rest = F.when(twice, F.substring(rest, F.length(county) + 1, F.length(rest))).otherwise(rest)
    return F.regexp_replace(F.regexp_replace(rest, "_+", "_"), "^_|_$", "")


def normalise_year(year: Column) -> Column:
    """Three digits stay, a year in Chinese digits becomes digits, any other text stays; a missing year is blank."""
    digits = F.translate(year, "零一二三四五六七八九", "0123456789")
    return F.when(F.coalesce(year, F.lit("")) == "", "").when(year.rlike("^[零一二三四五六七八九]+$"), digits).otherwise(year)


def full_year(year: Column) -> Column:
    """A year of two digits with a third in front: 1 below 50, else 0; others stay."""
    return F.when(year.rlike(r"^\d\d$"), F.concat(F.when(year < "50", "1").otherwise("0"), year)).otherwise(year)


def county_by_short_name(name: Column) -> Column:
    """The county, by the spelling with 台, that a school's name begins with, else the one that a short name stands for."""
    spelled = ["台" + c[1:] if c[0] == "臺" else c for c in COUNTIES]
    begins = lambda w: F.startswith(name, w)
    return F.coalesce(first_that(spelled, begins), lookup(first_that(list(SHORT_NAMES), begins), SHORT_NAMES))


def county_words() -> dict[str, list[str]]:
    """For each county the words by which a school's name tells it."""
    return {c: [c, *MORE_WORDS.get(c, [c[:2]])] for c in COUNTIES}


def in_county(name: Column, county: Column) -> Column:
    """Whether a school's name holds a word of the county; an unknown county or all holds every school."""
    table = F.create_map(*[x for c, words in county_words().items() for x in (F.lit(c), F.array(*map(F.lit, words)))])
    words = F.try_element_at(table, county)
    return F.coalesce(F.exists(words, lambda w: F.contains(name, w)), F.lit(True))
