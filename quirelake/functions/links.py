"""Expressions over links: kinds, file names, whether they lead to exams, levels and targets. Column to Column only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirelake.functions.names import blank_to_null, found, lookup

#: Kinds of files that can be downloaded.
FILE_KINDS = [".pdf", ".doc", ".docx", ".xls", ".xlsx", ".zip"]
#: Words that lead to exams, and words of files that are none.
NAVIGATION = ["考古", "段考", "試題", "考卷", "題庫", "學期", "下載", "補考"]
NO_EXAM = ["申請", "配置圖", "平面圖", "校服", "校旗", "手冊", "流程", "辦法", "規定", "原則", "行事曆", "教科書"]
#: Labels that describe nothing.
EMPTY_LABELS = ["下載", "檔案下載", "download"]
_ENDING = r"(?i)\.(pdf|docx?|xlsx?|zip)(?:$|[?&#/])"


def any_word(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def url_host(url: Column) -> Column:
    """The host in lower case, without user and port; null where there is none."""
    return F.lower(found(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def url_query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def query_value(url: Column, name: str) -> Column:
    """The first value of a query's field, whatever the case of its name."""
    return found(url_query(url), rf"(?i)(?:^|&){name}=([^&]*)")


def unquoted(c: Column) -> Column:
    """Percent signs decoded, plus signs kept; text that is not well-formed stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def link_type(url: Column) -> Column:
    """drive, sharepoint, sites, nas, school_web or other, by the host."""
    host = F.coalesce(url_host(url), F.lit(""))
    has = lambda *words: any_word(host, list(words))
    return (
        F.when(has("drive.google.com", "docs.google.com"), "drive")
        .when(has("sharepoint.com", "my.sharepoint"), "sharepoint")
        .when(has("sites.google.com"), "sites")
        .when(has(".edu.tw") & (has("nas") | F.contains(url, F.lit(":5001"))), "nas")
        .when(has(".edu.tw"), "school_web")
        .otherwise("other")
    )


def cms_strategy(url: Column) -> Column:
    """How a site is read, by its path."""
    path = F.lower(url_path(url))
    out = F.when(path.rlike(r"/p/[^/]+\.php$"), "playwright")
    for part, kind in (("/view/index.php", "kh_view"), ("/upload/", "kh_upload"), ("/modules/", "modules"), ("/nss/", "nss")):
        out = out.when(F.contains(path, F.lit(part)), kind)
    return out.otherwise("static")


def should_follow(start: Column, candidate: Column, label: Column) -> Column:
    """Whether a crawl that began at ``start`` goes on to ``candidate``: the same host, and what the site's kind asks for."""
    kind, at, to = cms_strategy(start), F.lower(url_path(start)), F.lower(url_path(candidate))
    word = any_word(label, NAVIGATION)
    view = (to == at) & query_value(candidate, "mainmenuid").eqNullSafe(query_value(start, "mainmenuid")) & query_value(candidate, "submenuid").isNotNull()
    upload = any_word(to, ["/upload/file_list/", "/upload/upload_list/"])
    modules = (to == at) & query_value(candidate, "of_cat_sn").isNotNull() & (word | any_word(url_query(candidate), NAVIGATION) | F.contains(to, F.lit("tad_uploader")) | F.contains(url_query(candidate), F.lit("list_mode")))
    nss = F.startswith(to, F.concat(F.regexp_replace(at, "/+$", ""), F.lit("/"))) & word
    rule = F.when(kind == "kh_view", view).when(kind == "kh_upload", upload).when(kind == "modules", modules).when(kind == "nss", nss).otherwise(word)
    return F.coalesce((url_host(start) == url_host(candidate)) & rule, F.lit(False))


def file_extension(value: Column) -> Column:
    """The ending of a downloadable file in a url's path, in the whole value or in a value of its query; else blank."""
    kind = F.coalesce(found(url_path(value), _ENDING), found(value, _ENDING), found(unquoted(url_query(value)), _ENDING))
    return F.coalesce(F.concat(F.lit("."), F.lower(kind)), F.lit(""))


def is_file_link(url: Column, label: Column) -> Column:
    return (file_extension(url) != "") | (file_extension(label) != "")


def safe_file_name(name: Column) -> Column:
    """Decoded, characters that a name may not hold as underscores, no blanks and dots at the ends, 220 characters at most."""
    clean = F.btrim(F.regexp_replace(unquoted(name), r'[<>:"/\\|?*\x00-\x1F]', "_"), F.lit(" ."))
    return F.coalesce(blank_to_null(F.substring(clean, 1, 220)), F.lit("unnamed"))


def _suffix(name: Column) -> Column:
    return F.coalesce(found(name, r"[^.](\.[^./]+)$"), F.lit(""))


def choose_file_name(url: Column, label: Column) -> Column:
    """A label that describes something, else the last part of the url's path; with the link's ending where it has none of
    a downloadable file."""
    kind = F.coalesce(blank_to_null(file_extension(url)), blank_to_null(file_extension(label)), F.lit(""))
    text = F.trim(F.regexp_replace(label, r"\s+", " "))
    bare = F.regexp_replace(F.element_at(F.split(text, "/"), -1), r"(?<=[^.])\.[^.]*$", "")
    told = (F.length(bare) >= 4) & ~text.isin(*EMPTY_LABELS)
    name = safe_file_name(F.when(told, text).otherwise(F.element_at(F.split(F.regexp_replace(unquoted(url_path(url)), "/+$", ""), "/"), -1)))
    return F.when((kind != "") & ~F.lower(_suffix(name)).isin(*FILE_KINDS), F.concat(name, kind)).otherwise(name)


def school_file(name: Column) -> Column:
    """struct(year, term, grade, subject, exam_type, has_answer) of names such as 111學年度第1學期一年級英語補考題庫; null without
    a year with a term, or without a grade."""
    base = F.regexp_replace(name, r"(?<=[^.])\.[^./]*$", "")
    when = r"(\d{3})學年(?:度)?[_、\s]?第?(\d|[一二三四])[_、\s]?學期"
    term = F.regexp_extract(base, when, 2)
    grade_at = "[一二三四五六七八九][_、 ]?年級"
    grade = found(base, f"({grade_at})")
    junior = lookup(found(base, "國([一二三])"), {c: f"{c}年級" for c in "一二三"})
    subject = found(base, grade_at + r"([^\s補段範題考_]+?)_?(?:補考|段考|範圍|題庫|考卷|試題|$)")
    exam = F.when(any_word(base, ["補考題庫", "補考範圍", "補考題"]), "補考")
    for word in ("段考", "期末考", "期中考"):
        exam = exam.when(F.contains(base, F.lit(word)), word)
    made = F.struct(
        found(base, when).cast("int").alias("year"),
        F.coalesce(lookup(term, {c: i + 1 for i, c in enumerate("一二三四")}), term.try_cast("int")).alias("term"),
        F.coalesce(F.regexp_replace(grade, "[_、 ]", ""), junior).alias("grade"),
        F.coalesce(subject, F.lit("其他")).alias("subject"),
        exam.otherwise("其他").alias("exam_type"),
        base.rlike("答案|解答|解析|詳解").alias("has_answer"),
    )
    return F.when(base.rlike(when) & F.coalesce(grade, junior).isNotNull(), made)


def link_fields(name: Column, label: Column, title: Column) -> Column:
    """school_file of the file's name, else of the label, else of page title, label and name together."""
    return F.coalesce(school_file(name), school_file(F.concat(label, _suffix(name))), school_file(F.concat_ws("_", title, label, name)))


def is_exam_file(name: Column, label: Column, title: Column) -> Column:
    """Whether a link leads to an exam: its names give fields; or no word speaks against it and a word, or a year with a
    term, speaks for it."""
    here = F.concat_ws(" ", name, label, title)
    dated = here.rlike(r"(?:10\d|11\d).{0,10}(?:第?[12][-_]?學期|[上下]學期|第[一二三四1234]次)")
    return link_fields(name, label, title).isNotNull() | (~any_word(F.concat_ws(" ", name, label), NO_EXAM) & (any_word(here, NAVIGATION[:-1]) | dated))


def encoded_path(url: Column) -> Column:
    """The url with its path percent-encoded, slashes and the rest kept; without a scheme and host it stays."""
    path = url_path(url)
    coded = F.array_join(F.transform(F.split(path, "/"), lambda p: F.replace(F.replace(F.url_encode(p), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))), "/")
    coded = F.replace(coded, F.lit("%7E"), F.lit("~"))
    whole = F.concat(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), coded, F.regexp_extract(url, r"^[^?#]*([?#].*)?$", 1))
    return F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]"), whole).otherwise(url)
