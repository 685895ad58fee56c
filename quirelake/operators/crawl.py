"""Jobs over fetched pages: anchors, download links, bounded reachability, lists in pages and bulletins. DataFrame to DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirelake.functions import links, markup
from quirelake.functions.names import blank_to_null, found
from quirelake.sources import store

def absolute_url(base: Column, href: Column) -> Column:
    """``href`` as a link on the page ``base``: whole urls, those without scheme, from the root, from the page's folder, and
    queries; one and two dots are resolved as far as the path goes."""
    root, scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    path = links.url_path(base)
    folder = F.regexp_extract(path, "^(.*/)[^/]*$", 1)
    at, rest = F.regexp_extract(href, "^([^?#]*)", 1), F.regexp_extract(href, "^[^?#]*(.*)$", 1)
    raw = F.when(F.startswith(at, F.lit("/")), at).otherwise(F.concat(F.coalesce(blank_to_null(folder), F.lit("/")), at))
    step = lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.concat(done, F.array(s)))
    segments = F.slice(F.split(raw, "/"), 2, 10_000)
    solid = F.aggregate(segments, F.array().cast("array<string>"), step)
    ends = F.when(F.element_at(segments, -1).isin(".", ".."), "/").otherwise("")
    clean = F.when(F.contains(raw, F.lit("/.")), F.concat(F.lit("/"), F.array_join(solid, "/"), ends)).otherwise(raw)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, href))
        .when(at == "", F.concat(root, path, F.when(F.startswith(rest, F.lit("#")), F.concat(F.regexp_extract(base, r"(\?[^#]*)", 1), rest)).otherwise(rest)))
        .otherwise(F.concat(root, clean, rest))
    )


def text_of(element: Column, between: str = " ") -> Column:
    """The texts inside an element."""
    return F.array_join(F.slice("texts", element["first"] + 1, element["last"] - element["first"]), between)


def extract_links(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) to anchors in order: (page_id, place, url, label, page_title, is_file). Links that lead
    nowhere (javascript, mail, telephone, a place in the page, none) are left out. Comments and scripts are not read."""
    rows = markup.with_elements(pages.select("page_id", F.col("url").alias("base"), "html"), ["a", "title"])
    title = F.get(F.filter("elements", lambda e: e["name"] == "title"), F.lit(0))
    anchors = F.filter("elements", lambda e: (e["name"] == "a") & e["attrs"]["href"].isNotNull())
    named = F.transform(anchors, lambda e: F.struct(F.trim(F.regexp_replace(e["attrs"]["href"], r"^\s+|\s+$", "")).alias("href"), text_of(e).alias("label")))
    each = rows.select("page_id", "base", F.coalesce(text_of(title), F.lit("")).alias("page_title"), F.posexplode(named).alias("place", "a")).select("page_id", "base", "page_title", "place", "a.*")
    some = each.filter((F.col("href") != "") & ~F.col("href").rlike("^(?:javascript:|mailto:|tel:|#)"))
    made = some.withColumn("url", absolute_url(F.col("base"), F.col("href")))
    return made.select("page_id", "place", "url", "label", "page_title", links.is_file_link(F.col("url"), F.col("label")).alias("is_file"))


def first_links(found_: DataFrame) -> DataFrame:
    """The first link, by page and place, of each url without its fragment; combined before the shuffle."""
    first = F.min(F.struct("page_id", "place", "url", "label", "page_title"))
    return found_.groupBy(F.regexp_extract("url", "^([^#]*)", 1).alias("target")).agg(first.alias("x")).select("target", "x.*")


def reachable(starts: DataFrame, edges: DataFrame, max_depth: int = 5, max_pages: int = 60) -> DataFrame:
    """(start, page, depth): pages reached from each start along edges (src, dst) in at most ``max_depth`` steps, the nearest
    ``max_pages`` of each start, of one depth those of the least number.

    One join a step; visited pages are written, so a lost executor repeats one step. A start that has its pages goes no
    further, which bounds each step by ``max_pages`` pages of a start."""
    seen = starts.select(F.col("page").alias("start"), "page", F.lit(0).alias("depth"))
    for depth in range(1, max_depth + 1):
        counted = seen.groupBy("start").agg(F.count("*").alias("n"))
        front = seen.filter(F.col("depth") == depth - 1)
        new = front.join(edges, front["page"] == edges["src"]).select("start", F.col("dst").alias("page")).distinct().join(seen.select("start", "page"), ["start", "page"], "left_anti")
        ranked = new.withColumn("r", F.row_number().over(W.partitionBy("start").orderBy("page"))).join(counted, "start")
        kept = ranked.filter(F.col("r") + F.col("n") <= max_pages).select("start", "page", F.lit(depth).alias("depth"))
        seen = store.kept(seen.unionByName(kept), "reached")
    return seen


def sitemap_urls(sitemaps: DataFrame) -> DataFrame:
    """(url) of papers that sitemaps (text) list."""
    return sitemaps.select(F.explode(F.regexp_extract_all("text", F.lit(r"<loc>\s*(https?://[^<\s]+/paper/[^<\s]+)\s*</loc>"), F.lit(1))).alias("url")).distinct()


def bulletin_entries(documents: DataFrame) -> DataFrame:
    """Documents (doc_id, text) to entries (doc_id, entry, category, title, summary, url, source). An entry begins with 🔶
    and a blank; its fields end where the next begins; a summary has 200 characters at most; entries without title,
    summary mark or link are dropped. A header (a sign and a few words before a 🔶) gives the category of all entries
    behind it, up to the next one; before the first it is 其他."""
    chunks = documents.select("doc_id", F.posexplode(F.split("text", "🔶 ")).alias("entry", "chunk"))
    header = F.regexp_extract(F.col("chunk"), r"(?s).*?([\x{1F000}-\x{1FFFF}☀-➿]️?\s+[^\n🔶]{2,30})$", 1)
    w = W.partitionBy("doc_id").orderBy("entry").rowsBetween(W.unboundedPreceding, -1)
    told = chunks.withColumn("category", F.coalesce(F.last(F.trim(blank_to_null(header)), ignorenulls=True).over(w), F.lit("其他"))).filter("entry > 0")
    before = lambda c, *marks: F.trim(F.regexp_replace(c, "(?s)(?<=.)(?:" + "|".join(marks) + ").*$", ""))
    after = lambda c, mark: found(c, f"(?s)^.*?{mark}(.*)$")
    rest = after(F.col("chunk"), "摘要：")
    link = after(rest, "連結：")
    title = before(F.regexp_extract("chunk", "(?s)^(.*?)摘要：", 1), "標籤：", "影響等級：")
    summary = F.substring(before(F.regexp_extract(rest, "(?s)^(.*?)(?:連結：|$)", 1), "來源：", "標籤：", "影響等級："), 1, 200)
    url = F.trim(F.regexp_extract(link, "(?s)^(.*?)(?:來源|標籤|影響等級|$)", 1))
    source = F.trim(F.regexp_extract(F.coalesce(after(link, "來源："), F.lit("")), "(?s)^(.*?)(?:標籤|影響等級|$)", 1))
    made = told.select("doc_id", "entry", "category", title.alias("title"), summary.alias("summary"), url.alias("url"), source.alias("source"))
    return made.filter("title <> '' and url <> ''")


def school_list(pages: DataFrame) -> DataFrame:
    """Directory pages (page_id, html) to (page_id, category, name, url, has_answer, link_type): of each summary that names a
    kind of school, the items of the first list in the element it is in, but for collections of national exams; lists
    inside an item belong to the item."""
    rows = markup.with_elements(pages.select("page_id", "html")).select("page_id", "texts", "elements", F.explode(F.filter("elements", lambda e: e["name"] == "summary")).alias("s"))
    told = text_of(F.col("s"), "")
    kind = F.when(F.contains(told, F.lit("國中")), "junior").when(F.contains(told, F.lit("高中")), "senior").when(F.contains(told, F.lit("國小")), "elementary")
    of = lambda name, inside: F.filter("elements", lambda e: (e["name"] == name) & inside(e))
    parent = F.get(F.filter("elements", lambda e: e["at"] == F.col("s.parent")), F.lit(0))
    around = rows.select("page_id", "texts", "elements", kind.alias("category"), parent.alias("parent")).filter("category is not null")
    first = F.get(of("ul", lambda e: F.col("parent").isNull() | (e["at"] > F.col("parent.at")) & (e["at"] < F.col("parent.until"))), F.lit(0))
    listed = around.withColumn("ul", first).withColumn("li", F.explode(of("li", lambda e: e["parent"] == F.col("ul.at"))))
    linked = listed.withColumn("a", F.get(of("a", lambda e: (e["at"] > F.col("li.at")) & (e["at"] < F.col("li.until"))), F.lit(0)))
    answered = ~F.coalesce(F.array_contains(F.split(F.col("li.attrs")["class"], r"\s+"), "noanswer"), F.lit(False))
    found_ = linked.select("page_id", "category", text_of(F.col("a"), "").alias("name"), F.col("a.attrs")["href"].alias("url"), answered.alias("has_answer"))
    past = F.contains("name", F.lit("歷屆")) & (F.contains("name", F.lit("會考")) | F.contains("name", F.lit("學測")))
    return found_.filter((F.col("name") != "") & (F.col("url") != "") & ~past).withColumn("link_type", links.link_type(F.col("url")))
