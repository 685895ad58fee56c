"""Operator 2: URL filter by a path-template tree and list rules. DataFrame functions only.

For each host a tree of path segments grows level by level, as deep as its paths go: a segment becomes ``*`` if it looks like an id, or if its
place in the tree takes many different values for few distinct urls each; how often a url is repeated does not count.
A template whose share of good labels does not differ significantly from that of all templates that differ from it in
one fixed segment only, is merged with them: at its last fixed segment, or at one before that where there are
MIN_VALUES templates or more; of several such segments at the one with most templates, and so on while any merge. A template is rejected if its labelled purity, smoothed towards that of all labelled pages, is too low.
List rules go first: the longest rule that fits decides.

Defined results: a null url or one without ``://`` has empty host and path and shares the template of these; labels of
repeated urls weigh as often as they come; repeated labels of a page count as good only if all are good; null labels count
as none; without any labels the prior purity is 1, so nothing is rejected; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm._spark import spread_join, written
from quirelake.llm.line_dedup import ascii_lower

#: A place in the tree with so many values, and at most this many distinct urls for each, is variable.
MIN_VALUES, MAX_PAGES_EACH = 5, 2
#: Looks like an id: has a digit and no letters beyond a-f, with an optional file ending.
ID_LIKE = r"^[0-9a-fA-F_-]*[0-9][0-9a-fA-F_-]*(\.[a-z0-9]+)?$"
#: Square of the normal quantile beyond which shares differ.
Z2 = 3.84
#: Labels that the prior counts as, and the least purity.
PRIOR_WEIGHT, MIN_PURITY = 4.0, 0.5


def host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host_: Column, path_: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; rules are few and given as parameters."""
    rule = verdict = F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: len(r[0])):  # later ones, which are longer, take precedence
        at, slash, rest = text.partition("/")
        fits = ((host_ == at) | F.endswith(host_, F.lit("." + at))) & F.startswith(path_, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def path_templates(paths: DataFrame) -> DataFrame:
    """Adds template to rows (host, path, n, ...) with distinct (host, path).

    One level a round, until no path has a further segment. A place with fewer than MIN_VALUES paths can have no
    variable place below it, so its paths are finished at once: the rounds follow shared prefixes, not the longest path.
    """
    other = [c for c in paths.columns if c not in ("host", "path")]
    segments = F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), lambda s: F.when(s.rlike(ID_LIKE), "*").otherwise(s))
    rows = paths.withColumn("segments", segments).withColumn("template", F.lit(""))
    named = rows.filter(F.size("segments") == 0).select("host", "path", *other, "template")
    rows, k = rows.filter(F.size("segments") > 0), 0
    while True:
        rows = rows.withColumn("segment", F.get("segments", F.lit(k)))
        nodes = rows.groupBy("host", "template", "segment").agg(F.sum("n").alias("n"), F.count("*").alias("paths"))
        places = nodes.groupBy("host", "template").agg(F.count("*").alias("n_values"), F.sum("n").alias("n"), F.sum("paths").alias("paths"))
        is_variable = (F.col("n_values") >= MIN_VALUES) & (F.col("n") <= MAX_PAGES_EACH * F.col("n_values"))
        open_ = written(places.filter(F.col("paths") >= MIN_VALUES).select("host", "template", is_variable.alias("variable"), "paths"), "places")
        rows = spread_join(rows, open_, ["host", "template"], "paths", ["path"], "left")
        rest = F.array_join(F.slice("segments", k + 1, F.size("segments")), "/")
        part = F.when(F.col("variable").isNull(), rest).when(F.col("variable"), "*").otherwise(F.col("segment"))
        done = F.col("variable").isNull() | (F.size("segments") == k + 1)
        rows = written(rows.select("host", "path", *other, "segments", F.concat("template", F.lit("/"), part).alias("template"), done.alias("done")), "level")
        named = named.unionByName(rows.filter("done").select("host", "path", *other, "template"))
        rows, k = rows.filter("not done").drop("done"), k + 1
        if rows.isEmpty():
            return named


def merge_round(groups: DataFrame) -> DataFrame:
    """(host, final, wider): the templates ``final`` of (host, final, n_labels, n_good) that join others as ``wider``."""
    parts = F.split("final", "/")
    size = F.size("parts")
    places = F.filter(F.sequence(F.lit(1), size - 1), lambda i: F.get("parts", i) != "*")
    split = groups.withColumn("parts", parts).withColumn("places", F.when(size > 1, places).otherwise(F.array().cast("array<int>")))
    # place 0 is the template itself: what is merged already stays in the pool
    each = split.withColumn("place", F.explode(F.concat(F.array(F.lit(0)), "places")))
    wider = F.array_join(F.concat(F.slice("parts", 1, F.col("place")), F.array(F.lit("*")), F.slice("parts", F.col("place") + 2, size)), "/")
    each = each.select("host", "final", "n_labels", "n_good", "place", (F.col("place") == F.array_max("places")).alias("last"), F.when(F.col("place") == 0, F.col("final")).otherwise(wider).alias("wider"))
    pooled = each.groupBy("host", "wider").agg(F.sum("n_labels").alias("all_labels"), F.sum("n_good").alias("all_good"), F.count("*").alias("siblings"))
    pooled = pooled.filter("siblings > 1")
    share, mean = F.col("n_good") / F.greatest("n_labels", F.lit(1)), F.col("all_good") / F.greatest("all_labels", F.lit(1))
    alike = (F.col("n_labels") == 0) | ((share - mean) * (share - mean) * F.col("n_labels") <= F.lit(Z2) * mean * (1 - mean))
    fits = each.filter("place > 0").join(pooled, ["host", "wider"]).filter(alike & (F.col("last") | (F.col("siblings") >= MIN_VALUES)))
    return fits.groupBy("host", "final").agg(F.max(F.struct("siblings", "place", "wider"))["wider"].alias("wider"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) per page. ``labels``: (page_id, good boolean)."""
    own = pages.select(F.col(page_id).alias("page_id"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"), F.col(url).alias("url"))
    marks = labels.select(F.col("page_id").alias("page_id"), F.col("good").cast("int").alias("good")).filter("page_id is not null and good is not null").groupBy("page_id").agg(F.min("good").alias("good"))
    by_url = own.join(marks, "page_id", "left").groupBy("host", "path", "url").agg(F.count("good").alias("n_labels"), F.coalesce(F.sum("good"), F.lit(0)).alias("n_good"), F.count("*").alias("pages"))
    counted = by_url.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("n_labels").alias("n_labels"), F.sum("n_good").alias("n_good"), F.sum("pages").alias("pages"))
    # the templates are read three times; written once, they are put together once
    named = written(path_templates(written(counted, "paths")), "templates")
    per = named.groupBy("host", "template").agg(F.sum("n_labels").alias("n_labels"), F.sum("n_good").alias("n_good"), F.count("*").alias("paths"))
    merged = written(per.withColumn("final", F.col("template")), "merged")
    while True:  # each round takes a fixed segment from the templates that merge
        joins = written(merge_round(merged.groupBy("host", "final").agg(F.sum("n_labels").alias("n_labels"), F.sum("n_good").alias("n_good"))), "joins")
        if joins.isEmpty():
            break
        merged = written(merged.join(joins, ["host", "final"], "left").select("host", "template", "n_labels", "n_good", "paths", F.coalesce("wider", "final").alias("final")), "merged")
    total = merged.agg(F.sum("n_labels").alias("n"), F.sum("n_good").alias("g")).first()  # two numbers
    prior = total["g"] / total["n"] if total["n"] else 1.0
    smoothed = (F.col("g") + F.lit(PRIOR_WEIGHT * prior)) / (F.col("n") + F.lit(PRIOR_WEIGHT))
    purity = merged.groupBy("host", "final").agg(F.sum("n_labels").alias("n"), F.sum("n_good").alias("g")).select("host", "final", smoothed.alias("purity"))
    verdicts = written(merged.select("host", "template", "final", "paths").join(purity, ["host", "final"]), "verdicts")
    # a template may hold any share of the paths, a path any share of the pages
    by_path = spread_join(named.select("host", "path", "template", "pages"), verdicts, ["host", "template"], "paths", ["path"])
    by_path = written(by_path.select("host", "path", "final", "purity", "pages"), "by-path")
    rule, decided = longest_rule(F.col("host"), F.col("path"), rules)
    judged = spread_join(own, by_path, ["host", "path"], "pages", ["page_id", "url"])
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(decided, F.when(F.col("purity") < MIN_PURITY, "block").otherwise("allow")).alias("verdict"), F.col("final").alias("template"), "purity")
