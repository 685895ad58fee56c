"""Registered queries of searches and upkeep over the given tables, each with DuckDB SQL written apart from the jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirelake.functions import links, names, paths
from quirelake.functions.schools import archive_name, county_of, short_name
from quirelake.operators import activity_queries, search, upkeep
from quirelake.operators import catalog as jobs
from quirelake.plans import dump_queries, seed
from quirelake.plans.catalog_queries import _KEYS, CATALOG_SQL, catalog
from quirelake.plans.registry import Registry

_registry = Registry("arc")
query, queries, oracle_sql = _registry.query, _registry.queries, _registry.oracle_sql
_AUDIT = activity_queries._AUDIT
_NULL_SAFE = " AND ".join(f"a.{k.strip()} IS NOT DISTINCT FROM b.{k.strip()}" for k in _KEYS.split(","))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# searches

_ORDER = "school_year DESC NULLS LAST, county NULLS FIRST, school_name NULLS FIRST, grade NULLS FIRST, subject NULLS FIRST, paper_id"


@query(CATALOG_SQL + f", hit AS (SELECT * FROM catalog WHERE level = '國中' AND paper_or_daan = 'paper' AND contains(lower(school_name), '大同')) SELECT paper_id, school_name, school_year, (SELECT count(*) FROM hit) AS total, greatest(ceil((SELECT count(*) FROM hit) / 5.0), 1) AS pages FROM hit ORDER BY {_ORDER} LIMIT 5 OFFSET 5")
def search_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page with total and number of pages."""
    rows = search.search(catalog(spark, sf_dir), {"level": "國中", "paper_or_daan": "paper"}, "大同", 2, 5)
    return rows.select("paper_id", "school_name", "school_year", "total", F.col("pages").cast("double").alias("pages"))


_PAIRED = f"SELECT coalesce(max(paper_id) FILTER (paper_or_daan = 'paper'), max(paper_id) FILTER (paper_or_daan = 'daan')) AS paper_id, {_KEYS}, max(paper_id) FILTER (paper_or_daan = 'paper') AS paper_id_paper, max(paper_id) FILTER (paper_or_daan = 'daan') AS paper_id_daan, CASE WHEN bool_or(paper_or_daan = 'daan') THEN '有' ELSE '無' END AS download_answer FROM shown WHERE paper_or_daan IN ('paper', 'daan') GROUP BY {_KEYS}"


def _relaxed_sql(strict: str, dropped: str) -> str:
    return CATALOG_SQL + f""", near AS (SELECT *, coalesce({strict}, false) AS fits FROM catalog WHERE contains(school_name, '中山')),
info AS (SELECT count(*) FILTER (fits) = 0 AND count(*) > 0 AS fallback, CASE WHEN count(*) FILTER (fits) = 0 AND count(*) > 0 THEN count(*) ELSE count(*) FILTER (fits) END AS total FROM near),
shown AS (SELECT near.* FROM near, info WHERE fallback OR fits ORDER BY {_ORDER} LIMIT 40)
SELECT p.*, fallback, total, CASE WHEN fallback THEN '{dropped}' ELSE '' END AS dropped, CAST(greatest(ceil(total / 40.0), 1) AS BIGINT) AS pages FROM ({_PAIRED}) p, info"""


@query(_relaxed_sql("grade = '七年級' AND subject = '國防'", "grade,subject"))
def search_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """no row has the subject, so grade and subject are dropped."""
    return search.search_relaxed(catalog(spark, sf_dir), {"grade": "七年級", "subject": "國防"}, "中山國中", 1, 40)


@query(_relaxed_sql("grade = '七年級' AND paper_or_daan = 'paper'", "grade,paper_or_daan"))
def search_no_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows fit, nothing is dropped."""
    return search.search_relaxed(catalog(spark, sf_dir), {"grade": "七年級", "paper_or_daan": "paper"}, "中山國中", 1, 40)


@query(
    CATALOG_SQL
    + f""", g AS (SELECT {_KEYS}, arg_min(paper_id, {{'a': paper_or_daan <> 'paper', 'b': NOT filename LIKE '%.pdf', 'c': paper_id}}) AS paper_id,
  arg_min(paper_id, {{'b': NOT filename LIKE '%.pdf', 'c': paper_id}}) FILTER (paper_or_daan = 'paper') AS paper_id_paper, arg_min(paper_id, {{'b': NOT filename LIKE '%.pdf', 'c': paper_id}}) FILTER (paper_or_daan = 'daan') AS paper_id_daan
  FROM catalog WHERE contains(school_name, '仁愛國小') GROUP BY {_KEYS}), f AS (SELECT * FROM g WHERE paper_id_daan IS NOT NULL)
SELECT *, '有' AS download_answer, (SELECT count(*) FROM f) AS total, CAST(greatest(ceil((SELECT count(*) FROM f) / 30.0), 1) AS BIGINT) AS pages FROM f
ORDER BY county, coalesce(TRY_CAST(school_year AS INT), 0) DESC, exam_type NULLS FIRST, grade NULLS FIRST, subject NULLS FIRST, paper_id LIMIT 30"""
)
def search_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with an answer sheet of schools that match a name."""
    return search.search_groups(catalog(spark, sf_dir), {}, "仁愛國小", "daan", 1, 30)


_WANTED = "SELECT paper_id, CASE WHEN k % 2 = 0 THEN 'daan' ELSE 'paper' END AS kind FROM catalog WHERE k % 4 < 2"


@query(
    CATALOG_SQL
    + f""", shown AS (SELECT * FROM catalog), sheets AS ({_PAIRED}), wanted AS ({_WANTED})
SELECT w.paper_id, w.kind, coalesce(CASE w.kind WHEN 'paper' THEN b.paper_id_paper ELSE b.paper_id_daan END, b.paper_id) AS chosen_id,
  CASE WHEN (CASE w.kind WHEN 'paper' THEN b.paper_id_paper ELSE b.paper_id_daan END) IS NOT NULL THEN w.kind WHEN w.kind = 'paper' THEN 'daan' ELSE 'paper' END AS actual
FROM wanted w JOIN catalog a USING (paper_id) JOIN sheets b ON {_NULL_SAFE}"""
)
def lookup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the sheet that is asked for, or its companion."""
    rows = catalog(spark, sf_dir)
    return search.lookup_pairs(rows.filter("k % 4 < 2").select("paper_id", F.when(F.col("k") % 2 == 0, "daan").otherwise("paper").alias("kind")), rows)


@query(
    CATALOG_SQL
    + """, b AS (SELECT county, school_name, bool_or(grade IN ('一年級', '二年級', '三年級', '四年級', '五年級', '六年級')) AS p, bool_or(grade IN ('七年級', '八年級', '九年級')) AS j, bool_or(grade IN ('十年級', '十一年級', '十二年級')) AS s FROM catalog WHERE school_name IS NOT NULL GROUP BY 1, 2)
SELECT county, school_name, CASE WHEN coalesce(p, false) OR coalesce(j, false) OR coalesce(s, false) THEN concat_ws(',', CASE WHEN p THEN '國小' END, CASE WHEN j THEN '國中' END, CASE WHEN s THEN '高中' END) ELSE '國小,國中,高中' END AS bands FROM b"""
)
def grade_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F11."""
    return search.grade_bands(catalog(spark, sf_dir))


@query(CATALOG_SQL + "SELECT paper_id, contains(rel_path, '/_drivefolder/') AS dump FROM catalog WHERE school_term IS NULL OR school_year IS NULL OR exam_type IS NULL OR school_name IS NULL OR county = ''")
def needs_text_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: rows with a blank field, and which of them are of dumps."""
    rows = search.needs_text_pass(catalog(spark, sf_dir), only_blank=True)
    dump = search.needs_text_pass(rows, only_dump=True).select("paper_id", F.lit(True).alias("dump"))
    return rows.select("paper_id").join(dump, "paper_id", "left").select("paper_id", F.coalesce("dump", F.lit(False)).alias("dump"))


@query(CATALOG_SQL + "SELECT paper_id FROM catalog WHERE level = '高中' AND k NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 200000)")
def takedowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search without papers that were taken down, which the dear orders stand for."""
    rows = catalog(spark, sf_dir)
    gone = rows.join(read(spark, sf_dir, "orders").filter("o_totalprice > 200000").select(F.col("o_orderkey").alias("k")), "k").select("paper_id")
    return search.without_takedowns(rows.filter("level = '高中'"), gone).select("paper_id")


_HISTORY = f"WITH {_AUDIT}, mine AS (SELECT * FROM audit WHERE action IN ('download', 'batch_download') AND user_id % 10 = 3 AND amount % 2 = 0)"


@query(_HISTORY + " SELECT user_id, event_id, ts, total, CAST(greatest(ceil(total / 25.0), 1) AS BIGINT) AS pages FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n, count(*) OVER (PARTITION BY user_id) AS total FROM mine) WHERE n <= 25")
def download_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the first page of 25 of each reader's downloads under a filter, newest first, with totals."""
    rows = activity_queries.audit(spark, sf_dir).filter("action in ('download', 'batch_download') and user_id % 10 = 3 and amount % 2 = 0")
    n = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    totals = rows.groupBy("user_id").agg(F.count("*").alias("total"))
    shown = rows.withColumn("n", n).filter("n <= 25").join(totals, "user_id")
    return shown.select("user_id", "event_id", "ts", "total", F.greatest(F.ceil(F.col("total") / 25), F.lit(1)).alias("pages"))


@query(f"WITH {_AUDIT}, u AS (SELECT user_id, min(ts) AS first_seen, arg_max(action, {{'a': ts, 'b': event_id}}) = 'submit_access_request' AS pending FROM audit GROUP BY user_id) SELECT user_id, first_seen, pending, row_number() OVER (ORDER BY first_seen, user_id) AS place FROM u ORDER BY first_seen, user_id LIMIT 50")
def admin_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the first fifty users by first appearance, and whether a request of theirs is pending."""
    rows = activity_queries.audit(spark, sf_dir).groupBy("user_id").agg(F.min("ts").alias("first_seen"), (F.max_by("action", F.struct("ts", "event_id")) == "submit_access_request").alias("pending"))
    first = rows.orderBy("first_seen", "user_id").limit(50)
    return first.withColumn("place", F.row_number().over(W.orderBy("first_seen", "user_id")))  # fifty rows


# joins

_STATUS = "SELECT c.paper_id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'failed' END AS ocr_status, o_orderpriority AS note FROM catalog c JOIN orders ON o_orderkey = k"


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text-pass states that the orders stand for."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed").alias("ocr_status"), F.col("o_orderpriority").alias("note"))
    return catalog(spark, sf_dir).select("paper_id", "k").join(orders, "k").drop("k")


@query(CATALOG_SQL + f", status AS ({_STATUS}) SELECT paper_id, ocr_status AS status_ocr_status, note AS status_note, rel_path FROM status JOIN catalog USING (paper_id) WHERE ocr_status IN ('done', 'failed')")
def by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2."""
    return upkeep.by_state(status(spark, sf_dir), catalog(spark, sf_dir), ["done", "failed"]).select("paper_id", "status_ocr_status", "status_note", "rel_path")


@query(CATALOG_SQL + ", listed AS (SELECT DISTINCT CASE layout WHEN 'dump' THEN path ELSE rel_path END AS rel_path FROM placed) SELECT rel_path FROM listed WHERE rel_path NOT IN (SELECT rel_path FROM catalog WHERE k % 3 <> 0)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed files that a catalogue, here without every third order, does not know."""
    listed = jobs.newest_paths(seed.listing(spark, sf_dir)).select("rel_path")
    return listed.join(catalog(spark, sf_dir).filter("k % 3 <> 0").select("rel_path"), "rel_path", "left_anti")


@query("SELECT p_partkey AS item_id, p_size AS page FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate < DATE '1993-06-01') ORDER BY p_size, p_partkey LIMIT 100")
def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in order of page that no early line item collected."""
    listed = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_size").alias("page"))
    done = read(spark, sf_dir, "lineitem").filter("l_shipdate < date '1993-06-01'").select(F.col("l_partkey").alias("item_id"))
    return upkeep.pending(listed, done, [F.asc("page"), F.asc("item_id")], 100)


@query(
    f"""WITH {_AUDIT}, asked AS (SELECT DISTINCT ts AS as_of, account AS cur FROM audit WHERE action = 'search' AND event_id % 20 = 0),
limits AS (SELECT account, ts, ts + to_minutes(amount % 60) AS until FROM audit WHERE action = 'rate_limited'),
state AS (SELECT as_of, cur, account, (SELECT arg_max(until, {{'a': l.ts, 'b': l.until}}) FROM limits l WHERE l.account = n.account AND l.ts <= as_of AND CAST(l.ts + INTERVAL '8 hours' AS DATE) = CAST(as_of + INTERVAL '8 hours' AS DATE)) AS until FROM asked, (SELECT unnest([0, 1, 2, 3]) AS account) n)
SELECT as_of, cur AS current, min(account) FILTER (account <> cur AND NOT coalesce(until > as_of, false)) AS account, min(until) FILTER (until > as_of) AS recovers FROM state GROUP BY 1, 2"""
)
def next_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The account that takes over at some of the searches."""
    rows = activity_queries.audit(spark, sf_dir)
    asked = rows.filter("action = 'search' and event_id % 20 = 0").select(F.col("ts").alias("as_of"), F.col("account").alias("current")).distinct()
    accounts = asked.withColumn("account", F.explode(F.array(*[F.lit(i).cast("long") for i in range(4)]))).withColumn("place", F.col("account"))
    limits = rows.filter("action = 'rate_limited'").select("account", "ts", (F.col("ts") + F.make_dt_interval(mins=F.col("amount").cast("int") % 60)).alias("until"))
    return upkeep.next_account(accounts, limits)


@query(CATALOG_SQL + f", {_AUDIT}, first AS (SELECT k, min(paper_id) AS paper_id FROM catalog GROUP BY k) SELECT paper_id, title, count(*) AS downloads FROM audit JOIN first ON k = CAST(key AS BIGINT) JOIN (SELECT paper_id, filename AS title FROM catalog) USING (paper_id) WHERE action = 'download' GROUP BY 1, 2 ORDER BY downloads DESC, paper_id LIMIT 10")
def hot_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten papers with most downloads and their names."""
    rows = catalog(spark, sf_dir)
    first = rows.groupBy("k").agg(F.min("paper_id").alias("paper_id"))
    downloads = activity_queries.audit(spark, sf_dir).filter("action = 'download'").select(F.col("key").cast("long").alias("k")).join(first, "k").select("paper_id")
    return upkeep.hot_papers(downloads, rows.withColumn("title", F.col("filename")), 10)


_URL = "CASE s_suppkey % 7 WHEN 0 THEN concat('https://drive.google.com/drive/folders/', s_suppkey) WHEN 1 THEN concat('https://x.sharepoint.com/', s_suppkey) WHEN 2 THEN concat('https://sites.google.com/view/', s_suppkey) WHEN 3 THEN concat('http://nas.s', s_suppkey, '.kh.edu.tw:5001/') WHEN 4 THEN concat('https://example.org/', s_suppkey) ELSE concat('https://www.s', s_suppkey, '.kh.edu.tw/modules/tad/') END"
_KIND = "CASE s_suppkey % 7 WHEN 0 THEN 'drive' WHEN 1 THEN 'sharepoint' WHEN 2 THEN 'sites' WHEN 3 THEN 'nas' WHEN 4 THEN 'other' ELSE 'school_web' END"
_CATEGORY = "CASE s_suppkey % 3 WHEN 0 THEN 'junior' WHEN 1 THEN 'senior' ELSE 'elementary' END"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schools' sources that the suppliers stand for."""
    rows = read(spark, sf_dir, "supplier").selectExpr("s_suppkey", "s_name as name", f"{_URL} as url", f"{_CATEGORY} as category", "s_nationkey as county")
    return rows.withColumn("link_type", links.link_type(F.col("url")))


@query(f"SELECT s_suppkey, {_URL} AS url, {_KIND} AS link_type, CASE WHEN s_suppkey % 7 > 4 THEN 'modules' ELSE 'static' END AS strategy, {_CATEGORY.replace('junior', '國中').replace('senior', '高中').replace('elementary', '國小')} AS level FROM supplier")
def source_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X4, X5, P15, IO7."""
    return sources(spark, sf_dir).select("s_suppkey", "url", "link_type", links.cms_strategy(F.col("url")).alias("strategy"), paths.level_of_school(F.col("name"), F.col("category")).alias("level"))


@query(f"SELECT category, county, count(*) AS n, grouping(category, county) AS depth FROM (SELECT s_nationkey AS county, {_CATEGORY} AS category FROM supplier) GROUP BY ROLLUP (category, county)")
def source_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13."""
    return upkeep.source_totals(sources(spark, sf_dir))


@query(f"SELECT s_suppkey, {_URL} AS url FROM supplier WHERE s_suppkey % 7 > 4 AND contains(s_name, 'Supp') AND s_suppkey % 5 <> 0")
def to_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """schools' own sites with a word in their name that are not completed."""
    rows = sources(spark, sf_dir)
    done = rows.select("url", F.when(F.col("s_suppkey") % 5 == 0, "completed").otherwise("failed").alias("status"))
    return upkeep.to_crawl(rows, done, "Supp").select("s_suppkey", "url")


# set operations

_EARLY, _LATE, _RETRIED = "l_shipdate < DATE '1994-01-01'", "l_shipdate >= DATE '1998-01-01'", "l_returnflag = 'R' AND l_linenumber = 1"


@query(f"SELECT 'collected' AS what, item_id FROM (SELECT l_partkey AS item_id FROM lineitem WHERE {_EARLY} UNION SELECT l_partkey FROM lineitem WHERE {_LATE}) UNION ALL SELECT 'still_failing', item_id FROM (SELECT l_partkey AS item_id FROM lineitem WHERE {_RETRIED} EXCEPT SELECT l_partkey FROM lineitem WHERE {_EARLY})")
def id_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4: ids collected before or now; retried ones without those that succeeded."""
    ids = lambda cond: read(spark, sf_dir, "lineitem").filter(cond).select(F.col("l_partkey").alias("item_id"))
    both = ids(_EARLY).union(ids(_LATE)).distinct().select(F.lit("collected").alias("what"), "item_id")
    return both.unionByName(ids(_RETRIED).subtract(ids(_EARLY)).select(F.lit("still_failing").alias("what"), "item_id"))


# upkeep


@query(CATALOG_SQL + "SELECT count(*) AS before, count(*) FILTER (k % 5 <> 0) AS after, count(*) FILTER (k % 5 = 0) AS deleted FROM catalog")
def delete_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: a fifth of the paths, and some that are not there, are deleted; rows before and after."""
    rows = catalog(spark, sf_dir)
    gone = rows.filter("k % 5 = 0").select("rel_path").unionByName(rows.select(F.concat(F.lit("none/"), "rel_path").alias("rel_path")))
    left = jobs.delete_paths(rows, gone).agg(F.count("*").alias("after"))
    return rows.agg(F.count("*").alias("before")).join(F.broadcast(left)).withColumn("deleted", F.col("before") - F.col("after"))


_HIGHER = "(exam_type LIKE '%段考%' OR exam_type LIKE '%階段%' OR exam_type LIKE '%評量%')"
_P_GRADES = "grade IN ('一年級', '二年級', '三年級', '四年級', '五年級', '六年級')"


@query(
    CATALOG_SQL
    + f""", parsed AS (SELECT c.paper_id, c.rel_path, c.paper_or_daan, coalesce(nullif(CASE WHEN k % 9 = 0 THEN '新北市' WHEN k % 11 = 0 THEN '' ELSE county END, ''), county) AS county, c.school_name AS school, school_year, coalesce(school_term, '') AS term, coalesce(exam_type, '') AS exam_type, grade, subject FROM catalog c WHERE layout IN ('full', 'legacy')),
levelled AS (SELECT *, CASE WHEN {_P_GRADES} AND {_HIGHER} THEN '國中' WHEN {_P_GRADES} THEN '國小' WHEN grade IN ('七年級', '八年級', '九年級') THEN '國中' ELSE '高中' END AS lv FROM parsed),
graded AS (SELECT *, CASE WHEN lv = '國中' AND grade = '一年級' THEN '七年級' WHEN lv = '國中' AND grade = '二年級' THEN '八年級' WHEN lv = '國中' AND grade = '三年級' THEN '九年級' ELSE grade END AS g,
  regexp_replace(school, concat('^(', county, ')+'), '') AS short FROM levelled),
moved AS (SELECT *, concat(county, '/', lv, '/', g, '/', subject, '/', array_to_string(list_filter([county, short, g, school_year, term, exam_type, subject, CASE paper_or_daan WHEN 'daan' THEN 'daan' ELSE '' END], lambda x: x <> ''), '_'), '.pdf') AS new_path FROM graded)
SELECT m.paper_id, m.rel_path, new_path, CASE WHEN new_path = m.rel_path THEN 'no_change' WHEN c.paper_id IS NOT NULL THEN 'skip_target_exists' ELSE 'moved' END AS action FROM moved m LEFT JOIN catalog c ON c.rel_path = new_path"""
)
def rehome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where text-pass results send the catalogue's files."""
    rows = catalog(spark, sf_dir).filter("layout in ('full', 'legacy')")
    parsed = rows.select("paper_id", F.expr("case when k % 9 = 0 then '新北市' when k % 11 = 0 then '' else county end").alias("county"), "school_name", "school_year", F.lit("").alias("filetype"), "school_term", "exam_type", "grade", "subject")
    return upkeep.rehome_plan(parsed, catalog(spark, sf_dir)).select("paper_id", "rel_path", "new_path", "action")


@query(
    f"""WITH named AS ({seed.ATTRIBUTES_SQL}), files AS (SELECT DISTINCT rel_path, school AS school_name FROM named WHERE k % 40 = 9), config AS ({dump_queries.CONFIG_SQL}),
new AS (SELECT f.rel_path, c.county, CASE WHEN c.county IS NOT NULL THEN concat(c.county, substr(f.rel_path, 4)) END AS new_path FROM files f LEFT JOIN config c USING (school_name))
SELECT rel_path, new_path, CASE WHEN new_path IS NULL THEN 'no_county' WHEN row_number() OVER (PARTITION BY new_path ORDER BY rel_path) > 1 THEN 'collision' ELSE 'move' END AS status FROM new"""
)
def county_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without a county's folder move below the county that a table gives their school."""
    files = seed.attributes(spark, sf_dir).filter("k % 40 = 9").select("rel_path", F.col("school").alias("school_name")).distinct()
    return upkeep.county_migration(files, dump_queries.configured(spark, sf_dir).select("school_name", F.col("county").alias("found_county")))


_CHANGE = "CASE action WHEN 'batch_download' THEN 'approve' WHEN 'rate_limited' THEN CASE WHEN amount % 3 = 0 THEN 'ban' ELSE 'reject' END WHEN 'submit_access_request' THEN 'reset' WHEN 'download' THEN 'change_permission' END"


@query(
    f"""WITH {_AUDIT}, e AS (SELECT user_id, ts, event_id, {_CHANGE} AS action, amount % 10 AS permission FROM audit WHERE action <> 'search' AND user_id % 25 <> 0),
r AS (SELECT user_id, max({{'a': ts, 'b': event_id}}) FILTER (action = 'reset') AS reset FROM e GROUP BY 1),
l AS (SELECT user_id, arg_max(action, {{'a': ts, 'b': event_id}}) AS act, arg_max(permission, {{'a': ts, 'b': event_id}}) AS p, max({{'a': ts, 'b': event_id}}) AS last FROM e WHERE action <> 'reset' GROUP BY 1)
SELECT user_id, CASE WHEN act IS NULL OR (reset > last AND act <> 'ban') THEN 'pending' WHEN act = 'ban' THEN 'banned' WHEN act = 'reject' THEN 'rejected' WHEN act = 'change_permission' AND p > 8 THEN 'pending' ELSE 'approved' END AS status,
  CAST(CASE WHEN act IS NULL OR (reset > last AND act <> 'ban') THEN 9 WHEN act = 'change_permission' THEN p WHEN act = 'approve' THEN 7 ELSE 9 END AS BIGINT) AS permission
FROM r LEFT JOIN l USING (user_id)"""
)
def access_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: states after all changes, with guards and permissions; every 25th user is an administrator."""
    rows = activity_queries.audit(spark, sf_dir).filter("action <> 'search'").select("user_id", "ts", "event_id", F.expr(_CHANGE).alias("action"), (F.col("amount") % 10).alias("permission"))
    return upkeep.access_state(rows, rows.filter("user_id % 25 = 0").select("user_id").distinct())


_USERS = "SELECT c_custkey AS user_id, CASE c_custkey % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'pending' WHEN 2 THEN 'rejected' ELSE 'banned' END AS status, c_custkey % 97 = 0 AS is_admin FROM customer"


@query(f"SELECT user_id, CASE WHEN is_admin THEN 0 WHEN status = 'approved' THEN 8 ELSE 9 END AS first, CASE WHEN is_admin THEN 0 WHEN status = 'approved' THEN 7 ELSE 9 END AS permission FROM ({_USERS})")
def permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: permissions that follow from the status, before and after the shift."""
    users = upkeep.backfill_permission(spark.sql(_USERS.replace("FROM customer", "FROM {customer}"), customer=read(spark, sf_dir, "customer")))
    return upkeep.shift_permission(users.withColumn("first", F.col("permission"))).select("user_id", "first", "permission")


@query(f"SELECT count(*) AS users, count(*) FILTER (NOT is_admin AND status = 'approved') AS approved FROM ({_USERS})")
def approved_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and approved ones among them, administrators apart."""
    users = upkeep.shift_permission(upkeep.backfill_permission(spark.sql(_USERS.replace("FROM customer", "FROM {customer}"), customer=read(spark, sf_dir, "customer"))))
    return users.agg(F.count("*").alias("users"), F.count_if((F.col("permission") <= upkeep.APPROVED) & ~F.col("is_admin")).alias("approved"))


_KNOWN = "SELECT c_custkey AS user_id, concat('g', c_custkey) AS google_id, concat('u', c_custkey, '@x.tw') AS email, CAST(NULL AS TIMESTAMP) AS last_login, false AS is_admin FROM customer WHERE c_custkey % 3 = 0"
_LOGINS = "SELECT CASE WHEN o_custkey % 2 = 0 THEN concat('g', o_custkey) ELSE concat('other', o_custkey) END AS google_id, concat('u', o_custkey, '@x.tw') AS email, CAST(o_orderdate AS TIMESTAMP) AS ts FROM orders"


@query(
    f"""WITH users AS ({_KNOWN}), logins AS ({_LOGINS}), one AS (SELECT google_id, min(email) AS email, max(ts) AS ts FROM logins GROUP BY 1),
who AS (SELECT one.*, coalesce(a.user_id, b.user_id) AS user_id FROM one LEFT JOIN users a USING (google_id) LEFT JOIN users b ON b.email = one.email)
SELECT u.user_id, u.google_id, u.email, s.ts AS last_login, u.email IN ('u3@x.tw', 'u4@x.tw') AS is_admin FROM users u LEFT JOIN (SELECT user_id, max(ts) AS ts FROM who GROUP BY 1) s USING (user_id)
UNION ALL SELECT NULL, min(google_id), email, max(ts), email IN ('u3@x.tw', 'u4@x.tw') FROM who WHERE user_id IS NULL GROUP BY email"""
)
def logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: users after the logins that the orders stand for."""
    users = spark.sql(_KNOWN.replace("FROM customer", "FROM {customer}"), customer=read(spark, sf_dir, "customer"))
    seen = spark.sql(_LOGINS.replace("FROM orders", "FROM {orders}"), orders=read(spark, sf_dir, "orders"))
    return upkeep.login_users(users, seen, ["U3@x.tw", "u4@x.tw"])


@query(
    CATALOG_SQL
    + """SELECT paper_id, CASE WHEN n = 1 THEN name WHEN contains(name, '.') THEN concat(left(name, length(name) - 4), '_', n - 1, '.pdf') ELSE concat(name, '_', n - 1) END AS unique_name
FROM (SELECT paper_id, name, row_number() OVER (PARTITION BY batch, name ORDER BY paper_id) AS n FROM (SELECT paper_id, k % 50 AS batch, concat(coalesce(subject, 'x'), CASE WHEN k % 2 = 0 THEN '.a.pdf' ELSE '' END) AS name FROM catalog))"""
)
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names within batches."""
    items = catalog(spark, sf_dir).select(F.col("paper_id").alias("item_id"), (F.col("k") % 50).alias("batch"), F.concat(F.coalesce("subject", F.lit("x")), F.when(F.col("k") % 2 == 0, ".a.pdf").otherwise("")).alias("name"))
    return upkeep.dedupe_names(items).select(F.col("item_id").alias("paper_id"), "unique_name")


@query(f"WITH {_AUDIT} SELECT event_id, user_id, n - 1 AS pending FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM audit WHERE action = 'submit_access_request') WHERE n > 1")
def repeated_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W10."""
    return upkeep.repeated_requests(activity_queries.audit(spark, sf_dir))


@query("SELECT p.total, c.collected, round(c.collected * 100 / p.total, 1) AS percent, p.total - c.collected AS remaining, CAST(ceil((p.total - c.collected) / 120.0) AS BIGINT) AS days FROM (SELECT count(*) AS total FROM part) p, (SELECT count(DISTINCT l_partkey) AS collected FROM lineitem WHERE l_shipdate < DATE '1992-06-01') c")
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18."""
    done = read(spark, sf_dir, "lineitem").filter("l_shipdate < date '1992-06-01'").select(F.col("l_partkey").alias("item_id"))
    return upkeep.progress(read(spark, sf_dir, "part"), done)


# path expressions over the catalogue

@query(
    CATALOG_SQL
    + """SELECT paper_id, CASE WHEN level <> '' AND subject IS NOT NULL AND paper_or_daan IN ('paper', 'daan') THEN concat(county, '/', level, '/', grade, '/', replace(replace(subject || '/甲:x', '/', '／'), ':', '：'), '/', paper_or_daan) END AS folder,
  concat(CASE WHEN county = '其他X' OR k % 6 = 0 THEN '其他X' ELSE county END, '_', school_year, coalesce(school_term, ''), '_', coalesce(exam_type, '無'), '_', coalesce(fileid, '0'), '_', replace(school_name, '/', '／'), '_', coalesce(version, '未註明')) AS name,
  concat_ws('_', school_name, grade, concat(school_year, coalesce(school_term, CASE WHEN contains(rel_path, '上學期') THEN '上學期' WHEN contains(rel_path, '下學期') THEN '下學期' ELSE '' END)), CASE WHEN k % 3 = 0 THEN '語文領域' END, subject, exam_type, version, CASE paper_or_daan WHEN 'daan' THEN '答案' ELSE '試卷' END) || '.pdf' AS download
FROM catalog"""
)
def built_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive folders and names, and download names."""
    c = F.col
    county = F.when(c("k") % 6 == 0, "未知").otherwise(c("county"))
    folder = paths.archive_folder(c("county"), c("grade"), F.concat(c("subject"), F.lit("/甲:x")), c("paper_or_daan"))
    name = paths.archive_name(county, F.concat("school_year", F.coalesce("school_term", F.lit(""))), F.coalesce("exam_type", F.lit("無")), F.coalesce("fileid", F.lit("0")), c("school_name"), c("version"))
    category = F.when(c("k") % 3 == 0, "語文領域").when(c("k") % 3 == 1, c("subject"))
    return catalog(spark, sf_dir).select("paper_id", folder.alias("folder"), name.alias("name"), paths.download_name(c("school_name"), c("grade"), c("school_year"), c("school_term"), c("rel_path"), category, c("subject"), c("exam_type"), c("version"), c("paper_or_daan")).alias("download"))


@query(
    dump_queries.WITH
    + """SELECT paper_id, nullif(school_year, '') AS school_year, CASE WHEN school_year <> '' THEN nullif(school_term, '') END AS school_term, nullif(exam_type, '未註明') AS exam_type, coalesce(nullif(subject, ''), '未分類') AS subject, grade, school_name, CAST(NULL AS VARCHAR) AS version
FROM classified WHERE confidence <> 'LOW'"""
)
def fixed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names that a dump's files get, read back."""
    rows = dump_queries.classified(spark, sf_dir).filter("confidence <> 'LOW'")
    return names.computed(rows.select("paper_id", "target_filename"), of=names.parse_fixed_name(F.concat("target_filename", F.lit(".pdf")))).select("paper_id", "of.*")


@query(
    dump_queries.WITH
    + """SELECT paper_id, county, nullif(school_year, '') AS school_year, CASE WHEN school_year <> '' THEN nullif(school_term, '') END AS school_term, nullif(exam_type, '未註明') AS exam_type, coalesce(nullif(subject, ''), '未分類') AS subject, grade, school_name
FROM classified WHERE confidence <> 'LOW'"""
)
def minimal_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the places of the parts alone."""
    rows = dump_queries.classified(spark, sf_dir).filter("confidence <> 'LOW'")
    return names.computed(rows.select("paper_id", "target_filename"), of=names.minimal_parse(F.concat("target_filename", F.lit(".pdf")))).select("paper_id", "of.*")


@query(
    CATALOG_SQL
    + """SELECT DISTINCT school_name, county, substr(school_name, 5) AS plain,
  CASE WHEN county = '其他X' THEN '其他縣市' ELSE county END AS of_county, CASE WHEN county = '其他X' THEN school_name ELSE substr(school_name, 4) END AS short FROM catalog WHERE layout <> 'full' OR level <> '高中'"""
)
def school_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counties, short names and archive names of all schools."""
    rows = catalog(spark, sf_dir).filter("layout <> 'full' or level <> '高中'").select("school_name", "county").distinct()
    return rows.select("school_name", "county", archive_name(F.col("school_name"), F.col("county")).alias("plain"), county_of(F.col("school_name")).alias("of_county"), short_name(F.col("school_name")).alias("short"))


@query(
    CATALOG_SQL
    + """, r AS (SELECT *, grade IN ('一年級', '二年級', '三年級', '七年級', '八年級', '九年級') AS low FROM catalog WHERE layout = 'full')
SELECT paper_id, CASE WHEN k % 10 < 5 THEN school_name WHEN k % 10 = 5 THEN CASE WHEN exam_type IN ('期中考', '期末考') THEN school_name END
  WHEN k % 10 = 6 AND paper_or_daan = 'paper' THEN regexp_extract(filename, '_([^_]+)_[^_]+_[^_]+\\.pdf$', 1)
  WHEN k % 10 = 7 AND paper_or_daan = 'daan' THEN subject WHEN NOT low THEN grade END AS school FROM r"""
)
def counted_schools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P34."""
    rows = catalog(spark, sf_dir).filter("layout = 'full'")
    return rows.select("paper_id", names.counted_school(F.col("filename"), F.col("county")).alias("school"))
