"""Registered queries of inbox files and of files written and read back, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.functions import inbox, links, names, schools
from quirelake.operators import activity_queries
from quirelake.operators import catalog as jobs
from quirelake.plans import catalog_queries, dump_queries, seed
from quirelake.plans.catalog_queries import CATALOG_SQL, catalog
from quirelake.plans.registry import Registry
from quirelake.plans.text_queries import derived
from quirelake.sources import files, store

_registry = Registry("box")
query, queries, oracle_sql = _registry.query, _registry.queries, _registry.oracle_sql

_G = "CASE CAST(FLOOR(k / 3.0) AS BIGINT) % 3 WHEN 0 THEN '七' WHEN 1 THEN '八' ELSE '九' END"
_NAME = f"""SELECT DISTINCT k, k % 7 AS form, county, school, level, grade, subject, exam_type, school_year AS y, {_G} AS c, CASE k % 2 WHEN 0 THEN '上' ELSE '下' END AS t, CASE k % 2 WHEN 0 THEN '1' ELSE '2' END AS n, filetype FROM ({seed._NAMED}) named WHERE county <> '其他X'"""
INBOX_SQL = f"""SELECT *, CASE form WHEN 0 THEN concat(y, '學年度第', n, '學期', c, '年級', subject, '第一次段考.pdf') WHEN 1 THEN concat(y, n, c, '解答2.pdf') WHEN 2 THEN concat(y, t, '2段', c, '數.pdf') WHEN 3 THEN concat('社會_', y, '-', n, '-3公民(答案).pdf')
  WHEN 4 THEN concat('期末考', CASE filetype WHEN 'daan' THEN '_daan' ELSE '' END, '.pdf') WHEN 5 THEN concat(y, '_高二', subject, '_三月.docx') ELSE '掃描.pdf' END AS name,
  CASE WHEN form IN (0, 1, 2, 3) THEN concat('_inbox/', county, '_schools/', school, '/x/') ELSE concat('_inbox/', county, '/', level, '/', grade, '/', subject, '/', filetype, '/') END AS folder FROM ({_NAME}) b"""
_PLAIN = "CASE subject WHEN '英語' THEN '英文' ELSE subject END"


@query(
    f"""WITH b AS ({INBOX_SQL}), m AS (SELECT k, name, county, CASE WHEN form IN (0, 1, 2, 3) THEN substr(school, 5) WHEN k % 5 = 0 THEN 'S' END AS school_name,
  CASE WHEN form IN (0, 1, 2) THEN concat(c, '年級') WHEN form = 3 THEN CASE WHEN k % 5 = 0 THEN '六年級' END WHEN form = 5 THEN '十一年級' ELSE CASE WHEN k % 5 = 0 THEN '六年級' ELSE grade END END AS grade,
  CASE form WHEN 1 THEN CASE WHEN k % 5 = 0 THEN '自然' END WHEN 2 THEN '數學' WHEN 3 THEN '公民' WHEN 0 THEN {_PLAIN} WHEN 5 THEN {_PLAIN} ELSE CASE WHEN k % 5 = 0 THEN '自然' ELSE {_PLAIN} END END AS subject, form, filetype,
  CASE WHEN form IN (0, 1, 2, 3, 5) THEN y END AS school_year, CASE WHEN form IN (0, 1, 3) THEN concat(t, '學期') WHEN form = 2 THEN concat(t, '學期') END AS school_term,
  CASE form WHEN 0 THEN '第一次段考' WHEN 1 THEN '第二次段考' WHEN 4 THEN '期末考' WHEN 5 THEN '第三次月考' END AS exam_type FROM b),
r AS (SELECT *, concat_ws(',', CASE WHEN grade IS NULL THEN 'grade' END, CASE WHEN subject IS NULL THEN 'subject' END, CASE WHEN school_year IS NULL THEN 'school_year' END) AS missing FROM m)
SELECT k, name, county, CASE WHEN form IN (0, 1, 2, 3) AND k % 5 = 0 THEN 'S' ELSE school_name END AS school_name, grade, CASE WHEN subject = '社會' THEN '社會' ELSE subject END AS subject, school_year, school_term, exam_type,
  CASE WHEN form > 3 THEN filetype WHEN form = 3 THEN 'daan' ELSE 'paper' END AS filetype, missing, CASE WHEN missing = '' THEN 'keep' ELSE 'skip_low_quality' END AS action FROM r"""
)
def inbox_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of inbox files from names, side files (every fifth has one) and folders."""
    c = F.col
    rows = derived(spark, sf_dir, INBOX_SQL, "lineitem", seed.sheets(spark, sf_dir)).select("k", "name", "folder", "county")
    side = lambda v: F.when(c("k") % 5 == 0, v)
    rows = rows.withColumn("side", F.struct(side("自然").alias("subject"), side("S").alias("school_name"), side("六年級").alias("grade")))
    rows = names.computed_once(rows, "name", read=inbox.read_name(c("name")))  # many folders hold files of one name
    made = names.computed(rows, of=inbox.merged_with(c("read"), c("side"), F.concat("folder", "name"), c("county")))
    return made.select("k", "name", *[f"of.{f}" for f in ("county", "school_name", "grade", "subject", "school_year", "school_term", "exam_type", "filetype", "missing", "action")])


_DRIVE = f"""SELECT DISTINCT k, k % 4 AS form, school, county, y, t, subject, concat('_inbox/_未分類/DriveFolder/', county, '/', school, '/', y, '學年度/', CASE k % 4 WHEN 0 THEN concat(y, t, '學期第2次段考') WHEN 1 THEN concat(y, t, '學期') WHEN 2 THEN concat(y, '3段') ELSE '其他' END, '/', subject, '/a.pdf') AS path
FROM ({_NAME}) b"""


@query(
    f"""WITH d AS ({_DRIVE}) SELECT k, county, school AS school_name, CASE subject WHEN '英語' THEN '英文' ELSE subject END AS subject, y AS school_year, CASE WHEN form < 2 THEN concat(t, '學期') WHEN form = 2 THEN '下學期' END AS school_term,
CASE form WHEN 0 THEN '第二次段考' WHEN 2 THEN '第三次段考' END AS exam_type FROM d"""
)
def drive_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P25: fields of drive folders' paths."""
    rows = derived(spark, sf_dir, _DRIVE, "lineitem").select("k", "path")
    return names.computed(rows, of=inbox.drive_path(F.col("path"))).select("k", "of.*")


_YEARS = "CASE p_partkey % 5 WHEN 0 THEN '一一零' WHEN 1 THEN '98' WHEN 2 THEN '107' WHEN 3 THEN '12' ELSE '' END"
_MESSY = "CASE p_partkey % 5 WHEN 0 THEN '_新北市_unknown_段考_local_ee4a_新北市崇林國中' WHEN 1 THEN '新北市新北市崇林國中' WHEN 2 THEN '崇林國中_local_ab_cd' WHEN 3 THEN 'a__b_' ELSE '崇林國中_unknown_9' END"


@query(
    f"""SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN '110' ELSE {_YEARS} END AS year, CASE p_partkey % 5 WHEN 1 THEN '098' WHEN 3 THEN '112' ELSE {_YEARS} END AS full_year,
  CASE p_partkey % 5 WHEN 0 THEN '新北市_local_ee4a_新北市崇林國中' WHEN 1 THEN '新北市崇林國中' WHEN 2 THEN '崇林國中_cd' WHEN 3 THEN 'a_b' ELSE '崇林國中' END AS school,
  CASE p_partkey % 5 WHEN 0 THEN '其他X' WHEN 1 THEN '桃園縣' WHEN 2 THEN '其他X' WHEN 3 THEN '臺北縣' ELSE '其他X' END AS county, CASE p_partkey % 5 WHEN 1 THEN '桃園市' WHEN 3 THEN '臺北市' WHEN 0 THEN '' WHEN 2 THEN '未註明' ELSE '其他縣市' END AS upgraded FROM part"""
)
def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years, schools' names without placeholders, counties."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey as k", f"{_YEARS} as y", f"{_MESSY} as s", "case p_partkey % 5 when 0 then '' when 1 then '桃園縣' when 2 then '未註明' when 3 then '臺北縣' else '其他縣市' end as c")
    c = F.col
    return rows.select("k", schools.normalise_year(c("y")).alias("year"), schools.full_year(c("y")).alias("full_year"), schools.strip_placeholders(c("s"), F.lit("新北市")).alias("school"), schools.normalise_county(c("c")).alias("county"), schools.upgraded_county(c("c")).alias("upgraded"))


_ASKED = "SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN '高雄市楠梓國中' WHEN 1 THEN '楠梓' WHEN 2 THEN '高雄市立楠梓國中' WHEN 3 THEN '' WHEN 4 THEN '高雄市楠梓國中' ELSE '臺北市建國' END AS q, CASE p_partkey % 6 WHEN 0 THEN '高雄市立楠梓國中' WHEN 1 THEN '高雄市楠梓國中' WHEN 2 THEN '楠梓國中' WHEN 3 THEN 'x' WHEN 4 THEN '高雄市' ELSE '建國高中' END AS s FROM part"


@query(f"SELECT k, q, s, k % 6 <> 4 AS fits, CASE k % 6 WHEN 3 THEN '' WHEN 1 THEN '楠梓' WHEN 5 THEN '建國' ELSE '楠梓國中' END AS plain FROM ({_ASKED})")
def school_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G8, G10."""
    rows = derived(spark, sf_dir, _ASKED, "part")
    return rows.select("k", "q", "s", schools.school_matches(F.col("q"), F.col("s")).alias("fits"), schools.search_name(F.col("q")).alias("plain"))


_FOLLOW = """SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN 'http://a.edu.tw/view/index.php?MainMenuId=3' WHEN 1 THEN 'http://a.edu.tw/upload/x' WHEN 2 THEN 'http://a.edu.tw/modules/t/' WHEN 3 THEN 'http://a.edu.tw/nss/p/' WHEN 4 THEN 'http://a.edu.tw/x' ELSE 'http://a.edu.tw/p/412.php' END AS start,
CASE p_partkey % 12 WHEN 0 THEN 'http://A.edu.tw/view/index.php?mainmenuid=3&SubMenuId=1' WHEN 6 THEN 'http://a.edu.tw/view/index.php?MainMenuId=4&SubMenuId=1' WHEN 1 THEN 'http://a.edu.tw/upload/file_list/3' WHEN 7 THEN 'http://a.edu.tw/upload/other' WHEN 2 THEN 'http://a.edu.tw/modules/t/?of_cat_sn=3&list_mode=1' WHEN 8 THEN 'http://a.edu.tw/modules/t/?x=1'
  WHEN 3 THEN 'http://a.edu.tw/nss/p/exam' WHEN 9 THEN 'http://a.edu.tw/nss/q' WHEN 4 THEN 'http://a.edu.tw/y' WHEN 10 THEN 'http://b.edu.tw/y' ELSE 'http://a.edu.tw/z' END AS candidate, CASE WHEN p_partkey % 12 = 11 THEN '首頁' ELSE '段考題庫' END AS label FROM part"""


@query(f"SELECT k, k % 12 IN (0, 1, 2, 3, 4, 5) AS follow FROM ({_FOLLOW})")
def follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X6."""
    rows = derived(spark, sf_dir, _FOLLOW, "part")
    return rows.select("k", links.should_follow(F.col("start"), F.col("candidate"), F.col("label")).alias("follow"))


@query(CATALOG_SQL + f"SELECT field, count(*) AS n FROM (SELECT paper_id, unnest([{{'field': 'county', 'old': county, 'new': ucounty}}, {{'field': 'school_term', 'old': school_term, 'new': uterm}}, {{'field': 'school_year', 'old': school_year, 'new': uyear}}], recursive := true) FROM catalog JOIN ({catalog_queries._UPD}) u USING (paper_id)) WHERE old <> '' AND new <> '' AND old <> new GROUP BY field")
def diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11."""
    rows = catalog(spark, sf_dir)
    return jobs.field_diffs(catalog_queries._updates(rows), rows, catalog_queries._FIELDS).groupBy("field").agg(F.count("*").alias("n"))


# written and read back


@query(dump_queries.WITH + dump_queries._CONFLICTS + "SELECT paper_id, confidence, conflict_target, skip_reason, size_kb FROM conflicts")
def report_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO4: a classified dump written as CSV and read back."""
    path = store.new_path(spark, "report")
    files.write_report(dump_queries.with_conflicts(spark, sf_dir), path)
    return files.read_report(spark, path).select("paper_id", "confidence", "conflict_target", "skip_reason", "size_kb")


@query(CATALOG_SQL + f"SELECT paper_id, rel_path, field, old AS db_val, new AS ocr_val, substr(rel_path, 1, 200) AS preview FROM (SELECT paper_id, rel_path, 'county' AS field, county AS old, ucounty AS new FROM catalog JOIN ({catalog_queries._UPD}) u USING (paper_id)) WHERE old <> '' AND new <> '' AND old <> new")
def quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO5, IO6: differences of county, written as CSV and read back."""
    rows, path = catalog(spark, sf_dir), store.new_path(spark, "quarantine")
    diffs = jobs.field_diffs(catalog_queries._updates(rows), rows, catalog_queries._FIELDS)
    held = files.quarantine(diffs, rows, rows.select("paper_id", F.col("rel_path").alias("text")))
    files.write_rows(held, path)
    return spark.read.option("header", True).schema(held.schema).csv(path)


@query(f"WITH {activity_queries._AUDIT} SELECT event_id, user_id, action FROM audit WHERE action = 'download' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'")
def audit_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO10: downloads of two weeks, written as CSV and read back."""
    path = store.new_path(spark, "audit")
    rows = files.audit_export(activity_queries.audit(spark, sf_dir), action="download", since="2024-01-05", until="2024-01-20").select("event_id", "user_id", "action")
    files.write_rows(rows, path)
    return spark.read.option("header", True).schema(rows.schema).csv(path)


@query(CATALOG_SQL + "SELECT county, name, count, path FROM (SELECT county, school_name AS name, count(*) AS count, min(rel_path) AS path FROM catalog WHERE school_name IS NOT NULL GROUP BY 1, 2)")
def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO12, IO2, IO11: each county's schools written as JSON, and read back as rows."""
    path = store.new_path(spark, "snapshot")
    files.school_snapshot(catalog(spark, sf_dir)).write.json(path)
    rows = spark.read.schema("county string, schools array<struct<name: string, count: long, path: string>>").json(path)
    return rows.selectExpr("county", "inline(schools)")


@query("SELECT CASE p_partkey % 3 WHEN 0 THEN concat(p_partkey, '上學期考') ELSE concat(p_partkey, '考') END AS title, p_partkey AS fileid, 'paper' AS filetype, CASE p_partkey % 3 WHEN 0 THEN '上學期' WHEN 1 THEN '下學期' ELSE '' END AS school_term FROM part")
def search_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO13: items under any of four names, with terms inferred."""
    c = F.col
    title = F.when(c("p_partkey") % 3 == 0, F.concat("p_partkey", F.lit("上學期考"))).otherwise(F.concat("p_partkey", F.lit("考")))
    item = F.array(F.struct(title.alias("title"), c("p_partkey").alias("fileid"), F.lit("paper").alias("filetype"), F.when(c("p_partkey") % 3 == 1, "下學期").otherwise("").alias("school_term")))
    body = F.when(c("p_partkey") % 4 == 0, F.to_json(F.struct(item.alias("list"))))
    for i, name in enumerate(("data", "results"), 1):
        body = body.when(c("p_partkey") % 4 == i, F.to_json(F.struct(item.alias(name))))
    return files.read_search_response(spark.read.parquet(f"{sf_dir}/part.parquet").select(body.otherwise(F.to_json(F.struct(item.alias("items")))).alias("body")))


#: Files of an archive: papers of three kinds, one with a capital ending, and others that a listing leaves out.
_FILES = "SELECT s_suppkey AS k, concat('archive/', s_suppkey % 5, '/', s_suppkey, '.', CASE s_suppkey % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'DOCX' WHEN 2 THEN 'doc' ELSE 'txt' END) AS rel_path, CAST(s_suppkey % 7 * 1000 + 1 AS INT) AS size FROM supplier"


@query(f"SELECT rel_path, CAST(floor(size / 1024) AS BIGINT) AS size_kb FROM ({_FILES}) f WHERE NOT suffix(rel_path, '.txt')")
def archive_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO1: files written below a folder whose name comes again in it, and listed."""
    root = store.new_path(spark, "archive") + "/archive/x/archive"
    rows = spark.sql(_FILES.replace("FROM supplier", "FROM {supplier}"), supplier=spark.read.parquet(f"{sf_dir}/supplier.parquet"))
    whole = root if "://" in root or root.startswith("file:") else f"file://{root}"
    files.write_files(rows.select("rel_path", F.repeat(F.lit("x"), F.col("size")).cast("binary").alias("content")), whole).write.format("noop").mode("overwrite").save()
    return files.archive_files(spark, root).select("rel_path", "size_kb")
