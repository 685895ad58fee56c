"""Registered queries over a raw dump that the line items stand for, with DuckDB SQL that knows the fields by the way
names are made; the SQL parses nothing.

Every order is one file of the dump for each kind of sheet. ``k % 33`` picks the form of its name and folder, one for
each grade rule that can fire and one without a grade; forms of the one school with rules of its own stand there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.functions import names
from quirelake.operators import dump as jobs
from quirelake.plans import catalog_queries, seed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Form: (folder, name, rule, grade, subject, year, term, exam) as SQL over the attributes below; '' is blank.
#: y year, t 上 or 下, n 1 or 2, d 7 to 9, c 七 to 九, h 一 to 三, e 1 to 3, s one character, whole its subject, subject, exam_type.
FORMS = [
    ("d || '年級'", "subject || '考題'", "path_arabic_年級", "c", "subject", "''", "''", "''"),
    ("c || '年級  ok'", "subject", "path_chinese_年級", "c", "subject", "''", "''", "''"),
    ("'國' || h || '科目'", "y || '-' || n || '-段考'", "path_guo_chinese", "gh", "''", "y", "term", "'段考'"),
    ("'國 ' || e || '科'", "s || ' A卷'", "path_guo_arabic", "ge", "whole", "''", "''", "''"),
    ("d", "s", "path_single_digit", "c", "whole", "''", "''", "''"),
    ("d || 'B'", "subject", "path_digit_letter", "c", "subject", "''", "''", "''"),
    ("d || '年'", "subject", "path_arabic_年_only", "c", "subject", "''", "''", "''"),
    ("'資料'", "y || '學年度第' || n || '學期' || d || '年級' || subject || '第一次段考'", "arabic_年級", "c", "subject", "y", "term", "'第一次段考'"),
    ("'資料'", "y || t || c || '年級' || subject || exam_type || CASE filetype WHEN 'daan' THEN '解答' ELSE '考題' END", "chinese_年級", "c", "subject", "y", "term", "exam_type"),
    ("'資料'", "y || t || '國' || c || '數'", "guo_chinese", "c", "''", "y", "term", "''"),
    ("'資料'", "subject || '國' || h || '答案'", "guo_chinese", "gh", "subject", "''", "''", "''"),
    ("'資料'", "y || '0' || n || '01-' || d || subject", "taoyuan_7digit_dash", "c", "subject", "y", "term", "''"),
    ("'資料'", "y || '0' || n || '01' || c || s || '答案'", "taoyuan_7digit_chinese_subject", "c", "whole", "y", "term", "''"),
    ("'資料'", "y || '0' || n || '01' || c || '寫作題目'", "taoyuan_7digit_2char_subject", "c", "'寫作'", "y", "term", "''"),
    ("'資料'", "d || s || '1'", "taoyuan_bare", "c", "whole", "''", "''", "''"),
    ("'資料'", "y || '0' || n || '0 ' || d || s", "taoyuan_6digit_bare_arabic_subject", "c", "''", "y", "term", "''"),
    ("'資料'", "subject || '_' || c || t || '一段'", "taoyuan_chinese_term", "c", "subject", "''", "''", "''"),
    ("'資料'", "subject || c || t || ' 段考'", "chinese_grade_term", "c", "subject", "''", "''", "'段考'"),
    ("'資料'", "y || '國' || CASE h WHEN '一' THEN '二' ELSE h END || t || '2段'", "guo_term", "CASE h WHEN '三' THEN '九年級' ELSE '八年級' END", "''", "y", "''", "''"),
    ("'資料'", "'國' || e || t || subject", "guo_term_arabic", "ge", "subject", "''", "''", "''"),
    ("'資料'", "subject || '(' || c || ')考'", "paren_grade", "c", "subject", "''", "''", "''"),
    ("'資料'", "c || '英1段'", "chinese_digit_prefix", "c", "'英語'", "''", "''", "''"),
    ("'資料'", "'卷' || c || ' 年' || subject", "chinese_year_then_subject", "c", "subject", "''", "''", "''"),
    ("'資料'", "y || '0' || n || '0' || c || '資訊'", "taoyuan_6digit_chinese_grade", "c", "'資訊'", "y", "term", "''"),
    ("'資料'", "y || c || t || '測'", "3digit_year_grade_term", "c", "''", "y", "''", "''"),
    ("'資料'", "'950' || n || ' ' || d || '-3 ' || subject", "old_format_yy_tt_grade_exam", "c", "subject", "''", "''", "''"),
    ("'資料'", "y || t || '01' || c || '資訊'", "taoyuan_yyyy_term_exam_chinese_subject", "c", "'資訊'", "y", "''", "''"),
    ("'資料'", "y || t || '國' || c || '段一試題'", "guo_chinese", "c", "''", "y", "term", "''"),
    ("'資料'", "y || '0' || n || '02' || c || '資訊'", "taoyuan_7digit_loose_subject", "c", "'資訊'", "y", "term", "''"),
    ("'資料'", "y || '03' || c || '資訊'", "taoyuan_yyyy_exam_chinese_subject", "c", "'資訊'", "y", "''", "''"),
    ("'資料'", "'99上 ' || d || subject || ' 答案'", "zhongping_2digit_year_term_grade", "c", "subject", "''", "''", "''"),
    ("'資料'", "y || '1050102-' || d || s || '試題'", "taoyuan_typo_year_exam_arabic_subject", "c", "''", "y", "''", "''"),
    ("'資料'", "'掃描'", "", "''", "''", "''", "''", "''"),
]
_ONE_SCHOOL = [i for i, f in enumerate(FORMS) if f[2].startswith("taoyuan")]
_ANSWERS = [10, 12, 30]


def _form(column: int) -> str:
    return "CASE k % 33 " + " ".join(f"WHEN {i} THEN {f[column]}" for i, f in enumerate(FORMS)) + " END"


_GROUPED, _SIZE = " GROUP BY k, filetype, county, school, subject, exam_type, school_year, term", "CAST(FLOOR(l_extendedprice) AS BIGINT)"
_SIGNS = f"""
SELECT k, filetype, county, school, subject, exam_type, max({_SIZE}) AS size_kb, school_year AS y,
  CASE k % 2 WHEN 0 THEN '上' ELSE '下' END AS t, term, CASE k % 2 WHEN 0 THEN '1' ELSE '2' END AS n,
  {seed._pick("CAST(FLOOR(k / 3.0) AS BIGINT) % 3", ["7", "8", "9"])} AS d,
  {seed._pick("CAST(FLOOR(k / 3.0) AS BIGINT) % 3", ["七", "八", "九"])} AS c,
  {seed._pick("CAST(FLOOR(k / 5.0) AS BIGINT) % 3", ["一", "二", "三"])} AS h,
  {seed._pick("CAST(FLOOR(k / 5.0) AS BIGINT) % 3", ["1", "2", "3"])} AS e,
  {seed._pick("CAST(FLOOR(k / 7.0) AS BIGINT) % 8", list("公國英數社理歷地"))} AS s,
  {seed._pick("CAST(FLOOR(k / 7.0) AS BIGINT) % 8", ["公民", "國文", "英語", "數學", "社會", "理化", "歷史", "地理"])} AS whole
FROM ({seed._NAMED}) named{_GROUPED}
"""
#: Files of the dump with what their names stand for.
FILES_SQL = f"""
SELECT *, concat('_未分類/DriveFolder/', at_county, '/', at_school, '/', folder, '/', name) AS path,
  substr(sha1(lower(concat(at_county, '/', at_school, '/_drivefolder/', folder, '/', name, '/', CAST(k AS VARCHAR(20)), filetype))), 1, 16) AS paper_id
FROM (
  SELECT k, filetype, size_kb, county, school, {_form(0)} AS folder, concat({_form(1)}, '.pdf') AS name,
    CASE WHEN k % 33 IN ({", ".join(map(str, _ONE_SCHOOL))}) THEN '桃園市' ELSE county END AS at_county,
    CASE WHEN k % 33 IN ({", ".join(map(str, _ONE_SCHOOL))}) THEN '桃園市桃園國中' ELSE school END AS at_school,
    {"CASE k % 33 " + " ".join(f"WHEN {i} THEN '{f[2]}'" for i, f in enumerate(FORMS)) + " END"} AS rule,
    {_form(3)} AS grade_sign, {_form(4)} AS its_subject, {_form(5)} AS its_year, {_form(6)} AS its_term, {_form(7)} AS its_exam,
    CASE WHEN k % 33 IN ({", ".join(map(str, _ANSWERS))}) OR (k % 33 = 8 AND filetype = 'daan') THEN 'daan' ELSE 'paper' END AS its_filetype
  FROM (SELECT *, CASE h WHEN '一' THEN '七年級' WHEN '二' THEN '八年級' ELSE '九年級' END AS gh, CASE e WHEN '1' THEN '七年級' WHEN '2' THEN '八年級' ELSE '九年級' END AS ge FROM ({_SIGNS}) signs) named
) files
"""
#: The same, classified as their makers mean it.
_CLASSIFIED = f"""
dump_files AS ({FILES_SQL}),
dump_graded AS (SELECT *, CASE WHEN length(grade_sign) = 1 THEN concat(grade_sign, '年級') ELSE grade_sign END AS its_grade FROM dump_files),
dump_named AS (
  SELECT *, concat_ws('_', at_county, CASE its_year WHEN '' THEN '未註明' ELSE concat(its_year, its_term) END, coalesce(nullif(its_exam, ''), '未註明'), coalesce(nullif(its_subject, ''), '未分類'), its_grade, at_school, '未註明', 'drivefolder') AS target
  FROM dump_graded
),
classified AS (
  SELECT paper_id, path AS rel_path, name AS filename, at_county AS county, at_school AS school_name, its_year AS school_year, its_term AS school_term,
    coalesce(nullif(its_exam, ''), '未註明') AS exam_type, CASE its_grade WHEN '' THEN '' ELSE '國中' END AS level, its_grade AS grade, rule AS grade_parse_pattern,
    its_subject AS subject, its_filetype AS filetype, CASE WHEN its_grade = '' THEN 'LOW' WHEN its_subject = '' THEN 'MEDIUM' ELSE 'HIGH' END AS confidence,
    CASE its_grade WHEN '' THEN concat('_未分類/_pending_review/', at_county, '/', at_school, '/', name)
      ELSE concat(at_county, '/國中/', its_grade, '/', coalesce(nullif(its_subject, ''), '未分類'), '/', its_filetype, '/', target, '.pdf') END AS target_rel,
    CASE its_grade WHEN '' THEN '' ELSE target END AS target_filename, CASE its_grade WHEN '' THEN 'no_grade' ELSE '' END AS skip_reason, size_kb
  FROM dump_named
)
"""
WITH = catalog_queries.CATALOG_SQL.rstrip() + "," + _CLASSIFIED
_CONFLICTS = """, main AS (SELECT *, coalesce(exam_type, '') AS exam FROM catalog WHERE level <> ''),
conflicts AS (
  SELECT d.*, CASE d.confidence WHEN 'LOW' THEN '' ELSE coalesce((SELECT min(rel_path) FROM main m WHERE m.rel_path = d.target_rel),
    (SELECT min(m.rel_path) FROM main m WHERE m.county = d.county AND m.school_year = d.school_year AND m.grade = d.grade AND m.subject = d.subject AND m.paper_or_daan = d.filetype AND m.exam = d.exam_type AND m.school_name = d.school_name), '') END AS conflict_target
  FROM classified d
)
"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dump's listing: paper_id, path, county and school_name by folder, size_kb."""
    # the sheets of an order by numbers, before texts are made of them
    sheet = F.when(F.col("l_linenumber") % 2 == 1, 1).otherwise(2).alias("l_linenumber")
    sheets = seed.line_items(spark, sf_dir).groupBy("l_orderkey", sheet).agg(F.max("l_extendedprice").alias("l_extendedprice"))
    unread = [F.lit(None).alias(c) for c in ("l_partkey", "l_suppkey", "l_shipdate")]
    one = FILES_SQL.replace(_GROUPED, "").replace(f"max({_SIZE})", _SIZE).replace("FROM lineitem", "FROM {lineitem}")
    rows = spark.sql(seed.whole(one), lineitem=sheets.select("*", *unread))
    return names.computed(rows.select("k", "filetype", "size_kb", "paper_id", F.col("path").alias("_path")), path=F.col("_path"), county=F.get(F.split("_path", "/"), F.lit(2)), school_name=F.get(F.split("_path", "/"), F.lit(3))).select("paper_id", "path", "county", "school_name", "size_kb")


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.classify(files(spark, sf_dir))


def with_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.classify_and_find(files(spark, sf_dir), catalog_queries.catalog(spark, sf_dir))


@query(WITH + "SELECT paper_id, rel_path, filename, county, school_name, school_year, school_term, exam_type, level, grade, grade_parse_pattern, subject, filetype, confidence, target_rel, target_filename, skip_reason, size_kb FROM classified")
def classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 to D6, P18."""
    return classified(spark, sf_dir)


@query(WITH + _CONFLICTS + "SELECT paper_id, target_rel, conflict_target FROM conflicts")
def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6."""
    return with_conflicts(spark, sf_dir).select("paper_id", "target_rel", "conflict_target")


@query(WITH + "SELECT confidence, count(*) AS n, round(count(*) * 100 / (SELECT count(*) FROM classified), 1) AS percent FROM classified GROUP BY confidence")
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5, W9."""
    return jobs.confidence_report(classified(spark, sf_dir))


@query(
    WITH
    + _CONFLICTS
    + """SELECT county, school_name, count(*) AS total, count(*) FILTER (confidence = 'HIGH') AS high, count(*) FILTER (confidence = 'MEDIUM') AS medium, count(*) FILTER (confidence = 'LOW') AS low,
round(count(*) FILTER (confidence = 'HIGH') * 100 / count(*), 1) AS high_percent, count(*) FILTER (conflict_target <> '') AS conflicts FROM conflicts GROUP BY county, school_name"""
)
def schools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6, A8."""
    return jobs.school_report(with_conflicts(spark, sf_dir))


@query(WITH + "SELECT * FROM (SELECT field, value, count(*) AS n, row_number() OVER (PARTITION BY field ORDER BY count(*) DESC, value) AS place FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS field, {c} AS value FROM classified" for c in ("subject", "grade", "grade_parse_pattern")) + ") WHERE value <> '' GROUP BY field, value) WHERE place <= 15")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen most frequent values."""
    return jobs.coverage_report(classified(spark, sf_dir))


@query(WITH + "SELECT count(*) AS total, count(*) FILTER (grade = '') AS no_grade, count(*) FILTER (confidence <> 'LOW' AND subject = '') AS no_subject, count(*) FILTER (starts_with(filename, '._')) AS system_files FROM classified")
def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps."""
    return jobs.gap_report(classified(spark, sf_dir))


#: Schools that the suppliers stand for.
CONFIG_SQL = f"""SELECT DISTINCT county, concat(county, '立', core, '國中') AS school_name FROM (
  SELECT {seed._pick("s_suppkey % 22", seed.COUNTIES)} AS county, {seed._pick("CAST(FLOOR(s_suppkey / 2.0) AS BIGINT) % 20", seed.CORES)} AS core FROM supplier) s"""


def configured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CONFIG_SQL.replace("FROM supplier", "FROM {supplier}"), supplier=spark.read.parquet(f"{sf_dir}/supplier.parquet"))


@query(
    WITH
    + f""", config AS ({CONFIG_SQL}), idx AS (SELECT county, school_name, count(*) AS n FROM classified GROUP BY 1, 2)
SELECT coalesce(c.county, i.county) AS county, coalesce(c.school_name, i.school_name) AS school_name, c.county IS NOT NULL AS configured, i.county IS NOT NULL AS indexed, coalesce(n, 0) AS n
FROM config c FULL JOIN idx i ON c.county = i.county AND c.school_name = i.school_name"""
)
def config_and_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8."""
    return jobs.config_and_index(configured(spark, sf_dir), classified(spark, sf_dir))


@query(
    WITH
    + f""", config AS ({CONFIG_SQL}), idx AS (SELECT DISTINCT county, school_name FROM classified)
SELECT 'config_minus_index' AS what, * FROM (SELECT * FROM config EXCEPT SELECT * FROM idx) UNION ALL SELECT 'index_minus_config', * FROM (SELECT * FROM idx EXCEPT SELECT * FROM config) UNION ALL SELECT 'both', * FROM (SELECT * FROM idx INTERSECT SELECT * FROM config)"""
)
def school_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schools configured, indexed or both, as sets."""
    return jobs.school_sets(configured(spark, sf_dir), files(spark, sf_dir))


_REASON = "CASE WHEN starts_with(filename, '._') THEN 'system_file' WHEN confidence = 'LOW' THEN 'low' WHEN school_name <> '桃園市桃園國中' THEN 'other_school' ELSE 'apply' END"


@query(WITH + f"SELECT {_REASON} AS reason, count(*) AS n FROM classified GROUP BY 1")
def apply_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would be applied for one school, with why the rest is left out."""
    return jobs.apply_reasons(classified(spark, sf_dir), include_medium=True, school="桃園市桃園國中").groupBy("reason").agg(F.count("*").alias("n"))


_TO = "CASE WHEN ascii(substr(paper_id, 16)) % 3 = 0 THEN coalesce(nullif(conflict_target, ''), target_rel) ELSE target_rel END"


@query(
    WITH
    + _CONFLICTS
    + f""", moved AS (SELECT paper_id, {_TO} AS target_rel, size_kb FROM conflicts WHERE confidence <> 'LOW')
SELECT m.paper_id, m.target_rel, CASE WHEN c.size_kb = m.size_kb THEN 'dedup' WHEN c.size_kb IS NOT NULL THEN 'size_mismatch' WHEN row_number() OVER (PARTITION BY m.target_rel ORDER BY m.paper_id) > 1 THEN 'collision' ELSE 'move' END AS action
FROM moved m LEFT JOIN catalog c ON c.rel_path = m.target_rel"""
)
def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the files aim at the archive's file that they conflict with."""
    rows = with_conflicts(spark, sf_dir).filter("confidence <> 'LOW'").withColumn("target_rel", F.expr(_TO))
    return jobs.plan_moves(rows, catalog_queries.catalog(spark, sf_dir))


def queries() -> dict[str, Query]:
    return {f"dump_{k}": v for k, v in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {f"dump_{k}": v for k, v in ORACLES.items()}
