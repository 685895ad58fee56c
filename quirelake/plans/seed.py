"""The catalogue that the given tables stand for: every line item becomes an archive file.

The rules are plain SQL that Spark and DuckDB read alike; SEED_SQL is the one text both use. Attributes hang on the
order key, so the question and the answer sheet of an order share their group; ``k % 10``, and ``k % 40`` where that is
9, pick the form of the path: standard names (0 to 4), with a term (5), 第N學期 (6), without a file id (7), raw dump (8),
left out (9, 39), legacy folders (19), a school's folder with a free name (29).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.functions.names import GRADES, PUBLISHERS, computed
from quirelake.functions.schools import COUNTIES
from quirelake.sources import store

#: Bytes of the line items' files that go to one task: some 200,000 rows, of which it makes about 100 MB.
PART = 4 << 20
#: Bytes of a generated method that the JVM still compiles; Spark's own limit keeps longer ones, which are then interpreted.
COMPILED = 8000
#: Columns of a listing.
LISTED = ["k", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey", "rel_path", "size_kb", "mtime"]
#: Fixed values of the made-up catalogue.
CORES = ["楠梓", "建國", "大同", "中山", "仁愛", "三民", "崇林", "獅甲", "英明", "苓雅", "土城", "左營", "丹鳳", "新泰", "錦和", "永和", "福興", "溪湖", "埔心", "文昌"]
SUBJECTS = ["國文", "英語", "數學", "自然", "社會", "理化", "生物", "歷史", "地理", "公民", "健康", "體育", "音樂", "美術", "資訊"]
EXAMS = ["第一次段考", "第二次段考", "第三次段考", "期中考", "期末考", "模擬考"]


def _pick(key: str, values: list[str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_BASE = f"""
SELECT l_orderkey AS k, l_linenumber, l_extendedprice, l_partkey, l_suppkey, l_shipdate,
  {_pick("l_orderkey % 23", [*COUNTIES, "其他X"])} AS county,
  {_pick("CAST(FLOOR(l_orderkey / 3.0) AS BIGINT) % 12", GRADES)} AS grade,
  CASE WHEN CAST(FLOOR(l_orderkey / 3.0) AS BIGINT) % 12 < 6 THEN '國小' WHEN CAST(FLOOR(l_orderkey / 3.0) AS BIGINT) % 12 < 9 THEN '國中' ELSE '高中' END AS level,
  {_pick("CAST(FLOOR(l_orderkey / 23.0) AS BIGINT) % 20", CORES)} AS core,
  {_pick("CAST(FLOOR(l_orderkey / 5.0) AS BIGINT) % 15", SUBJECTS)} AS subject,
  {_pick("CAST(FLOOR(l_orderkey / 7.0) AS BIGINT) % 6", EXAMS)} AS exam_type,
  CASE l_orderkey % 2 WHEN 0 THEN '上學期' ELSE '下學期' END AS term,
  CAST(100 + CAST(FLOOR(l_orderkey / 11.0) AS BIGINT) % 16 AS VARCHAR(3)) AS school_year,
  {_pick("CAST(FLOOR(l_orderkey / 13.0) AS BIGINT) % 7", PUBLISHERS)} AS version,
  CASE WHEN l_linenumber % 2 = 1 THEN 'paper' ELSE 'daan' END AS filetype
FROM lineitem
"""

_NAMED = f"SELECT *, concat(county, '立', core, level) AS school FROM ({_BASE}) base"

_FOLDERS = "concat(county, '/', level, '/', grade, '/', subject, '/', filetype, '/')"
_DAAN = "CASE filetype WHEN 'daan' THEN '_解答' ELSE '' END"
_PLAIN = "concat(county, '_', school_year, '_', exam_type, '_', CAST(k AS VARCHAR(20)), '_', school, '_', version)"
#: Every line item with its attributes and the path it stands for.
ATTRIBUTES_SQL = f"""
SELECT *,
  CASE
    WHEN k % 10 < 5 THEN concat({_FOLDERS}, {_PLAIN}, '.pdf')
    WHEN k % 10 = 5 THEN concat({_FOLDERS}, county, '_', school_year, term, '_', exam_type, '_', CAST(k AS VARCHAR(20)), '_', school, '_', version, '.pdf')
    WHEN k % 10 = 6 THEN concat({_FOLDERS}, county, '_', school_year, '_第', CASE k % 2 WHEN 0 THEN '1' ELSE '2' END, '學期_', exam_type, '_', school, '_', grade, '_', subject, {_DAAN}, '.pdf')
    WHEN k % 10 = 7 THEN concat({_FOLDERS}, county, '_', school_year, '_', exam_type, '_', school, '_', grade, '_', subject, {_DAAN}, '.pdf')
    WHEN k % 10 = 8 THEN concat('_未分類/DriveFolder/', county, '/', school, '/', school_year, '學年', term, '/', dump_name)
    WHEN k % 40 = 9 THEN concat('其他X/', level, '/', grade, '/', subject, '/', filetype, '/', {_PLAIN}, '.pdf')
    WHEN k % 40 = 19 THEN concat(county, '/', level, '/', grade, '/', subject, '/', {_PLAIN}, CASE filetype WHEN 'daan' THEN '.docx' ELSE '.pdf' END)
    WHEN k % 40 = 29 THEN concat(county, '/', school, '/', school_year, '學年度', grade, subject, exam_type, {_DAAN}, '.doc')
    ELSE concat('_未分類/待整理/', school, '/', dump_name)
  END AS rel_path,
  CAST(FLOOR(l_extendedprice) AS BIGINT) AS size_kb, CAST(l_shipdate AS DATE) AS mtime
FROM (SELECT *, concat(school_year, CASE k % 2 WHEN 0 THEN '上' ELSE '下' END, grade, subject, exam_type, CASE filetype WHEN 'paper' THEN '考題' ELSE '解答' END, '.pdf') AS dump_name FROM ({_NAMED}) named) files
"""


def whole(sql: str) -> str:
    """A seed's SQL with a rounded down quotient by whole numbers, which are exact too, in place of one by decimals."""
    return re.sub(r"CAST\(FLOOR\((\w+) / (\d+)\.0\) AS BIGINT\)", r"(\1 DIV \2 - CASE WHEN \1 % \2 < 0 THEN 1 ELSE 0 END)", sql)


def read_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey", "l_shipdate")


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line items, those of an order together: their paths and names, many times as long, then meet where they are made.
    The number of parts follows the table's size, so that what a task makes of its part stays in memory at any size. The
    rules' long cases are one method each where a whole stage is one; past ``COMPILED`` bytes expressions get methods of their own."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", COMPILED)
    items = read_items(spark, sf_dir)
    return items.repartition(parts(items), "l_orderkey")


def parts(items: DataFrame) -> int:
    """How many tasks line items are dealt to, and the catalogue that is made of them."""
    return max(items.sparkSession.sparkContext.defaultParallelism, -(-store.n_bytes(items) // PART))


def one_each(items: DataFrame, *told: Column) -> DataFrame:
    """One line item of each order, or of each order and value of ``told``: the least of each column. Numbers are compared
    where the order's items lie, before any text is made of them."""
    keys = [c.alias(f"_{i}") for i, c in enumerate(told)]
    return items.groupBy("l_orderkey", *keys).agg(*[F.min(c).alias(c) for c in items.columns if c != "l_orderkey"]).select(*items.columns)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line item of each order."""
    return one_each(line_items(spark, sf_dir))


def sheet() -> Column:
    """Whether a line item is of its order's question sheet; all others are of the answer sheet."""
    return F.coalesce(F.col("l_linenumber") % 2 == 1, F.lit(False))


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line item of each order's question sheet and of its answer sheet."""
    return one_each(line_items(spark, sf_dir), sheet())


def attributes_of(items: DataFrame, *more: str) -> DataFrame:
    """Line items with their attributes and paths, the path made once, and with ``more`` columns of their own."""
    sql = ATTRIBUTES_SQL.replace("FROM lineitem", "FROM {lineitem}").replace("l_shipdate,", ", ".join(["l_shipdate", *more, ""]).rstrip())
    rows = items.sparkSession.sql(whole(sql), lineitem=items)
    return computed(rows.withColumnRenamed("rel_path", "_path"), rel_path=F.col("_path")).drop("_path")


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes_of(line_items(spark, sf_dir))


def newest_listing(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """The listing of those line items that ``where`` holds for, without those that a newer one of the same order and sheet,
    and so of the same path, replaces: they are told apart by numbers, before paths are made."""
    items = line_items(spark, sf_dir).filter(where)
    order = [F.col("l_shipdate").cast("date").alias("l_shipdate"), "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey"]
    newest = items.groupBy("l_orderkey", sheet().alias("_sheet")).agg(F.max(F.struct(*order)).alias("x")).select("l_orderkey", "x.*")
    return attributes_of(newest.select(*items.columns)).select(*LISTED)


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive listing that the line items stand for: path, size, time, and the columns that break ties."""
    return attributes(spark, sf_dir).select(*LISTED)
