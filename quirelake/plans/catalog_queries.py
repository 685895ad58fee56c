"""Registered queries of the catalogue jobs over the given tables, each with DuckDB SQL written apart from the jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.functions import names, schools
from quirelake.operators import catalog as jobs
from quirelake.operators import facet_cube, name_index, school_merge
from quirelake.plans import seed
from quirelake.sources import store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Where the catalogue of a source was written, by the source's fingerprint, and the rows as they are read.
_WRITTEN: dict[tuple[str, str], tuple[str, DataFrame]] = {}


def catalog(spark: SparkSession, sf_dir: str, anew: bool = False) -> DataFrame:
    """The catalogue of the listing, built and written once and read by every search, as an index is. It is built again
    where the source's files have changed or the written table is gone."""
    source = spark.read.schema("l_orderkey long").parquet(f"{sf_dir}/lineitem.parquet")  # its files matter here, not its columns
    at = (spark.sparkContext.applicationId, store.fingerprint(source))
    known = _WRITTEN.get(at)
    if anew or known is None or not store.is_there(spark, known[0]):
        path = store.new_path(spark, "catalog")
        _WRITTEN[at] = (path, store.write_catalog(jobs.build_catalog(seed.newest_listing(spark, sf_dir), parts=seed.parts(seed.read_items(spark, sf_dir))), path))
    return _WRITTEN[at][1]


#: The catalogue in DuckDB's SQL, by what the forms of the seed's paths mean; no name is parsed. ``lost``: the 第N學期 form
#: knows nine grades only, so a senior school's name goes by the fallback rules.
ROWS_SQL = f"""
WITH named AS ({seed.ATTRIBUTES_SQL}),
formed AS (
  SELECT *, CASE WHEN k % 10 < 6 OR k % 40 = 19 THEN 'standard' WHEN k % 10 = 6 AND level = '高中' THEN 'lost' WHEN k % 10 < 8 THEN 'plain' WHEN k % 10 = 8 THEN 'dump' ELSE 'free' END AS form,
    CASE WHEN k % 10 = 8 THEN 'dump' WHEN k % 40 = 19 THEN 'legacy' WHEN k % 40 = 29 THEN 'school' ELSE 'full' END AS layout
  FROM named WHERE k % 40 NOT IN (9, 39) AND (county <> '其他X' OR k % 10 = 8)
),
placed AS (
  SELECT *, CASE layout WHEN 'dump' THEN concat(county, '/', school, '/_drivefolder/', school_year, '學年', term, '/', dump_name) ELSE rel_path END AS path,
    layout IN ('full', 'legacy') AS sorted
  FROM formed
),
rows_ AS (
  SELECT k, l_linenumber, l_extendedprice, l_partkey, l_suppkey, substr(sha1(lower(path)), 1, 16) AS paper_id, path AS rel_path, string_split(path, '/')[-1] AS filename, layout, county,
    CASE WHEN sorted THEN level ELSE '' END AS level, CASE WHEN sorted THEN grade END AS grade, CASE WHEN sorted THEN subject END AS subject, school_year,
    CASE WHEN k % 10 = 5 THEN term END AS school_term, CASE WHEN form IN ('standard', 'plain') THEN exam_type END AS exam_type,
    CASE WHEN form = 'standard' THEN CAST(k AS VARCHAR) END AS fileid,
    CASE form WHEN 'lost' THEN regexp_extract(string_split(path, '/')[-1], '^(.*高中)_', 1) ELSE school END AS school_name,
    CASE form WHEN 'standard' THEN version WHEN 'plain' THEN '未註明' END AS version,
    CASE layout WHEN 'legacy' THEN 'paper' WHEN 'school' THEN '' ELSE filetype END AS paper_or_daan, size_kb, mtime
  FROM placed
),
"""
_NEWEST = "mtime DESC NULLS LAST, l_linenumber DESC, l_extendedprice DESC, l_partkey DESC, l_suppkey DESC"
CATALOG_SQL = ROWS_SQL + f"""catalog AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY {_NEWEST}) AS rn FROM rows_) WHERE rn = 1
)
"""
_KEYS = "school_name, school_year, school_term, exam_type, grade, subject, version, county"


@query(CATALOG_SQL + "SELECT paper_id, rel_path, county, level, grade, subject, school_year, school_term, exam_type, fileid, school_name, version, paper_or_daan, size_kb, mtime FROM catalog")
def catalog_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1, P3 to P8, P11, IO3, W2: listing to catalogue, built and written anew."""
    return catalog(spark, sf_dir, anew=True).select("paper_id", "rel_path", "county", "level", "grade", "subject", "school_year", "school_term", "exam_type", "fileid", "school_name", "version", "paper_or_daan", "size_kb", "mtime")


@query(
    CATALOG_SQL
    + """SELECT paper_id, array_to_string(list_filter([nullif(school_name, ''), school_year || '學年度', school_term, exam_type, grade, subject, '(' || nullif(version, '未註明') || ')'], lambda x: x IS NOT NULL), ' ') AS title,
  CAST(paper_or_daan = 'paper' AS INT) AS is_paper, CAST(school_name IS NOT NULL AS INT) AS has_school, CAST(coalesce(length(school_name), 0) > 4 AS INT) AS has_school_name FROM catalog"""
)
def catalog_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display titles and flags."""
    return catalog(spark, sf_dir).select("paper_id", "title", "is_paper", "has_school", "has_school_name")


SEARCH = {"county": "高雄市", "level": "國中"}


@query(CATALOG_SQL + "SELECT paper_id, title_school AS school_name, school_year, exam_type, grade, subject FROM (SELECT *, school_name AS title_school FROM catalog) WHERE county = '高雄市' AND level = '國中' AND contains(school_name, '楠梓') ORDER BY county, school_year DESC NULLS LAST, exam_type NULLS FIRST, grade NULLS FIRST, subject NULLS FIRST, paper_id LIMIT 20")
def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters and school tokens, one page."""
    rows = catalog(spark, sf_dir).filter(jobs.matches(SEARCH, "高雄市立楠梓國中"))
    return jobs.page(rows, 1, 20).select("paper_id", "school_name", "school_year", "exam_type", "grade", "subject")


_PAIRS = f"""SELECT {_KEYS}, max(CASE WHEN paper_or_daan = 'paper' THEN paper_id END) AS paper_file, max(CASE WHEN paper_or_daan = 'daan' THEN paper_id END) AS daan_file, count(*) AS n_files,
  concat_ws(',', CASE WHEN bool_or(paper_or_daan = 'paper') THEN 'paper' END, CASE WHEN bool_or(paper_or_daan = 'daan') THEN 'daan' END) AS filetype_set,
  CASE WHEN bool_or(paper_or_daan = 'daan') THEN '有' ELSE '無' END AS has_daan FROM catalog"""


@query(CATALOG_SQL + _PAIRS + f" GROUP BY {_KEYS}")
def pair_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question and answer sheets of the whole catalogue, paired."""
    return jobs.pair_groups(catalog(spark, sf_dir))


@query(CATALOG_SQL + _PAIRS + f" WHERE county = '高雄市' AND level = '國中' AND contains(school_name, '楠梓') GROUP BY {_KEYS}")
def search_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: search by county and school token, paired."""
    return jobs.pair_groups(catalog(spark, sf_dir).filter(jobs.matches(SEARCH, "高雄市立楠梓國中")))


@query(CATALOG_SQL + "SELECT field, value, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS field, {c} AS value FROM catalog" for c in jobs.FACETS) + ") WHERE value IS NOT NULL AND value <> '' GROUP BY field, value")
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facet values with counts."""
    return jobs.facets(catalog(spark, sf_dir))


@query(CATALOG_SQL + "SELECT county, school_name, count(*) AS n FROM catalog WHERE school_name <> '' AND school_name <> county GROUP BY ALL")
def school_dropdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9."""
    return jobs.school_dropdown(catalog(spark, sf_dir))


@query(CATALOG_SQL + "SELECT CAST(school_year AS INT) AS school_year, row_number() OVER (ORDER BY CAST(school_year AS INT) DESC) AS place FROM (SELECT DISTINCT school_year FROM catalog WHERE layout <> 'dump' AND school_year <> '')")
def years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """years of the main archive, latest first."""
    return jobs.archive_years(catalog(spark, sf_dir))


_COUNTY_SQL = "CASE " + " ".join(f"WHEN starts_with(school_name, '{c}') THEN '{c}'" for c in schools.COUNTIES) + " ELSE '其他縣市' END"


@query(CATALOG_SQL + f"SELECT of_county, school_name, count(*) AS calls, count(DISTINCT paper_id) AS distinct_files, grouping(of_county, school_name) AS depth FROM (SELECT *, {_COUNTY_SQL} AS of_county FROM catalog) GROUP BY ROLLUP (of_county, school_name)")
def school_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, G1: statistics with county and grand totals."""
    return jobs.school_stats(catalog(spark, sf_dir))


@query(CATALOG_SQL + "SELECT count(*) AS files, count(*) FILTER (level = '國小') AS elementary, count(*) FILTER (level = '國中') AS junior, count(*) FILTER (level = '高中') AS senior, count(*) FILTER (layout = 'dump') AS dump, count(*) FILTER (paper_or_daan = 'daan') AS answers, count(DISTINCT school_name) AS schools, CAST(sum(size_kb) AS BIGINT) AS size_kb FROM catalog")
def archive_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A3."""
    return jobs.archive_counts(catalog(spark, sf_dir))


#: Files told of twice: first, of every third order, under a placeholder that its school's county does not appear in, then in
#: full. The placeholder's files go to the name of the first of the later calls.
_CALLS = f"""SELECT l_linenumber * 2 + k * 20 + CASE WHEN told = 2 THEN 1000000000 ELSE 0 END AS seq, k AS fileid, filetype, CASE WHEN told = 1 AND k % 3 = 0 THEN concat(core, level, ' (from filename)') WHEN k % 17 = 0 THEN '' ELSE school END AS school_name, concat(grade, CASE WHEN told = 2 THEN '!' ELSE '' END) AS grade
FROM ({seed._NAMED}) named, (SELECT 1 AS told UNION ALL SELECT 2) t"""
_MERGED = f"""WITH calls AS ({_CALLS}),
told AS (SELECT seq, concat(fileid, '_', filetype) AS file, grade, CASE WHEN school_name = '' THEN '未註明' ELSE school_name END AS name, school_name <> '' AS named FROM calls),
placed AS (SELECT DISTINCT file, name FROM told WHERE suffix(name, '(from filename)')),
changes AS (SELECT p.name, arg_min({{'to': t.name, 'grade': t.grade}}, t.seq) AS c, min(t.seq) AS moved_at FROM placed p JOIN told t ON t.file = p.file AND t.named AND t.seq >= 1000000000 GROUP BY p.name),
whole AS (SELECT name, file, seq, grade, NULL AS moved_at, NULL AS given FROM told WHERE NOT suffix(name, '(from filename)') UNION ALL SELECT c['to'], file, NULL, NULL, moved_at, c['grade'] FROM placed JOIN changes USING (name)
  UNION ALL SELECT name, file, seq, grade, NULL, NULL FROM told WHERE suffix(name, '(from filename)') AND name NOT IN (SELECT name FROM changes))
SELECT school_name AS school, {_COUNTY_SQL} AS county, short_name, coalesce(given, first_grade) AS grade, total_files
FROM (SELECT name AS school_name, CASE WHEN ({_COUNTY_SQL.replace("school_name", "name")}) = '其他縣市' THEN name ELSE substr(name, 4) END AS short_name, count(DISTINCT file) AS total_files, arg_min(grade, seq) AS first_grade, arg_max(given, moved_at) AS given FROM whole GROUP BY name)"""


@query(_MERGED)
def merged_schools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: schools with distinct files and grade, placeholders given up for full names."""
    calls = spark.sql(seed.whole(_CALLS).replace("FROM lineitem", "FROM {lineitem}"), lineitem=seed.line_items(spark, sf_dir))
    return school_merge.merged_schools(calls)


@query(f"SELECT county, school, count(*) AS calls FROM (SELECT school_name AS school, {_COUNTY_SQL} AS county FROM (SELECT CASE WHEN school_name = '' THEN '未註明' ELSE school_name END AS school_name FROM ({_CALLS}) c) n) x GROUP BY ROLLUP (county, school)")
def school_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: calls by county and school, by county and in all."""
    calls = spark.sql(seed.whole(_CALLS).replace("FROM lineitem", "FROM {lineitem}"), lineitem=seed.line_items(spark, sf_dir))
    return school_merge.counted_calls(calls)


#: National exams' files: in their folders, generic, and of other kinds.
_NATIONAL = "SELECT CASE p_partkey % 5 WHEN 0 THEN concat('cap_exam/', 100 + p_partkey % 16, '/', p_partkey, '.pdf') WHEN 1 THEN concat('ceec/gsat/', p_partkey, '.pdf') WHEN 2 THEN concat('ceec/_generic/', p_partkey % 7, '/', p_partkey, '.pdf') WHEN 3 THEN concat('cap_exam/110/', p_partkey, '.zip') ELSE concat('ceec/', p_partkey, '.PDF') END AS rel_path FROM part"
_STATUS = ", ".join(f"count(*) FILTER (level = '{v}' AND pdf) AS {k}_count, count(*) FILTER (level = '{v}' AND pdf AND paper_or_daan = 'paper') AS {k}_papers" for k, v in (("primary", "國小"), ("junior", "國中"), ("senior", "高中")))


@query(
    CATALOG_SQL
    + f"""SELECT cap_count, ceec_count, count(*) FILTER (pdf) + cap_count + ceec_count AS pdf_count, {_STATUS}
FROM (SELECT *, suffix(filename, '.pdf') AS pdf FROM catalog), (SELECT count(*) FILTER (p_partkey % 5 = 0) AS cap_count, count(*) FILTER (p_partkey % 5 = 1) AS ceec_count FROM part) GROUP BY cap_count, ceec_count"""
)
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: files by level and sheet, national exams apart."""
    national = spark.sql(_NATIONAL.replace("FROM part", "FROM {part}"), part=spark.read.parquet(f"{sf_dir}/part.parquet"))
    return jobs.status_counts(catalog(spark, sf_dir), national)


_LONG = " UNION ALL ".join(f"SELECT county, school_name, '{c}' AS field, {c} AS value FROM catalog WHERE {c} <> ''" for c in jobs.FACETS)


@query(CATALOG_SQL + f"SELECT county, school_name, field, array_to_string(CASE field WHEN 'school_year' THEN list_reverse_sort(list(DISTINCT value)) ELSE list_sort(list(DISTINCT value)) END, '|') AS listed FROM ({_LONG}) GROUP BY county, school_name, field")
def school_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: the six lists of every school, from the cube's cells."""
    lists = facet_cube.school_lists(facet_cube.facet_cells(catalog(spark, sf_dir)))
    return lists.select("county", "school_name", "field", F.array_join("values", "|").alias("listed"))


@query(CATALOG_SQL + f"SELECT field, value, count(*) AS n, CAST(row_number() OVER (PARTITION BY field ORDER BY CASE WHEN field = 'school_year' THEN value END DESC, value) AS INT) AS place FROM ({_LONG}) WHERE county = '高雄市' AND contains(school_name, '楠梓') GROUP BY field, value")
def cascading_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: the lists of a county's schools that hold a token; the cube is made of half the rows and brought up to date by
    rows that come and rows that go, names come from the index."""
    rows = catalog(spark, sf_dir)
    cells = facet_cube.facet_cells(rows.filter("k % 3 <> 0"))
    cells = facet_cube.changed_cells(cells, rows.filter("k % 3 = 0").unionByName(rows.filter("k % 3 = 1")), rows.filter("k % 3 = 1"))
    return facet_cube.cascade(cells, "高雄市", indexed(spark, sf_dir).names("楠梓"))


_INDEXED: dict[str, name_index.NameIndex] = {}


def indexed(spark: SparkSession, sf_dir: str) -> name_index.NameIndex:
    """The catalogue by names, written once for each written catalogue."""
    rows = catalog(spark, sf_dir)
    at = next(path for path, known in _WRITTEN.values() if known is rows)
    if at not in _INDEXED or not store.is_there(spark, f"{_INDEXED[at].root}/pairs"):
        _INDEXED[at] = name_index.NameIndex(spark, store.new_path(spark, "names")).write(rows)
    return _INDEXED[at]


_TOKENS = ["楠梓", "中山國中", "大同"]


@query(CATALOG_SQL + " UNION ALL ".join(f"SELECT '{t}' AS token, paper_id, school_name FROM catalog WHERE level = '國中' AND contains(school_name, '{t.removesuffix('國中')}')" for t in _TOKENS))
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """filters and tokens through the index of names; the rows are those of a scan."""
    found = [indexed(spark, sf_dir).search({"level": "國中"}, t).select(F.lit(t).alias("token"), "paper_id", "school_name") for t in _TOKENS]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(f"SELECT concat(county, '/', school, '/_drivefolder/', school_year, '學年', term) AS path, count(*) AS n FROM ({seed.ATTRIBUTES_SQL}) named WHERE k % 10 = 8 GROUP BY 1")
def folder_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: raw dumps' paths without the files' names, and how many files share one."""
    rows = seed.listing(spark, sf_dir).filter("k % 10 = 8")
    return rows.groupBy(names.canonical_path(F.col("rel_path"), faithful=True).alias("path")).agg(F.count("*").alias("n"))


@query(CATALOG_SQL + "SELECT * FROM (SELECT field, value, count(*) AS n, row_number() OVER (PARTITION BY field ORDER BY count(*) DESC, value) AS place FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS field, {c} AS value FROM catalog" for c in ("county", "school_name", "subject")) + ") WHERE value <> '' GROUP BY field, value) WHERE place <= CASE field WHEN 'subject' THEN 15 ELSE 20 END")
def archive_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: the twenty largest counties and schools, the fifteen largest subjects."""
    return jobs.archive_top(catalog(spark, sf_dir), {"county": 20, "school_name": 20, "subject": 15})


_DENSE = ["county", "level", "grade", "subject", "school_year", "school_term", "exam_type", "school_name", "version"]


@query(CATALOG_SQL + " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER (coalesce({c}, '') <> '') AS filled, count(*) AS total FROM catalog" for c in _DENSE))
def metadata_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9."""
    return jobs.metadata_density(catalog(spark, sf_dir))


@query(CATALOG_SQL + "SELECT paper_id, paper_or_daan, rel_path, mtime FROM catalog ORDER BY mtime DESC NULLS LAST, paper_id LIMIT 15")
def latest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen latest files."""
    return catalog(spark, sf_dir).orderBy(F.desc_nulls_last("mtime"), "paper_id").limit(15).select("paper_id", "paper_or_daan", "rel_path", "mtime")


@query(CATALOG_SQL + f"SELECT paper_id, paper_or_daan, CASE paper_or_daan WHEN 'paper' THEN min(CASE WHEN paper_or_daan = 'daan' THEN paper_id END) OVER w ELSE min(CASE WHEN paper_or_daan = 'paper' THEN paper_id END) OVER w END AS companion_id FROM catalog WINDOW w AS (PARTITION BY {_KEYS})")
def companions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other sheet by null-safe keys."""
    return jobs.companion(catalog(spark, sf_dir))


@query(CATALOG_SQL + "SELECT DISTINCT fileid, county FROM catalog a WHERE fileid IS NOT NULL AND paper_or_daan = 'paper' AND NOT EXISTS (SELECT 1 FROM catalog b WHERE b.fileid = a.fileid AND b.county = a.county AND b.paper_or_daan = 'daan')")
def missing_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5."""
    return jobs.missing_answers(catalog(spark, sf_dir))


_OLD, _NEW = "(l_linenumber <= 4)", "(l_linenumber >= 3)"
#: A batch's rows in turn: condition on the order, first letter of the id (none: as it is), folder before the path. Ids and
#: paths change hands up to four times, so rows are replaced by rows that are replaced themselves.
_TURNS = [("true", "", ""), ("k % 5 = 0", "m", ""), ("k % 5 = 0", "m", "moved/"), ("k % 15 = 0", "", "moved/"), ("k % 15 = 5", "x", "")]


def _newest_sql(where: str) -> str:
    return f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY {_NEWEST}) AS rn FROM rows_ WHERE {where}) WHERE rn = 1"


@query(
    ROWS_SQL
    + f"""old AS ({_newest_sql(_OLD)}), new AS ({_newest_sql(_NEW)}),
turns AS (SELECT paper_id, rel_path, size_kb, mtime, 'old' AS came_from, 0 AS turn FROM old UNION ALL """
    + " UNION ALL ".join(f"SELECT {f"'{letter}' || substr(paper_id, 2)" if letter else 'paper_id'}, '{folder}' || rel_path, size_kb, mtime, 'new', {n + 1} FROM new WHERE {when}" for n, (when, letter, folder) in enumerate(_TURNS))
    + """)
SELECT paper_id, rel_path, size_kb, mtime, came_from, turn FROM turns
QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY turn DESC) = 1 AND row_number() OVER (PARTITION BY rel_path ORDER BY turn DESC) = 1"""
)
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: a batch of later line items over a catalogue of earlier ones; a batch row replaces what has its id or its
    path, old rows and rows of the same batch that came before it."""
    parts = seed.parts(seed.read_items(spark, sf_dir))
    # built once and written, as both keys' maxima read them; the result has these columns and what orders them
    needed = ["paper_id", "rel_path", "size_kb", *jobs.NEWEST, "k"]
    old, new = (store.kept(jobs.placed(seed.newest_listing(spark, sf_dir, f"l_linenumber {some}"), parts=parts).select(needed), "upsert") for some in ("<= 4", ">= 3"))
    turns = [
        F.when(F.expr(when), F.struct((F.concat(F.lit(letter), F.substring("paper_id", 2, 15)) if letter else F.col("paper_id")).alias("paper_id"), F.concat(F.lit(folder), "rel_path").alias("rel_path"), F.lit(n + 1).alias("turn")))
        for n, (when, letter, folder) in enumerate(_TURNS)
    ]
    batch = new.withColumn("x", F.explode(F.array_compact(F.array(*turns)))).select("x.*", *[c for c in new.columns if c not in ("paper_id", "rel_path")], F.lit("new").alias("came_from"))
    done = jobs.upsert(old.withColumns({"came_from": F.lit("old"), "turn": F.lit(0)}), batch, ["turn", *jobs.NEWEST])
    return done.select("paper_id", "rel_path", "size_kb", "mtime", "came_from", "turn")


def _updates(rows: DataFrame) -> DataFrame:
    """Text-pass results: every ninth order has another county, every eleventh has blanks."""
    return rows.filter("k % 9 = 0 or k % 11 = 0").select("paper_id", F.when(F.col("k") % 9 == 0, "新北市").otherwise("").alias("county"), F.lit("上學期").alias("school_term"), F.when(F.col("k") % 11 == 0, "").otherwise("113").alias("school_year"))


_UPD = "SELECT paper_id, CASE WHEN k % 9 = 0 THEN '新北市' ELSE '' END AS ucounty, '上學期' AS uterm, CASE WHEN k % 11 = 0 THEN '' ELSE '113' END AS uyear FROM catalog WHERE k % 9 = 0 OR k % 11 = 0"
_FIELDS = ["county", "school_term", "school_year"]


@query(CATALOG_SQL + f"SELECT paper_id, coalesce(nullif(county, ''), ucounty) AS county, coalesce(nullif(school_term, ''), uterm) AS school_term, coalesce(nullif(school_year, ''), uyear) AS school_year FROM catalog LEFT JOIN ({_UPD}) u USING (paper_id)")
def fill_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3."""
    rows = catalog(spark, sf_dir)
    return jobs.fill_empty(rows, _updates(rows), _FIELDS).select("paper_id", *_FIELDS)


@query(CATALOG_SQL + f"SELECT paper_id, coalesce(nullif(ucounty, ''), county) AS county, coalesce(nullif(uterm, ''), school_term) AS school_term, coalesce(nullif(uyear, ''), school_year) AS school_year FROM catalog LEFT JOIN ({_UPD}) u USING (paper_id)")
def prefer_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4."""
    rows = catalog(spark, sf_dir)
    return jobs.prefer_new(rows, _updates(rows), _FIELDS).select("paper_id", *_FIELDS)


@query(CATALOG_SQL + f"SELECT paper_id, field, old, new FROM (SELECT paper_id, unnest([{{'field': 'county', 'old': county, 'new': ucounty}}, {{'field': 'school_term', 'old': school_term, 'new': uterm}}, {{'field': 'school_year', 'old': school_year, 'new': uyear}}], recursive := true) FROM catalog JOIN ({_UPD}) u USING (paper_id)) WHERE old <> '' AND new <> '' AND old <> new")
def field_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5, IO5, IO6: text pass against catalogue."""
    rows = catalog(spark, sf_dir)
    return jobs.field_diffs(_updates(rows), rows, _FIELDS)


@query(CATALOG_SQL + "SELECT paper_id FROM catalog WHERE k NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def unprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows without a row in the status table, which the finished orders stand for."""
    status = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"))
    return catalog(spark, sf_dir).join(status, "k", "left_anti").select("paper_id")


_TOKEN = "CASE WHEN length(core) >= 2 THEN core END"


@query(CATALOG_SQL + f"SELECT school_name, county, level, {_TOKEN} AS token FROM (SELECT DISTINCT school_name, county, level, regexp_replace(regexp_replace(substr(school_name, 4), '^立', ''), '(國小|國中|高中)$', '') AS core FROM catalog WHERE school_name <> '' AND county <> '其他X')")
def school_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search tokens of all schools."""
    rows = catalog(spark, sf_dir).filter("school_name <> '' and county <> '其他X'").select("school_name", "county", "level").distinct()
    return rows.withColumn("token", schools.core_token(F.col("school_name")))


@query(CATALOG_SQL + "SELECT grade, " + "CASE " + " ".join(f"WHEN grade = '{g}' THEN '{seed_level}'" for g, seed_level in zip(names.GRADES, ["國小"] * 6 + ["國中"] * 3 + ["高中"] * 3, strict=True)) + " END AS level, count(*) AS n FROM catalog GROUP BY 1, 2")
def levels_of_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level by grade."""
    return catalog(spark, sf_dir).groupBy("grade").agg(F.count("*").alias("n")).select("grade", names.level_of(F.col("grade")).alias("level"), "n")


def queries() -> dict[str, Query]:
    return {f"cat_{k}": v for k, v in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {f"cat_{k}": v for k, v in ORACLES.items()}
