"""Registered queries over covers, links, names of national exams and messages, with DuckDB SQL that knows the fields by
the way the texts are made."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.functions import exams, links, names, schools, texts
from quirelake.operators import crawl
from quirelake.plans import seed
from quirelake.plans.registry import Registry

_registry = Registry("txt")
query, queries, oracle_sql = _registry.query, _registry.queries, _registry.oracle_sql


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str, table: str, rows: DataFrame | None = None) -> DataFrame:
    """Rows of a seed's SQL over one of the given tables. ``rows``: the table's rows that the SQL's DISTINCT tells apart, one
    of each, so that no texts need be compared."""
    if rows is not None:
        sql = sql.replace("SELECT DISTINCT", "SELECT")
    else:
        rows = seed.line_items(spark, sf_dir) if table == "lineitem" else read(spark, sf_dir, table)
    return spark.sql(seed.whole(sql).replace(f"FROM {table}", "FROM {" + table + "}"), **{table: rows})


# covers

_COVER = f"""SELECT DISTINCT k, county, school, core, level, grade, subject, exam_type, term, school_year AS y, k % 6 AS form,
  concat(school, school_year, '學年度第', CASE k % 2 WHEN 0 THEN '1' ELSE '2' END, '學期', exam_type, '試題', chr(10), grade, subject, '科') AS plain
FROM ({seed._NAMED}) named WHERE county <> '其他X'"""
COVER_SQL = f"""SELECT *, CASE form WHEN 0 THEN plain WHEN 1 THEN {{vertical}}
  WHEN 2 THEN concat(school, ' 99學年 (', left(term, 1), ')不分科系 ', grade, subject, ' 解答卷') WHEN 3 THEN concat('高一各班 公民 社會 ', y, '學年度 下學期 第2次定期評量')
  WHEN 4 THEN '' ELSE concat('台北市立', core, '國中', y, '學年度') END AS text FROM ({_COVER}) c"""
_FOUND_GRADE = "CASE grade WHEN '十一年級' THEN '一年級' WHEN '十二年級' THEN '二年級' ELSE grade END"
_LEVEL = f"CASE WHEN level <> '高中' THEN level WHEN {_FOUND_GRADE} = '十年級' THEN '高中' ELSE '國小' END"


def covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's cover, with the county it is of."""
    rows = derived(spark, sf_dir, COVER_SQL.format(vertical="regexp_replace(plain, '([^\\n])', '$1\\n')"), "lineitem", seed.orders(spark, sf_dir))
    return names.computed(rows.withColumnRenamed("text", "_text"), text=F.col("_text")).select("k", "county", "text")


_COVERS = "WITH covers AS (" + COVER_SQL.format(vertical="regexp_replace(plain, '([^\\n])', '\\1' || chr(10), 'g')") + ")"


@query(
    _COVERS
    + f""" SELECT k, CASE WHEN form IN (0, 1, 2) THEN county WHEN form = 5 THEN '臺北市' END AS county, CASE WHEN form IN (0, 1, 2) THEN school WHEN form = 5 THEN concat('台北市立', core, '國中') END AS school_name,
  CASE WHEN form IN (0, 1, 3, 5) THEN y WHEN form = 2 THEN '099' END AS school_year, CASE WHEN form IN (0, 1, 2) THEN term WHEN form = 3 THEN '下學期' END AS school_term,
  CASE WHEN form IN (0, 1) THEN exam_type WHEN form = 3 THEN '第2次定期考' END AS exam_type, CASE WHEN form = 2 THEN 'daan' WHEN form <> 4 THEN 'paper' END AS filetype,
  CASE WHEN form IN (0, 1, 2) THEN {_FOUND_GRADE} WHEN form = 3 THEN '十年級' END AS grade, CASE WHEN form IN (0, 1, 2) THEN {_LEVEL} WHEN form = 3 THEN '高中' WHEN form = 5 THEN '國中' END AS level,
  CASE WHEN form IN (0, 2) THEN subject WHEN form = 3 THEN '公民' END AS subject FROM covers"""
)
def cover_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2."""
    return names.computed(covers(spark, sf_dir), of=texts.cover_fields(F.col("text"))).select("k", "of.*")


_T_COUNTY = "CASE WHEN form = 5 OR county = '新北市' THEN '臺北市' ELSE county END"


@query(
    _COVERS
    + f""" SELECT k, CASE WHEN form IN (3, 4) THEN '其他縣市' ELSE {_T_COUNTY} END AS county, CASE WHEN form IN (3, 4) THEN '未註明' WHEN form = 5 THEN concat('臺北市立', core, '國中') ELSE concat({_T_COUNTY}, '立', core, level) END AS school_name,
  CASE WHEN form IN (3, 4) THEN '未註明' WHEN form = 5 THEN concat('立', core, '國中') ELSE concat('立', core, level) END AS school_short, CASE WHEN form = 4 THEN NULL ELSE string_split(text, chr(10))[1] END AS title FROM covers"""
)
def title_schools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1; 北市 is looked for before 新北市."""
    return names.computed(covers(spark, sf_dir), of=texts.title_school(F.col("text"))).select("k", "of.*")


@query(
    _COVERS
    + """ SELECT k, CASE WHEN form IN (0, 2) THEN 'text' WHEN form IN (1, 3) THEN 'scanned' ELSE 'none' END AS taken, length(text) >= 50 AND form IN (0, 1, 2, 3) AND (form <> 1) AS usable
FROM covers WHERE form <> 5 AND county <> '新北市'"""
)
def accepted_schools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text decides where it knows a county, else the scanned text, which here is that of forms with one; covers
    that are long enough and have the words."""
    rows = covers(spark, sf_dir).filter("k % 6 <> 5 and county <> '新北市'")
    text = F.when(F.col("k") % 6 == 1, "無縣市").otherwise(F.col("text"))
    scanned = F.when(F.col("k") % 6 == 4, "").otherwise(F.lit("高雄市立楠梓國中"))
    made = names.computed(rows, of=texts.accepted_school(text, scanned), usable=texts.usable_cover(F.col("text")))
    taken = F.when(F.startswith("of.title", F.lit("[OCR] ")), "scanned").when(F.col("of.county") == "其他縣市", "none").otherwise("text")
    return made.select("k", taken.alias("taken"), "usable")


# messages and home pages

_MESSAGE = "CASE event_id % 5 WHEN 0 THEN concat('你下載太頻繁,請等待 ', event_id % 90, ' 分鐘後再試。') WHEN 1 THEN '今天下載太多次了,請明天再試。' WHEN 2 THEN '訪問過於頻繁' WHEN 3 THEN concat('%PDF ', event_id) ELSE concat('太多次', repeat('x', 600)) END"


@query("SELECT event_id, CAST(CASE event_id % 5 WHEN 0 THEN event_id % 90 WHEN 1 THEN 1440 WHEN 2 THEN 25 END AS INT) AS minutes, CASE WHEN event_id % 5 = 3 THEN 20000 + event_id END AS papers, CASE WHEN event_id % 40 < 30 AND event_id % 3 = 0 THEN '剛剛更新' WHEN event_id % 3 = 1 THEN concat(event_id % 59 + 1, ' 分鐘前') WHEN event_id % 3 = 2 THEN concat(event_id % 23 + 1, ' 小時前') ELSE concat(event_id % 40 - 29, ' 天前') END AS age FROM events")
def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T7, T8, ST8: minutes that messages ask to wait, totals of home pages, ages in words."""
    rows = read(spark, sf_dir, "events").select("event_id", F.expr(_MESSAGE).alias("message"))
    page = F.when(F.col("event_id") % 5 == 3, F.concat(F.lit("<h1>首頁 -<span>"), F.col("event_id") + 20000, F.lit("</span>\n份中小學試卷</h1>"))).otherwise("<h1>無</h1>")
    i = F.col("event_id")
    age = F.when((i % 3 == 0) & (i % 40 < 30), i % 40).when(i % 3 == 1, (i % 59 + 1) * 60 + i % 60).when(i % 3 == 2, (i % 23 + 1) * 3600 + i % 3600).otherwise((i % 40 - 29) * 86400)
    return rows.select("event_id", texts.limit_minutes(F.col("message")).alias("minutes"), texts.homepage_total(page).cast("long").alias("papers"), texts.freshness(age).alias("age"))


@query(
    f"""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'PDF' WHEN 1 THEN 'DOC' WHEN 2 THEN 'DOCX' WHEN 3 THEN 'EMPTY' ELSE 'OTHER' END AS kind, event_id % 5 IN (0) AS good_pdf, event_id % 5 = 2 AS good_zip, event_id % 5 <> 3 AS good_other,
  substr(sha256(concat(event_type, '|', user_id % 9, '|||')), 1, 64) AS cache_key, substr(sha256(concat('salt:10.0.0.', user_id)), 1, 32) AS ip_hash, substr(sha256(CAST(event_id AS VARCHAR)), 1, 12) AS content_id FROM events"""
)
def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of files by their first bytes, valid downloads, cache keys, pseudonyms, ids of contents."""
    c = F.col
    head = F.when(c("event_id") % 5 == 0, F.unhex(F.lit("255044462D312E34"))).when(c("event_id") % 5 == 1, F.unhex(F.lit("D0CF11E0A1B11AE1"))).when(c("event_id") % 5 == 2, F.unhex(F.lit("504B030414000600"))).when(c("event_id") % 5 == 3, F.unhex(F.lit(""))).otherwise(F.unhex(F.lit("3C68746D6C3E")))
    rows = read(spark, sf_dir, "events").withColumn("content", head)
    good = lambda kind: texts.valid_download(c("content"), F.lit(kind))
    key = texts.cache_key(c("event_type"), (c("user_id") % 9).cast("string"), F.lit(None).cast("string"), F.lit(""), F.lit(""))
    return rows.select("event_id", texts.file_kind(c("content")).alias("kind"), good(".pdf").alias("good_pdf"), good(".zip").alias("good_zip"), good(".doc").alias("good_other"), key.alias("cache_key"), texts.address_pseudonym(F.concat(F.lit("10.0.0."), c("user_id")), "salt").alias("ip_hash"), names.content_id(c("event_id").cast("string").cast("binary")).alias("content_id"))


# pages

_LINK = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a\s*>"""
_LINKS_SQL = f"""WITH body AS (SELECT page_id, url AS base, regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<script.*?</script\\s*>', '', 'gsi'), '<style.*?</style\\s*>', '', 'gsi') AS body FROM pages),
found AS (SELECT page_id, base, unnest(regexp_extract_all(body, '{_LINK.replace("'", "''")}', 1)) AS href, unnest(regexp_extract_all(body, '{_LINK.replace("'", "''")}', 2)) AS label, unnest(range(len(regexp_extract_all(body, '{_LINK.replace("'", "''")}', 1)))) AS place FROM body),
links AS (SELECT page_id, CAST(place AS INT) AS place, concat(regexp_extract(base, '^([a-z]+://[^/?#]*)', 1), href) AS url, trim(label) AS label FROM found WHERE href <> '' AND NOT starts_with(href, '#'))"""


@query(_LINKS_SQL + " SELECT page_id, place, url, label, false AS is_file FROM links")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1, X2, IO9: anchors of all pages; all of them lead from the root of their site."""
    return crawl.extract_links(read(spark, sf_dir, "pages")).select("page_id", "place", "url", "label", "is_file")


@query(_LINKS_SQL + " SELECT url AS target, min(page_id) AS page_id, count(*) AS n FROM links GROUP BY url")
def first_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links without repeats, by their first page, and how often each is found."""
    rows = crawl.extract_links(read(spark, sf_dir, "pages"))
    counted = rows.groupBy(F.regexp_extract("url", "^([^#]*)", 1).alias("target")).agg(F.count("*").alias("n"))
    return crawl.first_links(rows).join(counted, "target").select("target", "page_id", "n")


_EDGES = "SELECT page_id AS src, (page_id * 7 + 1) % n AS dst FROM pages, (SELECT count(*) AS n FROM pages) UNION ALL SELECT page_id, (page_id * 13 + 5) % n FROM pages, (SELECT count(*) AS n FROM pages)"


@query(
    f"""WITH RECURSIVE edges AS ({_EDGES}), starts AS (SELECT page_id AS page FROM pages WHERE page_id % 10 = 0),
walk AS (SELECT page AS start, page, 0 AS depth FROM starts UNION SELECT w.start, e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.page WHERE w.depth < 5)
SELECT start, page, CAST(min(depth) AS INT) AS depth FROM walk GROUP BY start, page"""
)
def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five steps reach at most 63 pages, so the cap of 64 takes none away."""
    pages = read(spark, sf_dir, "pages").select("page_id")
    n = pages.agg(F.count("*").alias("n"))
    numbered = pages.join(F.broadcast(n))
    edge = lambda a, b: numbered.select(F.col("page_id").alias("src"), ((F.col("page_id") * a + b) % F.col("n")).alias("dst"))
    return crawl.reachable(pages.filter("page_id % 10 = 0").select(F.col("page_id").alias("page")), edge(7, 1).unionByName(edge(13, 5)), 5, 64)


_FILE = f"""SELECT DISTINCT k, k % 7 AS form, school, grade, subject, filetype, y,
  CASE k % 7 WHEN 0 THEN concat('http://s.edu.tw/dl/', k, '.PDF?x=1') WHEN 1 THEN concat('http://s.edu.tw/get.php?f=a', k, '.docx&v=2') WHEN 2 THEN concat('http://s.edu.tw/view/', k) WHEN 3 THEN concat('http://s.edu.tw/f/%E6%AE%B5%E8%80%83', k, '.zip')
    WHEN 4 THEN concat('http://s.edu.tw/doc/', k, '.doc') WHEN 5 THEN concat('http://s.edu.tw/p/', k, '.php') ELSE concat('http://s.edu.tw/上傳/', k, '.pdf') END AS url,
  CASE k % 7 WHEN 0 THEN concat(y, '學年度第1學期', grade, subject, '補考題庫') WHEN 1 THEN '下載' WHEN 2 THEN concat('學校行事曆', k, '.xls') WHEN 3 THEN 'x' WHEN 4 THEN concat('配置圖 ', k) WHEN 5 THEN '考古題' ELSE concat(y, '上學期') END AS label
FROM (SELECT k, school, CASE WHEN k % 3 = 0 THEN '七年級' ELSE '八年級' END AS grade, subject, filetype, school_year AS y FROM ({seed._NAMED}) named) n"""


@query(
    f"""WITH f AS ({_FILE})
SELECT DISTINCT k, url, CASE form WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 3 THEN '.zip' WHEN 4 THEN '.doc' WHEN 6 THEN '.pdf' ELSE '' END AS extension,
  CASE form WHEN 0 THEN concat(label, '.pdf') WHEN 1 THEN 'get.php.docx' WHEN 2 THEN label WHEN 3 THEN concat('段考', k, '.zip') WHEN 4 THEN concat(label, '.doc') WHEN 5 THEN concat(k, '.php') ELSE concat(label, '.pdf') END AS filename,
  form IN (0, 1, 3, 5, 6) AS is_exam, CASE WHEN form = 0 THEN CAST(y AS INT) END AS year, CASE WHEN form = 0 THEN subject END AS subject, CASE WHEN form = 0 THEN '補考' END AS exam_type,
  CASE form WHEN 3 THEN concat('http://s.edu.tw/f/%25E6%25AE%25B5%25E8%2580%2583', k, '.zip') WHEN 6 THEN concat('http://s.edu.tw/%E4%B8%8A%E5%82%B3/', k, '.pdf') ELSE url END AS encoded FROM f"""
)
def link_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds and names of linked files, whether they are exams, their fields, encoded urls."""
    c = F.col
    rows = derived(spark, sf_dir, _FILE, "lineitem").select("k", "url", "label").distinct()
    named = names.computed(rows, filename=links.choose_file_name(c("url"), c("label")), extension=links.file_extension(c("url")))
    judged = names.computed(named, of=links.link_fields(c("filename"), c("label"), F.lit("")), is_exam=links.is_exam_file(c("filename"), c("label"), F.lit("")))
    return judged.select("k", "url", "extension", "filename", "is_exam", "of.year", "of.subject", "of.exam_type", links.encoded_path(c("url")).alias("encoded"))


# national exams

_EXAM = f"""SELECT p_partkey AS k, p_partkey % 13 AS form, CAST(90 + p_partkey % 26 AS VARCHAR(3)) AS y, {seed._pick("p_partkey % 5", ["國文", "英語", "數學", "社會", "自然"])} AS cap, {seed._pick("p_partkey % 6", ["國文", "數甲", "物理", "公民與社會", "國綜", "歷史"])} AS ceec,
  {seed._pick("p_partkey % 4", ["國語文綜合能力測驗", "數學甲", "公民", "數學b"])} AS long_, {seed._pick("p_partkey % 4", ["國綜", "數甲", "公民與社會", "數b"])} AS of_long FROM part"""
EXAM_SQL = f"""SELECT *, CASE form WHEN 0 THEN concat(y, '_', cap, '_', cap, '科_1ZfjE4.pdf') WHEN 1 THEN concat(y, '_', cap, '_1ZfjE4xy.pdf') WHEN 2 THEN concat(y, '_參考答案_1b3Vusr5.pdf') WHEN 3 THEN concat(y, '_其他_一級分_1amvNV.pdf') WHEN 4 THEN concat('x_', cap, '.pdf')
  WHEN 5 THEN concat('01-', y, '學測', ceec, '試卷定稿.pdf') WHEN 6 THEN concat('01-', y, '分科測驗', long_, '選擇題答案.pdf') WHEN 7 THEN concat(y, 'sat_語音_國文_圖文(序號).pdf') WHEN 8 THEN concat(y, '指考試題音軌對照表_', ceec, '.pdf')
  WHEN 9 THEN concat(y, 'sat_音軌對照表_國_圖文.pdf') WHEN 10 THEN concat(y, '指考', ceec, '定稿.pdf') WHEN 11 THEN concat(y, 'sat_數學_文字.pdf') ELSE concat('說明', y, '.pdf') END AS name FROM ({_EXAM}) e"""


@query(
    f"""WITH e AS ({EXAM_SQL}) SELECT k, name, CASE WHEN form IN (0, 1) THEN cap ELSE '' END AS cap_subject, CASE form WHEN 0 THEN concat(cap, '科') WHEN 2 THEN '參考答案' WHEN 3 THEN '其他' ELSE '' END AS cap_type,
  CASE WHEN form IN (5, 8, 10) THEN ceec WHEN form = 6 THEN of_long WHEN form IN (7, 9) THEN '國文' WHEN form = 11 THEN '數學' END AS ceec_subject,
  CASE form WHEN 5 THEN '試卷定稿' WHEN 6 THEN '選擇題答案' WHEN 7 THEN '語音_圖文(序號)' WHEN 8 THEN '試題音軌對照表' WHEN 9 THEN '音軌對照表_圖文' WHEN 10 THEN '定稿' WHEN 11 THEN '文字' END AS ceec_type FROM e WHERE form < 12"""
)
def exam_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of junior exams (forms 0 to 4) and of senior exams (5 to 11)."""
    rows = derived(spark, sf_dir, EXAM_SQL, "part").filter("form < 12").select("k", "form", "name")
    made = names.computed(rows, cap=exams.cap_name(F.col("name")), ceec=exams.ceec_name(F.col("name")))
    senior = lambda c: F.when(F.col("form") >= 5, F.col(c))
    return made.select("k", "name", F.col("cap.subject").alias("cap_subject"), F.col("cap.file_type").alias("cap_type"), senior("ceec.subject").alias("ceec_subject"), senior("ceec.file_type").alias("ceec_type"))


_GSAT = """SELECT p_partkey AS k, p_partkey % 7 AS form, 81 + p_partkey % 40 AS y, CASE p_partkey % 7 WHEN 0 THEN concat('01-', 81 + p_partkey % 40, '學測國綜試題卷.pdf') WHEN 1 THEN concat(81 + p_partkey % 19, 'bio答案.pdf') WHEN 2 THEN concat('01-', 81 + p_partkey % 40, '英文答題卷.pdf')
  WHEN 3 THEN concat('10_', 100 + p_partkey % 20, ' 數A 評分原則.pdf') WHEN 4 THEN concat(81 + p_partkey % 18, '0702%E6%95%B8B.pdf') WHEN 5 THEN '說明.pdf' ELSE concat(81 + p_partkey % 40, 'SAT社會.pdf') END AS name FROM part"""


@query(
    f"""WITH g AS ({_GSAT}) SELECT k, CAST(CASE form WHEN 1 THEN 81 + k % 19 WHEN 3 THEN 100 + k % 20 WHEN 4 THEN 81 + k % 18 WHEN 5 THEN 0 ELSE y END AS INT) AS year, CASE form WHEN 0 THEN '國綜' WHEN 2 THEN '英文' WHEN 3 THEN '數A' WHEN 4 THEN '數B' WHEN 6 THEN '社會' ELSE '' END AS subject,
  CASE form WHEN 0 THEN '試題' WHEN 1 THEN '答案' WHEN 2 THEN '答題卷' WHEN 3 THEN '評分原則' ELSE '' END AS file_type FROM g"""
)
def gsat_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in listings of senior exams, two listings in one."""
    rows = derived(spark, sf_dir, _GSAT, "part").select("k", "name")
    both = rows.filter("k % 2 = 0").unionByName(rows.filter("k % 2 = 1"))
    return names.computed(both, of=exams.gsat_name(F.col("name"))).select("k", "of.*")


_CAP = f"""SELECT k, y, cap, CASE k % 4 WHEN 0 THEN concat(cap, '科試題本') WHEN 1 THEN cap WHEN 2 THEN '寫作測驗級分樣卷' ELSE '各題通過率:統計/表' END AS title, concat('1a_B-c', k, 'xyz') AS file_id FROM ({_EXAM}) e"""


@query(
    f"""WITH c AS ({_CAP}), s AS (SELECT *, CASE k % 4 WHEN 0 THEN cap WHEN 1 THEN cap WHEN 2 THEN '寫作測驗' ELSE '其他' END AS subject FROM c)
SELECT k, file_id, subject, concat(CASE WHEN k % 5 = 0 THEN '基測' ELSE '會考' END, '/', y, '年/', y, '_', subject, CASE WHEN title <> subject THEN concat('_', replace(replace(title, ':', '_'), '/', '_'), '_', substr(file_id, 1, 6)) ELSE concat('_', substr(file_id, 1, 8)) END, '.pdf') AS destination,
  CAST(CASE WHEN subject <> '其他' THEN 1 ELSE 3 END AS INT) AS priority FROM s"""
)
def cap_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed files of junior exams, where they go and how soon."""
    c = F.col
    rows = derived(spark, sf_dir, _CAP, "part").withColumn("url", F.concat(F.lit("https://drive.google.com/file/d/"), c("file_id"), F.lit("/view"))).drop("file_id")
    made = names.computed(rows, of=exams.cap_listing(c("url"), c("title"))).select("k", "y", "title", "of.*")
    exam = F.when(c("k") % 5 == 0, "基測").otherwise("會考")
    return made.select("k", "file_id", "subject", exams.cap_destination(exam, c("y").cast("int"), c("subject"), c("title"), c("file_id")).alias("destination"), exams.cap_priority(c("subject"), c("title")).alias("priority"))


@query(
    f"""WITH e AS ({EXAM_SQL}), c AS (SELECT k, name, CAST(y AS INT) AS year, cap AS subject, CASE form WHEN 0 THEN concat(cap, '科') ELSE '' END AS file_type FROM e WHERE form IN (0, 1)), f AS (SELECT * FROM c WHERE year >= 95)
SELECT k, year, subject, file_type, (SELECT count(*) FROM f) AS total, CAST(greatest(ceil((SELECT count(*) FROM f) / 20.0), 1) AS BIGINT) AS pages FROM f ORDER BY year DESC, subject = '', subject, file_type = '', file_type, name, k LIMIT 20"""
)
def browse_exams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a page of junior exams, latest first, blank subjects and kinds last."""
    rows = derived(spark, sf_dir, EXAM_SQL, "part").filter("form in (0, 1)").select("k", "name", F.col("y").cast("int").alias("year"))
    items = names.computed(rows, of=exams.cap_name(F.col("name"))).select("k", "name", "year", "of.subject", "of.file_type").filter("year >= 95")
    total = items.agg(F.count("*").alias("total"))
    order = [F.desc("year"), F.expr("subject = ''"), F.asc("subject"), F.expr("file_type = ''"), F.asc("file_type"), F.asc("name"), F.asc("k")]
    return items.orderBy(*order).limit(20).join(F.broadcast(total)).select("k", "year", "subject", "file_type", "total", F.greatest(F.ceil(F.col("total") / 20), F.lit(1)).alias("pages"))


@query(f"WITH e AS ({EXAM_SQL}) SELECT CAST(y AS INT) AS year, CASE WHEN form < 5 THEN '會考' ELSE '學測' END AS exam, count(*) AS n FROM e GROUP BY 1, 2")
def exams_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14."""
    rows = derived(spark, sf_dir, EXAM_SQL, "part")
    return rows.groupBy(F.col("y").cast("int").alias("year"), F.when(F.col("form") < 5, "會考").otherwise("學測").alias("exam")).agg(F.count("*").alias("n"))


#: Some schools of the table that tells their counties.
BANK_SCHOOLS = {"市立建國高級中學": "臺北市", "市立三民國中": "高雄市", "縣立溪湖國中": "彰化縣"}
_BANK = f"""SELECT *, concat('https://bank.example.org/paper/', y, '-', title, '-0a1b2c3d') AS url FROM (SELECT p_partkey AS k, p_partkey % 9 AS form, CAST(105 + p_partkey % 9 AS VARCHAR(3)) AS y,
  CASE p_partkey % 9 WHEN 0 THEN concat(105 + p_partkey % 9, '年市立建國高級中學高一數學第2次段考') WHEN 1 THEN concat(105 + p_partkey % 9, '年市立三民國中七年級英語第1次段考') WHEN 2 THEN concat(105 + p_partkey % 9, '年國中數學會考') WHEN 3 THEN concat(105 + p_partkey % 9, '年不詳國中八年級國文第3次段考')
  WHEN 4 THEN '無法解析' WHEN 5 THEN concat(105 + p_partkey % 9, '年學測高三國文第1次') WHEN 6 THEN concat(105 + p_partkey % 9, '年高雄市七年級數學第1次段考') WHEN 7 THEN concat(105 + p_partkey % 9, '年桃園市立武陵高中高二物理第2次段考') ELSE concat(105 + p_partkey % 9, '年縣立不明國中九年級社會第2次段考') END AS title FROM part) b"""


@query(
    f"""WITH b AS ({_BANK}) SELECT k, CASE form WHEN 0 THEN '市立建國高級中學' WHEN 1 THEN '市立三民國中' WHEN 2 THEN '(模擬考)' WHEN 3 THEN '不詳國中' WHEN 5 THEN '學測' WHEN 6 THEN '高雄市' WHEN 7 THEN '桃園市立武陵高中' WHEN 8 THEN '縣立不明國中' END AS school,
  CASE form WHEN 0 THEN '高一年級' WHEN 1 THEN '七年級' WHEN 2 THEN '九年級' WHEN 3 THEN '八年級' WHEN 5 THEN '高三年級' WHEN 6 THEN '七年級' WHEN 7 THEN '高二年級' WHEN 8 THEN '九年級' END AS grade,
  CASE form WHEN 0 THEN '數學' WHEN 1 THEN '英語' WHEN 2 THEN '國中數學' WHEN 3 THEN '國文' WHEN 5 THEN '國文' WHEN 6 THEN '數學' WHEN 7 THEN '物理' WHEN 8 THEN '社會' END AS subject,
  CASE form WHEN 0 THEN '臺北市' WHEN 1 THEN '高雄市' WHEN 6 THEN '高雄市' WHEN 7 THEN '桃園市' WHEN 8 THEN '未分類' END AS county,
  CASE WHEN k % 2 = 0 AND form = 0 THEN 'done' ELSE CASE form WHEN 2 THEN 'mock_exam' WHEN 3 THEN 'no_county' WHEN 4 THEN 'parse_fail' WHEN 5 THEN 'national_exam_skip' ELSE 'ready' END END AS status FROM b"""
)
def bank_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P31, P32, G4, X13, IO8: papers that a sitemap lists, their counties and what becomes of them."""
    c = F.col
    rows = derived(spark, sf_dir, _BANK, "part").select("k", "form", "url", "title")
    listed = crawl.sitemap_urls(rows.select(F.concat(F.lit("<url><loc>"), "url", F.lit("</loc></url>")).alias("text")))
    rows = rows.join(listed, "url")
    made = names.computed(rows, of=exams.bank_url(c("url")))
    made = names.computed(made, county=exams.guessed_county(c("of.school"), BANK_SCHOOLS))
    return made.select("k", "of.school", "of.grade", "of.subject", "county", exams.bank_status((c("k") % 2 == 0) & (c("form") == 0), c("of"), c("title"), c("county")).alias("status"))


# bulletins and directories

_BULLETIN = "SELECT doc_id, concat('週報📊 第一類🔶 甲', doc_id, '摘要：', repeat('長', CAST(190 + doc_id % 30 AS INT)), '連結：http://a/', doc_id, ' 來源：報社標籤：x🔶 無連結摘要：y📈 第二類🔶 乙', doc_id, '標籤：z摘要：短連結：http://b/', doc_id, '影響等級：高') AS text FROM documents"


@query(
    """SELECT doc_id, 1 AS entry, '📊 第一類' AS category, concat('甲', doc_id) AS title, substr(repeat('長', CAST(190 + doc_id % 30 AS INT)), 1, 200) AS summary, concat('http://a/', doc_id) AS url, '報社' AS source FROM documents
UNION ALL SELECT doc_id, 3, '📈 第二類', concat('乙', doc_id), '短', concat('http://b/', doc_id), '' FROM documents"""
)
def bulletins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T6, W8."""
    return crawl.bulletin_entries(derived(spark, sf_dir, _BULLETIN, "documents"))


_DIRECTORY = "SELECT s_suppkey AS page_id, concat('<details><summary>國中段考</summary><ul><li><a href=\"http://a', s_suppkey, '.edu.tw\">高雄市立<b>A', s_suppkey, '</b></a></li><li class=\"noanswer\"><a href=\"https://drive.google.com/x\">武陵B</a></li><li><a href=\"http://c\">會考歷屆</a></li></ul></details><details><summary>其他</summary><ul><li><a href=\"http://d\">D</a></li></ul></details>') AS html FROM supplier"


@query(
    """SELECT s_suppkey AS page_id, 'junior' AS category, concat('高雄市立A', s_suppkey) AS name, concat('http://a', s_suppkey, '.edu.tw') AS url, true AS has_answer, 'school_web' AS link_type, '高雄市' AS county FROM supplier
UNION ALL SELECT s_suppkey, 'junior', '武陵B', 'https://drive.google.com/x', false, 'drive', '桃園市' FROM supplier"""
)
def directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X12, G3, IO7."""
    return crawl.school_list(derived(spark, sf_dir, _DIRECTORY, "supplier")).withColumn("county", schools.county_by_short_name(F.col("name")))


_WORDS = "[" + ", ".join("['" + c + "', '" + "', '".join(w) + "']" for c, w in schools.county_words().items()) + "]"


@query(f"SELECT asked, count(*) AS n FROM (SELECT DISTINCT school, county FROM ({seed._NAMED}) named) s, (SELECT unnest({_WORDS}) AS words), LATERAL (SELECT words[1] AS asked) WHERE len(list_filter(words, lambda w: contains(school, w))) > 0 GROUP BY asked")
def schools_in_county(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schools of each county by the words of their names."""
    rows = seed.attributes(spark, sf_dir).select("school").distinct()
    asked = rows.select("school", F.explode(F.array(*map(F.lit, schools.COUNTIES))).alias("asked"))
    return asked.filter(schools.in_county(F.col("school"), F.col("asked"))).groupBy("asked").agg(F.count("*").alias("n"))
