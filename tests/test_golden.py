"""Golden strings of names, schools and dumps, odd rows of the jobs, and files read and written."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quirelake.functions import dump, links, names, paths, schools, texts
from quirelake.operators import catalog as jobs
from quirelake.operators import crawl, search
from quirelake.sources import files, store

C = F.col


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("name", "county", "want"),
    [
        ("高雄市_109_期中考_34585_高雄市立大樹國民中學_南一.pdf", "高雄市", ("109", None, "期中考", "34585", "高雄市立大樹國民中學", "南一", None, None)),
        ("臺東縣_108下學期_期末考_28550_臺東縣立新生國小_何嘉仁.pdf", "臺東縣", ("108", "下學期", "期末考", "28550", "臺東縣立新生國小", "何嘉仁", None, None)),
        ("高雄市_110_第2學期_補考_高雄市五福國中_一年級_公民.pdf", "高雄市", ("110", None, "補考", None, "高雄市五福國中", "未註明", "一年級", "公民")),
        ("高雄市_110_第2學期_補考_高雄市五福國中_一年級_公民_解答.docx", None, ("110", None, "補考", None, "高雄市五福國中", "未註明", "一年級", "公民")),
        ("苗栗縣_108_第1段考_縣立大同國中_七年級_公民.pdf", "苗栗縣", ("108", None, "第1段考", None, "縣立大同國中", "未註明", "七年級", "公民")),
        ("苗栗縣_108_期中考_1_大同國中_其他版.doc", "苗栗縣", ("108", None, "期中考", "1", "大同國中", "其他版", None, None)),
        ("苗栗縣_108_期中考_1_大同國中_很長的版本.doc", "苗栗縣", ("108", None, None, None, None, None, None, None)),
        ("楠梓國中1年級上-3段歷史.pdf", "高雄市", (None,) * 8),
        ("楠梓國中1年級地理上學期第二次段考  106年.pdf", "高雄市", ("106", *[None] * 7)),
        ("107-110上學期.pdf", "高雄市", ("110", *[None] * 7)),
        ("高市楠梓國中106下2年級數學科第二次段考試題.pdf", "高雄市", ("106", *[None] * 7)),
        ("", "高雄市", (None,) * 8),
    ],
)
def test_file_names(spark, name, county, want):
    assert tuple(one(spark, name, names.parse_file_name(C("x"), F.lit(county) if county else None))) == want


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("高雄市/國中/七年級/數學/paper/a.pdf", ("full", "高雄市", "國中", "七年級", "數學", "paper")),
        ("高雄市/國中/七年級/數學/a.pdf", ("legacy", "高雄市", "國中", "七年級", "數學", "paper")),
        ("高雄市/國中/七年級/數學/其他/a.pdf", ("legacy", "高雄市", "國中", "七年級", "數學", "paper")),
        ("高雄市/楠梓國中/a.pdf", ("school", "高雄市", "", "", "", "")),
        ("_未分類/DriveFolder/高雄市/楠梓國中/108下/a解答.pdf", ("dump", "高雄市", "", "", "", "daan")),
        ("_未分類/DriveFolder/高雄市/楠梓國中/108下/a.docx", None),
        ("高雄市/a.pdf", None),
        ("a.pdf", None),
    ],
)
def test_layouts(spark, path, want):
    got = one(spark, path, names.layout(C("x")))
    assert (tuple(got) if got else None) == want


def test_dump_paths(spark):
    path = "_未分類/DriveFolder/高雄市/楠梓國中/108下/x/a.pdf"
    assert one(spark, path, names.canonical_path(C("x"))) == "高雄市/楠梓國中/_drivefolder/108下/x/a.pdf"
    assert one(spark, path, names.canonical_path(C("x"), faithful=True)) == "高雄市/楠梓國中/_drivefolder/108下/x"
    assert one(spark, "高雄市/國中/a.pdf", names.canonical_path(C("x"))) == "高雄市/國中/a.pdf"


@pytest.mark.parametrize(
    ("query", "candidate", "fits"),
    [
        ("楠梓", "高雄市楠梓國中", True),
        ("高雄市楠梓國中", "高雄市立楠梓國中", True),
        ("高雄市立楠梓國中", "高雄市楠梓國中", True),
        ("高雄市楠梓國中", "楠梓國中", True),
        ("高雄市楠梓國中", "高雄市", False),
        ("", "高雄市楠梓國中", True),
        (None, "高雄市楠梓國中", True),
        ("楠梓", "", False),
        ("楠梓", None, False),
        ("建國", "高雄市立楠梓國中", False),
    ],
)
def test_school_matches(spark, query, candidate, fits):
    assert spark.createDataFrame([(query, candidate)], "q string, c string").select(schools.school_matches(C("q"), C("c"))).first()[0] is fits


@pytest.mark.parametrize(("name", "token"), [("高雄市楠梓國中", "楠梓"), ("高雄市立楠梓國中", "楠梓"), ("臺北市立建國高級中學", "建國"), ("高雄市立海青高職", "海青"), ("台東縣立新生國小", "新生"), ("臺北市私立大同高中", "私立大同"), ("高雄市", None), ("國中", None), (None, None)])
def test_core_tokens(spark, name, token):
    assert one(spark, name, schools.core_token(C("x"))) == token


@pytest.mark.parametrize(
    ("name", "county", "plain"), [("臺北市立仁愛國中", "臺北市", "仁愛國中"), ("臺北市仁愛國中", "臺北市", "仁愛國中"), ("彰化縣立溪湖高中", "彰化縣", "溪湖高中"), ("國立臺灣大學", "臺北市", "臺灣大學"), ("縣立大同國小", "苗栗縣", "大同國小"), ("高雄市", "高雄市", "高雄市"), ("市立x", "", "市立x"), (None, "高雄市", None)]
)
def test_archive_names(spark, name, county, plain):
    assert one(spark, name, schools.archive_name(C("x"), F.lit(county))) == plain


def test_years_and_placeholders(spark):
    for year, want in (("一一零", "110"), ("110", "110"), ("98", "98"), ("abc", "abc"), (None, ""), ("", "")):
        assert one(spark, year, schools.normalise_year(C("x"))) == want
    for year, want in (("12", "112"), ("98", "098"), ("107", "107")):
        assert one(spark, year, schools.full_year(C("x"))) == want
    for name, want in (("x_local_ab_cd_y", "x_y"), ("x_unknown_9", "x"), ("x_local_ab_cd_x", "x_x"), ("__a__b_", "a_b")):
        assert one(spark, name, schools.strip_placeholders(C("x"))) == want


@pytest.mark.parametrize(
    ("name", "year", "term", "exam"),
    [
        ("101下自然七年級第一次段考.pdf", "101", "下學期", "第一次段考"),
        ("崇林102下自然第一次段考.pdf", "102", "下學期", "第一次段考"),
        ("111上七年級英語.pdf", "111", "上學期", None),
        ("101-2-八年級第三次段考.pdf", "101", "下學期", "第三次段考"),
        ("101學年下學期七年級自然.pdf", "101", "下學期", None),
        ("98學年上學期七年級自然.pdf", None, "上學期", None),
        ("1082-2-7社會.pdf", "108", "下學期", "第二次段考"),
        ("1071-3七年級自然試卷.pdf", "107", "上學期", "第三次段考"),
        ("1071-1八年級英文試題.pdf", "107", "上學期", "第一次段考"),
    ],
)
def test_dump_names(spark, name, year, term, exam):
    where = F.lit("新北市"), F.lit("新北市崇林國中")
    assert one(spark, name, dump.dump_year(C("x"), *where)) == year
    assert one(spark, name, dump.dump_term(C("x"), *where)) == term
    assert one(spark, name, dump.dump_exam(C("x"))) == exam


def test_fixed_names(spark):
    got = one(spark, "高雄市_110上學期_未註明_數學_七年級_楠梓國中_南一_drivefolder.pdf", names.parse_fixed_name(C("x")))
    assert tuple(got) == ("110", "上學期", None, "數學", "七年級", "楠梓國中", "南一")
    got = one(spark, "高雄市_未註明_數學_七年級_楠梓國中_未註明_drivefolder.pdf", names.parse_fixed_name(C("x")))
    assert tuple(got) == (None, None, None, "數學", "七年級", "楠梓國中", None)
    assert one(spark, "高雄市_110_drivefolder.pdf", names.parse_fixed_name(C("x"))) is None
    assert one(spark, "高雄市_110_a_b_c_d.pdf", names.parse_fixed_name(C("x"))) is None


def test_levels_and_grades(spark):
    for grade, exam, level in (("一年級", "期中考", "國小"), ("一年級", "第二次段考", "國中"), ("十年級", "", "高中"), (None, "", "國中")):
        assert one(spark, grade, paths.level_of_exam(C("x"), F.lit(exam))) == level
    for grade, level, want in (("一年級", "國中", "七年級"), ("三年級", "高中", "十二年級"), ("二年級", "國小", "二年級"), ("九年級", "國中", "九年級")):
        assert one(spark, grade, paths.grade_for_level(C("x"), F.lit(level))) == want


@pytest.mark.parametrize(
    ("base", "href", "want"),
    [
        ("http://a.tw/x/y.html?q=1", "z.pdf", "http://a.tw/x/z.pdf"),
        ("http://a.tw/x/y.html", "../z", "http://a.tw/z"),
        ("http://a.tw/x/y/", "./z/../w", "http://a.tw/x/y/w"),
        ("http://a.tw/x/y", "/r", "http://a.tw/r"),
        ("http://a.tw/x/y", "//b.tw/r", "http://b.tw/r"),
        ("http://a.tw/x/y", "?p=2", "http://a.tw/x/y?p=2"),
        ("http://a.tw", "z", "http://a.tw/z"),
        ("http://a.tw/x", "https://b.tw/", "https://b.tw/"),
    ],
)
def test_absolute_urls(spark, base, href, want):
    assert one(spark, href, crawl.absolute_url(F.lit(base), C("x"))) == want


def test_anchors_of_odd_pages(spark):
    html = "<title>T &amp; U</title><!-- <a href='/no'>x</a> --><script>var a='<a href=\"/no\">y</a>'</script><a class=b HREF='/f.pdf'>檔 <b>案</b></a><a href='#x'>p</a><a href='mailto:a'>m</a><a>none</a><a href=\"/n\"></a>"
    rows = crawl.extract_links(spark.createDataFrame([(1, "http://a.tw/", html), (2, "http://a.tw/", ""), (3, "http://a.tw/", None)], "page_id long, url string, html string")).collect()
    assert [(r.page_id, r.url, r.label, r.page_title, r.is_file) for r in rows] == [(1, "http://a.tw/f.pdf", "檔 案", "T & U", True), (1, "http://a.tw/n", "", "T & U", False)]


def test_reachable_is_bounded(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 9)] + [(i, i + 100) for i in range(1, 9)] + [(1, 0)], "src long, dst long")
    got = {(r.start, r.page, r.depth) for r in crawl.reachable(spark.createDataFrame([(0,)], "page long"), edges, 2, 5).collect()}
    assert got == {(0, 0, 0), (0, 1, 1), (0, 2, 1), (0, 3, 1), (0, 4, 1)}


def test_messages(spark):
    assert one(spark, "你下載太頻繁,請等待 7 分鐘後再試。", texts.limit_minutes(C("x"))) == 7
    assert one(spark, "x" * 600 + "太多次", texts.limit_minutes(C("x"))) is None
    assert one(spark, None, texts.limit_minutes(C("x"))) is None
    assert one(spark, "", texts.cover_fields(C("x"))) is None
    assert one(spark, "http://a.tw/a b/ü?q=ü#f", links.encoded_path(C("x"))) == "http://a.tw/a%20b/%C3%BC?q=ü#f"


ITEMS = "paper_id string, rel_path string, filename string, county string, school_name string, school_year string, school_term string, exam_type string, grade string, subject string, version string, paper_or_daan string"


def items(spark, *rows):
    return spark.createDataFrame([(i, f"高雄市/{i}.pdf", f"{i}.pdf", "高雄市", "高雄市立楠梓國中", year, None, exam, None, None, None, kind) for i, year, exam, kind in rows], ITEMS)


def test_relaxed_search(spark):
    rows = items(spark, ("a", None, None, "paper"), ("b", None, None, "daan"))
    got = search.search_relaxed(rows, {"county": "高雄市", "grade": "一年級"}, "高雄市楠梓國中").collect()
    assert [(r.paper_id, r.paper_id_daan, r.fallback, r.total, r.dropped, r.pages) for r in got] == [("a", "b", True, 2, "grade", 1)]
    assert search.search_relaxed(rows, {"county": "高雄市", "grade": "一年級"}).collect() == []
    assert search.search_relaxed(rows.limit(0), {"grade": "一年級"}, "楠梓國中").collect() == []


def test_upsert_by_either_key(spark):
    old = spark.createDataFrame([("a", "p1", 1), ("b", "p2", 1), ("c", "p3", 1)], "paper_id string, rel_path string, n int")
    new = spark.createDataFrame([("a", "p9", 2), ("x", "p2", 2)], "paper_id string, rel_path string, n int")
    got = {tuple(r) for r in jobs.upsert(old, new, ["n"]).collect()}
    assert got == {("a", "p9", 2), ("x", "p2", 2), ("c", "p3", 1)}


def test_archive_files(spark, tmp_path):
    (tmp_path / "archive/高雄市/國中").mkdir(parents=True)
    (tmp_path / "archive/高雄市/國中/a.PDF").write_bytes(b"x" * 3000)
    (tmp_path / "archive/高雄市/國中/b.txt").write_bytes(b"x")
    assert [(r.rel_path, r.size_kb) for r in files.archive_files(spark, str(tmp_path / "archive")).collect()] == [("高雄市/國中/a.PDF", 2)]


def test_archive_files_below_a_folder_that_has_its_name(spark, tmp_path):
    root = tmp_path / "archive/a+b (c)/archive"
    for name in ("archive/x/archive/a.pdf", "C/b.doc"):
        (root / name).parent.mkdir(parents=True)
        (root / name).write_bytes(b"x")
    assert {r.rel_path for r in files.archive_files(spark, f"{root}/").collect()} == {"archive/x/archive/a.pdf", "C/b.doc"}


def test_items_of_json_documents(spark, tmp_path):
    (tmp_path / "index.json").write_text('{"built_at": "x", "items": [{"paper_id": "a", "n": 1}, {"paper_id": "b", "n": 2}]}')
    assert {(r.paper_id, r.n) for r in files.read_items(spark, str(tmp_path / "index.json")).collect()} == {("a", 1), ("b", 2)}
    assert files.read_items(spark, str(tmp_path / "index.json"), schema="paper_id: string, n: long").count() == 2


def test_catalogue_is_read_back(spark):
    rows = items(spark, ("a", "110", "期中考", "paper"), ("b", None, None, "daan"))
    back = store.write_catalog(rows, store.new_path(spark, "catalog"))
    assert sorted(back.collect()) == sorted(rows.collect()) and back.schema.simpleString() == rows.schema.simpleString()
