"""Jobs of the catalogue against replays of the rules they stand for."""

from __future__ import annotations

import random
import shutil

from pyspark.sql import functions as F

from quirelake.operators import catalog as jobs
from quirelake.operators import school_merge
from quirelake.operators.catalog import FACETS
from quirelake.operators.facet_cube import cascade, changed_cells, facet_cells
from quirelake.operators.name_index import NameIndex
from quirelake.plans import catalog_queries


def replayed(old, batch):
    """Rows (id, path, n) put in one after another; each takes the place of all that share its id or its path."""
    live = list(old)
    for row in sorted(batch, key=lambda r: r[2]):
        live = [r for r in live if r[0] != row[0] and r[1] != row[1]] + [row]
    return set(live)


def test_upsert_equals_a_replay_of_a_thousand_batches(spark):
    rng, olds, news, want = random.Random(11), [], [], set()
    for trial in range(1000):
        size = rng.randrange(1, 6)
        ids, paths = rng.sample(range(8), size), rng.sample(range(8), size)
        old = [(f"{trial}-p{i}", f"{trial}-r{p}", -n) for n, (i, p) in enumerate(zip(ids, paths, strict=True))]
        batch = [(f"{trial}-p{rng.randrange(8)}", f"{trial}-r{rng.randrange(8)}", n) for n in range(rng.randrange(12))]
        olds, news, want = olds + old, news + batch, want | replayed(old, batch)
    schema = "paper_id string, rel_path string, n int"
    got = jobs.upsert(spark.createDataFrame(olds, schema), spark.createDataFrame(news, schema), ["n"])
    assert got.count() == len(want)
    assert {tuple(r) for r in got.collect()} == want


def test_upsert_of_nothing_and_of_repeats(spark):
    schema = "paper_id string, rel_path string, n int"
    old, none = spark.createDataFrame([("p1", "r1", 1)], schema), spark.createDataFrame([], schema)
    assert {tuple(r) for r in jobs.upsert(old, none, ["n"]).collect()} == {("p1", "r1", 1)}
    twice = spark.createDataFrame([("p2", "r1", None), ("p2", "r1", None)], schema)
    assert [tuple(r) for r in jobs.upsert(old, twice, ["n"]).collect()] == [("p2", "r1", None)]


ROWS = "paper_id string, county string, school_name string, level string, school_year string, grade string, subject string, exam_type string, school_term string, version string, paper_or_daan string"


def rows_of(spark, n, rng, hot=0.0):
    schools = ["高雄市立楠梓國中", "高雄市立楠梓國小", "臺南市立中山國中", "Ab國中", "aB國小", "市", None]
    pick = lambda values: rng.choice(values)
    rows = []
    for i in range(n):
        if rng.random() < hot:
            rows.append((f"p{i}", "高雄市", None, None, None, None, None, None, None, None, pick(["paper", "daan"])))
        else:
            rows.append((f"p{i}", pick(["高雄市", "臺南市", None]), pick(schools), pick(["國中", "國小"]), pick(["109", "110", "", None]), pick(["七年級", None]), pick(["國文", "數學", ""]), pick(["期中考", None]), pick(["上學期", None]), pick(["南一", None]), pick(["paper", "daan", None])))
    return spark.createDataFrame(rows, ROWS), rows


def test_companions_of_null_and_hot_keys(spark):
    df, rows = rows_of(spark, 4000, random.Random(3), hot=0.4)
    at = {c.split()[0]: i for i, c in enumerate(ROWS.split(", "))}
    groups = {}
    for r in rows:
        groups.setdefault(tuple(r[at[k]] for k in jobs.KEYS), []).append(r)
    want = set()
    for group in groups.values():
        first = {kind: min((r[0] for r in group if r[-1] == kind), default=None) for kind in ("paper", "daan")}
        want |= {(r[0], r[-1], first["daan" if r[-1] == "paper" else "paper"]) for r in group}
    found = jobs.companion(df)
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(rows)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


def test_names_by_the_index_are_those_of_a_scan(spark, tmp_path):
    df, rows = rows_of(spark, 500, random.Random(5))
    index = NameIndex(spark, str(tmp_path / "names"), shelves=16).write(df)
    assert index.rows().count() == 500
    for token in ("楠梓", "中山", "立楠", "國中", "ab", "AB", "楠梓國小", "梓楠", "none", "高雄市立楠梓國中", "市"):
        assert {r["name_key"] for r in index.names(token).collect()} == {r[2].lower() for r in rows if r[2] and token.lower() in r[2].lower()}
    for filters, keyword in (({"level": "國中"}, "高雄市楠梓國中"), ({}, "中山國中"), ({"county": "臺南市"}, None), ({}, "無此校名"), ({}, "國")):
        scan = {r["paper_id"] for r in df.filter(jobs.matches(filters, keyword)).collect()}
        assert {r["paper_id"] for r in index.search(filters, keyword).collect()} == scan
    shelves = index.search({}, "中山國中").select("paper_id").count()
    assert shelves and len(index.names("中山").select("shelf").distinct().collect()) == 1


def test_cells_after_changes_are_those_of_the_rows(spark):
    df, _ = rows_of(spark, 300, random.Random(6))
    n = F.substring("paper_id", 2, 9).cast("int")
    old, new = df.filter(n < 200), df.filter(n >= 100)
    changed = changed_cells(facet_cells(old), df.filter(n >= 200), df.filter(n < 100))
    assert sorted(map(tuple, changed.collect()), key=repr) == sorted(map(tuple, facet_cells(new).collect()), key=repr)
    for county in ("高雄市", None):
        rows = df if county is None else df.filter(F.col("county") == county)
        lists = {}
        for r in cascade(facet_cells(df), county).orderBy("field", "place").collect():
            lists.setdefault(r["field"], []).append((r["value"], r["n"]))
        for field in FACETS:
            counted = {r[field]: r["count"] for r in rows.groupBy(field).count().collect() if r[field]}
            assert lists[field] == sorted(counted.items(), reverse=field == "school_year")


def test_status_counts(spark):
    rows = spark.createDataFrame([("a.pdf", "國小", "paper"), ("b.pdf", "國中", "daan"), ("c.doc", "國小", "paper"), ("d.pdf", "", None), ("e.PDF", "高中", "paper")], "filename string, level string, paper_or_daan string")
    national = spark.createDataFrame([("cap_exam/a.pdf",), ("cap_exam/_generic/b.pdf",), ("ceec/_generic/c.pdf",), ("ceec/x/_generic/y/d.pdf",), ("ceec/e.pdf",), ("ceec/f.zip",), ("x/g.pdf",)], "rel_path string")
    assert jobs.status_counts(rows, national).first().asDict() == {"pdf_count": 6, "cap_count": 2, "ceec_count": 1, "primary_count": 1, "junior_count": 1, "senior_count": 0, "primary_papers": 1, "junior_papers": 0, "senior_papers": 0}


def test_a_changed_source_is_noticed(spark, tmp_path):
    items = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    items.limit(40).write.parquet(f"{tmp_path}/lineitem.parquet")
    first = catalog_queries.catalog(spark, str(tmp_path))
    n = first.count()
    assert catalog_queries.catalog(spark, str(tmp_path)) is first
    items.filter("l_orderkey > 100").limit(40).write.mode("append").parquet(f"{tmp_path}/lineitem.parquet")
    second = catalog_queries.catalog(spark, str(tmp_path))
    assert second.count() > n
    path = next(p for p, known in catalog_queries._WRITTEN.values() if known is second)
    shutil.rmtree(path)  # a cleared folder
    assert catalog_queries.catalog(spark, str(tmp_path)).count() > n


def merged(calls):
    """The rule, call after call: {school: (files, grade)}; a placeholder's files join those that its new name has."""
    schools, first = {}, {}
    for _, fileid, filetype, name, grade in sorted(calls):
        file, key = f"{fileid}_{filetype}", name or "未註明"
        held = first.setdefault(file, key)
        if school_merge.MARK in held and file in schools.get(held, (set(),))[0] and name and name != held:
            files, _ = schools.pop(held)
            schools[name] = (schools.get(name, (set(), None))[0] | files, grade)
            first[file] = name
            for other in files:
                first[other] = name
        schools.setdefault(key, (set(), grade))[0].add(file)
    return {(k, len(files), grade) for k, (files, grade) in schools.items()}


def test_merged_schools_equal_a_replay(spark):
    rng = random.Random(9)
    for _ in range(6):
        calls, first = [], {}
        for seq in range(150):
            fileid = rng.randrange(40)
            marked = [f"楠梓國中{i} {school_merge.MARK}" for i in range(3)]
            if fileid not in first:
                first[fileid] = rng.choice([*marked, *marked, "高雄市立楠梓國中", ""])
                name = first[fileid]
            else:  # a file keeps its placeholder or is told of in full
                name = rng.choice([first[fileid], f"高雄市立楠梓國中{rng.randrange(4)}", "臺南市立大同國小"])
            calls.append((seq, fileid, "paper", name, f"g{seq}"))
        df = spark.createDataFrame(calls, "seq long, fileid long, filetype string, school_name string, grade string")
        assert {(r["school"], r["total_files"], r["grade"]) for r in school_merge.merged_schools(df).collect()} == merged(calls)
    counted = {(r["county"], r["school"]): r["calls"] for r in school_merge.counted_calls(df).collect()}
    assert counted[None, None] == 150 and counted["臺南市", None] == counted["臺南市", "臺南市立大同國小"] == sum(c[3] == "臺南市立大同國小" for c in calls)
    assert school_merge.merged_schools(df.limit(0)).count() == 0
