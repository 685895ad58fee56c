"""The versioned catalogue: what a batch writes, repeats, failures, orders of arrival, folding."""

from __future__ import annotations

import os
import random
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from quirelake.operators import catalog as jobs
from quirelake.sources import versions as parts_of
from quirelake.sources.versions import Versions

SCHEMA = "paper_id string, rel_path string, county string, school_name string, n int"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, p, c, "x", n) for i, p, c, n in rows], SCHEMA)


def parquet_bytes(root):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(root) for f in names if f.endswith(".parquet"))


def read(versions, counties=None):
    return {(r["paper_id"], r["rel_path"], r["county"], r["n"]) for r in versions.read(counties).collect()}


def batches_of(rng, n):
    out, at = [], 0
    for _ in range(n):
        rows = []
        for _ in range(rng.randrange(1, 8)):
            at += 1
            rows.append((f"p{rng.randrange(12)}", f"r{rng.randrange(12)}", "高雄市", at))
        out.append(rows)
    return out


def live_of(rows):
    return {r for r in rows if not any(o[3] > r[3] and (o[0] == r[0] or o[1] == r[1]) for o in rows)}


def test_batches_in_any_order_and_again(spark, tmp_path):
    batches = batches_of(random.Random(4), 7)
    want = live_of([r for b in batches for r in b])
    for name, order in {"straight": [0, 1, 2, 3, 4, 5, 6], "mixed": [6, 2, 0, 0, 5, 1, 4, 3, 2]}.items():
        versions = Versions(spark, str(tmp_path / name), ["n"], most=2)
        for number in order:
            versions.put(rows_of(spark, batches[number]), number)
            assert len(versions.parts()) <= 3
        assert read(versions) == want


def test_a_batch_that_fails_before_its_manifest_changes_nothing(spark, tmp_path):
    versions = Versions(spark, str(tmp_path / "v"), ["n"])
    assert versions.parts() == []
    versions.put(rows_of(spark, [("p1", "r1", "高雄市", 1)]), 0)
    lost = versions._write(rows_of(spark, [("p1", "r1", "高雄市", 9)]), "delta", 1)
    (tmp_path / "v/manifest/000000000001").mkdir()  # a manifest that was begun
    assert lost["n_rows"] == 1 and read(versions) == {("p1", "r1", "高雄市", 1)}
    (tmp_path / "v/manifest/000000000001").rmdir()
    versions.put(rows_of(spark, [("p1", "r2", "高雄市", 9)]), 1)
    assert read(Versions(spark, str(tmp_path / "v"), ["n"])) == {("p1", "r2", "高雄市", 9)}
    with pytest.raises(Exception, match="(?i)exists"):
        versions._version = lambda: 0  # another writer was faster
        versions.put(rows_of(spark, [("p3", "r3", "高雄市", 9)]), 2)


def test_bytes_follow_the_batch_and_folding_follows_the_size(spark, tmp_path):
    versions = Versions(spark, str(tmp_path / "v"), ["n"], most=3)
    versions.put(spark.range(200_000).selectExpr("sha1(string(id)) paper_id", "concat('r', id) rel_path", "if(id % 2 = 0, '高雄市', '臺南市') county", "'x' school_name", "1 n"), 0)
    versions.put(rows_of(spark, [("q", "q", "高雄市", 0)]), 1)
    versions.put(rows_of(spark, [("q", "q", "高雄市", 1)]), 2)
    versions.put(rows_of(spark, [("q", "q", "高雄市", 2)]), 3)  # four deltas: a base
    assert [p["kind"] for p in versions.parts()] == ["base"]
    whole, grew = parquet_bytes(tmp_path / "v"), []
    for number in range(4, 9):
        versions.put(rows_of(spark, [(f"p{number}", f"s{number}", "臺南市", number), ("q", "q", "高雄市", number)]), number)
        grew.append(parquet_bytes(tmp_path / "v") - whole)
        whole += grew[-1]
    assert max(grew) < whole / 100  # four small deltas were folded into one, the base stayed
    assert {p["kind"] for p in versions.parts()} == {"base", "folded", "delta"}
    assert versions.read().count() == 200_006
    assert versions.read(["高雄市"]).count() == 100_001
    read_of = versions._together(versions.parts(), ["高雄市"]).select(F.input_file_name().alias("f")).distinct().collect()
    assert read_of and all(unquote(unquote(r["f"])).count("of_county=高雄市") == 1 for r in read_of)


def test_whole_rows_are_dealt_once_where_ids_and_paths_go_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "last_by_either_key", None)  # two maxima over whole rows and a join
    versions = Versions(spark, str(tmp_path / "v"), ["n"], most=1)
    for number in range(4):
        versions.put(rows_of(spark, [(f"p{i}", f"r{i}", "高雄市", 10 * number + i) for i in range(number, number + 3)]), number)
    assert all(p["clean"] for p in versions.parts())
    assert read(versions) == {("p0", "r0", "高雄市", 0), ("p1", "r1", "高雄市", 11), ("p2", "r2", "高雄市", 22), *((f"p{i}", f"r{i}", "高雄市", 30 + i) for i in (3, 4, 5))}


def test_a_fold_deals_some_counties_at_a_time_and_leaves_nothing_it_replaced(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(parts_of, "FOLD_ROWS", 6, raising=False)
    dealt, real = [], jobs.last_by_key
    monkeypatch.setattr(jobs, "last_by_key", lambda rows, order: (dealt.append({r["county"] for r in rows.select("county").distinct().collect()}), real(rows, order))[1])
    versions, want = Versions(spark, str(tmp_path / "v"), ["n"], most=2), {}
    for number in range(7):
        rows = [(f"p{i}", f"r{i}", ["高雄市", "臺南市", "臺北市", None][i % 4], 100 * number + i) for i in range(number, number + 8)]
        want |= {r[0]: r for r in rows}
        versions.put(rows_of(spark, rows), number)
        there = {str(x.relative_to(tmp_path / "v")) for kind in ("base", "folded", "delta") for x in (tmp_path / "v" / kind).glob("*")}
        assert there == {p["path"] for p in versions.parts()}  # all parts ever written before
    assert read(versions) == set(want.values())
    assert len(dealt) > 4 and not any(len(counties) == 4 for counties in dealt)  # whole catalogues before


def test_keys_of_two_counties_are_folded_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(parts_of, "FOLD_ROWS", 1, raising=False)
    batches = [[("p1", "r1", "高雄市", 1), ("p2", "r2", "臺南市", 2)], [("p1", "r1", "臺南市", 3)], [("p3", "r2", "高雄市", 4), ("p2", "r4", "高雄市", 3)], [("p1", "r5", "臺北市", 5)]]
    versions = Versions(spark, str(tmp_path / "v"), ["n"], most=1)
    for number in (0, 1, 3, 2, 1):
        versions.put(rows_of(spark, batches[number]), number)
    assert read(versions) == live_of([r for b in batches for r in b])
