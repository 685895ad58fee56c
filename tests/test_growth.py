"""Jobs whose work must grow with their input: what their joins make and write, besides their results."""

from __future__ import annotations

import datetime as dt
import os
import random
import time

from pyspark.sql import functions as F

from quirelake.functions import names
from quirelake.operators import catalog, dump, upkeep
from quirelake.plans import catalog_queries, dump_queries, inbox_queries, seed, text_queries
from quirelake.sources import files, store

SMALL = "/root/testdata/sf0.001"
START = dt.datetime(2024, 1, 1)


def most_rows(rows):
    """The rows, and the most that one step of the run gave out."""
    got, most, todo = rows.collect(), 0, [rows._jdf.queryExecution().executedPlan()]
    while todo:
        step = todo.pop()
        made = step.metrics().get("numOutputRows")
        most = max(most, made.get().value() if made.isDefined() else 0)
        inner = step.executedPlan() if "Adaptive" in step.nodeName() else step.plan() if "QueryStage" in step.nodeName() else None
        below = step.children() if inner is None else None
        todo += [inner] if inner is not None else [below.apply(i) for i in range(below.size())]
    return got, most


def test_next_account_meets_each_limit_once(spark):
    rng = random.Random(3)
    at = lambda: START + dt.timedelta(seconds=rng.randrange(2 * 86_400))
    limits = [(rng.randrange(3), t := at(), t + dt.timedelta(minutes=rng.randrange(90))) for _ in range(1500)]
    asked = sorted({(at(), rng.randrange(4)) for _ in range(700)})
    local = lambda t: (t + dt.timedelta(hours=8)).date()
    want = []
    for moment, current in asked:
        until = [max(((t, u) for a, t, u in limits if a == account and t <= moment and local(t) == local(moment)), default=(None, None))[1] for account in range(4)]
        free = [a for a in range(4) if a != current and not (until[a] and until[a] > moment)]
        want.append((moment, current, min(free, default=None), min((u for u in until if u and u > moment), default=None)))
    accounts = spark.createDataFrame(asked, "as_of timestamp, current long").withColumn("account", F.explode(F.array(*[F.lit(i).cast("long") for i in range(4)]))).withColumn("place", F.col("account"))
    got, most = most_rows(upkeep.next_account(accounts, spark.createDataFrame([*limits, (None, START, START)], "account long, ts timestamp, until timestamp")))
    assert sorted(tuple(r) for r in got) == want
    assert most <= 4 * len(asked) + len(limits) + 1  # not each moment with each limit of its day


def test_parts_of_the_line_items_follow_their_size_and_keep_orders_together(spark, monkeypatch):
    monkeypatch.setattr(seed, "PART", 4096, raising=False)
    items = seed.line_items(spark, SMALL)
    assert items.rdd.getNumPartitions() > 8  # one for each core before, whatever the size
    of_part = items.select("l_orderkey", F.spark_partition_id().alias("part")).distinct()
    assert of_part.count() == of_part.select("l_orderkey").distinct().count()
    plan = dump_queries.files(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1  # the line items' own; names are not dealt again


def test_newest_paths_deal_one_path_a_row(spark):
    rows = catalog.newest_paths(seed.listing(spark, SMALL))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert [x for x in plan.splitlines() if "Aggregate" in x and "max(" in x and "rel_path" not in x.replace("AS rel_path", "")]


def test_school_sets_read_the_files_once(spark):
    kinds = "county string, school_name string"
    configured = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), (None, "z")], kinds)
    indexed = spark.createDataFrame([("a", "y")] * 50 + [(None, "z"), ("b", None)], kinds)
    got = [tuple(r) for r in dump.school_sets(configured, indexed).collect()]
    assert len(got) == 4 and set(got) == {("config_minus_index", "a", "x"), ("both", "a", "y"), ("both", None, "z"), ("index_minus_config", "b", None)}
    plan = dump_queries.school_sets(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1


def test_a_projection_makes_computed_values(spark):
    made = names.computed(spark.range(3), x=F.regexp_replace(F.col("id").cast("string"), "1", "y"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    generators = [x for x in plan.splitlines() if "Generate " in x]
    assert generators and not [x for x in generators if "regexp_replace" in x]  # a generator would interpret it
    assert [r["x"] for r in made.collect()] == ["0", "y", "2"]


def test_a_dumps_sheets_are_numbers_until_they_are_one_row_each(spark):
    plan = dump_queries.files(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "county" not in next(x for x in plan.splitlines() if "Aggregate [" in x).split("], [")[0]


def test_a_files_stem_is_made_once(spark):
    plan = dump_queries.classified(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?i)\\.pdf$") == 1


def optimized(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_a_name_in_the_inbox_is_read_once_for_all_its_files(spark):
    plan = optimized(inbox_queries.inbox_files(spark, SMALL))
    assert plan.count("_(?:daan|paper)$") == plan.count("解答(\\d)") == plan.count("^國立") == 1  # once for each use before
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, "")], "i long, x string")
    made = names.computed_once(rows, "x", y=F.concat(F.coalesce("x", F.lit("none")), F.lit("!")))
    assert sorted(tuple(r) for r in made.select("i", "x", "y").collect()) == [(1, "a", "a!"), (2, None, "none!"), (3, "a", "a!"), (4, "", "!")]


def test_whole_numbers_stand_for_quotients_rounded_down(spark):
    text = "SELECT CAST(FLOOR(id / 3.0) AS BIGINT) AS q, id FROM {t}"
    assert "FLOOR" not in seed.whole(text)  # decimals were divided for each branch of each rule
    assert [(r["q"], r["id"]) for r in spark.sql(seed.whole(text), t=spark.range(-7, 8)).collect()] == [(i // 3, i) for i in range(-7, 8)]


def test_a_title_is_read_once(spark):
    plan = optimized(text_queries.accepted_schools(spark, SMALL))
    assert plan.count("(?U)\\s+") == 2  # the text's and the scanned one's; once for each county and each use before
    assert plan.count("Relation [") == 1  # joined with the line items again before


def test_a_covers_school_is_read_once(spark):
    plan = optimized(text_queries.cover_fields(spark, SMALL))
    assert plan.count("國[民中小]") == 2  # the text and the text without blanks; once for each use before
    assert plan.count("次\\s*段考") == 2


def test_rows_of_an_upsert_meet_by_a_key_alone(spark):
    rows = spark.createDataFrame([("a", "p", 1), ("a", "q", 2), ("b", "q", 3), ("c", "r", None)], "paper_id string, rel_path string, n int")
    kept = catalog.last_by_both_keys(rows, ["n"])
    assert sorted(r["paper_id"] for r in kept.collect()) == ["b", "c"]
    joins = [x for x in optimized(kept).splitlines() if "Join Inner" in x]
    assert joins and not [x for x in joins if "<=>" in x]  # all that orders them was a key of the join, dealt and sorted by


def test_placed_files_are_those_of_the_catalogue_and_parse_no_name(spark):
    placed = catalog.placed(seed.newest_listing(spark, SMALL))
    assert "第\\\\d學期" not in optimized(placed) and "第\\d學期" not in optimized(placed)
    built = catalog.build_catalog(seed.listing(spark, SMALL))
    columns = ["paper_id", "rel_path", "size_kb", *catalog.NEWEST, "k"]
    assert sorted(map(tuple, placed.select(columns).collect())) == sorted(map(tuple, built.select(columns).collect()))


def test_paths_are_read_in_as_many_parts_as_the_line_items_have(spark, monkeypatch):
    monkeypatch.setattr(seed, "PART", 4096, raising=False)
    parts = seed.parts(seed.read_items(spark, SMALL))
    rows = catalog.build_catalog(seed.newest_listing(spark, SMALL), parts=parts)
    assert parts > 8 and rows.rdd.getNumPartitions() == parts  # as many as any shuffle has before, whatever the size


def shuffle_files(spark):
    return {f for _, _, names_ in os.walk(spark.sparkContext.getConf().get("spark.local.dir")) for f in names_ if f.startswith("shuffle_")}


def test_what_writes_a_table_leaves_no_shuffle_files(spark, tmp_path):
    before, set_before = shuffle_files(spark), spark.conf.get(store.CLEANUP)
    rows = spark.range(5000).selectExpr("id", "string(id % 22) county", "string(id % 7) school_name").repartition(5, "id")
    held = store.write_catalog(rows, str(tmp_path / "catalog"))
    assert spark.conf.get(store.CLEANUP) == set_before
    for _ in range(50):  # they go beside the run
        left = {f for f in shuffle_files(spark) - before if f.endswith(".data")}
        if not left:
            break
        time.sleep(0.2)
    assert not left
    assert held.count() == 5000


def test_a_report_takes_little_room(spark, tmp_path):
    rows = dump_queries.with_conflicts(spark, SMALL).select(*dump.REPORT)
    want = sorted(map(tuple, rows.collect()))
    files.write_report(rows, str(tmp_path / "report"))
    assert sorted(map(tuple, files.read_report(spark, str(tmp_path / "report")).collect())) == want
    room = sum(os.path.getsize(f"{d}/{f}") for d, _, found in os.walk(tmp_path) for f in found if not f.endswith(".crc"))
    assert room < sum(len(",".join(map(str, r)).encode()) for r in want) / 4  # as much as the text before


def test_conflicts_are_those_of_the_classified_files_and_deal_only_what_names_tell(spark):
    archive = catalog_queries.catalog(spark, SMALL)
    whole = dump.classify(dump_queries.files(spark, SMALL))
    hit = whole.filter("confidence = 'HIGH'").orderBy("paper_id").limit(40).select("target_rel", "level")
    more = archive.limit(0).unionByName(hit.select(F.col("target_rel").alias("rel_path"), "level"), allowMissingColumns=True)
    archive = archive.unionByName(more.select(archive.columns))  # files on target paths
    at_once = dump.classify_and_find(dump_queries.files(spark, SMALL), archive)
    got = sorted(map(tuple, at_once.collect()))
    assert got == sorted(map(tuple, dump.find_conflicts(whole, archive).collect()))
    by_path = sum(r["conflict_target"] == r["target_rel"] for r in at_once.collect())
    assert by_path >= 40 and sum(r["conflict_target"] != "" for r in at_once.collect()) > by_path
    todo, dealt = [at_once._jdf.queryExecution().sparkPlan()], []
    while todo:
        step = todo.pop()
        todo += [step.children().apply(i) for i in range(step.children().size())]
        if step.nodeName().endswith("Join"):
            dealt.append(step.left().output().mkString(","))
    assert dealt and not any(c in x for x in dealt for c in ("target_filename", "skip_reason", "confidence"))
