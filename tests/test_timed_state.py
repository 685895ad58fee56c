"""Sliding limits, cache outcomes and cooldowns: against replays, with one hot key, and as streams in any order."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quirelake.operators import limits
from quirelake.plans import stream_queries
from quirelake.streaming import jobs, ordered

START = dt.datetime(2024, 1, 1)
LOG = "event_id long, key string, account long, action string, amount long, ts timestamp"


def moments(rng, n, hours, hot):
    """Rows (event_id, key, ts): gaps of all sizes, several at one moment, ``hot`` of the rows of one key."""
    at, rows = 0, []
    for i in range(n):
        at += rng.choice([0, 0, 1, 59, 600, 1800, 3599, 3600, 3601, 7200, 10_801][: rng.randrange(1, hours)])
        rows.append((i, "hot" if rng.random() < hot else f"k{rng.randrange(4)}", START + dt.timedelta(seconds=at)))
    return rows


def outcomes(rows, seconds=3600):
    missed, out = {}, set()
    for i, key, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        hit = key in missed and ts < missed[key] + dt.timedelta(seconds=seconds)
        missed[key] = missed[key] if hit else ts
        out.add((i, key, "hit" if hit else "miss"))
    return out


def test_cache_outcomes_equal_a_replay(spark):
    rng = random.Random(8)
    for hours, hot in ((12, 0.3), (7, 0.9), (11, 1.0)):
        rows = moments(rng, 600, hours, hot)
        found = limits.cache_outcomes(spark.createDataFrame([*rows, (-1, None, START)], "event_id long, key string, ts timestamp"))
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(rows) and set(got) == outcomes(rows)
    assert limits.cache_outcomes(spark.createDataFrame([], "event_id long, key string, ts timestamp")).count() == 0


def test_sliding_counts_equal_a_replay_and_split_a_hot_user(spark):
    rng = random.Random(2)
    rules = [("a", ["search"], 60, 3), ("b", ["search", "download"], 3600, 10), ("c", ["download"], 86_400, 20)]
    rows = [(i, 7 if rng.random() < 0.9 else rng.randrange(5), rng.choice(["search", "download", "other"]), START + dt.timedelta(microseconds=rng.randrange(200_000) * 1_000_000 + rng.choice([0, 0, 1, 999_999]))) for i in range(3000)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, action string, ts timestamp")
    by = defaultdict(list)
    for i, user, action, ts in rows:
        for rule, actions, _, _ in rules:
            if action in actions:
                by[rule, user].append((ts, i))
    want = set()
    for rule, _, seconds, most in rules:
        for (name, user), some in by.items():
            if name == rule:
                want |= {(rule, most, user, i, sum(ts - dt.timedelta(seconds=seconds) < o <= ts for o, _ in some)) for ts, i in some}
    assert {tuple(r) for r in limits.sliding_counts(events, rules).collect()} == want
    by_part = [F.floor(F.unix_micros("ts") * limits.PARTS / F.lit(3600 * limits.MICROS))]
    sizes = [r["count"] for r in events.filter("user_id = 7").groupBy(*by_part).count().collect()]
    assert max(sizes) < 0.01 * len(rows)  # what a task gets of the user, at an hour's limit


def streamed(spark, tmp_path, rows, last, files, make, name):
    """The rows in files, one micro-batch each, and ``last``, which moves the watermark, in the last of them; the stream's
    result and the number of state rows after each batch."""
    schema = spark.createDataFrame(rows[:1], LOG).schema
    for n in range(files):
        some = rows[n::files] + ([last] if n == files - 1 else [])
        spark.createDataFrame(some, LOG).coalesce(1).write.parquet(f"{tmp_path}/{name}/{n:03d}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/{name}")
    spark.conf.set(jobs.PROVIDER, ordered.STORE)
    try:
        query = make(source).writeStream.format("memory").queryName(f"q_{name}").option("checkpointLocation", f"{tmp_path}/{name}_checkpoint").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        state = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    finally:
        spark.conf.unset(jobs.PROVIDER)
    return [tuple(r) for r in spark.table(f"q_{name}").collect()], state


@pytest.mark.parametrize("files", [1, 4])
def test_cache_stream_in_any_order_ends_without_state(spark, tmp_path, files):
    rows = moments(random.Random(5), 300, 12, 0.5)
    log = [(i, key, 0, "search", 0, ts) for i, key, ts in rows]
    last = (9999, "end", 0, "search", 0, START + dt.timedelta(days=400))
    random.Random(6).shuffle(log)
    found, state = streamed(spark, tmp_path, log, last, files, lambda s: ordered.cache_outcomes_stream(s, watermark="500 days"), f"cache{files}")
    assert found == []  # the watermark has passed nothing
    found, state = streamed(spark, tmp_path, log, last, files, lambda s: ordered.cache_outcomes_stream(s, watermark="300 days"), f"passed{files}")
    assert sorted(found) == sorted(outcomes(rows))
    assert max(state) > 1 and state[-1] <= 2  # only the last key waits: its row and its list's length


def test_cooldown_stream_over_midnight(spark, tmp_path):
    at = lambda h, m=0: START + dt.timedelta(hours=h, minutes=m)  # noqa: E731  local midnight is 16:00
    log = [
        (1, "x", 1, "rate_limited", 40, at(15, 40)),
        (2, "x", 1, "download", 0, at(15, 59)),
        (3, "x", 1, "download", 0, at(16, 1)),  # cooled down by midnight
        (4, "x", 1, "rate_limited", 30, at(16, 10)),
        (5, "x", 1, "rate_limited", 5, at(16, 12)),  # the latest counts, though it ends sooner
        (6, "x", 1, "download", 0, at(16, 16)),
        (7, "x", 1, "download", 0, at(16, 20)),
        (8, "x", 2, "download", 0, at(16, 13)),
        (9, "x", 2, "rate_limited", 59, at(16, 14)),
        (10, "x", 2, "download", 0, at(17, 12)),
        (11, "x", 2, "download", 0, at(17, 13)),
    ]
    last = (12, "x", 3, "download", 0, START + dt.timedelta(days=40))
    for files, order in ((1, log), (3, log[::-1])):
        found, state = streamed(spark, tmp_path, order, last, files, lambda s: ordered.cooldown_stream(s, "30 days"), f"cool{files}")
        assert sorted(found) == [(2, 1), (6, 1), (10, 2)]
        assert state[-1] <= 2


def test_cache_stream_gives_out_every_request(spark, tmp_path):
    rows = moments(random.Random(7), 200, 12, 0.5)
    events = spark.createDataFrame([(i, ts, 1, "view", 0.0, f'{{"k": "{key}"}}') for i, key, ts in rows[::-1]], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    for n in range(10):  # more files than a batch reads, the latest first
        events.offset(20 * n).limit(20).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    found = [tuple(r) for r in stream_queries.cache_stream(spark, str(tmp_path)).collect()]
    assert len(found) == len(rows) and set(found) == outcomes(rows)
