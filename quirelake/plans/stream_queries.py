"""Registered queries that run streams over the given events and listing, with DuckDB SQL of their batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.operators import activity_queries, catalog, limits
from quirelake.operators.activity_queries import _AUDIT, audit_rows
from quirelake.plans import seed
from quirelake.plans.catalog_queries import _NEWEST, ROWS_SQL
from quirelake.plans.registry import Registry
from quirelake.sources import store
from quirelake.streaming import jobs, ordered

_registry = Registry("str")
query, queries, oracle_sql = _registry.query, _registry.queries, _registry.oracle_sql


def audit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_rows(jobs.file_stream(spark, sf_dir, "events.parquet"))


def busy(rows: DataFrame) -> DataFrame:
    """The log in a twentieth of a percent of its time and by two users, so that limits are met."""
    start = F.lit(1_704_067_200_000_000)
    at = F.timestamp_micros(start + F.floor((F.unix_micros("ts") - start) / 5000))
    return rows.withColumn("ts", at).withColumn("user_id", F.col("user_id") % 2)


_BUSY = f"{_AUDIT}, busy AS (SELECT * REPLACE (make_timestamp(1704067200000000 + CAST(floor((epoch_us(ts) - 1704067200000000) / 5000.0) AS BIGINT)) AS ts, user_id % 2 AS user_id) FROM audit)"
#: The limits: name, actions, seconds, how many are allowed.
LIMITS = [("search_minute", ["search"], 60, 10), ("download_minute", ["download", "batch_download"], 60, 5), ("download_hour", ["download", "batch_download"], 3600, 30), ("user_minute", list(activity_queries.ACTIONS.values()), 60, 30), ("user_day", list(activity_queries.ACTIONS.values()), 86_400, 500)]


def _in(actions: list[str]) -> str:
    return "(" + ", ".join(f"'{a}'" for a in actions) + ")"


@query(f"WITH {_BUSY} " + " UNION ALL ".join(f"SELECT '{n}' AS rule, user_id, to_timestamp(floor(epoch(ts) / {s}) * {s})::TIMESTAMP AS starts, count(*) AS n FROM busy WHERE action IN {_in(a)} GROUP BY ALL HAVING count(*) > {m}" for n, a, s, m in LIMITS))
def tumbling_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST2: all documented limits over tumbling windows, in one pass: a row counts once for each rule that knows it."""
    rules = F.filter(F.array(*[F.when(F.col("action").isin(*a), F.struct(F.lit(n).alias("rule"), F.lit(s).alias("seconds"), F.lit(m).alias("most"))) for n, a, s, m in LIMITS]), lambda r: r.isNotNull())
    rows = busy(activity_queries.audit(spark, sf_dir)).select("user_id", "ts", F.explode(rules).alias("r"))
    starts = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / F.col("r.seconds")) * F.col("r.seconds"))
    counted = rows.groupBy("r.rule", "r.most", "user_id", starts.alias("starts")).agg(F.count("*").alias("n"))
    return counted.filter("n > most").select("rule", "user_id", "starts", "n")


def lopsided(rows: DataFrame) -> DataFrame:
    """The busy log with nine tenths of it by one user."""
    return busy(rows.withColumn("whole", F.col("user_id"))).withColumn("user_id", F.when(F.col("whole") % 10 == 0, F.col("whole") % 50).otherwise(7)).drop("whole")


_LOPSIDED = _BUSY.replace("user_id % 2 AS user_id", "CASE WHEN user_id % 10 = 0 THEN user_id % 50 ELSE 7 END AS user_id")


@query(f"WITH {_LOPSIDED} " + " UNION ALL ".join(f"SELECT '{n}' AS rule, user_id, event_id, n FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {s * 1_000_000 - 1} PRECEDING AND CURRENT ROW) AS n FROM busy WHERE action IN {_in(a)}) WHERE n > {m}" for n, a, s, m in LIMITS))
def sliding_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST2: requests that exceed one of the five limits over the time just before them, one user with nine tenths of the log."""
    counted = limits.sliding_counts(lopsided(activity_queries.audit(spark, sf_dir)), LIMITS)
    return counted.filter("n > most").select("rule", F.col("user").alias("user_id"), "event_id", "n")


@query(
    f"""WITH {_BUSY}, w AS (SELECT user_id, ts, unnest(range(6)) AS i FROM busy WHERE action = 'search'),
s AS (SELECT user_id, to_timestamp((floor(epoch(ts) / 10) - i) * 10)::TIMESTAMP AS starts, count(*) AS n FROM w GROUP BY ALL)
SELECT user_id, starts, n FROM s WHERE n > 10 AND starts + INTERVAL '1 minute' <= (SELECT max(ts) - INTERVAL '2 minutes' FROM busy WHERE action = 'search')"""
)
def limit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST2 as a stream: sliding minutes with too many searches, given out once the watermark has passed them."""
    found = jobs.rate_violations(busy(audit_stream(spark, sf_dir)), ["search"], 10, "1 minute", "10 seconds", "2 minutes")
    return jobs.drained(found, "limits").select("user_id", "starts", "n")


@query(f"WITH {_AUDIT} SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS starts, count(*) FILTER (action = 'search') AS searches, count(*) FILTER (action IN ('download', 'batch_download')) AS downloads FROM audit GROUP BY 1")
def activity_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST3 as a stream: every batch gives out the days it changes, and the last word on a day counts."""
    rows = jobs.drained(jobs.activity(audit_stream(spark, sf_dir)), "activity", "update")
    return rows.groupBy("starts").agg(F.max(F.struct("batch", "searches", "downloads")).alias("x")).select("starts", "x.searches", "x.downloads")


@query(
    f"""WITH {_AUDIT}, marked AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM audit WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM marked)
SELECT user_id, min(ts) AS starts, max(ts) + INTERVAL '30 minutes' AS ends, count(*) AS n FROM numbered GROUP BY user_id, s HAVING max(ts) + INTERVAL '30 minutes' <= (SELECT max(ts) - INTERVAL '1 hour' FROM audit)"""
)
def session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST4 as a stream: sessions that the watermark has passed."""
    return jobs.drained(jobs.user_sessions(audit_stream(spark, sf_dir)), "sessions")


_CACHE = f"""WITH RECURSIVE {_AUDIT}, r AS (SELECT event_id, key, ts, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS n FROM audit WHERE action = 'search' AND key IS NOT NULL),
walk AS (SELECT key, n, event_id, ts, ts AS missed, 'miss' AS outcome FROM r WHERE n = 1
  UNION ALL SELECT r.key, r.n, r.event_id, r.ts, CASE WHEN r.ts < w.missed + INTERVAL '1 hour' THEN w.missed ELSE r.ts END, CASE WHEN r.ts < w.missed + INTERVAL '1 hour' THEN 'hit' ELSE 'miss' END FROM walk w JOIN r ON r.key = w.key AND r.n = w.n + 1)
SELECT event_id, key, outcome FROM walk"""
#: Rows that a watermark of ten minutes, which is in milliseconds, has passed at the end.
_PASSED = "ceil(epoch_us(ts) / 1000.0) < (SELECT floor(max(epoch_us(ts)) / 1000.0) - 600000 FROM {})"


@query(_CACHE)
def cache_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST5 in batch form."""
    return limits.cache_outcomes(activity_queries.audit(spark, sf_dir).filter("action = 'search'"))


@query(_CACHE)
def cache_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST5 as a stream with state and timers: all requests, those at the end of the log and those of files out of order, up to
    sixty days late, too."""
    log, end = jobs.ending(audit_stream(spark, sf_dir).filter("action = 'search'"), "key")
    return jobs.drained(ordered.cache_outcomes_stream(log, watermark="60 days"), "cache", state_store=ordered.STORE, end=end)


@query(
    f"""WITH {_AUDIT}, r AS (SELECT *, CAST(ts + INTERVAL '8 hours' AS DATE) AS day, CASE WHEN action = 'rate_limited' THEN ts + to_minutes(amount % 60) END AS until FROM audit WHERE action IN ('download', 'rate_limited')),
c AS (SELECT *, last_value(until IGNORE NULLS) OVER (PARTITION BY account, day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cooling FROM r)
SELECT event_id, account FROM c WHERE action = 'download' AND ts < cooling AND {_PASSED.format('r')}"""
)
def cooldown_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST6, J10 as a stream with state and timers: attempts that the watermark has passed."""
    return jobs.drained(ordered.cooldown_stream(audit_stream(spark, sf_dir)), "cooldown", state_store=ordered.STORE)


@query(f"WITH {_AUDIT} SELECT user_id, key, count(*) AS n FROM (SELECT DISTINCT user_id, key FROM audit WHERE action IN ('download', 'batch_download')) GROUP BY ALL")
def unique_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST7 as a stream: with a watermark of sixty days no repeat is given out twice."""
    rows = jobs.drained(jobs.unique_downloads(audit_stream(spark, sf_dir), "60 days"), "unique")
    return rows.groupBy("user_id", "key").agg(F.count("*").alias("n"))


@query(
    ROWS_SQL
    + """walked AS (SELECT *, unnest(range(greatest(l_linenumber - 2, 0), least(l_linenumber + 1, 8))) AS walk FROM rows_)
SELECT paper_id, rel_path, size_kb, mtime, walk FROM walked QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY walk DESC, """
    + _NEWEST
    + ") = 1"
)
def catalog_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1: a listing that comes in eight walks of the archive, each line item seen by three of them; of a path the row of the
    last walk that saw it counts, whatever the order in which the walks' files are read."""
    root, items = store.new_path(spark, "listing"), seed.line_items(spark, sf_dir)
    walks = F.sequence(F.greatest(F.col("l_linenumber") - 2, F.lit(0)), F.least(F.col("l_linenumber"), F.lit(7)))
    seen = items.withColumn("walk", F.explode(walks)).withColumn("walk", F.col("walk").cast("int"))
    with store.shuffles_dropped(spark):  # line items; the stream makes the paths of what it reads
        seen.sortWithinPartitions("walk", "l_orderkey", "l_linenumber").write.partitionBy("walk").option("compression", "zstd").parquet(f"{root}/files")
    read = spark.readStream.schema(seen.schema).option("maxFilesPerTrigger", items.rdd.getNumPartitions()).parquet(f"{root}/files")
    listing = seed.attributes_of(read, "walk").select(*seed.LISTED, "walk")
    found = jobs.stream_catalog(listing, f"{root}/catalog", ["walk", *catalog.NEWEST], most=3).read()
    return found.select("paper_id", "rel_path", "size_kb", "mtime", "walk")
