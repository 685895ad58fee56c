"""Activity logs: traffic, rate limits, sessions, cooldowns, cache outcomes, access state. Jobs and their registered queries.

The ``events`` table stands for the audit log: view is a search, click a download, purchase a batch download, signup an
access request, error a rate limit; the account is ``user_id % 4``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: What the event types stand for.
ACTIONS = {"view": "search", "click": "download", "purchase": "batch_download", "signup": "submit_access_request", "error": "rate_limited"}
ACTION_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ACTIONS.items()) + " END"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_rows(spark.read.parquet(f"{sf_dir}/events.parquet"))


def audit_rows(events: DataFrame) -> DataFrame:
    """The audit log that event rows, given or streamed, stand for."""
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", (F.col("user_id") % 4).alias("account"), F.expr(ACTION_SQL).alias("action"), F.floor("value").alias("amount"), F.get_json_object("props", "$.k").alias("key"))


_AUDIT = f"audit AS (SELECT event_id, ts, user_id, user_id % 4 AS account, {ACTION_SQL} AS action, CAST(floor(value) AS BIGINT) AS amount, json_extract_string(props, '$.k') AS key FROM events)"


# jobs


def traffic(events: DataFrame) -> DataFrame:
    """(grain, starts, searches, downloads, users): by week, by month and in all, in one pass; users are distinct."""
    grains = [F.struct(F.lit(g).alias("grain"), F.to_date(F.date_trunc(g, "ts")).alias("starts")) for g in ("week", "month")]
    rows = events.select("user_id", "action", F.explode(F.array(*grains, F.struct(F.lit("all").alias("grain"), F.lit(None).cast("date").alias("starts")))).alias("g"))
    return rows.groupBy("g.grain", "g.starts").agg(F.count_if(F.col("action") == "search").alias("searches"), F.count_if(F.col("action").isin("download", "batch_download")).alias("downloads"), F.count_distinct("user_id").alias("users"))


def user_sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, starts, ends, n): runs of events less than ``gap`` apart."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("ends")).select("user_id", F.col("w.start").alias("starts"), "ends", "n")


def cooldown_hits(events: DataFrame) -> DataFrame:
    """Attempts made while an account cools down: the latest rate limit of the account on the same local day, plus its
    minutes, lies after the attempt. One window over both kinds of rows, no range join."""
    day = F.to_date(F.from_utc_timestamp("ts", "Asia/Taipei"))
    until = F.when(F.col("action") == "rate_limited", F.col("ts") + F.make_dt_interval(mins=F.col("amount").cast("int") % 60))
    rows = events.withColumn("day", day).withColumn("until", until)
    w = W.partitionBy("account", "day").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("cooling", F.last("until", ignorenulls=True).over(w)).filter((F.col("action") == "download") & (F.col("ts") < F.col("cooling"))).select("event_id", "account", "ts", F.col("cooling").alias("until"))


def access_meta(events: DataFrame) -> DataFrame:
    """Last access, count and last user of each key."""
    return events.groupBy("key").agg(F.max("ts").alias("last_access"), F.count("*").alias("n"), F.max_by("user_id", F.struct("ts", "event_id")).alias("last_user"))


def total_history(events: DataFrame, keep: int = 90) -> DataFrame:
    """(day, n, delta): counts per day with the change, the last ``keep`` days. Ordered over days only, which are few."""
    days = events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    w = W.orderBy("day")
    return days.withColumn("delta", F.col("n") - F.lag("n", 1, None).over(w)).fillna(0, ["delta"]).orderBy(F.desc("day")).limit(keep)


# queries


_TRAFFIC = "count(*) FILTER (action = 'search') AS searches, count(*) FILTER (action IN ('download', 'batch_download')) AS downloads, count(DISTINCT user_id) AS users FROM audit"


@query(f"WITH {_AUDIT} SELECT 'week' AS grain, CAST(date_trunc('week', ts) AS DATE) AS starts, {_TRAFFIC} GROUP BY 2 UNION ALL SELECT 'month', CAST(date_trunc('month', ts) AS DATE), {_TRAFFIC} GROUP BY 2 UNION ALL SELECT 'all', NULL, {_TRAFFIC}")
def traffic_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17."""
    return traffic(audit(spark, sf_dir))


@query(
    f"""WITH {_AUDIT}, marked AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM audit WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM marked)
SELECT user_id, min(ts) AS starts, max(ts) AS ends, count(*) AS n FROM numbered GROUP BY user_id, s"""
)
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST4 in batch form."""
    return user_sessions(audit(spark, sf_dir))


@query(
    f"""WITH {_AUDIT}, r AS (SELECT *, CAST(ts + INTERVAL '8 hours' AS DATE) AS day, CASE WHEN action = 'rate_limited' THEN ts + to_minutes(amount % 60) END AS until FROM audit),
c AS (SELECT *, last_value(until IGNORE NULLS) OVER (PARTITION BY account, day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cooling FROM r)
SELECT event_id, account, ts, cooling AS until FROM c WHERE action = 'download' AND ts < cooling"""
)
def attempts_in_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10, ST6 in batch form."""
    return cooldown_hits(audit(spark, sf_dir))


@query(f"WITH {_AUDIT} SELECT key, max(ts) AS last_access, count(*) AS n, arg_max(user_id, {{'a': ts, 'b': event_id}}) AS last_user FROM audit GROUP BY key")
def last_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15."""
    return access_meta(audit(spark, sf_dir))


@query(f"WITH {_AUDIT}, d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM audit GROUP BY 1) SELECT day, n, coalesce(n - lag(n) OVER (ORDER BY day), 0) AS delta FROM d ORDER BY day DESC LIMIT 90")
def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3."""
    return total_history(audit(spark, sf_dir))


@query(f"WITH {_AUDIT} SELECT account, max(n) AS quota FROM (SELECT account, CAST(ts + INTERVAL '8 hours' AS DATE) AS day, count(*) AS n FROM audit WHERE action = 'download' GROUP BY 1, 2) GROUP BY account")
def learned_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most downloads an account has had on a local day."""
    day = F.to_date(F.from_utc_timestamp("ts", "Asia/Taipei"))
    return audit(spark, sf_dir).filter("action = 'download'").groupBy("account", day.alias("day")).agg(F.count("*").alias("n")).groupBy("account").agg(F.max("n").alias("quota"))


@query(f"WITH {_AUDIT} SELECT key, count(*) AS downloads FROM audit WHERE action IN ('download', 'batch_download') GROUP BY key ORDER BY downloads DESC, key LIMIT 10")
def hot_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten keys with most downloads."""
    return audit(spark, sf_dir).filter("action in ('download', 'batch_download')").groupBy("key").agg(F.count("*").alias("downloads")).orderBy(F.desc("downloads"), "key").limit(10)


@query(f"WITH {_AUDIT} SELECT user_id, event_id, ts, action FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM audit) WHERE n <= 5")
def last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five events of each user."""
    w = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return audit(spark, sf_dir).withColumn("n", F.row_number().over(w)).filter("n <= 5").select("user_id", "event_id", "ts", "action")


@query(f"WITH {_AUDIT} SELECT event_id, ts, user_id, action FROM audit ORDER BY ts DESC, event_id DESC LIMIT 20")
def last_audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F14."""
    return audit(spark, sf_dir).orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "ts", "user_id", "action")


def queries() -> dict[str, Query]:
    return {f"act_{k}": v for k, v in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {f"act_{k}": v for k, v in ORACLES.items()}
