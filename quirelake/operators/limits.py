"""Sliding request limits and cache outcomes of request logs, in forms that split one busy user or key over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirelake.sources import store

#: Parts that a limit's time is cut into; a task gets the rows of one part and those that leave the window meanwhile.
PARTS = 8
MICROS = 1_000_000


def sliding_counts(events: DataFrame, limits: list[tuple[str, list[str], int, int]], user: str = "user_id") -> DataFrame:
    """(rule, most, user, event_id, n): for each event and each limit (name, actions, seconds, most) that knows its action, how
    many such events the user has had in the last ``seconds``, the event and those at its moment included.

    Time is cut into parts of an eighth of the limit. The window that ends at a row of part j begins in part j - 8: so its
    count is that of the eight parts before, plus the rows of part j up to the moment, less the rows of part j - 8 that
    have left it. Those come into part j moved by the length of the limit, so one running count over two parts finds both
    numbers, and the eight parts are added up from counts. No task holds more of a user than two parts, and nothing is
    compared row by row. All limits go in one pass."""
    known = F.filter(F.array(*[F.when(F.col("action").isin(*a), F.struct(F.lit(n).alias("rule"), F.lit(s * MICROS).alias("span"), F.lit(m).alias("most"))) for n, a, s, m in limits]), lambda r: r.isNotNull())
    rows = events.select(F.col(user).alias("user"), "event_id", F.unix_micros("ts").alias("at"), F.explode(known).alias("r")).select("user", "event_id", "at", "r.*")
    rows = rows.withColumn("part", F.floor(F.col("at") * PARTS / F.col("span")).cast("long"))
    keys = ["rule", "user", "part"]
    leaving = rows.select("rule", "most", "user", (F.col("part") + PARTS).alias("part"), (F.col("at") + F.col("span")).alias("at"), F.lit(None).cast("long").alias("event_id"), F.lit(-1).alias("by"))
    moves = rows.select("rule", "most", "user", "part", "at", "event_id", F.lit(1).alias("by")).unionByName(leaving)
    upto = W.partitionBy(*keys).orderBy("at").rangeBetween(W.unboundedPreceding, W.currentRow)
    counted = moves.withColumn("own", F.sum("by").over(upto)).filter("by = 1")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    before = sizes.select("rule", "user", "n", F.explode(F.sequence(F.col("part") + 1, F.col("part") + PARTS)).alias("part")).groupBy(*keys).agg(F.sum("n").alias("before"))
    return counted.join(before, keys, "left").select("rule", "most", "user", "event_id", (F.col("own") + F.coalesce("before", F.lit(0))).alias("n"))


def cache_outcomes(requests: DataFrame, seconds: int = 3600) -> DataFrame:
    """(event_id, key, outcome): hit or miss of each request; a miss fills the cache for ``seconds``, a hit does not extend it.

    Time is cut into parts as long as the cache lives, so a key misses at most once in a part. If a request is a miss, the
    next one is the first request after its time is up: in the next part, or else the first of the part after that; where
    both are empty the chain ends. A part whose predecessor is empty begins a chain with its first request. So each moment
    points to the one that would miss next, found by one ordered pass over two parts of a key, and the misses are what
    the heads of the chains reach. They are found by pointer doubling: each round doubles both the reach of the pointers and
    the misses known, in joins by key and moment. A key may hold any share of the requests: its parts, and in the joins
    its moments, go to different tasks."""
    span = seconds * MICROS
    rows = requests.filter("key is not null").select("event_id", "key", F.unix_micros("ts").alias("at"))
    moments = store.kept(rows.groupBy("key", "at").agg(F.min("event_id").alias("first")).withColumn("part", F.floor(F.col("at") / F.lit(span)).cast("long")), "moments")
    opens = moments.groupBy("key", "part").agg(F.min("at").alias("at"))
    asks = moments.select("key", (F.col("part") + 1).alias("part"), (F.col("at") + span).alias("due"), F.col("at").alias("asks"))
    both = asks.unionByName(moments.select("key", "part", F.col("at").alias("due"), F.lit(None).cast("long").alias("asks")))
    later = W.partitionBy("key", "part").orderBy(F.desc("due"), F.asc_nulls_first("asks")).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = both.withColumn("to", F.last(F.when(F.col("asks").isNull(), F.col("due")), ignorenulls=True).over(later)).filter("asks is not null")
    follow = opens.select("key", (F.col("part") + 1).alias("part"))  # of these parts the one before holds requests
    after = opens.join(follow, ["key", "part"], "left_semi").select("key", (F.col("part") - 1).alias("part"), F.col("at").alias("opens"))
    jumps = found.join(after, ["key", "part"], "left").select("key", F.col("asks").alias("at"), F.coalesce("to", "opens").alias("to")).filter("to is not null")
    jumps = store.kept(jumps, "jumps")
    misses = new = store.kept(opens.join(follow, ["key", "part"], "left_anti").select("key", "at"), "misses")
    while not new.isEmpty():
        new = store.kept(misses.join(jumps, ["key", "at"]).select("key", F.col("to").alias("at")), "misses")
        misses = misses.unionByName(new)
        onward = jumps.select("key", F.col("at").alias("to"), F.col("to").alias("beyond"))
        jumps = store.kept(jumps.join(onward, ["key", "to"]).select("key", "at", F.col("beyond").alias("to")), "jumps")
    filled = misses.join(moments.select("key", "at", "first"), ["key", "at"])
    missed = F.coalesce(F.col("event_id") == F.col("first"), F.lit(False))
    return rows.join(filled, ["key", "at"], "left").select("event_id", "key", F.when(missed, "miss").otherwise("hit").alias("outcome"))
