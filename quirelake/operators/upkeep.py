"""Upkeep of the archive: pending work, re-home and migration plans, users, accounts, name clashes. DataFrame to DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirelake.functions import paths


def by_state(status: DataFrame, catalog: DataFrame, states: list[str]) -> DataFrame:
    """Status rows in the given states with their catalogue rows; status columns are prefixed."""
    rows = status.filter(F.col("ocr_status").isin(*states))
    return rows.select("paper_id", *[F.col(c).alias(f"status_{c}") for c in rows.columns if c != "paper_id"]).join(catalog, "paper_id")


def pending(listed: DataFrame, collected: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` listed items, in a total order, that were not collected."""
    return listed.join(collected.select("item_id").distinct(), "item_id", "left_anti").orderBy(*order).limit(most)


def hot_papers(downloads: DataFrame, catalog: DataFrame, k: int) -> DataFrame:
    """(paper_id, title, downloads): the ``k`` papers with most downloads that are still in the catalogue. Counted before
    the join, so a hot paper is one row in it."""
    counted = downloads.groupBy("paper_id").agg(F.count("*").alias("downloads"))
    return counted.join(catalog.select("paper_id", "title"), "paper_id").orderBy(F.desc("downloads"), "paper_id").limit(k)


def to_crawl(sources: DataFrame, done: DataFrame, word: str = "") -> DataFrame:
    """Schools' own sites under .edu.tw whose name holds ``word`` and that are not completed."""
    rows = sources.filter((F.col("link_type") == "school_web") & F.contains(F.col("url"), F.lit(".edu.tw")) & F.contains(F.col("name"), F.lit(word)))
    return rows.join(done.filter("status = 'completed'").select("url"), "url", "left_anti")


def next_account(accounts: DataFrame, limits: DataFrame) -> DataFrame:
    """(as_of, account, recovers): for each moment asked about the first account by order that is not current and does not
    cool down, else null, and the earliest end of a cooldown among the account's rivals.

    accounts: (as_of, current, account, place); limits: (account, ts, until). The latest limit of the same local day up to the moment
    counts. Moments and limits of an account go in one order, so each row is met once; days are cut into minutes, and what a
    minute begins with is found over the last limits of the minutes before it, so a busy account is dealt to many tasks."""
    keys = ["account", "day", "minute"]
    columns = ["as_of", "current", "account", "place", "at", "limit"]
    asked = accounts.withColumn("at", F.col("as_of")).withColumn("limit", F.lit(None).cast("struct<ts: timestamp, until: timestamp>")).select(columns)
    known = limits.filter("account is not null and ts is not null").select("account", F.col("ts").alias("at"), F.struct("ts", "until").alias("limit"))
    both = asked.unionByName(known, allowMissingColumns=True)
    both = both.withColumn("asks", F.col("limit").isNull()).withColumn("day", F.to_date(F.from_utc_timestamp("at", "Asia/Taipei"))).withColumn("minute", F.floor(F.unix_seconds("at") / 60))
    before = W.partitionBy("account", "day").orderBy("minute").rowsBetween(W.unboundedPreceding, -1)
    begins = both.groupBy(*keys).agg(F.max("limit").alias("last")).select(*keys, F.max("last").over(before).alias("begins")).filter("begins is not null")
    upto = W.partitionBy(*keys).orderBy("at").rangeBetween(W.unboundedPreceding, W.currentRow)
    own = both.withColumn("own", F.max("limit").over(upto)).filter("asks")
    state = own.join(begins, keys, "left").withColumn("until", F.coalesce("own", "begins")["until"])
    cooling = F.col("until") > F.col("as_of")
    free = (F.col("account") != F.col("current")) & ~F.coalesce(cooling, F.lit(False))
    return state.groupBy("as_of", "current").agg(F.min(F.when(free, F.struct("place", "account")))["account"].alias("account"), F.min(F.when(cooling, F.col("until"))).alias("recovers"))


def rehome_plan(parsed: DataFrame, catalog: DataFrame) -> DataFrame:
    """(paper_id, rel_path, new_path, action) of text-pass results over their catalogue rows.

    A blank county or school is taken from the catalogue. db_updated: county and school are those of the path's first
    two folders; no_change: the new path is the old one; skip_target_exists: another file is there; else moved."""
    c = F.col
    fields = ["county", "school_name", "school_year", "school_term", "exam_type", "grade", "subject", "version", "filetype"]
    new = parsed.select("paper_id", *[c(f).alias(f"_{f}") for f in fields if f in parsed.columns])
    rows = catalog.withColumnRenamed("paper_or_daan", "filetype").join(new, "paper_id")
    blank = F.lit("")
    given = lambda f: F.coalesce(F.nullif(c(f"_{f}"), blank), c(f)) if f in ("county", "school_name", "filetype") else (c(f"_{f}") if f in parsed.columns else blank)
    at = {f: given(f) for f in fields}
    made = rows.select("paper_id", "rel_path", *[F.coalesce(x, blank).alias(f) for f, x in at.items()])
    folder = paths.home_folder(c("county"), c("grade"), c("exam_type"), c("subject"))
    name = paths.home_name(*[c(f) for f in ("county", "school_name", "grade", "school_year", "school_term", "exam_type", "subject", "version", "filetype")])
    made = made.withColumn("new_path", F.concat_ws("/", folder, name))
    there = catalog.select(c("rel_path").alias("new_path"), c("paper_id").alias("there"))
    first, second = F.get(F.split("rel_path", "/"), F.lit(0)), F.get(F.split("rel_path", "/"), F.lit(1))
    differs = ((c("county") != "") & (c("county") != first)) | ((c("school_name") != "") & (c("school_name") != second))
    action = F.when(~differs, "db_updated").when(c("new_path") == c("rel_path"), "no_change").when(c("there").isNotNull(), "skip_target_exists").otherwise("moved")
    return made.join(there, "new_path", "left").select("paper_id", "rel_path", "new_path", action.alias("action"))


def county_migration(rows: DataFrame, counties: DataFrame) -> DataFrame:
    """(rel_path, new_path, status): files outside a county's folder move below the county that a lookup gives their school;
    no_county without one, collision for all but the first by path of one target, else move."""
    named = rows.join(counties, "school_name", "left")
    target = F.concat_ws("/", "found_county", F.array_join(F.slice(F.split("rel_path", "/"), 2, 100), "/"))
    new = named.withColumn("new_path", F.when(F.col("found_county").isNotNull(), target))
    place = F.row_number().over(W.partitionBy("new_path").orderBy("rel_path"))
    return new.select("rel_path", "new_path", F.when(F.col("new_path").isNull(), "no_county").when(place > 1, "collision").otherwise("move").alias("status"))


#: Permissions: of an administrator, of an approved user at first and since the shift by one, of all others.
ADMIN, FIRST_APPROVED, APPROVED, REGISTERED = 0, 8, 7, 9


def backfill_permission(users: DataFrame) -> DataFrame:
    """Users (status, is_admin, ...) with the permission that their status means."""
    return users.withColumn("permission", F.when(F.col("is_admin"), ADMIN).when(F.col("status") == "approved", FIRST_APPROVED).otherwise(REGISTERED))


def shift_permission(users: DataFrame) -> DataFrame:
    """An approved user's permission moves from its first value to the present one; others stay."""
    return users.withColumn("permission", F.when(F.col("permission") == FIRST_APPROVED, APPROVED).otherwise(F.col("permission")))


def access_state(events: DataFrame, admins: DataFrame | None = None) -> DataFrame:
    """(user_id, status, permission) after approve, reject, ban, reset and change_permission events in order of time.

    The last event that is no reset decides; a permission of 8 or less means approved, more means pending. A reset after
    it makes the user pending again, unless that event was a ban. Administrators are left out. One aggregate: the last
    event and the last reset are maxima."""
    rows = events if admins is None else events.join(admins.select("user_id"), "user_id", "left_anti")
    when, reset = F.struct("ts", "event_id"), F.col("action") == "reset"
    last = rows.groupBy("user_id").agg(F.max(F.when(~reset, F.struct("ts", "event_id", "action", "permission"))).alias("x"), F.max(F.when(reset, when)).alias("reset"))
    act, given = F.col("x.action"), F.coalesce("x.permission", F.lit(REGISTERED))
    undone = F.col("reset").isNotNull() & (act.isNull() | (F.col("reset") > F.struct("x.ts", "x.event_id"))) & (F.coalesce(act, F.lit("")) != "ban")
    pending = undone | act.isNull() | ((act == "change_permission") & (given > FIRST_APPROVED))
    status = F.when(pending, "pending").when(act == "ban", "banned").when(act == "reject", "rejected").otherwise("approved")
    permission = F.when(undone | act.isNull(), REGISTERED).when(act == "change_permission", given).when(act == "approve", APPROVED).otherwise(REGISTERED)
    return last.select("user_id", status.alias("status"), permission.alias("permission"))


def login_users(users: DataFrame, logins: DataFrame, admins: list[str]) -> DataFrame:
    """Users after logins (google_id, email, ts): a login belongs to the user with its google id, else to the one with its
    first address, else makes one new user for that address; last_login moves, and listed addresses become administrators."""
    one = logins.groupBy("google_id").agg(F.min(F.struct("ts", "email"))["email"].alias("email"), F.max("ts").alias("ts"))
    by_id = one.join(users.select("google_id", F.col("user_id").alias("a")), "google_id", "left")
    who = by_id.join(users.select("email", F.col("user_id").alias("b")), "email", "left").select("google_id", "email", "ts", F.coalesce("a", "b").alias("user_id"))
    seen = who.filter("user_id is not null").groupBy("user_id").agg(F.max("ts").alias("seen"))
    known = users.join(seen, "user_id", "left").select("user_id", "google_id", "email", F.coalesce("seen", "last_login").alias("last_login"), "is_admin")
    new = who.filter("user_id is null").groupBy("email").agg(F.min("google_id").alias("google_id"), F.max("ts").alias("last_login"))
    added = new.select(F.lit(None).cast("long").alias("user_id"), "google_id", "email", "last_login", F.lit(False).alias("is_admin"))
    return known.unionByName(added).withColumn("is_admin", F.col("is_admin") | F.lower("email").isin(*[a.lower() for a in admins]))


def dedupe_names(items: DataFrame) -> DataFrame:
    """Adds unique_name: of one batch's items with one name the first by id keeps it, others get _1, _2 and so on before
    the last dot."""
    n = F.row_number().over(W.partitionBy("batch", "name").orderBy("item_id")) - 1
    mark = F.concat(F.lit("_"), n.cast("string"))
    dotted = F.regexp_extract("name", r"^(.*)(\.[^.]*)$", 1)
    return items.withColumn("unique_name", F.when(n == 0, F.col("name")).when(F.contains("name", F.lit(".")), F.concat(dotted, mark, F.regexp_extract("name", r"^(.*)(\.[^.]*)$", 2))).otherwise(F.concat("name", mark)))


def repeated_requests(events: DataFrame) -> DataFrame:
    """(event_id, user_id, pending): access requests of users who had one pending already."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    return events.filter("action = 'submit_access_request'").withColumn("pending", F.count("*").over(w)).filter("pending > 0").select("event_id", "user_id", "pending")


def source_totals(sources: DataFrame) -> DataFrame:
    """(category, county, n, depth): sources by category and county, by category, and in all."""
    return sources.rollup("category", "county").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("depth"))


def progress(total: DataFrame, collected: DataFrame, per_day: int = 120) -> DataFrame:
    """One row: total, collected, percent, remaining, days at ``per_day`` a day."""
    one = total.agg(F.count("*").alias("total")).join(F.broadcast(collected.agg(F.count_distinct("item_id").alias("collected"))))
    left = F.col("total") - F.col("collected")
    return one.select("total", "collected", F.round(F.col("collected") * 100 / F.col("total"), 1).alias("percent"), left.alias("remaining"), F.ceil(left / per_day).alias("days"))
