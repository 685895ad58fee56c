"""Streaming forms of the activity and catalogue jobs: streaming DataFrame to streaming DataFrame, or a sink for batches.

State is bounded by watermarks: a window, a session or a key is dropped once the watermark has passed it, and rows that
come later than that are left out. The same functions take batch DataFrames, where a watermark does nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quirelake.operators import catalog as jobs
from quirelake.sources import store
from quirelake.sources.versions import Versions

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def rate_violations(events: DataFrame, actions: list[str], limit: int, window: str = "1 minute", slide: str | None = None, watermark: str = "10 minutes") -> DataFrame:
    """(user_id, starts, ends, n): windows, tumbling or sliding, in which a user acts more often than the limit."""
    rows = events.filter(F.col("action").isin(*actions)).withWatermark("ts", watermark)
    counted = rows.groupBy("user_id", F.window("ts", window, slide).alias("w") if slide else F.window("ts", window).alias("w")).agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") > limit).select("user_id", F.col("w.start").alias("starts"), F.col("w.end").alias("ends"), "n")


def activity(events: DataFrame, window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """(starts, searches, downloads) of each window."""
    rows = events.withWatermark("ts", watermark).groupBy(F.window("ts", window).alias("w"))
    out = rows.agg(F.count_if(F.col("action") == "search").alias("searches"), F.count_if(F.col("action").isin("download", "batch_download")).alias("downloads"))
    return out.select(F.col("w.start").alias("starts"), "searches", "downloads")


def user_sessions(events: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """(user_id, starts, ends, n): runs of a user's events less than ``gap`` apart; ``ends`` is the last event plus the gap."""
    return events.withWatermark("ts", watermark).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("starts"), F.col("w.end").alias("ends"), "n")


def unique_downloads(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Downloads without a user's repeats of a key within the watermark."""
    rows = events.filter(F.col("action").isin("download", "batch_download")).withWatermark("ts", watermark)
    return rows.dropDuplicatesWithinWatermark(["user_id", "key"])


def stream_catalog(listing: DataFrame, root: str, order: list[str] | None = None, most: int = 8) -> Versions:
    """ST1: keeps a catalogue up to date with a streaming listing: each micro-batch is parsed and written as a delta over
    the parts before it (see ``sources.versions``). Runs what is there and returns the versions."""
    versions = Versions(listing.sparkSession, root, order, most)

    def write(batch: DataFrame, number: int) -> None:
        versions.put(jobs.build_catalog(batch, order=order), number)

    with store.shuffles_dropped(listing.sparkSession):  # a batch's go before the next one's are made
        listing.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return versions


def ending(stream: DataFrame, key: str) -> tuple[DataFrame, Callable[[], None]]:
    """The stream of a log, and what ends it: once called, a row of an empty ``key`` and of the year 2200 comes after all others,
    so the watermark passes them; it waits for ever itself."""
    root = store.new_path(stream.sparkSession, "end")
    fixed = {"ts": F.timestamp_seconds(F.lit(7_258_118_400)), key: F.lit("")}
    row = stream.sparkSession.range(1).select(*[fixed.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in stream.schema])
    row.limit(0).write.parquet(root)
    end = stream.sparkSession.readStream.schema(stream.schema).parquet(root)
    return stream.unionByName(end), lambda: row.write.mode("append").parquet(root)


def drained(stream: DataFrame, name: str, mode: str = "append", state_store: str | None = None, end: Callable[[], None] | None = None) -> DataFrame:
    """Runs a stream over all that is there now and returns the rows it gave out, from the shared folder. With ``end``, which
    ends the stream's log, it goes on over that."""
    spark, root = stream.sparkSession, store.new_path(stream.sparkSession, name)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    before = spark.conf.get(PROVIDER)
    if state_store:
        spark.conf.set(PROVIDER, state_store)
    try:
        if mode == "append":
            writer.format("parquet").start(f"{root}/rows").awaitTermination()
            if end:
                end()
                writer.start(f"{root}/rows").awaitTermination()
            return spark.read.schema(stream.schema).parquet(f"{root}/rows")

        def write(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/rows/{number}")

        writer.foreachBatch(write).start().awaitTermination()
        return spark.read.option("recursiveFileLookup", True).schema(StructType([*stream.schema, StructField("batch", IntegerType())])).parquet(f"{root}/rows")
    finally:
        spark.conf.set(PROVIDER, before)


def file_stream(spark: SparkSession, folder: str, name: str, files: int = 8) -> DataFrame:
    """A stream of the Parquet table ``name`` in ``folder``, which is one file or a folder of files."""
    table = spark.read.parquet(f"{folder}/{name}")
    reader = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files)
    if table.inputFiles()[0].endswith(f"/{name}"):
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(f"{folder}/{name}")
