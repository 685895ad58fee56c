"""Readers and writers of the files that the archive's jobs exchange. Paths are folders that Spark's readers reach."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.functions.paths import term_of_title
from quirelake.operators.dump import REPORT
from quirelake.sources import store


def archive_files(spark: SparkSession, root: str) -> DataFrame:
    """IO1: (rel_path, size_kb, mtime) of all papers below a folder; contents are not read. The paths that Spark gives
    begin with the folder's full name, whatever it holds, so what is behind that is the path in the archive. Spark's
    reader skips files of no bytes, so they are not listed."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString().rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    rel = F.substr("path", F.lit(len(whole) + 2))
    return rows.filter(F.lower("path").rlike(r"\.(?:pdf|docx|doc)$")).select(rel.alias("rel_path"), F.floor(F.col("length") / 1024).alias("size_kb"), F.col("modificationTime").alias("mtime"))


def write_files(rows: DataFrame, root: str) -> DataFrame:
    """Rows (rel_path, content binary) as files below a folder that the tasks reach; gives (rel_path, n_bytes). A task that
    runs again writes the same files again."""
    kinds = "rel_path string, n_bytes long"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = fs.FileSystem.from_uri(root)
        for batch in batches:
            sizes = []
            for path, content in zip(batch.column("rel_path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                system.create_dir(f"{folder}/{path}".rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(f"{folder}/{path}") as out:
                    out.write(content)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([batch.column("rel_path"), pa.array(sizes, pa.int64())], names=["rel_path", "n_bytes"])

    return rows.select("rel_path", "content").mapInArrow(write, kinds)


def read_items(spark: SparkSession, path: str, field: str = "items", schema: str | None = None) -> DataFrame:
    """IO2, IO7, IO11: the rows of the array ``field`` of JSON documents; without one, the documents themselves."""
    reader = spark.read.option("multiLine", True)
    rows = (reader.schema(f"{field} array<struct<{schema}>>") if schema else reader).json(path)
    return rows.selectExpr(f"inline({field})") if field in rows.columns else rows


def read_search_response(responses: DataFrame, fields: str = "title string, fileid long, filetype string, school_term string") -> DataFrame:
    """IO13: responses (body) to items: the array under list, data, results or items, whichever is first; a missing term
    is inferred from the title."""
    names = ["list", "data", "results", "items"]
    item = ", ".join(": ".join(f.split()) for f in fields.split(","))
    parsed = F.from_json("body", ", ".join(f"{n} array<struct<{item}>>" for n in names))
    items = responses.select(F.explode(F.coalesce(*[parsed[n] for n in names])).alias("item")).select("item.*")
    return items.withColumn("school_term", F.coalesce(F.nullif("school_term", F.lit("")), term_of_title(F.col("title")), F.lit("")))


def write_report(classified: DataFrame, path: str, kind: str = "csv") -> None:
    """IO4: a classified dump as CSV with a header, or as JSON; gzip takes a tenth of the text's room, and readers know it by the
    files' endings."""
    with store.shuffles_dropped(classified.sparkSession):
        writer = classified.select(*REPORT).write.mode("errorifexists").option("compression", "gzip")
        writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """IO4: the CSV of a classified dump; blank fields stay blank."""
    return spark.read.option("header", True).option("emptyValue", "").schema(", ".join(f"{c} {'long' if c == 'size_kb' else 'string'}" for c in REPORT)).csv(path).fillna("")


def write_rows(rows: DataFrame, path: str) -> None:
    """IO5, IO6, IO10: differences, quarantined rows or audit rows as CSV with a header."""
    rows.write.mode("errorifexists").option("header", True).csv(path)


def audit_export(events: DataFrame, user_id: int | None = None, action: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """IO10: audit rows of a user, an action and a span of time, each where given."""
    rows = events
    for value, cond in ((user_id, F.col("user_id") == user_id), (action, F.col("action") == action), (since, F.col("ts") >= F.to_timestamp(F.lit(since))), (until, F.col("ts") < F.to_timestamp(F.lit(until)))):
        rows = rows if value is None else rows.filter(cond)
    return rows


def quarantine(diffs: DataFrame, rows: DataFrame, previews: DataFrame) -> DataFrame:
    """IO5: (paper_id, rel_path, field, db_val, ocr_val, preview) of differences in county or school; previews (paper_id,
    text) are cut at 200 characters."""
    some = diffs.filter(F.col("field").isin("county", "school_name"))
    wide = some.join(rows.select("paper_id", "rel_path"), "paper_id").join(previews.select("paper_id", F.substring("text", 1, 200).alias("preview")), "paper_id", "left")
    return wide.select("paper_id", "rel_path", "field", F.col("old").alias("db_val"), F.col("new").alias("ocr_val"), "preview")


def school_snapshot(rows: DataFrame) -> DataFrame:
    """IO12: (county, schools): each county's schools with their numbers of files and a path, by name."""
    each = rows.filter("school_name is not null").groupBy("county", "school_name").agg(F.count("*").alias("count"), F.min("rel_path").alias("path"))
    return each.groupBy("county").agg(F.sort_array(F.collect_list(F.struct(F.col("school_name").alias("name"), "count", "path"))).alias("schools"))
