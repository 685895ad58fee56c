"""Operator 6: lines found in many documents are dropped. DataFrame functions only.

Lines are exploded with their positions and hashed, distinct documents are counted for each hash, and the positions
of lines over the threshold go back to their documents. Only hashes and positions are shuffled before the last join.

Defined results: null text is an empty text; an empty text is one empty line; a document of which all lines go
keeps an empty text; rows that repeat a doc_id count as one document; a null doc_id is one document of its own;
an empty table stays empty; other columns are kept, whatever their names: the counts are added under ``counts`` only
where these names are free (a clash raises ValueError), and not at all where it is None.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm._spark import spread_join, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\f\r"


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, nothing else; the fast lower() where a string has ASCII characters only."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, doc_id: str = "doc_id", text: str = "text", counts: tuple[str, str] | None = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with ``text`` replaced by its other lines and, under the names in ``counts``, its numbers of lines and of
    dropped lines."""
    if counts and set(counts) & set(docs.columns):
        raise ValueError(f"columns {counts} are there already: name others or none")
    body = F.coalesce(F.col(text), F.lit(""))
    found = (
        docs.select(F.col(doc_id).alias("id"), F.xxhash64(body).alias("of"), F.posexplode(F.split(body, "\n")).alias("pos", "line"))
        .select("id", "of", "pos", line_key(F.col("line")).alias("key"))
        .filter(F.length("key") >= min_chars)
        .select("id", "of", "pos", F.md5("key").alias("hash"))
    )
    found = written(found, "lines")  # texts are taken apart once; what follows reads hashes and positions
    common = found.groupBy("hash").agg(F.count_distinct(F.struct("id")).alias("n"), F.count("*").alias("rows")).filter(F.col("n") >= min_docs).select("hash", "rows")
    gone = spread_join(found, written(common, "common-lines"), ["hash"], "rows", ["id", "of", "pos"]).groupBy("id", "of").agg(F.collect_set("pos").alias("gone"))
    gone = gone.select(F.struct("id", "of").alias("gone_of"), "gone")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.struct(F.col(doc_id).alias("id"), F.xxhash64(body).alias("of")).alias("key"))
    lines = F.split(F.coalesce(F.col("row").getField(text), F.lit("")), "\n")
    joined = rows.join(gone, F.col("key").eqNullSafe(F.col("gone_of")), "left").select("row", "gone", F.coalesce(F.size("gone"), F.lit(0)).alias("n_gone"))
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone")), lambda i: F.get(lines, i)), "\n")
    # a text of which nothing goes is not taken apart
    new = F.when(F.col("n_gone") == 0, F.coalesce(F.col("row").getField(text), F.lit(""))).otherwise(kept)
    columns = [new.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns]
    sizes = [F.size(lines).cast("long"), F.col("n_gone").cast("long")]
    return joined.select(*columns, *[c.alias(n) for c, n in zip(sizes, counts or (), strict=False)])
