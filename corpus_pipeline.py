"""The corpus pipeline: toxicity, line dedup, n-gram Jaccard join, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm import decontaminate, jaccard_join, line_dedup, packing, toxicity
from quirelake.llm._spark import written
from quirelake.llm.registry import TOKENIZER, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network scores at or above its threshold go; a null or wordless text scores 0 and stays."""
    params = toxicity.train(*toxicity.sample(docs, table(spark, sf_dir, "labels"), "doc_id", "text"))
    return toxicity.reject(docs, params)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go from all of them; n_chars follows the text."""
    kept = line_dedup.drop_common_lines(docs, min_docs=10, min_chars=1, counts=None)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at Jaccard 0.8 or more, the one with the smallest id stays; of
    repeated rows of one id, all or none. Texts without words are linked with nothing and stay."""
    found = jaccard_join.jaccard_components(docs, k=5, threshold=Fraction(4, 5))
    gone = found.filter("component_id is not null and component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, exactly or edited, go."""
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids."""
    return packing.pack(packing.cut(docs, TOKENIZER, 2048), 2048)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_lines),
    ("jaccard_join", one_of_each_group),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: A trained network and a tokenizer are beyond SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
