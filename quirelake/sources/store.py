"""Where tables rest between jobs: a folder that driver and executors share, and catalogues written there."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local master may do without and gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quirelake-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _statuses(source: DataFrame) -> list[tuple[str, int, int]]:
    """Name, size and time of change of a table's files. Names come from the plan, the rest from the file system; contents are
    not read."""
    spark, told = source.sparkSession, []
    for name in sorted(source.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        told.append((name, status.getLen(), status.getModificationTime()))
    return told


def fingerprint(source: DataFrame) -> str:
    """What tells a table's files from changed ones: their names, sizes and times of change."""
    return hashlib.sha256("\n".join(f"{name} {size} {at}" for name, size, at in _statuses(source)).encode()).hexdigest()


def n_bytes(source: DataFrame) -> int:
    """The size of a table's files."""
    return sum(size for _, size, _ in _statuses(source))


def is_there(spark: SparkSession, path: str) -> bool:
    """Whether a written table is whole."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


#: Whether Spark drops an execution's shuffle files when it ends; else they lie there until the driver collects its garbage,
#: which the size of the data does not bring about.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """For tables that are written once and read from their files: what is run inside leaves no shuffle files."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, True)
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def kept(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written in the shared folder and read again: what came before is not computed twice, nor lost with an executor."""
    path = new_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def write_catalog(rows: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """IO3: the catalogue as Parquet, each file in the order of county and school, so that a search for one county skips
    the row groups of the others by their least and greatest values. Returns the rows as they are read back."""
    with shuffles_dropped(rows.sparkSession):
        rows.sortWithinPartitions("county", "school_name").write.mode(mode).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
