"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows in an Arrow batch: bounds a Python worker's memory where texts are long.
BATCH_ROWS = 512
#: Characters of a plan's text: operators of many jobs would fill the driver with these texts.
PLAN_CHARS = 20_000
_scopes: list[list[str]] = []


def tuned(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches that go to Python workers, and the texts of plans that the driver keeps of each job."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.maxPlanStringLength", str(PLAN_CHARS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a local folder if all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="trellis-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/trellis-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and reread it.

    The plan above starts from files that survive the loss of any executor,
    and whatever was not deterministic below is now fixed.
    """
    spark = df.sparkSession
    path = new_dir(spark, name)
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that are staged within are deleted at its end: what leaves it must have been written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


def drop(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    remove(df.sparkSession, df.staged_path)


def free_name(names: list[str], wanted: str) -> str:
    """``wanted``, lengthened while a column has that name."""
    while wanted.lower() in {n.lower() for n in names}:
        wanted += "_"
    return wanted


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
