"""Cutting lineage: tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: While a table is written: its shuffle files go when it ends, since what comes later starts from the table; and batches for Python are small, since rows may be long.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset: a folder of our own if all runs on one machine, else an error, since each executor would write to its own disk."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc._conf.get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lattica-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: Rows of a counted table of ids that are sent to all.
SMALL = 20_000


def beside(df: DataFrame, rows: int) -> DataFrame:
    """df for a join: sent to all if its counted rows are few, else shuffled. Spark itself would go by the size of its files, and ids fill a hundred times that in memory."""
    return F.broadcast(df) if rows <= SMALL else df.hint("merge")


@contextmanager
def set_for(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """These settings while something runs."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored_bytes(spark: SparkSession, *paths: str) -> int:
    jvm, conf = spark.sparkContext._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    found = [jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return sum(p.getFileSystem(conf).getContentSummary(p).getLength() for p in found)


def cut(df: DataFrame, name: str = "step", **how: object) -> DataFrame:
    """df written as Parquet and read again: a plan of one scan, which survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with set_for(spark, WRITING):
        df.write.parquet(path, **how)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that `cut` returned. Only for those that no plan reads any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._cut_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
