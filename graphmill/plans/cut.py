"""Lineage cuts for iterations: written tables in the session's shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_OWN: dict[str, str] = {}
#: Ids that are broadcast take so many bytes at most.
BROADCAST_BYTES = 32 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on one machine only, a temporary folder where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = tempfile.mkdtemp(prefix="graphmill-")
    return _OWN[context.applicationId]


@contextmanager
def freed(spark: SparkSession):
    """Within it, a job's shuffle files are removed when it ends, not when the driver next collects its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """df as a table of files in the shared folder, which survives a lost executor and is read by columns."""
    path = f"{shared_folder(df.sparkSession)}/graphmill-walks/{uuid.uuid4().hex}"
    with freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean_up(spark: SparkSession) -> None:
    """Remove what cut() has written, once no result that reads it is needed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/graphmill-walks")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def is_stored(df: DataFrame) -> bool:
    """Whether df is no more than filters and columns of files, which is as cheap to read again as a copy of it."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = [re.sub(r"^[\s:+-]*", "", line) for line in plan.splitlines() if line.strip()]
    return all(n.startswith(("Project", "Filter", "Relation")) for n in nodes)


def steps_of(df: DataFrame) -> DataFrame:
    """The edges that every level of a walk joins with: read anew where they are stored, so that a level reads what its frontier asks for; else cut once."""
    return df if is_stored(df) else cut(df.distinct())


def read_of(df: DataFrame) -> DataFrame:
    """Edges for walks that do not mind repeated rows: read anew where they are stored, else cut once as they are."""
    return df if is_stored(df) else cut(df)


def drop(table: DataFrame) -> None:
    """Remove the files of a table that cut() has made, and nothing else reads."""
    path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.inputFiles()[0]).getParent()
    path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_side(df: DataFrame, column: str) -> DataFrame:
    """A stored table of ids as the side of a join: broadcast if it is measured to take no more than BROADCAST_BYTES."""
    held = df.agg(F.sum(F.length(column) + 64)).first()[0] or 0
    return F.broadcast(df) if held <= BROADCAST_BYTES else df
