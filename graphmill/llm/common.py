"""Plumbing shared by the training-data operators: shared folder, written tables, worker imports, hot keys."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = Path(__file__).resolve().parents[2]
#: A side of a join is broadcast only when its rows are measured to take no more bytes than this.
BROADCAST_BYTES = 32 << 20
#: Rank of a null doc_id; ids are below it.
LAST = (1 << 63) - 1
#: What tells rows apart: the rank of the id, and two digests of the text.
KEY = ["rank", "t0", "t1"]
#: Rows of an Arrow batch between Spark and a Python worker.
BATCH_ROWS = 1_000
_OWN_DIRS: dict[str, str] = {}
#: What Python workers remember between tasks, by operator.
_CACHES: dict[str, list[dict]] = {}


def exclusive(operator: str, *caches: dict) -> None:
    """Called by a worker at the start of a task: what other operators remembered in this worker is let go."""
    _CACHES[operator] = list(caches)
    for name, held in _CACHES.items():
        if name != operator:
            for c in held:
                c.clear()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on one machine only, a temporary one where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.partition("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="graphmill-")
    return _OWN_DIRS[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/graphmill/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, **options: int) -> DataFrame:
    """Write df as Parquet in the shared folder, with options of the writer, and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(df: DataFrame) -> None:
    """Remove the files of a table that materialize() wrote and that nothing reads any more."""
    for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/graphmill/" in root:
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clean_up(spark: SparkSession) -> None:
    """Remove all tables and files that operators have written in the shared folder, once no result that reads them is needed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/graphmill")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def workers_can_import(spark: SparkSession) -> None:
    """Send the package to Python workers that would not find it by PYTHONPATH or the working folder."""
    on_path = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    sc = spark.sparkContext
    if str(ROOT) in on_path or os.path.realpath(os.getcwd()) == str(ROOT) or getattr(sc, "_graphmill_sent", False):
        return
    target = Path(tempfile.mkdtemp(prefix="graphmill-")) / "graphmill_pkg.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in (ROOT / "graphmill").rglob("*.py"):
            z.write(f, f.relative_to(ROOT))
    sc.addPyFile(str(target))
    sc._graphmill_sent = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, func: Callable, schema: str) -> DataFrame:
    """mapInArrow with batches of few rows, as rows hold whole texts; the session keeps that batch size."""
    workers_can_import(df.sparkSession)
    if not 0 < int(df.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(func, schema)


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """The columns KEY: rows of one id with different texts differ in them, rows that are equal in both do not."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("rank"), F.xxhash64(t).alias("t0"), F.xxhash64(F.lit(1), t).alias("t1")]


def _width(value: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 16
    if isinstance(kind, T.StructType):
        parts = [_width(value[f.name], f.dataType) for f in kind]
        return functools.reduce(Column.__add__, parts, F.lit(16).cast("long"))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StringType | T.BinaryType | T.StructType | T.ArrayType):
            return F.coalesce(F.aggregate(value, F.lit(16).cast("long"), lambda n, x: n + _width(x, kind.elementType)), F.lit(16).cast("long"))
        return F.greatest(F.size(value), F.lit(0)).cast("long") * 8 + 16
    return F.lit(8).cast("long")


def measured_bytes(df: DataFrame) -> int:
    """About how many bytes all rows of df take, by one aggregation."""
    width = functools.reduce(Column.__add__, [_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema])
    return df.agg(F.sum(width + 32)).first()[0] or 0


def fits_broadcast(df: DataFrame) -> bool:
    """Whether all rows of df take no more than BROADCAST_BYTES, as measured."""
    return measured_bytes(df) <= BROADCAST_BYTES


#: Keys that hold more than one row in so many, and more rows than a floor, are hot: at most HOT of them, whatever the input.
HOT, HOT_FLOOR, SPREAD = 256, 1_000, 64


def hot_keys(counted: DataFrame, keys: list[str], n: str) -> DataFrame:
    total = counted.agg(F.sum(n).alias("__total"))
    common = counted.crossJoin(F.broadcast(total)).filter((F.col(n) > HOT_FLOOR) & (F.col(n) * HOT > F.col("__total")))
    return common.select(*keys, F.lit(True).alias("__hot"))


def keyed_join(rows: DataFrame, facts: DataFrame, keys: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """Join rows with facts, one for each key, by a shuffle in which the rows of each hot key go to SPREAD places.

    hot: (keys, __hot), bounded as above and so broadcast; the facts of hot keys are copied to all places.
    """
    own = [f.name for f in rows.schema if f.name not in keys and not isinstance(f.dataType, T.ArrayType | T.StringType | T.BinaryType)]
    zero = F.lit(0).cast("long")
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*keys, *own), F.lit(SPREAD).cast("long"))).otherwise(zero)
    places = F.when(F.col("__hot"), F.sequence(zero, F.lit(SPREAD - 1).cast("long"))).otherwise(F.array(zero))
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn("__salt", salt).drop("__hot")
    copies = facts.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.explode(places)).drop("__hot")
    return salted.join(copies, [*keys, "__salt"], how).drop("__salt")


def counted_join(rows: DataFrame, facts: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Inner keyed_join() with facts that know, in column n, how many rows have their key."""
    return keyed_join(rows, facts, keys, hot_keys(facts, keys, n))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def empty_if_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def lookup_join(rows: DataFrame, facts: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join rows, in which a key may be very common, with a few facts, one for each key: broadcast once they are measured to be few.

    Beyond that both sides are shuffled, by keyed_join().
    """
    if fits_broadcast(facts):
        return rows.join(F.broadcast(facts), keys, how)
    hot = materialize(hot_keys(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")), keys, "__n"), "hot")
    return keyed_join(rows, facts, keys, hot, how)
