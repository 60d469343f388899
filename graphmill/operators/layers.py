"""Tables that are kept current by layers: what is new, tombstones by version, and merges by tiers.

Rows belong to keys.  Every change is a version.  It writes one layer with the rows of the keys that are new or different,
and one table of the keys that it replaces or removes; a row of an older layer whose key has a tombstone of a later
version is dead.  Nothing else is written until FANIN layers of one level have come together, which then become one of
the next level, or until dead rows outnumber the living, when all become one.  So a row is written again about
log(versions) / log(FANIN) times, and a reader reads about FANIN layers a level.

How many rows there are, and what they weigh, is added up over layers, less what is dead in them.  A manifest of a few
rows names the files of a version and is written last: readers see a version whole or not at all, and what a failed
attempt left is never read.  One writer at a time.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.plans.cut import freed, small_side

#: Layers of a level that are merged; and the level of a whole table, which changes do not reach.
FANIN, WHOLE = 4, 99
MANIFEST = "kind string, folder string, low long, high long, level int, n long, total long, dead long, dead_total long"


class Layers:
    """Tables below path.  A subclass says what they are: for each its key and the order in which it is written."""

    #: Of each table: the column of its key, and the columns that it is sorted by.
    tables: dict[str, tuple[str, tuple[str, ...]]]
    #: The table whose rows are counted.
    counted: str

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def weight(self) -> Column:
        """What a row of the counted table adds to its layer's total."""
        return F.lit(1)

    # -- files
    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _write(self, df: DataFrame, folder: str, *order: str) -> None:
        sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
        with freed(self.spark):
            sorted_.write.parquet(f"{self.path}/{folder}")

    def _read(self, folder: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{folder}")

    def version(self) -> int:
        """The last version that was written whole."""
        return self._read("manifest").agg(F.max("version")).first()[0]

    def manifest(self, version: int | None = None) -> list[dict]:
        """What a version consists of: a few rows, whatever the tables hold."""
        v = self.version() if version is None else version
        return [r.asDict() for r in self._read("manifest").filter(F.col("version") == v).orderBy("low", "kind").collect()]

    def _publish(self, rows: list[dict], version: int) -> None:
        names = [c.split()[0] for c in MANIFEST.split(", ")]
        table = self.spark.createDataFrame([tuple(r[c] for c in names) for r in rows], MANIFEST)
        table.coalesce(1).write.parquet(f"{self.path}/manifest/version={version}")

    # -- layers
    def _layer(self, tables: dict[str, DataFrame], low: int, high: int, level: int) -> dict:
        folder = f"segments/{uuid.uuid4().hex}"
        for name, (_, order) in self.tables.items():
            self._write(tables[name], f"{folder}/{name}", *order)
        n, total = self._read(f"{folder}/{self.counted}").agg(F.count(F.lit(1)), F.coalesce(F.sum(self.weight()), F.lit(0))).first()
        return {"kind": "segment", "folder": folder, "low": low, "high": high, "level": level, "n": n, "total": total, "dead": 0, "dead_total": 0}

    def _tombstones(self, rows: list[dict]) -> DataFrame | None:
        """(id, until) of keys that a later version replaced: their rows in layers that end before it are dead."""
        oldest = min(r["high"] for r in rows if r["kind"] == "segment")
        tables = [self._read(r["folder"]).select("id", F.lit(r["high"]).alias("at")) for r in rows if r["kind"] == "tombstones" and r["high"] > oldest]
        return reduce(DataFrame.unionByName, tables).groupBy("id").agg(F.max("at").alias("until")) if tables else None

    def _living(self, rows: list[dict], name: str, of: list[dict] | None = None) -> DataFrame:
        """A table over all layers, or some, without what is dead.  Filters go below the join, to the scans."""
        parts = [self._read(f"{r['folder']}/{name}").withColumn("high", F.lit(r["high"])) for r in of or rows if r["kind"] == "segment"]
        table, dead = reduce(DataFrame.unionByName, parts), self._tombstones(rows)
        if dead is not None:
            # Tombstones are broadcast while they are few; beyond that both sides are shuffled by key.
            dead = small_side(dead.withColumnRenamed("id", "dead_id"), "dead_id")
            table = table.join(dead, (F.col(self.tables[name][0]) == F.col("dead_id")) & (F.col("until") > F.col("high")), "left_anti")
        return table

    def living(self, name: str, version: int | None = None) -> DataFrame:
        """The rows of a table in a version, by default the last."""
        return self._living(self.manifest(version), name).drop("high")

    def start(self, tables: dict[str, DataFrame]) -> None:
        """Version 0: all rows as one layer."""
        self._publish([self._layer(tables, 0, 0, WHOLE)], 0)

    def change(self, tables: dict[str, DataFrame] | None, gone: DataFrame | None) -> int:
        """Put tables in the place of the rows of their keys and of those of gone (id), merge what is due; the new version.

        Without gone, the keys that are replaced are those of the counted table.
        """
        rows, version = self.manifest(), self.version() + 1
        if tables is None and gone is None:
            return version - 1
        at = max(r["high"] for r in rows) + 1
        added = self._layer(tables, at, at, 0) if tables else None
        keys = [self._read(f"{added['folder']}/{self.counted}").select(F.col(self.tables[self.counted][0]).alias("id"))] if added else []
        keys += [gone.select("id").filter("id is not null")] if gone is not None else []
        folder = f"tombstones/{uuid.uuid4().hex}"
        self._write(reduce(DataFrame.unionByName, keys).distinct(), folder)
        # What dies now, by layer: the rows that were alive and whose key is among them.
        key = self.tables[self.counted][0]
        died = self._living(rows, self.counted).withColumn("w", self.weight()).join(small_side(self._read(folder).withColumnRenamed("id", key), key), key, "left_semi")
        for r in died.groupBy("high").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("total")).collect():  # one row for each layer
            own = next(x for x in rows if x["kind"] == "segment" and x["high"] == r["high"])
            own["dead"] += r["n"]
            own["dead_total"] += r["total"]
        rows.append({"kind": "tombstones", "folder": folder, "low": at, "high": at, "level": 0, "n": 0, "total": 0, "dead": 0, "dead_total": 0})
        if added:
            rows.append(added)
        while run := due(rows):
            rows = self._merged(rows, run)
        self._publish(rows, version)
        return version

    def _merged(self, rows: list[dict], run: list[dict]) -> list[dict]:
        """Neighbouring layers as one, without what is dead in them; tombstones that no older layer needs are dropped."""
        whole = len(run) == sum(r["kind"] == "segment" for r in rows)
        level = WHOLE if run[0]["level"] == WHOLE else max(r["level"] for r in run) + 1
        new = self._layer({name: self._living(rows, name, run).drop("high") for name in self.tables}, run[0]["low"], run[-1]["high"], level)
        kept = [r for r in rows if r["kind"] == "segment" and r not in run] + [new]
        # What was replaced within the run is gone from it; for older layers its tombstones are as one of its last version.
        stones = [r for r in rows if r["kind"] == "tombstones" and not whole]
        ours = [r for r in stones if new["low"] <= r["high"] <= new["high"]]
        if len(ours) > 1:
            folder = f"tombstones/{uuid.uuid4().hex}"
            self._write(reduce(DataFrame.unionByName, [self._read(r["folder"]) for r in ours]).distinct(), folder)
            stones = [r for r in stones if r not in ours] + [ours[-1] | {"folder": folder, "low": new["low"], "high": new["high"]}]
        return kept + stones

    def rebuild(self) -> int:
        """All layers as one."""
        rows, version = self.manifest(), self.version() + 1
        self._publish(self._merged(rows, [r for r in rows if r["kind"] == "segment"]), version)
        return version

    def fragmentation(self) -> DataFrame:
        """(segments, tombstones, n, dead, dead_share, due): whether the next change will merge, and what it would win."""
        rows = self.manifest()
        segments = [r for r in rows if r["kind"] == "segment"]
        n, dead = sum(r["n"] for r in segments), sum(r["dead"] for r in segments)
        out = (len(segments), len(rows) - len(segments), n - dead, dead, dead / n if n else 0.0, due(rows) is not None)
        return self.spark.createDataFrame([out], "segments int, tombstones int, n long, dead long, dead_share double, due boolean")

    def vacuum(self) -> None:
        """Remove files that the last version does not name: older versions can not be read after it."""
        rows, last = self.manifest(), self.version()
        named = {r["folder"].split("/")[1] for r in rows}
        for top in ("segments", "tombstones"):
            path, fs = self._fs(f"{self.path}/{top}")
            for s in fs.listStatus(path) if fs.exists(path) else ():
                if s.getPath().getName() not in named:
                    fs.delete(s.getPath(), True)
        path, fs = self._fs(f"{self.path}/manifest")
        for s in fs.listStatus(path):
            if s.getPath().getName() != f"version={last}":
                fs.delete(s.getPath(), True)


def due(rows: list[dict]) -> list[dict] | None:
    """The neighbouring layers that are to become one now, oldest first."""
    segments = sorted((r for r in rows if r["kind"] == "segment"), key=lambda r: r["high"])
    if 2 * sum(r["dead"] for r in segments) > sum(r["n"] for r in segments):
        return segments
    newest = [r for r in segments if r["level"] == segments[-1]["level"]]
    return newest if len(newest) >= FANIN else None
