"""Streams: incremental ingest of changed files, rolling aggregates of event logs, and stateful matching."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from graphmill.functions import scalars as S
from graphmill.operators import extract as X

#: Incremental passes after which all deferred edges are resolved anew.
HEAL_AFTER = 8


def watch(spark: SparkSession, folder: str, schema: str, source: str = "parquet", per_batch: int = 1000) -> DataFrame:
    """A stream of the files that appear in a folder."""
    return spark.readStream.format(source).schema(schema).option("maxFilesPerTrigger", per_batch).load(folder)


def tumbling(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, span: str = "7 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", span, step), "event_type").agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def log_sink(events: DataFrame, path: str, checkpoint: str):
    """Append a stream to a table of files, exactly once."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def newest(batch: DataFrame) -> DataFrame:
    """(path, content), the last version of each path by mtime, of equally old ones by content; deleted files have no content."""
    at = F.col("mtime") if "mtime" in batch.columns else F.lit(0)
    last = F.max(F.struct(at.alias("at"), F.col("content").isNull().alias("gone"), "content")).alias("last")
    return batch.groupBy("path").agg(last).select("path", "last.content")


class Ingest:
    """Keeps tables of hashes, symbols, deferred edges and edges up to date from micro-batches of files (path, content).

    Of several versions of a path in a batch the newest counts; files whose hash is known are skipped; a file whose
    content is null has been deleted, and all that came from it goes.  Edges that start in or lead to a changed or deleted
    file are made anew, for that file and for the files that refer to it; after HEAL_AFTER batches all are.
    All tables are directories of versions, edges among them: a version is written whole and then named by one
    marker file, which also holds the number of batches since the last full pass.  So a batch that fails half-way
    changes nothing, one that is run twice gives the same tables, readers keep the version that they have opened
    (the last KEEP stay), and a restarted job goes on where it was.
    """

    TABLES = ("hashes", "symbols", "pending", "edges")
    KEEP = 3

    def __init__(self, spark: SparkSession, root: str, project: str, resolve: Callable[[DataFrame, DataFrame], DataFrame] | None = None, publish: Callable[[dict], None] = lambda e: None) -> None:
        """resolve makes edges (project_id, from_id, to_id, kind, ...) of symbols and deferred edges."""
        self.spark, self.root, self.project, self.resolve, self.publish = spark, root.rstrip("/"), project, resolve, publish

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def _versions(self) -> dict[int, int]:
        """Whole versions, and the batches since the last full pass as of each."""
        fs, Path = self._fs()
        if not fs.exists(Path(self.root)):
            return {}
        names = [str(s.getPath().getName()).split("-") for s in fs.listStatus(Path(self.root))]
        return {int(n[1]): int(n[2]) for n in names if n[0] == "done"}

    def version(self) -> int:
        """The last whole version, -1 if there is none."""
        return max(self._versions(), default=-1)

    @property
    def passes(self) -> int:
        return self._versions().get(self.version(), 0)

    def read(self, name: str) -> DataFrame | None:
        v = self.version()
        fs, Path = self._fs()
        there = v >= 0 and fs.exists(Path(f"{self.root}/v{v}/{name}"))
        return self.spark.read.parquet(f"{self.root}/v{v}/{name}") if there else None

    def _edges(self, v: int, touched: DataFrame, full: bool) -> DataFrame:
        """The edges of version v: those of the files that nothing has touched, and the others made anew."""
        symbols, pending = (self.spark.read.parquet(f"{self.root}/v{v}/{n}") for n in ("symbols", "pending"))
        old = None if full else self.read("edges")
        if old is None:
            return self.resolve(symbols, pending)
        path = lambda c: S.file_of_id(F.col(c)).alias("path")
        referring = old.select(path("to_id"), S.file_of_id(F.col("from_id")).alias("referrer")).join(touched, "path", "left_semi").select(F.col("referrer").alias("path"))
        again = touched.union(referring).distinct()
        kept = old.join(again, S.file_of_id(F.col("from_id")) == again.path, "left_anti").join(touched, S.file_of_id(F.col("to_id")) == touched.path, "left_anti")
        new = self.resolve(symbols, pending.join(again, F.col("from_file") == again.path, "left_semi"))
        return kept.select(*new.columns).unionByName(new)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        self.publish({"event": "index_started", "batch": batch_id})
        v, old = self.version(), {n: self.read(n) for n in self.TABLES}
        files = newest(batch).withColumn("hash", F.hex(F.xxhash64("content")))
        gone, there = files.filter("content is null").select("path"), files.filter("content is not null")
        changed = there if old["hashes"] is None else there.join(old["hashes"].select("path", "hash"), ["path", "hash"], "left_anti")
        gone = gone.limit(0) if old["hashes"] is None else gone.join(old["hashes"].select("path"), "path", "left_semi")
        changed, gone = changed.persist(), gone.persist()
        try:
            n, deleted = changed.count(), gone.count()
            passes = self.passes + 1
            heal = passes >= HEAL_AFTER
            if n or deleted:
                touched = changed.select("path").union(gone)
                rows = X.extract(changed)
                new = {"hashes": changed.select("path", "hash"), "symbols": X.symbols_of(rows, self.project), "pending": X.pending_of(rows, self.project)}
                keys = {"hashes": "path", "symbols": "file_path", "pending": "from_file"}
                for name, df in new.items():
                    if old[name] is not None:
                        df = old[name].join(touched.select(F.col("path").alias(keys[name])), keys[name], "left_anti").select(*df.columns).unionByName(df)
                    df.write.mode("overwrite").parquet(f"{self.root}/v{v + 1}/{name}")
                if self.resolve:
                    self._edges(v + 1, touched, heal).write.mode("overwrite").parquet(f"{self.root}/v{v + 1}/edges")
                fs, Path = self._fs()
                fs.create(Path(f"{self.root}/done-{v + 1}-{0 if heal else passes}"), True).close()
                for was, count in sorted(self._versions().items())[: -self.KEEP]:
                    fs.delete(Path(f"{self.root}/done-{was}-{count}"), False)
                    fs.delete(Path(f"{self.root}/v{was}"), True)
        finally:
            changed.unpersist()
            gone.unpersist()
        self.publish({"event": "index_complete", "batch": batch_id, "files": n, "deleted": deleted})

    def sweep(self, files: DataFrame, batch_id: int = -1) -> None:
        """Take files (path, content) for all that there are: what is known and not among them has been deleted."""
        known = self.read("hashes")
        gone = None if known is None else known.join(files.select("path"), "path", "left_anti").select("path", F.lit(None).cast("string").alias("content"))
        own = files.select("path", "content")
        self.apply(own if gone is None else own.unionByName(gone), batch_id)

    def start(self, files: DataFrame, checkpoint: str):
        return files.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


RING = 20


def _canonical(args: str | None) -> dict:
    try:
        return json.loads(args) if args else {}
    except ValueError:
        return {}


def adherence_state(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Advice and calls of one session in order: a call takes the oldest advice on its tool whose arguments it has all of; the last 20 are kept."""
    ring = [tuple(x) for x in json.loads(state.get[0])] if state.exists else []
    rows = pd.concat(list(batches)).sort_values(["at", "seq"], kind="stable")
    out = []
    for r in rows.itertuples(index=False):
        if r.what == "advice":
            ring = [*ring, (r.tool, r.args or "")][-RING:]
        else:
            own = _canonical(r.args)
            hit = next((i for i, (tool, args) in enumerate(ring) if tool == r.tool and _canonical(args).items() <= own.items()), None)
            if hit is not None:
                ring.pop(hit)
            out.append((key[0], r.seq, r.tool, hit is not None))
    state.update((json.dumps(ring),))
    yield pd.DataFrame(out, columns=["session_id", "seq", "tool", "followed"])


def adherence(steps: DataFrame) -> DataFrame:
    """(session_id, seq, tool, followed) of a stream (session_id, at, seq, what, tool, args) of advice and calls."""
    schema = "session_id string, seq long, tool string, followed boolean"
    return steps.groupBy("session_id").applyInPandasWithState(adherence_state, schema, "ring string", "append", GroupStateTimeout.NoTimeout)


def resolved_stream(hooks: DataFrame, calls: DataFrame, within: str = "1 hour") -> DataFrame:
    """Hooks joined with the later calls of their session, up to a time; a hook that no call follows comes out, with nulls, once its time is over."""
    h = hooks.withWatermark("hook_at", within)
    c = calls.withWatermark("call_at", within)
    near = (F.col("h.session_id") == F.col("c.session_id")) & (F.col("call_at") > F.col("hook_at")) & (F.col("call_at") <= F.col("hook_at") + F.expr(f"interval {within}"))
    return h.alias("h").join(c.alias("c"), near, "left_outer").select("h.id", F.col("c.tool").alias("tool"), "hook_at", "call_at")
