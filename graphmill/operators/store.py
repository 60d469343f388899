"""Tables of the graph store as DataFrames: lookups, upserts, edge replacement, deletion, redirects, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.functions import scalars as S


def by_ids(symbols: DataFrame, ids: list[str], project: str | None = None) -> DataFrame:
    out = symbols.filter(F.col("id").isin(ids))
    return out if project is None else out.filter(F.col("project_id") == project)


def by_name(symbols: DataFrame, name: str, limit: int) -> DataFrame:
    return symbols.filter(F.col("name") == name).orderBy("id").limit(limit)


def by_column(symbols: DataFrame, column: str, value: str) -> DataFrame:
    return symbols.filter(F.col(column) == value).orderBy("start_byte", "id")


def by_qualified_name(symbols: DataFrame) -> DataFrame:
    """Nodes that share a qualified name, as a sorted list of ids."""
    return symbols.groupBy("project_id", "qualified_name").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def edges_of(edges: DataFrame, column: str, node: str, kinds: list[str] | None = None) -> DataFrame:
    out = edges.filter(F.col(column) == node)
    return out.filter(F.col("kind").isin(kinds)) if kinds else out


def call_pairs(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("kind") == "CALLS").select("from_id", "to_id")


def files_of(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("project_id", "file_path").agg(F.count(F.lit(1)).alias("n_symbols"), F.max("file_hash").alias("file_hash"))


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """current with the rows of changes in place of those with the same keys; of several changes the last by `order` wins.

    Untouched rows are passed on by an anti join: only keys are compared, and the table is not sorted.
    """
    if order is not None:
        last = Window.partitionBy(*keys).orderBy(F.col(order).desc())
        changes = changes.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n", order)
    else:
        changes = changes.dropDuplicates(keys)
    return current.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


EDGE_KEYS = ["project_id", "from_id", "to_id", "kind"]


def insert_edges(current: DataFrame, new: DataFrame) -> DataFrame:
    """current with those of new whose key it lacks; provenance tiers are put in order, empty properties become null."""
    new = new.dropDuplicates(EDGE_KEYS)
    if "provenance_tier" in new.columns:
        new = new.withColumn("provenance_tier", S.provenance_tier(F.col("provenance_tier")))
    if "properties" in new.columns:
        new = new.withColumn("properties", F.when(~F.col("properties").isin("", "{}", "null"), F.col("properties")))
    return current.unionByName(new.join(current.select(*EDGE_KEYS), EDGE_KEYS, "left_anti"))


def replace_edges(current: DataFrame, kind: str, source: str, new: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """current with all edges of a kind and source, or those that start in some files (file_path), replaced by new."""
    gone = (F.col("kind") == kind) & (F.col("source") == source)
    if files is None:
        kept = current.filter(~gone)
    else:
        marked = current.withColumn("file_path", S.file_of_id(F.col("from_id"))).join(files.select("file_path", F.lit(True).alias("__in")).distinct(), "file_path", "left")
        kept = marked.filter(~(gone & F.coalesce("__in", F.lit(False)))).select(*current.columns)
    return insert_edges(kept, new)


def delete_file(symbols: DataFrame, edges: DataFrame, files: DataFrame, *members: DataFrame) -> tuple[DataFrame, ...]:
    """Symbols and edges without those of some files (project_id, file_path); edges go with either end.

    members: tables of what symbols hold (fields of structs, methods of interfaces), by project_id and file_path; theirs go too.
    """
    gone = symbols.join(files, ["project_id", "file_path"], "left_semi").select("project_id", "id")
    kept = symbols.join(files, ["project_id", "file_path"], "left_anti")
    for end in ("from_id", "to_id"):
        edges = edges.join(gone.withColumnRenamed("id", end), ["project_id", end], "left_anti")
    return kept, edges, *[m.join(files, ["project_id", "file_path"], "left_anti") for m in members]


def replace_members(current: DataFrame, new: DataFrame, files: DataFrame) -> DataFrame:
    """Members of symbols, with those of some files (project_id, file_path) replaced by new ones, which may be none."""
    return current.join(files, ["project_id", "file_path"], "left_anti").unionByName(new)


def resolve_stale(ids: DataFrame, moves: DataFrame) -> DataFrame:
    """ids (project_id, id) with `current`, the id that a move (project_id, old_id, new_id) gave it."""
    m = moves.select("project_id", F.col("old_id").alias("id"), "new_id")
    return ids.join(m, ["project_id", "id"], "left").withColumn("current", F.coalesce("new_id", "id")).drop("new_id")


def detect_moves(before: DataFrame, after: DataFrame) -> DataFrame:
    """(project_id, old_id, new_id) of nodes with the same name and kind and another id, whose old id is gone."""
    keys = ["project_id", "qualified_name", "kind"]
    old = before.select(*keys, F.col("id").alias("old_id")).join(after.select("project_id", F.col("id").alias("old_id")), ["project_id", "old_id"], "left_anti")
    new = after.select(*keys, F.col("id").alias("new_id")).join(before.select("project_id", F.col("id").alias("new_id")), ["project_id", "new_id"], "left_anti")
    return old.join(new, keys).groupBy("project_id", "old_id").agg(F.min("new_id").alias("new_id"))


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> tuple[DataFrame, int, bool]:
    """A page of df in a total order, how many rows there are, and whether more follow."""
    total = df.count()
    return df.orderBy(*order).offset(offset).limit(limit), total, offset + limit < total


def filter_projects(projects: DataFrame, min_edges: int = 0, active_since: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Projects (alive, last_active, edges) that pass, and one row of how many were dropped for which reason."""
    inactive = F.lit(False) if active_since is None else F.col("last_active") < active_since
    reason = F.when(~F.col("alive"), "dead_path").when(inactive, "inactive").when(F.col("edges") < min_edges, "few_edges")
    marked = projects.withColumn("__drop", reason)
    drops = marked.agg(*[F.count_if(F.col("__drop") == r).alias(r) for r in ("dead_path", "inactive", "few_edges")])
    return marked.filter("__drop is null").drop("__drop"), drops


def decisions(current: DataFrame, project: str, key: str | None = None) -> DataFrame:
    """The decisions of a project in order of their keys, or the one of a key."""
    own = current.filter(F.col("project_id") == project)
    return (own if key is None else own.filter(F.col("key") == key)).orderBy("key")


def delete_decisions(current: DataFrame, gone: DataFrame) -> DataFrame:
    """current without the decisions of some keys (project_id, key)."""
    return current.join(gone.select("project_id", "key"), ["project_id", "key"], "left_anti")


def fields(df: DataFrame, names: list[str] | None) -> DataFrame:
    """Only the named columns, in that order; names that df has not are left out, and without any name all stay."""
    kept = [n for n in names or [] if n in df.columns]
    return df.select(*kept) if kept else df


def set_decisions(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Key-value decisions (project_id, key, value), changes last."""
    return upsert(current, changes, ["project_id", "key"])


def _remove(df: DataFrame, path: str, **folder: str) -> None:
    """Delete a folder of a partitioned table."""
    jvm = df.sparkSession._jvm
    at = jvm.org.apache.hadoop.fs.Path("/".join([path.rstrip("/"), *(f"{k}={jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(v)}" for k, v in folder.items())]))
    at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def write_symbols(symbols: DataFrame, path: str, projects: list[str] | None = None) -> None:
    """Symbols in folders by project; the projects that symbols holds are replaced, and those named that it has no row of are emptied."""
    for p in sorted(set(projects or []) - {r[0] for r in symbols.select("project_id").distinct().collect()} if projects else ()):
        _remove(symbols, path, project_id=p)
    symbols.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(path)


def write_edges(edges: DataFrame, path: str, replaces: list[tuple[str, str, str]] | None = None) -> None:
    """Edges in folders by project, kind and source, sorted by where they start; the folders that edges fills are replaced.

    replaces: (project, kind, source) of folders that this write stands for; one that it has no row for is emptied.
    A walk over one kind reads that kind's folders, and a lookup by from_id skips row groups.
    """
    if replaces:
        filled = {tuple(r) for r in edges.select("project_id", "kind", "source").distinct().collect()}
        for p, k, s in sorted(set(replaces) - filled):
            _remove(edges, path, project_id=p, kind=k, source=s)
    ordered = edges.repartitionByRange("project_id", "kind", "source", "from_id").sortWithinPartitions("project_id", "kind", "source", "from_id")
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id", "kind", "source").parquet(path)
