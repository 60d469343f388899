"""What a graph is worth: unused nodes, coverage, confidence, storage, advisories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.functions import scalars as S

DEAD_KINDS, DEAD_CONFIDENCE = ("Function", "Method"), 0.95
#: Bytes that a symbol, an edge and a full-text row are reckoned to take.
SYMBOL_BYTES, EDGE_BYTES, TEXT_BYTES = 384, 160, 192
FLOOD_COUNT, FLOOD_SHARE = 1000, 0.80
STUCK_CALLS, STUCK_ENTROPY, STUCK_SHARE = 100, 1.0, 0.80
OUTLIER_RATIO, OUTLIER_BYTES = 10, 100 * 1024


def dead_nodes(
    symbols: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = DEAD_KINDS, min_confidence: float = DEAD_CONFIDENCE, interface_methods: DataFrame | None = None,
    language: str | None = None, files: list[str] | None = None, limit: int | None = 100,
) -> DataFrame:
    """Nodes that nothing leads to and that are no entry point, test or export; methods that an interface names are spared."""
    s = symbols.filter(~F.col("is_exported") & ~F.col("is_entry_point") & ~F.col("is_test") & (F.col("extraction_confidence") >= min_confidence) & F.col("kind").isin(list(kinds)))
    s = s.filter(~((F.col("language") == "Go") & F.col("name").isin("init")))
    if language:
        s = s.filter(F.col("language") == language)
    if files:
        s = s.filter(F.col("file_path").isin(files))
    out = s.join(edges.select("project_id", F.col("to_id").alias("id")), ["project_id", "id"], "left_anti")
    if interface_methods is not None:
        named = interface_methods.select("project_id", F.col("method_name").alias("name"), F.lit("Method").alias("kind"))
        out = out.join(named, ["project_id", "name", "kind"], "left_anti")
    return out if limit is None else out.orderBy("file_path", "start_line", "id").limit(limit)


def presentable(dead: DataFrame) -> DataFrame:
    """Without scratch paths, fixtures and functions that a runtime calls."""
    path = F.col("file_path")
    run = (F.col("language") == "Go") & F.col("name").isin("init", "main", "TestMain")
    return dead.filter(~path.rlike("(^|/)scratch/") & ~S.is_fixture_path(path) & ~run)


def audit_unused(symbols: DataFrame, edges: DataFrame, interface_names: DataFrame | None = None, limit: int | None = 100, **filters) -> DataFrame:
    """Dead nodes with how sure that is: high, or medium where an interface may dispatch to a method or extraction was not certain.

    A node with a caller is not dead, so no trace can lower that: there is nothing to walk to from a node without incoming edges.
    """
    out = dead_nodes(symbols, edges, limit=None, **filters)
    dispatch = F.lit(False)
    if interface_names is not None:
        named = interface_names.select(F.lower("method_name").alias("__name"), F.lit(True).alias("__dispatch")).distinct()
        out = out.join(named, F.lower("name") == F.col("__name"), "left")
        dispatch = (F.col("kind") == "Method") & F.coalesce("__dispatch", F.lit(False))
    blind = dispatch | (F.col("extraction_confidence") < 0.95)
    sure = F.when(blind, "medium").otherwise("high")
    rank = F.when(F.col("confidence") == "high", 0).otherwise(1)
    out = out.select("id", "name", "qualified_name", "kind", "file_path", sure.alias("confidence"))
    return out if limit is None else out.orderBy(rank, "qualified_name", "id").limit(limit)


def interface_method_names(symbols: DataFrame) -> DataFrame:
    """Names of methods whose parent is an interface, by its name or its qualified name: two equi-joins, not one with OR."""
    methods = symbols.filter(F.col("kind") == "Method")
    interfaces = symbols.filter(F.col("kind") == "Interface")
    by = [methods.join(interfaces.select("project_id", F.col(c).alias("parent")), ["project_id", "parent"], "left_semi") for c in ("name", "qualified_name")]
    return by[0].union(by[1]).select("project_id", F.col("name").alias("method_name")).distinct()


def graph_stats(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, kind, n): symbols and edges by kind."""
    part = lambda df, what: df.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "kind", "n")
    return part(symbols, "symbol").union(part(edges, "edge"))


def confidence_by_kind(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("kind").agg(F.avg("extraction_confidence").alias("avg_confidence"))


def language_coverage(symbols: DataFrame) -> DataFrame:
    out = symbols.groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.avg("extraction_confidence").alias("avg_confidence"))
    return out.withColumn("parser", F.when(F.col("avg_confidence") >= 0.99, "AST").otherwise("Regex"))


def floor_percentile(values: Column, p: int) -> Column:
    """The value at p * (n - 1) / 100, rounded down, of sorted values."""
    return F.get(values, F.floor(p * (F.size(values) - 1) / 100).cast("int"))


def kind_percentiles(symbols: DataFrame, column: str = "extraction_confidence") -> DataFrame:
    """Exact p10 and p50 by kind.

    Equal values are counted first; the value at a rank is the first whose running count passes it, so what a
    task sorts is the distinct values of a kind, not its rows.
    """
    counts = symbols.filter(F.col(column).isNotNull()).groupBy("kind", F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("kind")
    ranked = counts.withColumn("upto", F.sum("c").over(w.orderBy("v"))).withColumn("n", F.sum("c").over(w))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(p * (F.col("n") - 1) / 100), F.col("v")))
    return ranked.groupBy("kind").agg(F.max("n").alias("n"), at(10).alias("p10"), at(50).alias("p50"))


def symbols_by_file(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("project_id", "file_path").agg(F.count(F.lit(1)).alias("n"))


def storage_estimate(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    count = lambda df, size: df.groupBy("project_id").agg((F.count(F.lit(1)) * size).alias("bytes"))
    parts = count(symbols, SYMBOL_BYTES).union(count(edges, EDGE_BYTES)).union(count(symbols, TEXT_BYTES))
    return parts.groupBy("project_id").agg(F.sum("bytes").alias("bytes"))


def confidence_histogram(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy(S.confidence_bucket(F.col("extraction_confidence")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def parity(extracted: DataFrame, stored: DataFrame) -> DataFrame:
    """Files whose count of extracted symbols differs from the stored one."""
    count = lambda df, name: df.groupBy("file_path").agg(F.count(F.lit(1)).alias(name))
    both = count(extracted, "extracted").join(count(stored, "stored"), "file_path", "full").na.fill(0, ["extracted", "stored"])
    return both.filter("extracted <> stored")


def tool_mix(calls: DataFrame) -> DataFrame:
    """One row: calls, Shannon entropy in bits of the mix of tools, the commonest tool's share, and whether the use is stuck on it."""
    by = calls.groupBy("tool").agg(F.count(F.lit(1)).alias("n"))
    total = by.agg(F.sum("n").alias("calls"))
    p = F.col("n") / F.col("calls")
    out = by.crossJoin(F.broadcast(total)).agg(F.max("calls").alias("calls"), (-F.sum(p * F.log2(p))).alias("entropy"), F.max(p).alias("top_share"))
    return out.withColumn("stuck", (F.col("calls") >= STUCK_CALLS) & (F.col("entropy") < STUCK_ENTROPY) & (F.col("top_share") >= STUCK_SHARE))


def settings_flood(symbols: DataFrame, least: int = FLOOD_COUNT) -> DataFrame:
    """Projects of more than some symbols that are mostly settings."""
    by = symbols.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "Setting").alias("settings"))
    return by.filter((F.col("n") > least) & (F.col("settings") > FLOOD_SHARE * F.col("n")))


def edge_ratio(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges for each symbol by project: near nothing where a project is a ghost."""
    s = symbols.groupBy("project_id").agg(F.count(F.lit(1)).alias("symbols"))
    e = edges.groupBy("project_id").agg(F.count(F.lit(1)).alias("edges"))
    return s.join(e, "project_id", "left").na.fill(0, ["edges"]).withColumn("ratio", F.col("edges") / F.col("symbols"))


def extraction_failures(counts: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files (file_path, bytes) of some size that gave no symbol."""
    return counts.join(symbols.select("file_path").distinct(), "file_path", "left_anti").filter(F.col("bytes") > 256).withColumn("reason", F.lit("no_symbols"))


def projects(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, symbols, edges, ratio, files, languages) of each project."""
    own = symbols.groupBy("project_id").agg(F.countDistinct("file_path").alias("files"), F.countDistinct("language").alias("languages"))
    return edge_ratio(symbols, edges).join(own, "project_id")


#: Edges for each symbol below which a project of some size is a ghost, and the mean confidence below which extraction is in doubt.
GHOST_RATIO, GHOST_SYMBOLS, DOUBTFUL = 0.1, 100, 0.7


def doctor(symbols: DataFrame, edges: DataFrame, flood_from: int = FLOOD_COUNT) -> DataFrame:
    """(project_id, finding, value): projects that are mostly settings, have hardly any edge, or were extracted with little confidence."""
    flood = settings_flood(symbols, flood_from).select("project_id", F.lit("settings_flood").alias("finding"), (F.col("settings") / F.col("n")).alias("value"))
    ghost = edge_ratio(symbols, edges).filter((F.col("symbols") >= GHOST_SYMBOLS) & (F.col("ratio") < GHOST_RATIO)).select("project_id", F.lit("few_edges"), "ratio")
    doubt = symbols.groupBy("project_id").agg(F.avg("extraction_confidence").alias("c")).filter(F.col("c") < DOUBTFUL).select("project_id", F.lit("low_confidence"), "c")
    return flood.union(ghost).union(doubt)


def health(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: projects, symbols, edges and findings."""
    counted = projects(symbols, edges).agg(F.count(F.lit(1)).alias("projects"), F.coalesce(F.sum("symbols"), F.lit(0)).alias("symbols"), F.coalesce(F.sum("edges"), F.lit(0)).alias("edges"))
    return counted.crossJoin(F.broadcast(doctor(symbols, edges).agg(F.count(F.lit(1)).alias("findings"))))
