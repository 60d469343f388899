"""Graph operators: trace, closure, call flow, degrees, cross-package connections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.functions import scalars as S
from graphmill.operators import lists as L
from graphmill.operators.paths import kind_index, levels, numbered, reached, reversed_edges, spread
from graphmill.plans.cut import cut, drop, read_of, steps_of
from graphmill.schema import CALL_FAMILY

MOST_HOPS_TRACED, TRACE_DEFAULT, TRACE_LIMIT = 5, 3, 500
CLOSURE_DEFAULT, CLOSURE_MOST = 3, 8
#: From so many direct callers on a trace stays shallow.
BUSY = 5
DIRECTIONS = {
    **dict.fromkeys(("in", "inbound", "callers", "upstream", "incoming", "up"), "in"),
    **dict.fromkeys(("out", "outbound", "callees", "downstream", "outgoing", "down"), "out"),
    **dict.fromkeys(("both", "all", "any", ""), "both"),
}


def direction_of(name: str) -> str:
    try:
        return DIRECTIONS[name.lower()]
    except KeyError:
        raise ValueError(f"unknown direction {name!r}: in, out or both") from None


def trace_depth(depth: int) -> int:
    return depth if 1 <= depth <= MOST_HOPS_TRACED else TRACE_DEFAULT


def _walk_with_kinds(edges: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """(start, node, depth, via): least depth, and of the last edges of all walks the kind that sorts first.

    A node has a walk of d edges whose last has a given kind if some node that a walk of d - 1 edges reaches
    has such an edge to it; so levels need no more than (start, node), distinct.
    """
    steps = steps_of(edges.select(F.col("from_id").alias("__from"), F.col("to_id").alias("__to"), F.col("kind").alias("via")))
    front, found = starts.select("start", F.col("start").alias("node")).distinct(), None
    for depth in range(1, most + 1):
        level = front.join(steps, F.col("node") == F.col("__from")).groupBy("start", F.col("__to").alias("node")).agg(F.min("via").alias("via"))
        level = cut(level)
        if level.isEmpty():
            break
        tagged = level.withColumn("depth", F.lit(depth))
        found = tagged if found is None else found.unionByName(tagged)
        front = level.select("start", "node")
    if found is None:
        return starts.sparkSession.createDataFrame([], "start string, node string, depth int, via string")
    return found.filter("start <> node").groupBy("start", "node").agg(F.min("depth").alias("depth"), F.min("via").alias("via"))


def trace(edges: DataFrame, starts: DataFrame, direction: str = "in", depth: int = TRACE_DEFAULT, kinds: tuple[str, ...] = CALL_FAMILY) -> DataFrame:
    """(start, node, depth, via, risk) of all that calls, or is called by, each start; `both` keeps the nearer way."""
    way, most = direction_of(direction), trace_depth(depth)
    e = edges.filter(F.col("kind").isin(list(kinds))).select("from_id", "to_id", "kind")
    parts = []
    if way in ("in", "both"):
        parts.append(_walk_with_kinds(reversed_edges(e), starts, most))
    if way in ("out", "both"):
        parts.append(_walk_with_kinds(e, starts, most))
    out = parts[0]
    if len(parts) == 2:
        out = out.unionByName(parts[1]).groupBy("start", "node").agg(F.min("depth").alias("depth"), F.min_by("via", F.struct("depth", "via")).alias("via"))
    return out.withColumn("risk", S.risk_label(F.col("depth")))


def auto_depth(edges: DataFrame, start: str, depth: int | None = None) -> int:
    """The depth asked for; else 1 for a node with many direct callers, else the default."""
    if depth is not None:
        return trace_depth(depth)
    callers = edges.filter((F.col("to_id") == start) & F.col("kind").isin(list(CALL_FAMILY))).select("from_id").distinct().limit(BUSY).count()
    return 1 if callers >= BUSY else TRACE_DEFAULT


def hops(traced: DataFrame, symbols: DataFrame, include_tests: bool = False, limit: int | None = TRACE_LIMIT) -> DataFrame:
    """Traced nodes with their names; tests and fixtures are left out by default."""
    s = symbols.select(F.col("id").alias("node"), "name", "kind", "file_path", "start_line", "is_test")
    out = traced.join(s, "node")
    if not include_tests:
        out = out.filter(~F.col("is_test") & ~S.is_test_file(F.col("file_path")) & ~S.is_fixture_path(F.col("file_path")))
    out = out.drop("is_test")
    return out if limit is None else out.orderBy("start", "depth", "node").limit(limit)


def trace_counts(traced: DataFrame) -> DataFrame:
    """How many nodes there are at each depth, with its risk."""
    return traced.groupBy("start", "depth", "risk").agg(F.count(F.lit(1)).alias("n"))


def ditto(rows: DataFrame, column: str, order: list[str], mark: str = '"') -> DataFrame:
    """A column whose value is that of the row before becomes a ditto mark."""
    w = Window.partitionBy("start").orderBy(*order)
    return rows.withColumn(column, F.when(F.lag(column).over(w) == F.col(column), mark).otherwise(F.col(column)))


def trace_candidates(symbols: DataFrame, name: str, limit: int = 50) -> DataFrame:
    """Nodes that a name may mean: production before tests before fixtures, then functions, methods, classes and the rest."""
    path = F.col("file_path")
    place = F.when(S.is_fixture_path(path), 2).when(S.is_test_file(path) | F.col("is_test") | path.rlike("(^|/)scratch/"), 1).otherwise(0)
    rank = F.when(F.col("kind") == "Function", 0).when(F.col("kind") == "Method", 1).when(F.col("kind") == "Class", 2).otherwise(3)
    return symbols.filter(F.col("name") == name).withColumn("place", place).withColumn("rank", rank).orderBy("place", "rank", "id").limit(limit).drop("place", "rank")


def closure(edges: DataFrame, depth: int = CLOSURE_DEFAULT, kinds: tuple[str, ...] = CALL_FAMILY, starts: DataFrame | None = None) -> DataFrame:
    """(from_id, to_id, depth, via_kind) of all pairs up to a depth; via_kind is that of the last edge of a shortest walk.

    starts (id): only pairs that begin there, for a part of the closure to be made anew.
    """
    most = max(1, min(depth, CLOSURE_MOST)) if depth > 0 else CLOSURE_DEFAULT
    called = edges.filter(F.col("kind").isin(list(kinds)) & F.col("to_id").isNotNull())
    calls = called.select(F.col("from_id").alias("__from"), F.col("to_id").alias("__to"), F.col("kind").alias("via"))
    steps = read_of(calls)
    begin = None if starts is None else starts.select(F.col("id").alias("start"))
    lists = L.lists_of(steps, begin, most, kind_index(kinds))
    if lists is not None:
        if steps is not calls:
            drop(steps)
        via = F.coalesce(*[F.when(F.col("k") == i, k) for i, k in enumerate(sorted(set(kinds)))])
        return lists.rows().select(F.col("start").alias("from_id"), F.col("node").alias("to_id"), "depth", via.alias("via_kind"))
    known = numbered(steps.select(F.col("__from").alias("start")) if begin is None else begin)
    found = levels(steps, known, 1, most, kinds)
    if found is None:
        return edges.sparkSession.createDataFrame([], "from_id string, to_id string, depth int, via_kind string")
    bits = [f"new{i}" for i in range(len(set(kinds)))]
    via = F.coalesce(*[F.when(F.col(b).bitwiseAND(F.col("bit")) != 0, k) for b, k in zip(bits, sorted(set(kinds)), strict=True)])
    return spread(found, known, *bits).select(F.col("start").alias("from_id"), F.col("node").alias("to_id"), "depth", via.alias("via_kind"))


def closure_lookup(table: DataFrame, start: str, direction: str = "out", depth: int = CLOSURE_DEFAULT, limit: int | None = TRACE_LIMIT) -> DataFrame:
    """A trace read from a closure table."""
    way = direction_of(direction)
    own = table.filter(F.col("depth") <= depth)
    out = own.filter(F.col("from_id") == start).select(F.col("to_id").alias("node"), "depth", F.col("via_kind").alias("via"))
    into = own.filter(F.col("to_id") == start).select(F.col("from_id").alias("node"), "depth", F.col("via_kind").alias("via"))
    rows = {"out": out, "in": into, "both": out.union(into).groupBy("node").agg(F.min("depth").alias("depth"), F.min_by("via", F.struct("depth", "via")).alias("via"))}[way]
    return rows if limit is None else rows.orderBy("depth", "node").limit(limit)


def callflow(edges: DataFrame, seed: str, direction: str = "both", depth: int = 2, node_cap: int = 200) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, depth) around a seed, the nearest up to a cap, and the call edges between them."""
    e = edges.filter(F.col("kind").isin(list(CALL_FAMILY)))
    start = edges.sparkSession.createDataFrame([(seed,)], "start string")
    way = direction_of(direction)
    parts = [reached(e, start, 1, depth)] if way in ("out", "both") else []
    parts += [reached(reversed_edges(e), start, 1, depth)] if way in ("in", "both") else []
    near = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    nodes = near.groupBy(F.col("node").alias("id")).agg(F.min("depth").alias("depth")).orderBy("depth", "id").limit(node_cap - 1)
    nodes = cut(nodes.union(start.select(F.col("start").alias("id"), F.lit(0).alias("depth"))))
    inside = nodes.select("id")
    induced = (
        e.select("from_id", "to_id").distinct()
        .join(F.broadcast(inside.withColumnRenamed("id", "from_id")), "from_id", "left_semi").join(F.broadcast(inside.withColumnRenamed("id", "to_id")), "to_id", "left_semi")
        .select("from_id", "to_id")
    )
    return nodes, induced


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("to_id").agg(F.count(F.lit(1)).alias("in_degree"))


def hotspots(symbols: DataFrame, edges: DataFrame, limit: int | None = 20) -> DataFrame:
    """Nodes by how many edges of any kind lead to them."""
    out = in_degree(edges).join(symbols.select(F.col("id").alias("to_id"), "name", "kind", "file_path"), "to_id").withColumnRenamed("to_id", "id")
    return out if limit is None else out.orderBy(F.desc("in_degree"), "id").limit(limit)


def risk_hotspots(symbols: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = ("Function", "Method", "Class", "Interface", "Type"), limit: int | None = 20) -> DataFrame:
    """risk = 3 x incoming + outgoing + edges with a test or fixture, over CALLS."""
    e = edges.filter(F.col("kind") == "CALLS").select("from_id", "to_id")
    place = lambda c: S.is_test_file(S.file_of_id(F.col(c))) | S.is_fixture_path(S.file_of_id(F.col(c)))
    one = F.lit(1)
    ends = e.select(F.col("to_id").alias("id"), one.alias("i"), F.lit(0).alias("o"), place("from_id").cast("int").alias("t")).union(
        e.select(F.col("from_id").alias("id"), F.lit(0), one, place("to_id").cast("int"))
    )
    counts = ends.groupBy("id").agg(F.sum("i").alias("incoming"), F.sum("o").alias("outgoing"), F.sum("t").alias("tests"))
    out = counts.join(symbols.filter(F.col("kind").isin(list(kinds))).select("id", "name", "kind", "file_path"), "id")
    out = out.withColumn("degree", F.col("incoming") + F.col("outgoing")).withColumn("risk", 3 * F.col("incoming") + F.col("outgoing") + F.col("tests"))
    return out if limit is None else out.orderBy(F.desc("risk"), F.desc("incoming"), F.desc("outgoing"), "file_path", "id").limit(limit)


def _pairs_of_files(edges: DataFrame, kinds: tuple[str, ...] | None) -> DataFrame:
    """(from_file, to_file, from_package, to_package, n): edges between files of different packages, counted before paths are taken apart.

    The counts are cut off, as the conditions on packages would else be pushed below them, to every edge.
    """
    e = edges if kinds is None else edges.filter(F.col("kind").isin(list(kinds)))
    by_file = cut(e.groupBy(S.file_of_id(F.col("from_id")).alias("from_file"), S.file_of_id(F.col("to_id")).alias("to_file")).agg(F.count(F.lit(1)).alias("n")))
    p = by_file.select("from_file", "to_file", S.package_of_file(F.col("from_file")).alias("from_package"), S.package_of_file(F.col("to_file")).alias("to_package"), "n")
    return p.filter((F.col("from_package") != "") & (F.col("to_package") != "") & (F.col("from_package") != F.col("to_package")))


def package_pairs(edges: DataFrame, kinds: tuple[str, ...] | None = ("CALLS",), limit: int | None = None) -> DataFrame:
    """Edges between packages: how many there are for each pair, and the one that sorts first; with a limit, of the rarest pairs only.

    Counting needs no strings but the files' names; examples are looked for once the pairs are known.
    """
    files = _pairs_of_files(edges, kinds)
    pairs = files.groupBy("from_package", "to_package").agg(F.sum("n").alias("edge_count"))
    if limit is not None:
        pairs = cut(pairs.orderBy("edge_count", "from_package", "to_package").limit(limit))
    wanted = files.join(pairs, ["from_package", "to_package"]).select("from_file", "to_file", "from_package", "to_package", "edge_count")
    e = edges if kinds is None else edges.filter(F.col("kind").isin(list(kinds)))
    met = e.select("from_id", "to_id", "kind", S.file_of_id(F.col("from_id")).alias("from_file"), S.file_of_id(F.col("to_id")).alias("to_file")).join(wanted, ["from_file", "to_file"])
    out = met.groupBy("from_package", "to_package", "edge_count").agg(F.min(F.struct("from_id", "to_id", "kind")).alias("example"))
    return out.select("from_package", "to_package", "edge_count", F.col("example.from_id").alias("example_from"), F.col("example.to_id").alias("example_to"))


def surprising(edges: DataFrame, limit: int | None = 10, kinds: tuple[str, ...] | None = ("CALLS",)) -> DataFrame:
    """The rarest connections between packages, with a word on the boundary that they cross."""
    out = package_pairs(edges, kinds, limit)
    mention = lambda c: F.col(c).rlike("(^|/)(tests?|testdata|fixtures)(/|$)|_test$")
    placed = lambda c: S.is_test_file(S.file_of_id(F.col(c))) | S.is_fixture_path(S.file_of_id(F.col(c)))
    outer = lambda c: F.col(c).startswith("@external")
    under = lambda c, p: (F.col(c) == p) | F.col(c).startswith(p + "/")
    cli = (under("from_package", "cmd") & under("to_package", "internal")) | (under("from_package", "internal") & under("to_package", "cmd"))
    boundary = (
        F.when(mention("from_package") | mention("to_package") | placed("example_from") | placed("example_to"), "test/prod boundary")
        .when(outer("from_package") | outer("to_package"), "external dependency boundary").when(cli, "CLI/internal coupling")
        .when(under("from_package", "scripts") | under("to_package", "scripts"), "automation boundary").otherwise("cross-package coupling")
    )
    out = out.withColumn("boundary", boundary)
    return out if limit is None else out.orderBy("edge_count", "from_package", "to_package").limit(limit)


def direct_callers(edges: DataFrame, target: Column) -> DataFrame:
    return edges.filter((F.col("to_id") == target) & F.col("kind").isin(list(CALL_FAMILY))).select("from_id").distinct()


def neighborhood(symbols: DataFrame, symbol: str, offset: int = 0, limit: int = 50) -> DataFrame:
    """Other nodes of the same file, a page of them."""
    own = symbols.filter(F.col("id") == symbol).select("project_id", "file_path")
    return symbols.join(F.broadcast(own), ["project_id", "file_path"], "left_semi").filter(F.col("id") != symbol).orderBy("start_byte", "id").offset(offset).limit(min(limit, 500))


def reverse_dependency_files(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(target_file, from_file): files with an edge into another file."""
    e = edges.select(S.file_of_id(F.col("from_id")).alias("from_file"), S.file_of_id(F.col("to_id")).alias("target_file"))
    return e.filter("from_file <> target_file").distinct()
