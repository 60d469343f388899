"""More named queries: language defaults, lookups, name resolution, resolver passes, scalars and search fall-backs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.functions import scalars as S
from graphmill.operators import extract as X
from graphmill.operators import graph as G
from graphmill.operators import impact as I
from graphmill.operators import quality as Q
from graphmill.operators import resolve as R
from graphmill.operators import retrieval as RT
from graphmill.operators import search as T
from graphmill.operators import store as K
from graphmill.operators import telemetry as M
from graphmill.plans import warnings as W
from graphmill.plans.cut import cut
from graphmill.plans.parser import one_edit_apart, parse
from graphmill.plans.planner import Engine
from graphmill.queries import _graph, query
from graphmill.sources import sinks as SK
from graphmill.sources import trade

SUPPLIER = "party/supplier::s3#Supplier"


def _default(spark: SparkSession, d: str, edges: DataFrame | None = None) -> Engine:
    """The engine as a user makes it: with its default limit, and without a promise that edges are unique."""
    return Engine(trade.symbols(spark, d), trade.edges(spark, d) if edges is None else edges, trade.PROJECT)


def _doubled(spark: SparkSession, d: str) -> DataFrame:
    """Every edge twice, once with half its confidence."""
    e = trade.edges(spark, d)
    return e.unionByName(e.withColumn("confidence", F.col("confidence") / 2))


# -- defaults of the language -------------------------------------------------------------------------
query("path_many_starts", "symbols edges", """SELECT count(*) AS n FROM (
SELECT e.from_id AS f, e.to_id AS t FROM edges e JOIN symbols a ON a.id = e.from_id WHERE a.kind = 'Order' AND e.kind = 'CALLS'
UNION SELECT e.from_id, x.to_id FROM edges e JOIN symbols a ON a.id = e.from_id JOIN edges x ON x.from_id = e.to_id WHERE a.kind = 'Order' AND e.kind = 'CALLS' AND x.kind = 'CALLS') WHERE f <> t""")(
    lambda spark, d: _default(spark, d).query("MATCH (a:Order)-[:CALLS*1..2]->(b) RETURN COUNT(*) AS n").df
)
query("default_limit", "symbols", "SELECT id FROM symbols WHERE kind = 'Order' ORDER BY id LIMIT 200")(lambda spark, d: _default(spark, d).query("MATCH (n:Order) RETURN n.id AS id ORDER BY n.id").df)
query("repeated_edges_count_once", "symbols edges", "SELECT b.name AS nation, count(*) AS n FROM edges e JOIN symbols a ON a.id = e.from_id JOIN symbols b ON b.id = e.to_id WHERE e.kind = 'IMPORTS' AND a.kind = 'Customer' GROUP BY 1")(
    lambda spark, d: _default(spark, d, _doubled(spark, d)).query("MATCH (a:Customer)-[:IMPORTS]->(b:Nation) RETURN b.name AS nation, COUNT(*) AS n").df
)
query("repeated_edges_keep_the_best", "symbols edges", "SELECT b.id AS id, count(*) AS n, max(e.confidence) AS best, min(e.confidence) AS worst FROM edges e JOIN symbols b ON b.id = e.to_id WHERE e.kind = 'CALLS' AND b.kind = 'Part' AND b.complexity = 7 AND e.confidence > 0.4 AND starts_with(e.from_id, 'order/') GROUP BY 1 ORDER BY 1 LIMIT 200")(
    lambda spark, d: _default(spark, d, _doubled(spark, d)).query("MATCH (a:Order)-[r:CALLS]->(b:Part) WHERE r.confidence > 0.4 AND b.complexity = 7 RETURN b.id AS id, COUNT(*) AS n, MAX(r.confidence) AS best, MIN(r.confidence) AS worst ORDER BY b.id").df
)
query("whole_node", "symbols", "SELECT id, name, kind, is_exported FROM symbols WHERE kind = 'Region'")(
    lambda spark, d: _default(spark, d).query("MATCH (n:Region) RETURN n AS node").df.select(
        *[F.get_json_object("node", f"$.{c}").alias(c) for c in ("id", "name", "kind")], F.get_json_object("node", "$.is_exported").cast("boolean").alias("is_exported")
    )
)
_graph("order_by_alias_of_property", "MATCH (n:Part) RETURN n.id AS id, n.complexity AS size ORDER BY n.complexity DESC LIMIT 40", "SELECT id, complexity AS size FROM symbols WHERE kind = 'Part' ORDER BY complexity DESC, id LIMIT 40", "symbols")
_graph("columns_are_not_compared", "MATCH (n:Nation) WHERE n.name = n.id RETURN n.id AS id", "SELECT id FROM symbols WHERE kind = 'Nation'", "symbols")
_graph("unknown_property_is_null", "MATCH (n:Nation) WHERE n.nonsense IS NULL AND NOT n.nonsense = 'x' RETURN n.id AS id", "SELECT id FROM symbols WHERE kind = 'Nation'", "symbols")
_graph("unbound_condition_is_dropped", "MATCH (n:Nation) WHERE m.name = 'x' AND n.qualified_name STARTS WITH 'n1' RETURN n.id AS id", "SELECT id FROM symbols WHERE kind = 'Nation' AND starts_with(qualified_name, 'n1')", "symbols")
_graph("walk_with_far_label", 'MATCH (a:Order {qualified_name: "o7"})-[:CALLS*1..2]->(b:Supplier) RETURN b.id AS id', """SELECT DISTINCT t AS id FROM (
SELECT e.to_id AS t FROM edges e WHERE e.kind = 'CALLS' AND e.from_id LIKE '%::o7#Order' UNION SELECT x.to_id FROM edges e JOIN edges x ON x.from_id = e.to_id WHERE e.kind = 'CALLS' AND x.kind = 'CALLS' AND e.from_id LIKE '%::o7#Order') WHERE t LIKE 'party/supplier::%'""")  # fmt: skip

_WARNED = [
    ("unknown_property", "MATCH (n) RETURN n.nam"), ("unbound_variable", "MATCH (n) WHERE m.name = 'x' RETURN n.name"), ("column_comparison", "MATCH (n) WHERE n.name = n.id RETURN n.name"),
    ("type_mismatch", "MATCH (n) WHERE n.complexity > 'x' RETURN n.name"), ("text_aggregate", "MATCH (n) RETURN SUM(n.name)"), ("unknown_order", "MATCH (n) RETURN n.name ORDER BY foo"),
    ("bare_property", "MATCH (n) RETURN name"), ("order_without_group", "MATCH (n) RETURN COUNT(*) ORDER BY n.name"), ("mixed_aggregate", "MATCH (n) RETURN n, COUNT(*)"),
    ("repeated_variable", "MATCH (a)-[:CALLS]->(a) RETURN a.name"), ("hop_range", "MATCH (a)-[:CALLS*3..1]->(b) RETURN a.name"), ("unknown_edge_kind", "MATCH (a)-[:CALL]->(b) RETURN a.name"),
    ("nothing", "MATCH (n:Part) WHERE n.complexity > 3 RETURN n.name"),
]
query("query_warnings", "", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {n != 'nothing'})" for n, _ in _WARNED) + ") t(about, warned)")(
    lambda spark, d: spark.createDataFrame([(n, bool(W.static_warnings(parse(q)))) for n, q in _WARNED], "about string, warned boolean")
)


@query("graph_warnings", "", "SELECT * FROM (VALUES ('label_typo', 'Part'), ('unknown_value', 'order'), ('label_mismatch', 'Nation')) t(about, told)")
def _(spark, d):
    e = _default(spark, d)
    nation = trade.table(spark, d, "nation").orderBy("n_nationkey").first()["n_name"]
    asked = [("label_typo", "Part", "MATCH (n:Prt) RETURN n.name"), ("unknown_value", "order", "MATCH (n) WHERE n.language = 'Order' RETURN n.name"), ("label_mismatch", "Nation", f"MATCH (n:Part) WHERE n.name = '{nation}' RETURN n.name")]
    return spark.createDataFrame([(about, word) for about, word, q in asked if any(word in w for w in e.diagnose(e.query(q)))], "about string, told string")


# -- lookups and pages --------------------------------------------------------------------------------
query("lookup_by_ids", "symbols", f"SELECT id, name FROM symbols WHERE id IN ('{SUPPLIER}', 'geo/region::r1#Region')")(
    lambda spark, d: K.fields(K.by_ids(trade.symbols(spark, d), [SUPPLIER, "geo/region::r1#Region", "none"], "trade"), ["id", "name", "nonsense"])
)
query("lookup_by_name", "symbols", "SELECT id FROM symbols WHERE name = 'Order#7' ORDER BY id LIMIT 5")(lambda spark, d: K.by_name(trade.symbols(spark, d), "Order#7", 5).select("id"))
query("lookup_by_column", "symbols", "SELECT id FROM symbols WHERE parent = 'r1'")(lambda spark, d: K.by_column(trade.symbols(spark, d), "parent", "r1").select("id"))
query("page_of_symbols", "symbols", "SELECT id, (SELECT count(*) FROM symbols WHERE kind = 'Customer') AS total, true AS more FROM symbols WHERE kind = 'Customer' ORDER BY id LIMIT 7 OFFSET 5")(lambda spark, d: _page(spark, d))


def _page(spark, d):
    df, total, more = K.page(trade.symbols(spark, d).filter("kind = 'Customer'"), [F.col("id")], 5, 7)
    return df.select("id", F.lit(total).cast("long").alias("total"), F.lit(more).alias("more"))


@query("filtered_projects", "", "SELECT 'kept' AS what, count(*) AS n FROM nation WHERE n_regionkey <> 0 AND n_nationkey >= 5 UNION ALL SELECT 'dead_path', count(*) FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 'few_edges', count(*) FROM nation WHERE n_regionkey <> 0 AND n_nationkey < 5")
def _(spark, d):
    projects = trade.table(spark, d, "nation").select(F.col("n_name").alias("id"), (F.col("n_regionkey") != 0).alias("alive"), F.lit(9).alias("last_active"), F.col("n_nationkey").alias("edges"))
    kept, drops = K.filter_projects(projects, 5, 1)
    counts = [kept.agg(F.lit("kept").alias("what"), F.count(F.lit(1)).alias("n"))]
    counts += [drops.select(F.lit(c).alias("what"), F.col(c).alias("n")) for c in ("dead_path", "few_edges")]
    return counts[0].union(counts[1]).union(counts[2])


@query("redirected_ids", "symbols", "SELECT id, CASE WHEN kind = 'Supplier' THEN 'moved/' || id ELSE id END AS current FROM symbols WHERE kind IN ('Supplier', 'Nation')")
def _(spark, d):
    s = trade.symbols(spark, d).filter("kind in ('Supplier', 'Nation')").select("project_id", "id", "kind")
    moves = s.filter("kind = 'Supplier'").select("project_id", F.col("id").alias("old_id"), F.concat(F.lit("moved/"), "id").alias("new_id"))
    return K.resolve_stale(s.select("project_id", "id"), moves).select("id", "current")


@query("decisions_delete_and_list", "", "SELECT c_mktsegment AS key, count(*)::VARCHAR AS value FROM customer WHERE c_mktsegment >= 'C' GROUP BY 1")
def _(spark, d):
    now = trade.table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("key")).agg(F.count(F.lit(1)).cast("string").alias("value")).withColumn("project_id", F.lit("trade"))
    return K.decisions(K.delete_decisions(now, now.filter("key < 'C'")), "trade").select("key", "value")


# -- graph --------------------------------------------------------------------------------------------
query("trace_candidates", "symbols", "SELECT id FROM symbols WHERE language = 'order' ORDER BY is_test, id LIMIT 50")(
    lambda spark, d: G.trace_candidates(trade.symbols(spark, d).withColumn("name", F.col("language")), "order").select("id")
)
query("auto_depth", "edges", "SELECT to_id AS id, CASE WHEN count(DISTINCT from_id) >= 5 THEN 1 ELSE 3 END AS depth FROM edges WHERE kind = 'CALLS' AND to_id IN ('party/supplier::s1#Supplier', 'party/supplier::s2#Supplier') GROUP BY 1 UNION ALL SELECT 'geo/region::r1#Region', 3")(
    lambda spark, d: spark.createDataFrame([(x, G.auto_depth(trade.edges(spark, d), x)) for x in ("party/supplier::s1#Supplier", "party/supplier::s2#Supplier", "geo/region::r1#Region")], "id string, depth int")
)
_INTO = f"""w AS (SELECT '{SUPPLIER}' AS node, 0 AS depth UNION SELECT from_id, depth + 1 FROM w JOIN edges ON to_id = node WHERE kind = 'CALLS' AND depth < 2),
t AS (SELECT node, min(depth) AS depth FROM w WHERE depth > 0 GROUP BY 1)"""


def _into(spark: SparkSession, d: str) -> DataFrame:
    return G.trace(trade.edges(spark, d), spark.createDataFrame([(SUPPLIER,)], "start string"), "in", 2)


query("trace_without_tests", "symbols edges", f",\n{_INTO} SELECT s.id, s.name, t.depth FROM t JOIN symbols s ON s.id = node WHERE NOT is_test", True)(
    lambda spark, d: G.hops(_into(spark, d), trade.symbols(spark, d), limit=None).select(F.col("node").alias("id"), "name", "depth")
)
query("trace_ditto", "symbols edges", f""",\n{_INTO} SELECT id, CASE WHEN lag(kind) OVER (ORDER BY depth, id) = kind THEN '"' ELSE kind END AS kind FROM t JOIN symbols ON id = node WHERE NOT is_test""", True)(
    lambda spark, d: G.ditto(G.hops(_into(spark, d), trade.symbols(spark, d), limit=None), "kind", ["depth", "node"]).select(F.col("node").alias("id"), "kind")
)
_PKG = "regexp_replace(split_part({}, '::', 1), '/[^/]*$', '')"
query("surprising_calls", "edges", f"""SELECT from_package, to_package, count(*) AS edge_count FROM (SELECT {_PKG.format('from_id')} AS from_package, {_PKG.format('to_id')} AS to_package FROM edges WHERE kind = 'CALLS')
WHERE from_package <> to_package GROUP BY 1, 2 ORDER BY 3, 1, 2 LIMIT 10""")(lambda spark, d: G.surprising(trade.edges(spark, d), 10).select("from_package", "to_package", "edge_count"))  # fmt: skip


# -- quality and impact -------------------------------------------------------------------------------
def _as_code(spark: SparkSession, d: str) -> DataFrame:
    """Customers as methods of their nations, which are interfaces in region 1."""
    s = trade.symbols(spark, d).filter("kind in ('Customer', 'Nation')")
    c = trade.table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("qualified_name"), F.concat(F.lit("n"), "c_nationkey").alias("p"))
    kind = F.when(F.col("kind") == "Customer", "Method").when(F.col("parent") == "r1", "Interface").otherwise("Class")
    return s.join(c, "qualified_name", "left").withColumn("parent", F.coalesce("p", "parent")).withColumn("kind", kind).drop("p")


query("interface_methods", "", "SELECT DISTINCT c_name AS method_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1")(
    lambda spark, d: Q.interface_method_names(_as_code(spark, d)).select("method_name")
)
query("dead_but_for_interfaces", "symbols", "SELECT s.id FROM symbols s JOIN customer ON s.qualified_name = 'c' || c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE s.kind = 'Customer' AND NOT is_exported AND n_regionkey <> 1")(
    lambda spark, d: Q.dead_nodes(_as_code(spark, d), trade.edges(spark, d).filter("kind = 'IMPORTS'"), ("Method",), interface_methods=Q.interface_method_names(_as_code(spark, d)), limit=None).select("id")
)


@query("changed_lines", "symbols", "SELECT id FROM symbols WHERE kind = 'Part' AND ((complexity * 10 <= 52 AND complexity * 10 + 9 >= 35 AND file_path = 'catalog/Brand#2') OR (complexity * 10 <= 120 AND complexity * 10 + 9 >= 120 AND file_path = 'catalog/Brand#3'))")
def _(spark, d):
    """Parts have ten lines each, by their size, so that hunks begin, end and lie inside of them."""
    s = trade.symbols(spark, d).filter("kind = 'Part'").withColumn("start_line", F.col("complexity") * 10).withColumn("end_line", F.col("complexity") * 10 + 9)
    hunks = I.parse_hunks("--- a/catalog/Brand#2\n+++ b/catalog/Brand#2\n@@ -30,2 +35,18 @@ x\n--- a/catalog/Brand#3\n+++ b/catalog/Brand#3\n@@ -119,4 +120,0 @@\n")
    return I.changed_symbols(s, spark.createDataFrame(hunks, "file_path string, start_line int, end_line int")).select("id")


query("composite_score", "", "SELECT n_name AS name, round((n_nationkey * 10 + greatest(n_regionkey - 2.0, 0) * 0.001 + n_regionkey * 0.05 + 3 * 0.02)::DOUBLE, 9) AS score FROM nation")(
    lambda spark, d: M.composite_score(trade.table(spark, d, "nation").select(
        F.col("n_name").alias("name"), F.col("n_nationkey").cast("double").alias("accuracy"), (F.col("n_regionkey") - 2.0).alias("tokens"), F.col("n_regionkey").cast("double").alias("p50"), F.lit(3.0).alias("p95"), F.lit(-1.0).alias("trips"),
    )).select("name", F.round("score", 9).alias("score"))
)


# -- resolver -----------------------------------------------------------------------------------------
def _code_nodes(df: DataFrame, path, qn, name, kind: str, language: str) -> DataFrame:
    return df.select(
        F.lit("p").alias("project_id"), S.symbol_id(path, qn, F.lit(kind)).alias("id"), path.alias("file_path"), name.alias("name"), qn.alias("qualified_name"), F.lit(kind).alias("kind"), F.lit(language).alias("language"), F.lit(0).alias("start_byte")
    )


def _pending(df: DataFrame, path, qn, to, kind: str, receiver=None) -> DataFrame:
    return df.select(
        F.lit("p").alias("project_id"), path.alias("from_file"), F.lit(kind).alias("kind"), qn.alias("from_qn"), to.alias("to_name"), F.lit(1.0).alias("confidence"), (F.lit(None).cast("string") if receiver is None else receiver).alias("receiver_type")
    )


@query("resolve_calls", "", r"""WITH n AS (SELECT p_partkey AS k, 'src/b' || (p_partkey % 9) || '/f' || (p_partkey % 4) || '.go' AS path, 'src/b' || (p_partkey % 9) AS dir, 'p' || p_partkey AS name,
CASE WHEN p_partkey % 2 = 0 THEN 'p' || p_partkey ELSE 'pkg.p' || p_partkey END AS qn FROM part),
s AS (SELECT *, path || '::' || qn || '#Function' AS id FROM n), c AS (SELECT id AS from_id, dir, 'p' || (k * 7 % (SELECT count(*) FROM part) + 1) AS to_name FROM s)
SELECT DISTINCT from_id, coalesce(t1.id, t2.id) AS to_id FROM c LEFT JOIN s t1 ON t1.qn = to_name LEFT JOIN s t2 ON t2.name = to_name AND t2.dir = c.dir WHERE coalesce(t1.id, t2.id) <> from_id""")  # fmt: skip
def _(spark, d):
    """Calls by bare names: of functions with that qualified name, else of those in the caller's folder."""
    p = trade.table(spark, d, "part")
    k, n = F.col("p_partkey"), p.count()
    path, name = F.concat(F.lit("src/b"), k % 9, F.lit("/f"), k % 4, F.lit(".go")), F.concat(F.lit("p"), k)
    qn = F.when(k % 2 == 0, name).otherwise(F.concat(F.lit("pkg."), name))
    calls = _pending(p, path, qn, F.concat(F.lit("p"), k * 7 % n + 1), "CALLS")
    return R.resolve_calls(_code_nodes(p, path, qn, name, "Function", "Go"), calls)[0].select("from_id", "to_id")


@query("resolve_methods", "", r"""SELECT 'u/c.go::f' || c_custkey || '#Function' AS from_id, 'u/t.go::T' || c_nationkey || '.m#Method' AS to_id FROM customer WHERE c_custkey % 3 <> 0 UNION ALL
SELECT 'u/c.go::f' || c_custkey || '#Function', 'u/t.go::T' || c_nationkey || '.only' || c_nationkey || '#Method' FROM customer WHERE c_custkey % 3 = 0""")  # fmt: skip
def _(spark, d):
    """Calls with a receiver: a method of its type, pointer or not, or one that a single type has."""
    c, n = trade.table(spark, d, "customer"), trade.table(spark, d, "nation")
    place, key = F.lit("u/t.go"), F.col("n_nationkey")
    owner = F.concat(F.lit("T"), key)
    nodes = _code_nodes(n, place, F.concat(owner, F.lit(".m")), F.lit("m"), "Method", "Go").union(_code_nodes(n, place, F.concat(owner, F.lit(".only"), key), F.concat(F.lit("only"), key), "Method", "Go"))
    caller = F.concat(F.lit("f"), F.col("c_custkey"))
    nodes = nodes.union(_code_nodes(c, F.lit("u/c.go"), caller, caller, "Function", "Go"))
    single = F.col("c_custkey") % 3 == 0
    to = F.when(single, F.concat(F.lit("x.only"), "c_nationkey")).otherwise("x.m")
    receiver = F.when(~single, F.concat(F.when(F.col("c_custkey") % 2 == 0, "*").otherwise(""), F.lit("T"), "c_nationkey"))
    return R.resolve_calls(nodes, _pending(c, F.lit("u/c.go"), caller, to, "CALLS", receiver))[0].select("from_id", "to_id")


# -- Go sources -----------------------------------------------------------------------------------------
def _go_files(spark: SparkSession, d: str) -> DataFrame:
    """A file for each nation, with a struct, an interface and a variable, and one for each customer that uses its nation's."""
    nations = trade.table(spark, d, "nation").select(F.format_string("s/%d.go", "n_nationkey").alias("path"), F.regexp_replace(F.lit("""package s

import "io"

// NOTE: the struct of nation @.
type S@ struct{}

func (s *S@) Run() { Total@++ }

type Runner@ interface {
	io.Closer
	Run()
	Stop@(n int) error
}

var Total@ int
"""), "@", F.col("n_nationkey").cast("string")).alias("content"))
    c = trade.table(spark, d, "customer")
    text = F.regexp_replace(F.lit("""package c

type C@ struct {
	sync.Mutex
	part, spare *S# `json:"}"`
	name        string
}

func (c *C@) Go(n int) {
	// TODO: not "}" but
	// until # is done
	c.part.Run()
	Total# = n
	c.name = `}` + Name(n)
}

func (c *C@) Stop@() { c.Go(Total#) }
"""), "@", F.col("c_custkey").cast("string"))
    customers = c.select(F.format_string("c/%d.go", "c_custkey").alias("path"), F.regexp_replace(text, "#", F.col("c_nationkey").cast("string")).alias("content"))
    return nations.union(customers).withColumn("language", F.lit("Go"))


def _go_rows(spark: SparkSession, d: str) -> DataFrame:
    return X.extract(_go_files(spark, d))


query("extract_go_fields", "", """SELECT 'C' || c_custkey AS struct, field, CASE field WHEN 'Mutex' THEN 'sync.Mutex' WHEN 'name' THEN 'string' ELSE '*S' || c_nationkey END AS type
FROM customer, (VALUES ('Mutex'), ('part'), ('spare'), ('name')) f(field)""")(lambda spark, d: X.fields_of(_go_rows(spark, d), "p").select("struct", "field", "type"))
query("extract_go_interfaces", "", "SELECT 'Runner' || n_nationkey AS interface, m || CASE m WHEN 'Stop' THEN n_nationkey::VARCHAR ELSE '' END AS method_name FROM nation, (VALUES ('Run'), ('Stop')) t(m)")(
    lambda spark, d: X.interface_methods_of(_go_rows(spark, d), "p").select("interface", "method_name")
)
query("extract_go_symbols", "", """SELECT 's/' || n_nationkey || '.go::' || q || '#' || kind AS id, line AS start_line, till AS end_line FROM (SELECT n_nationkey, unnest([
{'q': 'S' || n_nationkey, 'kind': 'Class', 'line': 6, 'till': 6}, {'q': 'S' || n_nationkey || '.Run', 'kind': 'Method', 'line': 8, 'till': 8}, {'q': 'Runner' || n_nationkey, 'kind': 'Interface', 'line': 10, 'till': 14},
{'q': 'Total' || n_nationkey, 'kind': 'Variable', 'line': 16, 'till': 16}, {'q': 's.rationale.L5', 'kind': 'Rationale', 'line': 5, 'till': 5}], recursive := true) FROM nation)
UNION ALL SELECT 'c/' || c_custkey || '.go::' || q || '#' || kind, line, till FROM (SELECT c_custkey, unnest([
{'q': 'C' || c_custkey, 'kind': 'Class', 'line': 3, 'till': 7}, {'q': 'C' || c_custkey || '.Go', 'kind': 'Method', 'line': 9, 'till': 15}, {'q': 'C' || c_custkey || '.Stop' || c_custkey, 'kind': 'Method', 'line': 17, 'till': 17},
{'q': 'c.rationale.L10', 'kind': 'Rationale', 'line': 10, 'till': 11}], recursive := true) FROM customer)""")(lambda spark, d: X.symbols_of(_go_rows(spark, d), "p").select("id", "start_line", "end_line"))
query("extract_go_rationale", "", """SELECT 'C' || c_custkey || '.Go' AS parent, 'TODO: not "}" but' AS name FROM customer UNION ALL SELECT NULL, 'NOTE: the struct of nation ' || n_nationkey || '.' FROM nation""")(
    lambda spark, d: X.symbols_of(_go_rows(spark, d), "p").filter("kind = 'Rationale'").select("parent", "name")
)


def _go_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = cut(_go_rows(spark, d))
    return X.symbols_of(rows, "p"), X.pending_of(rows, "p"), rows


@query("resolve_fields", "", """SELECT 'c/' || c_custkey || '.go::C' || c_custkey || '.Go#Method' AS from_id, 's/' || c_nationkey || '.go::S' || c_nationkey || '.Run#Method' AS to_id FROM customer
UNION ALL SELECT 'c/' || c_custkey || '.go::C' || c_custkey || '.Stop' || c_custkey || '#Method', 'c/' || c_custkey || '.go::C' || c_custkey || '.Go#Method' FROM customer""")  # fmt: skip
def _(spark, d):
    """Calls through a field of the receiver, by the fields that extraction found, and on the receiver itself."""
    symbols, pending, rows = _go_graph(spark, d)
    return R.resolve_calls(symbols, pending, X.fields_of(rows, "p"))[0].select("from_id", "to_id")


query("resolve_go_variables", "", """SELECT 'c/' || c_custkey || '.go::C' || c_custkey || '.Go#Method' AS from_id, 's/' || c_nationkey || '.go::Total' || c_nationkey || '#Variable' AS to_id, 'WRITES' AS kind FROM customer
UNION ALL SELECT 'c/' || c_custkey || '.go::C' || c_custkey || '.Stop' || c_custkey || '#Method', 's/' || c_nationkey || '.go::Total' || c_nationkey || '#Variable', 'READS' FROM customer
UNION ALL SELECT 's/' || n_nationkey || '.go::S' || n_nationkey || '.Run#Method', 's/' || n_nationkey || '.go::Total' || n_nationkey || '#Variable', k FROM nation, (VALUES ('READS'), ('WRITES')) t(k)""")(
    lambda spark, d: R.resolve_reads(*_go_graph(spark, d)[:2]).select("from_id", "to_id", "kind")
)
query("dead_but_for_go_interfaces", "", "SELECT 'C' || c_custkey || '.Stop' || c_custkey AS qualified_name FROM customer WHERE c_custkey NOT IN (SELECT n_nationkey FROM nation)")(
    lambda spark, d: _dead_go(spark, d).select("qualified_name")
)


def _dead_go(spark, d):
    """Methods that nothing calls and no interface of the project declares."""
    symbols, pending, rows = _go_graph(spark, d)
    edges = R.resolve_calls(symbols, pending, X.fields_of(rows, "p"))[0]
    unexported = symbols.withColumn("is_exported", F.lit(False))
    return Q.dead_nodes(unexported, edges, ("Method",), interface_methods=X.interface_methods_of(rows, "p"), limit=None)


@query("investigate_many", "", """SELECT c_custkey AS failure_id, 'c/' || c_custkey || '.go::C' || c_custkey || '.Stop' || c_custkey || '#Method' AS id, CASE WHEN c_nationkey = 3 THEN 0.85 ELSE 0.65 END::DOUBLE AS score,
'stack_frame_exact_name_match,file_appears_in_trace' || CASE WHEN c_nationkey = 3 THEN ',modified_in_working_tree' ELSE '' END AS evidence, 1 AS rank FROM customer""")  # fmt: skip
def _(spark, d):
    """A failure for each customer, whose trace names its method and file; files of one nation's customers were changed."""
    symbols, pending, rows = _go_graph(spark, d)
    c = trade.table(spark, d, "customer")
    failures = c.select(F.col("c_custkey").alias("failure_id"), F.format_string("panic: boom\ngoroutine 1 [running]:\nmain.C.Stop%d(0x1)\n\t/app/c/%d.go:17 in main", "c_custkey", "c_custkey").alias("error_text"))
    recent = c.filter("c_nationkey = 3").select(F.format_string("c/%d.go", "c_custkey").alias("file_path"))
    edges = R.resolve_calls(symbols, pending, X.fields_of(rows, "p"))[0]
    return RT.investigate(symbols, edges, T.build_index(symbols, ["name", "qualified_name"]), failures, recent)


@query("delete_file_members", "", """SELECT 'C' || c_custkey AS holder, field AS member FROM customer, (VALUES ('Mutex'), ('part'), ('spare'), ('name')) f(field) WHERE c_custkey % 3 <> 1
UNION ALL SELECT 'Runner' || n_nationkey, m || CASE m WHEN 'Stop' THEN n_nationkey::VARCHAR ELSE '' END FROM nation, (VALUES ('Run'), ('Stop')) t(m) WHERE n_nationkey % 2 = 0""")  # fmt: skip
def _(spark, d):
    """Fields and methods go with their file."""
    symbols, pending, rows = _go_graph(spark, d)
    gone = trade.table(spark, d, "customer").filter("c_custkey % 3 = 1").select(F.lit("p").alias("project_id"), F.format_string("c/%d.go", "c_custkey").alias("file_path"))
    gone = gone.union(trade.table(spark, d, "nation").filter("n_nationkey % 2 = 1").select(F.lit("p"), F.format_string("s/%d.go", "n_nationkey")))
    fields, methods = K.delete_file(symbols, R.resolve_calls(symbols, pending)[0], gone, X.fields_of(rows, "p"), X.interface_methods_of(rows, "p"))[2:]
    return fields.select(F.col("struct").alias("holder"), F.col("field").alias("member")).union(methods.select("interface", "method_name"))


# -- sources of other languages ------------------------------------------------------------------------
# For each language: a source whose strings and comments hold what ends blocks, and its declarations (kind, name, first and last line); @ is a supplier's key.
_SOURCES = {
    "JavaScript": ("class A@ {\n  // }\n  draw() {\n    const s = `}${ `}` }`;\n    return /}/.test(s);\n  }\n  later() {\n  }\n}\nconst f@ = (x) => x + 1\nfunction h@() {\n}\n",
                   (("Class", "A@", 1, 9), ("Method", "A@.draw", 3, 6), ("Method", "A@.later", 7, 8), ("Function", "f@", 10, 10), ("Function", "h@", 11, 12))),
    "Java": ("public class A@ {\n  /* class X { */\n  public int f@(int x) throws E {\n    char c = '}';\n    return \"\"\"\n      } \\\"\n      \"\"\".length();\n  }\n}\n", (("Class", "A@", 1, 9), ("Method", "A@.f@", 3, 8))),
    "Rust": ("pub struct S@ { a: i32 }\npub fn go@<'a>(x: &'a str) {\n  let s = r#\"}\"#;\n  /* /* } */ } */\n}\npub trait T@ {\n  fn m(&self);\n}\n", (("Class", "S@", 1, 1), ("Function", "go@", 2, 5), ("Interface", "T@", 6, 8), ("Method", "T@.m", 7, 7))),
    "Ruby": ("class A@\n  # end\n  def f@(x)\n    return 1 if x\n    while x do\n      y = \"end #{x ? 'end' : 1}\"\n    end\n  end\n  def g@ = 2\nend\ndef last@\nend\n", (("Class", "A@", 1, 10), ("Method", "A@.f@", 3, 8), ("Method", "A@.g@", 9, 9), ("Function", "last@", 11, 12))),
    "Lua": ("function f@(x)\n  -- end\n  for i = 1, 2 do\n    if x then y = [[ end ]] end\n  end\n  repeat x = x + 1 until x > 2\nend\nlocal function h@()\nend\n", (("Function", "f@", 1, 7), ("Function", "h@", 8, 9))),
    "C++": ("int f@(int x)\n{\n  auto s = R\"(})\";\n  return 1'000;\n}\nvoid A@::g() {\n  char c = '}';\n}\n", (("Function", "f@", 1, 5), ("Method", "A@.g", 6, 8))),
}
_DECLARED = " UNION ALL ".join(
    f"SELECT '{lang}' AS language, '{kind}' AS kind, '{name.split('@')[0]}' || s_suppkey || '{name.split('@', 1)[1]}' AS qualified_name, {a} AS start_line, {b} AS end_line FROM supplier" if name.count("@") == 1
    else f"SELECT '{lang}', '{kind}', replace('{name}', '@', s_suppkey::VARCHAR), {a}, {b} FROM supplier"
    for lang, (_, found) in _SOURCES.items() for kind, name, a, b in found
)


def _sources(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    each = [F.struct(F.lit(lang).alias("language"), F.replace(F.lit(text), F.lit("@"), key).alias("content")) for lang, (text, _) in _SOURCES.items()]
    return trade.table(spark, d, "supplier").select(F.concat(F.lit("f"), key).alias("path"), F.explode(F.array(*each)).alias("s")).select("path", "s.*")


query("extract_blocks", "", _DECLARED)(lambda spark, d: X.symbols_of(X.extract(_sources(spark, d)), "p").select("language", "kind", "qualified_name", "start_line", "end_line"))


def _made(spark: SparkSession, d: str, table: str, key: str, language: str, text: str) -> DataFrame:
    """A source for each row of a table, in which @ is its key."""
    content = F.replace(F.lit(text), F.lit("@"), F.col(key).cast("string"))
    return X.extract(trade.table(spark, d, table).select(F.concat(F.lit("f"), F.col(key).cast("string")).alias("path"), F.lit(language).alias("language"), content.alias("content")))


_YAML = """base: &b
  size: @
  tags: [a, {k@: "}: x", e}]
script: |
  not: a key
   - nor an element
jobs:
- name: 'j: @'
  <<: *b
  size: 2
-
  use: *b
  image: {{ .Values.image@ }}
"""
_SETTINGS = (
    ("base", 1, 3), ("base.size", 2, 2), ("base.tags", 3, 3), ("base.tags.0", 3, 3), ("base.tags.1", 3, 3), ("base.tags.1.k@", 3, 3), ("base.tags.1.e", 3, 3), ("script", 4, 6), ("jobs", 7, 13), ("jobs.0", 8, 10),
    ("jobs.0.name", 8, 8), ("jobs.0.size", 10, 10), ("jobs.0.tags", 9, 9), ("jobs.0.tags.0", 9, 9), ("jobs.0.tags.1", 9, 9), ("jobs.0.tags.1.k@", 9, 9), ("jobs.0.tags.1.e", 9, 9), ("jobs.1", 12, 13), ("jobs.1.use", 12, 12),
    ("jobs.1.use.size", 12, 12), ("jobs.1.use.tags", 12, 12), ("jobs.1.use.tags.0", 12, 12), ("jobs.1.use.tags.1", 12, 12), ("jobs.1.use.tags.1.k@", 12, 12), ("jobs.1.use.tags.1.e", 12, 12), ("jobs.1.image", 13, 13),
)
query("extract_yaml_settings", "", "SELECT 'f' || c_custkey AS file_path, replace(q, '@', c_custkey::VARCHAR) AS qualified_name, a AS start_line, b AS end_line FROM customer, (VALUES " + ", ".join(f"('{q}', {a}, {b})" for q, a, b in _SETTINGS) + ") t(q, a, b)")(
    lambda spark, d: X.symbols_of(_made(spark, d, "customer", "c_custkey", "YAML", _YAML), "p").select("file_path", "qualified_name", "start_line", "end_line")
)
query("extract_yaml_variables", "", "SELECT 'f' || s_suppkey AS from_file, 'USES_VAR' AS kind, 'v' || s_suppkey AS to_name FROM supplier")(
    lambda spark, d: X.pending_of(_made(spark, d, "supplier", "s_suppkey", "YAML", "a: 'x {{ v@ | upper }}'\nb: |\n  {{- v@ }}\n"), "p").select("from_file", "kind", "to_name")
)
_HCL = """variable "v@" { default = "}${"a"}" }
locals {
  n@ = "${var.v@}"
  doc = <<-EOT
    } resource "no" "no" { ${local.n@}
  EOT
}
resource "host" "h@" {
  name = local.n@
  disk { size = data.sizes.s@.small }
  disk { size = 2 } # }
  lifecycle {
    keep = true
  }
}
output "o@" { value = host.h@[0].id }
"""
_BLOCKS = (
    ("var.v@", "Variable", 1, 1), ("local.n@", "Local", 3, 3), ("local.doc", "Local", 4, 6), ("resource.host.h@", "Resource", 8, 15), ("resource.host.h@.disk.0", "Block", 10, 10), ("resource.host.h@.disk.1", "Block", 11, 11),
    ("resource.host.h@.lifecycle", "Block", 12, 14), ("output.o@", "Output", 16, 16),
)
query("extract_hcl_blocks", "", "SELECT replace(q, '@', s_suppkey::VARCHAR) AS qualified_name, kind, a AS start_line, b AS end_line FROM supplier, (VALUES " + ", ".join(f"('{q}', '{k}', {a}, {b})" for q, k, a, b in _BLOCKS) + ") t(q, kind, a, b)")(
    lambda spark, d: X.symbols_of(_made(spark, d, "supplier", "s_suppkey", "HCL", _HCL), "p").select("qualified_name", "kind", "start_line", "end_line")
)
query("extract_hcl_references", "", """SELECT replace(f, '@', s_suppkey::VARCHAR) AS from_qn, replace(t, '@', s_suppkey::VARCHAR) AS to_name FROM supplier,
(VALUES ('local.n@', 'var.v@'), ('local.doc', 'local.n@'), ('resource.host.h@', 'local.n@'), ('resource.host.h@', 'data.sizes.s@'), ('output.o@', 'resource.host.h@')) r(f, t)""")(
    lambda spark, d: X.pending_of(_made(spark, d, "supplier", "s_suppkey", "HCL", _HCL), "p").select("from_qn", "to_name")
)


@query("resolve_reads", "", r"""SELECT 'a/s.go::f' || s_suppkey || '#Function' AS from_id, CASE WHEN s_nationkey % 2 = 0 THEN 'a/v.go::v' || s_nationkey || '#Variable' ELSE 'a/v.go::v' || s_nationkey || '#Function' END AS to_id,
CASE WHEN s_nationkey % 2 = 0 THEN 'READS' ELSE 'CALLS' END AS kind, CASE WHEN s_nationkey % 2 = 0 THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END AS confidence FROM supplier""")  # fmt: skip
def _(spark, d):
    """Names used as values: variables are read, functions count as calls of little confidence."""
    n, s = trade.table(spark, d, "nation"), trade.table(spark, d, "supplier")
    name, own = F.concat(F.lit("v"), "n_nationkey"), F.concat(F.lit("f"), "s_suppkey")
    even = F.col("n_nationkey") % 2 == 0
    nodes = _code_nodes(n.filter(even), F.lit("a/v.go"), name, name, "Variable", "Go").union(_code_nodes(n.filter(~even), F.lit("a/v.go"), name, name, "Function", "Go"))
    nodes = nodes.union(_code_nodes(s, F.lit("a/s.go"), own, own, "Function", "Go"))
    return R.resolve_reads(nodes, _pending(s, F.lit("a/s.go"), own, F.concat(F.lit("v"), "s_nationkey"), "READS")).select("from_id", "to_id", "kind", "confidence")


@query("resolve_references", "", r"""SELECT 'n' || n_nationkey || '.md::top#Section' AS from_id, CASE WHEN n_nationkey % 2 = 0 THEN 'r' || n_regionkey || '.md::top#Section' ELSE 'r' || n_regionkey || '.md::top.more#Section' END AS to_id FROM nation""")
def _(spark, d):
    """Links of documents: to a file, or to an anchor in it."""
    n, r = trade.table(spark, d, "nation"), trade.table(spark, d, "region")
    page, of = F.concat(F.lit("n"), "n_nationkey", F.lit(".md")), F.concat(F.lit("r"), "r_regionkey", F.lit(".md"))
    nodes = _code_nodes(n, page, F.lit("top"), F.lit("top"), "Section", "Markdown").union(_code_nodes(r, of, F.lit("top"), F.lit("top"), "Section", "Markdown"))
    nodes = nodes.union(_code_nodes(r, of, F.lit("top.more"), F.lit("more"), "Section", "Markdown").withColumn("start_byte", F.lit(9)))
    to = F.concat(F.lit("doc:r"), "n_regionkey", F.lit(".md"), F.when(F.col("n_nationkey") % 2 == 0, "").otherwise("#more"))
    return R.resolve_references(nodes, _pending(n, page, F.lit("top"), to, "REFERENCES")).select("from_id", "to_id")


@query("resolve_includes", "", "SELECT 'n' || n_nationkey || '::n' || n_nationkey || '#Module' AS from_id, 'r' || n_regionkey || '::' || CASE WHEN n_regionkey < 2 THEN 'known' ELSE 'r' || n_regionkey END || '#Module' AS to_id FROM nation")
def _(spark, d):
    """File edges: to the module of a file, or to one made for it."""
    n, r = trade.table(spark, d, "nation"), trade.table(spark, d, "region").filter("r_regionkey < 2")
    nodes = _code_nodes(r, F.concat(F.lit("r"), "r_regionkey"), F.lit("known"), F.lit("known"), "Module", "Bash")
    own = F.concat(F.lit("n"), "n_nationkey")
    return R.resolve_file_edges(nodes, _pending(n, own, own, F.concat(F.lit("r"), "n_regionkey"), "INCLUDES"), "INCLUDES")[0].select("from_id", "to_id")


@query("resolve_uses_var", "", "SELECT 'play' || n_nationkey || '.yml::play' || n_nationkey || '.yml#Module' AS from_id, 'group_vars/all.yml::v' || n_regionkey || '#Setting' AS to_id FROM nation WHERE n_regionkey <> 3")
def _(spark, d):
    """Uses of variables that a file of variables sets."""
    n, r = trade.table(spark, d, "nation"), trade.table(spark, d, "region").filter("r_regionkey <> 3")
    name, own = F.concat(F.lit("v"), "r_regionkey"), F.concat(F.lit("play"), "n_nationkey", F.lit(".yml"))
    nodes = _code_nodes(r, F.lit("group_vars/all.yml"), name, name, "Setting", "YAML")
    return R.resolve_uses_var(nodes, _pending(n, own, own, F.concat(F.lit("v"), "n_regionkey"), "USES_VAR")).select("from_id", "to_id")


@query("resolve_python_tails", "", "SELECT 'app/x.py::f' || n_nationkey || '#Function' AS from_id, 'lib/m.py::lib.m.g' || n_regionkey || '#Function' AS to_id FROM nation WHERE n_regionkey <> 2")
def _(spark, d):
    """Dotted Python names with which exactly one qualified name ends; that of region 2 occurs in two modules."""
    n, r = trade.table(spark, d, "nation"), trade.table(spark, d, "region")
    own, name = F.concat(F.lit("f"), "n_nationkey"), F.concat(F.lit("g"), "r_regionkey")
    nodes = _code_nodes(r, F.lit("lib/m.py"), F.concat(F.lit("lib.m."), name), name, "Function", "Python").union(_code_nodes(r.filter("r_regionkey = 2"), F.lit("old/m.py"), F.concat(F.lit("old.m."), name), name, "Function", "Python"))
    nodes = nodes.union(_code_nodes(n, F.lit("app/x.py"), own, own, "Function", "Python"))
    return R.resolve_calls(nodes, _pending(n, F.lit("app/x.py"), own, F.concat(F.lit("m.g"), "n_regionkey"), "CALLS"))[0].select("from_id", "to_id")


# -- health -------------------------------------------------------------------------------------------
query("projects_listed", "symbols edges", "SELECT 'trade' AS project_id, count(*) AS symbols, (SELECT count(*) FROM edges) AS edges, count(DISTINCT file_path) AS files, count(DISTINCT language) AS languages FROM symbols")(
    lambda spark, d: Q.projects(trade.symbols(spark, d), trade.edges(spark, d)).drop("ratio")
)


def _by_region(spark: SparkSession, d: str) -> DataFrame:
    """Customers of each region as a project; those of region 0 are settings, those of region 1 were extracted badly."""
    c = trade.table(spark, d, "customer").join(trade.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    r = F.col("n_regionkey")
    return c.select(F.concat(F.lit("r"), r).alias("project_id"), F.lit("f").alias("file_path"), F.lit("x").alias("language"), F.when(r == 0, "Setting").otherwise("Function").alias("kind"), F.when(r == 1, 0.5).otherwise(1.0).alias("extraction_confidence"))


query("doctor_findings", "", "SELECT 'r0' AS project_id, 'settings_flood' AS finding, 1.0::DOUBLE AS value WHERE (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 0) > 150 UNION ALL SELECT 'r1', 'low_confidence', 0.5::DOUBLE")(
    lambda spark, d: Q.doctor(_by_region(spark, d), trade.edges(spark, d).limit(0), 150).filter("finding <> 'few_edges'")
)
query("settings_flood_found", "", "SELECT 'r0' AS project_id, count(*) AS n, count(*) AS settings FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 0 HAVING count(*) > 150")(
    lambda spark, d: Q.settings_flood(_by_region(spark, d), 150)
)


def _reads(spark: SparkSession, d: str) -> DataFrame:
    """Events as hooks on ten files of each user."""
    e = trade.table(spark, d, "events")
    kind = F.when(F.col("event_type") == "view", "Read").when(F.col("event_type") == "click", "Task").otherwise("Edit")
    return e.select(F.col("event_id").alias("id"), F.col("ts"), F.concat(F.lit("s"), "user_id").alias("session_id"), kind.alias("tool_name"), F.concat(F.lit("/repo/"), F.col("event_id") % 10).alias("file_path"), F.when(F.col("event_id") % 97 == 0, "advise_index").otherwise("allow").alias("decision"))


query("files_seen_before", "", "SELECT event_id AS id, row_number() OVER (PARTITION BY user_id, event_id % 10 ORDER BY ts, event_id) > 1 AS seen FROM events")(
    lambda spark, d: M.seen_before(_reads(spark, d)).select("id", "seen")
)
query("session_probes", "", "SELECT 's' || user_id AS session_id, count(*) FILTER (event_type = 'view' AND event_id % 10 = 3) AS reads_under_root, count(*) FILTER (event_type = 'click') AS tasks, count(*) FILTER (event_id % 97 = 0 AND event_id % 10 = 3) > 0 AS advised FROM events GROUP BY 1")(
    lambda spark, d: M.session_probes(_reads(spark, d), "/repo/3")
)


# -- scalars ------------------------------------------------------------------------------------------
query("scalars_of_names", "", "SELECT p_partkey AS id, 1 + (length(p_name) - length(replace(p_name, 'for ', ''))) // 4 + (length(p_name) - length(replace(p_name, '||', ''))) // 2 AS complexity, regexp_matches(upper(p_name), '^[A-Z]') AS exported, contains('Code generated ' || p_name, 'Code generated') AS generated FROM part")(
    lambda spark, d: trade.table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), S.complexity(F.regexp_replace("p_name", "(if|else|while|switch|case|catch) |&&", "")).cast("long").alias("complexity"), S.is_exported(F.upper("p_name")).alias("exported"),
        S.is_generated(F.concat(F.lit("Code generated "), "p_name")).alias("generated"),
    )
)
query("scalars_of_numbers", "", """SELECT o_orderkey AS id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' WHEN s < 86400 THEN (s // 3600) || 'h' ELSE (s // 86400) || 'd' END AS age,
CASE WHEN s < 1024 THEN s || ' B' WHEN s < 1048576 THEN printf('%.1f KB', s / 1024.0) ELSE printf('%.1f MB', s / 1048576.0) END AS size FROM (SELECT o_orderkey, (o_orderkey % 50) * (o_orderkey % 50) * 97::BIGINT + 1 AS s FROM orders)""")(
    lambda spark, d: trade.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), ((F.col("o_orderkey") % 50) * (F.col("o_orderkey") % 50) * 97 + 1).cast("long").alias("s")).select("id", S.staleness(F.col("s")).alias("age"), S.size_text(F.col("s")).alias("size"))
)
query("scalars_of_versions", "", "SELECT max(v) AS newest FROM (SELECT (n_regionkey, n_nationkey, 3, 0) AS k, 'v' || n_regionkey || '.' || n_nationkey || '.3-rc1' AS v FROM nation) WHERE k = (SELECT max((n_regionkey, n_nationkey, 3, 0)) FROM nation)")(
    lambda spark, d: trade.table(spark, d, "nation").select(F.concat(F.lit("v"), "n_regionkey", F.lit("."), "n_nationkey", F.lit(".3-rc1")).alias("v")).agg(F.max_by("v", S.version_parts(F.col("v"))).alias("newest"))
)
_PLACES = "CASE n_nationkey % 5 WHEN 0 THEN 'a/tests/x.py' WHEN 1 THEN 'src/x_test.go' WHEN 2 THEN 'testdata/x.go' WHEN 3 THEN 'src/contest.py' ELSE 'a/fixtures/b/c.ts' END"
query("scalars_of_paths", "", f"SELECT n_nationkey AS id, n_nationkey % 5 IN (0, 1) AS is_test, n_nationkey % 5 IN (2, 4) AS is_fixture FROM (SELECT *, {_PLACES} AS path FROM nation)")(
    lambda spark, d: trade.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.expr(_PLACES).alias("path")).select("id", S.is_test_file(F.col("path")).alias("is_test"), S.is_fixture_path(F.col("path")).alias("is_fixture"))
)
query("scalars_of_confidence", "", "SELECT s_suppkey AS id, round(least(1.0, greatest(0.0, (s_suppkey % 10 / 10.0 + 0.8) / 2 - 0.05 + 0.1)), 9) AS composed FROM supplier")(
    lambda spark, d: trade.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.round(S.composed_confidence(F.col("s_suppkey") % 10 / 10.0, F.lit("Section"), F.lit(-0.05), F.lit(0.1), F.lit(0.0)), 9).alias("composed"))
)
query("one_edit_apart", "", "SELECT a.n_name AS a, b.n_name AS b FROM (SELECT n_name FROM nation) a, (SELECT n_name FROM nation) b WHERE levenshtein(a.n_name, b.n_name) <= 1 AND a.n_name <= b.n_name")(lambda spark, d: _near_names(spark, d))


def _near_names(spark, d):
    names = sorted(r.n_name for r in trade.table(spark, d, "nation").collect())
    return spark.createDataFrame([(a, b) for a in names for b in names if a <= b and one_edit_apart(a, b)], "a string, b string")


# -- search -------------------------------------------------------------------------------------------
def _docs(spark: SparkSession, d: str) -> T.Index:
    return trade.index(spark, d)


def _ways(spark: SparkSession, d: str) -> DataFrame:
    index = _docs(spark, d)
    return spark.createDataFrame([(q, T.search(index, q, None)[1]) for q in ("license zzzzqqqq", "licens", "zzzzqqqq", "mit license")], "asked string, way string")


query("search_fallbacks", "", "SELECT * FROM (VALUES ('license zzzzqqqq', 'any'), ('licens', 'prefix'), ('zzzzqqqq', 'prefix'), ('mit license', 'all')) t(asked, way)")(_ways)
query("search_sanitized", "", "SELECT * FROM (VALUES ('db.Open', '\"db.Open\"'), ('foo*', 'foo*'), ('don''t', 'dont'), ('a_b OR c', 'a_b OR c'), ('x OR y', '\"x OR y\"'), ('HandleIt', '\"HandleIt\"')) t(asked, sent)")(
    lambda spark, d: spark.createDataFrame([(q, T.sanitize(q)) for q in ("db.Open", "foo*", "don't", "a_b OR c", "x OR y", "HandleIt")], "asked string, sent string")
)
query("search_least_confidence", "", "SELECT * FROM (VALUES ('name', 'code', 0.0::DOUBLE), ('two words', 'code', 0.71::DOUBLE), ('two words', 'docs', 0.0::DOUBLE)) t(asked, corpus, least)")(
    lambda spark, d: spark.createDataFrame([(q, c, T.least_confidence(q, c)) for q, c in (("name", "code"), ("two words", "code"), ("two words", "docs"))], "asked string, corpus string, least double")
)
query("search_other_kinds", "symbols", "SELECT id, kind FROM symbols WHERE language = 'geo' AND kind <> 'Region'")(
    lambda spark, d: T.other_kinds(trade.symbols(spark, d).withColumn("name", F.col("language")), "geo", "Region")
)
query("search_snippets", "", "SELECT doc_id, array_to_string(string_split(text, chr(10))[1:5], chr(10)) AS snippet FROM documents WHERE text IS NOT NULL")(
    lambda spark, d: trade.table(spark, d, "documents").filter("text is not null").select("doc_id", T.snippet(F.col("text"), "two words").alias("snippet"))
)
query("search_exists", "symbols", "SELECT id FROM symbols WHERE name = 'Order#7'")(lambda spark, d: T.exists(trade.symbols(spark, d), T.build_index(trade.symbols(spark, d).filter("kind = 'Region'"), ["name"]), "Order#7").select("id"))

_GRAPHML_HEAD = (
    '<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<key id="name" for="node" attr.name="name" attr.type="string"/>',
    '<key id="kind" for="all" attr.name="kind" attr.type="string"/>', '<graph edgedefault="directed">',
)
_X = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
query("export_graphml", "symbols edges", f"""SELECT 0 AS part, array_to_string([{", ".join(f"'{x}'" for x in _GRAPHML_HEAD)}], chr(10)) AS value UNION ALL SELECT 3, '</graph>' || chr(10) || '</graphml>'
UNION ALL SELECT 1, '<node id="' || {_X.format('id')} || '"><data key="name">' || {_X.format('name')} || '</data><data key="kind">' || kind || '</data></node>' FROM symbols
UNION ALL SELECT 2, '<edge source="' || {_X.format('from_id')} || '" target="' || {_X.format('to_id')} || '"><data key="kind">' || kind || '</data></edge>' FROM edges WHERE kind = 'IMPORTS'""")(
    lambda spark, d: SK.graphml_lines(trade.symbols(spark, d), trade.edges(spark, d).filter("kind = 'IMPORTS'"))
)
