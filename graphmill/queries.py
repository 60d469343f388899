"""Named queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.functions import scalars as S
from graphmill.operators import closures as CL
from graphmill.operators import extract as X
from graphmill.operators import graph as G
from graphmill.operators import impact as I
from graphmill.operators import quality as Q
from graphmill.operators import resolve as R
from graphmill.operators import retrieval as RT
from graphmill.operators import search as T
from graphmill.operators import segments as SG
from graphmill.operators import store as K
from graphmill.operators import telemetry as M
from graphmill.plans.cut import cut, shared_folder
from graphmill.plans.planner import Engine
from graphmill.sources import files as FL
from graphmill.sources import sinks as SK
from graphmill.sources import trade

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_SYMBOL_PARTS = [
    ("region", "Region", "'geo/region'", "r_name", "'r'||r_regionkey", "geo", {}),
    ("nation", "Nation", "'geo/nation'", "n_name", "'n'||n_nationkey", "geo", {"parent": "'r'||n_regionkey"}),
    ("supplier", "Supplier", "'party/supplier'", "s_name", "'s'||s_suppkey", "party", {"is_exported": "s_acctbal >= 0"}),
    ("customer", "Customer", "'party/'||lower(c_mktsegment)", "c_name", "'c'||c_custkey", "party", {"is_exported": "c_acctbal >= 0"}),
    ("part", "Part", "'catalog/'||p_brand", "p_name", "'p'||p_partkey", "catalog", {
        "complexity": "p_size", "return_type": "p_type", "extraction_confidence": "CASE WHEN p_size <= 10 THEN 0.6::DOUBLE WHEN p_size <= 30 THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END"}),
    ("orders", "Order", "'order/'||o_orderpriority", "'Order#'||o_orderkey", "'o'||o_orderkey", "order", {
        "complexity": "floor(o_totalprice / 10000)::INT", "is_test": "o_orderstatus = 'P'", "is_entry_point": "o_orderstatus = 'O'"}),
]
_DEFAULTS = {"complexity": "0", "return_type": "NULL::VARCHAR", "parent": "NULL::VARCHAR", "is_exported": "false", "is_test": "false", "is_entry_point": "false", "extraction_confidence": "1.0::DOUBLE"}


def _symbols_sql() -> str:
    parts = []
    for table, kind, path, name, qn, language, given in _SYMBOL_PARTS:
        rest = ", ".join(f"{given.get(c, d)} AS {c}" for c, d in _DEFAULTS.items())
        parts.append(f"SELECT 'trade' AS project_id, {path}||'::'||{qn}||'#{kind}' AS id, {path} AS file_path, {name} AS name, {qn} AS qualified_name, '{kind}' AS kind, '{language}' AS language, {rest} FROM {table}")
    return "symbols AS MATERIALIZED (\n" + "\nUNION ALL ".join(parts) + ")"


_ORDER, _PART = "'order/'||o_orderpriority||'::o'||o_orderkey||'#Order'", "'catalog/'||p_brand||'::p'||p_partkey||'#Part'"
_SUPPLIER, _CUSTOMER = "'party/supplier::s'||{}||'#Supplier'", "'party/'||lower(c_mktsegment)||'::c'||c_custkey||'#Customer'"
_EDGES_SQL = f"""edges AS MATERIALIZED (
SELECT {_ORDER} AS from_id, {_PART} AS to_id, 'CALLS' AS kind, max(1 - l_discount) AS confidence FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
UNION ALL SELECT DISTINCT {_PART}, {_SUPPLIER.format('l_suppkey')}, 'CALLS', 1.0::DOUBLE FROM lineitem JOIN part ON l_partkey = p_partkey
UNION ALL SELECT DISTINCT {_ORDER}, {_SUPPLIER.format('l_suppkey')}, 'READS', 1.0::DOUBLE FROM lineitem JOIN orders ON l_orderkey = o_orderkey
UNION ALL SELECT {_ORDER}, {_CUSTOMER}, 'REFERENCES', 1.0::DOUBLE FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT {_SUPPLIER.format('s_suppkey')}, 'geo/nation::n'||s_nationkey||'#Nation', 'IMPORTS', 1.0::DOUBLE FROM supplier
UNION ALL SELECT {_CUSTOMER}, 'geo/nation::n'||c_nationkey||'#Nation', 'IMPORTS', 1.0::DOUBLE FROM customer
UNION ALL SELECT 'geo/nation::n'||n_nationkey||'#Nation', 'geo/region::r'||n_regionkey||'#Region', 'IMPORTS', 1.0::DOUBLE FROM nation)"""
_HANDOFF_SQL = """handoff AS MATERIALIZED (SELECT DISTINCT 'u'||user_id AS from_id, 'u'||nxt AS to_id, 'ASYNC_CALLS' AS kind FROM (SELECT user_id, lead(user_id) OVER (ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL)"""
_CALLS_SQL = """calls AS MATERIALIZED (SELECT *, CASE WHEN tokens_used + tokens_saved <> 0 THEN 100.0::DOUBLE * tokens_saved / (tokens_used + tokens_saved) END AS tokens_saved_pct FROM (
SELECT 's'||user_id AS session_id, event_type AS tool, CASE WHEN value < 50 THEN 'lite' WHEN value < 150 THEN 'standard' ELSE 'heavy' END AS complexity_tier, round(value * 10)::BIGINT * 4 AS response_bytes,
round(value * 10)::BIGINT AS tokens_used, CASE WHEN event_type <> 'error' THEN round(value * 30)::BIGINT END AS tokens_saved, ts AS moment, epoch_us(ts) * 1000 AS ts, event_id FROM events))"""
_HOOKS_SQL = """redirects AS (SELECT event_id AS id, 's'||user_id AS session_id, ts AS moment, event_type AS tool_name, round(value * 40)::BIGINT AS baseline_tokens, round(value * 10)::BIGINT AS est_tokens_served FROM events WHERE event_type IN ('view', 'click') AND value >= 100),
next3 AS (SELECT h.id, c.tool, row_number() OVER (PARTITION BY h.id ORDER BY c.moment, c.event_id) AS rn FROM redirects h JOIN calls c ON c.session_id = h.session_id AND c.moment > h.moment),
took AS (SELECT id, max((tool = 'purchase')::INT) AS took FROM next3 WHERE rn <= 3 GROUP BY id),
resolved AS MATERIALIZED (SELECT h.*, t.took AS took_recommendation FROM redirects h LEFT JOIN took t USING (id))"""
_WITH = {"symbols": _symbols_sql(), "edges": _EDGES_SQL, "handoff": _HANDOFF_SQL, "calls": _CALLS_SQL, "hooks": _CALLS_SQL + ",\n" + _HOOKS_SQL}


def _sql(needs: str, body: str, recursive: bool = False) -> str:
    parts = [_WITH[n] for n in needs.split()]
    return ("WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(parts) + "\n" if parts else "") + body


def query(name: str, needs: str = "", sql: str | None = None, recursive: bool = False):
    """Register a query, with SQL over the views that it needs."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = _sql(needs, sql, recursive)
        return f

    return add


def _engine(spark: SparkSession, d: str) -> Engine:
    return Engine(trade.symbols(spark, d), trade.edges(spark, d), trade.PROJECT, max_rows=None, unique_edges=True)


def _graph(name: str, text: str, sql: str, needs: str = "symbols edges", recursive: bool = False) -> None:
    query(name, needs, sql, recursive)(lambda spark, d: _engine(spark, d).query(text).df)


# -- query language ---------------------------------------------------------------------------------
_graph(
    "hop1_agg_topk", "MATCH (a:Order)-[:CALLS]->(b:Part) WHERE b.complexity > 40 RETURN b.name AS part, COUNT(*) AS calls ORDER BY calls DESC LIMIT 20",
    "SELECT b.name AS part, count(*) AS calls FROM edges e JOIN symbols a ON a.id = e.from_id JOIN symbols b ON b.id = e.to_id WHERE e.kind = 'CALLS' AND a.kind = 'Order' AND b.kind = 'Part' AND b.complexity > 40 GROUP BY 1 ORDER BY calls DESC, part LIMIT 20",
)
_graph("nodes_filter", "MATCH (n:Part) WHERE n.complexity >= 45 RETURN n.id AS id, n.name AS name, n.complexity AS complexity", "SELECT id, name, complexity FROM symbols WHERE kind = 'Part' AND complexity >= 45", "symbols")
_graph("nodes_inline_props", 'MATCH (n:Customer {file_path: "party/building"}) RETURN n.id AS id', "SELECT id FROM symbols WHERE kind = 'Customer' AND file_path = 'party/building'", "symbols")
_graph("nodes_predicates_text", 'MATCH (n) WHERE n.name CONTAINS "red" OR n.name STARTS WITH "blue" OR n.name ENDS WITH "gear" RETURN n.id AS id', "SELECT id FROM symbols WHERE contains(name, 'red') OR starts_with(name, 'blue') OR suffix(name, 'gear')", "symbols")
_graph("nodes_predicates_regex", 'MATCH (n:Part) WHERE n.name =~ "^(old|new) r" RETURN n.id AS id', "SELECT id FROM symbols WHERE kind = 'Part' AND regexp_matches(name, '^(old|new) r')", "symbols")
_graph("nodes_predicates_null", "MATCH (n) WHERE n.return_type IS NULL AND n.parent IS NOT NULL RETURN n.id AS id", "SELECT id FROM symbols WHERE (return_type IS NULL OR return_type = '') AND parent IS NOT NULL AND parent <> ''", "symbols")
_graph("nodes_predicates_in", 'MATCH (n:Part) WHERE n.return_type IN ["ECONOMY", "SMALL"] AND n.complexity IN [1, 2, 3] RETURN n.id AS id', "SELECT id FROM symbols WHERE kind = 'Part' AND return_type IN ('ECONOMY', 'SMALL') AND complexity IN (1, 2, 3)", "symbols")
_graph("nodes_predicates_not", 'MATCH (n) WHERE NOT (n.return_type = "ECONOMY" OR n.is_exported = true) AND n.kind <> "Order" RETURN n.id AS id', "SELECT id FROM symbols WHERE NOT (coalesce(return_type = 'ECONOMY', false) OR is_exported) AND kind <> 'Order'", "symbols")
_graph("nodes_predicates_inequality", 'MATCH (n) WHERE n.return_type <> "SMALL" AND n.language <> "order" RETURN n.id AS id', "SELECT id FROM symbols WHERE (return_type IS NULL OR return_type <> 'SMALL') AND language <> 'order'", "symbols")
_graph("nodes_bool_naked", "MATCH (n:Order) WHERE n.is_test RETURN n.id AS id", "SELECT id FROM symbols WHERE kind = 'Order' AND is_test", "symbols")
_graph("nodes_distinct", "MATCH (n) RETURN DISTINCT n.kind AS kind, n.language AS language", "SELECT DISTINCT kind, language FROM symbols", "symbols")
_graph("nodes_aggregates", "MATCH (n) RETURN n.kind AS kind, COUNT(*) AS n, COUNT(n.return_type) AS typed, COUNT(DISTINCT n.file_path) AS files, SUM(n.complexity) AS total, AVG(n.complexity) AS mean, MIN(n.complexity) AS low, MAX(n.complexity) AS high",
       "SELECT kind, count(*) AS n, count(return_type) AS typed, count(DISTINCT file_path) AS files, sum(complexity)::DOUBLE AS total, avg(complexity) AS mean, min(complexity)::DOUBLE AS low, max(complexity)::DOUBLE AS high FROM symbols GROUP BY kind", "symbols")
_graph("nodes_global_aggregate", "MATCH (n:Part) RETURN COUNT(*) AS n, SUM(n.name) AS text_sum, AVG(n.confidence) AS mean", "SELECT count(*) AS n, 0.0::DOUBLE AS text_sum, avg(extraction_confidence) AS mean FROM symbols WHERE kind = 'Part'", "symbols")
_graph("nodes_order_limit", "MATCH (n:Order) RETURN n.id AS id, n.complexity AS cx ORDER BY cx DESC LIMIT 50", "SELECT id, complexity AS cx FROM symbols WHERE kind = 'Order' ORDER BY cx DESC, id LIMIT 50", "symbols")
_graph("nodes_order_hidden_key", "MATCH (n:Part) RETURN n.id AS id ORDER BY n.complexity LIMIT 30", "SELECT id FROM symbols WHERE kind = 'Part' ORDER BY complexity NULLS FIRST, id LIMIT 30", "symbols")
_graph("hop1_edge_props", "MATCH (a:Order)-[r:CALLS]->(b:Part) WHERE r.confidence < 0.92 AND b.complexity = 7 RETURN a.id AS f, b.id AS t, r.confidence AS confidence",
       "SELECT e.from_id AS f, e.to_id AS t, e.confidence FROM edges e JOIN symbols b ON b.id = e.to_id WHERE e.kind = 'CALLS' AND b.kind = 'Part' AND b.complexity = 7 AND e.confidence < 0.92 AND e.from_id LIKE 'order/%'")
_graph("hop1_kinds", "MATCH (a)-[:IMPORTS|REFERENCES]->(b) RETURN b.kind AS kind, COUNT(*) AS n", "SELECT b.kind, count(*) AS n FROM edges e JOIN symbols a ON a.id = e.from_id JOIN symbols b ON b.id = e.to_id WHERE e.kind IN ('IMPORTS', 'REFERENCES') GROUP BY 1")
_graph("hop1_any_kind", "MATCH (a:Order)-->(b) RETURN b.kind AS kind, COUNT(DISTINCT b.id) AS n", "SELECT b.kind, count(DISTINCT b.id) AS n FROM edges e JOIN symbols a ON a.id = e.from_id JOIN symbols b ON b.id = e.to_id WHERE a.kind = 'Order' GROUP BY 1")
_graph("path_1_3", 'MATCH (a:Order {qualified_name: "o7"})-[:CALLS|IMPORTS*1..3]->(b) RETURN b.id AS id',
       "w AS (SELECT to_id AS node, 1 AS depth FROM edges JOIN symbols ON id = from_id WHERE qualified_name = 'o7' AND edges.kind IN ('CALLS', 'IMPORTS') UNION SELECT to_id, depth + 1 FROM w JOIN edges ON from_id = node WHERE edges.kind IN ('CALLS', 'IMPORTS') AND depth < 3) SELECT DISTINCT node AS id FROM w", "symbols edges", True)
_graph("path_2_3", 'MATCH (a:Order {qualified_name: "o7"})-[:CALLS|IMPORTS*2..3]->(b) RETURN b.kind AS kind, COUNT(*) AS n',
       "w AS (SELECT to_id AS node, 1 AS depth FROM edges JOIN symbols ON id = from_id WHERE qualified_name = 'o7' AND edges.kind IN ('CALLS', 'IMPORTS') UNION SELECT to_id, depth + 1 FROM w JOIN edges ON from_id = node WHERE edges.kind IN ('CALLS', 'IMPORTS') AND depth < 3) SELECT kind, count(*) AS n FROM (SELECT DISTINCT node FROM w WHERE depth >= 2) JOIN symbols ON id = node GROUP BY 1", "symbols edges", True)
_graph("path_inverted", 'MATCH (a)-[:CALLS*1..2]->(b) WHERE b.qualified_name = "s3" RETURN a.kind AS kind, COUNT(*) AS n',
       "w AS (SELECT from_id AS node, 1 AS depth FROM edges JOIN symbols ON id = to_id WHERE qualified_name = 's3' AND edges.kind = 'CALLS' UNION SELECT from_id, depth + 1 FROM w JOIN edges ON to_id = node WHERE edges.kind = 'CALLS' AND depth < 2) SELECT kind, count(*) AS n FROM (SELECT DISTINCT node FROM w) JOIN symbols ON id = node GROUP BY 1", "symbols edges", True)
for _n in ("path_1_3", "path_2_3", "path_inverted"):
    SQL[_n] = SQL[_n].replace(")\nw AS (", "),\nw AS (", 1)


@query("selfloop", "handoff", "SELECT from_id AS id FROM handoff WHERE from_id = to_id")
def _(spark, d):
    e = trade.handoff_edges(spark, d)
    nodes = e.select("project_id", F.col("from_id").alias("id")).union(e.select("project_id", F.col("to_id").alias("id"))).distinct()
    some = trade.symbols(spark, d).limit(0)
    symbols = some.unionByName(nodes, allowMissingColumns=True)
    return Engine(symbols, e, trade.HANDOFF, max_rows=None).query("MATCH (a)-[:ASYNC_CALLS]->(a) RETURN a.id AS id").df


# -- graph operators --------------------------------------------------------------------------------
_TRACE = """, w AS (SELECT 'u1' AS node, 0 AS depth, NULL::VARCHAR AS via UNION SELECT {far}, depth + 1, kind FROM w JOIN handoff ON {near} = node WHERE depth < 3)
SELECT node, min(depth) AS depth, min(via) AS via, CASE min(depth) WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM w WHERE node <> 'u1' GROUP BY node"""


def _traced(spark, d, way):
    start = spark.createDataFrame([("u1",)], "start string")
    return G.trace(trade.handoff_edges(spark, d), start, way, 3).drop("start")


for _way, _far, _near in (("out", "to_id", "from_id"), ("in", "from_id", "to_id")):
    query(f"trace_{_way}", "handoff", _TRACE.format(far=_far, near=_near).removeprefix(", "), True)(lambda spark, d, w=_way: _traced(spark, d, w))
    SQL[f"trace_{_way}"] = SQL[f"trace_{_way}"].replace(")\nw AS (", "),\nw AS (", 1)
query("trace_both", "handoff", """, w AS (SELECT 'u1' AS node, 0 AS depth UNION SELECT to_id, depth + 1 FROM w JOIN handoff ON from_id = node WHERE depth < 3),
v AS (SELECT 'u1' AS node, 0 AS depth UNION SELECT from_id, depth + 1 FROM v JOIN handoff ON to_id = node WHERE depth < 3)
SELECT node, min(depth) AS depth FROM (SELECT * FROM w UNION ALL SELECT * FROM v) WHERE node <> 'u1' GROUP BY node""", True)(lambda spark, d: _traced(spark, d, "both").select("node", "depth"))  # fmt: skip
query("trace_risk_counts", "handoff", _TRACE.format(far="from_id", near="to_id").replace("SELECT node, min", ", t AS (SELECT node, min") + ") SELECT depth, risk, count(*) AS n FROM t GROUP BY 1, 2", True)(
    lambda spark, d: G.trace_counts(G.trace(trade.handoff_edges(spark, d), spark.createDataFrame([("u1",)], "start string"), "in", 3)).drop("start")
)


@query("closure_d3", "edges", """, c AS (SELECT from_id, to_id, 1 AS depth FROM edges WHERE kind = 'CALLS' UNION SELECT c.from_id, e.to_id, depth + 1 FROM c JOIN edges e ON e.from_id = c.to_id WHERE e.kind = 'CALLS' AND depth < 3)
SELECT from_id, to_id, min(depth) AS depth, 'CALLS' AS via_kind FROM c WHERE from_id <> to_id GROUP BY 1, 2""", True)  # fmt: skip
def _(spark, d):
    return G.closure(trade.edges(spark, d), 3)


for _n in ("trace_both", "trace_risk_counts", "closure_d3"):
    SQL[_n] = SQL[_n].replace(")\n, ", "),\n", 1)


@query("closure_lookup", "edges", """c1 AS (SELECT to_id AS node, 1 AS depth FROM edges WHERE kind = 'CALLS' AND from_id LIKE '%::o7#Order'), c2 AS (SELECT e.to_id AS node, 2 AS depth FROM c1 JOIN edges e ON e.from_id = node WHERE e.kind = 'CALLS')
SELECT node, min(depth) AS depth, 'CALLS' AS via FROM (SELECT * FROM c1 UNION ALL SELECT * FROM c2) GROUP BY 1""")  # fmt: skip
def _(spark, d):
    start = trade.symbols(spark, d).filter(F.col("qualified_name") == "o7").select("id")
    return G.closure_lookup(G.closure(trade.edges(spark, d), 3, starts=start), start.first()[0], "out", 3, None)


SQL["closure_lookup"] = SQL["closure_lookup"].replace(")\nc1 AS", "),\nc1 AS", 1)


# A twentieth of the calls of orders come later, another goes, and so does what one part in ten calls.
_KEPT = "e AS (SELECT from_id, to_id FROM edges WHERE kind = 'CALLS' AND NOT (starts_with(from_id, 'order/') AND hash_of % 20 = 3) AND NOT (starts_with(from_id, 'catalog/') AND hash_of % 10 = 4))"
_AFTER = """, k AS (SELECT *, length(from_id) * 7 + length(to_id) * 3 + ascii(right(regexp_extract(from_id, '::(.*)#', 1), 1)) * 11 + ascii(right(regexp_extract(to_id, '::(.*)#', 1), 1)) AS hash_of FROM edges),
""" + _KEPT.replace("FROM edges", "FROM k") + """,
c AS (SELECT from_id, to_id, 1 AS depth FROM e UNION SELECT c.from_id, e.to_id, depth + 1 FROM c JOIN e ON e.from_id = c.to_id WHERE depth < 3)"""


def _hash_of():
    last = lambda c: F.ascii(F.right(F.regexp_extract(c, "::(.*)#", 1), F.lit(1)))
    return F.length("from_id") * 7 + F.length("to_id") * 3 + last("from_id") * 11 + last("to_id")


def _kept_closure(spark, d):
    """The closure after two changes, and the edges as they are then."""
    edges = cut(trade.edges(spark, d).filter("kind = 'CALLS'").select("from_id", "to_id", "kind").withColumn("h", _hash_of()))
    order = F.col("from_id").startswith("order/")
    came, went, parts = order & (F.col("h") % 20 == 7), order & (F.col("h") % 20 == 3), F.col("from_id").startswith("catalog/") & (F.col("h") % 10 == 4)
    kept = CL.Closures(spark, f"{shared_folder(spark)}/graphmill-walks/{uuid.uuid4().hex}", 3)
    kept.create(edges.filter(~came))
    kept.apply(edges.filter(~went), edges.filter(came | went))
    now = edges.filter(~went & ~parts)
    kept.apply(now, edges.filter(parts))
    return kept, now


query("closure_after_changes", "edges", _AFTER + " SELECT from_id, to_id, min(depth) AS depth, 'CALLS' AS via_kind FROM c WHERE from_id <> to_id GROUP BY 1, 2", True)(lambda spark, d: _kept_closure(spark, d)[0].table())
query("trace_by_closure", "edges", _AFTER + """ SELECT to_id AS start, from_id AS node, min(depth) AS depth, 'CALLS' AS via, CASE min(depth) WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' ELSE 'MEDIUM' END AS risk FROM c
WHERE starts_with(to_id, 'party/supplier') AND from_id <> to_id GROUP BY 1, 2""", True)(lambda spark, d: _by_closure(spark, d))  # fmt: skip
for _n in ("closure_after_changes", "trace_by_closure"):
    SQL[_n] = SQL[_n].replace(")\n, ", "),\n", 1)


def _by_closure(spark, d):
    kept, now = _kept_closure(spark, d)
    return CL.traced(now, trade.symbols(spark, d).filter("kind = 'Supplier'").select(F.col("id").alias("start")), "in", 9, kept=kept)


@query("callflow", "edges", """, w AS (SELECT 'party/supplier::s3#Supplier' AS node, 0 AS depth UNION SELECT from_id, depth + 1 FROM w JOIN edges ON to_id = node WHERE kind = 'CALLS' AND depth < 2),
n AS (SELECT node FROM (SELECT node, min(depth) AS depth FROM w GROUP BY node) ORDER BY depth, node LIMIT 60) SELECT DISTINCT from_id, to_id FROM edges WHERE kind = 'CALLS' AND from_id IN (FROM n) AND to_id IN (FROM n)""", True)  # fmt: skip
def _(spark, d):
    return G.callflow(trade.edges(spark, d), "party/supplier::s3#Supplier", "in", 2, 60)[1]


SQL["callflow"] = SQL["callflow"].replace(")\n, ", "),\n", 1)

query("hotspots", "symbols edges", "SELECT s.id, s.name, s.kind, s.file_path, count(*) AS in_degree FROM edges e JOIN symbols s ON s.id = e.to_id GROUP BY ALL ORDER BY in_degree DESC, id LIMIT 20")(
    lambda spark, d: G.hotspots(trade.symbols(spark, d), trade.edges(spark, d))
)
query("hotspot_risk", "symbols edges", """SELECT s.id, s.name, s.kind, s.file_path, coalesce(i, 0) AS incoming, coalesce(o, 0) AS outgoing, 0::BIGINT AS tests, coalesce(i, 0) + coalesce(o, 0) AS degree, 3 * coalesce(i, 0) + coalesce(o, 0) AS risk
FROM symbols s LEFT JOIN (SELECT to_id AS id, count(*) AS i FROM edges WHERE kind = 'CALLS' GROUP BY 1) x USING (id) LEFT JOIN (SELECT from_id AS id, count(*) AS o FROM edges WHERE kind = 'CALLS' GROUP BY 1) y USING (id)
WHERE s.kind IN ('Part', 'Supplier') AND (i IS NOT NULL OR o IS NOT NULL) ORDER BY risk DESC, incoming DESC, outgoing DESC, file_path, id LIMIT 25""")(
    lambda spark, d: G.risk_hotspots(trade.symbols(spark, d), trade.edges(spark, d), ("Part", "Supplier"), 25)
)
_PKG = "regexp_replace(split_part({}, '::', 1), '/[^/]*$', '')"
query("surprising_pairs", "edges", f"""SELECT from_package, to_package, count(*) AS edge_count, min((from_id, to_id, kind)).from_id AS example_from, min((from_id, to_id, kind)).to_id AS example_to, 'cross-package coupling' AS boundary
FROM (SELECT {_PKG.format('from_id')} AS from_package, {_PKG.format('to_id')} AS to_package, from_id, to_id, kind FROM edges) WHERE from_package <> to_package GROUP BY 1, 2 ORDER BY edge_count, from_package, to_package LIMIT 10""".replace("min((from_id, to_id, kind)).from_id", "min(struct_pack(a := from_id, b := to_id, c := kind)).a").replace("min((from_id, to_id, kind)).to_id", "min(struct_pack(a := from_id, b := to_id, c := kind)).b"))(
    lambda spark, d: G.surprising(trade.edges(spark, d), 10, None)
)
query("reverse_dependencies", "edges", "SELECT DISTINCT split_part(from_id, '::', 1) AS from_file, split_part(to_id, '::', 1) AS target_file FROM edges WHERE split_part(from_id, '::', 1) <> split_part(to_id, '::', 1)")(
    lambda spark, d: G.reverse_dependency_files(trade.symbols(spark, d), trade.edges(spark, d))
)
query("direct_callers", "edges", "SELECT DISTINCT from_id FROM edges WHERE kind IN ('CALLS', 'HTTP_CALLS', 'ASYNC_CALLS') AND to_id = 'party/supplier::s3#Supplier'")(
    lambda spark, d: G.direct_callers(trade.edges(spark, d), F.lit("party/supplier::s3#Supplier"))
)
query("neighborhood", "symbols", "SELECT id FROM symbols WHERE kind = 'Supplier' AND id <> 'party/supplier::s3#Supplier' ORDER BY id LIMIT 20 OFFSET 10")(
    lambda spark, d: G.neighborhood(trade.symbols(spark, d), "party/supplier::s3#Supplier", 10, 20).select("id")
)

# -- store ------------------------------------------------------------------------------------------
query("symbols_by_qualified_name", "symbols", "SELECT qualified_name, count(*) AS n, min(id) AS first_id FROM symbols GROUP BY 1")(
    lambda spark, d: K.by_qualified_name(trade.symbols(spark, d)).select("qualified_name", F.size("ids").cast("bigint").alias("n"), F.get("ids", F.lit(0)).alias("first_id"))
)
query("files_listing", "symbols", "SELECT project_id, file_path, count(*) AS n_symbols FROM symbols GROUP BY 1, 2")(lambda spark, d: K.files_of(trade.symbols(spark, d)).drop("file_hash"))
query("call_pairs", "edges", "SELECT from_id, to_id FROM edges WHERE kind = 'CALLS'")(lambda spark, d: K.call_pairs(trade.edges(spark, d)))
query("edges_of_node", "edges", "SELECT to_id, kind FROM edges WHERE from_id LIKE '%::o7#Order' AND kind IN ('CALLS', 'READS')")(
    lambda spark, d: trade.edges(spark, d).filter(F.col("from_id").endswith("::o7#Order") & F.col("kind").isin("CALLS", "READS")).select("to_id", "kind")
)


@query("symbol_upsert", "symbols", "SELECT id, CASE WHEN kind = 'Part' AND complexity > 30 THEN 'changed' ELSE name END AS name FROM symbols")
def _(spark, d):
    s = trade.symbols(spark, d).select("project_id", "id", "name", "kind", "complexity")
    changes = s.filter((F.col("kind") == "Part") & (F.col("complexity") > 30)).withColumn("v", F.lit(2)).withColumn("name", F.lit("changed"))
    older = changes.withColumn("v", F.lit(1)).withColumn("name", F.lit("older"))
    return K.upsert(s, changes.unionByName(older), ["project_id", "id"], "v").select("id", "name")


@query("edge_insert_or_ignore", "edges", "SELECT kind, count(*) AS n, max(confidence) AS best FROM edges GROUP BY 1")
def _(spark, d):
    e = trade.edges(spark, d)
    new = e.filter(F.col("kind") == "READS").withColumn("confidence", F.lit(9.0))
    return K.insert_edges(e, new).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("best"))


@query("edge_replace", "edges", "SELECT kind, count(*) AS n FROM edges WHERE kind <> 'READS' GROUP BY 1 UNION ALL SELECT 'READS', 1")
def _(spark, d):
    e = trade.edges(spark, d).withColumn("source", F.lit("resolve_pass"))
    return K.replace_edges(e, "READS", "resolve_pass", e.filter(F.col("kind") == "READS").orderBy("from_id", "to_id").limit(1)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("delete_file", "symbols edges", "SELECT 'symbol' AS what, count(*) AS n FROM symbols WHERE file_path <> 'party/supplier' UNION ALL SELECT 'edge', count(*) FROM edges WHERE split_part(from_id, '::', 1) <> 'party/supplier' AND split_part(to_id, '::', 1) <> 'party/supplier'")
def _(spark, d):
    s, e = K.delete_file(trade.symbols(spark, d), trade.edges(spark, d), spark.createDataFrame([("trade", "party/supplier")], "project_id string, file_path string"))
    return s.select(F.lit("symbol").alias("what")).union(e.select(F.lit("edge"))).groupBy("what").agg(F.count(F.lit(1)).alias("n"))


@query("move_detection", "symbols", "SELECT id AS old_id, 'moved/' || id AS new_id FROM symbols WHERE kind = 'Supplier'")
def _(spark, d):
    s = trade.symbols(spark, d).select("project_id", "id", "qualified_name", "kind")
    after = s.withColumn("id", F.when(F.col("kind") == "Supplier", F.concat(F.lit("moved/"), "id")).otherwise(F.col("id")))
    return K.detect_moves(s, after).select("old_id", "new_id")


# -- quality ----------------------------------------------------------------------------------------
query("dead_nodes", "symbols edges", "SELECT id FROM symbols s WHERE NOT is_exported AND NOT is_entry_point AND NOT is_test AND extraction_confidence >= 0.95 AND kind IN ('Order', 'Part') AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.to_id = s.id)")(
    lambda spark, d: Q.dead_nodes(trade.symbols(spark, d), trade.edges(spark, d), ("Order", "Part"), limit=None).select("id")
)
query("audit_unused", "symbols edges", "SELECT id, CASE WHEN extraction_confidence < 0.95 THEN 'medium' ELSE 'high' END AS confidence FROM symbols s WHERE NOT is_exported AND NOT is_entry_point AND NOT is_test AND extraction_confidence >= 0.5 AND kind IN ('Order', 'Part') AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.to_id = s.id)")(
    lambda spark, d: Q.audit_unused(trade.symbols(spark, d), trade.edges(spark, d), kinds=("Order", "Part"), min_confidence=0.5, limit=None).select("id", "confidence")
)
query("graph_stats", "symbols edges", "SELECT 'symbol' AS what, kind, count(*) AS n FROM symbols GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM edges GROUP BY kind")(
    lambda spark, d: Q.graph_stats(trade.symbols(spark, d), trade.edges(spark, d))
)
query("confidence_by_kind", "symbols", "SELECT kind, round(avg(extraction_confidence), 6) AS avg_confidence FROM symbols GROUP BY kind")(
    lambda spark, d: Q.confidence_by_kind(trade.symbols(spark, d)).withColumn("avg_confidence", F.round("avg_confidence", 6))
)
query("coverage_language", "symbols", "SELECT language, count(*) AS n, round(avg(extraction_confidence), 6) AS avg_confidence, CASE WHEN avg(extraction_confidence) >= 0.99 THEN 'AST' ELSE 'Regex' END AS parser FROM symbols GROUP BY language")(
    lambda spark, d: Q.language_coverage(trade.symbols(spark, d)).withColumn("avg_confidence", F.round("avg_confidence", 6))
)
query("coverage_kind_percentiles", "symbols", "SELECT kind, len(v)::BIGINT AS n, v[1 + (10 * (len(v) - 1)) // 100] AS p10, v[1 + (50 * (len(v) - 1)) // 100] AS p50 FROM (SELECT kind, list_sort(list(extraction_confidence)) AS v FROM symbols GROUP BY kind)")(
    lambda spark, d: Q.kind_percentiles(trade.symbols(spark, d))
)
query("confidence_histogram", "symbols", "SELECT CASE WHEN extraction_confidence < 0.5 THEN '0.0-0.5' WHEN extraction_confidence < 0.7 THEN '0.5-0.7' WHEN extraction_confidence < 0.9 THEN '0.7-0.9' ELSE '0.9-1.0' END AS bucket, count(*) AS n FROM symbols GROUP BY 1")(
    lambda spark, d: Q.confidence_histogram(trade.symbols(spark, d))
)
query("storage_estimate", "symbols edges", "SELECT 'trade' AS project_id, ((SELECT count(*) FROM symbols) * (384 + 192) + (SELECT count(*) FROM edges) * 160)::BIGINT AS bytes")(
    lambda spark, d: Q.storage_estimate(trade.symbols(spark, d), trade.edges(spark, d))
)
query("symbols_by_file", "symbols", "SELECT project_id, file_path, count(*) AS n FROM symbols GROUP BY 1, 2")(lambda spark, d: Q.symbols_by_file(trade.symbols(spark, d)))
query("parity", "symbols", "SELECT file_path, count(*) AS extracted, count(*) FILTER (complexity <= 40) AS stored FROM symbols GROUP BY 1 HAVING count(*) <> count(*) FILTER (complexity <= 40)")(
    lambda spark, d: Q.parity(trade.symbols(spark, d), trade.symbols(spark, d).filter("complexity <= 40"))
)
query("edge_ratio", "symbols edges", "SELECT 'trade' AS project_id, (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM edges) AS edges, round((SELECT count(*) FROM edges)::DOUBLE / (SELECT count(*) FROM symbols), 6) AS ratio")(
    lambda spark, d: Q.edge_ratio(trade.symbols(spark, d), trade.edges(spark, d)).withColumn("ratio", F.round("ratio", 6))
)
query("language_share", "symbols", "SELECT language, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM symbols GROUP BY 1")(
    lambda spark, d: I.language_share(trade.symbols(spark, d)).withColumn("share", F.round("share", 6))
)

# -- impact -----------------------------------------------------------------------------------------
_CHANGES = [("party/supplier", None, None), ("catalog/Brand#2", 1, 3), ("geo/nation", 5, 9)]


def _changes(spark):
    return spark.createDataFrame(_CHANGES, "file_path string, start_line int, end_line int")


query("changed_symbols", "symbols", "SELECT id FROM symbols WHERE file_path IN ('party/supplier', 'catalog/Brand#2')")(lambda spark, d: I.changed_symbols(trade.symbols(spark, d), _changes(spark)).select("id"))


@query("blast_radius", "symbols edges", """, c AS (SELECT id FROM symbols WHERE file_path IN ('party/supplier', 'catalog/Brand#2')),
w AS (SELECT id AS node, 0 AS depth FROM c UNION SELECT from_id, depth + 1 FROM w JOIN edges ON to_id = node WHERE kind = 'CALLS' AND depth < 2)
SELECT node AS id, min(depth) AS depth, CASE min(depth) WHEN 1 THEN 'CRITICAL' ELSE 'HIGH' END AS risk FROM w WHERE node NOT IN (FROM c) GROUP BY node""", True)  # fmt: skip
def _(spark, d):
    s, e = trade.symbols(spark, d), trade.edges(spark, d)
    return I.blast_radius(s, e, I.changed_symbols(s, _changes(spark)), 2).select("id", "depth", "risk")


SQL["blast_radius"] = SQL["blast_radius"].replace(")\n, c AS", "),\nc AS", 1)


@query("tests_ranked", "symbols edges", """, c AS (SELECT id FROM symbols WHERE file_path IN ('party/supplier', 'catalog/Brand#2')),
w AS (SELECT id AS start, id AS node, 0 AS depth FROM symbols WHERE is_test UNION SELECT start, to_id, depth + 1 FROM w JOIN edges ON from_id = node WHERE kind = 'CALLS' AND depth < 2)
SELECT start AS id, count(DISTINCT node) AS reaches FROM w WHERE depth > 0 AND node IN (FROM c) GROUP BY 1""", True)  # fmt: skip
def _(spark, d):
    s, e = trade.symbols(spark, d), trade.edges(spark, d)
    changed = I.changed_symbols(s, _changes(spark))
    return I.impacted_tests(I.blast_radius(s, e, changed, 2), e, changed, 2).select("id", "reaches")


SQL["tests_ranked"] = SQL["tests_ranked"].replace(")\n, c AS", "),\nc AS", 1)
query("callers_by_file", "symbols edges", "SELECT split_part(from_id, '::', 1) AS file_path, count(DISTINCT from_id) AS direct_callers FROM edges WHERE kind = 'CALLS' AND to_id LIKE 'party/supplier::%' GROUP BY 1")(
    lambda spark, d: I.callers_by_file(trade.symbols(spark, d), trade.edges(spark, d), trade.symbols(spark, d).filter("kind = 'Supplier'"))
)
query("plan_change", "symbols edges", """, w AS (SELECT 'party/supplier::s3#Supplier' AS node, 0 AS depth UNION SELECT from_id, depth + 1 FROM w JOIN edges ON to_id = node WHERE kind = 'CALLS' AND depth < 2)
SELECT s.id, min(depth) AS depth, bool_or(s.file_path NOT LIKE 'party/%') AS cross_package, bool_or(s.is_test) AS in_tests FROM w JOIN symbols s ON s.id = node WHERE depth > 0 GROUP BY 1""", True)(
    lambda spark, d: I.plan_change(trade.symbols(spark, d), trade.edges(spark, d), "party/supplier::s3#Supplier", 2).select("id", "depth", "cross_package", "in_tests")
)
SQL["plan_change"] = SQL["plan_change"].replace(")\n, w AS", "),\nw AS", 1)
query("assert_exists", "symbols", "SELECT count(*) > 0 AS passed FROM symbols WHERE name = 'Order#7'")(lambda spark, d: I.assert_exists(trade.symbols(spark, d), "Order#7"))
query("assert_max_callers", "edges", "SELECT count(DISTINCT from_id) AS callers, count(DISTINCT from_id) <= 50 AS passed FROM edges WHERE kind = 'CALLS' AND to_id = 'party/supplier::s3#Supplier'")(
    lambda spark, d: I.assert_max_callers(trade.edges(spark, d), "party/supplier::s3#Supplier", 50)
)
query("assert_no_callers_outside", "edges", "SELECT DISTINCT from_id FROM edges WHERE kind = 'CALLS' AND to_id = 'party/supplier::s3#Supplier' AND from_id NOT LIKE 'catalog/Brand#1::%' ORDER BY 1 LIMIT 10")(
    lambda spark, d: I.assert_no_callers_outside(trade.edges(spark, d), "party/supplier::s3#Supplier", ["catalog/Brand#1"])
)
query("assert_no_calls_to", "edges", "SELECT DISTINCT from_id, to_id FROM edges WHERE kind = 'CALLS' AND from_id LIKE 'order/1-URGENT::%' AND to_id LIKE 'catalog/Brand#3::%'")(
    lambda spark, d: I.assert_no_calls_to(trade.edges(spark, d), ["order/1-URGENT"], ["catalog/Brand#3"], None)
)
query("branch_overlap", "symbols", "SELECT 'file' AS what, 'catalog/Brand#2' AS name UNION ALL SELECT 'symbol', id FROM symbols WHERE file_path = 'catalog/Brand#2'")(
    lambda spark, d: I.branch_overlap(trade.symbols(spark, d), _changes(spark), spark.createDataFrame([("catalog/Brand#2", None, None), ("geo/region", 1, 1)], "file_path string, start_line int, end_line int"))
)
query("verify_change", "symbols", "SELECT id, CASE WHEN complexity > 45 AND return_type = 'SMALL' THEN 'as_planned' WHEN complexity > 45 THEN 'untouched' ELSE 'unplanned' END AS verdict FROM symbols WHERE kind = 'Part' AND (complexity > 45 OR return_type = 'SMALL')")(
    lambda spark, d: I.verify_change(trade.symbols(spark, d).filter("kind = 'Part' and complexity > 45"), trade.symbols(spark, d).filter("kind = 'Part' and return_type = 'SMALL'"))
)
query("boundary_edges", "symbols edges", "SELECT CASE WHEN starts_with(to_id, 'geo/') THEN 'in' ELSE 'out' END AS way, from_id, to_id, e.kind, a.name AS from_name, b.name AS to_name FROM edges e LEFT JOIN symbols a ON a.id = from_id LEFT JOIN symbols b ON b.id = to_id WHERE starts_with(from_id, 'geo/') <> starts_with(to_id, 'geo/') ORDER BY ALL LIMIT 50")(
    lambda spark, d: I.boundary_edges(trade.symbols(spark, d), trade.edges(spark, d), "geo")
)
query("onboard_summary", "symbols", "SELECT count(*) AS nodes, count(*) FILTER (is_entry_point) AS entry_points, count(*) FILTER (is_exported) AS exported, count(*) FILTER (is_test) AS tests, round(count(*) FILTER (is_test)::DOUBLE / count(*), 6) AS test_share, count(*) FILTER (is_test)::DOUBLE / count(*) >= 0.8 AS mostly_tests FROM symbols WHERE file_path LIKE 'order/%'")(
    lambda spark, d: I.onboard_summary(trade.symbols(spark, d), "order").withColumn("test_share", F.round("test_share", 6))
)
query("context", "symbols edges", "SELECT s.id, e.kind AS via, s.name, s.kind, s.file_path FROM edges e JOIN symbols s ON s.id = e.to_id WHERE e.from_id = 'party/supplier::s3#Supplier' AND e.kind IN ('CALLS', 'IMPORTS')")(
    lambda spark, d: I.context(trade.symbols(spark, d), trade.edges(spark, d), "party/supplier::s3#Supplier")
)
query("suspects", "symbols edges", """SELECT s.id, s.name, s.file_path, round(CASE WHEN name = 'Order#7' THEN 0.45 ELSE 0.20 END + CASE WHEN file_path = 'party/supplier' THEN 0.20 ELSE 0 END + 0.05 * least(coalesce(n, 0), 20) / 20.0, 6)::DOUBLE AS score
FROM symbols s LEFT JOIN (SELECT to_id AS id, count(*) AS n FROM edges GROUP BY 1) f USING (id) WHERE lower(name) IN ('order#7', 'supplier#000000003') ORDER BY score DESC, id LIMIT 20""".replace("CASE WHEN name = 'Order#7'", "CASE WHEN name IN ('Order#7', 'Supplier#000000003')"))(
    lambda spark, d: I.suspects(trade.symbols(spark, d), trade.edges(spark, d), ["Order#7", "Supplier#000000003"], ["party/supplier"]).withColumn("score", F.round("score", 6))
)

# -- telemetry --------------------------------------------------------------------------------------
_STATS = "{k}, count(*) AS calls, round(avg(tokens_used), 6) AS avg_tokens, sum(coalesce(tokens_used, 0))::BIGINT AS tokens_used, sum(coalesce(tokens_saved, 0))::BIGINT AS tokens_saved FROM calls"
_SEVEN = "(SELECT max(ts) FROM calls) - 604800000000000"


def _calls(spark, d):
    return trade.tool_calls(spark, d)


def _week(spark, d):
    log = _calls(spark, d)
    return log.join(F.broadcast(log.agg(F.max("ts").alias("__now"))), F.col("ts") >= F.col("__now") - M.WEEK)


query("tool_stats_7d", "calls", f"SELECT {_STATS.format(k='tool')} WHERE ts >= {_SEVEN} GROUP BY tool")(lambda spark, d: M.tool_stats(_week(spark, d)).withColumn("avg_tokens", F.round("avg_tokens", 6)))
query("tool_stats_all", "calls", f"SELECT {_STATS.format(k='tool')} GROUP BY tool")(lambda spark, d: M.tool_stats(_calls(spark, d)).withColumn("avg_tokens", F.round("avg_tokens", 6)))
query("tier_stats", "calls", f"SELECT {_STATS.format(k='complexity_tier')} GROUP BY complexity_tier")(lambda spark, d: M.tier_stats(_calls(spark, d)).withColumn("avg_tokens", F.round("avg_tokens", 6)))
query("savings_rows", "calls", "SELECT tool, complexity_tier, count(*) AS calls, sum(tokens_used)::BIGINT AS tokens_used, sum(tokens_saved)::BIGINT AS tokens_saved, count(*) FILTER (tokens_used IS NULL) AS missing_used, count(*) FILTER (tokens_saved IS NULL) AS missing_saved, min(ts) AS first_ts, max(ts) AS last_ts FROM calls GROUP BY 1, 2")(
    lambda spark, d: M.savings_rows(_calls(spark, d))
)
query("savings_window", "calls", "SELECT calls, tokens_used, tokens_saved, missing, tokens_used + tokens_saved AS baseline, CASE WHEN missing = 0 THEN round(100.0::DOUBLE * tokens_saved / (tokens_used + tokens_saved), 6) END AS saved_pct, missing = 0 AS claimable FROM (SELECT count(*) AS calls, sum(tokens_used)::BIGINT AS tokens_used, sum(tokens_saved)::BIGINT AS tokens_saved, count(*) FILTER (tokens_saved IS NULL) AS missing FROM calls WHERE tool <> 'error')")(
    lambda spark, d: M.savings_window(_calls(spark, d).filter("tool <> 'error'")).withColumn("saved_pct", F.round("saved_pct", 6))
)
query("payload_stats", "calls", "SELECT tool, count(*) AS calls, min(response_bytes) AS min_bytes, round(avg(response_bytes), 6) AS avg_bytes, max(response_bytes) AS max_bytes, sum(response_bytes)::BIGINT AS sum_bytes FROM calls GROUP BY 1")(
    lambda spark, d: M.payload_stats(_calls(spark, d)).withColumn("avg_bytes", F.round("avg_bytes", 6))
)
query("payload_outliers", "calls", "SELECT tool, round(max(response_bytes) / avg(response_bytes), 6) AS ratio FROM calls GROUP BY 1 HAVING max(response_bytes) / avg(response_bytes) >= 3 AND max(response_bytes) >= 2000 ORDER BY ratio DESC, tool LIMIT 3")(
    lambda spark, d: M.payload_outliers(_calls(spark, d), 3, 2000).select("tool", F.round("ratio", 6).alias("ratio"))
)
query("tool_mix_entropy", "calls", "SELECT sum(n)::BIGINT AS calls, round(-sum(n / t * log2(n / t)), 6) AS entropy, round(max(n / t), 6) AS top_share, false AS stuck FROM (SELECT tool, count(*)::DOUBLE AS n, sum(count(*)::DOUBLE) OVER () AS t FROM calls GROUP BY tool)")(
    lambda spark, d: Q.tool_mix(_calls(spark, d)).withColumn("entropy", F.round("entropy", 6)).withColumn("top_share", F.round("top_share", 6))
)
query("session_rollup", "calls", "SELECT session_id, count(*) AS calls, sum(tokens_used)::BIGINT AS tokens_used, coalesce(sum(tokens_saved), 0)::BIGINT AS tokens_saved, min(ts) AS first_ts, max(ts) AS last_ts FROM calls GROUP BY 1")(lambda spark, d: M.session_rollup(_calls(spark, d)))
query("calls_by_language", "", "SELECT 'k' AS language, sum((props->>'k')::BIGINT)::BIGINT AS calls FROM events")(lambda spark, d: M.calls_by_language(trade.table(spark, d, "events"), "props"))
query("recent_calls", "calls", "SELECT event_id::VARCHAR AS request_id, tool, ts FROM calls WHERE session_id = 's1' ORDER BY ts DESC, request_id DESC LIMIT 20")(
    lambda spark, d: M.recent_calls(_calls(spark, d), "s1", 20).select("request_id", "tool", "ts")
)


def _resolved(spark, d):
    return M.resolve_hooks(trade.hooks(spark, d), _calls(spark, d))


query("hook_next3", "hooks", "SELECT id, took_recommendation FROM resolved")(lambda spark, d: _resolved(spark, d).select("id", "took_recommendation"))
query("hook_conversion", "hooks", "SELECT count(*) AS redirects, count(*) FILTER (took_recommendation = 1) AS taken, count(took_recommendation) AS resolved, count(*) FILTER (took_recommendation = 0) AS ignored, round(100.0::DOUBLE * count(*) FILTER (took_recommendation = 1) / count(*), 6) AS conversion_pct, round(100.0::DOUBLE * count(*) FILTER (took_recommendation = 0) / count(took_recommendation), 6) AS override_pct FROM resolved")(
    lambda spark, d: M.hook_conversion(_resolved(spark, d)).withColumn("conversion_pct", F.round("conversion_pct", 6)).withColumn("override_pct", F.round("override_pct", 6))
)
query("hook_counts", "", "SELECT event_type AS tool_name, CASE WHEN value >= 100 THEN 'redirect' ELSE 'pass_through' END AS decision, count(*) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2")(lambda spark, d: M.hook_counts(trade.hooks(spark, d)))
query("hook_savings", "", "SELECT sum(round(value * 10)::BIGINT)::BIGINT AS served, sum(round(value * 40)::BIGINT)::BIGINT AS baseline FROM events WHERE event_type IN ('view', 'click')")(lambda spark, d: M.hook_savings(trade.hooks(spark, d)))
query("hook_tokens_left", "hooks", "SELECT count(*) AS ignored, sum(greatest(baseline_tokens - est_tokens_served, 0))::BIGINT AS tokens_left FROM resolved WHERE took_recommendation = 0")(lambda spark, d: M.tokens_left(_resolved(spark, d)))
query("opening_sessions", "calls", "SELECT count(DISTINCT session_id) AS sessions, count(DISTINCT CASE WHEN tool = 'signup' AND rn <= 3 THEN session_id END) AS opening FROM (SELECT session_id, tool, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS rn FROM calls)")(
    lambda spark, d: M.opening_sessions(_calls(spark, d), "signup")
)


@query("les_week_over_week", "hooks", """SELECT week, tokens_used, calls, recovery, coalesce(wasted, 0) AS wasted, round(coalesce(wasted, 0)::DOUBLE / calls, 9) AS waste_rate, round(tokens_used::DOUBLE / counted, 6) AS iteration_cost FROM (
SELECT CASE WHEN ts >= now - 604800000000000 THEN 'this' ELSE 'before' END AS week, sum(tokens_used)::BIGINT AS tokens_used, count(*) AS calls, count(*) FILTER (tool = 'error') AS recovery FROM calls, (SELECT max(ts) AS now FROM calls) WHERE ts >= now - 2 * 604800000000000 GROUP BY 1)
LEFT JOIN (SELECT CASE WHEN epoch_us(moment) * 1000 >= now - 604800000000000 THEN 'this' ELSE 'before' END AS week, count(*) AS wasted FROM resolved, (SELECT max(ts) AS now FROM calls) WHERE took_recommendation = 0 AND epoch_us(moment) * 1000 >= now - 2 * 604800000000000 GROUP BY 1) USING (week),
(SELECT count(*) AS counted FROM conversations WHERE trim(role) <> '' AND text NOT LIKE 'HANDOFF%')""")  # fmt: skip
def _(spark, d):
    log = _calls(spark, d)
    ignored = _resolved(spark, d).filter("took_recommendation = 0").select((trade.micros(F.col("at")) * 1000).alias("ts"))
    out = M.efficiency(log, ignored, trade.loop_checkpoints(spark, d), M.latest(log), "signup", "error")
    return out.withColumn("waste_rate", F.round("waste_rate", 9)).withColumn("iteration_cost", F.round("iteration_cost", 6))


# Purchases are checkpoints, of which small ones decide nothing; signups are calls of the loop; views of small value found nothing.
_LES = """wk AS (SELECT *, CASE WHEN ts >= now - 604800000000000 THEN 'this' WHEN ts >= now - 2 * 604800000000000 THEN 'before' END AS week FROM calls, (SELECT max(ts) AS now FROM calls)),
les AS MATERIALIZED (SELECT week, sum(tokens_used)::BIGINT AS tokens_used, count(*) AS calls, count(*) FILTER (tool = 'view' AND tokens_used < 300) AS wasted, count(*) FILTER (tool = 'purchase' AND tokens_used >= 50) AS checkpoints,
count(*) FILTER (tool = 'error') AS recovery_load FROM wk WHERE week IS NOT NULL GROUP BY 1),
op AS (SELECT week, count(*) AS sessions, sum(o)::BIGINT AS opening FROM (SELECT week, session_id, max((tool = 'signup')::INT) AS o FROM (SELECT *, row_number() OVER (PARTITION BY week, session_id ORDER BY ts, event_id) AS rn FROM wk WHERE week IS NOT NULL) WHERE rn <= 3 GROUP BY 1, 2) GROUP BY 1),
lw AS (SELECT *, wasted::DOUBLE / calls AS waste_rate, tokens_used::DOUBLE / checkpoints AS iteration_cost, opening::DOUBLE / sessions AS continuation_fidelity FROM les JOIN op USING (week)),
cand AS (SELECT unnest([{'s': 'iteration_cost', 'on': a.iteration_cost > b.iteration_cost, 't': trunc((a.iteration_cost - b.iteration_cost) * a.checkpoints)::BIGINT, 'k': 0},
{'s': 'waste_rate', 'on': a.waste_rate > b.waste_rate, 't': trunc((a.waste_rate - b.waste_rate) * a.calls * (a.tokens_used // a.calls))::BIGINT, 'k': 1}, {'s': 'recovery_load', 'on': a.recovery_load > b.recovery_load, 't': 0, 'k': 2},
{'s': 'continuation_fidelity', 'on': a.continuation_fidelity < b.continuation_fidelity, 't': 0, 'k': 3}], recursive := true) FROM (SELECT * FROM lw WHERE week = 'this') a, (SELECT * FROM lw WHERE week = 'before') b)"""


def _les(spark, d):
    log = _calls(spark, d)
    ledger = log.filter("tool = 'purchase'").select("ts", F.lit("claim").alias("claim"), F.when(F.col("tokens_used") < 50, " ").otherwise("go on").alias("decision"))
    return M.les_weeks(log, ledger, M.latest(log), None, _empty_views(log), "signup", "error")


def _empty_views(log):
    return log.filter("tool = 'view' and tokens_used < 300")


query("les_weeks", "calls", ", " + _LES + "\nSELECT week, tokens_used, calls, wasted, round(waste_rate, 9) AS waste_rate, checkpoints, round(iteration_cost, 6) AS iteration_cost, recovery_load, sessions, opening, round(continuation_fidelity, 9) AS continuation_fidelity FROM lw")(
    lambda spark, d: _les(spark, d).withColumns({c: F.round(c, n) for c, n in (("waste_rate", 9), ("iteration_cost", 6), ("continuation_fidelity", 9))})
)
query("les_regression", "calls", ", " + _LES + """
SELECT 'les_regression' AS pattern, s AS sub_metric, (SELECT count(*) FROM cand WHERE "on")::INT AS occurrences, t AS tokens FROM cand WHERE "on" ORDER BY t DESC, k LIMIT 1""")(lambda spark, d: M.les_regression(_les(spark, d)))
query("coach_churn", "calls", ", " + _LES + """
SELECT * FROM (SELECT 'zero_result_churn' AS pattern, count(*) AS occurrences, sum(tokens_used)::BIGINT AS tokens FROM wk WHERE tool = 'view' AND tokens_used < 300 UNION ALL SELECT 'les_regression', (SELECT count(*) FROM cand WHERE "on"), t FROM (SELECT * FROM cand WHERE "on" ORDER BY t DESC, k LIMIT 1))""")(
    lambda spark, d: M.coach(_calls(spark, d), 120, None, (), (), _empty_views(_calls(spark, d)), M.les_regression(_les(spark, d)))
)
for _n in ("les_weeks", "les_regression", "coach_churn"):
    SQL[_n] = SQL[_n].replace("\n, wk AS", ",\nwk AS", 1)
# Turns as searches, of which some found nothing; their texts share common words.
query("churn_runs", "", """WITH t AS (SELECT conv_id AS s, turn AS n, text IS NOT NULL AND length(text) % 4 <> 0 AS e, length(text) AS u, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')) AS w FROM conversations),
p AS (SELECT *, lag(w) OVER o AS v, lag(e) OVER o AS f FROM t WINDOW o AS (PARTITION BY s ORDER BY n)),
b AS (SELECT *, coalesce(e AND f AND len(list_distinct(w || v)) > 0 AND len(list_intersect(w, v)) >= 0.05 * len(list_distinct(w || v)), false) AS again FROM p),
i AS (SELECT *, sum((NOT again)::INT) OVER (PARTITION BY s ORDER BY n) AS island FROM b)
SELECT s::VARCHAR AS session_id, min(n) AS first, max(n) AS last, count(*) AS searches, sum(u)::BIGINT AS tokens FROM i WHERE e GROUP BY s, island HAVING count(*) > 1""")(lambda spark, d: _churn(spark, d))  # fmt: skip


def _churn(spark, d):
    c = trade.table(spark, d, "conversations")
    found = F.when(F.col("text").isNotNull() & (F.length("text") % 4 != 0), 0).otherwise(1)
    searches = c.select(F.col("conv_id").cast("string").alias("session_id"), F.floor(F.col("turn") / 2).alias("part"), F.col("turn").alias("at"), "text", found.alias("results"), F.length("text").cast("long").alias("tokens_used"))
    return M.churn_runs(searches, 0.05)


query("coach_findings", "calls", """SELECT * FROM (SELECT 'single_fact_burst' AS pattern, count(*) FILTER (tool IN ('click', 'view') AND tokens_used < 600) AS occurrences, (count(*) FILTER (tool IN ('click', 'view') AND tokens_used < 600) - 1) * 120 AS tokens FROM calls
UNION ALL SELECT 'unbudgeted_heavy_context', count(*), sum(tokens_used - 800)::BIGINT FROM calls WHERE tool = 'purchase' AND tokens_used > 2000)""")(
    lambda spark, d: M.coach(_calls(spark, d), 120, None, ("click", "view"), ("purchase",))
)
query("milestones", "calls", "SELECT s AS saved, max(t) AS threshold FROM (SELECT sum(tokens_saved)::BIGINT AS s FROM calls), (VALUES (100000), (1000000), (10000000), (100000000), (1000000000)) v(t) WHERE t <= s GROUP BY s".replace("max(t)", "max(t)::BIGINT"))(
    lambda spark, d: M.milestones(_calls(spark, d))
)
query("loop_stats", "", "SELECT conv_id::VARCHAR AS loop_name, count(*) AS checkpoints, (max(turn) + 1)::INT AS last_seq, arg_max(CASE WHEN text <> '' THEN text ELSE role END, turn) AS latest FROM conversations GROUP BY 1")(lambda spark, d: M.loop_stats(trade.loop_checkpoints(spark, d)))
query("loop_checkpoints_counted", "", "SELECT count(*) FILTER (trim(role) <> '' AND text NOT LIKE 'HANDOFF%') AS counted, count(*) AS total FROM conversations")(lambda spark, d: M.counted_checkpoints(trade.loop_checkpoints(spark, d)))
query("tool_latency", "calls", "SELECT tool, len(v)::BIGINT AS n, list_sum(v)::BIGINT AS total, round(list_sum(v)::DOUBLE / len(v), 6) AS mean, v[-1] AS largest, v[1 + len(v) // 2] AS p50, v[1 + len(v) * 95 // 100] AS p95 FROM (SELECT tool, list_sort(list(tokens_used)) AS v FROM calls GROUP BY tool)")(
    lambda spark, d: M.latency(_calls(spark, d), "tool", "tokens_used").withColumn("mean", F.round("mean", 6))
)

# -- search -----------------------------------------------------------------------------------------
_INDEX = """tok AS MATERIALIZED (SELECT id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id AS id, regexp_extract_all(translate(lower(source || ' ' || text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\\p{L}\\p{N}]+') AS w FROM documents)),
len AS (SELECT id, count(*) AS length FROM tok GROUP BY id), st AS (SELECT count(*) AS n, avg(length) AS al FROM len), post AS (SELECT term, id, count(*) AS tf FROM tok GROUP BY 1, 2)"""
_BM25 = """SELECT id, round(sum(ln(1.0::DOUBLE + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / al))), 6) AS score FROM (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM hits) JOIN len USING (id), st GROUP BY id HAVING count(DISTINCT grp) = {groups}"""


def _searched(text):
    def run(spark, d):
        index = trade.index(spark, d)
        return T.score(index, T.parse(text)).withColumn("score", F.round("score", 6))

    return run


def _search_sql(hits: str, groups: int) -> str:
    return f"WITH {_INDEX},\nhits AS ({hits})\n" + _BM25.format(groups=groups)


for _name, _text, _hits, _groups in (
    ("bm25_and", "the of license", "SELECT term, id, tf, term AS grp FROM post WHERE term IN ('the', 'of', 'license')", 3),
    ("bm25_or", "license OR mit OR apache", "SELECT term, id, tf, 1 AS grp FROM post WHERE term IN ('license', 'mit', 'apache')", 1),
    ("bm25_prefix", "licens*", "SELECT 'licens*' AS term, id, sum(tf) AS tf, 1 AS grp FROM post WHERE starts_with(term, 'licens') GROUP BY id", 1),
    ("bm25_phrase", '"mit license"', "SELECT 'p' AS term, a.id, count(*) AS tf, 1 AS grp FROM tok a JOIN tok b ON a.id = b.id AND b.pos = a.pos + 1 WHERE a.term = 'mit' AND b.term = 'license' GROUP BY a.id", 1),
):
    QUERIES[_name], SQL[_name] = _searched(_text), _search_sql(_hits, _groups)


# A tenth of the documents, dealt into four changes: texts replaced, documents added, documents removed.
_CHANGED = """SELECT doc_id, source || CASE WHEN doc_id % 40 IN (3, 13, 23) THEN ' replaced license' ELSE '' END AS source, text FROM documents WHERE doc_id % 40 NOT IN (7, 17)
UNION ALL SELECT doc_id + 1000000000, source, text FROM documents WHERE doc_id % 40 = 29"""
query("index_after_changes", "", _search_sql("SELECT term, id, tf, 1 AS grp FROM post WHERE term IN ('license', 'replaced', 'mit')", 1).replace("FROM documents)", f"FROM ({_CHANGED}))"))(
    lambda spark, d: T.score(_changed(spark, d).index(), T.parse("license OR replaced OR mit")).withColumn("score", F.round("score", 6))
)
query("index_fragments", "", f"SELECT 2 AS segments, 1 AS tombstones, count(*) AS n, (SELECT count(*) FROM documents WHERE doc_id % 40 IN (3, 7, 13, 17, 23)) AS dead, false AS due FROM ({_CHANGED})")(
    lambda spark, d: _changed(spark, d).fragmentation().drop("dead_share")
)


def _changed(spark, d):
    """The documents' index after four changes, of which three wrote a segment and the last merged them."""
    docs = trade.corpus(spark, d).select("id", "name", "docstring")
    some = lambda *rest: docs.filter((F.col("id") % 40).isin(*rest))
    replaced = lambda *rest: some(*rest).withColumn("name", F.concat("name", F.lit(" replaced license")))
    index = SG.Segments(spark, f"{shared_folder(spark)}/graphmill-walks/{uuid.uuid4().hex}", ["name", "docstring"])
    index.create(docs)
    index.apply(replaced(3, 13), some(7))
    index.apply(some(29).withColumn("id", F.col("id") + 1_000_000_000))
    index.apply(replaced(23))
    index.apply(replaced(3), some(17))
    return index


query("retrieve_batch", "", f"""WITH {_INDEX},
asked AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\\p{{L}}\\p{{N}}]+'))) AS term FROM benchmark),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
s AS (SELECT query_id, id, round(sum(ln(1.0::DOUBLE + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / al))), 9) AS score FROM asked JOIN post USING (term) JOIN dfs USING (term) JOIN len USING (id), st GROUP BY 1, 2)
SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5""")(
    lambda spark, d: RT.batch_search(trade.index(spark, d), trade.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 5).withColumn("score", F.round("score", 6))
)
query("search_term_frequencies", "", f"WITH {_INDEX} SELECT term, count(*) AS df, sum(tf)::BIGINT AS n FROM post GROUP BY term HAVING count(*) >= 20")(
    lambda spark, d: trade.index(spark, d).postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n")).filter("df >= 20")
)
query("corpus_routing", "symbols", "SELECT 'code' AS corpus, count(*) AS n FROM symbols")(lambda spark, d: T.route(trade.symbols(spark, d)).groupBy("corpus").agg(F.count(F.lit(1)).alias("n")))
query("approx_tokens", "", "SELECT doc_id, ((octet_length(encode(text)) + 3) // 4)::BIGINT AS tokens FROM documents")(lambda spark, d: trade.table(spark, d, "documents").select("doc_id", S.approx_tokens(F.col("text")).alias("tokens")))

# -- files, extraction and streaming ----------------------------------------------------------------
query("file_languages", "", "SELECT page_id, CASE WHEN regexp_matches(url, '\\.html?$') THEN 'HTML' END AS language FROM pages")(
    lambda spark, d: trade.files(spark, d).select("page_id", FL.language(F.col("path")).alias("language"))
)
query("hash_skip", "", "SELECT page_id FROM pages WHERE page_id % 3 <> 0")(
    lambda spark, d: _hashed(spark, d).join(_hashed(spark, d).filter("page_id % 3 = 0").select("path", "hash"), ["path", "hash"], "left_anti").select("page_id")
)


def _hashed(spark, d):
    return trade.files(spark, d).withColumn("hash", F.hex(F.xxhash64("content")))


def _extracted(spark, d):
    return X.extract(trade.files(spark, d).withColumn("language", F.lit("HTML")))


_PAGE = "url"
_WORDS = "trim(regexp_replace(replace(replace(replace(regexp_extract(html, '<{0}>([^<]*)</{0}>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\\s+', ' ', 'g'))"
_LINE = "(1 + length(split_part(html, '<{0}>', 1)) - length(replace(split_part(html, '<{0}>', 1), chr(10), '')))::INT"
query("html_sections", "", f"""SELECT {_PAGE} || '::title.0.' || name || '#Document' AS id, 'Document' AS kind, name, start_line, 0.75::DOUBLE AS extraction_confidence FROM (SELECT url, {_WORDS.format('title')} AS name, {_LINE.format('title')} AS start_line FROM pages)
UNION ALL SELECT {_PAGE} || '::h1.1.' || name || '#Section', 'Section', name, start_line, 0.8::DOUBLE FROM (SELECT url, {_WORDS.format('h1')} AS name, {_LINE.format('h1')} AS start_line FROM pages)""")(
    lambda spark, d: X.symbols_of(_extracted(spark, d), "pages").select("id", "kind", "name", "start_line", "extraction_confidence")
)
query("html_imports", "", f"""SELECT DISTINCT {_PAGE} AS from_file, 'IMPORTS' AS kind, regexp_replace(link, '[?#].*$', '') AS to_name FROM (SELECT url, unnest(list_distinct(regexp_extract_all(html, '<a href="([^"]+)"', 1))) AS link FROM pages)
WHERE NOT contains(link, '://') AND NOT regexp_matches(link, '^(#|mailto:|javascript:|//)')""")(
    lambda spark, d: X.pending_of(_extracted(spark, d), "pages").select("from_file", "kind", "to_name").distinct()
)
query("html_title_count", "", "SELECT 'Document' AS kind, count(*) AS n FROM pages WHERE contains(html, '<title>')")(
    lambda spark, d: X.symbols_of(_extracted(spark, d), "pages").filter("kind = 'Document'").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
)
query("export_dangling", "edges", "SELECT kind, count(*) AS n FROM edges WHERE split_part(to_id, '::', 1) <> 'party/supplier' AND split_part(from_id, '::', 1) <> 'party/supplier' GROUP BY 1")(
    lambda spark, d: SK.without_dangling(trade.symbols(spark, d).filter("kind <> 'Supplier'"), trade.edges(spark, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
)
query("export_tsv", "symbols", "SELECT concat_ws(chr(9), id, name, complexity::VARCHAR) AS value FROM symbols WHERE kind = 'Part'")(
    lambda spark, d: SK.tsv(trade.symbols(spark, d).filter("kind = 'Part'"), ["id", "name", "complexity"])
)
query("prometheus_text", "calls", "SELECT 'tool_calls_total{tool=\"' || tool || '\"} ' || count(*) AS value FROM calls GROUP BY tool UNION ALL SELECT 'tool_tokens_sum{tool=\"' || tool || '\"} ' || sum(tokens_used) FROM calls GROUP BY tool UNION ALL SELECT 'tool_tokens_count{tool=\"' || tool || '\"} ' || count(*) FROM calls GROUP BY tool")(
    lambda spark, d: SK.prometheus(_calls(spark, d))
)


@query("tumbling_counts", "", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    e = trade.table(spark, d, "events")
    return e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


@query("sliding_counts", "", "SELECT day + s::INT AS start_day, event_type, count(*) AS n FROM (SELECT ts::DATE AS day, event_type FROM events), range(-6, 1) r(s) GROUP BY 1, 2")
def _(spark, d):
    e = trade.table(spark, d, "events")
    out = e.groupBy(F.window("ts", "7 days", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.to_date("window.start").alias("start_day"), "event_type", "n")


@query("session_windows", "", """SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2) GROUP BY 1""")  # fmt: skip
def _(spark, d):
    e = trade.table(spark, d, "events")
    s = e.groupBy(F.session_window("ts", "6 hours"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


@query("imports_resolved", "", "SELECT 'order' || (o_orderkey % 7) AS from_qn, CASE WHEN o_orderkey % 3 = 0 THEN '@external' ELSE 'lib' END AS place, count(DISTINCT o_orderkey % 5) AS n FROM orders GROUP BY 1, 2")
def _(spark, d):
    """Imports of made names: a third of them have no definition and become external modules."""
    o = trade.table(spark, d, "orders").select(F.concat(F.lit("order"), F.col("o_orderkey") % 7).alias("from_qn"), (F.col("o_orderkey") % 3 == 0).alias("ext"), F.concat(F.lit("m"), F.col("o_orderkey") % 5).alias("m")).distinct()
    name = F.when(F.col("ext"), F.concat(F.lit("none."), "m")).otherwise(F.col("m"))
    one = lambda c: F.lit(c)
    pending = o.select(one("p").alias("project_id"), F.concat("from_qn", F.lit(".go")).alias("from_file"), one("IMPORTS").alias("kind"), "from_qn", name.alias("to_name"), F.lit(1.0).alias("confidence"))
    node = lambda df, c, f: df.select(one("p").alias("project_id"), S.symbol_id(f, F.col(c), F.lit("Module")).alias("id"), f.alias("file_path"), F.col(c).alias("name"), F.col(c).alias("qualified_name"), one("Module").alias("kind")).distinct()
    symbols = node(o, "from_qn", F.concat("from_qn", F.lit(".go"))).union(node(o, "m", F.lit("lib")))
    found, _ext = R.resolve_imports(symbols, pending)
    return found.select(F.regexp_extract("from_id", "::(.*)#", 1).alias("from_qn"), S.file_of_id(F.col("to_id")).alias("place")).groupBy("from_qn", "place").agg(F.count(F.lit(1)).alias("n"))

# -- ledgers and small tools ------------------------------------------------------------------------
query("decisions_upsert", "", "SELECT c_mktsegment AS key, CASE WHEN c_mktsegment < 'C' THEN 'new' ELSE count(*)::VARCHAR END AS value FROM customer GROUP BY 1")(lambda spark, d: _decisions(spark, d))


def _decisions(spark, d):
    now = trade.table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("key")).agg(F.count(F.lit(1)).cast("string").alias("value")).withColumn("project_id", F.lit("trade"))
    return K.set_decisions(now, now.filter("key < 'C'").withColumn("value", F.lit("new"))).select("key", "value")


@query("loop_append", "", "SELECT conv_id::VARCHAR AS loop_name, (max(turn) + 2)::INT AS seq FROM conversations GROUP BY 1")
def _(spark, d):
    old = trade.loop_checkpoints(spark, d).withColumn("project_id", F.lit("p"))
    new = old.groupBy("project_id", "loop_name").agg(F.lit("more").alias("claim"), F.lit("go on").alias("decision"), F.lit(1).alias("at"))
    out = M.append_checkpoints(old, new, "at")
    return out.filter("claim = 'more' and decision = 'go on'").select("loop_name", "seq")


@query("decisions_by_keyword", "", "SELECT c_name AS key, CASE WHEN contains(lower(c_name || ' ' || c_mktsegment), 'build') THEN 'build' ELSE 'mach' END AS keyword FROM customer WHERE contains(lower(c_name || ' ' || c_mktsegment), 'build') OR contains(lower(c_name || ' ' || c_mktsegment), 'mach')")
def _(spark, d):
    return I.decisions_for(trade.table(spark, d, "customer").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value")), ["build", "mach"]).select("key", "keyword")


@query("context_for_task", "symbols edges", """SELECT s.id, coalesce(i, 0) AS callers, coalesce(o, 0) AS callees FROM symbols s LEFT JOIN (SELECT to_id AS id, count(DISTINCT from_id) AS i FROM edges WHERE kind = 'CALLS' GROUP BY 1) a USING (id)
LEFT JOIN (SELECT from_id AS id, count(DISTINCT to_id) AS o FROM edges WHERE kind = 'CALLS' GROUP BY 1) b USING (id) WHERE s.kind = 'Part' AND s.complexity = 17 ORDER BY coalesce(i, 0) > 30, id LIMIT 10""")  # fmt: skip
def _(spark, d):
    s = trade.symbols(spark, d)
    seeds = s.filter("kind = 'Part' and complexity = 17").select("id", F.lit(1.0).alias("score"))
    return I.context_for_task(s, trade.edges(spark, d), seeds, 30).select("id", "callers", "callees")


query("provenance_tiers", "", "SELECT event_type, CASE WHEN upper(trim(event_type)) IN ('EXTRACTED', 'INFERRED', 'AMBIGUOUS') THEN upper(trim(event_type)) ELSE 'EXTRACTED' END AS tier FROM events GROUP BY 1")(
    lambda spark, d: trade.table(spark, d, "events").select("event_type", S.provenance_tier(F.col("event_type")).alias("tier")).distinct()
)
query("savings_signals", "calls", "SELECT session_id, CASE WHEN s IS NULL THEN 'needs_baseline' WHEN u + s <= 0 THEN 'no_usage' WHEN 100.0 * s / (u + s) >= 70 THEN 'excellent' WHEN 100.0 * s / (u + s) >= 50 THEN 'good' WHEN 100.0 * s / (u + s) >= 30 THEN 'watch' ELSE 'improve_query' END AS signal FROM (SELECT session_id, sum(tokens_used)::BIGINT AS u, sum(tokens_saved)::BIGINT AS s FROM calls GROUP BY 1)")(
    lambda spark, d: _calls(spark, d).groupBy("session_id").agg(F.sum("tokens_used").alias("u"), F.sum("tokens_saved").alias("s")).select("session_id", S.savings_signal(F.col("u"), F.col("s")).alias("signal"))
)
query("bench_regressions", "", "SELECT 'Brand' || n AS name, round(0.1::DOUBLE * n, 6) AS ns_growth, 0.0::DOUBLE AS allocs_growth FROM range(1, 6) r(n) WHERE 0.1 * n > 0.2")(lambda spark, d: _regressions(spark))


def _regressions(spark):
    base = spark.range(1, 6).select(F.concat(F.lit("Brand"), "id").alias("name"), F.lit(1000.0).alias("ns"), F.lit(10.0).alias("allocs"), "id")
    return M.bench_regressions(base.drop("id"), base.withColumn("ns", F.col("ns") * (1 + F.col("id") / 10.0)).drop("id"), 0.2 + 1e-9).withColumn("ns_growth", F.round("ns_growth", 6))


query("settings_flood", "symbols", "SELECT project_id FROM symbols GROUP BY 1 HAVING count(*) > 1000 AND count(*) FILTER (kind = 'Setting') > 0.8 * count(*)")(lambda spark, d: Q.settings_flood(trade.symbols(spark, d)).select("project_id"))
query("tests_by_package", "symbols edges", "SELECT 'order' AS package, false AS runnable, count(DISTINCT e.from_id) AS tests FROM edges e JOIN symbols s ON s.id = e.from_id WHERE e.kind = 'CALLS' AND s.is_test AND e.to_id LIKE 'catalog/Brand#2::%'")(lambda spark, d: _packages_of_tests(spark, d))


def _packages_of_tests(spark, d):
    s, e = trade.symbols(spark, d), trade.edges(spark, d)
    changed = s.filter("file_path = 'catalog/Brand#2'")
    return I.tests_by_package(I.impacted_tests(I.blast_radius(s, e, changed, 1), e, changed, 1))

from graphmill import more_queries  # noqa: E402, F401  (adds its queries to the tables above)
