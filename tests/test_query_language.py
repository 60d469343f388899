import pytest
from graph_fixture import LINKS, NODES, edges, symbols

from graphmill.plans.ast import QueryError
from graphmill.plans.parser import one_edit_apart, parse
from graphmill.plans.planner import Engine


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(symbols(spark).cache(), edges(spark).cache(), "p")


def run(engine, text):
    r = engine.query(text)
    return [tuple(x) for x in r.df.collect()], r.warnings


def nodes(test, *columns):
    return {tuple(n[c] for c in columns) for n in NODES if test(n)}


def links(test, *columns):
    """Values of both ends of the links that pass, by `a.column` and `b.column`."""
    by = {n["id"]: n for n in NODES}
    return {tuple((by[f] if c[0] == "a" else by[t])[c[2:]] for c in columns) for f, t, k in LINKS if test(by[f], by[t], k)}


def walks(start, least, most, kinds=("CALLS",)):
    """Nodes at the ends of walks of least..most links."""
    front, found = {start}, set()
    for depth in range(1, most + 1):
        front = {t for f, t, k in LINKS if f in front and k in kinds}
        found |= front if depth >= least else set()
    return {(x,) for x in found - {start}}


#: A query that warns of nothing, and what plain Python says to it.
ASKED = [
    ("MATCH (x:Variable) RETURN x.id", nodes(lambda n: n["kind"] == "Variable", "id")),
    ("MATCH (x) WHERE x.language = 'Python' AND x.kind = 'Function' RETURN x.id, x.name", nodes(lambda n: n["language"] == "Python" and n["kind"] == "Function", "id", "name")),
    ("MATCH (x) WHERE x.complexity >= 3 AND NOT x.is_test RETURN x.id", nodes(lambda n: n["complexity"] >= 3 and not n["is_test"], "id")),
    ("MATCH (x) WHERE NOT (x.is_exported = true OR x.complexity < 2) RETURN x.id", nodes(lambda n: not (n["is_exported"] or n["complexity"] < 2), "id")),
    ("MATCH (x) WHERE x.docstring IS NOT NULL RETURN x.docstring", nodes(lambda n: n["docstring"], "docstring")),
    ("MATCH (x:Method) WHERE x.docstring IS NULL RETURN x.id", nodes(lambda n: n["kind"] == "Method" and not n["docstring"], "id")),
    ("MATCH (x) WHERE x.signature =~ '^def .*\\(\\)' RETURN x.id", nodes(lambda n: n["signature"] == "def test_run()", "id")),
    ("MATCH (x) WHERE x.id STARTS WITH 'horn' OR x.id ENDS WITH 'level' RETURN x.id", nodes(lambda n: n["id"].startswith("horn") or n["id"].endswith("level"), "id")),
    ("MATCH (x) WHERE x.signature CONTAINS 'int' RETURN x.id", nodes(lambda n: "int" in n["signature"], "id")),
    ("MATCH (x) WHERE x.name IN ['run', 'dim'] AND x.complexity <> 5 RETURN x.id", nodes(lambda n: n["name"] in ("run", "dim") and n["complexity"] != 5, "id")),
    ("MATCH (x {name: 'run', kind: 'Method'}) RETURN x.id", {("horn.run",)}),
    ("MATCH (x:Function) WHERE x.is_entry_point RETURN x.name AS watch", {("run",)}),
    ("MATCH (x) RETURN DISTINCT x.kind, x.language", nodes(lambda n: True, "kind", "language")),
    ("MATCH (x)-[:READS|WRITES]->(y:Variable) RETURN x.id, y.id", links(lambda a, b, k: k in ("READS", "WRITES"), "a.id", "b.id")),
    ("MATCH (x)-->(y) WHERE x.language = 'Python' AND y.language = 'Go' RETURN x.id, y.id", links(lambda a, b, k: a["language"] == "Python" and b["language"] == "Go", "a.id", "b.id")),
    ("MATCH (x:Function)-[e:CALLS]->(y:Method) WHERE e.confidence > 0.9 RETURN x.id, y.name", links(lambda a, b, k: k == "CALLS" and a["kind"] == "Function" and b["kind"] == "Method", "a.id", "b.name")),
    ("MATCH (x {id: 'keeper.test'})-[:CALLS*1..2]->(y) RETURN y.id", walks("keeper.test", 1, 2)),
    ("MATCH (x {id: 'keeper.test'})-[:CALLS*2..4]->(y) RETURN y.id", walks("keeper.test", 2, 4)),
    ("MATCH (x {id: 'keeper.run'})-[:CALLS|READS*1..3]->(y) RETURN y.id", walks("keeper.run", 1, 3, ("CALLS", "READS"))),
]


@pytest.mark.parametrize(("text", "want"), ASKED)
def test_queries_say_what_plain_python_says(engine, text, want):
    rows, warnings = run(engine, text)
    assert set(rows) == want and len(rows) == len(want) > 0 and warnings == []


def test_values(engine):
    functions = [n["complexity"] for n in NODES if n["kind"] == "Function"]
    assert run(engine, "MATCH (x:Function) RETURN COUNT(*), SUM(x.complexity), MIN(x.complexity), MAX(x.complexity), AVG(x.complexity)")[0] == [
        (len(functions), float(sum(functions)), float(min(functions)), float(max(functions)), sum(functions) / len(functions))
    ]
    assert run(engine, "MATCH (x) RETURN SUM(x.name), COUNT(DISTINCT x.language), COUNT(x.docstring)")[0][0][:2] == (0.0, 2)
    assert run(engine, "MATCH (x) WHERE x.name = 'nobody' RETURN SUM(x.complexity), AVG(x.complexity), COUNT(*)")[0] == [(0.0, None, 0)]
    by_kind = run(engine, "MATCH (x) RETURN x.kind, COUNT(*) AS n ORDER BY n DESC")[0]
    assert dict(by_kind) == {k: sum(n["kind"] == k for n in NODES) for k in {n["kind"] for n in NODES}} and [n for _, n in by_kind] == sorted((n for _, n in by_kind), reverse=True)
    assert run(engine, "MATCH (x:Function) RETURN x.name ORDER BY x.complexity DESC LIMIT 2")[0] == [("run",), ("test_run",)]
    assert len(run(engine, "MATCH (x) RETURN x.id LIMIT 4")[0]) == 4 and "lamp.dim" in run(engine, "MATCH (x {id: 'lamp.dim'}) RETURN x")[0][0][0]
    assert run(engine, "MATCH (x)-[e:CALLS]->(y) RETURN y.name, e.confidence ORDER BY y.name LIMIT 1")[0] == [("Blow", 1.0)]


def test_a_walk_from_many_starts_is_whole(spark):
    """The default engine bounds rows, never the starts of a walk."""
    many = [(f"x.{i}", f"y.{i}", "CALLS") for i in range(150)]
    s = symbols(spark, [dict(NODES[0], id=x, name=x) for f, t, _ in many for x in (f, t)])
    assert run(Engine(s, edges(spark, many), "p"), "MATCH (a)-[:CALLS*1..2]->(b) RETURN COUNT(*)")[0] == [(150,)]


@pytest.mark.parametrize("text", [
    "MATCH (a) MATCH (b) RETURN a.name", "MATCH (a)-[:X]->(b)-[:X]->(c) RETURN a.name", "MATCH (a), (b) RETURN a.name", "MATCH (a)<-[:X]-(b) RETURN a.name",
    "MATCH (a)-[:X]-(b) RETURN a.name", "MATCH (a) WITH a RETURN a.name", "MATCH (a) RETURN a.name WHERE a.name = 'x'", "MATCH (a) RETURN a.name ORDER BY a.name, a.id",
    "MATCH (a) RETURN a.name LIMIT -1", "MATCH (a) RETURN a.name LIMIT 1.5", "MATCH (a) RETURN a.name LIMIT x", "CREATE (a) RETURN a.name", "MATCH (a) RETURN *",
    "MATCH (a) RETURN upper(a.name)", "MATCH (a) RETURN COUNT(DISTINCT *)", "MATCH (a) RETURN COUNT(DISTINCT a)", "MATCH (a) RETURN SUM(DISTINCT a.complexity)",
    "MATCH (a) WHERE a.name IN ('x') RETURN a.name", "MATCH (a) WHERE a.name IN [] RETURN a.name", "MATCH (a) WHERE a.name != 'x' RETURN a.name",
    "MATCH (a) WHERE a.name LIKE 'x' RETURN a.name", "MATCH (a) WHERE a.complexity BETWEEN 1 RETURN a.name", "MATCH (a) WHERE a.complexity = 1 + 2 RETURN a.name",
    "MATCH (a) WHERE a.name =~ '(' RETURN a.name", "MATCH (a) WHERE a.name =~ '(?=x)' RETURN a.name", "MATCH (a RETURN a.name", "MATCH (a) WHERE (a.name = 'x' RETURN a.name",
    "MATCH (a) WHRE a.name = 'x' RETURN a.name", "RETURN a.name", "MATCH (a)", "MATCH (a) RETURN a.name SKIP 1", "MATCH (a) WHERE a.name RETURN a.name", "OPTIONAL MATCH (a) RETURN a",
])
def test_rejections(text):
    with pytest.raises(QueryError):
        parse(text)


@pytest.mark.parametrize("text,said", [
    ("MATCH (n) RETURN n.nam", "did you mean"), ("MATCH (n) WHERE m.name = 'x' RETURN n.name", "not bound"), ("MATCH (n) WHERE n.name = n.id RETURN n.name", "ignored"),
    ("MATCH (n) WHERE n.complexity > 'x' RETURN n.name", "is a number"), ("MATCH (n) RETURN SUM(n.name)", "no numbers"), ("MATCH (n) RETURN n.name ORDER BY foo", "not sorted"),
    ("MATCH (n) RETURN name", "not bound"), ("MATCH (n) RETURN COUNT(*) ORDER BY n.name", "no effect"), ("MATCH (n) RETURN n, COUNT(*)", "whole node"),
    ("MATCH (a)-[:CALLS]->(a) RETURN a.name", "self-loops"), ("MATCH (a)-[:CALLS*3..1]->(b) RETURN a.name", "inverted"), ("MATCH (a)-[:CALLS*0..1]->(b) RETURN a.name", "one hop"),
    ("MATCH (a)-[:CALL]->(b) RETURN a.name", "did you mean CALLS"),
])
def test_warnings(engine, text, said):
    assert any(said in w for w in engine.query(text).warnings)


def test_diagnosis_looks_at_the_graph(engine):
    assert any("Function" in w for w in engine.diagnose(engine.query("MATCH (n:Funcion) RETURN n.name")))
    assert any("'Go'" in w for w in engine.diagnose(engine.query("MATCH (n) WHERE n.language = 'go' RETURN n.name")))
    assert any("Method" in w for w in engine.diagnose(engine.query("MATCH (n:Class) WHERE n.name = 'Light' RETURN n.name")))


OPS = ["=", "<>", "<", ">"]


@pytest.mark.parametrize("value", ["", "0", "1", "true", "x"])
def test_null_empty_and_boolean_equality(spark, value):
    rows = [("a", None), ("b", ""), ("c", "0"), ("d", "x"), ("e", "1")]
    base = symbols(spark).limit(1).drop("docstring", "id")
    table = base.crossJoin(spark.createDataFrame(rows, "id string, docstring string")).select(*symbols(spark).columns)
    e = Engine(table, edges(spark).limit(0), "p")
    got = {r[0] for r in run(e, f"MATCH (n) WHERE n.docstring = '{value}' RETURN n.id")[0]}
    assert got == {i for i, d in rows if (d or "") == value} if value == "" else got == {i for i, d in rows if d == value}
    other = {r[0] for r in run(e, f"MATCH (n) WHERE n.docstring <> '{value}' RETURN n.id")[0]}
    assert other == {i for i, _ in rows} - got
    negated = {r[0] for r in run(e, f"MATCH (n) WHERE NOT n.docstring = '{value}' RETURN n.id")[0]}
    assert negated == {i for i, _ in rows} - got


def test_edit_distance():
    assert one_edit_apart("MATCH", "MACH") and one_edit_apart("WHERE", "WHERE") and one_edit_apart("LIMIT", "LIMUT") and not one_edit_apart("MATCH", "MTAHC")


def test_two_hops_may_return_to_a_node_that_one_hop_reaches(spark):
    ring = [("keeper.run", "keeper.log", "CALLS"), ("keeper.log", "horn.blow", "CALLS"), ("keeper.run", "horn.blow", "CALLS"), ("horn.blow", "keeper.run", "CALLS")]
    e = Engine(symbols(spark), edges(spark, ring), "p")
    got = run(e, 'MATCH (a {id: "keeper.run"})-[:CALLS*2..3]->(b) RETURN b.id')[0]
    assert {r[0] for r in got} == {"horn.blow", "keeper.log"}
    back = run(e, 'MATCH (a)-[:CALLS*1..2]->(b) WHERE b.id = "horn.blow" RETURN a.id')[0]
    assert {r[0] for r in back} == {"keeper.run", "keeper.log"}
