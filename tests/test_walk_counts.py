"""Walks that a query only counts: by bits, with what walks give whose rows are counted."""

import pytest

import graph_fixture as GF
from graphmill.plans import planner as PL


CASES = [
    ("(a)-[:CALLS*1..3]->(b)", "", False), ("(a:Function)-[:CALLS*1..2]->(b)", "WHERE a.complexity < 9 AND b.complexity > 1", False), ("(a)-[:CALLS*2..3]->(b:Method)", "WHERE NOT b.name = 'dim'", False),
    ("(a)-[:CALLS*1..3]->(b {name: 'run'})", "", False), ("(a)-[:CALLS*1..2]->(b)", "WHERE a.name = 'run' OR b.name = 'dim'", False), ("(a)-[:LOADS*1..2]->(b)", "", False), ("(a)-[:CALLS*1..2]->(b)", "", True),
]


@pytest.mark.parametrize(("pattern", "where", "twice"), CASES)
def test_counts(spark, monkeypatch, pattern, where, twice):
    nodes = GF.symbols(spark, GF.NODES + GF.NODES[:4] * twice)
    e = PL.Engine(nodes, GF.edges(spark))
    text = f"MATCH {pattern} {where} RETURN COUNT(*) AS n, COUNT(a) AS m"
    got = e.query(text).df
    rows = [tuple(r) for r in got.collect()]
    monkeypatch.setattr(PL.Engine, "_counted", lambda *_: None)
    plain = e.query(text).df
    assert got.columns == plain.columns and got.dtypes == plain.dtypes and rows == [tuple(r) for r in plain.collect()]


def test_many_starts_are_not_spread(spark):
    df = PL.Engine(GF.symbols(spark), GF.edges(spark)).query("MATCH (a)-[:CALLS*1..2]->(b) RETURN COUNT(*) AS n").df
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_count" in plan and "posexplode" not in plan
