"""Walks by lists: what they give is what walks by bits give, and what they shuffle."""

import random

import pytest

from graphmill.operators import graph as G
from graphmill.operators import lists as L
from graphmill.operators import paths as P


def frame(spark, rows):
    return spark.createDataFrame(rows, "from_id string, to_id string, kind string")


def links(seed, n, nodes):
    r = random.Random(seed)
    odd = [(None, "n1", "CALLS"), ("n1", None, "CALLS"), ("n2", "n2", "CALLS"), ("n2", "n3", "CALLS"), ("n2", "n3", "CALLS"), ("n2", "n3", "ASYNC_CALLS")]
    return odd + [(f"n{r.randrange(nodes)}", f"n{r.randrange(nodes)}", r.choice(G.CALL_FAMILY)) for _ in range(n)]


@pytest.mark.parametrize(("seed", "n", "nodes", "most", "slice_"), [(1, 110, 80, 4, 1 << 30), (4, 260, 60, 2, 500)])
def test_lists_give_what_bits_give(spark, monkeypatch, seed, n, nodes, most, slice_):
    e = frame(spark, links(seed, n, nodes))
    starts = spark.createDataFrame([(f"n{i}",) for i in range(0, nodes, 3)] + [("n3",), (None,), ("nowhere",)], "start string")
    every = e.selectExpr("from_id AS start").distinct()
    closed = lambda: [sorted(map(tuple, G.closure(e, most, starts=s).collect())) for s in (None, starts.selectExpr("start AS id"))]
    walked = lambda: [sorted(map(tuple, f(e, s, 1, most).collect())) for f in (P.reached, P.reach_counts) for s in (every, starts)]
    bits = closed() + walked()
    made = []
    monkeypatch.setattr(L, "LEAST_STEPS", 0)
    monkeypatch.setattr(L, "WALKS", 1 << 40)
    monkeypatch.setattr(L, "SLICE", slice_)
    monkeypatch.setattr(L, "Lists", lambda *a, of=L.Lists: (made.append(1), of(*a))[1])
    assert closed() + walked() == bits and len(made) == 6 and len(bits[0]) > 40


def test_where_bits_serve(spark, monkeypatch):
    """Many walks for each step, or ends too many to broadcast."""
    hub = [(f"s{i}", "hub", "CALLS") for i in range(90)] + [("hub", f"e{i}", "CALLS") for i in range(90)]
    steps = frame(spark, hub).selectExpr("from_id AS __from", "to_id AS __to", "kind AS via").cache()
    kind = P.kind_index(G.CALL_FAMILY)
    assert L.lists_of(steps, None, 3, kind) is None  # few steps
    monkeypatch.setattr(L, "LEAST_STEPS", 0)
    assert L.lists_of(steps, None, 1, kind) is not None and L.lists_of(steps, None, 3, kind) is not None  # 8100 walks, 180 steps
    monkeypatch.setattr(L, "WALKS", 44)
    assert L.lists_of(steps, None, 3, kind) is None and L.lists_of(steps, None, 1, kind) is not None
    monkeypatch.setattr(L, "WALKS", 64)
    monkeypatch.setattr(L, "BROADCAST_BYTES", 0)
    assert L.lists_of(steps, None, 3, kind) is None


def test_few_walks_for_each_step_are_not_spread_by_bits(spark, monkeypatch):
    """Forty orders of parts with suppliers: pairs are spread from lists, after the last shuffle but that of the ends' names."""
    e = [(f"o{i:02}", f"p{(i * 7 + j) % 30:02}", "CALLS") for i in range(40) for j in range(3)] + [(f"p{i:02}", f"s{(i + j) % 9}", "CALLS") for i in range(30) for j in range(4)]
    monkeypatch.setattr(L, "LEAST_STEPS", 200)
    df = G.closure(frame(spark, e), 3)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "array_except" in plan and "names" not in plan
    assert df.count() == len({x[:2] for x in e}) + len({(a, t) for a, b, _ in e for f, t, _ in e if f == b})
