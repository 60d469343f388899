"""Walks from many starts against walks of plain Python."""

import random
from collections import defaultdict

import pytest

from graphmill.operators import graph as G
from graphmill.operators.paths import levels, numbered, reached, spread


def a_graph(seed, nodes, edges):
    r = random.Random(seed)
    return [(f"n{r.randrange(nodes):03}", f"n{r.randrange(nodes):03}", r.choice(G.CALL_FAMILY)) for _ in range(edges)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "from_id string, to_id string, kind string")


def plain(edges, starts, least, most):
    """{(start, node): (depth, via)} over all walks, level by level."""
    out = defaultdict(list)
    for a, b, k in edges:
        if a is not None and b is not None:
            out[a].append((b, k))
    found = {}
    for s in starts:
        level = {s}
        for depth in range(1, most + 1):
            came = defaultdict(set)
            for n in level:
                for b, k in out[n]:
                    came[b].add(k)
            level = set(came)
            if depth >= least:
                for n, kinds in came.items():
                    if n != s:
                        found.setdefault((s, n), (depth, min(kinds)))
    return found


@pytest.mark.parametrize(("seed", "nodes", "edges", "least", "most"), [(1, 200, 500, 1, 3), (2, 90, 120, 1, 6), (3, 150, 400, 2, 4), (4, 70, 90, 3, 5)])
def test_walks_equal_plain_ones(spark, seed, nodes, edges, least, most):
    e = a_graph(seed, nodes, edges)
    starts = sorted({a for a, _, _ in e}) + ["nowhere"]
    got = {(r.start, r.node): r.depth for r in reached(frame(spark, e), spark.createDataFrame([(s,) for s in starts * 2], "start string"), least, most).collect()}
    assert got == {k: d for k, (d, _) in plain(e, starts, least, most).items()}


@pytest.mark.parametrize(("seed", "most"), [(5, 3), (6, 8)])
def test_closure_equals_plain_walks(spark, seed, most):
    e = a_graph(seed, 180, 420)
    rows = G.closure(frame(spark, e), most).collect()
    want = plain(e, {a for a, _, _ in e}, 1, most)
    assert len(rows) == len(want) and {(r.from_id, r.to_id): (r.depth, r.via_kind) for r in rows} == want


def test_starts_of_a_chunk_share_a_row(spark):
    """A thousand starts that call one node, which calls another: two rows a chunk, not two thousand."""
    e = [(f"s{i:04}", "hub", "CALLS") for i in range(1000)] + [("hub", "end", "CALLS"), ("end", "hub", "CALLS")]
    steps = frame(spark, e).selectExpr("from_id AS __from", "to_id AS __to", "kind AS via")
    known = numbered(frame(spark, e).selectExpr("from_id AS start"))
    found = levels(steps, known, 1, 5)
    chunks = known.select("chunk").distinct().count()
    assert chunks <= 1002 // 64 + 1 + known.rdd.getNumPartitions() and found.count() <= 3 * chunks
    assert spread(found, known, "new0").count() == 1000 + 1000 + 2


def test_odd_rows(spark):
    e = [("a", "b", "CALLS"), ("a", "b", "CALLS"), ("b", "a", "CALLS"), ("a", "a", "CALLS"), (None, "b", "CALLS"), ("b", None, "CALLS"), (None, None, "CALLS"), ("", "a", "CALLS")]
    starts = spark.createDataFrame([("a",), ("a",), (None,), ("",)], "start string")
    assert {tuple(r) for r in reached(frame(spark, e), starts, 1, 3).collect()} == {("a", "b", 1), ("", "a", 1), ("", "b", 2)}
    nothing = frame(spark, [])
    assert reached(nothing, starts, 1, 3).count() == 0 and reached(frame(spark, e), starts.limit(0), 2, 3).count() == 0
    assert G.closure(nothing).count() == 0 and set(G.closure(nothing).columns) == {"from_id", "to_id", "depth", "via_kind"}
