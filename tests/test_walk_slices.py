"""Walks whose levels are made in slices, and what a level shuffles."""

import random

import pytest

from graphmill.operators import graph as G
from graphmill.operators import paths as P
from graphmill.plans import cut as C


def links(seed, n):
    r = random.Random(seed)
    return [(f"n{r.randrange(90):02}", f"n{r.randrange(90):02}", r.choice(G.CALL_FAMILY)) for _ in range(n)]


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_slices_give_what_one_piece_gives(spark, monkeypatch, few):
    e = spark.createDataFrame(links(3, 260), "from_id string, to_id string, kind string")
    starts = e.select(e.from_id.alias("start")).distinct()
    closed, walked = (lambda: sorted(map(tuple, G.closure(e, 4).collect()))), (lambda: sorted(map(tuple, P.reached(e, starts, 2, 3).collect())))
    whole = closed(), walked()
    monkeypatch.setattr(P, "SLICE", 100)
    monkeypatch.setattr(P, "SLICE_STEPS", 50)
    monkeypatch.setattr(P, "BROADCAST_BYTES", few)
    assert (closed(), walked()) == whole and len(whole[0]) > 1000


def test_lists_of_ends_are_dealt_out_whole(spark, monkeypatch):
    """A thousand starts that call one hub of a thousand ends: the second level shuffles no row for each chunk and end."""
    e = [(f"s{i:04}", "hub", "CALLS") for i in range(1000)] + [("hub", f"e{i:04}", "CALLS") for i in range(1000)]
    plans = []
    monkeypatch.setattr(P, "cut", lambda df: (plans.append(df), C.cut(df))[1])
    df = G.closure(spark.createDataFrame(e, "from_id string, to_id string, kind string"), 3)
    assert df.count() == 1000 + 1000 + 1_000_000
    dealt = plans[-1]._jdf.queryExecution().optimizedPlan().toString()
    assert dealt.index("explode(offs") < dealt.index("RepartitionByExpression")
    before = spark.conf.get(C.CLEANUP, None)
    with C.freed(spark):
        assert spark.conf.get(C.CLEANUP) == "true"
    assert spark.conf.get(C.CLEANUP, None) == before
