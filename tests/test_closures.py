"""A closure kept current under random changes of a cyclic graph, against one built anew."""

import os
import random

import pytest

from graphmill.operators import closures as CL
from graphmill.operators import graph as G

SCHEMA = "from_id string, to_id string, kind string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.mark.parametrize("depth", [1, 3])
def test_the_table_equals_one_built_anew(spark, tmp_path, depth):
    rng, path = random.Random(depth), str(tmp_path / "closure")
    link = lambda: (f"n{rng.randrange(14)}", f"n{rng.randrange(14)}", rng.choice(["CALLS", "HTTP_CALLS", "READS"]))
    now = {link() for _ in range(22)}
    kept = CL.Closures(spark, path, depth)
    frame = lambda links: spark.createDataFrame(sorted(links), SCHEMA)
    kept.create(frame(now))
    for _ in range(4):
        came, went = {link() for _ in range(rng.randint(0, 2))} - now, set(rng.sample(sorted(now), rng.randint(0, 2)))
        before, old = files(path), rows(kept.table())
        now = (now | came) - went
        touched = {r.id for r in kept.touched(frame(came | went)).collect()}
        kept.apply(frame(now), frame(came | went))
        assert rows(kept.table()) == rows(G.closure(frame(now), depth))
        assert before <= files(path)
        # Nodes that were not touched keep their rows.
        assert {r for r in old if r[0] not in touched} == {r for r in rows(kept.table()) if r[0] not in touched}
    assert kept.apply(frame(now), frame(set())) == kept.version()
    starts = spark.createDataFrame([("n1",), ("n2",), ("none",)], "start string")
    edges = frame(now)
    for way in ("in", "out", "both"):
        read, walked = (CL.traced(edges, starts, way, min(depth, 2), kept=k) for k in (kept, None))
        assert read.columns == walked.columns
        assert rows(read.drop("via")) == rows(walked.drop("via"))


def test_what_the_closure_does_not_serve_is_walked(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b", "CALLS"), ("b", "c", "CALLS"), ("c", "d", "CALLS"), ("a", "x", "READS")], SCHEMA)
    kept = CL.Closures(spark, str(tmp_path / "c"), 2)
    kept.create(edges.filter("from_id <> 'b'"))
    start = spark.createDataFrame([("a",)], "start string")
    nodes = lambda **more: {r.node for r in CL.traced(edges, start, "out", kept=kept, **more).collect()}
    assert nodes(depth=2) == {"b"}  # read, as the closure has it
    assert nodes(depth=3) == {"b", "c", "d"} and nodes(depth=0) == {"b", "c", "d"}  # deeper than it was built
    assert nodes(depth=2, kinds=("READS",)) == {"x"}
    assert nodes(depth=2, version=1) == {"b", "c"}  # not the version that goes with the edges
    kept.apply(edges, edges.filter("from_id = 'b'"))
    assert nodes(depth=2, version=1) == {"b", "c"} and {r.risk for r in CL.traced(edges, start, "out", 2, kept=kept).collect()} == {"CRITICAL", "HIGH"}
    assert CL.Closures(spark, "x", 50).depth == 8 and CL.Closures(spark, "x", 0).depth == 3
