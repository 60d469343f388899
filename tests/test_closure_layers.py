"""How a closure's layers are written and read: once, and with few tombstones broadcast."""

from graphmill.operators import closures as CL
from graphmill.plans import cut as C


def test_layers_are_written_without_a_sort_and_few_tombstones_are_broadcast(spark, tmp_path, monkeypatch):
    edges = spark.createDataFrame([(f"a{i}", f"b{i}", "CALLS") for i in range(9)] + [(f"b{i}", "c", "CALLS") for i in range(9)], "from_id string, to_id string, kind string")
    kept = CL.Closures(spark, str(tmp_path / "c"), 3)
    assert kept.tables["pairs"] == ("from_id", ())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept.create(edges)
        kept.apply(edges.filter("from_id <> 'b3'"), edges.filter("from_id = 'b3'"))
        few = kept.table()
        assert few.count() == 9 + 2 * 8
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan(few) and "SortMergeJoin" not in plan(few)
        monkeypatch.setattr(C, "BROADCAST_BYTES", 0)
        many = kept.table()
        assert "SortMergeJoin" in plan(many) and sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
