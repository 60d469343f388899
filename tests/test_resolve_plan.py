"""What the driver holds of a plan that resolves calls."""

from graphmill.operators import resolve as R


def test_calls_are_resolved_in_several_plans(spark):
    nodes = spark.createDataFrame([("p", "a", "x/f.go", "f", "f", "Function", "Go", 0), ("p", "b", "x/g.go", "g", "pkg.g", "Function", "Go", 0)], "project_id string, id string, file_path string, name string, qualified_name string, kind string, language string, start_byte int")
    calls = spark.createDataFrame([("p", "x/f.go", "CALLS", "f", "g", 1.0, None), ("p", "x/f.go", "CALLS", "f", "nothing", 1.0, None)], "project_id string, from_file string, kind string, from_qn string, to_name string, confidence double, receiver_type string")
    found, drops = R.resolve_calls(nodes, calls)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 3
    assert [(r.from_id, r.to_id) for r in found.collect()] == [("a", "b")] and tuple(drops.first()) == (0, 1, 0)
