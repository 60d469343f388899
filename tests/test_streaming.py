from pyspark.sql import functions as F

from graphmill.streaming import ingest as N


def test_incremental_ingest_skips_known_files(spark, tmp_path):
    seen = []
    job = N.Ingest(spark, str(tmp_path / "store"), "p", publish=seen.append)
    batch = lambda rows: spark.createDataFrame(rows, "path string, content string")
    job.apply(batch([("a.py", "def f():\n    pass\n"), ("b.py", "import os\n")]), 0)
    job.apply(batch([("a.py", "def f():\n    pass\n"), ("b.py", "def g():\n    pass\n")]), 1)
    assert [e["files"] for e in seen if e["event"] == "index_complete"] == [2, 1]
    assert {r.qualified_name for r in job.read("symbols").collect()} == {"f", "g"} and job.read("pending").count() == 0
    job.apply(batch([("b.py", "def g():\n    pass\n")]), 2)
    assert job.version() == 1


def test_newest_versions_deletions_and_edges(spark, tmp_path):
    from graphmill.operators import resolve as R

    job = lambda: N.Ingest(spark, str(tmp_path / "store"), "p", lambda s, p: R.resolve_calls(s, p)[0])
    files = lambda rows: spark.createDataFrame(rows, "path string, content string, mtime long")
    a, b = "def f():\n    g()\n", "def g():\n    pass\n"
    job().apply(files([("a.py", "def old():\n    pass\n", 1), ("a.py", a, 2), ("b.py", b, 1)]), 0)
    ends = lambda: {(r.from_id.split("::")[1], r.to_id.split("::")[0]) for r in job().read("edges").collect()}
    assert {r.qualified_name for r in job().read("symbols").collect()} == {"f", "g"} and ends() == {("f#Function", "b.py")}
    # The called function moves to another file: the caller, which has not changed, is resolved again.
    job().apply(files([("b.py", None, 3), ("c.py", b, 3)]), 1)
    assert {r.path for r in job().read("hashes").collect()} == {"a.py", "c.py"} and job().passes == 2
    job().apply(files([("a.py", a + "X = 1\n", 4)]), 2)
    assert ends() == {("f#Function", "c.py")}
    job().sweep(files([("a.py", a, 5)]))
    assert {r.path for r in job().read("hashes").collect()} == {"a.py"} and ends() == set() and job().version() == 3
    old = job().read("symbols")
    job().apply(files([("a.py", b, 6)]), 4)
    assert old.count() == 1 and len([p for p in (tmp_path / "store").iterdir() if p.name.startswith("done-")]) == N.Ingest.KEEP


def test_pending_hooks_come_out(spark, tmp_path):
    from pyspark.sql.functions import timestamp_seconds

    spark.createDataFrame([(1, "s", 100), (2, "t", 100), (3, "s", 90_000)], "id long, session_id string, at long").write.parquet(str(tmp_path / "h"))
    spark.createDataFrame([("s", "find", 200), ("s", "find", 99_000)], "session_id string, tool string, at long").write.parquet(str(tmp_path / "c"))
    hooks = N.watch(spark, str(tmp_path / "h"), "id long, session_id string, at long").withColumn("hook_at", timestamp_seconds("at"))
    calls = N.watch(spark, str(tmp_path / "c"), "session_id string, tool string, at long").withColumn("call_at", timestamp_seconds("at"))
    q = N.resolved_stream(hooks, calls).writeStream.format("memory").queryName("settled").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.id, r.tool) for r in spark.table("settled").collect()}
    assert (1, "find") in got and (2, None) in got


def test_stream_of_files_runs_to_the_end(spark, tmp_path):
    spark.createDataFrame([("a.py", "X = 1\n")], "path string, content string").write.parquet(str(tmp_path / "in"))
    job = N.Ingest(spark, str(tmp_path / "store"), "p")
    job.start(N.watch(spark, str(tmp_path / "in"), "path string, content string"), str(tmp_path / "check")).awaitTermination()
    assert job.read("symbols").count() == 1


def test_windows_drop_late_rows(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "e"))
    events = N.watch(spark, str(tmp_path / "e"), ", ".join(f"{f.name} {'timestamp' if f.name == 'ts' else f.dataType.simpleString()}" for f in schema))
    q = N.tumbling(events, "1 day").writeStream.format("memory").queryName("daily").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("daily").agg(F.sum("n")).first()[0] > 500


def test_adherence_matches_and_consumes_advice(spark, tmp_path):
    rows = [("s", 1, 1, "advice", "context", '{"id": "x"}'), ("s", 2, 2, "call", "context", '{"id": "x", "lite": 1}'), ("s", 3, 3, "call", "context", '{"id": "x"}'), ("s", 4, 4, "call", "trace", "")]
    schema = "session_id string, at long, seq long, what string, tool string, args string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "s"))
    q = N.adherence(N.watch(spark, str(tmp_path / "s"), schema)).writeStream.format("memory").queryName("followed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.seq, r.followed) for r in spark.table("followed").orderBy("seq").collect()] == [(2, True), (3, False), (4, False)]
