"""Efficiency week over week, its finding, and searches that are said again, on small logs."""

import random

from pyspark.sql import functions as F

from graphmill.operators import telemetry as M

NOW, DAY = 100 * 86_400 * 10**9, 86_400 * 10**9
LOG = "session_id string, tool string, tokens_used long, ts long, request_id string"
LEDGER = "ts long, claim string, decision string"


def weeks(spark, log, ledger, **more):
    calls = spark.createDataFrame([(s, t, u, int(NOW - d * DAY), str(i)) for i, (s, t, u, d) in enumerate(log)], LOG)
    marks = spark.createDataFrame([(int(NOW - d * DAY), c, x) for c, x, d in ledger], LEDGER)
    return M.les_weeks(calls, marks, NOW, **more)


def test_weeks_and_a_regression(spark):
    log = [("a", "loop", 100, 8), ("a", "x", 100, 8), ("b", "x", 100, 9), ("c", "x", 300, 1), ("c", "x", 300, 1), ("c", "x", 0, 1), ("c", "loop", 0, 0.5), ("c", "investigate_failure", 300, 0), ("d", "x", 1, 20)]
    ledger = [("did", "go", 8), ("did", "  ", 8), ("HANDOFF x", "go", 8), ("did", "go", 2)]
    zero = spark.createDataFrame([(NOW - 1,), (NOW - 2 * 7 * DAY - 1,)], "ts long")
    w = weeks(spark, log, ledger, zero=zero)
    got = {r.week: r for r in w.collect()}
    assert set(got) == {"this", "before"}
    assert (got["before"].tokens_used, got["before"].checkpoints, got["before"].iteration_cost, got["before"].continuation_fidelity, got["before"].wasted) == (300, 1, 300.0, 0.5, 0)
    # The loop is called after the first three calls of the session.
    assert (got["this"].tokens_used, got["this"].recovery_load, got["this"].continuation_fidelity, got["this"].wasted, got["this"].waste_rate) == (900, 1, 0.0, 1, 0.2)
    f = M.les_regression(w).collect()
    assert [tuple(r) for r in f] == [("les_regression", "iteration_cost", 4, 600)]


def test_no_regression(spark):
    better = [("a", "x", 500, 8), ("a", "investigate_failure", 500, 8), ("b", "loop", 100, 1)]
    assert M.les_regression(weeks(spark, better, [("c", "go", 8), ("c", "go", 1)])).collect() == []
    # Nothing to compare with, or no checkpoints at all.
    assert M.les_regression(weeks(spark, [("a", "x", 500, 1)], [("c", "go", 1)])).collect() == []
    w = weeks(spark, better, [])
    assert all(r.continuation_fidelity is None and r.iteration_cost is None for r in w.collect()) and M.les_regression(w).collect() == []
    counted = weeks(spark, [("a", "x", 5, 8), ("a", "investigate_failure", 5, 1)], [])
    assert [(r.sub_metric, r.occurrences, r.tokens) for r in M.les_regression(counted).collect()] == [("recovery_load", 1, 0)]


def test_coach_tells_of_empty_results_or_not(spark):
    log = spark.createDataFrame([("s", "x", 10, NOW, str(i)) for i in range(10)], LOG)
    zero = spark.createDataFrame([(40,), (2,)], "tokens_used long")
    found = lambda **more: [tuple(r) for r in M.coach(log, 5, **more).collect()]
    assert found() == [] and found(zero=zero.limit(0)) == [] and found(zero=zero) == [("zero_result_churn", 2, 42)]
    assert M.coach(log.limit(9), 5, zero=zero).collect() == []


def test_runs_of_rephrased_searches(spark):
    rng = random.Random(7)
    vocabulary = ["open", "store", "read", "file", "Öl", "x1"]
    rows = []
    for s in ("hot", "hot2", "a", "b"):
        for at in range({"hot": 400, "hot2": 60}.get(s, 7)):
            rows.append((s, at // 5, at, rng.choice([None, "", *[" ".join(rng.choices(vocabulary, k=rng.randint(1, 4))) for _ in range(6)]]), rng.choice([0, 0, 0, 2]), at))
    df = spark.createDataFrame(rows, "session_id string, part long, at long, text string, results long, tokens_used long")
    want, run = [], []
    words = lambda t: set((t or "").lower().split())
    for prev, r in zip([None, *rows], [*rows, None], strict=True):
        joined = prev and r and prev[0] == r[0] and prev[4] == r[4] == 0 and words(prev[3]) | words(r[3]) and len(words(prev[3]) & words(r[3])) >= 0.3 * len(words(prev[3]) | words(r[3]))
        if not joined:
            if len(run) > 1:
                want.append((run[0][0], run[0][2], run[-1][2], len(run), sum(x[5] for x in run)))
            run = []
        if r and r[4] == 0:
            run.append(r)
    assert len(want) > 20
    assert sorted(tuple(r) for r in M.churn_runs(df.repartition(7)).select("session_id", "first", "last", "searches", "tokens").collect()) == sorted(want)
    assert M.churn_runs(df.filter(F.lit(False))).collect() == []
