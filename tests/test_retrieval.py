"""Searches of a table of queries against one search each, and suspects of many failures."""

import math
import random

import pytest

from graphmill.operators import impact as I
from graphmill.operators import retrieval as RT
from graphmill.operators import search as T


def brute(docs, query, k):
    """The best documents by Okapi BM25, by plain Python."""
    tokens = {i: T._plain(t) for i, t in docs.items()}
    lengths = [len(w) for w in tokens.values()]
    n, average = len(lengths), sum(lengths) / len(lengths)
    out = []
    for i, w in tokens.items():
        score = 0.0
        for term in set(T._plain(query)):
            df, tf = sum(term in x for x in tokens.values()), w.count(term)
            if tf:
                score += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / average))
        if score:
            out.append((-round(score, 9), i))
    return [(i, -s) for s, i in sorted(out)[:k]]


@pytest.mark.parametrize("k", [1, 4, 500])
def test_batch_equals_one_search_each(spark, k):
    rng = random.Random(k)
    common, rare = ["the", "of", "and"], [f"w{i}" for i in range(60)]
    docs = {i: " ".join(rng.choices(common, k=rng.randint(0, 6)) + rng.choices(rare, k=rng.randint(0, 5))) for i in range(150)}
    docs |= {200 + i: docs[i] for i in range(10)}
    queries = [("q1", "the of w3 w7"), ("q2", "the"), ("q3", "w1 w2 w3 and the of the"), ("q4", "nothing"), ("q5", ""), ("q6", None), ("q7", "W5! the"), ("q7b", "of and")]
    index = T.build_index(spark.createDataFrame(list(docs.items()), "id long, text string"), ["text"])
    got = RT.batch_search(index, spark.createDataFrame(queries, "query_id string, text string"), k).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append((r.id, round(r.score, 9)))
    assert by == {q: w for q, t in queries if t and (w := brute(docs, t, k))}


def test_common_words_are_not_looked_up_everywhere(spark, monkeypatch):
    docs = [(i, "the a" + (" needle" if i in (3, 5) else "") + " x" * (i % 7)) for i in range(300)]
    index = T.build_index(spark.createDataFrame(docs, "id long, text string"), ["text"])
    seen = []
    monkeypatch.setattr(RT, "cut", lambda df, real=RT.cut: (seen.append(real(df)), seen[-1])[1])
    got = RT.batch_search(index, spark.createDataFrame([("q", "the needle a")], "query_id string, text string"), 2).collect()
    assert {r.id for r in got} == {3, 5}
    hits = [df for df in seen if "tf" in df.columns]
    assert [df.count() for df in hits] == [2]  # of 602 postings


def test_frames_are_those_of_one_text(spark):
    texts = [
        'panic: x\nmain.HandleRequest(0x1)\n\t/app/a.go:12\n  File "b/c.py", line 3, in parse_path\nmain.HandleRequest(0x1)', "", None, "Error: at run (x.js:1)\n at Object.doIt (y.js) in parse_path in it", "a.b.() _x(1) __init__(2)",
        " ".join(f"fn{i:02d}()" * (i % 3 + 1) for i in range(30)),
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "failure_id int, error_text string")
    got = {}
    for r in RT.frames(df).collect():
        got.setdefault(r.failure_id, set()).add(r.frame)
    assert got == {i: set(n) for i, t in enumerate(texts) if (n := I.stack_frames(t or "")[0])}


def test_suspects_of_many_failures(spark):
    names = [("a/x.go", "Login", "func (s *Auth) Login()"), ("a/y.go", "login", "func login()"), ("a/x.go", "Auth", "type Auth struct"), ("b/z.go", "Render", "func Render(a Auth)"), ("b/z.go", "other", "func other()")]
    symbols = spark.createDataFrame([(f"{p}::{n}", n, p, g) for p, n, g in names], "id string, name string, file_path string, signature string")
    edges = spark.createDataFrame([(f"c{i}", "b/z.go::Render", "CALLS") for i in range(30)] + [("c", "a/x.go::Login", "CALLS")], "from_id string, to_id string, kind string")
    index = T.build_index(symbols, ["name", "signature"])
    failures = spark.createDataFrame([(1, "panic\nauth.Login(0x1)\n\t/app/a/x.go:4\nm.Auth(2)"), (2, "Render(1)"), (3, "nothing"), (4, None)], "failure_id int, error_text string")
    recent = spark.createDataFrame([("b/z.go",)], "file_path string")
    got = {(r.failure_id, r.id): (round(r.score, 6), r.evidence) for r in RT.investigate(symbols, edges, index, failures, recent).collect()}
    assert got == {
        (1, "a/x.go::Login"): (0.7525, "stack_frame_exact_name_match,multi_frame_match,file_appears_in_trace,caller_fan_in=1"), (1, "a/y.go::login"): (0.45, "stack_frame_exact_name_match"),
        (1, "a/x.go::Auth"): (0.65, "stack_frame_exact_name_match,file_appears_in_trace"), (1, "b/z.go::Render"): (0.45, "stack_frame_match,modified_in_working_tree,caller_fan_in=30"),
        (2, "b/z.go::Render"): (0.7, "stack_frame_exact_name_match,modified_in_working_tree,caller_fan_in=30"),
    }
