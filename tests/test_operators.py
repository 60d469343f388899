import json

import pytest
from graph_fixture import edges, symbols
from pyspark.sql import functions as F

from graphmill.functions import scalars as S
from graphmill.operators import extract as X
from graphmill.operators import graph as G
from graphmill.operators import impact as I
from graphmill.operators import quality as Q
from graphmill.operators import resolve as R
from graphmill.operators import search as T
from graphmill.operators import store as K
from graphmill.operators import tools
from graphmill.operators.paths import reached
from graphmill.schema import PENDING, SYMBOLS
from graphmill.sources import files as FL
from graphmill.sources import sinks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_trace_equals_closure_on_a_cyclic_graph(spark):
    import random

    rng = random.Random(5)
    links = {(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", rng.choice(["CALLS", "HTTP_CALLS"])) for _ in range(30)}
    e = edges(spark, sorted(links)).cache()
    starts = spark.createDataFrame([(f"n{i}",) for i in range(12)], "start string")
    closed = rows(G.closure(e, 3).select("from_id", "to_id", "depth"))
    assert rows(G.trace(e, starts, "out", 3).select("start", "node", "depth")) == closed
    assert rows(reached(e, starts, 1, 3)) == closed
    best = {}
    for a in (f"n{i}" for i in range(12)):
        front = {a}
        for d in range(1, 4):
            front = {t for f, t, _ in links if f in front}
            for n in front - {a}:
                best.setdefault((a, n), d)
    assert [(a, b, d) for (a, b), d in sorted(best.items())] == closed


def test_trace_direction_depth_and_candidates(spark):
    assert G.direction_of("Callers") == "in" and G.trace_depth(9) == 3 and G.trace_depth(2) == 2
    with pytest.raises(ValueError):
        G.direction_of("sideways")
    e = edges(spark)
    start = spark.createDataFrame([("lamp.dim",)], "start string")
    got = rows(G.trace(e, start, "in", 3).select("node", "depth", "risk"))
    assert got == [("keeper.log", 3, "MEDIUM"), ("keeper.run", 2, "HIGH"), ("keeper.test", 3, "MEDIUM"), ("lamp.light", 1, "CRITICAL")]
    assert [r.id for r in G.trace_candidates(symbols(spark), "run").collect()] == ["keeper.run", "horn.run"]
    both = G.trace(e, spark.createDataFrame([("lamp.light",)], "start string"), "both", 1)
    assert {r.node for r in both.collect()} == {"keeper.run", "lamp.dim"}
    nodes, inside = G.callflow(e, "lamp.light", "both", 1)
    assert nodes.count() == 3 and inside.count() == 2
    assert sinks.mermaid(nodes, inside).startswith("flowchart LR")


def test_dead_and_audited_nodes(spark):
    s, e = symbols(spark), edges(spark)
    assert [r.id for r in Q.dead_nodes(s, e).collect()] == ["horn.run", "horn.unused"]
    assert [r.id for r in Q.dead_nodes(s.withColumn("name", F.when(F.col("id") == "horn.unused", "init").otherwise(F.col("name"))), e).collect()] == ["horn.run"]
    doubted = s.withColumn("extraction_confidence", F.when(F.col("id") == "horn.run", 0.9).otherwise(1.0))
    audited = Q.audit_unused(doubted, e, min_confidence=0.5)
    assert [(r.id, r.confidence) for r in audited.collect()] == [("horn.unused", "high"), ("horn.run", "medium")]


def test_percentiles_are_exact_and_rounded_down(spark):
    df = spark.createDataFrame([("k", float(x)) for x in range(1, 12)], "kind string, extraction_confidence double")
    assert rows(Q.kind_percentiles(df)) == [("k", 11, 2.0, 6.0)]


def test_paths_and_packages(spark):
    yes = ["a_test.go", "x.test.ts", "x.spec.js", "test_a.py", "a_test.py", "a_spec.rb", "FooTest.java", "FooTest.kt", "FooSpec.scala", "tests/a.go", "a/__tests__/b.js", "a\\test\\b.go"]
    no = ["foo.spec.unrelated", "featuretest/a.go", "specfile.txt", "testdata/a.go", "contest_winner.go"]
    got = {r.p: (r.t, r.f) for r in spark.createDataFrame([(p,) for p in yes + no], "p string").select("p", S.is_test_file(F.col("p")).alias("t"), S.is_fixture_path(F.col("p")).alias("f")).collect()}
    assert all(got[p][0] for p in yes) and not any(got[p][0] for p in no) and got["testdata/a.go"][1] and not got["a_test.go"][1]
    d = spark.createDataFrame([("a/b/c.go",), ("c.go",), ("@external",)], "p string").select(S.package_of_file(F.col("p"))).collect()
    assert [r[0] for r in d] == ["a/b", ".", ""]
    one = spark.range(1).select(
        S.approx_tokens(F.lit("abcde")), S.staleness(F.lit(7200)), S.size_text(F.lit(2048)), S.complexity(F.lit("if a && b || c for x")), S.risk_label(F.lit(4)), S.provenance_tier(F.lit(" inferred ")),
        S.name_of_id(F.lit("a/b.go::pkg.F#Function")), S.version_parts(F.lit("v1.10.0")) > S.version_parts(F.lit("1.9.9")),
    ).first()
    assert tuple(one) == (2, "2h", "2.0 KB", 5, "LOW", "INFERRED", "F", True)


def test_hunks():
    diff = "+++ b/a.go\n@@ -1,2 +5,3 @@\n@@ -9 +20,0 @@\n+++ b/c.go\n@@ -1 +7 @@\n@@ bad @@\n"
    assert I.parse_hunks(diff) == [("a.go", 5, 7), ("a.go", 20, 20), ("c.go", 7, 7)]


def test_hunk_overlap_is_inclusive(spark):
    s = symbols(spark).filter("id = 'lamp.light'").withColumn("start_line", F.lit(10)).withColumn("end_line", F.lit(20))
    hits = lambda a, b: I.changed_symbols(s, spark.createDataFrame([("station/lamp.go", a, b)], "file_path string, start_line int, end_line int")).count()
    assert (hits(20, 25), hits(21, 25), hits(1, 10), hits(1, 9), hits(None, None)) == (1, 0, 1, 0, 1)


def test_search_syntax(spark):
    assert T.sanitize("parse_path don't") == "parse_path dont"
    assert T.sanitize("db.Open") == '"db.Open"' and T.sanitize("foo*") == "foo*" and T.sanitize("HandleRequest") == '"HandleRequest"' and T.sanitize(".foo bar.") == ".foo bar."
    with pytest.raises(ValueError):
        T.parse("foo.*bar")
    with pytest.raises(ValueError):
        T.corpus_name("nope")
    docs = spark.createDataFrame([(1, "red apple pie"), (2, "red car"), (3, "green apple"), (4, "Café crème")], "id long, text string")
    index = T.build_index(docs, ["text"])
    ids = lambda q: (sorted(r.id for r in T.search(index, q)[0].collect()), T.search(index, q)[1])
    assert ids("red apple") == ([1], "all") and ids("car green") == ([2, 3], "any") and ids("app") == ([1, 3], "prefix") and ids('"apple pie"') == ([1], "all")
    assert T.sanitize("red OR green") == '"red OR green"' and T.sanitize("a_b OR green") == "a_b OR green"
    assert sorted(r.id for r in T.score(index, T.parse("red OR green")).collect()) == [1, 2, 3]
    assert ids("cafe") == ([4], "all") and ids("zebra") == ([], "prefix")
    assert T.least_confidence("name", "code") == 0.0 and T.least_confidence("two words", "code") == 0.71 and T.least_confidence("two words", "docs") == 0.0


def test_store(spark):
    s, e = symbols(spark), edges(spark)
    moved = s.withColumn("id", F.when(F.col("id") == "lamp.light", "lamp.light2").otherwise(F.col("id")))
    moves = K.detect_moves(s, moved)
    assert rows(moves) == [("p", "lamp.light", "lamp.light2")]
    asked = spark.createDataFrame([("p", "lamp.light"), ("p", "x")], "project_id string, id string")
    assert rows(K.resolve_stale(asked, moves)) == [("p", "lamp.light", "lamp.light2"), ("p", "x", "x")]
    kept, left = K.delete_file(s, e, spark.createDataFrame([("p", "station/keeper.py")], "project_id string, file_path string"))
    assert kept.count() == 8 and left.count() == 3
    assert K.insert_edges(e, e.withColumn("confidence", F.lit(0.1))).filter("confidence < 1").count() == 0
    df, total, more = K.page(s, [F.col("id")], 10, 5)
    assert (df.count(), total, more) == (1, 11, False)
    projects = spark.createDataFrame([("a", True, 5, 10), ("b", False, 5, 10), ("c", True, 1, 10), ("d", True, 5, 0)], "id string, alive boolean, last_active int, edges int")
    alive, drops = K.filter_projects(projects, 1, 2)
    assert [r.id for r in alive.collect()] == ["a"] and tuple(drops.first()) == (1, 1, 1)


def pending(spark, values):
    return spark.createDataFrame([("p", *v) for v in values], PENDING)


def nodes(spark, values):
    names = [f.split()[0] for f in SYMBOLS.split(", ")]
    out = []
    for path, qn, kind, lang in values:
        d = dict.fromkeys(names)
        d |= {"project_id": "p", "id": f"{path}::{qn}#{kind}", "file_path": path, "name": qn.rsplit(".", 1)[-1], "qualified_name": qn, "kind": kind, "language": lang, "start_byte": 0}
        out.append(tuple(d[n] for n in names))
    return spark.createDataFrame(out, SYMBOLS)


def test_call_resolution(spark):
    s = nodes(spark, [
        ("a/x.go", "pkg.Caller", "Function", "Go"), ("a/y.go", "pkg2.helper", "Function", "Go"), ("b/s_linux.go", "Store.Open", "Method", "Go"), ("b/s_windows.go", "Store.Open", "Method", "Go"),
        ("b/q.go", "Queue.Drain", "Method", "Go"), ("w/a.ts", "Widget", "Class", "TypeScript"), ("w/a.ts", "Widget.draw", "Method", "TypeScript"), ("w/b.ts", "main", "Function", "TypeScript"),
        ("w/c.ts", "unique", "Function", "TypeScript"),
    ])
    p = pending(spark, [
        ("a/x.go", "CALLS", "pkg.Caller", "helper", 1.0, None, None), ("a/x.go", "CALLS", "pkg.Caller", "s.Open", 1.0, "*Store", None), ("a/x.go", "CALLS", "pkg.Caller", "q.Drain", 1.0, None, None),
        ("a/x.go", "CALLS", "pkg.Caller", "strings.Drain", 1.0, None, None), ("a/x.go", "CALLS", "pkg.Caller", "missing", 1.0, None, None), ("w/b.ts", "CALLS", "main", "w.draw", 1.0, "Widget", None),
        ("w/b.ts", "CALLS", "main", "unique", 1.0, None, None), ("w/b.ts", "CALLS", "nobody", "unique", 1.0, None, None),
    ])
    found, drops = R.resolve_calls(s, p)
    got = {(r.from_id.split("::")[1], r.to_id) for r in found.collect()}
    assert got == {
        ("pkg.Caller#Function", "a/y.go::pkg2.helper#Function"), ("pkg.Caller#Function", "b/s_linux.go::Store.Open#Method"), ("pkg.Caller#Function", "b/s_windows.go::Store.Open#Method"),
        ("pkg.Caller#Function", "b/q.go::Queue.Drain#Method"), ("main#Function", "w/a.ts::Widget.draw#Method"), ("main#Function", "w/c.ts::unique#Function"),
    }
    assert tuple(drops.first()) == (1, 2, 0)


def test_other_resolvers(spark):
    s = nodes(spark, [
        ("a/x.py", "a.x", "Module", "Python"), ("src/lib.py", "src.lib", "Module", "Python"), ("a/x.py", "a.x.f", "Function", "Python"), ("a/x.py", "a.x.LIMIT", "Variable", "Python"),
        ("d.md", "intro", "Section", "Markdown"), ("d.md", "intro.more", "Section", "Markdown"), ("e.md", "top", "Section", "Markdown"), ("group_vars/all.yml", "port", "Setting", "YAML"),
        ("site.yml", "site", "Module", "YAML"),
    ])
    imports, ext = R.resolve_imports(s, pending(spark, [("a/x.py", "IMPORTS", "a.x", "lib", 1.0, None, None), ("a/x.py", "IMPORTS", "a.x", "os", 1.0, None, None)]), ["src"])
    assert {r.to_id for r in imports.collect()} == {"src/lib.py::src.lib#Module", "@external::os#Module"} and [r.name for r in ext.collect()] == ["os"]
    reads = R.resolve_reads(s, pending(spark, [("a/x.py", "READS", "a.x.f", "LIMIT", 0.8, None, None), ("a/x.py", "READS", "a.x", "f", 0.8, None, None)]))
    assert {(r.kind, r.confidence) for r in reads.collect()} == {("READS", 0.8), ("CALLS", 0.4)}
    refs = R.resolve_references(s, pending(spark, [("d.md", "REFERENCES", "intro", "doc:e.md", 1.0, None, None), ("e.md", "REFERENCES", "", "doc:d.md#more", 1.0, None, None), ("d.md", "REFERENCES", "intro", "intro.more", 1.0, None, None)]))
    assert {(r.from_id.split("::")[0], r.to_id.split("::")[1]) for r in refs.collect()} == {("d.md", "top#Section"), ("e.md", "intro.more#Section"), ("d.md", "intro.more#Section")}
    uses = R.resolve_uses_var(s, pending(spark, [("site.yml", "USES_VAR", "site", "port", 1.0, None, None)]))
    assert [r.to_id for r in uses.collect()] == ["group_vars/all.yml::port#Setting"]
    inc, made = R.resolve_file_edges(s, pending(spark, [("m1", "INCLUDES", "m1", "m2", 1.0, None, None)]), "INCLUDES")
    assert inc.count() == 1 and made.count() == 2
    c = spark.createDataFrame([("..b.c", "p/q/r.py"), ("x", "p/q.py"), ("....z", "p/q.py")], "t string, f string").select(R.python_candidates(F.col("t"), F.col("f"), ["src"])).collect()
    assert [r[0] for r in c] == [["p.b.c"], ["x", "src.x"], []]


SOURCES = {
    "Go": ("package a\nimport \"fmt\"\nfunc (s *Store) Open() error {\n  fmt.Println(1)\n  return nil\n}\ntype Store struct {\n}\n", {("Method", "Store.Open"), ("Class", "Store")}),
    "Python": ("import os\nclass A:\n    def f(self):\n        os.getcwd()\nX = 1\n", {("Class", "A"), ("Method", "A.f"), ("Variable", "X")}),
    "TypeScript": ("export class W {\n  draw() {\n    go();\n  }\n}\nexport const f = (x) => { return x }\n", {("Class", "W"), ("Method", "W.draw"), ("Function", "f")}),
    "Java": ("public class A {\n  public int f(int x) {\n    return 1;\n  }\n}\n", {("Class", "A"), ("Method", "A.f")}),
    "Rust": ("pub struct S { a: i32 }\npub fn go() { }\n", {("Class", "S"), ("Function", "go")}),
    "Ruby": ("class A\n  def f\n    1\n  end\nend\n", {("Class", "A"), ("Method", "A.f")}),
    "SQL": ("CREATE TABLE t (a int);\nCREATE INDEX i ON t(a);\n", {("Class", "t"), ("Setting", "i")}),
    "Bash": ("run() {\n  echo 1\n}\nNAME=1\n", {("Function", "run"), ("Variable", "NAME")}),
    "JSON": ('{"a": {"b": 1}}', {("Setting", "a"), ("Setting", "a.b")}),
    "TOML": ("[a]\nb = 1\n", {("Setting", "a"), ("Setting", "a.b")}),
    "YAML": ("a:\n  b: 1\nc: {{ d }}\n", {("Setting", "a"), ("Setting", "a.b"), ("Setting", "c")}),
    "XML": ("<a><b>1</b></a>", {("Block", "a"), ("Setting", "a.b")}),
    "Markdown": ("intro\n# One\n[x](b.md)\n## Two\n", {("Section", "preamble"), ("Section", "one"), ("Section", "one.two")}),
    "HTML": ("<title>T</title><h1>H</h1><a href='/x?y'>l</a>", {("Document", "title.0.T"), ("Section", "h1.1.H")}),
    "Makefile": ("all: b c\n\techo\nCC=gcc\n", {("Function", "all"), ("Variable", "CC")}),
    "HCL": ('resource "aws_x" "y" {\n}\nvariable "v" {}\n', {("Resource", "resource.aws_x.y"), ("Variable", "var.v")}),
    "Jinja": ("{% block a %}{{ b }}{% endblock %}{% include 'c' %}", {("Block", "a")}),
}


@pytest.mark.parametrize("lang", SOURCES)
def test_extractors(lang):
    text, want = SOURCES[lang]
    got = X.extract_file("f", lang, text)
    assert {(r["kind"], r["qualified_name"]) for r in got if r["row"] == "symbol"} == want


def test_extractors_never_fail():
    import random

    rng = random.Random(3)
    for lang in X.REGISTRY:
        for _ in range(15):
            text = "".join(rng.choice("{}()[]<>\"'#:=\n\t\\ abc0é\0|&;") for _ in range(200))
            assert all(r["row"] in ("symbol", "edge", "failure") for r in X.extract_file("f", lang, text))


def test_files_and_round_trip(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "m.py").write_text("def f():\n    return 1\n")
    (tmp_path / "run").write_text("#!/usr/bin/env bash\nx() {\n}\n")
    (tmp_path / "a" / "x.min.js").write_text("1")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "y.js").write_text("1")
    files = FL.walk(spark, str(tmp_path)).cache()
    assert rows(files.select("path", "language")) == [("a/m.py", "Python"), ("run", "Bash")]
    s = X.symbols_of(X.extract(files), "p").join(files.select(F.col("path").alias("file_path"), F.col("hash").alias("h")), "file_path").withColumn("file_hash", F.col("h")).drop("h")
    got = {r.qualified_name: (r.source, r.stale) for r in FL.source_of(s, files).collect()}
    assert got["f"] == ("def f():\n    return 1", False)
    changed = files.withColumn("hash", F.lit("0"))
    assert all(r.stale and r.source is None for r in FL.source_of(s, changed).collect())
    assert FL.changed_files(files, files).count() == 0 and FL.vanished_files(files.limit(0), files).count() == 2


def test_ignore_files_and_refused_folders(spark, tmp_path):
    files = {".gitignore": "*.log\n!keep.log\n/top\nbuild2/\n# no\ndoc/**/x?.txt\n[ab].md\n", "a.log": "", "keep.log": "", "top/x.py": "", "in/top/x.py": "", "in/build2/y.py": "", "in/build2x.py": "", "doc/p/q/x1.txt": "", "doc/x12.txt": "", "a.md": "", "c.md": "", "in/.gitignore": "z.py\n", "in/z.py": "", "z.py": "", "big.py": "x" * 99}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text or "x")
    out = {r.path: r.reason for r in FL.left_out(spark, str(tmp_path), 98).collect()}
    assert out == dict.fromkeys(("a.log", "top/x.py", "in/build2/y.py", "doc/p/q/x1.txt", "a.md", "in/z.py"), "ignored") | {"big.py": "too_large"}
    assert {r.path for r in FL.walk(spark, str(tmp_path), 98).collect()} == set(files) - set(out) - {".gitignore", "in/.gitignore"}
    for root in ("/", "file:///", "s3://bucket"):
        with pytest.raises(ValueError):
            FL.walk(spark, root)


def test_rules_of_calls_without_a_receiver(spark):
    s = nodes(spark, [
        ("a/v.go", "runner", "Variable", "Go"), ("a/t.go", "Engine.start", "Method", "Go"), ("a/x.go", "go1", "Function", "Go"), ("b/x.go", "go2", "Function", "Go"),
        ("w/p/a.ts", "p.twice", "Function", "TypeScript"), ("w/q/b.ts", "q.twice", "Function", "TypeScript"), ("w/p/c.ts", "main", "Function", "TypeScript"), ("w/r/d.ts", "far", "Function", "TypeScript"),
        ("m/n.py", "m.n.helper", "Function", "Python"), ("m/o.py", "use", "Function", "Python"),
    ]).withColumn("signature", F.when(F.col("name") == "runner", "*Engine"))
    p = pending(spark, [
        ("a/x.go", "CALLS", "go1", "runner.start", 1.0, None, None), ("b/x.go", "CALLS", "go2", "strings.start", 1.0, None, None), ("w/p/c.ts", "CALLS", "main", "twice", 1.0, None, None),
        ("w/r/d.ts", "CALLS", "far", "twice", 1.0, None, None), ("m/o.py", "CALLS", "use", "n.helper", 1.0, None, None), ("m/o.py", "CALLS", "use", "helper", 1.0, None, None),
    ])
    got = {(r.from_id.split("::")[1], r.to_id.split("::")[0]) for r in R.resolve_calls(s, p)[0].collect()}
    assert got == {("go1#Function", "a/t.go"), ("main#Function", "w/p/a.ts"), ("use#Function", "m/n.py")}


def test_sinks(spark, tmp_path):
    s, e = symbols(spark), edges(spark)
    sinks.write_lines(sinks.graphml_lines(s, e), str(tmp_path / "g"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "g")).collect())
    assert text.count("<node ") == 11 and text.count("<edge ") == 9
    assert sinks.dot_lines(s, e).count() == 22 and json.loads(sinks.json_lines(s, e).first().value)["type"] == "node"
    assert sinks.tabular(s.orderBy("id"), "nodes", ["id", "kind"], 2).startswith("nodes[2]{id,kind}:")
    assert "## Hotspots" in sinks.report(s, e, "Report")


def test_tools(spark):
    s = symbols(spark)
    out = tools.batch([tools.Step(lambda: s.filter("kind = 'Class'")), tools.Step(lambda: s, (0, "files"), "file_path")])
    assert out[1].count() == 3
    with pytest.raises(ValueError):
        tools.batch([tools.Step(lambda: s, (0, "ids"))])
    assert tools.why_empty(s, "nothing") == "no_such_name" and tools.why_empty(s, "Light", "Class") == "filtered_by_kind" and tools.why_empty(s, "Light", "Method", 2.0) == "filtered_by_confidence"
    assert tools.seed_quality("fix parse_path now", ["parse_path"]) == "strong" and tools.seed_quality("fix the parser", ["Parser"]) == "fair"
    names, files = I.stack_frames('panic: x\nmain.HandleRequest(0x1)\n\t/app/a.go:12\n  File "b/c.py", line 3, in parse_path')
    assert "HandleRequest" in names and "parse_path" in names and files == ["/app/a.go", "b/c.py"]
    ledger = spark.createDataFrame([("l", 1, "a", "d1"), ("l", 2, "b", "d2")], "loop_name string, seq int, claim string, decision string")
    assert tools.resume(ledger, "l").first().seq == 2 and tools.handoff(ledger, "l").first().claim == "HANDOFF\n- d1\n- d2"
    assert "func" in tools.skeleton_of_children(s.withColumn("parent", F.lit("x"))).first().outline
    assert X.skeleton("def f():\n    x = 1\n    y = 2\n    return x") == "def f():\n    ... 2 lines\n    return x"


def test_saved_tables(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red apple pie"), (2, "red car")], "id long, text string")
    index = T.build_index(docs, ["text"])
    T.save_index(index, str(tmp_path / "i"))
    again = T.load_index(spark, str(tmp_path / "i"))
    assert rows(T.search(again, "red apple")[0]) == rows(T.search(index, "red apple")[0]) and T.fragmentation(spark, str(tmp_path / "i")).count() == 3
    e, path = edges(spark), str(tmp_path / "e")
    K.write_edges(e, path)
    K.write_edges(e.filter("kind = 'READS'").limit(1), path)
    kept = spark.read.parquet(path)
    assert kept.filter("kind = 'READS'").count() == 1 and kept.filter("kind = 'CALLS'").count() == 6
    K.write_edges(e.limit(0), path, [("p", "READS", "per_file"), ("p", "none", "per_file")])
    left = spark.read.parquet(path)
    assert left.filter("kind = 'READS'").count() == 0 and left.filter("kind = 'CALLS'").count() == 6


def test_table_function(spark):
    X.register_udtf(spark)
    assert [tuple(r) for r in spark.sql("SELECT kind, name FROM extract_symbols('a.py', 'Python', 'def f():\n    pass\n')").collect()] == [("Function", "f")]
    files = spark.createDataFrame([("src/pkg/__init__.py",), ("a/b.py",)], "path string")
    assert X.python_source_roots(files) == ["", "src"]
