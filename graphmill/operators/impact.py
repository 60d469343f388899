"""What a change touches: hunks to symbols, blast radius, plans and their checks, assertions, onboarding, failures."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.functions import scalars as S
from graphmill.operators.graph import direct_callers
from graphmill.operators.paths import reached, reached_by_any, reversed_edges
from graphmill.schema import CALL_FAMILY

HIGH_BLAST = 14
BOUNDARY_LIMIT = 50


def parse_hunks(diff: str) -> list[tuple[str, int, int]]:
    """(file, first line, last line) of the new side of each hunk of a unified diff; a pure deletion is its one line."""
    out, path = [], ""
    for line in diff.splitlines():
        if line.startswith("+++ "):
            path = re.sub(r"^[ab]/", "", line[4:].split("\t")[0])
        elif m := re.match(r"@@ -\S+ \+(\d+)(?:,(\d+))? @@", line):
            a, n = int(m[1]), int(m[2]) if m[2] is not None else 1
            out.append((path, a, a + max(n, 1) - 1))
    return out


def changed_symbols(symbols: DataFrame, changes: DataFrame) -> DataFrame:
    """Symbols that a change (file_path, start_line, end_line) overlaps; without lines the whole file is changed.

    The join is by file; the overlap is a condition on it.
    """
    c = changes.select("file_path", F.col("start_line").alias("h0"), F.col("end_line").alias("h1"))
    whole = F.col("h0").isNull() | F.col("h1").isNull()
    return symbols.join(c, "file_path").filter(whole | ((F.col("h0") <= F.col("end_line")) & (F.col("h1") >= F.col("start_line")))).select(*symbols.columns).distinct()


def change_depth(depth: int) -> int:
    return max(1, min(depth, 5))


def blast_radius(symbols: DataFrame, edges: DataFrame, changed: DataFrame, depth: int = 3) -> DataFrame:
    """All callers of the changed nodes by least depth, with risk: one walk from all of them together, which keeps a node once and not for each start."""
    calls = edges.filter(F.col("kind").isin(list(CALL_FAMILY)))
    near = reached_by_any(reversed_edges(calls), changed.select("id"), change_depth(depth)).select(F.col("node").alias("id"), "depth")
    return near.join(symbols.select("id", "name", "kind", "file_path", "is_test"), "id").withColumn("risk", S.risk_label(F.col("depth")))


def impacted_tests(blast: DataFrame, edges: DataFrame, changed: DataFrame, depth: int = 3) -> DataFrame:
    """Tests among those affected, by how many changed nodes they reach; only tests are walked from to count these."""
    tests = blast.filter(F.col("is_test") | S.is_test_file(F.col("file_path")))
    calls = edges.filter(F.col("kind").isin(list(CALL_FAMILY)))
    met = reached(calls, tests.select(F.col("id").alias("start")), 1, change_depth(depth)).join(changed.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
    out = tests.join(met.groupBy(F.col("start").alias("id")).agg(F.count(F.lit(1)).alias("reaches")), "id")
    return out.select("id", "name", "file_path", "depth", "reaches", S.package_of_file(F.col("file_path")).alias("package"))


def tests_by_package(tests: DataFrame) -> DataFrame:
    runnable = F.col("file_path").rlike(r"_test\.go$")
    return tests.withColumn("runnable", runnable).groupBy("package", "runnable").agg(F.count(F.lit(1)).alias("tests"))


def callers_by_file(symbols: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    e = edges.filter(F.col("kind").isin(list(CALL_FAMILY))).join(changed.select(F.col("id").alias("to_id")), "to_id", "left_semi").select("from_id").distinct()
    return e.join(symbols.select(F.col("id").alias("from_id"), "file_path"), "from_id").groupBy("file_path").agg(F.count(F.lit(1)).alias("direct_callers"))


def assert_exists(symbols: DataFrame, name: str) -> DataFrame:
    return symbols.agg((F.count_if(F.col("name") == name) > 0).alias("passed"))


def assert_max_callers(edges: DataFrame, target: str, most: int) -> DataFrame:
    return direct_callers(edges, F.lit(target)).agg(F.count(F.lit(1)).alias("callers"), (F.count(F.lit(1)) <= most).alias("passed"))


def assert_no_callers_outside(edges: DataFrame, target: str, prefixes: list[str], limit: int = 10) -> DataFrame:
    """Callers outside of some paths: none if the assertion holds."""
    return direct_callers(edges, F.lit(target)).filter(~S.under_any(S.file_of_id(F.col("from_id")), prefixes)).orderBy("from_id").limit(limit)


def assert_no_calls_to(edges: DataFrame, sources: list[str], targets: list[str], limit: int | None = 10) -> DataFrame:
    """Calls from below some paths to below others: none if the assertion holds."""
    path = lambda c: S.file_of_id(F.col(c))
    out = edges.filter(F.col("kind").isin(list(CALL_FAMILY)) & S.under_any(path("from_id"), sources) & S.under_any(path("to_id"), targets)).select("from_id", "to_id").distinct()
    return out if limit is None else out.orderBy("from_id", "to_id").limit(limit)


def plan_change(symbols: DataFrame, edges: DataFrame, target: str, depth: int = 3) -> DataFrame:
    """Callers of a target by depth, with whether they lie in another package and whether they are tests."""
    start = symbols.filter(F.col("id") == target)
    own = start.select(S.package_of_file(F.col("file_path")).alias("own_package"))
    out = blast_radius(symbols, edges, start, depth).crossJoin(F.broadcast(own))
    return out.select(
        "id", "name", "file_path", "depth", "risk", (S.package_of_file(F.col("file_path")) != F.col("own_package")).alias("cross_package"),
        (F.col("is_test") | S.is_test_file(F.col("file_path"))).alias("in_tests"),
    )


def high_blast(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count(F.lit(1)).alias("callers"), (F.count(F.lit(1)) > HIGH_BLAST).alias("high_blast"))


def decisions_for(decisions: DataFrame, keywords: list[str]) -> DataFrame:
    """Decisions (key, value) whose text holds a keyword, each once, with the first keyword that it holds."""
    text = F.lower(F.concat_ws(" ", "key", "value"))
    hit = F.lit(None).cast("string")
    for k in reversed(keywords):
        hit = F.when(F.contains(text, F.lit(k.lower())), F.lit(k)).otherwise(hit)
    return decisions.withColumn("keyword", hit).filter("keyword is not null")


def verify_change(planned: DataFrame, actual: DataFrame) -> DataFrame:
    """(id, verdict): planned and touched, planned but untouched, or touched without a plan."""
    p, a = planned.select("id", F.lit(True).alias("p")).distinct(), actual.select("id", F.lit(True).alias("a")).distinct()
    verdict = F.when(F.col("p") & F.col("a"), "as_planned").when(F.col("p"), "untouched").otherwise("unplanned")
    return p.join(a, "id", "full").select("id", verdict.alias("verdict"))


def branch_overlap(symbols: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(what, name) of files and symbols that two sets of changes share."""
    files = left.select("file_path").intersect(right.select("file_path")).select(F.lit("file").alias("what"), F.col("file_path").alias("name"))
    both = changed_symbols(symbols, left).select("id").intersect(changed_symbols(symbols, right).select("id"))
    return files.union(both.select(F.lit("symbol"), "id"))


def overlap_verdict(overlap: DataFrame) -> DataFrame:
    n = lambda w: F.count_if(F.col("what") == w)
    out = overlap.agg(n("file").alias("files"), n("symbol").alias("symbols"))
    return out.withColumn("verdict", F.when(F.col("symbols") > 0, "conflict").when(F.col("files") > 0, "same_files").otherwise("clear"))


def module_nodes(symbols: DataFrame, prefix: str) -> DataFrame:
    return symbols.filter(S.under_any(F.col("file_path"), [prefix]))


def onboard_summary(symbols: DataFrame, prefix: str) -> DataFrame:
    """One row on a folder: nodes, entry points, exports, tests and the share of tests."""
    t = F.col("is_test") | S.is_test_file(F.col("file_path"))
    out = module_nodes(symbols, prefix).agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("is_entry_point")).alias("entry_points"), F.count_if(F.col("is_exported")).alias("exported"), F.count_if(t).alias("tests"))
    return out.withColumn("test_share", F.when(F.col("nodes") > 0, F.col("tests") / F.col("nodes"))).withColumn("mostly_tests", F.coalesce(F.col("test_share") >= 0.8, F.lit(False)))


def language_share(symbols: DataFrame) -> DataFrame:
    by = symbols.groupBy("language").agg(F.count(F.lit(1)).alias("n"))
    return by.crossJoin(F.broadcast(by.agg(F.sum("n").alias("total")))).select("language", "n", (F.col("n") / F.col("total")).alias("share"))


def boundary_edges(symbols: DataFrame, edges: DataFrame, prefix: str, limit: int | None = BOUNDARY_LIMIT) -> DataFrame:
    """Edges that enter or leave a folder, with the names of their ends where those are known."""
    e = edges.select("from_id", "to_id", "kind", S.under_any(S.file_of_id(F.col("from_id")), [prefix]).alias("f"), S.under_any(S.file_of_id(F.col("to_id")), [prefix]).alias("t"))
    e = e.filter("f <> t").withColumn("way", F.when(F.col("t"), "in").otherwise("out")).drop("f", "t").distinct()
    s = symbols.select("id", "name")
    out = e.join(s.select(F.col("id").alias("from_id"), F.col("name").alias("from_name")), "from_id", "left").join(s.select(F.col("id").alias("to_id"), F.col("name").alias("to_name")), "to_id", "left")
    out = out.select("way", "from_id", "to_id", "kind", "from_name", "to_name")
    return out if limit is None else out.orderBy("way", "from_id", "to_id", "kind").limit(limit)


def context(symbols: DataFrame, edges: DataFrame, symbol: str) -> DataFrame:
    """A node's direct callees and imports."""
    e = edges.filter((F.col("from_id") == symbol) & F.col("kind").isin("CALLS", "IMPORTS")).select(F.col("to_id").alias("id"), F.col("kind").alias("via")).distinct()
    return e.join(symbols.select("id", "name", "kind", "file_path"), "id")


# Words in a stack trace that name nothing of the program.
_STOP = frozenset((
    "error", "exception", "panic", "goroutine", "running", "main", "at", "in", "line", "file", "traceback", "most", "recent", "call", "last", "raise", "return", "self", "runtime",
    "native", "caused", "by",
))
_FRAME = re.compile(r"(?<![\w/.-])([A-Za-z_][\w.]*)\s*(?=\()")
_FILE = re.compile(r"([\w./\\-]+\.(?:go|py|js|ts|tsx|java|rb|rs|cs|php|kt|swift|cpp|c|h))(?::(\d+)|\", line (\d+))?")


def stack_frames(text: str, limit: int = 20) -> tuple[list[str], list[str]]:
    """Names of functions in an error text, by how often and how long they are, and files."""
    counts: dict[str, int] = {}
    for m in _FRAME.finditer(text):
        name = m[1].rstrip(".").rsplit(".", 1)[-1]
        if len(name) > 2 and name.lower() not in _STOP:
            counts[name] = counts.get(name, 0) + 1
    for m in re.finditer(r"\bin ([A-Za-z_]\w+)", text):
        if m[1].lower() not in _STOP:
            counts[m[1]] = counts.get(m[1], 0) + 1
    names = sorted(counts, key=lambda n: (-counts[n], -len(n), n))[:limit]
    return names, list(dict.fromkeys(m[1].replace("\\", "/") for m in _FILE.finditer(text)))


def suspects(symbols: DataFrame, edges: DataFrame, names: list[str], files: list[str], recent_files: list[str] | None = None, limit: int | None = 20) -> DataFrame:
    """Nodes that an error may come from: name .45 exactly or .20 loosely, .20 each for its file and a recent change, fan-in up to .05."""
    lower = [n.lower() for n in names]
    exact, loose = F.col("name").isin(names), F.lower("name").isin(lower)
    s = symbols.filter(loose)
    into = edges.join(s.select(F.col("id").alias("to_id")), "to_id", "left_semi").groupBy(F.col("to_id").alias("id")).agg(F.count(F.lit(1)).alias("fan_in"))
    in_file = F.lit(False)
    for f in files:
        in_file = in_file | (F.col("file_path") == f) | F.lit(f).endswith(F.concat(F.lit("/"), F.col("file_path"))) | F.col("file_path").endswith("/" + f)
    recent = F.col("file_path").isin(recent_files) if recent_files else F.lit(False)
    value = (
        F.when(exact, 0.45).otherwise(0.20) + F.when(in_file, 0.20).otherwise(0.0) + F.when(recent, 0.20).otherwise(0.0)
        + 0.05 * F.least(F.coalesce("fan_in", F.lit(0)), F.lit(20)) / 20
    )
    out = s.join(into, "id", "left").select("id", "name", "file_path", F.least(F.lit(1.0), value).alias("score"))
    return out if limit is None else out.orderBy(F.desc("score"), "id").limit(limit)


def context_for_task(symbols: DataFrame, edges: DataFrame, seeds: DataFrame, hub: int = 150, limit: int = 10) -> DataFrame:
    """Seeds (id, score) in order: production before tests, plain nodes before hubs, then by score; with their callers and callees counted."""
    e = edges.filter(F.col("kind").isin(list(CALL_FAMILY)))
    ids = seeds.select("id")
    callers = e.join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi").groupBy(F.col("to_id").alias("id")).agg(F.countDistinct("from_id").alias("callers"))
    callees = e.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").groupBy(F.col("from_id").alias("id")).agg(F.countDistinct("to_id").alias("callees"))
    out = seeds.join(symbols.select("id", "name", "kind", "file_path", "is_test"), "id").join(callers, "id", "left").join(callees, "id", "left").na.fill(0, ["callers", "callees"])
    test = F.col("is_test") | S.is_test_file(F.col("file_path"))
    return out.withColumn("pass", test.cast("int") * 2 + (F.col("callers") > hub).cast("int")).drop("is_test").orderBy("pass", F.desc("score"), "id").limit(limit)
