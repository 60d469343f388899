"""Usage logs: tool statistics, savings, hooks, loops, coaching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_NS = 86_400 * 10**9
WEEK = 7 * DAY_NS
# What counts as a single fact, a burst of them, and a heavy answer.
BURST_TOOLS, BURST_TOKENS, BURST_CALLS = ("search", "symbol", "trace"), 600, 3
HEAVY_TOOLS, HEAVY_TOKENS, HEAVY_TARGET = ("context", "symbols"), 2000, 800
LEAST_CALLS = 10
# Cumulative savings that are worth a word.
MILESTONES = (100_000, 1_000_000, 10_000_000, 100_000_000, 1_000_000_000)


def since(log: DataFrame, now: Column, span: int = WEEK) -> DataFrame:
    """Rows of the trailing window; now is an epoch in nanoseconds."""
    return log.filter(F.col("ts") >= now - span)


def latest(log: DataFrame) -> int:
    """The last moment of a log, which stands for now."""
    return log.agg(F.max("ts")).first()[0] or 0


def _stats(log: DataFrame, key: str) -> DataFrame:
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return log.groupBy(key).agg(F.count(F.lit(1)).alias("calls"), F.avg("tokens_used").alias("avg_tokens"), F.sum(zero("tokens_used")).alias("tokens_used"), F.sum(zero("tokens_saved")).alias("tokens_saved"))


def tool_stats(log: DataFrame, limit: int | None = None) -> DataFrame:
    out = _stats(log, "tool")
    return out if limit is None else out.orderBy(F.desc("calls"), "tool").limit(limit)


def tier_stats(log: DataFrame) -> DataFrame:
    return _stats(log.filter(F.coalesce("complexity_tier", F.lit("")) != ""), "complexity_tier")


def savings_rows(log: DataFrame) -> DataFrame:
    missing = lambda c: F.sum(F.col(c).isNull().cast("int")).cast("bigint")
    return log.groupBy("tool", "complexity_tier").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("tokens_used").alias("tokens_used"), F.sum("tokens_saved").alias("tokens_saved"), missing("tokens_used").alias("missing_used"),
        missing("tokens_saved").alias("missing_saved"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


def savings_window(log: DataFrame) -> DataFrame:
    """One row: baseline, percentage (null where a value is missing), and whether the figure may be claimed."""
    out = savings_rows(log).agg(
        F.sum("calls").alias("calls"), F.coalesce(F.sum("tokens_used"), F.lit(0)).alias("tokens_used"), F.coalesce(F.sum("tokens_saved"), F.lit(0)).alias("tokens_saved"),
        F.sum(F.col("missing_used") + F.col("missing_saved")).alias("missing"),
    )
    base = F.col("tokens_used") + F.col("tokens_saved")
    return out.withColumn("baseline", base).withColumn("saved_pct", F.when((F.col("missing") == 0) & (base > 0), 100.0 * F.col("tokens_saved") / base)).withColumn("claimable", (F.col("missing") == 0) & (base > 0))


def payload_stats(log: DataFrame) -> DataFrame:
    b = F.col("response_bytes")
    return log.groupBy("tool").agg(F.count(F.lit(1)).alias("calls"), F.min(b).alias("min_bytes"), F.avg(b).alias("avg_bytes"), F.max(b).alias("max_bytes"), F.sum(b).alias("sum_bytes"))


def payload_outliers(log: DataFrame, ratio: float = 10, least: int = 100 * 1024, top: int = 3) -> DataFrame:
    out = payload_stats(log).withColumn("ratio", F.col("max_bytes") / F.col("avg_bytes"))
    return out.filter((F.col("ratio") >= ratio) & (F.col("max_bytes") >= least)).orderBy(F.desc("ratio"), "tool").limit(top)


def session_rollup(log: DataFrame) -> DataFrame:
    return log.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("tokens_used"), F.lit(0)).alias("tokens_used"), F.coalesce(F.sum("tokens_saved"), F.lit(0)).alias("tokens_saved"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


def calls_by_language(sessions: DataFrame, column: str = "calls_by_language") -> DataFrame:
    """Sums over a column of JSON maps from language to calls."""
    return sessions.select(F.explode(F.from_json(column, "map<string,bigint>")).alias("language", "n")).groupBy("language").agg(F.sum("n").alias("calls"))


def between(log: DataFrame, begin: int, end: int) -> DataFrame:
    return log.filter((F.col("ts") >= begin) & (F.col("ts") < end))


def recent_calls(log: DataFrame, session: str, limit: int) -> DataFrame:
    return log.filter(F.col("session_id") == session).orderBy(F.desc("ts"), F.desc("request_id")).limit(limit)


def resolve_hooks(hooks: DataFrame, calls: DataFrame, within: int = 3) -> DataFrame:
    """Redirects with took_recommendation: whether the tool they suggest is among the session's next three calls; null while there is none.

    Calls are numbered through within their session: by a window over each session and day, plus the calls of
    the days before, so that one session with most of the log is many tasks.  A hook then looks up the
    numbers that follow its own by an equi-join.
    """
    redirects = hooks.filter(F.col("decision") == "redirect")
    c = calls.select("session_id", "at", F.col("request_id").alias("key"), "tool", F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("string").alias("suggested"))
    h = redirects.select("session_id", "at", F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("tool"), "id", F.col("suggested_tool").alias("suggested"))
    both = c.unionByName(h).withColumn("day", F.to_date("at"))
    # Calls at the moment of a hook come before it, so that only later ones follow.
    order = Window.partitionBy("session_id", "day").orderBy("at", F.col("id").isNotNull(), F.col("key").cast("bigint"), "id")
    counted = both.withColumn("seen", F.count("tool").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    earlier = Window.partitionBy("session_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = both.groupBy("session_id", "day").agg(F.count("tool").alias("n")).select("session_id", "day", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = counted.join(days, ["session_id", "day"]).withColumn("seen", F.col("seen") + F.col("before"))
    numbered = placed.filter("tool is not null").select("session_id", F.col("seen").alias("n"), "tool")
    wanted = placed.filter("id is not null").select("session_id", "id", "suggested", F.explode(F.array(*[F.col("seen") + i for i in range(1, within + 1)])).alias("n"))
    found = wanted.join(numbered, ["session_id", "n"], "left").groupBy("id").agg(F.count("tool").alias("following"), F.max((F.col("tool") == F.col("suggested")).cast("int")).alias("took"))
    return redirects.join(found, "id").withColumn("took_recommendation", F.when(F.col("following") > 0, F.coalesce("took", F.lit(0)))).drop("following", "took")


def hook_conversion(resolved: DataFrame) -> DataFrame:
    """Share of redirects that were taken, and of resolved ones that were overridden."""
    n = lambda c: F.count_if(c)
    took = F.col("took_recommendation")
    out = resolved.agg(F.count(F.lit(1)).alias("redirects"), n(took == 1).alias("taken"), n(took.isNotNull()).alias("resolved"), n(took == 0).alias("ignored"))
    return out.withColumn("conversion_pct", F.when(F.col("redirects") > 0, 100.0 * F.col("taken") / F.col("redirects"))).withColumn(
        "override_pct", F.when(F.col("resolved") > 0, 100.0 * F.col("ignored") / F.col("resolved"))
    )


def hook_counts(hooks: DataFrame) -> DataFrame:
    return hooks.groupBy("tool_name", "decision").agg(F.count(F.lit(1)).alias("n"))


def hook_savings(hooks: DataFrame) -> DataFrame:
    return hooks.agg(F.coalesce(F.sum("est_tokens_served"), F.lit(0)).alias("served"), F.coalesce(F.sum("baseline_tokens"), F.lit(0)).alias("baseline"))


def tokens_left(resolved: DataFrame) -> DataFrame:
    """What ignored redirects would have saved; rows without both figures add nothing."""
    gap = F.when(F.col("baseline_tokens").isNotNull() & F.col("est_tokens_served").isNotNull(), F.greatest(F.col("baseline_tokens") - F.col("est_tokens_served"), F.lit(0)))
    return resolved.filter("took_recommendation = 0").agg(F.count(F.lit(1)).alias("ignored"), F.coalesce(F.sum(gap), F.lit(0)).alias("tokens_left"))


def opening_sessions(log: DataFrame, tool: str = "loop", first: int = 3) -> DataFrame:
    """Sessions, and those that use a tool in their first calls.

    Only the first rows of a session pass the filter on their rank, which Spark applies before the shuffle too.
    """
    w = Window.partitionBy("session_id").orderBy("ts", F.col("request_id").cast("bigint"))
    ranked = log.select("session_id", "tool", "ts", "request_id").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= first)
    by = ranked.groupBy("session_id").agg(F.max((F.col("tool") == tool).cast("int")).alias("opens"))
    return by.agg(F.count(F.lit(1)).alias("sessions"), F.coalesce(F.sum("opens"), F.lit(0)).cast("bigint").alias("opening"))


def append_checkpoints(ledger: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """ledger with new rows numbered on from the last seq of their project and loop."""
    keys = ["project_id", "loop_name"]
    last = ledger.groupBy(*keys).agg(F.max("seq").alias("__last"))
    w = Window.partitionBy(*keys).orderBy(order)
    numbered = new.join(last, keys, "left").withColumn("seq", (F.coalesce("__last", F.lit(0)) + F.row_number().over(w)).cast("int")).drop("__last", order)
    return ledger.unionByName(numbered)


def loop_stats(ledger: DataFrame, keys: tuple[str, ...] = ("loop_name",)) -> DataFrame:
    """Checkpoints by loop, and what the last one says: its claim, or its decision where that is empty."""
    said = F.coalesce(F.when(F.col("claim") != "", F.col("claim")), F.col("decision"))
    return ledger.groupBy(*keys).agg(F.count(F.lit(1)).alias("checkpoints"), F.max("seq").alias("last_seq"), F.max_by(said, "seq").alias("latest"))


def counted_checkpoints(ledger: DataFrame) -> DataFrame:
    """All checkpoints, and those that decide something and hand nothing over."""
    counts = (F.trim("decision") != "") & ~F.col("claim").startswith("HANDOFF")
    return ledger.agg(F.count_if(counts).alias("counted"), F.count(F.lit(1)).alias("total"))


def efficiency(log: DataFrame, ignored: DataFrame, ledger: DataFrame, now: int, opening_tool: str = "loop", recovery_tool: str = "investigate_failure") -> DataFrame:
    """This week and the week before: tokens, calls, waste rate and recovery load.  ignored: redirects (ts) that were not taken."""
    half = lambda c: F.when((c >= now - WEEK) & (c < now + 10**9), "this").when((c >= now - 2 * WEEK) & (c < now - WEEK), "before")
    used = log.withColumn("week", half(F.col("ts"))).filter("week is not null").groupBy("week").agg(
        F.sum("tokens_used").alias("tokens_used"), F.count(F.lit(1)).alias("calls"), F.count_if(F.col("tool") == recovery_tool).alias("recovery")
    )
    wasted = ignored.withColumn("week", half(F.col("ts"))).filter("week is not null").groupBy("week").agg(F.count(F.lit(1)).alias("wasted"))
    out = used.join(wasted, "week", "left").na.fill(0, ["wasted"]).crossJoin(F.broadcast(counted_checkpoints(ledger)))
    return out.select(
        "week", "tokens_used", "calls", "recovery", "wasted", (F.col("wasted") / F.col("calls")).alias("waste_rate"),
        F.when(F.col("counted") > 0, F.col("tokens_used") / F.col("counted")).alias("iteration_cost"),
    )


def coach(
    log: DataFrame, overhead: int, left: DataFrame | None = None, burst_tools: tuple[str, ...] = BURST_TOOLS, heavy_tools: tuple[str, ...] = HEAVY_TOOLS, zero: DataFrame | None = None, regression: DataFrame | None = None
) -> DataFrame:
    """Findings (pattern, occurrences, tokens), the dearest first; none for fewer than ten calls.

    left: what ignored redirects would have saved; zero: (tokens_used) of calls whose empty result surprised; regression: les_regression().
    """
    burst = F.col("tool").isin(list(burst_tools)) & (F.col("tokens_used") < BURST_TOKENS)
    heavy = F.col("tool").isin(list(heavy_tools)) & (F.col("tokens_used") > HEAVY_TOKENS)
    sums = log.agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(burst).alias("b"), F.count_if(heavy).alias("h"), F.coalesce(F.sum(F.when(heavy, F.col("tokens_used") - HEAVY_TARGET)), F.lit(0)).alias("ht")
    )
    rows = [
        sums.select("calls", F.lit("single_fact_burst").alias("pattern"), F.col("b").alias("occurrences"), ((F.col("b") - 1) * overhead).alias("tokens"), (F.col("b") >= BURST_CALLS).alias("on")),
        sums.select("calls", F.lit("unbudgeted_heavy_context"), "h", "ht", F.col("h") > 0),
    ]
    out = rows[0].union(rows[1])
    if left is not None:
        out = out.union(left.crossJoin(F.broadcast(sums.select("calls"))).select("calls", F.lit("hook_fall_through"), "ignored", "tokens_left", F.col("ignored") > 0))
    more = []
    if zero is not None:
        more.append(zero.agg(F.count(F.lit(1)).alias("occurrences"), F.coalesce(F.sum("tokens_used"), F.lit(0)).alias("tokens")).select(F.lit("zero_result_churn").alias("pattern"), "occurrences", "tokens"))
    if regression is not None:
        more.append(regression.select("pattern", "occurrences", "tokens"))
    for rows in more:
        out = out.union(rows.crossJoin(F.broadcast(sums.select("calls"))).select("calls", "pattern", "occurrences", "tokens", F.col("occurrences") > 0))
    return out.filter((F.col("calls") >= LEAST_CALLS) & F.col("on")).select("pattern", "occurrences", "tokens").orderBy(F.desc("tokens"), "pattern")


def milestones(log: DataFrame, fired: DataFrame | None = None, steps: tuple[int, ...] = MILESTONES) -> DataFrame:
    """The largest threshold that all savings reach, unless it has fired."""
    total = log.agg(F.coalesce(F.sum("tokens_saved"), F.lit(0)).alias("saved"))
    at = F.lit(None).cast("bigint")
    for s in steps:
        at = F.when(F.col("saved") >= s, F.lit(s).cast("bigint")).otherwise(at)
    out = total.select("saved", at.alias("threshold")).filter("threshold is not null")
    return out if fired is None else out.join(fired.select("threshold"), "threshold", "left_anti").select("saved", "threshold")


def latency(log: DataFrame, key: str, column: str) -> DataFrame:
    """Count, total, mean, largest, and the values at n/2 and 95n/100 of the sorted ones, exact.

    Equal values are counted before they are ranked, so no group is gathered into one task.
    """
    counts = log.filter(F.col(column).isNotNull()).groupBy(key, F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(key)
    ranked = counts.withColumn("upto", F.sum("c").over(w.orderBy("v"))).withColumn("n", F.sum("c").over(w))
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.col("n") * p / 100)), F.col("v")))
    out = ranked.groupBy(key).agg(F.max("n").alias("n"), F.sum(F.col("v") * F.col("c")).alias("total"), F.max("v").alias("largest"), at(50).alias("p50"), at(95).alias("p95"))
    return out.select(key, "n", "total", (F.col("total") / F.col("n")).alias("mean"), "largest", "p50", "p95")


def composite_score(gains: DataFrame) -> DataFrame:
    """accuracy * 10 + tokens * 0.001 + p50 * 0.05 + p95 * 0.02 + trips * 5, gains below zero counting as none."""
    floor = lambda c: F.greatest(F.col(c), F.lit(0.0))
    total = F.col("accuracy") * 10 + floor("tokens") * 0.001 + floor("p50") * 0.05 + floor("p95") * 0.02 + floor("trips") * 5
    return gains.withColumn("score", total)


def bench_history(runs: DataFrame, results: DataFrame, limit: int = 20) -> DataFrame:
    """The last runs (run_id, project_id, ts) with their results (run_id, metric, value)."""
    last = runs.orderBy(F.desc("ts"), "run_id").limit(limit)
    return results.join(F.broadcast(last), "run_id").select("run_id", "ts", "metric", "value")


def bench_regressions(baseline: DataFrame, actual: DataFrame, ns: float = 0.20, allocs: float = 0.30) -> DataFrame:
    """Benchmarks (name, ns, allocs) that have become slower, or allocate more, than the gate allows."""
    a = actual.select("name", F.col("ns").alias("new_ns"), F.col("allocs").alias("new_allocs"))
    grown = lambda new, old: F.when(F.col(old) > 0, F.col(new) / F.col(old) - 1).otherwise(0.0)
    out = baseline.join(a, "name").withColumn("ns_growth", grown("new_ns", "ns")).withColumn("allocs_growth", grown("new_allocs", "allocs"))
    return out.filter((F.col("ns_growth") > ns) | (F.col("allocs_growth") > allocs)).select("name", "ns_growth", "allocs_growth")


def recent(log: DataFrame, order: str, limit: int) -> DataFrame:
    """The latest rows of a log of failures or slow queries."""
    return log.orderBy(F.desc(order)).limit(limit)


def seen_before(hooks: DataFrame) -> DataFrame:
    """hooks with whether their session has had the same file before."""
    first = hooks.groupBy("session_id", "file_path").agg(F.min(F.struct("ts", "id")).alias("__first"))
    return hooks.join(first, ["session_id", "file_path"], "left").withColumn("seen", F.coalesce(F.struct("ts", "id") > F.col("__first"), F.lit(False))).drop("__first")


def session_probes(hooks: DataFrame, root: str, tool: str = "Read", task_tool: str = "Task", advice: str = "advise_index") -> DataFrame:
    """(session_id, reads_under_root, tasks, advised): what a session has done so far at or below a folder, and whether it was advised on it."""
    path = F.col("file_path")
    below = (path == root) | path.startswith(root.rstrip("/") + "/")
    return hooks.groupBy("session_id").agg(
        F.count_if((F.col("tool_name") == tool) & below).alias("reads_under_root"), F.count_if(F.col("tool_name") == task_tool).alias("tasks"),
        (F.count_if((F.col("decision") == advice) & (path == root)) > 0).alias("advised"),
    )


# -- efficiency week over week -----------------------------------------------------------------------
def _week_of(ts: Column, now: int) -> Column:
    """Half-open weeks that meet: a row is never in both."""
    return F.when((ts >= now - WEEK) & (ts < now + 10**9), "this").when((ts >= now - 2 * WEEK) & (ts < now - WEEK), "before")


def les_weeks(log: DataFrame, ledger: DataFrame, now: int, ignored: DataFrame | None = None, zero: DataFrame | None = None, loop_tool: str = "loop", recovery_tool: str = "investigate_failure", first: int = 3) -> DataFrame:
    """For this week and the one before: tokens and calls, what an iteration costs, the share that was wasted, recoveries, and how many sessions went on from the ledger.

    ledger: (ts, claim, decision) of checkpoints; ignored, zero: (ts) of redirects not taken and of unexpected empty results.
    A figure that can not be had is null: the cost without a counted checkpoint, the fidelity with an empty ledger.
    """
    week = lambda df: df.withColumn("week", _week_of(F.col("ts"), now)).filter("week is not null")
    used = week(log).groupBy("week").agg(F.sum("tokens_used").alias("tokens_used"), F.count(F.lit(1)).alias("calls"), F.count_if(F.col("tool") == recovery_tool).alias("recovery_load"))
    wasted = [week(df.select("ts")).select("week") for df in (ignored, zero) if df is not None] or [log.limit(0).select(F.lit("").alias("week"))]
    wasted = (wasted[0] if len(wasted) == 1 else wasted[0].unionAll(wasted[1])).groupBy("week").agg(F.count(F.lit(1)).alias("wasted"))
    decided = (F.trim("decision") != "") & ~F.col("claim").startswith("HANDOFF")
    counted = week(ledger).groupBy("week").agg(F.count_if(decided).alias("checkpoints"))
    # Only a session's first rows of a week pass the filter on their rank, which Spark applies before the shuffle too.
    w = Window.partitionBy("week", "session_id").orderBy("ts", F.col("request_id").cast("bigint"))
    opened = week(log.select("session_id", "tool", "ts", "request_id")).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= first)
    opened = opened.groupBy("week", "session_id").agg(F.max((F.col("tool") == loop_tool).cast("int")).alias("opens")).groupBy("week").agg(F.count(F.lit(1)).alias("sessions"), F.sum("opens").alias("opening"))
    out = used.join(wasted, "week", "left").join(counted, "week", "left").join(opened, "week", "left").na.fill(0, ["wasted", "checkpoints"])
    any_ = F.broadcast(ledger.agg((F.count(F.lit(1)) > 0).alias("__ledger")))
    return out.crossJoin(any_).select(
        "week", "tokens_used", "calls", "wasted", (F.col("wasted") / F.col("calls")).alias("waste_rate"), "checkpoints",
        F.when(F.col("checkpoints") > 0, F.col("tokens_used") / F.col("checkpoints")).alias("iteration_cost"), "recovery_load", "sessions", "opening",
        F.when(F.col("__ledger"), F.col("opening") / F.col("sessions")).alias("continuation_fidelity"),
    )


def les_regression(weeks: DataFrame) -> DataFrame:
    """(pattern, sub_metric, occurrences, tokens): the figure that has become worse at the highest price, and how many have; none without a week before."""
    names = ("tokens_used", "calls", "waste_rate", "checkpoints", "iteration_cost", "recovery_load", "continuation_fidelity")
    both = weeks.agg(*[F.max(F.when(F.col("week") == k, F.col(n))).alias(f"{n}_{k}") for n in names for k in ("this", "before")]).filter("calls_before > 0 and calls_this > 0")
    now, was = (lambda n: F.col(f"{n}_this")), (lambda n: F.col(f"{n}_before"))
    rise = lambda n: now(n) - was(n)
    average = F.floor(now("tokens_used") / now("calls"))
    candidates = [
        ("iteration_cost", rise("iteration_cost") > 0, (rise("iteration_cost") * now("checkpoints")).cast("long")),
        ("waste_rate", rise("waste_rate") > 0, (rise("waste_rate") * now("calls") * average).cast("long")),
        ("recovery_load", rise("recovery_load") > 0, F.lit(0).cast("long")),
        ("continuation_fidelity", rise("continuation_fidelity") < 0, F.lit(0).cast("long")),
    ]
    found = F.array_compact(F.array(*[F.when(worse, F.struct(price.alias("tokens"), F.lit(-i).alias("rank"), F.lit(name).alias("sub_metric"))) for i, (name, worse, price) in enumerate(candidates)]))
    out = both.select(F.size(found).alias("occurrences"), F.array_max(found).alias("best")).filter("occurrences > 0")
    return out.select(F.lit("les_regression").alias("pattern"), "best.sub_metric", "occurrences", "best.tokens")


# -- searches that are said again --------------------------------------------------------------------
def _running(rows: DataFrame, value: Column, name: str, order: list[str]) -> DataFrame:
    """rows (session_id, part, ...) with the running sum of a value in their session.

    Summed up within each part, plus what the parts before have, so that a session with most of the rows is many tasks.
    """
    inside = Window.partitionBy("session_id", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("session_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    valued = rows.withColumn("__v", value)
    parts = valued.groupBy("session_id", "part").agg(F.sum("__v").alias("__n")).select("session_id", "part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    summed = valued.withColumn(name, F.sum("__v").over(inside)).join(parts, ["session_id", "part"])
    return summed.withColumn(name, F.col(name) + F.col("__before")).drop("__v", "__before")


def churn_runs(searches: DataFrame, overlap: float = 0.3) -> DataFrame:
    """(session_id, first, last, searches, tokens) of runs of two searches or more that found nothing, each of which says the one before again.

    searches: (session_id, part, at, text, results, tokens_used); part is any coarser time, by which long sessions are
    dealt out.  A search says the one before again if of all words of the two a share of overlap or more are in both.
    Gaps and islands: a search that found something, or says something else, begins a new island.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    rows = searches.select("session_id", "part", "at", (F.col("results") == 0).alias("empty"), "tokens_used", words.alias("words"))
    placed = _running(rows, F.lit(1), "n", ["at"])
    before = placed.select("session_id", (F.col("n") + 1).alias("n"), F.col("words").alias("was"), F.col("empty").alias("was_empty"))
    both = placed.join(before, ["session_id", "n"], "left")
    union = F.size(F.array_union("words", "was"))
    again = F.coalesce(F.col("empty") & F.col("was_empty") & (union > 0) & (F.size(F.array_intersect("words", "was")) >= overlap * union), F.lit(False))
    islands = _running(both.select("session_id", "part", "at", "empty", "tokens_used", again.alias("again")), (~F.col("again")).cast("int"), "island", ["at"])
    runs = islands.filter("empty").groupBy("session_id", "island").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("searches"), F.sum("tokens_used").alias("tokens"))
    return runs.filter("searches > 1").drop("island")
