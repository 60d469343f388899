"""URL filter: rules by host and path first, then path templates judged by the labels of the URLs they cover.

Path segments with digits become shapes; then, level by level from the root of each host, a branching with
too many children for its distinct paths becomes a wildcard.  Sibling branches whose share of blocked labels does not
differ from their pool's by more than chance are merged.  A template is rejected where its blocked share,
smoothed towards the share of the same template on all hosts and that towards the overall one, reaches a
threshold.  The labels are the verdicts of the rules, or any boolean column that the caller names.

Only DataFrame functions are used.  Everything after the first aggregation works on one row for each host
and shape, and the verdicts reach the URLs by a join that a host with a third of all URLs does not skew.

A null URL, or one without `://`, has an empty host and path, and is judged like any other such.  Repeated
rows get equal verdicts, and ids play no part; a very long URL is a deep path, for which the tree has as many levels.
Ties of a share with its threshold count as reaching it.  An empty table gives an empty one.  Rows keep their other
columns, whatever their names, but for those of the result's names, which are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import lookup_join, lower_ascii, materialize

#: A branching becomes a wildcard from so many children on, if they are at least this share of its distinct paths.
CHILDREN, VARIETY = 20, 0.2
#: Branches within so many standard errors of their pool are merged.
ERRORS = 2.0
#: Weight of the prior, and the smoothed share of blocked labels from which a template is rejected.
PRIOR, REJECT = 10.0, 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case, and path, of a URL; empty where it has no `://`."""
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))
    return lower_ascii(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule (verdict, host/path) that fits, and its verdict; null if none does.  Of equally long ones, the first given."""
    which, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # Later conditions win, so rules come by length, and equally long ones from the last given to the first.
    for said, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        at = rule.index("/")
        own, prefix = rule[:at], rule[at:]
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(prefix)
        which, verdict = F.when(fits, F.lit(rule)).otherwise(which), F.when(fits, F.lit(said)).otherwise(verdict)
    return which, verdict


def shape(path: Column) -> Column:
    """Segments of a path, runs of digits and long hexadecimal names replaced."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(segments, lambda s: F.regexp_replace(F.regexp_replace(s, "[0-9a-fA-F]{8}[0-9a-fA-F-]*", "{h}"), "[0-9]+", "{n}"))


def _put(path: Column, at: int, value: Column) -> Column:
    return F.transform(path, lambda s, i: F.when(i == at, value).otherwise(s))


def templates(shapes: DataFrame) -> DataFrame:
    """shapes (host, shape, n, labelled, blocked; n: distinct paths) with the template of each and how much of it is blocked, smoothed."""
    deepest = shapes.agg(F.max(F.size("shape"))).first()[0] or 0
    tree = shapes.withColumn("template", F.col("shape"))
    for d in range(deepest):
        parent = F.slice("template", 1, d) if d else F.array().cast("array<string>")
        here = tree.withColumn("__parent", parent).withColumn("__child", F.get("template", F.lit(d)))
        children = here.filter("__child is not null").groupBy("host", "__parent", "__child").agg(F.sum("n").alias("n"))
        wide = (
            children.groupBy("host", "__parent").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"))
            .filter((F.col("c") >= CHILDREN) & (F.col("c") >= VARIETY * F.col("n"))).select("host", "__parent", F.lit(True).alias("__wide"))
        )
        tree = here.join(wide, ["host", "__parent"], "left").withColumn("template", F.when(F.col("__wide"), _put(F.col("template"), d, F.lit("*"))).otherwise(F.col("template")))
        tree = materialize(tree.select("host", "shape", "template", "n", "labelled", "blocked"), "tree")
    for d in reversed(range(deepest)):
        branch = tree.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")])
        branch = branch.withColumn("__pool", F.when(F.size("template") > d, _put(F.col("template"), d, F.lit("*"))).otherwise(F.col("template")))
        pools = branch.groupBy("host", "__pool").agg(F.count(F.lit(1)).alias("members"), F.sum("labelled").alias("pl"), F.sum("blocked").alias("pb"))
        share, pooled = F.col("blocked") / F.col("labelled"), F.col("pb") / F.col("pl")
        error = F.sqrt(pooled * (1 - pooled) / F.col("labelled"))
        alike = (F.col("members") > 1) & F.coalesce(F.abs(share - pooled) <= ERRORS * error, F.lit(True))
        moved = branch.filter("labelled > 0 or n > 0").join(pools, ["host", "__pool"]).select("host", "template", F.when(F.try_divide(F.lit(1), "labelled").isNull(), F.col("members") > 1).otherwise(alike).alias("alike"), "__pool")
        tree = tree.join(moved, ["host", "template"], "left").withColumn("template", F.when(F.col("alike"), F.col("__pool")).otherwise(F.col("template")))
        tree = materialize(tree.select("host", "shape", "template", "n", "labelled", "blocked"), "tree")
    own = tree.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    anywhere = own.groupBy("template").agg(F.sum("l").alias("tl"), F.sum("b").alias("tb"))
    overall = own.agg(F.coalesce(F.sum("l"), F.lit(0)).alias("al"), F.coalesce(F.sum("b"), F.lit(0)).alias("ab"))
    base = F.when(F.col("al") > 0, F.col("ab") / F.greatest("al", F.lit(1))).otherwise(F.lit(0.0))
    across = (F.col("tb") + PRIOR * base) / (F.col("tl") + PRIOR)
    judged = own.join(anywhere, "template").crossJoin(F.broadcast(overall)).select("host", "template", ((F.col("b") + PRIOR * across) / (F.col("l") + PRIOR)).alias("purity"))
    return tree.join(judged, ["host", "template"]).select("host", "shape", "template", "purity")


def filtered(pages: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url", label: str | None = None) -> DataFrame:
    """pages with host, path, rule, template, purity and verdict (allow or block).

    label names a boolean column, true for URLs known to be bad and null for unknown ones; the rules' verdicts
    count as labels where it is null or not given.
    """
    host, path = host_and_path(F.col(url).cast("string"))
    made = ["host", "path", "rule", "template", "purity", "verdict"]
    kept = [c for c in pages.columns if c not in made or c in (url, label)]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(0).alias("none"))
    rows = pages.select(row.alias("row"), host.alias("host"), path.alias("path"))
    which, said = rule_of(F.col("host"), F.col("path"), rules)
    known = F.coalesce(F.col(f"row.`{label}`"), said == "block") if label else said == "block"
    rows = rows.select("*", which.alias("rule"), said.alias("said"), known.alias("bad"), shape(F.col("path")).alias("shape"))
    paths = rows.groupBy("host", "shape", "path").agg(F.count("bad").alias("labelled"), F.sum(F.coalesce(F.col("bad").cast("long"), F.lit(0))).alias("blocked"))
    shapes = materialize(paths.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")), "shapes")
    judged = materialize(templates(shapes), "templates")
    out = lookup_join(rows, judged, ["host", "shape"])
    by_template = F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow"))
    own = [F.col(f"row.`{c}`") for c in kept if c not in made]
    return out.select(*own, "host", "path", "rule", F.concat(F.lit("/"), F.concat_ws("/", "template")).alias("template"), "purity", F.coalesce("said", by_template).alias("verdict"))
