"""Small tools around queries: batches with chained inputs, notes on empty results, task and seed quality, the loop ledger."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_QUERIES, BUDGET = 12, 4000


@dataclass
class Step:
    """One query of a batch; takes: (number of an earlier step, top_id, ids or files), joined with `on`."""

    run: Callable[[], DataFrame]
    takes: tuple[int, str] | None = None
    on: str = "id"


def batch(steps: list[Step]) -> list[DataFrame]:
    """Results of up to twelve queries; a step that takes an earlier one keeps the rows that it names, by a semi join."""
    if len(steps) > MOST_QUERIES:
        raise ValueError(f"a batch has {MOST_QUERIES} queries at most")
    out: list[DataFrame] = []
    for i, s in enumerate(steps):
        df = s.run()
        if s.takes is not None:
            n, what = s.takes
            if not 0 <= n < i or what not in ("top_id", "ids", "files"):
                raise ValueError("a step takes top_id, ids or files of an earlier one")
            column = "file_path" if what == "files" else "id"
            given = out[n].select(F.col(column).alias(s.on))
            df = df.join(given.limit(1) if what == "top_id" else given.distinct(), s.on, "left_semi")
        out.append(df)
    return out


def within_budget(df: DataFrame, order: list, text: str, budget: int = BUDGET) -> DataFrame:
    """The first rows whose texts take no more tokens than a budget, of a result that is small already."""
    from pyspark.sql import Window

    from graphmill.functions.scalars import approx_tokens

    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("__t", F.sum(approx_tokens(F.col(text))).over(w)).filter(F.col("__t") <= budget).drop("__t")


WHY_EMPTY = {
    "no_such_kind": "no node has this kind: look at the kinds that graph_stats lists",
    "no_such_name": "no node has this name: search for a prefix of it",
    "filtered_by_confidence": "all matches are below the least confidence: lower it",
    "filtered_by_kind": "the name exists with another kind: drop the kind",
    "filtered_tests": "all matches are tests or fixtures: include them",
    "no_edges": "the node has no edges of these kinds: try others, or the other direction",
    "other_corpus": "the words occur in another corpus: name it",
    "stale_id": "the id has moved: resolve it first",
    "empty_project": "the project has no nodes: index it",
}


def why_empty(symbols: DataFrame, name: str, kind: str | None = None, least: float = 0.0) -> str:
    """A reason for an empty search by name: a key of WHY_EMPTY."""
    row = symbols.filter(F.col("name") == name).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == kind).alias("k"), F.count_if((F.lit(kind is None) | (F.col("kind") == kind)) & (F.col("extraction_confidence") >= least)).alias("c")
    ).first()
    if not row.n:
        return "empty_project" if symbols.isEmpty() else "no_such_name"
    if kind is not None and not row.k:
        return "filtered_by_kind"
    return "filtered_by_confidence" if not row.c else "filtered_tests"


def identifier_tokens(task: str) -> tuple[list[str], list[str]]:
    """Words of a task that have the shape of identifiers, and the others of some length."""
    ws = list(dict.fromkeys(re.findall(r"[A-Za-z_][\w.]*\w", task)))
    shaped = [w for w in ws if "_" in w or "." in w or re.search("[a-z][A-Z]", w)]
    return shaped, [w for w in ws if w not in shaped and len(w) > 3]


def seed_quality(task: str, names: list[str]) -> str:
    """strong if a seed has a name that the task spells, fair if part of one, else weak."""
    strong, weak = identifier_tokens(task)
    lower = {n.lower() for n in names}
    if any(w.lower().rsplit(".", 1)[-1] in lower for w in strong):
        return "strong"
    return "fair" if any(w.lower() in n for w in weak + strong for n in lower) else "weak"


def resume(ledger: DataFrame, loop: str) -> DataFrame:
    """The last checkpoint of a loop."""
    return ledger.filter(F.col("loop_name") == loop).orderBy(F.desc("seq")).limit(1)


def handoff(ledger: DataFrame, loop: str, last: int = 5) -> DataFrame:
    """One row: a manifest of a loop's last decisions, oldest first."""
    rows = ledger.filter(F.col("loop_name") == loop).orderBy(F.desc("seq")).limit(last)
    lines = F.transform(F.sort_array(F.collect_list(F.struct("seq", "decision"))), lambda x: F.concat(F.lit("- "), x["decision"]))
    return rows.agg(F.concat(F.lit("HANDOFF\n"), F.array_join(lines, "\n")).alias("claim"))


def skeleton_of_children(children: DataFrame) -> DataFrame:
    """Signatures of the children of each parent, in order, as one text."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("start_byte", F.coalesce("signature", "name").alias("s")))), lambda x: x["s"])
    return children.groupBy("project_id", "parent").agg(F.array_join(lines, "\n").alias("outline"))
