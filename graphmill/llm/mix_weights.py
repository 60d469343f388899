"""Mixing by iterative proportional fitting.

Documents are counted into cells of (source, language, topic).  The cells' expected tokens are raked: scaled to
the wanted share of each source, then of each language, then of each topic, again and again, and never beyond
the tokens that a cell has.  Expected over actual tokens are sampling probabilities; a document is kept where a hash
of its id falls below its cell's.  The sample is a fraction of all tokens, but no larger than the scarcest
margin can fill (FILL of what it has), so that all wanted shares can be met; margins() tells how nearly they are.

Wanted shares are given by name, or are the actual ones to a power.  Sweeps go on until no margin is further off than
TOLERANCE or none comes nearer, SWEEPS at least and MOST at the most.

Only DataFrame functions are used.  Documents meet in one aggregation with map-side sums, whatever the share
of a source; raking works on the cells: as arrays in one row while they are few, in one partition when they are more,
and by margin beyond that.  No other step needs them together.

Null source or language counts as `unknown`, null text as empty; a null doc_id is replaced by the text in
the draw.  Rows of one id in one cell, and equal rows, are kept or dropped together.  A cell without words weighs one
token.  A very long text is split into words in its row.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.llm.common import empty_if_null, lookup_join, materialize

DIMENSIONS = ("source", "lang", "topic")
#: Wanted share of a margin that no target names: its actual share to this power, made to sum to 1.  0 is uniform, 1 as it is.
TEMPERATURE = {"source": 0.5, "lang": 0.7, "topic": 0.7}
SWEEPS, STEP, MOST, TOLERANCE = 24, 8, 96, 1e-5
#: Wanted fraction of all tokens, and the part of the scarcest margin's tokens that may be asked for.
FRACTION, FILL = 0.5, 0.95
#: Cells that are raked in one partition, and those that are raked in one row: there all sweeps are one expression, while
#: otherwise each is three windows in the driver's plan.
ONE_TASK, ONE_ROW = 100_000, 2_000
_SPACE = r"[\x20\x09-\x0D]+"


def topic_of(text: Column) -> Column:
    """A coarse topic by what a text holds."""
    has = lambda s: F.contains(text, F.lit(s))
    return (
        F.when(has("icense"), "legal").when(has("@"), "contact").when(has("http"), "web").when(has(" | "), "table").when(has("***"), "noise").otherwise("prose")
    )


def tokens_of(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, _SPACE), "")).cast("long")


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    """Uniform in [0, 1), by 32 bits of a digest of the id."""
    digest = F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), text), F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def _wanted(cells: DataFrame, d: str, given: Mapping[str, float] | None, temperature: float) -> DataFrame:
    """(d, want, have): the wanted share of each value of a dimension, and its tokens.

    Named values get their shares (made to sum to 1 if they exceed it); the others share what is left, as their
    actual tokens to the power `temperature` do.
    """
    own = cells.groupBy(d).agg(F.sum(F.col("tokens").cast("double")).alias("have"))
    share = F.lit(None).cast("double")
    for value, x in (given or {}).items():
        share = F.when(F.col(d) == F.lit(value), F.lit(float(x))).otherwise(share)
    own = own.withColumn("named", share).withColumn("power", F.when(F.col("named").isNull(), F.pow("have", F.lit(float(temperature)))).otherwise(F.lit(0.0)))
    total = own.agg(F.coalesce(F.sum("named"), F.lit(0.0)).alias("__named"), F.sum("power").alias("__power"))
    left = F.when(F.col("__power") > 0, F.greatest(F.lit(1.0) - F.col("__named"), F.lit(0.0))).otherwise(F.lit(0.0))
    want = F.coalesce(F.col("named"), F.col("power") * left / F.col("__power")) / (F.when(F.col("__power") > 0, F.greatest(F.col("__named"), F.lit(1.0))).otherwise(F.col("__named")))
    return own.crossJoin(F.broadcast(total)).select(d, want.alias(f"want_{d}"), "have")


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, temperature: Mapping[str, float] = TEMPERATURE, fraction: float = FRACTION, sweeps: int = SWEEPS, most: int = MOST) -> DataFrame:
    """cells (source, lang, topic, tokens) with the wanted shares, weight, which sums to 1, and p, the probability of each of its documents."""
    there = cells.limit(ONE_TASK + 1).count()
    few = there <= ONE_TASK
    now, scarce, together = cells, [], lambda x: x.coalesce(1) if few else x
    for d in DIMENSIONS:
        wanted = materialize(_wanted(cells, d, (targets or {}).get(d), temperature[d]), "wanted")
        scarce.append(wanted.filter(f"want_{d} > 0").agg(F.min(F.col("have") / F.col(f"want_{d}")).alias("most")))
        now = lookup_join(now, wanted.drop("have"), [d], "inner")
    bound = scarce[0].unionByName(scarce[1]).unionByName(scarce[2]).agg(F.min("most").alias("__most"))
    total = cells.agg(F.sum(F.col("tokens").cast("double")).alias("__all"))
    budget = F.least(F.lit(fraction) * F.col("__all"), F.lit(FILL) * F.col("__most"))
    now = now.crossJoin(F.broadcast(bound)).crossJoin(F.broadcast(total)).withColumn("budget", budget)
    now = materialize(together(now.withColumn("expected", F.col("tokens") * F.col("budget") / F.col("__all")).drop("__most", "__all")), "rake")
    now = _in_one_row(now, sweeps, most) if there <= min(ONE_TASK, ONE_ROW) else _by_windows(now, together, sweeps, most)
    sums = now.agg(F.sum("expected").alias("__sum"))
    return now.crossJoin(F.broadcast(sums)).select(*DIMENSIONS, "tokens", *[f"want_{d}" for d in DIMENSIONS], (F.col("expected") / F.col("__sum")).alias("weight"), (F.col("expected") / F.col("tokens")).alias("p"))


def _by_windows(now: DataFrame, together: Callable[[DataFrame], DataFrame], sweeps: int, most: int) -> DataFrame:
    """Swept until done; a sweep is a window for each dimension."""
    done, worst = 0, math.inf
    while True:
        now = together(now)
        for _ in range(min(STEP, max(1, sweeps - done))):
            for d in DIMENSIONS:
                own = F.sum("expected").over(Window.partitionBy(d))
                scaled = F.when(own > 0, F.col("expected") * F.col(f"want_{d}") * F.col("budget") / own).otherwise(F.lit(0.0))
                now = now.withColumn("expected", F.least(F.col("tokens").cast("double"), scaled))
        now, done = materialize(now, "rake"), done + min(STEP, max(1, sweeps - done))
        if done >= sweeps:
            before, worst = worst, _worst(now)
            if done >= most or worst <= TOLERANCE or worst > 0.99 * before:
                break
    return now


def _held(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often it is named."""
    return F.get(F.transform(F.array(value), lambda x: then(x)), F.lit(0))


def _sums(e: Column, d: str) -> Column:
    """Sums of e by the values of a dimension."""
    return F.transform(f"of_{d}", lambda cells: F.aggregate(cells, F.lit(0.0), lambda total, i: total + F.get(e, i)))


def _scaled(e: Column, d: str) -> Column:
    def of_cell(x: Column, i: Column, sums: Column) -> Column:
        cell, own = F.get("cells", i), F.get(sums, F.get(f"at_{d}", i))
        scaled = F.when(own > 0, x * cell[f"want_{d}"] * cell["budget"] / own).otherwise(F.lit(0.0))
        return F.least(cell["tokens"].cast("double"), scaled)

    return _held(_sums(e, d), lambda sums: F.transform(e, lambda x, i: of_cell(x, i, sums)))


def _sweep(e: Column) -> Column:
    for d in DIMENSIONS:
        e = _held(e, functools.partial(_scaled, d=d))
    return e


def _missed(e: Column) -> Column:
    """_worst() of the cells in one row."""

    def of_margin(d: str) -> Column:
        first = lambda k: F.get("cells", F.get(F.get(f"of_{d}", k), F.lit(0)))
        return F.array_max(F.transform(_sums(e, d), lambda own, k: F.abs(own / first(k)["budget"] - first(k)[f"want_{d}"])))

    return F.greatest(*[of_margin(d) for d in DIMENSIONS])


def _in_one_row(now: DataFrame, sweeps: int, most: int) -> DataFrame:
    """What _by_windows() returns: the cells are arrays in a row, and all sweeps one expression that ends by the same rules."""

    def places(d: str) -> list[Column]:
        """The place of each cell's value among all values, and the cells of each value."""
        values = F.array_distinct(F.transform("cells", lambda c: c[d]))
        at = _held(values, lambda known: F.transform("cells", lambda c: (F.array_position(known, c[d]) - 1).cast("int")))
        every = F.sequence(F.lit(0), F.size("cells") - 1)
        return [at.alias(f"at_{d}"), F.transform(values, lambda v: F.filter(every, lambda i: F.get("cells", i)[d] == v)).alias(f"of_{d}")]

    def judged(e: Column, over: Callable[[Column], Column]) -> Column:
        return _held(_missed(e), lambda worst: F.struct(e.alias("e"), worst.alias("worst"), over(worst).alias("over")))

    def further(s: Column) -> Column:
        return _held(_sweep(s["e"]), lambda e: judged(e, lambda worst: (worst <= TOLERANCE) | (worst > 0.99 * s["worst"])))

    own, first = now.columns, max(1, sweeps)
    row = now.agg(F.sort_array(F.collect_list(F.struct(*own))).alias("cells")).filter(F.size("cells") > 0)
    row = materialize(row.select("cells", *[c for d in DIMENSIONS for c in places(d)]), "rake")
    swept = F.aggregate(F.sequence(F.lit(1), F.lit(first)), F.transform("cells", lambda c: c["expected"]), lambda e, _: _sweep(e))
    swept = _held(swept, lambda e: judged(e, lambda worst: worst <= TOLERANCE))
    if first < most:
        swept = F.aggregate(F.sequence(F.lit(first + 1), F.lit(most)), swept, lambda s, _: F.when(s["over"], s).otherwise(further(s)))
    done = materialize(row.select("cells", swept["e"].alias("e")), "rake")
    return done.select(F.explode(F.arrays_zip("cells", "e")).alias("x")).select(*[F.col("x.e" if c == "expected" else f"x.cells.{c}").alias(c) for c in own])


def _worst(now: DataFrame) -> float:
    """By how much of the budget the worst margin misses its share."""
    off = [now.groupBy(d).agg(F.abs(F.sum("expected") / F.first("budget") - F.first(f"want_{d}")).alias("off")).agg(F.max("off").alias("off")) for d in DIMENSIONS]
    return off[0].unionByName(off[1]).unionByName(off[2]).agg(F.max("off")).first()[0] or 0.0


def margins(raked: DataFrame) -> DataFrame:
    """(dimension, value, wanted, expected): shares of tokens by margin, as wanted and as the probabilities of rake() give them."""
    total = raked.agg(F.sum(F.col("p") * F.col("tokens")).alias("__all"))
    own = [
        raked.groupBy(F.lit(d).alias("dimension"), F.col(d).alias("value")).agg(F.first(f"want_{d}").alias("wanted"), F.sum(F.col("p") * F.col("tokens")).alias("expected"))
        for d in DIMENSIONS
    ]
    out = own[0].unionByName(own[1]).unionByName(own[2])
    return out.crossJoin(F.broadcast(total)).select("dimension", "value", "wanted", (F.col("expected") / F.col("__all")).alias("expected"))


def cells_of(docs: DataFrame, topic: str | None = None) -> DataFrame:
    """(source, lang, topic, tokens) of docs; topic names a column, else topic_of() tells it from the text."""
    rows = docs.withColumns(_cell(topic))
    by = [F.col(f"__{d}").alias(d) for d in DIMENSIONS]
    return rows.groupBy(*by).agg(F.greatest(F.sum("__tokens"), F.lit(1).cast("long")).alias("tokens"))


def _cell(topic: str | None) -> dict[str, Column]:
    text, known = empty_if_null(F.col("text").cast("string")), lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    return {"__source": known("source"), "__lang": known("lang"), "__topic": known(topic) if topic else topic_of(text), "__tokens": tokens_of(text)}


def mixed(docs: DataFrame, seed: int = 17, topic: str | None = None, **wanted) -> DataFrame:
    """docs with topic, n_tokens, weight, p and kept; columns of these names are replaced.  Needs doc_id, text, source, lang.

    wanted: targets, temperature, fraction, sweeps and most, as rake() takes them.
    """
    made = ["topic", "n_tokens", "weight", "p", "kept"]
    rows = docs.withColumns(_cell(topic)).drop(*made)
    own = [c for c in docs.columns if c not in made]
    weights = materialize(rake(materialize(cells_of(docs, topic), "cells"), **wanted), "weights")
    weights = weights.select(*[F.col(d).alias(f"__{d}") for d in DIMENSIONS], "weight", "p")
    out = lookup_join(rows, weights, [f"__{d}" for d in DIMENSIONS])
    kept = draw(F.col("doc_id"), empty_if_null(F.col("text").cast("string")), seed) < F.col("p")
    return out.withColumn("kept", kept).select(*[F.col(f"`{c}`") for c in own], F.col("__topic").alias("topic"), F.col("__tokens").alias("n_tokens"), "weight", "p", "kept")


def mixed_sql(seed: int = 17, sweeps: int = SWEEPS, fraction: float = FRACTION, temperature: Mapping[str, float] = TEMPERATURE) -> str:
    """The query op6 in SQL: the sweeps one after the other."""
    steps = [
        r"""docs AS (SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang,
  CASE WHEN contains(t, 'icense') THEN 'legal' WHEN contains(t, '@') THEN 'contact' WHEN contains(t, 'http') THEN 'web' WHEN contains(t, ' | ') THEN 'table' WHEN contains(t, '***') THEN 'noise' ELSE 'prose' END AS topic,
  len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens, t FROM (SELECT *, coalesce(text, '') AS t FROM documents))""",
        "cells AS MATERIALIZED (SELECT source, lang, topic, greatest(sum(n_tokens), 1)::BIGINT AS tokens FROM docs GROUP BY ALL)",
    ]
    for d in DIMENSIONS:
        steps.append(f"want_{d} AS MATERIALIZED (SELECT {d}, have, w / sum(w) OVER () AS w FROM (SELECT {d}, sum(tokens::DOUBLE) AS have, pow(sum(tokens::DOUBLE), {temperature[d]}) AS w FROM cells GROUP BY {d}))")
    scarce = " UNION ALL ".join(f"SELECT min(have / w) AS most FROM want_{d}" for d in DIMENSIONS)
    steps.append(f"size AS MATERIALIZED (SELECT a, least({fraction}::DOUBLE * a, {FILL}::DOUBLE * (SELECT min(most) FROM ({scarce}))) AS budget FROM (SELECT sum(tokens::DOUBLE) AS a FROM cells))")
    joins = " ".join(f"JOIN want_{d} USING ({d})" for d in DIMENSIONS)
    wants = ", ".join(f"want_{d}.w AS want_{d}" for d in DIMENSIONS)
    steps.append(f"r0 AS MATERIALIZED (SELECT source, lang, topic, tokens, budget, tokens * budget / a AS expected, {wants} FROM cells {joins}, size)")
    n = 0
    for _ in range(sweeps):
        for d in DIMENSIONS:
            steps.append(f"r{n + 1} AS MATERIALIZED (SELECT * REPLACE (least(tokens::DOUBLE, expected * want_{d} * budget / sum(expected) OVER (PARTITION BY {d})) AS expected) FROM r{n})")
            n += 1
    steps.append(f"s AS MATERIALIZED (SELECT source, lang, topic, expected / sum(expected) OVER () AS weight, expected / tokens AS p FROM r{n})")
    final = f"""SELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens, round(s.weight, 9) AS weight, round(s.p, 6) AS p,
  ('0x' || substr(md5(concat_ws(':', coalesce(d.doc_id::VARCHAR, d.t), '{seed}')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < s.p AS kept
FROM docs d JOIN s USING (source, lang, topic)"""
    return "WITH " + ",\n".join(steps) + "\n" + final
