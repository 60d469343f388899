"""Walks by lists: one row for each start and block of ends, with the ends that a level reaches.

The first level is the edges themselves, distinct.  A later one joins its frontier with the list of ends of each node and
puts a start's lists together, without those that earlier levels have: a list moves whole, two bytes for an end, and
pairs are spread only where they are read, by a broadcast of the ends that can be met again.  Long levels are made in slices of
starts; a last level of one slice is not written.  A walk takes a list for each start and node, where bits would share one among 64 starts, so this is for graphs whose
walks are counted to be few for each edge.  Blocks of ends are those of graphmill.operators.paths.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.plans.cut import cut

#: Fewer steps than these are walked by bits; lists serve up to so many walks for each step.
LEAST_STEPS, WALKS = 1_000_000, 64
#: Walks that a slice of a level puts together, about: shuffles of one slice are freed before those of the next.
SLICE = 400_000_000
#: Bytes of ids of ends that can be met again, up to which lists serve.
BROADCAST_BYTES = 32 << 20
BLOCK = 1 << 15


def lists_of(steps: DataFrame, starts: DataFrame | None, most: int, kind: Column) -> Lists | None:
    """Walks of at most `most` of steps (__from, __to), from starts (start) or all nodes; None where bits serve better.

    That is where steps are few, walks many for each step, or the ends that can be met again too many to broadcast.
    """
    n = steps.count()  # written tables count by their footers
    if n < LEAST_STEPS:
        return None
    ends = cut(steps.groupBy(F.col("__to").alias("__end")).agg(F.count(F.lit(1)).alias("w")))
    # Distinct steps, with how many lead to where they begin.  Both the join and the grouping are by their beginning.
    known = steps.join(ends, F.col("__from") == F.col("__end"), "left")
    pairs = cut(known.groupBy(F.col("__from").alias("start"), F.col("__to").alias("node")).agg(F.min(kind).alias("k"), F.max("w").alias("w")).filter("start is not null"))
    inner = pairs.filter("w is not null")
    leads = inner.select("start").distinct().withColumn("on", F.lit(1))
    again = cut(inner.select("node").distinct().join(leads, F.col("node") == F.col("start"), "left").select("node", F.coalesce("on", F.lit(0)).alias("on")))
    held, on = again.agg(F.coalesce(F.sum(F.length("node") + 64), F.lit(0)), F.coalesce(F.sum("on"), F.lit(0))).first()
    deepest = most if on else min(most, 2)  # where no end that is met again leads on, no walk takes three steps
    if held > BROADCAST_BYTES or (walks := _walks(inner, deepest)) > WALKS * n:
        return None
    ranked = again.orderBy("on", "node").withColumn("__n", F.monotonically_increasing_id())
    again = cut(ranked.select("node", F.expr(f"(__n div {BLOCK}) * 2 + on").alias("block"), F.expr(f"cast(__n % {BLOCK} AS smallint)").alias("off")))
    return Lists(pairs, starts, deepest, again, inner, on > 0, 1 + int(walks // SLICE))


def _walks(inner: DataFrame, most: int) -> int:
    """How many walks take two steps to that many, each way of walking counted."""
    if most < 2:
        return 0
    total = inner.agg(F.sum("w")).first()[0] or 0
    ways = inner.groupBy("start").agg(F.max(F.col("w").cast("double")).alias("w"))
    for _ in range(3, most + 1):
        ways = cut(inner.drop("w").join(ways, "start").groupBy(F.col("node").alias("start")).agg(F.sum("w").alias("w")))
        total += inner.drop("w").join(ways, "start").agg(F.sum("w")).first()[0] or 0
    return total


class Lists:
    """The levels of walks over distinct steps (start, node, k), by the ends (node, block, off) that can be met again."""

    def __init__(self, pairs: DataFrame, starts: DataFrame | None, most: int, again: DataFrame, inner: DataFrame, on: bool, slices: int = 1) -> None:
        self.slices = slices
        self.again = F.broadcast(again.select("node", (F.col("block") * BLOCK + F.col("off")).alias("code")))
        mine = pairs.filter("start <> node")
        self.first = mine if starts is None else cut(mine.join(starts.select("start").distinct(), "start", "left_semi"))
        #: Of later levels their depth and (start, block, offs0..), offs of each kind.
        self.later: list[tuple[int, DataFrame]] = []
        self.kinds: list[int] = []
        #: The depth of a level that is not written.
        self.open = 0
        if most > 1:
            self._walk(inner, most, F.broadcast(again), on)

    def _walk(self, inner: DataFrame, most: int, marked: DataFrame, on: bool) -> None:
        lists = cut(inner.join(marked, "node").groupBy(F.col("start").alias("node"), "block", "k").agg(F.collect_list("off").alias("offs")))
        self.kinds = sorted(r[0] for r in lists.select("k").distinct().collect())  # no more than kinds are asked for
        names = [f"offs{k}" for k in self.kinds]
        # From an end, only ends that are met again and lead on can be walked from: without them ends have no second level.
        met_again = (self.first if on else self.first.filter("w is null")).join(marked, "node", "left")
        leads = F.col("block").bitwiseAND(1) != 0
        front = met_again.filter(F.col("block").isNull() | leads).select("start", "node")
        seen = met_again.filter(F.col("block").isNotNull()).select("start", "block", F.lit(-1).alias("k"), F.array("off").alias("offs"))
        for depth in range(2, most + 1):
            each = [self._level(front.filter(x).join(lists, "node").select("start", "block", "k", "offs").unionByName(seen.filter(x)), names) for x in self._slices()]
            if depth == most:
                self.later, self.open = self.later + [(depth, x) for x in each], depth
                break
            level = reduce(DataFrame.unionByName, [cut(x.filter(reduce(Column.__or__, [F.size(n) > 0 for n in names]))) for x in each])
            if level.isEmpty():
                break
            self.later.append((depth, level))
            seen = seen.unionByName(level.select("start", "block", F.lit(-1).alias("k"), F.concat(*names).alias("offs")))
            front = self._pairs(level.filter(leads)).join(self.again, "code").select("start", "node")

    def _slices(self) -> list[Column]:
        return [F.lit(True)] if self.slices == 1 else [F.pmod(F.hash("start"), F.lit(self.slices)) == i for i in range(self.slices)]

    def _level(self, met: DataFrame, names: list[str]) -> DataFrame:
        """(start, block, offs0..) that are new, of lists that are met (start, block, k, offs); k is -1 for what earlier levels have."""
        of = lambda k: F.flatten(F.collect_list(F.when(F.col("k") == k, F.col("offs"))))
        level = met.repartition("start", "block").groupBy("start", "block").agg(of(-1).alias("done"), *[of(k).alias(n) for k, n in zip(self.kinds, names, strict=True)])
        fresh = [F.array_except(n, reduce(lambda a, b: F.concat(a, b), [F.col(m) for m in names[:i]], F.col("done"))).alias(n) for i, n in enumerate(names)]
        return level.select("start", "block", *fresh)

    def _written(self, df: DataFrame) -> DataFrame:
        """A slice's result is written, so that its shuffles are freed; a whole level's is read as it comes."""
        return df if self.slices == 1 else cut(df)

    def _pairs(self, level: DataFrame) -> DataFrame:
        """(start, code, k) of a later level; a start is never its own end."""
        own = self.again.select(F.col("node").alias("__own"), F.col("code").alias("own"))
        names = [c for c in level.columns if c.startswith("offs")]
        each, low = level.join(own, F.col("start") == F.col("__own"), "left"), (F.col("block") * BLOCK).alias("low")
        if len(names) == 1:
            each = each.select("start", "own", F.lit(self.kinds[0]).alias("k"), low, F.explode(names[0]).alias("off"))
        else:
            each = each.select("start", "own", low, F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(n).alias("offs")) for k, n in zip(self.kinds, names, strict=True)])).alias("e"))
            each = each.select("start", "own", "e.k", "low", F.explode("e.offs").alias("off"))
        each = each.select("start", "own", "k", (F.col("low") + F.col("off")).alias("code"))
        return each.filter(F.col("own").isNull() | (F.col("own") != F.col("code"))).select("start", "code", "k")

    def rows(self) -> DataFrame:
        """(start, node, depth, k): nodes by the shortest walk, and the first kind of the last steps of such walks."""
        parts = [self.first.select("start", "node", F.lit(1).alias("depth"), "k")]
        parts += [self._pairs(self._written(x) if d == self.open else x).join(self.again, "code").select("start", "node", F.lit(d).alias("depth"), "k") for d, x in self.later]
        return reduce(DataFrame.unionByName, parts)

    def counts(self) -> DataFrame:
        """(node, n): how many starts reach a node."""
        n = F.count(F.lit(1)).alias("n")
        parts = [self.first.groupBy("node").agg(n)]
        parts += [self._written(self._pairs(x).groupBy("code").agg(n)).join(self.again, "code").select("node", "n") for _, x in self.later]
        return reduce(DataFrame.unionByName, parts).groupBy("node").agg(F.sum("n").alias("n"))
