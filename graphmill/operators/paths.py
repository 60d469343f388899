"""Walks over edges by joins of a frontier, one level after the other, from many starts at once.

Starts are numbered in the order of their ids, 64 to a chunk, and the starts that reach a node are, for one chunk, the bits
of one number.  Ends are numbered too, in blocks of 2^15.  A level joins its frontier with the lists of ends of each
node, deals the lists out by chunk and block as they are, and takes them apart only there, for a bit_or by end: what is
shuffled is two bytes for an end of a list, not a row.  A level is written as one row of ends with bits for each chunk
and block, together with the ids of the chunk's starts, so that results are spread into one row per start without
another shuffle.  Long levels are made in slices of chunks, and every table that is written frees its shuffles.

A block's number says by its last two bits whether its nodes have edges that lead on (only they are walked from), and
whether nodes that are ends themselves lead to them (only they can be met again).

Bits win where neighbouring starts share what they reach.  Where walks are counted to be few for each edge, and the ends
that can be met again fit a broadcast, levels are lists instead: see graphmill.operators.lists.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.operators import lists as L
from graphmill.plans.cut import cut, drop, read_of, steps_of

#: Starts of a chunk: the bits of a long.  Ends of a block: what a short counts.
CHUNK, BLOCK = 64, 1 << 15
#: Ends that a slice of a level meets, about, and steps that one of the first level takes; bytes of ids of ends up to which they are broadcast.
SLICE, SLICE_STEPS, BROADCAST_BYTES = 100_000_000, 10_000_000, 32 << 20


def numbered(starts: DataFrame) -> DataFrame:
    """(start, chunk, bit) of distinct starts (start) that are not null, neighbours by id in one chunk; a written table."""
    ranked = starts.select("start").filter(F.col("start").isNotNull()).distinct().orderBy("start").withColumn("__n", F.monotonically_increasing_id())
    return cut(ranked.select("start", F.expr(f"__n div {CHUNK}").alias("chunk"), F.expr(f"shiftleft(1L, int(__n % {CHUNK}))").alias("bit")))


def _less(bits: Column, taken: list[Column]) -> Column:
    return reduce(lambda b, t: b.bitwiseAND(F.bitwise_not(t)), taken, bits)


def _any(bits: list[Column]) -> Column:
    return reduce(Column.bitwiseOR, bits)


def _end_table(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, block, off) of all ends, and the steps that begin at an end, (__from, __to[, via])."""
    ends = steps.select(F.col("__to").alias("node")).distinct()
    inner = cut(steps.join(ends, F.col("__from") == F.col("node"), "left_semi"))
    goes = inner.select(F.col("__from").alias("node"), F.lit(2).alias("c"))
    again = inner.select(F.col("__to").alias("node"), F.lit(1).alias("c"))
    marks = goes.unionByName(again).groupBy("node").agg(F.bit_or("c").alias("c"))
    classed = ends.join(marks, "node", "left").select("node", F.coalesce("c", F.lit(0)).alias("c"))
    ranked = cut(classed).orderBy("c", "node").withColumn("__n", F.monotonically_increasing_id())
    table = ranked.select("node", F.expr(f"(__n div {BLOCK}) * 4 + c").alias("block"), F.expr(f"cast(__n % {BLOCK} AS smallint)").alias("off"))
    return cut(table), inner


def _ranges(starts: DataFrame, n: int) -> list[tuple[str, str]]:
    """Ranges of the ids of starts, which n steps are shared out to, SLICE_STEPS to each or less; no more than the files of starts."""
    by_file = starts.groupBy(F.expr(f"chunk div {(1 << 33) // CHUNK}").alias("file")).agg(F.min("start"), F.max("start"), F.count(F.lit(1))).orderBy("file").collect()
    each, out, held = SLICE_STEPS * sum(r[3] for r in by_file) / max(1, n), [], 0
    for _, low, high, k in by_file:
        if out and held + k <= each:
            out[-1], held = (out[-1][0], high), held + k
        else:
            out.append((low, high))
            held = k
    return out


def _is(mark: int) -> Column:
    return F.col("block").bitwiseAND(mark) != 0


def kind_index(kinds: tuple[str, ...]) -> Column:
    """The place of via among kinds, sorted; 0 without kinds."""
    return F.coalesce(*[F.when(F.col("via") == k, i) for i, k in enumerate(sorted(set(kinds)))]) if kinds else F.lit(0)


def levels(steps: DataFrame, starts: DataFrame, least: int, most: int, kinds: tuple[str, ...] = ()) -> DataFrame | None:
    """(node, chunk, names, depth, new0..): bits of the starts whose shortest walk of least..most edges to node has depth edges; None if there are none.

    steps: (__from, __to, and via if kinds are given); starts as numbered() gives them.  With kinds there is one column
    of bits for each, in their sorted order: a start counts for the first kind that the last edge of such a walk has.
    names are the ids of the chunk's starts, by bit.
    """
    parts = sorted(set(kinds)) or [None]
    news = [f"new{i}" for i in range(len(parts))]
    kind = kind_index(kinds)
    ends, inner = _end_table(steps)
    names = starts.groupBy(F.col("chunk").alias("__chunk")).agg(F.sort_array(F.collect_list("start")).alias("names"))
    near, far = (ends.select(F.col("node").alias(f"__{x}node"), F.col("block").alias(f"{x}block"), F.col("off").alias(f"{x}off")) for x in "nf")
    lists, few = None, None

    def written(met: DataFrame, done: DataFrame | None, depth: int) -> DataFrame:
        """met (chunk, block, k, bits, offs, node) and what is done (chunk, block, off, bits), as rows of ends."""
        if done is not None:
            met = met.unionByName(done.select("chunk", "block", F.lit(-1).alias("k"), "bits", F.array("off").alias("offs"), F.lit(None).cast("string").alias("node")))
        each = met.repartition("chunk", "block").select("chunk", "block", "k", "bits", "node", F.explode("offs").alias("off"))
        of = lambda i: F.bit_or(F.when(F.col("k") == i, F.col("bits")).otherwise(F.lit(0).cast("long")))
        name = [F.max("node").alias("node")] if depth == 1 else []
        level = each.groupBy("chunk", "block", "off").agg(*[of(i).alias(n) for i, n in enumerate(news)], of(-1).alias("done"), *name)
        walked = _any([F.col(n) for n in news])
        level = level.select("chunk", "block", "off", walked.alias("bits"), *[_less(F.col(n), [F.col(m) for m in (*news[:i], "done")]).alias(n) for i, n in enumerate(news)], *(["node"] if name else []))
        level = level.filter((_any([F.col(n) for n in news]) if least == 1 else F.col("bits")) != 0)
        if not name and few is None:
            level = level.join(ends, ["block", "off"])
        held = ["off", *news, *(["bits"] if least > 1 else []), *(["node"] if name or few is None else [])]
        packed = level.groupBy("chunk", "block").agg(F.sort_array(F.collect_list(F.struct(*held))).alias("ends"))
        return packed.join(names, F.col("chunk") == F.col("__chunk")).drop("__chunk")

    own = starts.join(near, F.col("start") == F.col("__nnode"))
    done = own.select("chunk", F.col("nblock").alias("block"), F.col("noff").alias("off"), F.col("bit").alias("bits"))
    found = None
    for depth in range(1, most + 1):
        level = None
        if depth == 1:
            for low, high in _ranges(starts, steps.count()):
                mine = starts.filter(F.col("start").between(low, high))
                met = steps.filter(F.col("__from").between(low, high)).join(mine, F.col("__from") == F.col("start")).join(far, F.col("__to") == F.col("__fnode"))
                met = met.select("chunk", F.col("fblock").alias("block"), kind.alias("k"), F.col("bit").alias("bits"), F.array("foff").alias("offs"), F.col("__to").alias("node"))
                mine = mine.join(near, F.col("start") == F.col("__nnode")).select("chunk", F.col("nblock").alias("block"), F.col("noff").alias("off"), F.col("bit").alias("bits"))
                part = cut(written(met, mine, 1))
                level = part if level is None else level.unionByName(part)
            if level is None:
                break
        else:
            rows, listed = front.count(), lists.agg(F.count(F.lit(1)), F.sum(F.size("offs"))).first()
            if not rows or not listed[0]:
                break
            slices = 1 + int(rows * listed[1] / listed[0] / SLICE)
            for i in range(slices):
                mine = (F.col("chunk") % slices == i) if slices > 1 else F.lit(True)
                met = front.filter(mine).join(lists, ["nblock", "noff"]).select("chunk", F.col("fblock").alias("block"), "k", "bits", "offs", F.lit(None).cast("string").alias("node"))
                part = cut(written(met, done.filter(mine & _is(1)), depth))
                level = part if level is None else level.unionByName(part)
        if level.isEmpty():
            break
        each = level.select("chunk", "block", "names", F.explode("ends").alias("e")).select("chunk", "block", "names", "e.*")
        fresh = _any([F.col(n) for n in news])
        if depth >= least:
            got = each.filter(fresh != 0)
            done = done.unionByName(got.select("chunk", "block", "off", fresh.alias("bits")))
            if depth > 1 and few is not None:
                got = got.join(F.broadcast(few), ["block", "off"])
            got = got.select("node", "chunk", "names", F.lit(depth).alias("depth"), *news)
            found = got if found is None else found.unionByName(got)
        if depth == most:
            break
        if lists is None:
            pairs = inner.join(near, F.col("__from") == F.col("__nnode")).join(far, F.col("__to") == F.col("__fnode"))
            lists = cut(pairs.groupBy("nblock", "noff", "fblock", kind.alias("k")).agg(F.collect_set("foff").alias("offs")))
            met_again = ends.filter(_is(1))
            if (met_again.agg(F.sum(F.length("node") + 64)).first()[0] or 0) <= BROADCAST_BYTES:
                few = met_again
        front = each.filter(_is(2)).select("chunk", F.col("block").alias("nblock"), F.col("off").alias("noff"), (fresh if least == 1 else F.col("bits")).alias("bits"))
    return found


def spread(found: DataFrame, starts: DataFrame, *bits: str) -> DataFrame:
    """One row for each start whose bit is in any of the columns of bits, with the columns of found and its start and bit."""
    each = found.select(*[c for c in found.columns if c != "names"], F.posexplode("names").alias("__p", "start"))
    held = F.call_function("shiftright", _any([F.col(b) for b in bits]), F.col("__p")).bitwiseAND(F.lit(1).cast("long")) != 0
    return each.filter(held).withColumn("bit", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__p"))).drop("__p")


def _walks(edges: DataFrame, starts: DataFrame, least: int, most: int) -> tuple[DataFrame, L.Lists | None]:
    """The steps, and their walks as lists where those serve; steps that were written for them are then removed."""
    plain = edges.select(F.col("from_id").alias("__from"), F.col("to_id").alias("__to")).filter(F.col("__to").isNotNull())
    steps = read_of(plain)
    lists = L.lists_of(steps, starts, most, F.lit(0)) if least == 1 else None
    if lists is not None and steps is not plain:
        drop(steps)
    return steps, lists


def reach_counts(edges: DataFrame, starts: DataFrame, least: int, most: int) -> DataFrame:
    """(node, n): how many distinct starts reach a node, as reached() has it, counted by bits or in lists and never spread."""
    steps, lists = _walks(edges, starts, least, most)
    if lists is not None:
        return lists.counts()
    found = levels(steps, numbered(starts), least, most)
    if found is None:
        return starts.sparkSession.createDataFrame([], "node string, n long")
    return found.groupBy("node").agg(F.sum(F.bit_count("new0")).cast("long").alias("n"))


def reached(edges: DataFrame, starts: DataFrame, least: int, most: int) -> DataFrame:
    """(start, node, depth): nodes some walk of least..most edges reaches from a start, by the shortest such walk.

    edges: (from_id, to_id); starts: (start).  A start is never its own result.  With least = 1 nodes that have been
    reached are not walked from again; else every level is walked in full, as a longer walk may be the first
    that is long enough.  Null starts and ends reach nothing, repeated rows change nothing.
    """
    steps, lists = _walks(edges, starts, least, most)
    if lists is not None:
        return lists.rows().select("start", "node", "depth")
    known = numbered(starts)
    found = levels(steps, known, least, most)
    if found is None:
        return starts.sparkSession.createDataFrame([], "start string, node string, depth int")
    return spread(found, known, "new0").select("start", "node", "depth")


def reached_by_any(edges: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """(node, depth): nodes that some walk of at most `most` edges reaches from any of the starts (id), by least depth; starts are left out."""
    steps = steps_of(edges.select(F.col("from_id").alias("__from"), F.col("to_id").alias("__to")))
    front = cut(starts.select(F.col("id").alias("node")).distinct())
    seen, found = front, None
    for depth in range(1, most + 1):
        front = cut(steps.join(front, F.col("__from") == F.col("node"), "left_semi").select(F.col("__to").alias("node")).distinct().join(seen, "node", "left_anti"))
        if front.isEmpty():
            break
        level = front.withColumn("depth", F.lit(depth))
        found = level if found is None else found.union(level)
        seen = seen.union(front)
    return starts.sparkSession.createDataFrame([], "node string, depth int") if found is None else found


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"from_id": F.col("to_id"), "to_id": F.col("from_id")})
