"""A transitive closure that is kept current, and traces that read it.

Rows belong to the node that they start from.  When edges change, the nodes whose rows may change are those from which
the closure, as it was, reaches the beginning of a changed edge within its depth less one: what leads to the first
changed edge of a walk has not changed, so it was walked before.  The rows of these nodes are deleted and derived again
from the new edges; no other row is written.  Layers, tombstones and merges are those of graphmill.operators.layers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.functions import scalars as S
from graphmill.operators.graph import CLOSURE_DEFAULT, CLOSURE_MOST, TRACE_DEFAULT, closure, direction_of, trace, trace_depth
from graphmill.operators.layers import Layers
from graphmill.plans.cut import cut, small_side
from graphmill.schema import CALL_FAMILY



class Closures(Layers):
    """The closure of the edges of calls below path, up to a depth."""

    #: Not sorted, so that walks are spread once, straight into files, where the rows of a chunk of starts lie together.
    tables = {"pairs": ("from_id", ())}
    counted = "pairs"

    def __init__(self, spark: SparkSession, path: str, depth: int = CLOSURE_DEFAULT) -> None:
        super().__init__(spark, path)
        self.depth = max(1, min(depth, CLOSURE_MOST)) if depth > 0 else CLOSURE_DEFAULT

    def create(self, edges: DataFrame) -> None:
        self.start({"pairs": closure(edges, self.depth)})

    def touched(self, changed: DataFrame) -> DataFrame:
        """(id) of the nodes whose rows may change with changed edges (from_id, to_id, kind)."""
        heads = cut(changed.filter(F.col("kind").isin(list(CALL_FAMILY))).select(F.col("from_id").alias("id")).distinct())
        before = self.living("pairs").filter(F.col("depth") < self.depth)
        return cut(before.join(small_side(heads.withColumnRenamed("id", "to_id"), "to_id"), "to_id", "left_semi").select(F.col("from_id").alias("id")).union(heads).distinct())

    def apply(self, edges: DataFrame, changed: DataFrame) -> int:
        """Follow a change: edges as they are now, and those that came or went; the new version."""
        nodes = self.touched(changed)
        if nodes.isEmpty():
            return self.version()
        return self.change({"pairs": closure(edges, self.depth, starts=nodes)}, nodes)

    def table(self, version: int | None = None) -> DataFrame:
        """(from_id, to_id, depth, via_kind) of a version."""
        return self.living("pairs", version).select("from_id", "to_id", "depth", "via_kind")


def traced(edges: DataFrame, starts: DataFrame, direction: str = "in", depth: int = TRACE_DEFAULT, kinds: tuple[str, ...] = CALL_FAMILY, kept: Closures | None = None, version: int | None = None) -> DataFrame:
    """(start, node, depth, via, risk): a trace that reads the closure where it serves, and walks edges where not.

    It serves where calls are asked for, no deeper than it was built, and its last version is the one that goes with the
    edges, if that is given.  A depth outside of 1..5 is the default.  via, of a node that is read, is the kind of the last edge of a shortest walk;
    both ways keep the nearer.
    """
    way, most = direction_of(direction), trace_depth(depth)
    fresh = kept is not None and (version is None or kept.version() == version)
    if not fresh or set(kinds) != set(CALL_FAMILY) or most > kept.depth:
        return trace(edges, starts, way, most, kinds)
    pairs = kept.table().filter(F.col("depth") <= most)
    start = starts.select("start").distinct()
    ends = {"out": [("from_id", "to_id")], "in": [("to_id", "from_id")], "both": [("to_id", "from_id"), ("from_id", "to_id")]}[way]
    parts = [pairs.join(start.withColumnRenamed("start", near), near).select(F.col(near).alias("start"), F.col(far).alias("node"), "depth", F.col("via_kind").alias("via")) for near, far in ends]
    out = parts[0]
    if len(parts) == 2:
        out = out.unionByName(parts[1]).groupBy("start", "node").agg(F.min("depth").alias("depth"), F.min_by("via", F.struct("depth", "via")).alias("via"))
    return out.withColumn("risk", S.risk_label(F.col("depth")))
