"""Connected components over an edge table: union-find by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill.llm.common import counted_join, delete, materialize

#: From so many links on, the rows of a node that a large share of them has are dealt out.
DEAL = 200_000
#: Up to so many links, about a MB, a round is one task: without shuffles, the driver keeps no plans and tasks of them.
ONE_TASK = 50_000


def _of_node(rows: DataFrame, least: DataFrame, deal: bool) -> DataFrame:
    """rows with their node's least; a hub's rows go to many tasks."""
    return counted_join(rows, least, ["u"], "n").drop("n") if deal else rows.join(least.drop("n"), "u")


def _large_star(edges: DataFrame, deal: bool = False) -> DataFrame:
    """Every node links its larger neighbours to the least node it knows."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return _of_node(both.filter("v > u"), least, deal).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(edges: DataFrame, deal: bool = False) -> DataFrame:
    """Every node links itself and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = _of_node(down, least, deal).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _stars_in_one_task(edges: DataFrame) -> DataFrame:
    """_small_star(_large_star()) of a few links."""
    by_node = Window.partitionBy("u")
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(1)
    large = both.withColumn("m", F.least(F.min("v").over(by_node), "u")).filter("v > u and v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
    least = large.withColumn("m", F.min("v").over(by_node))
    moved = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
    return least.select(F.explode(moved).alias("link")).select("link.*").filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): for every node with a link, the least node that it reaches.  edges: (u, v) longs.

    Rounds run until the stars stop changing; each round is a written table, so lineage stays short and
    nothing but two numbers reaches the driver.  Repeated links and links of a node with itself have no effect.
    """
    now = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    mark = None
    while True:
        row = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if row[0] == 0 or tuple(row) == mark:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        mark = tuple(row)
        deal = row[0] >= DEAL
        after = materialize(_stars_in_one_task(now) if row[0] <= ONE_TASK else _small_star(_large_star(now, deal), deal), "cc")
        delete(now)
        now = after
