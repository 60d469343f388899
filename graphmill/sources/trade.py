"""The driver's tables as the engine's: a property graph, telemetry logs, text corpora and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.schema import SYMBOLS

PROJECT, HANDOFF = "trade", "handoff"
#: Folders of graphs and indexes that store() has written, by the tables' folder.
_STORED: dict[str, str] = {}


def store(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Write the graph and the search index of sf_dir below path; from now on they are read from there, as a store is."""
    from graphmill.operators import search
    from graphmill.operators import store as tables

    _STORED.pop(sf_dir, None)
    tables.write_symbols(symbols(spark, sf_dir), f"{path}/symbols")
    tables.write_edges(edges(spark, sf_dir).withColumn("source", F.lit("per_file")), f"{path}/edges")
    search.save_index(index(spark, sf_dir), f"{path}/index")
    _STORED[sf_dir] = path


def index(spark: SparkSession, sf_dir: str):
    """The search index of the documents."""
    from graphmill.operators import search

    if sf_dir in _STORED:
        return search.load_index(spark, f"{_STORED[sf_dir]}/index")
    return search.build_index(corpus(spark, sf_dir), ["name", "docstring"])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nodes(df: DataFrame, kind: str, file_path: Column, name: Column, qn: Column, language: str, **given: Column) -> DataFrame:
    values: dict[str, Column] = {
        "project_id": F.lit(PROJECT), "id": F.concat(file_path, F.lit("::"), qn, F.lit("#" + kind)), "file_path": file_path, "name": name, "qualified_name": qn,
        "kind": F.lit(kind), "language": F.lit(language), "start_byte": F.lit(0), "end_byte": F.lit(0), "start_line": F.lit(1), "end_line": F.lit(1),
        "complexity": F.lit(0), "is_exported": F.lit(False), "is_test": F.lit(False), "is_entry_point": F.lit(False), "extraction_confidence": F.lit(1.0), "branch": F.lit(""),
    } | given
    columns = []
    for field in SYMBOLS.split(", "):
        c, kind_of = field.split()
        columns.append(values.get(c, F.lit(None)).cast(kind_of).alias(c))
    return df.select(*columns)


def key(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes.  A filter on kind leaves one table's scan, as every branch of the union has a constant kind."""
    if sf_dir in _STORED:
        return spark.read.schema(SYMBOLS).parquet(f"{_STORED[sf_dir]}/symbols")
    t = lambda n: table(spark, sf_dir, n)
    size = F.col("p_size")
    parts = [
        _nodes(t("region"), "Region", F.lit("geo/region"), F.col("r_name"), key("r", "r_regionkey"), "geo"),
        _nodes(t("nation"), "Nation", F.lit("geo/nation"), F.col("n_name"), key("n", "n_nationkey"), "geo", parent=key("r", "n_regionkey")),
        _nodes(t("supplier"), "Supplier", F.lit("party/supplier"), F.col("s_name"), key("s", "s_suppkey"), "party", is_exported=F.col("s_acctbal") >= 0),
        _nodes(
            t("customer"), "Customer", F.concat(F.lit("party/"), F.lower("c_mktsegment")), F.col("c_name"), key("c", "c_custkey"), "party", is_exported=F.col("c_acctbal") >= 0
        ),
        _nodes(
            t("part"), "Part", F.concat(F.lit("catalog/"), F.col("p_brand")), F.col("p_name"), key("p", "p_partkey"), "catalog", complexity=size, return_type=F.col("p_type"),
            extraction_confidence=F.when(size <= 10, 0.6).when(size <= 30, 0.85).otherwise(1.0),
        ),
        _nodes(
            t("orders"), "Order", F.concat(F.lit("order/"), F.col("o_orderpriority")), F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string")), key("o", "o_orderkey"), "order",
            complexity=F.floor(F.col("o_totalprice") / 10000), is_test=F.col("o_orderstatus") == "P", is_entry_point=F.col("o_orderstatus") == "O",
        ),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _ids(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Key and node id of the tables whose file path depends on the row; the others need no lookup."""
    t = lambda n: table(spark, sf_dir, n)
    make = lambda path, prefix, k, kind: F.concat(path, F.lit("::" + prefix), F.col(k).cast("string"), F.lit("#" + kind))
    return {
        "part": t("part").select("p_partkey", make(F.concat(F.lit("catalog/"), F.col("p_brand")), "p", "p_partkey", "Part").alias("part_id")),
        "order": t("orders").select("o_orderkey", "o_custkey", make(F.concat(F.lit("order/"), F.col("o_orderpriority")), "o", "o_orderkey", "Order").alias("order_id")),
        "customer": t("customer").select("c_custkey", "c_nationkey", make(F.concat(F.lit("party/"), F.lower("c_mktsegment")), "c", "c_custkey", "Customer").alias("customer_id")),
    }


def fixed_id(path: str, prefix: str, column: str, kind: str) -> Column:
    return F.concat(F.lit(f"{path}::{prefix}"), F.col(column).cast("string"), F.lit("#" + kind))


EDGE_COLUMNS = ("project_id", "from_id", "to_id", "kind", "confidence")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges of the trade graph, one for each (from, to, kind), with constant kinds for pruning."""
    if sf_dir in _STORED:
        return spark.read.parquet(f"{_STORED[sf_dir]}/edges").select(*EDGE_COLUMNS)
    t = lambda n: table(spark, sf_dir, n)
    ids = _ids(spark, sf_dir)
    supplier = fixed_id("party/supplier", "s", "l_suppkey", "Supplier")
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_discount")

    def kind(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.lit(PROJECT).alias("project_id"), "from_id", "to_id", F.lit(name).alias("kind"), F.col("confidence").cast("double").alias("confidence"))

    # Key pairs are aggregated before names are joined on: fewer and narrower rows in the shuffle.
    order_part = lines.groupBy("l_orderkey", "l_partkey").agg(F.max(1 - F.col("l_discount")).alias("confidence"))
    order_part = order_part.join(ids["order"], F.col("l_orderkey") == F.col("o_orderkey")).join(ids["part"], F.col("l_partkey") == F.col("p_partkey"))
    part_supplier = lines.select("l_partkey", "l_suppkey").distinct().join(ids["part"], F.col("l_partkey") == F.col("p_partkey"))
    order_supplier = lines.select("l_orderkey", "l_suppkey").distinct().join(ids["order"], F.col("l_orderkey") == F.col("o_orderkey"))
    order_customer = ids["order"].join(ids["customer"], F.col("o_custkey") == F.col("c_custkey"))
    one = F.lit(1.0).alias("confidence")
    nation = lambda c: fixed_id("geo/nation", "n", c, "Nation")
    parts = [
        kind(order_part.select(F.col("order_id").alias("from_id"), F.col("part_id").alias("to_id"), "confidence"), "CALLS"),
        kind(part_supplier.select(F.col("part_id").alias("from_id"), supplier.alias("to_id"), one), "CALLS"),
        kind(order_supplier.select(F.col("order_id").alias("from_id"), supplier.alias("to_id"), one), "READS"),
        kind(order_customer.select(F.col("order_id").alias("from_id"), F.col("customer_id").alias("to_id"), one), "REFERENCES"),
        kind(t("supplier").select(fixed_id("party/supplier", "s", "s_suppkey", "Supplier").alias("from_id"), nation("s_nationkey").alias("to_id"), one), "IMPORTS"),
        kind(ids["customer"].select(F.col("customer_id").alias("from_id"), nation("c_nationkey").alias("to_id"), one), "IMPORTS"),
        kind(t("nation").select(nation("n_nationkey").alias("from_id"), fixed_id("geo/region", "r", "n_regionkey", "Region").alias("to_id"), one), "IMPORTS"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def handoff_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cyclic graph: each user to the user of the next event.

    The successor in a total order is found by day first, then across days, so that no task sorts all events.
    """
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select("ts", "event_id", "user_id", F.to_date("ts").alias("day"))
    within = Window.partitionBy("day").orderBy("ts", "event_id")
    e = e.withColumn("next", F.lead("user_id").over(within))
    firsts = e.groupBy("day").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first_user"))
    # One row a day: small by construction.
    following = firsts.withColumn("first_next", F.lead("first_user").over(Window.orderBy("day"))).select("day", "first_next")
    # Of each day only the last event has no successor of its own.
    pairs = e.join(F.broadcast(following), "day").select("user_id", F.coalesce("next", "first_next").alias("next")).filter("next is not null").distinct()
    return pairs.select(F.lit(HANDOFF).alias("project_id"), key("u", "user_id").alias("from_id"), key("u", "next").alias("to_id"), F.lit("ASYNC_CALLS").alias("kind"), F.lit(1.0).alias("confidence"))


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as the log of tool calls."""
    v = F.col("value")
    used, saved = F.round(v * 10).cast("bigint"), F.when(F.col("event_type") != "error", F.round(v * 30).cast("bigint"))
    out = table(spark, sf_dir, "events").select(
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), F.col("event_type").alias("tool"),
        F.when(v < 50, "lite").when(v < 150, "standard").otherwise("heavy").alias("complexity_tier"), (used * 4).alias("response_bytes"), used.alias("tokens_used"),
        saved.alias("tokens_saved"), F.col("ts").alias("at"), F.col("event_id").cast("string").alias("request_id"),
    )
    total = F.col("tokens_used") + F.col("tokens_saved")
    return out.withColumn("tokens_saved_pct", F.when(total != 0, 100.0 * F.col("tokens_saved") / total)).withColumn("ts", micros(F.col("at")) * 1000)


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp without zone (read as UTC)."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events of two types as hook invocations; took_recommendation is filled in by telemetry.resolve_hooks."""
    v = F.col("value")
    return table(spark, sf_dir, "events").filter(F.col("event_type").isin("view", "click")).select(
        F.col("event_id").alias("id"), F.col("ts").alias("at"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), F.col("event_type").alias("tool_name"),
        F.when(v >= 100, "redirect").otherwise("pass_through").alias("decision"), F.lit("purchase").alias("suggested_tool"),
        F.round(v * 40).cast("bigint").alias("baseline_tokens"), F.round(v * 10).cast("bigint").alias("est_tokens_served"),
    )


def loop_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("loop_name"), (F.col("turn") + 1).cast("int").alias("seq"), F.col("text").alias("claim"), F.col("role").alias("decision")
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as the docs corpus of search."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("name"), F.col("text").alias("docstring"), F.col("lang").alias("language"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as source files."""
    return table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"), F.col("html").alias("content"))
