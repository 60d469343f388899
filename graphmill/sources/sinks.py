"""Graphs and results as files and text: JSON, GraphML, DOT, Mermaid, TSV and other tables, Prometheus, Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.functions import scalars as S


def without_dangling(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends both exist."""
    ids = symbols.select("id")
    return edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")


def json_lines(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON object a line: nodes, then edges."""
    node = symbols.select(F.lit(0).alias("part"), F.to_json(F.struct(F.lit("node").alias("type"), "id", "kind", "name", "file_path")).alias("value"))
    edge = edges.select(F.lit(1), F.to_json(F.struct(F.lit("edge").alias("type"), "from_id", "to_id", "kind", "confidence")))
    return node.union(edge)


def _xml(c: Column) -> Column:
    out = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def graphml_lines(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, value): the lines of a GraphML file by part; lines of one part may stand in any order."""
    spark = symbols.sparkSession
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n<key id="name" for="node" attr.name="name" attr.type="string"/>\n<key id="kind" for="all" attr.name="kind" attr.type="string"/>\n<graph edgedefault="directed">'
    ends = spark.createDataFrame([(0, head), (3, "</graph>\n</graphml>")], "part int, value string")
    node = symbols.select(F.lit(1), F.format_string('<node id="%s"><data key="name">%s</data><data key="kind">%s</data></node>', _xml(F.col("id")), _xml(F.col("name")), _xml(F.col("kind"))))
    edge = without_dangling(symbols, edges).select(F.lit(2), F.format_string('<edge source="%s" target="%s"><data key="kind">%s</data></edge>', _xml(F.col("from_id")), _xml(F.col("to_id")), _xml(F.col("kind"))))
    return ends.union(node).union(edge)


def _dot(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def dot_lines(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    ends = symbols.sparkSession.createDataFrame([(0, "digraph g {"), (3, "}")], "part int, value string")
    node = symbols.select(F.lit(1), F.format_string('  "%s" [label="%s"];', _dot(F.col("id")), _dot(F.col("name"))))
    edge = without_dangling(symbols, edges).select(F.lit(2), F.format_string('  "%s" -> "%s" [label="%s"];', _dot(F.col("from_id")), _dot(F.col("to_id")), F.col("kind")))
    return ends.union(node).union(edge)


def write_lines(lines: DataFrame, path: str) -> None:
    """Write (part, value) as text, the parts in order: a range partition by part keeps the files in order."""
    lines.repartitionByRange("part", "value").sortWithinPartitions("part", "value").select("value").write.mode("overwrite").text(path)


def mermaid(nodes: DataFrame, edges: DataFrame, most: int = 500) -> str:
    """A call flow as a Mermaid chart of the nearest nodes; a last line tells how many more there are."""
    found = nodes.select("id", S.name_of_id(F.col("id")).alias("n"), "depth").orderBy("depth", "id").limit(most).collect()
    at = {r.id: f"n{i}" for i, r in enumerate(found)}
    lines = ["flowchart LR", *[f'  {at[r.id]}["{r.n}"]' for r in found]]
    shown = edges.filter(F.col("from_id").isin(list(at)) & F.col("to_id").isin(list(at))).select("from_id", "to_id").distinct()
    lines += [f"  {at[r.from_id]} --> {at[r.to_id]}" for r in shown.orderBy("from_id", "to_id").collect()]
    more = nodes.count() - len(found)
    return "\n".join(lines + [f"  %% {more} more nodes"] * (more > 0))


def tsv(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows as tab-separated text."""
    clean = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\n]", " ") for c in columns]
    return df.select(F.concat_ws("\t", *clean).alias("value"))


def tabular(df: DataFrame, name: str, columns: list[str], limit: int = 500) -> str:
    """A small result as `name[n]{columns}:` and one line of values for each row."""
    rows = df.select(*columns).limit(limit).collect()
    quote = lambda v: "null" if v is None else f'"{v}"' if isinstance(v, str) and any(c in v for c in ',":\n') else str(v)
    return "\n".join([f"{name}[{len(rows)}]{{{','.join(columns)}}}:", *["  " + ",".join(quote(v) for v in r) for r in rows]])


def prometheus(log: DataFrame, prefix: str = "tool") -> DataFrame:
    """Counters and summaries of a log by tool, in the text format of Prometheus."""
    by = log.groupBy("tool").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("tokens_used"), F.lit(0)).alias("s"))
    label = F.format_string('{tool="%s"}', F.col("tool"))
    lines = F.array(
        F.concat(F.lit(f"{prefix}_calls_total"), label, F.lit(" "), F.col("n").cast("string")), F.concat(F.lit(f"{prefix}_tokens_sum"), label, F.lit(" "), F.col("s").cast("string")),
        F.concat(F.lit(f"{prefix}_tokens_count"), label, F.lit(" "), F.col("n").cast("string")),
    )
    return by.select(F.explode(lines).alias("value"))


def report(symbols: DataFrame, edges: DataFrame, title: str, limit: int = 10) -> str:
    """An architecture report in Markdown over a few small aggregates."""
    from graphmill.operators import graph, quality

    section = lambda name, df, columns: [f"## {name}", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *["| " + " | ".join(str(r[c]) for c in columns) + " |" for r in df.collect()], ""]
    entries = symbols.filter("is_entry_point").orderBy("file_path", "start_line", "id").limit(limit)
    kinds = quality.graph_stats(symbols, edges).orderBy("what", F.desc("n"), "kind").limit(50)
    out = [f"# {title}", ""]
    out += section("Counts", kinds, ["what", "kind", "n"])
    out += section("Entry points", entries, ["id", "kind"])
    out += section("Hotspots", graph.hotspots(symbols, edges, limit), ["id", "in_degree"])
    out += section("Surprising connections", graph.surprising(edges, limit, None), ["from_package", "to_package", "edge_count", "boundary"])
    notes = symbols.filter("kind = 'Rationale'").orderBy("id").limit(limit)
    return "\n".join(out + section("Rationale", notes, ["id", "docstring"]))
