"""Many searches in one plan: the best documents for each of a table of queries, and suspects for a table of failures.

Queries are texts; a document matches with any of their words and is scored by BM25.  Words that are so common that all
of them together can not lift a document among the best k are not looked up in all their postings, but only for the
documents that a telling word has found.  What "among the best k" takes is known from the telling words alone: a score by
some of the words is never more than the whole score, so the k-th best of them is a bound.  Results are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.operators.impact import _STOP
from graphmill.operators.search import K1, B, Index, words
from graphmill.plans.cut import cut

#: Scores are compared by so many decimals, so that equal texts tie and go by id.
DECIMALS = 9
#: Room for sums of floating point in a comparison of bounds.
SLACK = 1e-6
MOST_FRAMES, HITS = 20, 10


def _part(idf: Column) -> Column:
    return idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))


def _best(scored: DataFrame, k: int, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The k best rows of each query.  Spark drops what is beyond them in each partition before it shuffles."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def batch_search(index: Index, queries: DataFrame, k: int = HITS) -> DataFrame:
    """(query_id, id, score, rank) of the k best documents for each query (query_id, text)."""
    asked = queries.select("query_id", F.explode(F.array_distinct(words(F.col("text")))).alias("term")).distinct()
    stats = F.broadcast(index.stats)
    df = index.postings.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = asked.join(df, "term").crossJoin(stats).select("query_id", "term", "df", idf.alias("idf"), "avg_length").withColumn("bound", F.col("idf") * (K1 + 1))
    # Queries are texts: their words are few, so windows over a query hold a text's words.
    rare = Window.partitionBy("query_id").orderBy(F.desc("bound"), "term")
    common = Window.partitionBy("query_id").orderBy("bound", F.desc("term"))
    # Telling words, rarest first, until their postings alone fill the result.
    terms = cut(terms.withColumns({"found": F.sum("df").over(rare.rowsBetween(Window.unboundedPreceding, -1)), "rest": F.sum("bound").over(common)}))
    telling = terms.filter(F.coalesce("found", F.lit(0)) < k)
    first = _scored(index, _hits(index, telling))
    bound = _best(first, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    # Words of which, with all that are commoner, the sum stays below the bound find nothing by themselves.
    placed = cut(terms.join(bound, "query_id", "left").withColumn("finds", F.coalesce(F.col("rest") >= F.col("least") - SLACK, F.lit(True))).select("query_id", "term", "idf", "avg_length", "finds"))
    found = cut(_hits(index, placed.filter("finds")))
    # The others are looked up by word and document, so that no more rows come of them than candidates have words.
    wanted = found.select("query_id", "id").distinct().join(placed.filter("not finds"), "query_id")
    more = wanted.join(index.postings, ["term", "id"]).select(*found.columns)
    return _best(_scored(index, found.unionByName(more)), k)


def _hits(index: Index, terms: DataFrame) -> DataFrame:
    return index.postings.join(terms.select("query_id", "term", "idf", "avg_length"), "term").select("query_id", "id", "term", "tf", "idf", "avg_length")


def _scored(index: Index, hits: DataFrame) -> DataFrame:
    scored = hits.join(index.lengths, "id").withColumn("part", _part(F.col("idf")))
    return scored.groupBy("query_id", "id").agg(F.round(F.sum("part"), DECIMALS).alias("score"))


def frames(failures: DataFrame) -> DataFrame:
    """(failure_id, frame) of error texts (failure_id, error_text): names of functions, the most frequent, then the longest, MOST_FRAMES of them."""
    text = F.coalesce("error_text", F.lit(""))
    called = F.transform(F.regexp_extract_all(text, F.lit(r"(?<![\w/.-])([A-Za-z_][\w.]*)\s*(?=\()"), F.lit(1)), lambda x: F.regexp_extract(F.regexp_replace(x, r"\.+$", ""), r"([^.]*)$", 1))
    within = F.regexp_extract_all(text, F.lit(r"\bin ([A-Za-z_]\w+)"), F.lit(1))
    named = F.filter(F.concat(F.filter(called, lambda x: F.length(x) > 2), within), lambda x: ~F.lower(x).isin(sorted(_STOP)))
    counted = failures.select("failure_id", F.explode(named).alias("frame")).groupBy("failure_id", "frame").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("failure_id").orderBy(F.desc("n"), F.desc(F.length("frame")), "frame")
    return counted.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= MOST_FRAMES).select("failure_id", "frame")


def investigate(symbols: DataFrame, edges: DataFrame, index: Index, failures: DataFrame, recent: DataFrame | None = None, k: int = 5, hits: int = HITS) -> DataFrame:
    """(failure_id, id, score, evidence, rank) of the nodes that each failure (failure_id, error_text) may come from.

    Each distinct frame is searched once, whatever failures it is in.  A node that a frame names counts .45, one that it
    only finds .20; .10 if several frames find it, .20 if its file stands in the text, .20 if that was changed (recent:
    file_path), and up to .05 by its callers.
    """
    of = cut(frames(failures))
    searched = batch_search(index, of.select(F.col("frame").alias("query_id"), F.col("frame").alias("text")).distinct(), hits)
    found = of.join(searched.select(F.col("query_id").alias("frame"), "id"), "frame").join(symbols.select("id", "name", "file_path"), "id")
    exact = F.lower("frame") == F.lower("name")
    each = cut(found.groupBy("failure_id", "id", "file_path").agg(F.max(exact.cast("int")).alias("exact"), F.countDistinct("frame").alias("frames")))
    into = edges.join(each.select(F.col("id").alias("to_id")).distinct(), "to_id", "left_semi").groupBy(F.col("to_id").alias("id")).agg(F.count(F.lit(1)).alias("fan_in"))
    files = F.regexp_extract_all(F.coalesce("error_text", F.lit("")), F.lit(r"([\w./\\-]+\.(?:go|py|js|ts|tsx|java|rb|rs|cs|php|kt|swift|cpp|c|h))\b"), F.lit(1))
    paths = failures.select("failure_id", F.transform(files, lambda x: F.replace(x, F.lit("\\"), F.lit("/"))).alias("files"))
    path = F.col("file_path")
    in_text = F.exists("files", lambda x: (x == path) | x.endswith(F.concat(F.lit("/"), path)) | path.endswith(F.concat(F.lit("/"), x)))
    out = each.join(paths, "failure_id").join(into, "id", "left").withColumn("in_text", in_text)
    if recent is None:
        out = out.withColumn("recent", F.lit(False))
    else:
        out = out.join(recent.select("file_path", F.lit(True).alias("__r")).distinct(), "file_path", "left").withColumn("recent", F.coalesce("__r", F.lit(False)))
    fan = F.coalesce("fan_in", F.lit(0))
    signs = [("stack_frame_exact_name_match", F.col("exact") == 1, 0.45), ("stack_frame_match", F.col("exact") == 0, 0.20), ("multi_frame_match", F.col("frames") > 1, 0.10), ("file_appears_in_trace", F.col("in_text"), 0.20), ("modified_in_working_tree", F.col("recent"), 0.20)]
    score = sum((F.when(on, worth).otherwise(0.0) for _, on, worth in signs), F.lit(0.0)) + 0.05 * F.least(fan, F.lit(20)) / 20
    evidence = F.array_join(F.array_compact(F.array(*[F.when(on, F.lit(name)) for name, on, _ in signs], F.when(fan > 0, F.concat(F.lit("caller_fan_in="), fan)))), ",")
    scored = out.select("failure_id", "id", F.round(F.least(F.lit(1.0), score), DECIMALS).alias("score"), evidence.alias("evidence"))
    return _best(scored, k, ("failure_id",))
