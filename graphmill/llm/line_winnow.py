"""Line dedup by winnowing over line hashes.

A text is a sequence of line hashes.  Hashes of GRAM lines in a row are winnowed: in every window of
RUN - GRAM + 1 of them the least is selected (of equal ones the last), so every run of RUN lines that two
texts share holds a fingerprint that both have selected.  Fingerprints that occur once are dropped by an
aggregation with map-side counts.  Each of the others is extended both ways, by digests of the lines around it, to
all runs of RUN lines that hold it, and the positions of equal runs are joined with the first of them, in the
order of doc_id and line: each later one is a repeat.  A match that goes on beyond a run holds the next run's
fingerprint too, so repeats on one diagonal of one source that meet are put together to the longest match
without reading either text again.  Lines of later repeats are deleted.

Fewer than RUN lines hold no fingerprint.  There the guarantee comes from the size: where long_words is given, a
passage of fewer lines with that many words is a fingerprint and a match of its own, and so is a text of fewer
lines and words that another text equals as a whole.

Only hashes are shuffled.  A line counts as its words in lower case.  Empty lines are lines.  Null or empty
texts have no lines.  A row is known by its id and two digests of its text: rows that repeat a doc_id, or have
none, are documents of their own where their texts differ, ranked by id, then by digest; a null doc_id ranks
last.  Rows equal in id and text are one document, and both keep what the first keeps.  Runs that overlap
their own earlier occurrence, such as a line that a text repeats, are deleted from the second occurrence on.
An empty table gives an empty one; a very long text is one row of hashes at a time.  Other columns are kept.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import KEY, LAST, counted_join, map_arrow, materialize, row_key
from graphmill.llm.wordhash import _STEP, mix

GRAM, RUN = 2, 3
#: Words of a passage that is a repeat however few lines it has.
LONG = 8


def line_hashes(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each line, and how many words it has."""
    if not text:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lines = [x.split() for x in text.lower().split("\n")]
    digest = [blake2b(" ".join(x).encode("utf-8", "surrogatepass"), digest_size=8).digest() for x in lines]
    return np.frombuffer(b"".join(digest), np.uint64), np.fromiter(map(len, lines), np.int64, len(lines))


def rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k items in a row."""
    n = max(0, len(hashes) - k + 1)
    acc = np.full(n, k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            acc = mix((acc ^ hashes[j : j + n]) + _STEP)
    return acc


def selected(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the least gram of every window, the last of equal ones."""
    n = len(grams)
    if n < window:
        return np.zeros(0, np.int64)
    best = np.arange(n - window + 1)
    for j in range(1, window):
        here = np.arange(j, n - window + 1 + j)
        best = np.where(grams[here] <= grams[best], here, best)
    return np.unique(best)


def _runs_of(hashes: np.ndarray, gram: int, run: int):
    """(line, size, fingerprint, two digests) of every run that holds a selected fingerprint, once for each."""
    grams, window = rolled(hashes, gram), run - gram + 1
    at = selected(grams, window)
    first = at[:, None] + np.arange(1 - window, 1)[None, :]
    there = (first >= 0) & (first <= len(hashes) - run)
    line = first[there]
    return line, np.full(len(line), run), np.broadcast_to(grams[at][:, None], there.shape)[there], rolled(hashes, run)[line], rolled(mix(hashes + _STEP), run)[line]


def _passages_of(hashes: np.ndarray, words: np.ndarray, run: int, long_words: int):
    """The same of passages of fewer than `run` lines with long_words or more, and of a whole text of fewer lines and words: each is its own fingerprint."""
    total = np.concatenate(([0], np.cumsum(words)))
    whole = len(hashes) < run and 0 < total[-1] < long_words
    # A whole text meets whole texts only.
    own = mix(hashes + np.uint64(whole))
    for size in [len(hashes)] if whole else range(1, min(run, len(hashes) + 1)):
        at = np.flatnonzero((total[size:] - total[:-size] >= long_words) | whole)
        digest = rolled(own, size)[at]
        yield at, np.full(len(at), size), digest, digest, rolled(mix(own + _STEP), size)[at]


def _fingerprints(gram: int, run: int, long_words: int | None):
    def scan(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                found, rows = [], []
                for i, text in enumerate(batch.column(3).slice(a, 256).to_pylist()):
                    hashes, words = line_hashes(text)
                    parts = [_runs_of(hashes, gram, run)] if len(hashes) >= run else []
                    if long_words is not None and len(hashes):
                        parts += _passages_of(hashes, words, run, long_words)
                    found += parts
                    rows += [np.full(len(p[0]), a + i) for p in parts]
                if rows:
                    of = pa.array(np.concatenate(rows))
                    flat = [np.concatenate(c).astype(np.int64) if k < 2 else np.concatenate(c).view(np.int64) for k, c in enumerate(zip(*found, strict=True))]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(of) for c in range(3)), *map(pa.array, flat)], [*KEY, "line", "size", "gram", "run0", "run1"])

    return scan


_KEY = "rank long, t0 long, t1 long"


def repeats(docs: DataFrame, gram: int = GRAM, run: int = RUN, long_words: int | None = None) -> DataFrame:
    """(rank, t0, t1, line, size, source): every run of `run` lines, by its row and first line, that has occurred before.

    With long_words also every shorter passage that _passages_of() gives.  source: the first one's row and line.
    """
    rows = docs.select(*row_key(), F.col("text").cast("string").alias("text"))
    prints = materialize(map_arrow(rows, _fingerprints(gram, run, long_words), f"{_KEY}, line long, size long, gram long, run0 long, run1 long"), "prints")
    common = materialize(prints.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "grams")
    met = counted_join(prints, common, ["gram"], "n")
    runs = materialize(met.select(*KEY, "line", "size", "run0", "run1").distinct(), "runs")
    firsts = materialize(runs.groupBy("run0", "run1").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*KEY, "line")).alias("source")).filter("n > 1"), "firsts")
    later = counted_join(runs, firsts, ["run0", "run1"], "n").filter("struct(rank, t0, t1, line) <> source")
    return later.select(*KEY, "line", "size", "source")


def _extend(batches):
    """Repeats of a document to maximal runs: those on one diagonal of one source that meet are one match."""
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("line", "end_line", "source_doc", "source_line")]))
    for batch in batches:
        out = []
        for found in batch.column(3).to_pylist():
            done: list[list] = []
            for source, shift, line, size in sorted(((s["rank"], s["t0"], s["t1"]), x["line"] - s["line"], x["line"], x["size"]) for x in found for s in (x["source"],)):
                if done and done[-1][2:] == [source, shift] and done[-1][1] >= line:
                    done[-1][1] = max(done[-1][1], line + size)
                else:
                    done.append([line, line + size, source, shift])
            out.append([{"line": a, "end_line": b, "source_doc": None if s[0] == LAST else s[0], "source_line": a - d} for a, b, s, d in sorted(done)])
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, kind)], [*KEY, "matches"])


_MATCHES = "array<struct<line:bigint,end_line:bigint,source_doc:bigint,source_line:bigint>>"


def _matches(docs: DataFrame, gram: int, run: int, long_words: int | None) -> DataFrame:
    """(rank, t0, t1, matches) of the rows that have any."""
    grouped = repeats(docs, gram, run, long_words).groupBy(*KEY).agg(F.collect_set(F.struct("line", "size", "source")).alias("found"))
    return map_arrow(grouped, _extend, f"{_KEY}, matches {_MATCHES}")


def line_matches(docs: DataFrame, gram: int = GRAM, run: int = RUN, long_words: int | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, n_lines, n_deleted, and matches, the later repeated runs with their sources (null for one without an id)."""
    text = F.col("text").cast("string")
    lines = F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.size(F.split(text, "\n"))).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(), lines.alias("n_lines"))
    out = rows.join(_matches(docs, gram, run, long_words), KEY, "left").withColumn("matches", F.coalesce("matches", F.array().cast(_MATCHES)))
    covered = F.array_distinct(F.flatten(F.transform("matches", lambda m: F.sequence(m["line"], m["end_line"] - 1))))
    return out.select("doc_id", "n_lines", F.size(covered).cast("long").alias("n_deleted"), "matches")


def _delete(batches):
    for batch in batches:
        out = []
        for text, matches in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            gone = {i for m in matches or [] for i in range(m["line"], m["end_line"])}
            out.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone) if gone else text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["row", "text"])


def without_repeats(docs: DataFrame, gram: int = GRAM, run: int = RUN, long_words: int | None = LONG) -> DataFrame:
    """docs with the lines of later repeated runs deleted from text."""
    packed = docs.select(*row_key(), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), F.col("text").cast("string").alias("text"))
    joined = packed.join(_matches(docs, gram, run, long_words), KEY, "left").select("row", "text", "matches")
    kind = joined.schema["row"].dataType.simpleString()
    return map_arrow(joined, _delete, f"row {kind}, text string").select("row.*", "text").select(*docs.columns)
