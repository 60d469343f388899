"""Substring dedup by hashing units: lines, and the sentences inside them.

Units are normalised (lower case, white space runs as one space) and hashed to 128 bits.  Digests that occur
more than once are found by one aggregation with map-side sums; of each, the occurrence that ranks first, by
doc_id and offset, is kept and all others are removed.  Offsets are those of the original text, in characters.

Units shorter than a number of words are left alone: they repeat by chance.  A unit repeated within one text
is removed there too.  Null or empty texts have no units.

A row is known by its id and two digests of its text, so rows that repeat a doc_id, or have none, are documents
of their own where their texts differ; they rank by id, then by digest.  A null doc_id ranks last.  Rows equal
in id and text are one document: both keep what the first keeps.  An empty table gives an empty one.  Very
long texts are cut into units one at a time; of one row only the spans to remove are ever gathered.
Columns named `removed` are replaced, all others kept.
"""

from __future__ import annotations

import re
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import KEY, counted_join, fits_broadcast, map_arrow, materialize, row_key

LINE_WORDS, SENTENCE_WORDS = 4, 8
_SENTENCE = re.compile(r"[.!?]+\s+")


def _normal(unit: str) -> tuple[bytes, int]:
    words = unit.lower().split()
    return " ".join(words).encode("utf-8", "surrogatepass"), len(words)


def units_of(text: str, line_words: int = LINE_WORDS, sentence_words: int = SENTENCE_WORDS):
    """(digest, first character, character after the last) of each unit that is long enough."""
    at = 0
    for line in text.split("\n"):
        end = at + len(line)
        body, n = _normal(line)
        if n >= line_words:
            yield blake2b(body, digest_size=16).digest(), at, end
        if n > sentence_words:
            cuts = [m.end() for m in _SENTENCE.finditer(line)]
            if cuts:
                for a, b in zip([0, *cuts], [*cuts, len(line)], strict=True):
                    body, n = _normal(line[a:b])
                    if n >= sentence_words:
                        yield blake2b(body, digest_size=16).digest(), at + a, at + b
        at = end + 1


def _units(line_words: int, sentence_words: int):
    def run(batches):
        for batch in batches:
            texts = batch.column(3)
            for a in range(0, batch.num_rows, 256):
                owner, digests, starts, ends = [], [], [], []
                for i, text in enumerate(texts.slice(a, 256).to_pylist()):
                    for d, s, e in units_of(text or "", line_words, sentence_words):
                        owner.append(a + i)
                        digests.append(d)
                        starts.append(s)
                        ends.append(e)
                pair = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                of = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(of) for c in range(3)), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())],
                    [*KEY, "d0", "d1", "start", "end"],
                )

    return run


def repeated_spans(docs: DataFrame, line_words: int = LINE_WORDS, sentence_words: int = SENTENCE_WORDS) -> DataFrame:
    """(rank, t0, t1, start, end, first): every occurrence of a unit but the first, by row, and where that is."""
    rows = docs.select(*row_key(), F.col("text").cast("string").alias("text"))
    units = materialize(map_arrow(rows, _units(line_words, sentence_words), "rank long, t0 long, t1 long, d0 long, d1 long, start int, end int"), "units")
    firsts = materialize(units.groupBy("d0", "d1").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*KEY, "start")).alias("first")).filter("n > 1"), "firsts")
    later = counted_join(units, firsts, ["d0", "d1"], "n").filter("struct(rank, t0, t1, start) <> first")
    return later.select(*KEY, "start", "end", "first")


def _gather(batches):
    """Spans of each row of (key, spans), sorted and joined."""
    for batch in batches:
        out = []
        for spans in batch.column(3).to_pylist():
            done: list[list[int]] = []
            for s in sorted((x["start"], x["end"]) for x in spans):
                if done and done[-1][1] >= s[0]:
                    done[-1][1] = max(done[-1][1], s[1])
                else:
                    done.append(list(s))
            out.append([{"start": a, "end": b} for a, b in done])
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, batch.column(3).type)], [*KEY, "spans"])


_SPANS = "array<struct<start:int,end:int>>"


def _spans(docs: DataFrame, line_words: int, sentence_words: int) -> DataFrame:
    """(rank, t0, t1, spans) of the rows that lose something."""
    grouped = repeated_spans(docs, line_words, sentence_words).groupBy(*KEY).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return map_arrow(grouped, _gather, f"rank long, t0 long, t1 long, spans {_SPANS}")


def removals(docs: DataFrame, line_words: int = LINE_WORDS, sentence_words: int = SENTENCE_WORDS) -> DataFrame:
    """One row for each row of docs: doc_id, n_chars, n_removed, removed_chars and the spans to remove."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(), F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_chars"))
    out = rows.join(_spans(docs, line_words, sentence_words), KEY, "left").withColumn("spans", F.coalesce("spans", F.array().cast(_SPANS)))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return out.select("doc_id", "n_chars", F.size("spans").cast("long").alias("n_removed"), removed.alias("removed_chars"), "spans")


def _cut(batches):
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            parts, at = [], 0
            for s in spans or []:
                parts.append((text or "")[at : s["start"]])
                at = s["end"] + (text[s["end"] : s["end"] + 1] == "\n" and (s["start"] == 0 or text[s["start"] - 1] == "\n"))
            out.append(None if text is None else "".join([*parts, text[at:]]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["row", "text"])


def deduplicated(docs: DataFrame, line_words: int = LINE_WORDS, sentence_words: int = SENTENCE_WORDS) -> DataFrame:
    """docs with repeated units cut from text, and `removed`, the spans in the original text."""
    own = docs.drop("removed")
    found = materialize(_spans(docs, line_words, sentence_words), "removed")
    packed = own.select(*row_key(), F.struct(*[F.col(f"`{c}`") for c in own.columns if c != "text"]).alias("row"), F.col("text").cast("string").alias("text"))
    joined = packed.join(F.broadcast(found) if fits_broadcast(found) else found, KEY, "left")
    joined = joined.select(F.struct("row.*", F.col("spans").alias("removed")).alias("row"), "text", "spans")
    kind = joined.schema["row"].dataType.simpleString()
    out = map_arrow(joined, _cut, f"row {kind}, text string").select("row.*", "text")
    return out.select(*own.columns, "removed")
