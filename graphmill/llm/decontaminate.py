"""Benchmark decontamination with suffix arrays over the training text.

Each task turns its documents into word numbers and builds a suffix array over them, a shard; every suffix
of every benchmark item is binary-searched in it.  The range that a suffix still has after ten words holds
all verbatim occurrences of that ten-word window.  Windows that follow each other in the item and in the text are
one longer match, so the runs of them are the longest verbatim matches, with their places in both.
Words that no item has end a suffix, and suffixes too short for any window stay out of the array: neither
can hold a match, so the arrays are small although every document is searched whole.  Nothing is shuffled.

A benchmark of at most BLOCK_BYTES of text, as measured, is one broadcast block.  A larger one is written to the shared
folder in blocks; a task gathers a shard of about a block's size and takes one block after the other, so it
never holds more than one of them, and documents are read once whatever the number of blocks.

Null or empty texts have no words and no hits.  Items without words match nothing.  Items that repeat an
item_id count once; a null item_id counts as the empty string.  Rows of documents are judged one by one, so
repeated rows get equal verdicts, whatever their ids.  Of equally long matches the first in the text is given, then
the one of the item that sorts first, then the first in the item.  Empty tables give empty results, or documents
without hits.  A very long text is a shard of its own.  Extra columns are ignored, by clean() kept.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import exclusive, map_arrow, new_path, workers_can_import
from graphmill.llm.wordhash import LOWER, NON_WORD, chunks, text_bytes

WINDOW = 10
BLOCK_BYTES = 32 << 20
#: Text of one shard.
SHARD_BYTES = 4 << 20
_TABLE = bytes(np.where(NON_WORD[LOWER], 32, LOWER).astype(np.uint8))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters and digits and of all that is not ASCII."""
    return text.translate(_TABLE).split()


class Block:
    """Benchmark items as word numbers, with the windows to look for."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        names, sequences = [], []
        for name, text in items:
            if ws := words_of(text):
                names.append(name)
                sequences.append([number(w, len(self.vocabulary) + 1) for w in ws])
        lengths = np.array([len(s) for s in sequences], np.int64)
        self.names = sorted(set(names))
        at = {n: i for i, n in enumerate(self.names)}
        self.words = np.array([w for s in sequences for w in s], np.int64)
        begin = np.cumsum(lengths) - lengths
        self.item = np.repeat(np.array([at[n] for n in names], np.int64), lengths)
        self.offset = np.arange(len(self.words)) - np.repeat(begin, lengths)
        self.left = np.repeat(lengths, lengths) - self.offset
        #: Words of the window that begins here; 0 where too few are left.
        self.window = np.where(self.left >= np.minimum(np.repeat(lengths, lengths), window), np.minimum(np.repeat(lengths, lengths), window), 0)
        self.shortest = int(self.window[self.window > 0].min()) if len(self.words) else 0


def suffix_array(seq: np.ndarray, run: np.ndarray, least: int, bits: int) -> np.ndarray:
    """Starts of all suffixes of at least `least` words, in the order of their words; run: words up to the suffix's end."""
    order = np.flatnonzero(run >= least)
    group, depth, per = np.zeros(len(order), np.int64), 0, max(1, 62 // bits)
    tied = np.arange(len(order))
    while len(tied) > 1:
        start, key = order[tied], np.zeros(len(tied), np.int64)
        for d in range(depth, depth + per):
            key = (key << bits) | np.where(run[start] > d, seq[np.minimum(start + d, len(seq) - 1)], 0)
        # Of equal keys those that end here sort first: they leave the tie below and keep their places.
        by = np.lexsort((run[start] > depth + per, key, group[tied]))
        start, key, g = start[by], key[by], group[tied]
        order[tied] = start
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (key[1:] != key[:-1])))
        group[tied] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        depth += per
        lone = new & np.concatenate((new[1:], [True]))
        tied = tied[~lone & (run[start] > depth)] if len(tied) else tied
    return order


def search(block: Block, seq: np.ndarray, run: np.ndarray, array: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix, from, to) for each window found: array[from:to] are its places."""
    live = np.flatnonzero(block.window > 0)
    low, high = np.zeros(len(live), np.int64), np.full(len(live), len(array), np.int64)
    found, depth = [], 0
    last = len(seq) - 1

    def bisect(lo, hi, want, right):
        lo, hi = lo.copy(), hi.copy()
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) >> 1
            at = array[mid]
            word = np.where(run[at] > depth, seq[np.minimum(at + depth, last)], 0)
            less = word <= want[open_] if right else word < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        return lo

    while len(live):
        want = block.words[live + depth]
        lo, hi = bisect(low, high, want, False), bisect(low, high, want, True)
        some = hi > lo
        live, low, high, depth = live[some], lo[some], hi[some], depth + 1
        whole = block.window[live] == depth
        found.append((live[whole], low[whole], high[whole]))
        live, low, high = live[~whole], low[~whole], high[~whole]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def runs_of(block: Block, places: np.ndarray, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, suffix, words) of each longest match: windows one after the other in the text and in one item."""
    by = np.lexsort((places, places - suffixes))
    at, of = places[by], suffixes[by]
    new = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1] + 1) | (block.offset[of[1:]] == 0))) if len(by) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(by)])).astype(np.int64) - 1 if len(first) else first
    return at[first], of[first], at[last] - at[first] + block.window[of[first]]


def _shard(texts: list[bytes], block: Block):
    """Word numbers of all texts with a 0 after each, where each text begins, and the array over them."""
    get, parts, counts = block.vocabulary.get, [], []
    for t in texts:
        ws = words_of(t)
        counts.append(len(ws))
        parts.append(np.fromiter(map(get, ws, repeat(0)), np.int32, len(ws)))
        parts.append(np.zeros(1, np.int32))
    seq = np.concatenate(parts) if parts else np.zeros(1, np.int32)
    zero = np.where(seq == 0, np.arange(len(seq)), len(seq))
    run = np.minimum.accumulate(zero[::-1])[::-1] - np.arange(len(seq))
    counts = np.array(counts, np.int64)
    begin = np.cumsum(counts + 1) - counts - 1
    bits = max(1, math.ceil(math.log2(len(block.vocabulary) + 2)))
    array = suffix_array(seq, run, max(1, block.shortest), bits) if block.shortest else np.zeros(0, np.int64)
    return seq, run, begin, counts, array


def _expand(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers of the given ranges, one range after the other."""
    sizes = high - low
    return np.arange(sizes.sum()) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)


class Blocks:
    """The blocks of a benchmark, as workers get them: one by broadcast, or several as files."""

    def __init__(self, broadcast=None, uris: tuple[str, ...] = (), shard_bytes: int = SHARD_BYTES) -> None:
        self.broadcast, self.uris, self.shard_bytes = broadcast, uris, shard_bytes

    def __iter__(self):
        if self.broadcast is not None:
            yield self.broadcast.value
        for uri in self.uris:
            store, path = pa.fs.FileSystem.from_uri(uri)
            with store.open_input_stream(path) as f:
                yield pickle.loads(f.read())


def _blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Blocks:
    """The benchmark in blocks of about block_bytes each, at most; the driver holds one at a time."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.col("text").cast("binary").alias("text")).filter(
        F.octet_length("text") > 0
    )
    spark = benchmark.sparkSession
    n = max(1, math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / block_bytes))
    made = lambda own: Block([(r.name, bytes(r.text)) for r in own.toLocalIterator()], window)
    if n == 1:
        return Blocks(spark.sparkContext.broadcast(made(items)))
    folder = new_path(spark, "benchmark")
    store, path = pa.fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    for i in range(n):
        with store.open_output_stream(f"{path}/block-{i:05d}") as f:
            f.write(pickle.dumps(made(items.filter(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == i))))
    return Blocks(None, tuple(f"{folder}/block-{i:05d}" for i in range(n)), max(SHARD_BYTES, block_bytes))


def _gathered(batches, blocks: Blocks):
    """The batches as they are, or, where every shard means reading all blocks again, as few large ones."""
    if blocks.broadcast is not None:
        yield from batches
        return
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= blocks.shard_bytes:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _found(texts: list[bytes], blocks: Blocks):
    """For texts: counts of words, flags of hit words, where each text's begin, and the longest matches (text, item, place in both, words)."""
    hit, matches, counts, begin = None, [], None, None
    for block in blocks:
        seq, to_end, begin, counts, array = _shard(texts, block)
        suffix, low, high = search(block, seq, to_end, array)
        places, of = array[_expand(low, high)], np.repeat(suffix, high - low)
        edge = np.zeros(len(seq) + 1, np.int64)
        np.add.at(edge, places, 1)
        np.add.at(edge, places + block.window[of], -1)
        own = np.cumsum(edge)[:-1] > 0
        hit = own if hit is None else hit | own
        at, first, n = runs_of(block, places, of)
        doc = np.searchsorted(begin, at, "right") - 1
        names = block.names
        matches += [(d, names[i], p, o, w) for d, i, p, o, w in zip(doc.tolist(), block.item[first].tolist(), (at - begin[doc]).tolist(), block.offset[first].tolist(), n.tolist(), strict=True)]
    return counts, hit, begin, sorted(set(matches))


def _mark(blocks: Blocks):
    def run(batches):
        exclusive("decontaminate")
        for batch in _gathered(batches, blocks):
            texts = text_bytes(batch.column(1))
            for a, b in chunks(texts, blocks.shard_bytes):
                counts, hit, begin, matches = _found(texts[a:b], blocks)
                total = np.concatenate(([0], np.cumsum(hit)))
                n_hit = total[begin + counts] - total[begin]
                names: list[list[str]] = [[] for _ in range(b - a)]
                best: list[tuple | None] = [None] * (b - a)
                for d, name, p, o, w in matches:
                    if not names[d] or names[d][-1] != name:
                        names[d].append(name)
                    best[d] = min(best[d] or (0,), (-w, p, name, o))
                digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(counts), pa.array(n_hit), pa.array([len(x) for x in names], pa.int64()),
                        pa.array(digests, pa.string()), pa.array(n_hit > 0), pa.array([-x[0] if x else 0 for x in best], pa.int64()), pa.array([x and x[2] for x in best], pa.string()),
                        pa.array([x and x[1] for x in best], pa.int64()), pa.array([x and x[3] for x in best], pa.int64()),
                    ],
                    ["doc_id", "row", *_MADE],
                )

    return run


_MADE = {
    "n_words": "long", "n_hit": "long", "n_items": "long", "items_sha256": "string", "contaminated": "boolean",
    "longest_words": "long", "longest_item": "string", "longest_doc_word": "long", "longest_item_word": "long",
}


def _judged(docs: DataFrame, carried: list[str], benchmark: DataFrame, window: int, block_bytes: int) -> DataFrame:
    """doc_id, row (a struct of the carried columns) and the verdict's columns."""
    workers_can_import(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in carried]) if carried else F.struct(F.lit(0).alias("none"))
    out = docs.select("doc_id", F.col("text").cast("string").alias("text"), row.alias("row"))
    kind, row_kind = (out.schema[c].dataType.simpleString() for c in ("doc_id", "row"))
    schema = ", ".join([f"doc_id {kind}", f"row {row_kind}", *(f"{c} {k}" for c, k in _MADE.items())])
    return map_arrow(out, _mark(_blocks(benchmark, window, block_bytes)), schema)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each row of docs (doc_id, text): n_words, n_hit, n_items, items_sha256, contaminated, and the longest match with its item and places."""
    return _judged(docs, [], benchmark, window, block_bytes).drop("row")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns."""
    return _judged(docs, docs.columns, benchmark, window, block_bytes).filter("not contaminated").select("row.*")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, n_words): every verbatim match of a window or more that cannot be made longer."""
    blocks = _blocks(benchmark, window, block_bytes)

    def scan(batches):
        for batch in _gathered(batches, blocks):
            ids, texts = batch.column(0), text_bytes(batch.column(1))
            for a, b in chunks(texts, blocks.shard_bytes):
                if rows := _found(texts[a:b], blocks)[3]:
                    doc, item, p, o, w = zip(*rows, strict=True)
                    columns = [pa.array(c, k) for c, k in ((item, pa.string()), (p, pa.int64()), (o, pa.int64()), (w, pa.int64()))]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array([a + d for d in doc])), *columns], ["doc_id", "item_id", "doc_word", "item_word", "n_words"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(texts, scan, "doc_id long, item_id string, doc_word long, item_word long, n_words long")
