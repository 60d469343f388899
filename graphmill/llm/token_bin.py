"""Token ids as flat unsigned-integer files with 64-bit document offsets.

Format, one triple of little-endian files for each shard, shards in ascending doc_id order:

* shard-NNNNN.bin  token ids, 16 bits wide where the vocabulary allows it, else 32
* shard-NNNNN.idx  n + 1 unsigned 64-bit offsets, in ids, of the shard's documents; the first is 0
* shard-NNNNN.doc  n signed 64-bit doc_ids

A range partition by doc_id, and within one id by a digest of the text, is a shard; there are as many as bytes of text
ask for (SHARD_BYTES).  Bases of the shards are prefix sums of their sizes, the only numbers that the driver sees.
Files are written under a name of the attempt and then renamed, so a task that runs again after a lost executor
replaces its files with equal ones.  Readers map local files to memory and read others by ranges.

Null or empty texts are documents of the end id alone.  A null doc_id sorts first and is stored as the least
64-bit integer, which reads back as null.  Rows that repeat a doc_id are documents of their own, next to
each other.  An empty table gives no files and an empty result.  A very long text is encoded whole.  Extra columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import math
import os
import uuid
import zlib
from contextlib import suppress
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.llm.common import exclusive, map_arrow, new_path, workers_can_import

END_ID = 2
NULL_ID = np.iinfo(np.int64).min
#: Text of a shard; and, where that gives fewer shards than spark.sql.shuffle.partitions, the least text worth one more.
SHARD_BYTES, LEAST_BYTES = 128 << 20, 4 << 20
#: Documents, and ids, that are read from a file at once.
READ_DOCS, READ_IDS = 4096, 4 << 20
#: Pieces of text whose ids a worker remembers.
REMEMBERED = 1_600_000


class Pieces:
    """Encodes by way of pieces that begin at a space or newline.

    A byte-level tokenizer cuts its input before a space or newline that follows anything but white space,
    so the pieces between such places are encoded independently, and most of them have been seen before.
    A text in which white space meets white space, that white space begins or ends, or that holds one of the
    tokenizer's added tokens as text is encoded whole.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        self.remembered = remembered
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # what is known here is never asked for again
        self.width = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.newline = self._whole("\n")
        self.size = len(self._pack([0]))
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token[:1] in ("\u0120", "\u010a")]] = True
        #: Ids of " piece", or of a piece that begins with a newline.
        self.known: dict[str, bytes] = {}
        self.marks = {m: self._whole(m) for m in ",."}
        self.by_pieces = len(self.newline) == self.size and self._whole("a b,\nb") == b"".join(map(self._whole, ("a", " b", ",", "\n", "b")))

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.width).tobytes()

    def _whole(self, text: str) -> bytes:
        return self._pack(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def _learn(self, new: list[str]) -> None:
        """Encode pieces one after the other: an id whose token begins with a space or newline begins a piece, as no piece has one inside."""
        for at in range(0, len(new), 512):
            some = new[at : at + 512]
            joined = "".join([p if p[0] == "\n" else " " + p for p in some])
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.width)
            cut = (np.flatnonzero(self.begins[ids]) * self.size).tolist()
            raw = ids.tobytes()
            for p, a, b in zip(some, cut, [*cut[1:], len(raw)], strict=True):
                self.known[p] = raw[a:b]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_pieces:
            return [self._whole(t) if t else b"" for t in texts]
        out: list[bytes] = [b""] * len(texts)
        get, lacking, new = self.known.get, [], set()
        for i, t in enumerate(texts):
            if not t:
                continue
            if any(a in t for a in self.added):
                out[i] = self._whole(t)
                continue
            pieces = t.replace("\n", " \n").split(" ")
            pieces[0] = "\n" + pieces[0]
            ids = list(map(get, pieces))
            if None in ids:
                gaps, at = [], -1
                with suppress(ValueError):
                    while True:
                        gaps.append(at := ids.index(None, at + 1))
                unknown = [pieces[g] for g in gaps]
                if any(not p or p[-1].isspace() or p[p[0] == "\n" :][0].isspace() for p in unknown):
                    out[i] = self._whole(t)
                else:
                    new.update(unknown)
                    lacking.append((i, ids, gaps, unknown))
            else:
                out[i] = b"".join(ids)[self.size :]
        if len(self.known) + 2 * len(new) > self.remembered:
            self.known.clear()
        # A comma or full stop after a letter is a token of its own; the word before it may be known already.
        ended = [p for p in new if p[-1] in self.marks and p[-2:-1].isalpha()]
        bare = {p[:-1] for p in ended}
        self._learn([p for p in (new.difference(ended) | bare) if p not in self.known])
        for p in ended:
            self.known[p] = self.known[p[:-1]] + self.marks[p[-1]]
        for i, ids, gaps, unknown in lacking:
            for g, p in zip(gaps, unknown, strict=True):
                ids[g] = self.known[p]
            out[i] = b"".join(ids)[self.size :]
        return out


_PIECES: dict[str, Pieces] = {}


def pieces_of(path: str, remembered: int = REMEMBERED) -> Pieces:
    """A worker's encoder, made once."""
    if path not in _PIECES:
        _PIECES[path] = Pieces(path, remembered)
    return _PIECES[path]


def _store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri)


def _write(uri: str, tokenizer: str, end_id: int, remembered: int):
    def run(batches):
        from pyspark import TaskContext

        exclusive("token_bin", _PIECES)
        shard = TaskContext.get().partitionId()
        store, folder = _store(uri)
        store.create_dir(folder, recursive=True)
        name = f"{folder}/shard-{shard:05d}"
        mine = f"{folder}/attempt-{uuid.uuid4().hex}"
        pieces = pieces_of(tokenizer, remembered)
        end = np.array([end_id], pieces.width).tobytes()
        at, docs = 0, 0
        with store.open_output_stream(f"{mine}.bin") as ids, store.open_output_stream(f"{mine}.idx") as idx, store.open_output_stream(f"{mine}.doc") as names:
            idx.write(np.zeros(1, "<u8").tobytes())
            for batch in batches:
                keys = batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
                column = batch.column(1)
                for a in range(0, len(keys), 512):
                    encoded = [e + end for e in pieces.encode([t or "" for t in column.slice(a, 512).to_pylist()])]
                    ids.write(b"".join(encoded))
                    ends = at + np.cumsum([len(e) // len(end) for e in encoded])
                    at = int(ends[-1])
                    idx.write(ends.astype("<u8").tobytes())
                    names.write(keys[a : a + 512].astype("<i8").tobytes())
                    docs += len(encoded)
        for kind in ("bin", "idx", "doc"):
            with suppress(FileNotFoundError):
                store.delete_file(f"{name}.{kind}")  # of an attempt whose executor was lost
            store.move(f"{mine}.{kind}", f"{name}.{kind}")
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (shard, docs, at, len(end))], ["shard", "docs", "ids", "width"])

    return run


def write_token_files(docs: DataFrame, uri: str, tokenizer: str, end_id: int = END_ID, remembered: int = REMEMBERED) -> list[dict]:
    """Write docs (doc_id, text) as shards under uri; what the shards hold, with the ids and documents before each."""
    workers_can_import(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16)).first()[0] or 0
    n = max(1, math.ceil(size / SHARD_BYTES), min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / LEAST_BYTES)))
    # Where rows of one id, or equal rows, are many, the text's digest and the place of reading part them.
    ordered = rows.withColumn("t", F.xxhash64("text")).withColumn("part", F.spark_partition_id())
    ordered = ordered.repartitionByRange(n, "doc_id", "t", "part").sortWithinPartitions("doc_id", "t").select("doc_id", "text")
    shards = sorted((r.asDict() for r in map_arrow(ordered, _write(uri, tokenizer, end_id, remembered), "shard long, docs long, ids long, width long").collect()), key=lambda s: s["shard"])
    shards = [s for s in shards if s["docs"]]
    for s, base, first in zip(shards, accumulate((s["ids"] for s in shards), initial=0), accumulate((s["docs"] for s in shards), initial=0), strict=False):
        s |= {"base": base, "first_doc": first}
    return shards


class Ranges:
    """A file of numbers of which ranges are read: mapped to memory where it is local."""

    def __init__(self, store: pa.fs.FileSystem, path: str, kind: str) -> None:
        self.kind = np.dtype(kind)
        self.mapped = np.memmap(path, self.kind, "r") if isinstance(store, pa.fs.LocalFileSystem) else None
        self.file = None if self.mapped is not None else store.open_input_file(path)

    def __getitem__(self, span: slice) -> np.ndarray:
        if self.mapped is not None:
            return np.asarray(self.mapped[span])
        return np.frombuffer(self.file.read_at((span.stop - span.start) * self.kind.itemsize, span.start * self.kind.itemsize), self.kind)


def _read(uri: str):
    def run(batches):
        store, folder = _store(uri)
        for batch in batches:
            for s in batch.to_pylist():
                name = f"{folder}/shard-{s['shard']:05d}"
                offsets, keys = Ranges(store, f"{name}.idx", "<u8"), Ranges(store, f"{name}.doc", "<i8")
                ids = Ranges(store, f"{name}.bin", f"<u{s['width']}")
                for a in range(0, s["docs"], READ_DOCS):
                    b = min(a + READ_DOCS, s["docs"])
                    o = offsets[a : b + 1].astype(np.int64)
                    crc, at = [], 0
                    while at < b - a:
                        # So many documents at once as READ_IDS allows, one at least.
                        to = max(at + 1, int(np.searchsorted(o, o[at] + READ_IDS, "right")) - 1)
                        wide = ids[int(o[at]) : int(o[to])].astype("<u4")
                        crc += [zlib.crc32(wide[x:y]) for x, y in zip(o[at:to] - o[at], o[at + 1 : to + 1] - o[at], strict=True)]
                        at = to
                    own = keys[a:b].astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, mask=own == NULL_ID), pa.array(o[:-1] + s["base"]), pa.array(np.diff(o)), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return run


def read_token_files(spark: SparkSession, uri: str, shards: list[dict]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files."""
    rows = [(s["shard"], s["docs"], s["base"], s["width"]) for s in shards]
    listed = spark.createDataFrame(rows, "shard long, docs long, base long, width long").repartition(max(1, len(rows)))
    return map_arrow(listed, _read(uri), "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = END_ID, uri: str | None = None, remembered: int = REMEMBERED) -> DataFrame:
    """Write docs as token files in the shared folder, or under uri, and return what reading them gives."""
    uri = uri or new_path(docs.sparkSession, "tokens")
    return read_token_files(docs.sparkSession, uri, write_token_files(docs, uri, tokenizer, end_id, remembered))
