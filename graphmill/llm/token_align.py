"""Alignment of two tokenizers: which tokens of each cover the same bytes, and how common each pair is.

A: a byte-level tokenizer file, given a space and the text.  B: a sentencepiece model with byte fallback, given the
text, before which it puts a space itself.  Tokens become intervals of bytes; those of A and B that overlap are linked,
and the offsets where both end cut them into groups.

Texts are cut into units before a space or newline that follows a character and precedes one, none of them white
space.  No token of A or B spans such a place (for B that is read from its pieces; where it does not hold, texts are
units), so a unit has the same tokens wherever it stands.  DuckDB, inside each Arrow partition, holds the interval
tables of the units of a batch: an as-of join gives for each token of A the token of B in which it begins, a range
join those that begin inside it, and sums over windows number the groups.  Units are remembered from batch to batch, so
that work is done once; the tokens of a text are those of its units, which DuckDB joins and adds up.

The pairs that each document holds are written, with the partial counts of the batch beside them; Spark merges the
partial counts, finds the highest of each id of A, and brings both back to the documents.  The merged counts are
broadcast if they are measured to be small, else the pairs are dealt out by key, common ones salted.

Null and empty texts, and texts of which the tokens of A or B are other bytes than the space and the text (those with
U+2581, for instance), have no tokens: zeros and an empty groups_sha256; they hold no pair.  Strings of special tokens
are text.  Rows that are equal or repeat an id are documents of their own, a null id stays null, an empty table gives an
empty result, extra columns, whatever their names, are ignored.  A text is taken whole; a very long one without a place
to cut is one unit.  Batches are worked off in parts of PART characters.
"""

from __future__ import annotations

import os
import re
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import exclusive, lookup_join, map_arrow, materialize

#: Characters that are worked off at once, and units that a worker remembers.
PART, REMEMBERED = 1 << 21, 600_000
#: A pair is one number: the id of A times WIDE plus that of B.
WIDE = 1 << 20
SPACE = "▁"
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")

# Intervals of all units lie one after the other, so positions alone tell units apart.
STEPS = (
    "CREATE OR REPLACE TEMP TABLE a AS FROM a_now",
    "CREATE OR REPLACE TEMP TABLE b AS FROM b_now",
    # The token of B in which each token of A begins, and, where it ends before A's does, those that begin inside.
    "CREATE OR REPLACE TEMP TABLE met AS SELECT a.u, a.id AS id_a, a.s, a.e, b.id AS id_b, b.e AS to_b FROM a ASOF JOIN b ON a.s >= b.s",
    f"""CREATE OR REPLACE TEMP TABLE links AS SELECT u, id_a * {WIDE} + id_b AS pair FROM met
UNION ALL SELECT a.u, id_a * {WIDE} + b.id FROM (SELECT * FROM met WHERE to_b < e) a JOIN b ON b.s >= a.to_b AND b.s < a.e""",
    "CREATE OR REPLACE TEMP TABLE meet AS SELECT e FROM a SEMI JOIN b USING (e)",
    # A token's group is the number of places before it where tokens of both end.
    "CREATE OR REPLACE TEMP TABLE grouped AS "
    + " UNION ALL ".join(f"""SELECT {side} AS side, u, id, s, coalesce(sum((meet.e IS NOT NULL)::INT) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS g
FROM {x} LEFT JOIN meet USING (e)""" for side, x in enumerate("ab")),
    "CREATE OR REPLACE TEMP TABLE made AS SELECT u, count(*) FILTER (side = 0) AS n_a, count(*) FILTER (side = 1) AS n_b, max(g) - min(g) + 1 AS n_groups FROM grouped GROUP BY u",
    "INSERT INTO unit_pairs SELECT u, pair, count(*) FROM links GROUP BY u, pair",
    "INSERT INTO units SELECT u, n_a, n_b, n_groups, n FROM made JOIN (SELECT u, count(*) AS n FROM links GROUP BY u) USING (u)",
)
TABLES = """CREATE OR REPLACE TABLE units (u INTEGER, n_a BIGINT, n_b BIGINT, n_groups BIGINT, n_links BIGINT);
CREATE OR REPLACE TABLE unit_pairs (u INTEGER, pair BIGINT, m BIGINT)"""
ORDERED = "SELECT u, side, id, g FROM grouped ORDER BY g, side, s"
HELD = "CREATE OR REPLACE TEMP TABLE held AS SELECT d, u, count(*) AS n FROM every GROUP BY d, u"
SUMS = """SELECT d, sum(n * n_a)::BIGINT AS n_a, sum(n * n_b)::BIGINT AS n_b, sum(n * n_groups)::BIGINT AS n_groups, sum(n * n_links)::BIGINT AS n_links
FROM held JOIN units USING (u) GROUP BY d"""
PAIRS = "SELECT d, pair, sum(n * m)::BIGINT AS m FROM held JOIN unit_pairs USING (u) GROUP BY d, pair ORDER BY d, pair"


class Tokenizers:
    """Both tokenizers: ids of a unit, and the bytes of an id."""

    def __init__(self, a: str, b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        # Byte-level vocabularies write printable Latin-1 bytes as themselves and the others, in order, from U+0100 on.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(x): x for x in plain} | {chr(0x100 + n): x for n, x in enumerate(x for x in range(256) if x not in plain)}
        self.a_bytes = {i: bytes(byte_of.get(c, 0) for c in t) for t, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        normal = [p for i, p in enumerate(pieces) if not self.b.is_byte(i)]
        self.begins = next(i for i, p in enumerate(pieces) if p == SPACE)
        self.can_cut = not any("\n" in p or SPACE in p.lstrip(SPACE) for p in normal)

    def units(self, text: str) -> list[str]:
        """A space and the text, cut where no token can span."""
        return _CUT.split(" " + text) if self.can_cut else [" " + text]

    def _ids(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of A and of B for a unit, or units one after the other, that begin with a space or newline."""
        x = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        # B puts a space before: instead of the text's own, or as a token to be taken off.
        y = self.b.encode(text[1:] if text[0] == " " else text)
        return x, [self.begins] if text == " " else y if text[0] == " " else y[1:]

    def same(self, text: str, x: list[int], y: list[int]) -> bool:
        raw = text.encode()
        return b"".join([self.a_bytes[i] for i in x]) == raw and b"".join([self.b_bytes[i] for i in y]) == raw

    def encode(self, units: list[str]) -> tuple[list[str], list[int], list[int]]:
        """The units whose tokens are their bytes, first those that were encoded side by side, and the ids of A and of B for all of these."""
        plain = [u for u in units if self.can_cut and not u[1:2].isspace() and not u[-1].isspace()]
        chunks = [plain[k : k + 4096] for k in range(0, len(plain), 4096)]
        chunks += [[u] for u in set(units).difference(plain)]
        kept: list[str] = []
        of_a: list[int] = []
        of_b: list[int] = []
        while chunks:
            some = chunks.pop(0)
            text = "".join(some)
            x, y = self._ids(text)
            if self.same(text, x, y):
                kept += some
                of_a += x
                of_b += y
            elif len(some) > 1:
                # Halves, until the units that do not come back as they are stand alone.
                chunks += [some[: len(some) // 2], some[len(some) // 2 :]]
        return kept, of_a, of_b


def _intervals(ids: list[int], ends: np.ndarray, numbers: np.ndarray, size: np.ndarray) -> pa.Table:
    """(u, id, s, e) of the tokens that fill units that end at ends, one after the other."""
    flat = np.array(ids, np.int64)
    end = np.cumsum(size[flat])
    begin = end - size[flat]
    return pa.table({"u": numbers[np.searchsorted(ends, begin, "right")], "id": flat, "s": begin, "e": end})


def written(tokens: pa.Table) -> list[str]:
    """The groups of each unit as text, from its tokens in order of group, side and place."""
    u, g, side = (tokens[c].to_numpy() for c in ("u", "g", "side"))
    # What follows a token: one of its group and side, one of its group, one of its unit, or nothing.
    after = np.where(g[1:] != g[:-1], np.where(u[1:] != u[:-1], 3, 2), side[1:] != side[:-1])
    marks = list(map((",", "|", ";", "\n").__getitem__, [*after.tolist(), 3]))
    return "".join([x for both in zip(map(str, tokens["id"].to_pylist()), marks, strict=True) for x in both]).split("\n")[:-1]


def known_as(unit: str) -> str:
    """A unit's name: without its space, unless white space follows it."""
    return unit[1:] if unit[0] == " " and len(unit) > 1 and not unit[1].isspace() else unit


def unit_of(name: str) -> str:
    return name if name[0] in " \n" else " " + name


class Aligner:
    """A worker's units so far, as tables of its DuckDB."""

    def __init__(self, a: str, b: str) -> None:
        import duckdb

        self.tokenizers = Tokenizers(a, b)
        self.sizes = (np.zeros(max(self.tokenizers.a_bytes) + 1, np.int64), np.array([len(x) for x in self.tokenizers.b_bytes]))
        for i, raw in self.tokenizers.a_bytes.items():
            self.sizes[0][i] = len(raw)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "700MB"})
        self.forget()

    def forget(self) -> None:
        self.con.execute(TABLES)
        self.known: dict[str, int] = {}
        self.groups: list[str | None] = []

    def learn(self, new: list[str]) -> None:
        """Align units that were not met before."""
        first = len(self.groups)
        self.known.update(zip(new, range(first, first + len(new)), strict=True))
        self.groups += [None] * len(new)
        names = dict(zip(map(unit_of, new), range(first, len(self.groups)), strict=True))
        good, of_a, of_b = self.tokenizers.encode(list(names))
        if not good:
            return
        ends = np.cumsum([len(u.encode()) for u in good])
        numbers = np.array(list(map(names.__getitem__, good)), np.int32)
        con = self.con
        con.register("a_now", _intervals(of_a, ends, numbers, self.sizes[0]))
        con.register("b_now", _intervals(of_b, ends, numbers, self.sizes[1]))
        for statement in STEPS:
            con.execute(statement)
        for u, text in zip(numbers.tolist(), written(con.sql(ORDERED).to_arrow_table()), strict=True):
            self.groups[u] = text

    def numbers_of(self, texts: list[str]) -> list[list[int]]:
        """The units of each text, by number, all of them learnt."""
        get, can_cut, cut, new = self.known.get, self.tokenizers.can_cut, [], {}
        for t in texts:
            # Words between spaces and newlines are the units, but where white space meets white space.
            units = t.replace("\n", " \n").split(" ") if t and can_cut else []
            numbers = list(map(get, units))
            unknown = None in numbers or not units
            if t and unknown:
                lacking = [u for u, n in zip(units, numbers, strict=True) if n is None]
                if not units or any(not u or u[-1].isspace() or u[u[0] == "\n"].isspace() for u in lacking):
                    units = [known_as(u) for u in self.tokenizers.units(t)]
                    numbers = list(map(get, units))
                    lacking = [u for u, n in zip(units, numbers, strict=True) if n is None]
                new.update(dict.fromkeys(lacking))
            cut.append((units, numbers) if unknown else (None, numbers))
        if new:
            self.learn(list(new))
        return [numbers if units is None else list(map(get, units)) for units, numbers in cut]

    def align(self, texts: list[str]) -> tuple[dict[str, np.ndarray], list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Sums for each text, its groups' digest, and its pairs: the text's number, the pair, how many links."""
        if len(self.known) > REMEMBERED:
            self.forget()
        digests, at, held = [], [], []
        group = self.groups.__getitem__
        for d, numbers in enumerate(self.numbers_of(texts)):
            parts = list(map(group, numbers))
            if not parts or None in parts:
                digests.append("")
                continue
            digests.append(sha256(";".join(parts).encode()).hexdigest())
            at.append(np.full(len(numbers), d, np.int32))
            held.append(np.array(numbers, np.int32))
        sums = {c: np.zeros(len(texts), np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
        none = np.zeros(0, np.int64)
        if not held:
            return sums, digests, none, none, none
        self.con.register("every", pa.table({"d": np.concatenate(at), "u": np.concatenate(held)}))
        self.con.execute(HELD)
        found = self.con.sql(SUMS).to_arrow_table()
        for c, values in sums.items():
            values[found["d"].to_numpy()] = found[c].to_numpy()
        pairs = self.con.sql(PAIRS).to_arrow_table()
        return sums, digests, pairs["d"].to_numpy(), pairs["pair"].to_numpy(), pairs["m"].to_numpy()


_ALIGNERS: dict[tuple[str, str], Aligner] = {}
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<int>, part_pairs array<long>, part_docs array<int>"


def _parts(texts: list[str | None]):
    """Slices of a batch that hold PART characters or one text."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > PART:
            yield a, i
            a, size = i, 0
        size += len(t or "") + 1
    if a < len(texts):
        yield a, len(texts)


def _align(a: str, b: str):
    def run(batches):
        exclusive("token_align", _ALIGNERS)
        if (a, b) not in _ALIGNERS:
            _ALIGNERS[a, b] = Aligner(a, b)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in _parts(texts):
                sums, digests, d, pair, m = _ALIGNERS[a, b].align([t or "" for t in texts[lo:hi]])
                n = hi - lo
                offsets = pa.array(np.searchsorted(d, np.arange(n + 1)).astype(np.int32))
                distinct, docs = np.unique(pair, return_counts=True)
                # The partial counts of these documents stand in the first of their rows.
                once = pa.array([0] + [len(distinct)] * n, pa.int32())
                columns = [
                    batch.column(0).slice(lo, n), *[pa.array(sums[c]) for c in ("n_a", "n_b", "n_groups", "n_links")], pa.array(digests, pa.string()),
                    pa.ListArray.from_arrays(offsets, pa.array(pair, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(m.astype(np.int32))),
                    pa.ListArray.from_arrays(once, pa.array(distinct, pa.int64())), pa.ListArray.from_arrays(once, pa.array(docs.astype(np.int32))),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ALIGNED.split(", ")])

    return run


def aligned(docs: DataFrame, a: str, b: str) -> DataFrame:
    """A written table of each row's sums, digest, pairs and links of each pair, and of partial counts of pairs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(map_arrow(rows, _align(a, b), ALIGNED), "aligned")


def pair_counts(table: DataFrame) -> DataFrame:
    """(pair, id_a, id_b, docs, best): how many documents hold each pair, and whether no other pair of its id of A has more; written."""
    parts = table.select(F.explode(F.arrays_zip("part_pairs", "part_docs")).alias("p"))
    counts = parts.groupBy(F.col("p.part_pairs").alias("pair")).agg(F.sum("p.part_docs").alias("docs"))
    counts = materialize(counts.withColumn("id_a", F.floor(F.col("pair") / WIDE)), "pair-counts")
    # At most one row for each id of A's vocabulary, and a pair's row for each of them that B has for it.
    highest = counts.groupBy("id_a").agg(F.max("docs").alias("most"))
    return materialize(counts.join(highest, "id_a").select("pair", "id_a", F.pmod("pair", F.lit(WIDE)).alias("id_b"), "docs", (F.col("docs") == F.col("most")).alias("best")), "pair-bests")


def alignment(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of docs (doc_id, text)."""
    table = aligned(docs, a, b)
    # Both in one number, the lowest bit for best.
    facts = pair_counts(table).select("pair", (F.col("docs") * 2 + F.col("best").cast("int")).alias("fact"))
    sums = ["n_a", "n_b", "n_groups", "n_links"]
    rows = table.select("doc_id", *sums, "groups_sha256", "pairs", "links").withColumn("row", F.monotonically_increasing_id())
    each = rows.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.links").alias("m"))
    found = lookup_join(each, facts, ["pair"], "inner")
    m = F.col("m").cast("long")
    found = found.groupBy("row").agg(F.sum(m * (F.col("fact") % 2)).alias("n_best"), F.sum(m * F.floor(F.col("fact") / 2)).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.join(found, "row", "left").select("doc_id", *sums, zero("n_best"), zero("count_sum"), "groups_sha256")
