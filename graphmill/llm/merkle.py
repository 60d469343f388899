"""Merkle manifest of a data set: a tree of digests for each group of rows, and one over the groups' roots.

A leaf is the digest of a row's fields, each written as its length in bytes, a colon and its value, or "-" where it is
null.  Leaves of a group are numbered by key, ties by digest; FANOUT neighbours become the digest of their digests as
hex text, level by level, until one is left.  The roots of the groups, in order of the group's name with null first,
are leaves of a tree of their own.

Superblocks: numbers are bucketed by FANOUT ** LEVELS, and one task collapses LEVELS levels of a bucket at once, so a
tree of n leaves takes log(n) / log(FANOUT ** LEVELS) rounds, each over the bucket roots of the one before.  Proofs
come down the same way: a bucket's members get their siblings within the bucket, followed by the proof of the bucket's
root, which is the upper part.  No task holds more than one bucket, whatever the size of a group, and no proof is
written but the bucket roots'.

Numbers are places in a range partition by group, key and digest: a row's place in its partition plus what the
partitions before hold of its group.  Written tables cut the lineage of each round.

A null or empty field is told apart ("-" and "0:").  A null key sorts first; a null group is a group of its own, also
first.  Rows that are equal have equal leaves and numbers next to each other; rows of one key with different fields are
ordered by their digests.  A very long text is digested in the scan, and only digests are shuffled.  An empty table has
no root and gives no rows.  Extra columns, whatever their names, do not enter the digests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.llm.common import lookup_join, lower_ascii, materialize, workers_can_import

#: Nodes that become one, and levels that a task collapses at once.
FANOUT, LEVELS = 8, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODES = "grp string, idx long, h string, n long"
#: For each level from the leaf up, the siblings left and right of a node, as hex text side by side.
PROOF = "array<struct<lefts:string,rights:string>>"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf(fields: list[Column]) -> Column:
    """The digest of a row's fields."""
    one = lambda v: F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return F.sha2(F.concat(*[one(f.cast("string")) for f in fields]), 256)


def _group(name: str) -> Column:
    """A group's name that is never null and sorts as the group does, null first."""
    return F.coalesce(F.concat(F.lit("1"), F.col(name).cast("string")), F.lit("0"))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Written rows (grp, ...) with idx, their place by order within grp, from 0, and n, how many grp has."""
    # Rows that are equal in all of these may be any way round; the place of reading parts them.
    ranged = rows.withColumn("__from", F.spark_partition_id()).repartitionByRange("grp", *order, "__from").sortWithinPartitions("grp", *order)
    placed = materialize(ranged.drop("__from").withColumn("__at", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    held = placed.groupBy("grp", "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    own = Window.partitionBy("grp")
    before = F.sum("__n").over(own.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    held = held.select("grp", "__part", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__n").over(own).alias("n"))
    held = materialize(held, f"{name}-held")
    return lookup_join(placed, held, ["grp", "__part"], "inner").withColumn("idx", F.col("__at") + F.col("__shift")).drop("__at", "__part", "__shift")


def levels_of(nodes: list[str], n: int, levels: int) -> Iterator[list[str]]:
    """Nodes of a bucket, and of each level above them within it; n: nodes of the whole group, as the last bucket is done when one is left."""
    yield nodes
    for _ in range(levels):
        if n == 1:
            return
        nodes, n = [digest("".join(nodes[a : a + FANOUT])) for a in range(0, len(nodes), FANOUT)], -(-n // FANOUT)
        yield nodes


def _collapse(levels: int) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        n, block = int(pdf["n"].iloc[0]), FANOUT**levels
        *_, top = levels_of(pdf["h"].tolist(), n, levels)
        return pd.DataFrame({"grp": [pdf["grp"].iloc[0]], "idx": [int(pdf["idx"].iloc[0]) // block], "h": top, "n": [-(-n // block)]})

    return run


def siblings(block: list[list[str]], place: int) -> list[tuple[str, str]]:
    """Of each level of a bucket but its top, the nodes left and right of the one that a place belongs to."""
    out = []
    for nodes in block[:-1]:
        a = place - place % FANOUT
        out.append(("".join(nodes[a:place]), "".join(nodes[place + 1 : a + FANOUT])))
        place //= FANOUT
    return out


def fold(h: str, proof: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for lefts, rights in proof:
        h = digest(lefts + h + rights)
    return h


def _down(columns: list[str], out: Callable, levels: int) -> Callable:
    """Members of a bucket with their siblings within it, followed by the proof of the bucket's root."""

    def run(members: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        members = members.sort_values("idx")
        above = [(p["lefts"], p["rights"]) for p in upper["proof"].iloc[0]]
        block = list(levels_of(members["h"].tolist(), int(members["n"].iloc[0]), levels))
        top = {c: upper[c].iloc[0] for c in ("subroot", "root")}
        rows = [out(m, siblings(block, place) + above, top) for place, m in enumerate(members.to_dict("records"))]
        return pd.DataFrame(rows, columns=columns)

    return run


def _bucket(levels: int) -> Column:
    return F.floor(F.col("idx") / F.lit(FANOUT**levels))


def _joined(members: DataFrame, uppers: DataFrame, out: Callable, schema: str, levels: int) -> DataFrame:
    columns = [c.split()[0] for c in schema.split(", ")]
    left = members.withColumn("bucket", _bucket(levels)).groupBy("grp", "bucket")
    right = uppers.withColumn("bucket", F.col("idx")).groupBy("grp", "bucket")
    return left.cogroup(right).applyInPandas(_down(columns, out, levels), schema)


_UPPER = f"grp string, idx long, proof {PROOF}, subroot string, root string"


def _proof_of(m: dict, proof: list[tuple[str, str]], top: dict) -> tuple:
    return m["grp"], m["idx"], [{"lefts": a, "rights": b} for a, b in proof], top["subroot"], top["root"]


@dataclass
class Manifest:
    """The numbered leaves (grp, idx, h, n and whatever else the rows have) and, for their buckets, the upper proofs."""

    leaves: DataFrame
    uppers: DataFrame
    levels: int

    def proofs(self) -> DataFrame:
        """(grp, idx, proof, subroot, root) of each leaf."""
        return _joined(self.leaves, self.uppers, _proof_of, _UPPER, self.levels)

    def checked(self, tampered: str) -> DataFrame:
        """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each leaf.

        tampered: a column with the leaf as it is found later, null where nothing was changed; it is folded with the
        siblings that the manifest has.
        """

        def out(m: dict, proof: list[tuple[str, str]], top: dict) -> tuple:
            found = fold(m["h"] if pd.isna(m[tampered]) else m[tampered], proof)
            return None if pd.isna(m["key"]) else m["key"], m["h"], top["subroot"], top["root"], digest("".join(a + b for a, b in proof)), found, found == top["root"]

        schema = "key string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        rows = _joined(self.leaves.withColumn("key", F.col("doc_id").cast("string")), self.uppers, out, schema, self.levels)
        return rows.select(F.col("key").cast("long").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _rounds(leaves: DataFrame, name: str, levels: int) -> list[DataFrame]:
    """The leaves (grp, idx, h, n), and the bucket roots of each round, up to one node for each group."""
    tables = [leaves]
    while (tables[-1].agg(F.max("n")).first()[0] or 1) > 1:
        nodes = tables[-1].select("grp", "idx", "h", "n")
        tables.append(materialize(nodes.groupBy("grp", _bucket(levels).alias("bucket")).applyInPandas(_collapse(levels), NODES), name))
    return tables


def _come_down(tables: list[DataFrame], top: DataFrame, name: str, levels: int) -> DataFrame:
    """Proofs of the roots of the lowest buckets, or of the groups' only leaves, from those of the groups' roots."""
    for nodes in reversed(tables[1:-1]):
        top = materialize(_joined(nodes, top, _proof_of, _UPPER, levels), name)
    return top


def manifest(rows: DataFrame, order: list[str], levels: int = LEVELS) -> Manifest:
    """The tree over rows (grp, h, the columns of order, ...)."""
    workers_can_import(rows.sparkSession)
    leaves = materialize(numbered(rows, order, "merkle-placed"), "merkle-leaves")
    tables = _rounds(leaves, "merkle-nodes", levels)
    # The groups' roots are the leaves of the upper tree, whose one group is "".
    roots = tables[-1].select(F.lit("").alias("grp"), F.col("grp").alias("of"), "h")
    over = materialize(numbered(roots, ["of"], "merkle-roots"), "merkle-over")
    upper = _rounds(over, "merkle-over-nodes", levels)
    none = F.array().cast(PROOF).alias("proof")
    top = upper[-1].select("grp", "idx", none, F.lit(None).cast("string").alias("subroot"), F.col("h").alias("root"))

    def named(m: dict, proof: list[tuple[str, str]], up: dict) -> tuple:
        return m["of"], 0, [{"lefts": a, "rights": b} for a, b in proof], m["h"], up["root"]

    subroots = materialize(_joined(over, _come_down(upper, top, "merkle-upper", levels), named, _UPPER, levels), "merkle-subroots")
    return Manifest(leaves, _come_down(tables, subroots, "merkle-proofs", levels), levels)


def documents_manifest(docs: DataFrame, tampered: Column | None = None) -> Manifest:
    """The manifest of docs by language; tampered: where given, rows whose text is found with A-Z in lower case."""
    fields = {f: F.col(f).cast("string") for f in FIELDS}
    rows = docs.select(_group("lang").alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf(list(fields.values())).alias("h"), F.when(F.lit(False) if tampered is None else tampered, leaf(list((fields | {"text": lower_ascii(fields["text"])}).values()))).alias("found"))
    # Digests are written before they are dealt out, as dealing by ranges reads its input twice.
    return manifest(materialize(rows, "merkle-digests"), ["doc_id", "h"])


def third_of_ids(doc_id: str = "doc_id") -> Column:
    """Where 3 divides the unsigned crc32 of the decimal id; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3).cast("long")) == 0, F.lit(False))


def verified_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of docs held against copies in which a third of the texts have lost their capitals."""
    return documents_manifest(docs, third_of_ids()).checked("found")
