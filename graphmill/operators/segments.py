"""A search index that is kept current: layers of postings by document, as graphmill.operators.layers has them.

How many documents there are and how long they are together is added up over layers, so scores are those of an index
built anew.  A change writes the postings of its documents and the ids that they replace, and reads no text but theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.operators.layers import Layers
from graphmill.operators.search import Index, build_index


class Segments(Layers):
    """An index below path, of some columns of documents that key tells apart.

    Documents of one key in one change are one: the one whose columns sort last.  A null key is no document.
    """

    # Sorted by term, so that a query reads the row groups of its words.
    tables = {"postings": ("id", ("term", "id")), "positions": ("id", ("term", "id")), "lengths": ("id", ())}
    counted = "lengths"

    def __init__(self, spark: SparkSession, path: str, fields: list[str], key: str = "id") -> None:
        super().__init__(spark, path)
        self.fields, self.key = fields, key

    def weight(self) -> Column:
        return F.col("length")

    def _tables(self, docs: DataFrame) -> dict[str, DataFrame]:
        columns = [F.col(c).cast("string").alias(c) for c in self.fields]
        one = docs.filter(F.col(self.key).isNotNull()).groupBy(F.col(self.key).alias("id")).agg(F.max(F.struct(*columns)).alias("d"))
        index = build_index(one.select("id", "d.*"), self.fields)
        return {name: getattr(index, name) for name in self.tables}

    def create(self, docs: DataFrame) -> None:
        self.start(self._tables(docs))

    def apply(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> int:
        """Put documents in the place of those of their ids, and remove ids; the new version."""
        gone = None if deletes is None else deletes.select(F.col(self.key).alias("id"))
        return self.change(None if upserts is None else self._tables(upserts), gone)

    def index(self, version: int | None = None) -> Index:
        """The index of a version, for search: what is dead is left out, and statistics are sums over layers."""
        rows = self.manifest(version)
        n = sum(r["n"] - r["dead"] for r in rows)
        total = sum(r["total"] - r["dead_total"] for r in rows)
        stats = self.spark.createDataFrame([(n, total / n if n else None)], "n long, avg_length double")
        return Index(*[self._living(rows, name).drop("high") for name in ("postings", "lengths")], stats, self._living(rows, "positions").drop("high"))
