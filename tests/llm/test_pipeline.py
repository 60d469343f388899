import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_dedup import brute
from test_text_operators import brute_contamination

import corpus_pipeline as P
from graphmill.llm import language_id, mix_weights
from graphmill.llm.queries import QUERIES, SQL, tokenizer_path

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_its_brute_force(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    groups = brute(list(rows.items()), 5)
    kept = {d: t for d, t in rows.items() if groups[d][1] == d}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    verdicts = brute_contamination(list(kept.items()), items)
    kept = {d: t for d, t in kept.items() if not verdicts[d][4]}
    assert 0 < len(kept) < len(rows)
    left = docs.filter(F.col("doc_id").isin(list(kept)))
    con = duckdb.connect()
    con.register("documents", left.toPandas())
    chosen = {r[0] for r in con.execute(f"SELECT doc_id FROM ({mix_weights.mixed_sql()}) WHERE kept").fetchall()}
    t = Tokenizer.from_file(tokenizer_path())
    at, want = 0, {}
    for d in sorted(chosen):
        ids = t.encode_batch([kept[d]], add_special_tokens=False)[0].ids + [2]
        want[d] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in P.run(spark, SF).collect()} == want


def test_stages_return_documents_and_take_odd_ones(spark, odd, nothing):
    for name, stage in P.STAGES[:-1]:
        for docs in (odd, nothing):
            assert stage(spark, docs, SF).columns == P.COLUMNS, name
    kept = P.identify_language(spark, odd, SF)
    assert {r.doc_id for r in odd.collect()} - {r.doc_id for r in kept.collect()} == {101, 102, 103, 104}
    assert P.drop_near_duplicates(spark, odd, SF).filter("doc_id is null").count() == 1


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(SQL[name])
    columns = [c[0] for c in cur.description]
    got = sorted(tuple(r[c] for c in columns) for r in QUERIES[name](spark, SF).collect())
    assert [repr(x) for x in got] == [repr(x) for x in sorted(cur.fetchall())]


def test_names():
    assert language_id.UNKNOWN == "und" and len(P.STAGES) == 5 and P.ORACLE_SQL is None and len(QUERIES) == 13
