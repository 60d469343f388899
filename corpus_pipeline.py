"""The corpus pipeline: language ID, near duplicates, decontamination, mixing and token files, one after the other.

Every stage takes all that its predecessor kept.  Its plan starts at that stage's table, so a lost executor
costs only tasks of the running stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.llm import decontaminate, language_id, minhash, mix_weights, token_bin
from graphmill.llm.common import materialize, table
from graphmill.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language.

    Those without letters go: null or empty texts, and texts of digits and signs.  Rows that are equal, or that
    repeat an id, are judged one by one; a null id, language or source changes nothing.  An empty table stays
    empty.  Only the columns of documents are read and returned, whatever else the table holds.
    """
    model_from = language_id.learnable(docs)
    return language_id.identify(docs.select(*COLUMNS), model_from).filter(F.col("lang_pred") != language_id.UNKNOWN).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles put together at a similarity of 0.8 or more.

    That is the one with the least id, of rows with one id that whose text has the least digest; rows without an id
    come last.  Of equal rows one stays.  Documents without words all stay.  Clashing columns are left out.
    """
    return minhash.without_near_duplicates(docs.select(*COLUMNS), k=5, percent=80)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window, or a whole shorter item, of the benchmark.

    Null and empty texts hold none and stay.  Rows are judged one by one, whatever their ids.  Clashing
    columns are left out.
    """
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by raked weights of source, language and topic.

    A null source or language is a margin of its own.  Equal rows, and rows of one id in one cell, are drawn
    together; a null id is drawn by its text.  Clashing columns are left out.
    """
    return mix_weights.mixed(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, and their index as read back.

    Null and empty texts are documents of the end id alone, a null id comes first and reads back as null, rows
    that repeat an id stand side by side, other columns are ignored, and an empty table gives an empty index.
    """
    return token_bin.tokenized(docs, tokenizer_path(), remembered=150_000)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]
#: No stage but mixing can be written in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
