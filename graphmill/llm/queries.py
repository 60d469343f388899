"""The thin queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.llm import oracle
from graphmill.llm.common import table
from graphmill.llm.decontaminate import contamination
from graphmill.llm.language_id import held_out, identify, learnable
from graphmill.llm.license_scan import scan
from graphmill.llm.line_winnow import LONG, line_matches
from graphmill.llm.media_avi import media_round_trip
from graphmill.llm.merkle import verified_manifest
from graphmill.llm.minhash import near_duplicates
from graphmill.llm.mix_weights import SWEEPS, mixed
from graphmill.llm.token_align import alignment
from graphmill.llm.token_bin import tokenized
from graphmill.llm.token_count import token_counts
from graphmill.llm.unit_dedup import removals
from graphmill.llm.url_filter import filtered

# The rules of op3.
URL_RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer's vocabulary; the files are no part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # The label goes to the model alone; what is predicted from holds ids and texts.
    return identify(docs.select("doc_id", "text"), learnable(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_media_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op4_token_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_line_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_matches(table(spark, sf_dir, "documents"), long_words=LONG)
    match = lambda m: F.format_string("%d-%d=%s:%d", m["line"], m["end_line"], m["source_doc"].cast("string"), m["source_line"])
    by_place = F.transform(F.array_sort(F.transform("matches", lambda m: F.struct(m["line"], m["end_line"], m["source_doc"], m["source_line"]))), match)
    return out.withColumn("matches", F.array_join(by_place, ",")).withColumn("repeated", F.col("n_deleted") > 0)


def op6_mix_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    # As many sweeps as the SQL writes out, whether or not more would come nearer.
    out = mixed(table(spark, sf_dir, "documents"), most=SWEEPS)
    named = {c: F.coalesce(c, F.lit("unknown")) for c in ("source", "lang")}
    return out.withColumns(named).select("doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 9).alias("weight"), F.round("p", 6).alias("p"), "kept")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = removals(table(spark, sf_dir, "documents"))
    return out.withColumn("spans", F.array_join(F.transform("spans", lambda s: F.format_string("%d-%d", s["start"], s["end"])), ",")).withColumn("repeated", F.col("n_removed") > 0)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("spans")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op12_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified_manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_media_avi": op2_media_avi,
    "op3_url_filter": op3_url_filter,
    "op4_token_bin": op4_token_bin,
    "op5_line_winnow": op5_line_winnow,
    "op6_mix_weights": op6_mix_weights,
    "op7_decontaminate": op7_decontaminate,
    "op8_unit_dedup": op8_unit_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_minhash": op10_minhash,
    "op11_token_align": op11_token_align,
    "op12_token_count": op12_token_count,
    "op13_merkle": op13_merkle,
}
SQL: dict[str, str] = oracle.SQL
