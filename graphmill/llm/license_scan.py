"""License scan by diagonal voting.

All rolling word k-gram hashes of every text are joined, by Spark, with the positions that they have in templates; a
hit counts only if the words are equal too.  Hits of a template are counted by diagonal (text position less
template position), neighbouring diagonals are merged so that insertions and changes do not break a match, and
each span is verified: the share of the template's k-grams that stand in it, each counted once, and its length.
Phrases use pairs of words, and a place of a phrase is a diagonal on which all its pairs are; notices and license
texts use runs of four words.

The hashes of a text meet the templates' where they are made: the table of templates is broadcast, in blocks of at
most common.BROADCAST_BYTES, so only hits are ever written or shuffled.  Only DataFrame functions are used.

Null texts are empty: no words, no labels, score 0.  Repeated rows are scanned one by one, whatever their ids.  A very
long text is one row with 8 bytes for each of its hashes.  An empty table gives an empty one.  Other columns are ignored.
Templates that repeat count once for each label; labels and spans are sorted, so ties do not matter.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphmill.llm import common
from graphmill.llm.common import empty_if_null, lookup_join, lower_ascii, materialize, measured_bytes
from graphmill.llm.license_texts import TEXTS

PAIR, RUN = 2, 4
#: Diagonals that are so near to each other are one match: so many words, or one in so many of the template's.
NEAR, NEAR_SHARE = 3, 16
#: Share of a notice's runs that has to be found, and how much longer than the notice the found span may be.
COVER, STRETCH = 0.6, 1.5

# The phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Sentences by which licenses are granted.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
)
_WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands after a text's last hash, so that its row survives the join, and its template's number.
_END_HASH, _END = 0, -1
_SPANS = "array<struct<label:string,first_word:int,end_word:int,cover:double>>"


def _words(text: Column) -> Column:
    # lower() maps two characters beyond A-Z to ASCII letters as well; texts that hold them take the slower way.
    lowered = F.when(text.rlike("[\u0130\u212a]"), lower_ascii(text)).otherwise(F.lower(text))
    return F.array_remove(F.split(lowered, _WORD_BREAK), "")


def _rolling(hashes: Column, k: int) -> Column:
    """A hash of each k words in a row."""
    n = F.size(hashes)
    at = F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.lit(k), *[F.get(hashes, i + j) for j in range(k)]))


def _gram(words: Column, at: Column, k: int) -> Column:
    return F.array_join(F.slice(words, at + 1, k), " ")


def _templates(spark: SparkSession, phrases: Sequence[tuple[str, str]], texts: Sequence[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """(hash, places: template, at, gram), and (template, label, base, grams, words, near)."""
    rows = [(i, text, label, i < len(phrases)) for i, (text, label) in enumerate([*phrases, *texts])]
    given = spark.createDataFrame(rows, "template int, text string, label string, base boolean").select("*", _words(F.col("text")).alias("words"))
    hashed = given.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    parts = []
    for k, own in ((PAIR, F.col("base")), (RUN, ~F.col("base"))):
        part = hashed.filter(own).select("template", "words", F.posexplode(_rolling(F.col("h"), k)).alias("at", "hash"))
        parts.append(part.select("hash", F.struct("template", "at", _gram(F.col("words"), F.col("at"), k).alias("gram")).alias("place")))
    end = spark.createDataFrame([(_END_HASH, _END, 0, "")], "hash long, template int, at int, gram string").select("hash", F.struct("template", "at", "gram").alias("place"))
    places = materialize(parts[0].unionByName(parts[1]).unionByName(end).groupBy("hash").agg(F.collect_list("place").alias("places")), "templates")
    n = F.size("words")
    facts = given.select("template", "label", "base", (n - F.when(F.col("base"), PAIR).otherwise(RUN) + 1).alias("grams"), n.alias("words"), F.greatest(F.lit(NEAR), F.floor(n / NEAR_SHARE).cast("int")).alias("near"))
    return places, facts.filter("grams > 0")


def _hits(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(row, doc_id, template, pos, at): every k-gram of a template in a text, and for each row one of the template _END at its number of words."""
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), _words(empty_if_null(F.col("text").cast("string"))).alias("words"))
    blocks = max(1, math.ceil(measured_bytes(places) / common.BROADCAST_BYTES)) if common.BROADCAST_BYTES > 0 else 3
    if blocks > 1:
        rows = materialize(rows, "words")  # all blocks have to see the same numbers of rows
    hashed = rows.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    n = F.size("words")
    pairs, runs = F.greatest(n - PAIR + 1, F.lit(0)), F.greatest(n - RUN + 1, F.lit(0))
    grams = hashed.select("row", "doc_id", "words", F.posexplode(F.concat(_rolling(F.col("h"), PAIR), _rolling(F.col("h"), RUN), F.array(F.lit(_END_HASH).cast("long")))).alias("p", "hash"))
    is_end, pos = F.col("p") == pairs + runs, F.when(F.col("p") < pairs, F.col("p")).otherwise(F.col("p") - pairs)
    own = F.when(is_end, "").when(F.col("p") < pairs, _gram(F.col("words"), pos, PAIR)).otherwise(_gram(F.col("words"), pos, RUN))
    parts = []
    for b in range(blocks):
        block = places.filter(F.pmod(F.xxhash64("hash"), F.lit(blocks)) == b)
        met = grams.join(F.broadcast(block), "hash").select("row", "doc_id", F.when(is_end, n).otherwise(pos).alias("pos"), own.alias("own"), F.explode("places").alias("place"))
        parts.append(met.filter("own = place.gram").select("row", "doc_id", "place.template", "pos", "place.at"))
    return functools.reduce(DataFrame.unionByName, parts)


def scan(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str]] = (*NOTICES, *TEXTS)) -> DataFrame:
    """For each row of docs (doc_id, text): n_words, the places of phrases, labels, a score, and spans.

    spans: (label, first_word, end_word, cover) of each phrase's place and each notice or license text found.
    """
    places, facts = _templates(docs.sparkSession, phrases, notices)
    hits = materialize(_hits(docs, places), "hits")
    votes = hits.filter(F.col("template") != _END).groupBy("row", "template", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.collect_set("at").alias("ats"), F.min("pos").alias("from"), F.max("pos").alias("to")
    )
    votes = materialize(lookup_join(votes, materialize(facts, "facts"), ["template"], "inner"), "votes")
    by_place = votes.filter(F.col("base") & (F.size("ats") == F.col("grams")))
    places_of = by_place.groupBy("row").agg(
        F.count(F.lit(1)).alias("n_base"), F.min("diagonal").alias("first_word"), F.max("diagonal").alias("last_word"), F.collect_set("label").alias("base_set"),
        F.collect_set(F.struct("label", F.col("diagonal").alias("first_word"), (F.col("diagonal") + F.col("words")).alias("end_word"), F.lit(1.0).alias("cover"))).alias("base_spans"),
    )
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    gap = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > F.col("near")).cast("int"), F.lit(1))
    merged = (
        votes.filter(~F.col("base")).withColumn("gap", gap).withColumn("cluster", F.sum("gap").over(order))
        .groupBy("row", "template", "cluster", "label", "grams", "words")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("runs"), F.min("from").alias("from"), F.max("to").alias("to"))
        .withColumn("cover", F.col("runs") / F.col("grams"))
        .filter((F.col("cover") >= COVER) & (F.col("to") - F.col("from") + RUN <= STRETCH * F.col("words")))
    )
    found = merged.groupBy("row").agg(
        F.collect_set("label").alias("own_set"), F.max("cover").alias("cover"),
        F.collect_set(F.struct("label", F.col("from").alias("first_word"), (F.col("to") + RUN).alias("end_word"), "cover")).alias("own_spans"),
    )
    none, no_spans = F.array().cast("array<string>"), F.array().cast(_SPANS)
    rows = hits.filter(F.col("template") == _END).select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
    out = rows.join(places_of, "row", "left").join(found, "row", "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.coalesce("base_set", none)), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(F.coalesce("base_set", none), F.coalesce("own_set", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("cover", F.lit(0.0))).alias("score"),
        F.sort_array(F.concat(F.coalesce(F.col("base_spans").cast(_SPANS), no_spans), F.coalesce(F.col("own_spans").cast(_SPANS), no_spans))).alias("spans"),
    )
