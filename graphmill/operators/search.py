"""Full-text search: an inverted index as tables, BM25 scores, and the query syntax with its fallbacks."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.functions import scalars as S

K1, B = 1.2, 0.75
CORPORA = ("code", "config", "docs")
#: Confidence from which results are shown, by the shape of a query.
PLAIN_CONFIDENCE, EXACT_CONFIDENCE = 0.71, 0.0
#: Marks that stand by themselves after their letter.
MARKS = "[\u0300-\u036f]+"


def _folded(c: str) -> str | None:
    """The Latin letter that a small letter with marks is made of, or None."""
    letter, *marks = unicodedata.normalize("NFD", c)
    return letter if marks and "a" <= letter <= "z" and all("\u0300" <= m <= "\u036f" for m in marks) else None


#: Small Latin letters with marks, one or several, and what they become when the marks go.
FOLDED = {c: f for c in map(chr, range(0xC0, 0x1F00)) if c.islower() and (f := _folded(c))}
MARKED, UNMARKED = "".join(FOLDED), "".join(FOLDED.values())


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case without marks, composed or not."""
    bare = F.regexp_replace(F.translate(F.lower(text), MARKED, UNMARKED), MARKS, "")
    return F.regexp_extract_all(bare, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


@dataclass
class Index:
    """postings (term, id, tf), lengths (id, length), and one row of n and avg_length; positions (term, id, pos) for phrases."""

    postings: DataFrame
    lengths: DataFrame
    stats: DataFrame
    positions: DataFrame


def build_index(docs: DataFrame, fields: list[str], key: str = "id") -> Index:
    """The index of docs over the words of some columns, one after the other.

    Postings aggregate with map-side sums; nothing but the final scores of a query is ever gathered.
    """
    text = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields])
    tokens = docs.select(F.col(key).alias("id"), words(text).alias("w"))
    positions = tokens.select("id", F.posexplode("w").alias("pos", "term"))
    lengths = tokens.select("id", F.size("w").alias("length"))
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avg_length"))
    postings = positions.groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"))
    return Index(postings, lengths, stats, positions)


def corpus_name(name: str | None) -> str:
    """The corpus that is searched; code if none is named.  `all`, which once was one, means code."""
    if name in (None, "", "all"):
        return "code"
    if name not in CORPORA:
        raise ValueError(f"unknown corpus {name!r}: {', '.join(CORPORA)}")
    return name


def route(symbols: DataFrame) -> DataFrame:
    return symbols.withColumn("corpus", S.corpus_of(F.col("language"), F.col("kind")))


@dataclass
class Search:
    """A parsed query: groups of alternatives, all of which have to match.  A term is a word, a prefix or a phrase."""

    groups: list[list[tuple[str, tuple[str, ...]]]] = field(default_factory=list)
    operators: bool = False


_TERM = re.compile(r'"([^"]*)"(\*?)|(\S+)')
_REGEX = re.compile(r"\.\*|\.\+|\\[wdsb]|\[[^\]]*\]|\(\?|^\^|\$$|\|")


def _plain(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", re.sub(MARKS, "", text.lower().translate(str.maketrans(FOLDED))))


def sanitize(query: str) -> str:
    """Tokens that hold punctuation or mixed case inside become phrases; a final star stays outside; apostrophes go."""
    tokens = _TERM.findall(query.replace("'", ""))
    plain = [bare for _, _, bare in tokens if bare and bare not in ("AND", "OR", "NOT")]
    shaped = re.compile(r"[A-Za-z0-9][._-][A-Za-z0-9]|[:/@_]|[a-z][A-Z]")
    coded = any(shaped.search(b) for b in plain) or any(q for q, _, _ in tokens)
    if any(b in ("AND", "OR", "NOT") for _, _, b in tokens) and not coded:
        return '"' + " ".join(b or q for q, _, b in tokens) + '"'
    out = []
    for quoted, star, bare in tokens:
        if not bare:
            out.append(f'"{quoted}"{star}')
            continue
        star, body = ("*", bare[:-1]) if bare.endswith("*") else ("", bare)
        inner = re.search(r"[^\s.\-][.\-][^\s.\-]|^-", body) or re.search(r"[:/@\[\](){}<>,!?]", body) or (re.search("[a-z]", body) and re.search("[A-Z]", body[1:]))
        out.append(f'"{body}"{star}' if inner else body + star)
    return " ".join(out)


def parse(query: str) -> Search:
    """Implicit AND, OR between terms, "phrases", and prefix*."""
    if _REGEX.search(query):
        raise ValueError(f"{query!r} looks like a regular expression; search takes words, \"phrases\" and prefixes*")
    s, alternative = Search(), False
    for quoted, star, bare in _TERM.findall(query):
        if bare in ("OR", "AND"):
            s.operators, alternative = True, bare == "OR"
            continue
        ws = _plain(quoted or bare)
        if not ws:
            continue
        kind = "prefix" if (star or bare.endswith("*")) and len(ws) == 1 else "phrase" if len(ws) > 1 else "word"
        s.operators |= kind != "word"
        if alternative and s.groups:
            s.groups[-1].append((kind, tuple(ws)))
        else:
            s.groups.append([(kind, tuple(ws))])
        alternative = False
    return s


def _phrase(index: Index, ws: tuple[str, ...]) -> DataFrame:
    """(id, tf) of the texts in which words follow each other; the positions of all words are read once."""
    places = index.positions.filter(F.col("term").isin(list(ws)))
    at = F.create_map(*[F.lit(x) for w in dict.fromkeys(ws) for x in (w, [i for i, v in enumerate(ws) if v == w])])
    starts = places.select("id", F.explode(F.transform(F.element_at(at, F.col("term")), lambda i: F.struct((F.col("pos") - i).alias("start"), i.alias("i")))).alias("x"))
    whole = starts.groupBy("id", F.col("x.start").alias("start")).agg(F.countDistinct("x.i").alias("n")).filter(F.col("n") == len(ws))
    return whole.groupBy("id").agg(F.count(F.lit(1)).alias("tf"))


def score(index: Index, search: Search) -> DataFrame:
    """(id, score) of the documents that match all groups, by Okapi BM25.

    All words and prefixes of a query are looked up in one pass over the postings.
    """
    if not search.groups:
        return index.lengths.limit(0).select("id", F.lit(0.0).alias("score"))
    plain = [(g, kind, ws) for g, group in enumerate(search.groups) for kind, ws in group if kind != "phrase"]
    parts = []
    if plain:
        test = {True: lambda w: F.col("term") == w, False: lambda w: F.col("term").startswith(w)}
        found = F.array_compact(F.array(*[F.when(test[kind == "word"](ws[0]), F.struct(F.lit(g).alias("group"), F.lit(ws[0] + "*" * (kind == "prefix")).alias("term"))) for g, kind, ws in plain]))
        wanted = F.col("term").isin([ws[0] for _, kind, ws in plain if kind == "word"])
        for _, kind, ws in plain:
            if kind == "prefix":
                wanted = wanted | F.col("term").startswith(ws[0])
        rows = index.postings.filter(wanted).select("id", "tf", F.explode(found).alias("m"))
        parts.append(rows.groupBy("m.group", "m.term", "id").agg(F.sum("tf").alias("tf")))
    for g, group in enumerate(search.groups):
        for kind, ws in group:
            if kind == "phrase":
                parts.append(_phrase(index, ws).select(F.lit(g).alias("group"), F.lit(" ".join(ws)).alias("term"), "id", "tf"))
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    # Terms of a query are few, so their document frequencies are too.
    df = F.broadcast(hits.groupBy("group", "term").agg(F.count(F.lit(1)).alias("df")))
    rows = hits.join(df, ["group", "term"]).join(index.lengths, "id").crossJoin(F.broadcast(index.stats))
    idf = F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    out = rows.groupBy("id").agg(F.sum(part).alias("score"), F.countDistinct("group").alias("groups"))
    return out.filter(F.col("groups") == len(search.groups)).select("id", "score")


def search(index: Index, query: str, limit: int | None = 20) -> tuple[DataFrame, str]:
    """Results of a query, and which way was taken: as it stands, any of its words, or a prefix.

    A query of several plain words that match nothing together is tried with any of them; a bare identifier
    that matches nothing is tried as a prefix.
    """
    s = parse(sanitize(query))
    out, way = score(index, s), "all"
    if out.isEmpty() and not s.operators:
        if len(s.groups) > 1:
            out, way = score(index, Search([[t for g in s.groups for t in g]], True)), "any"
        elif S.exact_identifier(query):
            out, way = score(index, Search([[("prefix", s.groups[0][0][1])]], True)), "prefix"
    return (out if limit is None else out.orderBy(F.desc("score"), "id").limit(limit)), way


def least_confidence(query: str, corpus: str) -> float:
    """Results below this confidence are left out: nothing for exact identifiers and the docs corpus."""
    return EXACT_CONFIDENCE if corpus == "docs" or S.exact_identifier(query) else PLAIN_CONFIDENCE


def snippet(source: Column, query: str, lines: int | None = None) -> Column:
    """The first lines of a source: five, or none for an exact identifier, unless a number is given."""
    n = lines if lines is not None else 0 if S.exact_identifier(query) else 5
    return F.array_join(F.slice(F.split(source, "\n"), 1, n), "\n") if n else F.lit("")


def other_kinds(symbols: DataFrame, name: str, kind: str) -> DataFrame:
    """Nodes of exactly this name that a kind filter hides."""
    return symbols.filter((F.col("name") == name) & (F.col("kind") != kind)).select("id", "kind").orderBy("id")


def exists(symbols: DataFrame, index: Index, name: str) -> DataFrame:
    """Nodes by exact name; if there are none, by search."""
    exact = symbols.filter(F.col("name") == name).select("id")
    return exact if not exact.isEmpty() else search(index, name, 20)[0].select("id")


def save_index(index: Index, path: str) -> None:
    """Write an index anew: postings and positions sorted by term, so that a query reads the row groups of its words."""
    for name in ("postings", "positions"):
        getattr(index, name).repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/{name}")
    index.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
    index.stats.write.mode("overwrite").parquet(f"{path}/stats")


def load_index(spark: SparkSession, path: str) -> Index:
    return Index(*[spark.read.parquet(f"{path}/{n}") for n in ("postings", "lengths", "stats", "positions")])


def fragmentation(spark: SparkSession, path: str) -> DataFrame:
    """Files and rows of each table of a saved index."""
    parts = [spark.read.parquet(f"{path}/{n}").select(F.lit(n).alias("name"), F.input_file_name().alias("file")) for n in ("postings", "positions", "lengths")]
    out = parts[0].union(parts[1]).union(parts[2])
    return out.groupBy("name").agg(F.countDistinct("file").alias("files"), F.count(F.lit(1)).alias("n"))
