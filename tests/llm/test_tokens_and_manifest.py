import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphmill.llm import merkle, token_align, token_count
from graphmill.llm.queries import QUERIES, tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
STRANGE = [
    "", " ", "a", " a  b", "a ", "\n", "\n\na\n b\nc", "ﬁ ＡＢ é é", "<s> x </s> <|endoftext|> y <0x41>", "▁x", "a\0b", "\ttab \n\n x\r\n y", "漢字 \U0001f600 z",
    "don't we'll it's", "a\n\nb c\x1cd e", "a \n b", "　x　 y", "a b ​ c", "﻿a", "x" * 5000, "ab" * 2500, " " * 3000, "\n" * 700,
]


@pytest.fixture(scope="module")
def strange():
    rng = random.Random(5)
    alphabets = ("ab ", "xyzw", "ab'st \n\t1.,é漢", "abcdefghijklmnopqrstuvwxyz ABC019.,\n", "éèàüñ漢字 \U0001f600の")
    return STRANGE + ["".join(rng.choices(rng.choice(alphabets), k=rng.choice([1, 3, 8, 30, 300, 2000]))) for _ in range(400)]


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=B)


@pytest.fixture(scope="module")
def both():
    return token_align.Tokenizers(A, B)


def texts_of(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


# --- token counts -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("lane, slab", [(256, 1 << 21), (32, 1000), (24, 24), (64, 65)])
def test_transducer_counts_as_the_library(strange, model, monkeypatch, lane, slab):
    monkeypatch.setattr(token_count, "LANE", lane)
    monkeypatch.setattr(token_count, "SLAB", slab)
    some = strange if lane > 100 else strange[:120]
    assert token_count.count(token_count.Transducer(B), some) == [len(x) for x in model.encode(some)]


def test_transducer_forgets(strange, model, monkeypatch):
    monkeypatch.setattr(token_count, "MOST_STATES", 50)
    monkeypatch.setattr(token_count, "SLAB", 3000)
    machine = token_count.Transducer(B)
    assert token_count.count(machine, strange[:150]) == [len(x) for x in model.encode(strange[:150])]
    assert len(machine.keys) < 60_000


def test_maps_of_lanes_without_a_common_state_are_completed():
    """A run of one letter never forgets where it began: maps need an entry for each phase, and rounds do not grow with its lanes."""
    machine = token_count.Transducer(B)
    whole = token_count._codes(["x" * 40_003])
    rounds = []
    run = machine.run
    machine.run = lambda *a: (rounds.append(len(a[1])), run(*a))[1]
    token_count.count_slab(machine, whole, [len(whole)], None)
    assert len(rounds) < 20
    assert token_count.count(machine, ["x" * 40_002])[0] > 0


def test_scan_composes_as_one_step_after_the_other():
    rng = np.random.default_rng(1)
    lanes, states = 37, 3
    end = rng.integers(0, states, lanes * states)
    tokens = rng.integers(-2, 9, lanes * states)
    key = np.repeat(np.arange(lanes), states) << 32 | np.tile(np.arange(states), lanes)
    chained = rng.random(lanes) < 0.8
    chained[-1] = False
    got_end, got_tokens = token_count.scan((key, end, tokens), chained)
    for e in range(lanes * states):
        lane, at, total = e // states, e % states, 0
        while True:
            total, at = total + tokens[lane * states + at], end[lane * states + at]
            if not chained[lane]:
                break
            lane += 1
        assert (got_end[e], got_tokens[e]) == (at, total)


def test_every_piece_is_counted_as_the_library_does(model):
    pieces = [model.id_to_piece(i).replace("▁", " ") for i in range(300, model.vocab_size(), 7)]
    assert token_count.count(token_count.Transducer(B), pieces) == [len(x) for x in model.encode(pieces)]


def test_token_counts_of_odd_rows(spark, odd, nothing, clashing, model):
    want = Counter((r.doc_id, len((r.text or "").encode()), len(model.encode(r.text or "")), len(model.encode(r.text or "")) > 4096) for r in odd.collect())
    for docs in (odd, clashing):
        assert Counter(map(tuple, token_count.token_counts(docs, B).collect())) == want
    assert token_count.token_counts(nothing, B).collect() == []


def test_query_token_count(spark, model):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op12_token_count"](spark, SF).collect()}
    assert got == {d: (len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for d, t in texts_of(spark)}


# --- alignment ----------------------------------------------------------------------------------------------------


def brute_alignment(both, text):
    """Tokens, links and groups of a whole text, by walking over its bytes."""
    if not text:
        return None
    raw = (" " + text).encode()
    sides = []
    for ids, of in ((both.a.encode(" " + text, add_special_tokens=False).ids, both.a_bytes), (both.b.encode(text), both.b_bytes)):
        at, tokens = 0, []
        for i in ids:
            tokens.append((i, at, at + len(of[i])))
            at += len(of[i])
        if b"".join(of[i] for i in ids) != raw:
            return None
        sides.append(tokens)
    a, b = sides
    owner = [i for i, s, e in b for _ in range(s, e)], [k for k, (_, s, e) in enumerate(b) for _ in range(s, e)]
    links = [(i, b[k][0]) for i, s, e in a for k in sorted(set(owner[1][s:e]))]
    ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
    part = lambda tokens, lo, hi: ",".join(str(i) for i, s, _ in tokens if lo <= s < hi)
    groups = [f"{part(a, lo, hi)}|{part(b, lo, hi)}" for lo, hi in zip([0, *ends], ends, strict=False)]
    return len(a), len(b), len(groups), links, sha256(";".join(groups).encode()).hexdigest()


def brute_table(both, rows):
    found = [(d, brute_alignment(both, t)) for d, t in rows]
    counts = Counter(p for _, f in found if f for p in set(f[3]))
    most = defaultdict(int)
    for (i, _), n in counts.items():
        most[i] = max(most[i], n)
    return Counter((d, 0, 0, 0, 0, 0, 0, "") if f is None else (d, *f[:3], len(f[3]), sum(counts[p] == most[p[0]] for p in f[3]), sum(counts[p] for p in f[3]), f[4]) for d, f in found)


def test_units_align_as_whole_texts(both, strange, monkeypatch):
    short = [t for t in strange if len(t) < 400]
    aligner = token_align.Aligner(A, B)
    for _ in range(2):  # the second time from what is remembered
        sums, digests, d, pair, m = aligner.align(short)
        for k, text in enumerate(short):
            want = brute_alignment(both, text)
            at = slice(*np.searchsorted(d, [k, k + 1]))
            got = (*(int(sums[c][k]) for c in ("n_a", "n_b", "n_groups")), dict(zip(pair[at].tolist(), m[at].tolist(), strict=True)), digests[k])
            assert got == ((0, 0, 0, {}, "") if want is None else (*want[:3], dict(Counter(i * token_align.WIDE + j for i, j in want[3])), want[4])), text
    monkeypatch.setattr(token_align, "REMEMBERED", 10)
    assert aligner.align(short)[1] == digests


def test_alignment_of_odd_rows(spark, odd, nothing, clashing, both):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    rows = [(d, t) for d, t in rows if not t or len(t) < 100_000]
    short = odd.filter("text is null or length(text) < 100000")
    want = brute_table(both, rows)
    assert Counter(map(tuple, token_align.alignment(short, A, B).collect())) == want
    assert Counter(map(tuple, token_align.alignment(clashing.filter("text is null or length(text) < 100000"), A, B).collect())) == want
    assert token_align.alignment(nothing, A, B).collect() == []
    # Texts that come back as other bytes have no tokens and hold no pair.
    other = spark.createDataFrame([(1, "a▁b c"), (2, "a c"), (3, "a c")], "doc_id long, text string")
    got = {r.doc_id: r for r in token_align.alignment(other, A, B).collect()}
    assert got[1].n_links == 0 and got[1].groups_sha256 == "" and got[2].count_sum == 2 * got[2].n_links == got[3].count_sum


@pytest.mark.parametrize("broadcast", [True, False])
def test_query_token_align(spark, both, broadcast, monkeypatch):
    from graphmill.llm import common

    if not broadcast:
        monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(common, "HOT_FLOOR", 10)
    got = Counter(map(tuple, QUERIES["op11_token_align"](spark, SF).collect()))
    assert got == brute_table(both, texts_of(spark))


def test_pair_counts(spark, both):
    rows = [(1, "a b"), (2, "a b a b"), (3, None), (4, "zebra")]
    table = token_align.aligned(spark.createDataFrame(rows, "doc_id long, text string"), A, B)
    got = {(r.id_a, r.id_b): (r.docs, r.best) for r in token_align.pair_counts(table).collect()}
    links = [set(f[3]) for _, t in rows if (f := brute_alignment(both, t))]
    counts = Counter(p for s in links for p in s)
    assert {p: n for p, (n, _) in got.items()} == counts
    assert all(best == (n == max(x for q, x in counts.items() if q[0] == p[0])) for p, (n, best) in got.items())


# --- manifest -----------------------------------------------------------------------------------------------------


def brute_tree(leaves):
    """Levels of a tree, and for each leaf its siblings up to the root."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        nodes = levels[-1]
        levels.append([sha256("".join(nodes[a : a + 8]).encode()).hexdigest() for a in range(0, len(nodes), 8)])
    proofs = []
    for i in range(len(leaves)):
        proof = []
        for nodes in levels[:-1]:
            run = i - i % 8
            proof.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 8])))
            i //= 8
        proofs.append(proof)
    return levels[-1][0], proofs


def made(n):
    """n digests, and a group's name by place: one large group, a null one, one of a single row, some of eight and nine."""
    sizes = [None] * 9 + ["one"] + ["eight"] * 8 + ["nine"] * 9
    return [(sizes[i] if i < len(sizes) else "large", i, sha256(str(i).encode()).hexdigest()) for i in range(n)]


@pytest.mark.parametrize("n", [0, 1, 2, 10, 27, 90, 700])
@pytest.mark.parametrize("levels", [1, 2])
def test_manifest_equals_a_tree_built_at_once(spark, n, levels):
    rows = spark.createDataFrame(made(n), "lang string, doc_id long, h string").select(merkle._group("lang").alias("grp"), "doc_id", "h")
    if n > 100 and levels == 1:
        rows = rows.repartition(7)
    m = merkle.manifest(rows, ["doc_id", "h"], levels)
    got = {(r.grp, r.idx): (r.subroot, r.root, [(p.lefts, p.rights) for p in r.proof]) for r in m.proofs().collect()}
    groups = defaultdict(list)
    for lang, _, h in made(n):
        groups["0" if lang is None else "1" + lang].append(h)
    trees = {g: brute_tree(hs) for g, hs in groups.items()}
    if not trees:
        assert got == {}
        return
    names = sorted(trees)
    root, above = brute_tree([trees[g][0] for g in names])
    want = {(g, i): (trees[g][0], root, proof + above[names.index(g)]) for g in names for i, proof in enumerate(trees[g][1])}
    assert got == want
    for (g, i), (_, root, proof) in got.items():
        assert merkle.fold(groups[g][i], proof) == root
        assert n < 2 or merkle.fold(merkle.digest("other"), proof) != root


def test_manifest_of_odd_rows(spark, odd, nothing, clashing):
    rows = merkle.verified_manifest(odd).collect()
    assert len(rows) == odd.count() and len({r.root for r in rows}) == 1 and len({r.subroot for r in rows}) == 3
    assert Counter(map(tuple, merkle.verified_manifest(clashing).collect())) == Counter(map(tuple, rows))
    assert merkle.verified_manifest(nothing).collect() == []
    twice = [r for r in rows if r.doc_id == 107]
    assert len(twice) == 2 and len({r.leaf for r in twice}) == 1
    fields = lambda *v: merkle.digest("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in v))
    assert {r.doc_id: r.leaf for r in rows}[None] == fields(None, "hot", "en", 17, "no id at all here")
    assert {r.doc_id: r.leaf for r in rows}[101] == fields(101, None, None, None, None)


def test_tampered_rows_are_found(spark):
    docs = spark.createDataFrame([(i, "Text " + str(i), "en", "s", 6) for i in range(100)] + [(i, "no capitals", "en", "s", 6) for i in range(100, 130)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.verified for r in merkle.verified_manifest(docs).collect()}
    hit = {r.doc_id for r in docs.filter(merkle.third_of_ids()).collect()}
    assert {d for d, ok in got.items() if not ok} == {d for d in hit if d < 100}
    assert merkle.documents_manifest(docs).checked("found").filter("not verified").count() == 0


def test_numbers_are_places_in_their_group(spark):
    rng = random.Random(2)
    rows = [("g" + str(rng.choice([0, 0, 0, 1, 2])), rng.randint(0, 50)) for _ in range(3000)]
    got = merkle.numbered(spark.createDataFrame(rows, "grp string, k long").repartition(13), ["k"], "numbered").collect()
    assert Counter((r.grp, r.k) for r in got) == Counter(rows)
    for g in {r[0] for r in rows}:
        own = sorted((r for r in got if r.grp == g), key=lambda r: r.idx)
        assert [r.idx for r in own] == list(range(len(own))) and {r.n for r in own} == {len(own)}
        assert [r.k for r in own] == sorted(r.k for r in own)


def test_crc_of_ids(spark):
    import zlib

    rows = spark.range(2000).select(F.col("id").alias("doc_id"), merkle.third_of_ids("id").alias("hit")).collect()
    assert all(r.hit == (zlib.crc32(str(r.doc_id).encode()) % 3 == 0) for r in rows)
