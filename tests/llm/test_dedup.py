import re

import numpy as np
import pytest

from graphmill.llm import common as C
from graphmill.llm import line_winnow as W
from graphmill.llm import minhash as H
from graphmill.llm import unit_dedup as U
from graphmill.llm import wordhash as X
from graphmill.llm.components import components


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(docs, k):
    sets = {d: shingles(t, k) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("k", [1, 2, 5])
def test_near_duplicates_equal_brute_force(spark, corpus, k):
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in H.near_duplicates(df, k).collect()}
    want = brute(corpus, k)
    assert got == want and sum(d != c for d, (_, c) in want.items()) > 5


def chain(n, words=60):
    """Texts each near to the next, but not to those further off, beside a crowd around one text."""
    base = [f"w{i}" for i in range(words)]
    out = [(i, " ".join(f"c{j}" if j < 3 * i else w for j, w in enumerate(base))) for i in range(n)]
    crowd = [(1000 + i, " ".join(f"v{j}" if j != (7 * i) % words and j != (11 * i) % words else f"e{i}" for j in range(words))) for i in range(60)]
    return out + crowd


def test_chains_and_crowds_join_up(spark):
    docs = chain(12)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in H.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 1).collect()}
    assert got == brute(docs, 1)


def test_ways_for_many_candidates_and_blocks_lose_no_link(spark, corpus, monkeypatch):
    monkeypatch.setattr(C, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(H, "BLOCK", 300)
    monkeypatch.setattr(C, "HOT_FLOOR", 1)
    docs = [(5000 + d, t) for d, t in chain(10)] + corpus
    assert len({d for d, _ in docs}) == len(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in H.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 2).collect()}
    assert got == brute(docs, 2)


def test_near_duplicates_of_odd_rows(spark, odd, nothing, clashing):
    got = {r.doc_id: r for r in H.near_duplicates(odd, 2).collect()}
    assert all(got[d].n_shingles == 0 and got[d].kept and got[d].component_id == d for d in (101, 102, 103))
    assert got[None].component_id is None and got[None].kept and got[105].n_shingles == 1 and got[106].n_shingles == 1
    assert H.near_duplicates(odd, 2).count() == odd.count() and H.near_duplicates(nothing).count() == 0 and H.near_duplicates(clashing).count() == odd.count()


def test_superminhash_estimates_similarity_better_than_chance():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(60):
        a = rng.integers(0, 2**63, 100).astype(np.uint64)
        b = a.copy()
        b[:20] = rng.integers(0, 2**63, 20)
        s = H.superminhash(np.concatenate([a, b]), np.array([0, 100, 200]), 96)
        errors.append((s[0] == s[1]).mean() - 80 / 120)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05
    one = H.superminhash(np.array([5], np.uint64), np.array([0, 1]), 32)
    assert sorted((one[0] >> np.uint64(32)).tolist()) == list(range(32))


def test_signatures_of_large_sets_are_the_least_of_their_parts(monkeypatch):
    sets = np.arange(1, 5001, dtype=np.uint64) * np.uint64(7919)
    ends = np.array([0, 5000])
    whole = H.superminhash(sets, ends, 96)
    monkeypatch.setattr(H, "ELEMENTS", 700)
    assert (H.signature(sets, ends, 96) == whole).all()


def test_word_hashes_are_those_of_each_text_alone():
    texts = [b"The cat\nsat", b"", b"  cat  THE ", "é ü x".encode(), b"y" * 3_000_000, b"the"]
    hashes, first = X.word_hashes(texts, X.SPACES)
    words = [t.lower().split() for t in texts]
    assert np.diff(first).tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    table = {}
    assert all(table.setdefault(w, h) == h for w, h in zip(flat, hashes.tolist(), strict=True)) and len(set(table.values())) == len(table)


def test_components(spark):
    import random

    rng = random.Random(4)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_rounds_over_few_links_need_no_shuffle(spark, monkeypatch):
    from graphmill.llm import components as C

    links = spark.createDataFrame([(i, i // 2) for i in range(1, 300)] + [(1_000 + i, 1_000) for i in range(1, 50)], "u long, v long")
    plans = []
    monkeypatch.setattr(C, "materialize", lambda df, name, f=C.materialize: (plans.append(df._jdf.queryExecution().executedPlan().toString()), f(df, name))[1])
    few = {tuple(r) for r in C.components(links).collect()}
    assert len(plans) > 2 and all("Exchange" not in p for p in plans[1:])
    monkeypatch.setattr(C, "ONE_TASK", 0)
    assert few == {tuple(r) for r in C.components(links).collect()} == {(i, 0) for i in range(1, 300)} | {(1_000 + i, 1_000) for i in range(1, 50)}


def brute_spans(docs):
    seen, out = {}, {}
    for d, text in sorted(docs):
        gone = out.setdefault(d, set())
        for digest, a, b in sorted(U.units_of(text or ""), key=lambda u: u[1]):
            if digest in seen and seen[digest] != (d, a):
                gone.update(range(a, b))
            seen.setdefault(digest, (d, a))
    return out


@pytest.mark.parametrize("limit", [1_000, 1])
def test_unit_dedup_equals_brute_force(spark, corpus, monkeypatch, limit):
    monkeypatch.setattr(C, "HOT_FLOOR", limit)
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    got = {r.doc_id: {i for s in r.spans for i in range(s.start, s.end)} for r in U.removals(df).collect()}
    want = brute_spans(corpus)
    # Spans that touch are one span, and lines that follow each other leave the newline between them.
    assert {d: len(x) for d, x in got.items()} == {d: len(x) for d, x in want.items()} and got == want and sum(map(bool, want.values())) > 10


def test_units_are_lines_and_sentences():
    text = "Short one.\nOne two three four five six seven eight nine. Ten eleven twelve thirteen fourteen fifteen sixteen seventeen."
    line, second = text.index("One"), text.index("Ten")
    assert [(a, b) for _, a, b in U.units_of(text)] == [(line, len(text)), (line, second), (second, len(text))]


def test_deduplicated_texts_and_odd_rows(spark, odd, nothing, clashing):
    line = "one two three four five six seven eight nine"
    df = spark.createDataFrame([(1, f"a\n{line}\nb"), (2, f"{line}\nc"), (3, line), (4, "x y")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in U.deduplicated(df).collect()} == {1: f"a\n{line}\nb", 2: "c", 3: "", 4: "x y"}
    assert U.removals(odd).count() == odd.count() and U.removals(nothing).count() == 0 and U.deduplicated(clashing).count() == odd.count()
    same = U.removals(odd).filter("doc_id = 107").collect()
    assert [r.n_removed for r in same] == [0, 0]


def brute_lines(docs, run):
    seen, out = {}, {}
    for d, text in sorted(docs):
        lines = [" ".join(x.lower().split()) for x in text.split("\n")] if text else []
        gone = set()
        for i in range(len(lines) - run + 1):
            key = tuple(lines[i : i + run])
            if key in seen:
                gone.update(range(i, i + run))
            seen.setdefault(key, (d, i))
        out[d] = gone
    return out


@pytest.mark.parametrize("limit", [1_000, 1])
def test_winnowing_finds_every_repeated_run(spark, corpus, monkeypatch, limit):
    monkeypatch.setattr(C, "HOT_FLOOR", limit)
    got = {r.doc_id: {i for m in r.matches for i in range(m.line, m.end_line)} for r in W.line_matches(spark.createDataFrame(corpus, "doc_id long, text string")).collect()}
    want = brute_lines(corpus, W.RUN)
    assert got == want and sum(map(bool, want.values())) > 10


def brute_passages(docs, run, long_words):
    seen, out = {}, {}
    for d, text in sorted(docs):
        lines = [" ".join(x.lower().split()) for x in text.split("\n")] if text else []
        gone, n = set(), [len(x.split()) for x in lines]
        for i in range(len(lines)):
            for size in range(1, min(run, len(lines) - i) + 1):
                if size < run and sum(n[i : i + size]) < long_words:
                    continue
                if seen.setdefault(tuple(lines[i : i + size]), (d, i)) != (d, i):
                    gone.update(range(i, i + size))
        if len(lines) < run and 0 < sum(n) < long_words and seen.setdefault(("whole", *lines), d) != d:
            gone.update(range(len(lines)))
        out[d] = gone
    return out


@pytest.mark.parametrize("limit", [1_000, 1])
def test_passages_of_few_lines_are_found_by_their_size(spark, corpus, monkeypatch, limit):
    monkeypatch.setattr(C, "HOT_FLOOR", limit)
    long, half = "one two three four five six seven eight nine", "ten eleven twelve thirteen"
    texts = [long, f"x\n{long.upper()}\ny", f"{half}\nfourteen fifteen sixteen seventeen", f"z\n{half}\nfourteen  fifteen sixteen seventeen\nz", f"{half}\nz", "short text", "Short  text", "short text\nand more", "\n", "\n", f"{long}\n{long}", "a\nb", "a\nb"]
    docs = corpus + [(1000 + i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: {i for m in r.matches for i in range(m.line, m.end_line)} for r in W.line_matches(df, long_words=W.LONG).collect()}
    want = brute_passages(docs, W.RUN, W.LONG)
    assert got == want and sum(map(len, want.values())) > sum(map(len, brute_lines(docs, W.RUN).values()))
    assert [len(got[1000 + i]) for i in range(len(texts))] == [0, 1, 0, 2, 0, 0, 1, 0, 0, 0, 2, 0, 2]
    left = {r.doc_id: r.text for r in W.without_repeats(df).collect()}
    assert [left[1000 + i] for i in (0, 1, 3, 6, 7, 10, 12)] == [long, "x\ny", "z\nz", "", "short text\nand more", "", ""]


def test_matches_extend_both_ways_and_lines_go(spark, odd, nothing, clashing):
    run = "\n".join(f"line number {i}" for i in range(8))
    df = spark.createDataFrame([(1, f"top\n{run}\nend"), (2, f"x\ny\n{run}\nz")], "doc_id long, text string")
    r = W.line_matches(df).filter("doc_id = 2").first()
    assert [(m.line, m.end_line, m.source_doc, m.source_line) for m in r.matches] == [(2, 10, 1, 1)] and r.n_deleted == 8
    assert {x.doc_id: x.text for x in W.without_repeats(df).collect()} == {1: f"top\n{run}\nend", 2: "x\ny\nz"}
    assert W.line_matches(odd).count() == odd.count() and W.line_matches(nothing).count() == 0 and W.without_repeats(clashing).count() == odd.count()


def test_selected_fingerprints_cover_every_window():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 5, 40):
        grams = rng.integers(0, 6, n).astype(np.uint64)
        at = set(W.selected(grams, 3).tolist())
        assert all(at & set(range(i, i + 3)) for i in range(n - 2))
