import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphmill.llm import common as C
from graphmill.llm import decontaminate as D
from graphmill.llm import license_scan as S
from graphmill.llm import mix_weights as M
from graphmill.llm import token_bin as T
from graphmill.llm import url_filter as L
from graphmill.llm.queries import URL_RULES, tokenizer_path

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_contamination(docs, items, window=10):
    found = {}
    for name, text in items:
        x = words(text)
        n = min(window, len(x))
        for i in range(len(x) - n + 1 if n else 0):
            found.setdefault(tuple(x[i : i + n]), set()).add(str(name))
    out = {}
    for d, text in docs:
        x, hit, names = words(text), set(), set()
        for n in {len(w) for w in found}:
            for i in range(len(x) - n + 1):
                if (w := tuple(x[i : i + n])) in found:
                    hit |= set(range(i, i + n))
                    names |= found[w]
        best = None
        for name, text_of in items if names else ():
            y = words(text_of)
            least = min(window, len(y))
            for i in range(len(x)):
                for j in range(len(y)):
                    n = 0
                    while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
                        n += 1
                    if n >= least:
                        best = min(best or (0,), (-n, i, str(name), j))
        longest = (-best[0], best[2], best[1], best[3]) if best else (0, None, None, None)
        out[d] = (len(x), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit), *longest)
    return out


@pytest.mark.parametrize("block", [32 << 20, 200])
def test_contamination_equals_brute_force(spark, corpus, block):
    texts = [t for _, t in corpus if len(t.split()) > 30]
    items = [(i, " ".join(t.split()[i : i + 8 + 3 * i])) for i, t in enumerate(texts[:8])] + [(50, "two words"), (51, ""), (52, None), (53, "!"), (53, corpus[9][1])]
    docs = [*corpus, (900, "here Two, WORDS stand"), (901, None), (902, "")]
    got = {r[0]: tuple(r)[1:] for r in D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 10, block).collect()}
    assert got == brute_contamination(docs, items) and got[900][1:3] == (2, 1) and sum(x[4] for x in got.values()) > 5


def test_suffix_array_is_sorted_and_longest_matches_are_found(spark):
    rng = np.random.default_rng(7)
    seq = rng.integers(0, 4, 300).astype(np.int32)
    seq[-1] = 0
    zero = np.where(seq == 0, np.arange(300), 300)
    run = np.minimum.accumulate(zero[::-1])[::-1] - np.arange(300)
    array = D.suffix_array(seq, run, 2, 2)
    keys = [tuple(seq[i : i + run[i]]) for i in array]
    assert keys == sorted(keys) and len(array) == (run >= 2).sum()
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l"), (2, "z a b c d e f g h i j k l m")], "doc_id long, text string")
    item = spark.createDataFrame([("q", "x a b c d e f g h i j k l m y")], "item_id string, text string")
    got = {tuple(r) for r in D.matches(docs, item).collect()}
    assert got == {(1, "q", 0, 1, 12), (2, "q", 1, 1, 13)}
    # Items of one word each stand side by side in a block, and are no longer match for that.
    short = spark.createDataFrame([("p", "g"), ("q", "h")], "item_id string, text string")
    assert {tuple(r) for r in D.matches(docs.filter("doc_id = 1"), short).collect()} == {(1, "p", 6, 0, 1), (1, "q", 7, 0, 1)}


@pytest.mark.parametrize("bits", [2, 9, 12, 31])
def test_suffixes_that_end_at_a_compared_depth_sort_first(bits):
    rng = np.random.default_rng(bits)
    per, parts = 62 // bits, []
    phrase = rng.integers(1, 4, 3 * per + 2)
    for n in [len(phrase), *rng.integers(1, len(phrase) + 1, 40), per, 2 * per, 3 * per, len(phrase)]:
        parts += [phrase[:n], [0]]
    seq = np.concatenate(parts).astype(np.int32)
    zero = np.where(seq == 0, np.arange(len(seq)), len(seq))
    run = np.minimum.accumulate(zero[::-1])[::-1] - np.arange(len(seq))
    array = D.suffix_array(seq, run, 1, bits)
    keys = [tuple(seq[i : i + run[i]].tolist()) for i in array]
    assert keys == sorted(keys) and sorted(array.tolist()) == np.flatnonzero(run >= 1).tolist()


@pytest.mark.parametrize(("vocabulary", "per"), [(300, 6), (2100, 5)])
def test_windows_are_found_beside_shorter_copies(spark, vocabulary, per):
    names = [f"w{i}" for i in range(vocabulary)]
    items = [(1, " ".join(names)), (2, " ".join(names[50:53])), (3, " ".join(names[60:65])), (4, " ".join(names[70:79]))]
    docs = [(1, " ".join(names[:10])), (2, " ".join(["x", *names[50:82], "x"])), (3, " ".join([*names[:per], "other", *names[60 : 60 + per], "other", *names[70 : 70 + per], "other"]))]
    got = {r[0]: tuple(r)[1:] for r in D.contamination(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute_contamination(docs, items) and got[1][1] == 10


def test_clean_keeps_all_columns(spark, odd, nothing, clashing):
    bench = spark.createDataFrame([(1, "the same text twice over here")], "item_id long, text string")
    kept = D.clean(clashing, bench)
    assert kept.columns == clashing.columns and kept.count() == odd.count() - 2
    assert D.contamination(odd, bench.limit(0)).filter("contaminated").count() == 0 and D.contamination(nothing, bench).count() == 0


def test_token_files_round_trip(spark, odd, nothing, clashing, corpus, tmp_path):
    path = tokenizer_path()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    extra = [(500, "a  b\n\n\nc \n d"), (501, " lead"), (502, "trail \n"), (503, "x   y"), (504, "<|endoftext|> and don't, won't."), (507, "a <|endoftext|> b"), (508, "x<|endoftext|>"), (None, "twice <|endoftext|>"), (None, "other"), (505, "tab\tnew\rline\u00a0nb \u3000 wide"), (506, "a, b. c,. d.,")]
    rows = corpus + extra + [(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    uri = str(tmp_path / "tokens")
    shards = T.write_token_files(df, uri, path)
    out = T.read_token_files(spark, uri, shards).orderBy("start").collect()
    at, want = 0, []
    by = {}
    for d, text in rows:
        ids = t.encode_batch([text or ""], add_special_tokens=False)[0].ids + [2]
        by.setdefault(d, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for r in out:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in by[r.doc_id]
        at += r.n_tokens
        want.append(r.doc_id)
    order = [float("-inf") if d is None else d for d in want]
    assert order == sorted(order) and len(out) == len(rows) and [s["base"] for s in shards] == sorted(s["base"] for s in shards)
    flat = np.concatenate([np.memmap(f"{uri}/shard-{s['shard']:05d}.bin", "<u2", "r") for s in shards])
    assert len(flat) == at and (flat == 2).sum() >= len(rows)
    assert T.tokenized(nothing, path).count() == 0
    null = T.tokenized(clashing, path).filter("doc_id is null").collect()
    assert len(null) == 1 and null[0].start == 0


def test_shards_follow_bytes_and_part_equal_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "SHARD_BYTES", 4_000)
    monkeypatch.setattr(T, "READ_IDS", 50)
    monkeypatch.setattr(T, "READ_DOCS", 7)
    rows = [(None if i % 3 == 0 else 5, f"words of text number {i // 4} " * 5) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    shards = T.write_token_files(df, str(tmp_path / "t"), tokenizer_path())
    assert len(shards) >= 8 and max(s["docs"] for s in shards) < 120 and sum(s["docs"] for s in shards) == 400
    mapped = T.read_token_files(spark, str(tmp_path / "t"), shards).orderBy("start").collect()
    monkeypatch.setattr(T.np, "memmap", None)
    store = T.pa.fs.SubTreeFileSystem(str(tmp_path / "t"), T.pa.fs.LocalFileSystem())
    far = T.Ranges(store, f"shard-{shards[0]['shard']:05d}.idx", "<u8")
    assert far[0:3].tolist() == [0, *(r.start + r.n_tokens for r in mapped[:2])] and len(mapped) == 400


def test_pieces_forget_without_changing_results(monkeypatch, corpus):
    p = T.Pieces(tokenizer_path(), remembered=50)
    texts = [t for _, t in corpus]
    got = [b for i in range(0, len(texts), 7) for b in p.encode(texts[i : i + 7])]
    assert got == [p._whole(t) if t else b"" for t in texts]


def url_rows():
    hosts = ["Shop.Example.org", "example.org", "a.example.com", "b.net"]
    urls = [f"https://{h}/{lang}/{n}{end}" for h in hosts for lang in ("en", "de", "fr", "es") for n in (1, 15, 28, 300, 4711) for end in ("", ".html", "/?q=1", "#top")]
    return urls + [None, "no url", "", "http://", "http://org", "http://org/", "ftp://x.ORG:80/a?b", "a://notexample.org/es/1", "x://org.evil/es/", "HTTP://example.org/en/1", "https://example.org?x"]


def test_url_rules_equal_brute_force(spark):
    urls = url_rows()
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = {r.page_id: r for r in L.filtered(df, URL_RULES).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(r), r, v) for v, r in URL_RULES if (host == r[: r.index("/")] or host.endswith("." + r[: r.index("/")])) and path.startswith(r[r.index("/") :])]
        rule, verdict = (max(fits)[1:]) if fits else (None, None)
        got = out[i]
        assert (got.host, got.path, got.rule) == (host, path, rule) and (got.verdict == verdict if rule else got.verdict in ("allow", "block"))


@pytest.mark.parametrize("limit", [1 << 25, -1])
def test_templates_learn_from_labels(spark, monkeypatch, limit):
    monkeypatch.setattr(C, "BROADCAST_BYTES", limit)
    rows = [(i, f"http://h.net/{'spam' if i % 2 else 'ham'}/{word}-{i}", None if i % 5 == 0 else bool(i % 2)) for i, word in enumerate(["x", "y", "z", "w"] * 60)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    out = L.filtered(df, (), label="bad").collect()
    assert len(out) == len(rows) and all((r.verdict == "block") == ("/spam/" in r.url) for r in out)
    many = spark.createDataFrame([(i, f"http://v.net/item{chr(97 + i % 26)}{chr(97 + i // 26)}q/page", None) for i in range(200)], "page_id long, url string, bad boolean")
    assert {r.template for r in L.filtered(many, (), label="bad").collect()} == {"/*/page"}
    assert L.filtered(df.limit(0), URL_RULES).count() == 0
    clash = df.withColumns({c: F.lit("x") for c in ("host", "verdict", "n", "shape", "template")})
    assert L.filtered(clash, URL_RULES).count() == len(rows)


def brute_templates(rows):
    """Template and purity of each (host, path, label), by the rule of the module, in plain Python."""
    import math
    from collections import defaultdict

    shape = lambda path: tuple(re.sub("[0-9]+", "{n}", re.sub("[0-9a-fA-F]{8}[0-9a-fA-F-]*", "{h}", x)) for x in path.split("/") if x)
    leaves = defaultdict(lambda: [set(), 0, 0])
    for h, path, bad in rows:
        leaf = leaves[h, shape(path)]
        leaf[0].add(path)
        leaf[1] += bad is not None
        leaf[2] += bool(bad)
    tree = {k: k[1] for k in leaves}
    deepest = max(len(s) for _, s in leaves)
    star = lambda t, d: (*t[:d], "*", *t[d + 1 :])
    for d in range(deepest):
        below = defaultdict(lambda: defaultdict(int))
        for k, t in tree.items():
            if len(t) > d:
                below[k[0], t[:d]][t[d]] += len(leaves[k][0])
        for k, t in list(tree.items()):
            kids = below.get((k[0], t[:d]))
            if len(t) > d and len(kids) >= L.CHILDREN and len(kids) >= L.VARIETY * sum(kids.values()):
                tree[k] = star(t, d)
    for d in reversed(range(deepest)):
        branch = defaultdict(lambda: [0, 0])
        for k, t in tree.items():
            branch[k[0], t][0] += leaves[k][1]
            branch[k[0], t][1] += leaves[k][2]
        pools = defaultdict(lambda: [0, 0, 0])
        for (h, t), (n, b) in branch.items():
            pool = pools[h, star(t, d) if len(t) > d else t]
            for i, x in enumerate((1, n, b)):
                pool[i] += x
        for k, t in list(tree.items()):
            to = star(t, d) if len(t) > d else t
            (n, b), (members, pn, pb) = branch[k[0], t], pools[k[0], to]
            if members > 1 and (not n or abs(b / n - pb / pn) <= L.ERRORS * math.sqrt(pb / pn * (1 - pb / pn) / n)):
                tree[k] = to
    own, across = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for k, t in tree.items():
        for table, key in ((own, (k[0], t)), (across, t)):
            table[key][0] += leaves[k][1]
            table[key][1] += leaves[k][2]
    n, b = sum(x[1] for x in leaves.values()), sum(x[2] for x in leaves.values())
    base = b / n if n else 0.0
    out = []
    for h, path, _ in rows:
        t = tree[h, shape(path)]
        prior = (across[t][1] + L.PRIOR * base) / (across[t][0] + L.PRIOR)
        out.append(("/" + "/".join(t), (own[h, t][1] + L.PRIOR * prior) / (own[h, t][0] + L.PRIOR)))
    return out


def test_templates_equal_brute_force(spark):
    rng = np.random.default_rng(12)
    rows = []
    for _ in range(900):
        host = ["a.net", "b.net", "c.org"][rng.integers(3)]
        kind = ["spam", "news", "shop", "x"][rng.integers(4)]
        depth = rng.integers(0, 5)
        names = [kind, "".join(rng.choice(list("ghijkl"), 3)), str(rng.integers(0, 99)), ["p", "q"][rng.integers(2)], "0123abcd-ff"][:depth]
        bad = None if rng.random() < 0.3 else bool(rng.random() < {"spam": 0.9, "news": 0.1, "shop": 0.4, "x": 0.1}[kind])
        rows.append((host, "".join(f"/{n}" for n in names), bad))
    df = spark.createDataFrame([(i, f"http://{h}{p}?q={i}", b) for i, (h, p, b) in enumerate(rows)], "page_id long, url string, bad boolean")
    got = {r.page_id: r for r in L.filtered(df, (), label="bad").collect()}
    for i, (template, purity) in enumerate(brute_templates(rows)):
        assert got[i].template == template and abs(got[i].purity - purity) < 1e-9 and got[i].verdict == ("block" if purity >= L.REJECT else "allow")
    assert any("*" in r.template for r in got.values()) and len({r.verdict for r in got.values()}) == 2


def test_equally_long_rules_and_odd_columns(spark):
    df = spark.createDataFrame([(1, "http://a.b/xy", "k")], "page_id long, url string, __x string")
    assert [L.filtered(df, rules).first().rule for rules in ((("allow", "b/xy"), ("block", "a.b/")), (("block", "a.b/"), ("allow", "b/xy")))] == ["b/xy", "a.b/"]
    assert L.filtered(df, ()).columns == ["page_id", "url", "__x", "host", "path", "rule", "template", "purity", "verdict"]


def test_deep_paths_keep_their_labels(spark):
    base = "/".join("abcdefghij")
    rows = [(i, f"http://h.net/{base}/{'spam' if i % 2 else 'ham'}/x{i}", bool(i % 2)) for i in range(60)]
    out = L.filtered(spark.createDataFrame(rows, "page_id long, url string, bad boolean"), (), label="bad").collect()
    assert len(out) == len(rows) and all((r.verdict == "block") == ("/spam/" in r.url) for r in out)


def test_templates_do_not_depend_on_how_often_a_url_occurs(spark):
    urls = [f"http://v.net/item{chr(97 + i % 26)}{chr(97 + i // 26)}q/page" for i in range(50)]
    for times in (1, 20):
        df = spark.createDataFrame([(i, u) for i, u in enumerate(urls * times)], "page_id long, url string")
        # Half of them is blocked by name, so that branches are not merged by their labels alone.
        df = df.withColumn("bad", F.pmod(F.xxhash64("url"), F.lit(2)) == 0)
        assert {r.template for r in L.filtered(df, (), label="bad").collect()} == {"/*/page"}, times


def test_license_places_equal_brute_force(spark, odd, nothing, clashing):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    texts = [
        "MIT License", "the mit-license and MIT\nLICENSE", "gnu general public public license", "GNU General Public License gnu general public license", "cc by cc by cc", "apache licenses", "mit K license", "mİt license",
        "x Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction.",
        "permission is hereby granted free of charge to any odd person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", None, "", "--cc by--",
    ]
    rows = list(enumerate(texts))
    out = {r.doc_id: r for r in S.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, text in rows:
        w, places, labels = words(text), [], set()
        for p, label in phrases.items():
            p = p.split()
            hits = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            places += hits
            labels |= {label} if hits else set()
        r = out[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert out[8].labels == "mit" and out[9].labels == "mit" and out[8].n_base == 0
    assert S.scan(odd).count() == odd.count() and S.scan(nothing).count() == 0 and S.scan(clashing).count() == odd.count()


@pytest.mark.parametrize("limit", [1 << 25, -1])
def test_many_templates_and_blocks_of_them(spark, monkeypatch, limit):
    monkeypatch.setattr(C, "BROADCAST_BYTES", limit)
    rng = np.random.default_rng(5)
    names = np.array([f"v{i}" for i in range(300)])
    texts = [(" ".join(names[rng.integers(0, 300, 30)]), f"t{i:03d}") for i in range(500)]
    docs = []
    for i in range(60):
        own = texts[7 * i][0].split()
        # Every third has a word put in, every third four words in a row changed.
        own = own[:15] + ["new"] + own[15:] if i % 3 == 1 else own[:10] + ["a", "b", "c", "d"] + own[14:] if i % 3 == 2 else own
        docs.append((i, " ".join([*names[rng.integers(0, 300, 20)], *own, *names[rng.integers(0, 300, 5)]]).upper()))
    out = {r.doc_id: r for r in S.scan(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), (), texts).collect()}
    for i, _ in docs:
        (span,) = out[i].spans
        n = 30 + (i % 3 == 1)
        runs = {0: 27, 1: 24, 2: 20}[i % 3]
        assert out[i].labels == span.label == f"t{7 * i:03d}" and (span.first_word, span.end_word) == (20, 20 + n) and abs(span.cover - runs / 27) < 1e-9 and out[i].n_words == len(docs[i][1].split())


def test_whole_license_texts_are_found(spark):
    from graphmill.llm.license_texts import TEXTS

    docs = [(i, f"Copyright (c) 2020 someone\n\n{t}\n\nint main() {{}}") for i, (t, _) in enumerate(TEXTS)]
    out = {r.doc_id: r for r in S.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(label in out[i].labels.split(",") for i, (_, label) in enumerate(TEXTS))
    whole = {i: max(out[i].spans, key=lambda s: s.end_word - s.first_word) for i, _ in docs}
    assert all((whole[i].first_word, whole[i].end_word) == (4, 4 + len(words(t))) and whole[i].cover == 1.0 for i, (t, _) in enumerate(TEXTS))


CELLS = [("a", "en", "x", 1000), ("a", "fr", "y", 10), ("b", "en", "y", 300), ("b", "fr", "x", 5), ("c", "en", "x", 70), ("c", "fr", "y", 70), ("a", "en", "y", 400), ("b", "fr", "y", 60), ("c", "en", "y", 9), ("b", "en", "x", 200)]


def off(out):
    return max(abs(r.wanted - r.expected) for r in M.margins(out).collect())


@pytest.mark.parametrize("limit", [100_000, 0])
def test_raking_meets_its_margins(spark, odd, nothing, clashing, monkeypatch, limit):
    monkeypatch.setattr(M, "ONE_TASK", limit)
    cells = spark.createDataFrame(CELLS, "source string, lang string, topic string, tokens long")
    out = M.rake(cells).cache()
    assert abs(out.agg(F.sum("weight")).first()[0] - 1) < 1e-9 and out.filter("p > 1 or p < 0").count() == 0 and off(out) < 1e-4
    for d in M.DIMENSIONS:
        actual = {r[0]: r[1] for r in cells.groupBy(d).agg(F.pow(F.sum(F.col("tokens").cast("double")), F.lit(M.TEMPERATURE[d]))).collect()}
        for r in M.margins(out).filter(F.col("dimension") == d).collect():
            assert abs(r.wanted - actual[r.value] / sum(actual.values())) < 1e-9
    if limit:
        got = M.mixed(odd)
        assert got.count() == odd.count() and M.mixed(nothing).count() == 0 and M.mixed(clashing).count() == odd.count()
        twice = got.filter("doc_id = 107").select("kept").collect()
        assert twice[0] == twice[1]


def test_few_cells_are_raked_in_one_row_with_equal_results(spark, monkeypatch):
    """The driver holds two small jobs in place of three windows a sweep; sweeps end by the same rules."""
    cells = spark.createDataFrame(CELLS, "source string, lang string, topic string, tokens long")
    written = []
    monkeypatch.setattr(M, "materialize", lambda df, name, f=M.materialize: (written.append(df._jdf.queryExecution().analyzed().toString()), f(df, name))[1])
    for bounds in ({}, {"sweeps": 8}, {"most": M.SWEEPS}, {"sweeps": 1, "most": 1}, {"sweeps": 3, "targets": {"source": {"c": 0.6}}, "fraction": 0.9}, {"targets": {"source": {"a": 1.0}}}):
        written.clear()
        got = M.rake(cells, **bounds).collect()
        assert len(written) <= 6 and not any("Window" in p for p in written)
        with monkeypatch.context() as m:
            m.setattr(M, "ONE_ROW", 0)
            want = {r[:3]: r for r in M.rake(cells, **bounds).collect()}
        assert len(got) == len(want) == len(CELLS) and all(r[3:] == pytest.approx(want[r[:3]][3:], rel=1e-9, abs=1e-15) for r in got), bounds


def test_targets_are_met_and_never_overdrawn(spark):
    cells = spark.createDataFrame(CELLS, "source string, lang string, topic string, tokens long")
    out = M.rake(cells, {"source": {"a": 0.2, "b": 0.5, "c": 0.3}, "lang": {"fr": 0.3}}, fraction=0.1).cache()
    shares = {(r.dimension, r.value): r for r in M.margins(out).collect()}
    assert [round(shares["source", v].expected, 4) for v in "abc"] == [0.2, 0.5, 0.3] and abs(shares["lang", "fr"].expected - 0.3) < 1e-4 and off(out) < 1e-4
    # c has 149 tokens: the sample is no larger than they allow at a share of 0.6.
    most = M.rake(cells, {"source": {"c": 0.6}}, fraction=0.9, sweeps=8).cache()
    assert most.filter("p > 1").count() == 0 and most.agg(F.sum(F.col("p") * F.col("tokens"))).first()[0] <= M.FILL * 149 / 0.6 + 1e-6
    gone = M.rake(cells, {"source": {"a": 1.0}}, sweeps=8)
    assert gone.filter("source <> 'a' and p > 0").count() == 0


def test_a_given_topic_is_used_and_samples_are_calibrated(spark):
    rows = [(i, "word " * (1 + i % 9), "en" if i % 4 else "fr", "s" if i % 3 else "t", f"k{i % 5}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, subject string")
    out = M.mixed(docs, topic="subject", targets={"topic": {"k0": 0.4}}).cache()
    assert {r.topic for r in out.select("topic").distinct().collect()} == {f"k{i}" for i in range(5)}
    kept = out.filter("kept")
    n = kept.agg(F.sum("n_tokens")).first()[0]
    assert abs(kept.filter("topic = 'k0'").agg(F.sum("n_tokens")).first()[0] / n - 0.4) < 0.03
