import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphmill.llm import language_id as L
from graphmill.llm import media_avi as M


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = L.language_of(docs).filter("held_out")
    n, right = out.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 250 and right / n > 0.98
    assert out.filter("score < 0 or score > 1").count() == 0


def test_labels_of_held_out_documents_are_not_read(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lied = docs.withColumn("lang", F.when(L.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    assert {r.lang_pred for r in L.language_of(lied).select("lang_pred").distinct().collect()} <= {"en", "fr", "de", "es"}


def test_back_off_to_shorter_grams(spark):
    rows = [(i, t, lang, "s", 1) for i, (t, lang) in enumerate([("abcdef ghij", "x"), ("zyxwvu tsrq", "y")] * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    new = spark.createDataFrame([(1, "abcdxx"), (2, "zyxwqq"), (3, "a"), (4, "z")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in L.identify(new, docs).collect()}
    assert got == {1: "x", 2: "y", 3: "x", 4: "y"}


def brute_languages(train, texts):
    """The rule of the module, in plain Python."""
    import math
    import re
    from collections import Counter

    split = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    langs = sorted({lang for _, lang in train})
    counts = {lang: Counter(w for t, x in train if x == lang for w in split(t)) for lang in langs}
    total = {lang: sum(c.values()) for lang, c in counts.items()}
    everything = sum(total.values())

    def telling(w):
        n = sum(c[w] for c in counts.values())
        return sum(2 * c[w] * math.log(c[w] / (n * total[lang] / everything)) for lang, c in counts.items() if c[w]) >= L.SIGNIFICANT

    known = {w for c in counts.values() for w in c if telling(w)}
    tables = [{lang: Counter({w: n for w, n in c.items() if w in known}) for lang, c in counts.items()}]
    pieces = lambda w, k: [f"^{w}$"[i : i + k] for i in range(max(1, len(w) + 3 - k))]
    for k in range(1, 5):
        tables.append({lang: Counter(g for w in c for g in pieces(w, k)) for lang, c in counts.items()})
    kinds = [len(set().union(*t.values())) for t in tables]
    log = lambda k, g, lang: math.log((tables[k][lang][g] + 0.5) / (sum(tables[k][lang].values()) + 0.5 * kinds[k] + 0.5))

    def of(w, lang):
        if w in known:
            return log(0, w, lang)
        for k in range(4, 0, -1):
            if found := [g for g in pieces(w, k) if any(g in tables[k][x] for x in langs)]:
                return sum(log(k, g, lang) for g in found) / len(found)
        return 0.0

    out = []
    for t in texts:
        ws = split(t or "")
        sums = {lang: sum(of(w, lang) for w in ws) for lang in langs}
        best = max(sums, key=lambda x: (sums[x], [-ord(c) for c in x]))
        out.append((best, 1 / sum(math.exp(s - sums[best]) for s in sums.values())) if ws else ("und", 0.0))
    return out


def test_predictions_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    letters = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklmnoé"}
    words = {x: ["".join(rng.choice(list(s), rng.integers(1, 6))) for _ in range(40)] for x, s in letters.items()}
    rows = []
    for i in range(90):
        lang = ["aa", "bb", "cc"][i % 3]
        text = " ".join([*rng.choice(words[lang], rng.integers(1, 12)), *rng.choice(words["aa"], 2), "".join(rng.choice(list("abcdefghijklmnoxyz"), 5)).title(), "12, _x_!"])
        rows.append((i, text if i % 17 else "1 2 3", lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train = [(r.text, r.lang) for r in L.learnable(docs).collect()]
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.language_of(docs).collect()}
    for (i, _, _), (lang, score) in zip(rows, brute_languages(train, [t for _, t, _ in rows]), strict=True):
        assert abs(got[i][1] - score) < 1e-3 and (got[i][0] == lang or score < 0.501), i


def test_language_of_odd_texts(spark, odd, nothing, clashing):
    got = {(r.doc_id, r.text and r.text[:5]): r for r in L.language_of(odd).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0.0 for k in ((101, None), (102, ""), (103, "   \n\t"[:5]), (104, "!!! .")))
    assert len(L.language_of(odd).collect()) == odd.count()
    assert L.language_of(nothing).count() == 0
    assert {r.lang_pred for r in L.identify(odd, nothing).collect()} == {"und"}
    out = L.language_of(clashing)
    assert out.columns.count("score") == 1 and out.count() == odd.count()


@pytest.mark.parametrize("size", [192, 384, 192 * 37])
def test_media_are_lossless_and_decode_to_flat_blocks(size):
    payload = bytes(np.random.default_rng(size).integers(0, 256, size, dtype=np.uint8))
    media = M.store(payload)
    frames, fps, wrong = M.riff_index(media)
    assert fps == 25.0 and wrong is None and M.decode_frames(frames).tobytes() == payload
    px = M.pixels(frames[-1])
    assert (px == np.frombuffer(payload, np.uint8)[-192:, None, None]).all()


def test_general_codes_are_decoded_bit_by_bit():
    """A frame with the standard's own codes, restart markers and an AC coefficient."""
    counts, symbols = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12))
    table = {s: (n, c) for (n, c), s in M._canonical(counts, symbols).items()}
    ac = {0x00: (2, 0b00), 0x01: (2, 0b01)}
    head = (
        b"\xff\xd8" + M._segment(0xDB, b"\x00" + bytes([4] * 64)) + M._segment(0xC0, bytes([8, 0, 8, 0, 16, 1, 1, 0x11, 0])) + M._segment(0xC4, b"\x00" + bytes(counts) + bytes(symbols))
        + M._segment(0xC4, b"\x10" + bytes([0, 2] + [0] * 14) + bytes([0x00, 0x01])) + M._segment(0xDD, b"\x00\x01") + M._segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    )

    def block(dc, first):
        size = abs(dc).bit_length()
        n, c = table[size]
        bits = f"{c:0{n}b}" + (f"{dc if dc > 0 else dc + (1 << size) - 1:0{size}b}" if size else "")
        bits += (f"{ac[1][1]:02b}1" if first else "") + "00"
        bits += "1" * (-len(bits) % 8)
        return int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")

    px = M.pixels(head + block(10, True) + b"\xff\xd0" + block(-6, False) + b"\xff\xd9")
    assert px.shape == (2, 8, 8) and (px[1] == 128 - 3).all()
    x = np.cos((2 * np.arange(8) + 1) * np.pi / 16) * 0.5 * np.sqrt(0.125) * 4
    assert (px[0] == np.rint(128 + 5 + x)[None, :]).all()


def test_shots_are_cut_where_histograms_jump():
    dark, light = np.full((10, 192), 20, np.uint8), np.full((14, 192), 200, np.uint8)
    assert M.shots(np.concatenate([dark, light, dark])) == [(0, 10), (10, 24), (24, 34)]
    assert M.shots(dark) == [(0, 10)] and M.shots(dark[:0]) == []


def test_the_standards_codes_are_whole():
    for counts, symbols in (M._LUMA_DC, M._CHROMA_DC, M._LUMA_AC, M._CHROMA_AC):
        codes = M._canonical(counts, symbols)
        assert sum(counts) == len(codes) == len(set(symbols)) and all(code < (1 << n) - 1 for n, code in codes)
    assert len(M._LUMA_AC[1]) == len(M._CHROMA_AC[1]) == 162


def colour_frame(luma, across, h, v, tables=False):
    """A frame of flat blocks in colours of sampling h x v, with the standard's codes, which are left out of the file."""
    codes = [{s: x for x, s in M._canonical(*t).items()} for t in (M._LUMA_DC, M._LUMA_AC, M._CHROMA_DC, M._CHROMA_AC)]
    down = -(-len(luma) // across)
    bits, last = "", [0, 0, 0]

    def put(c, value):
        nonlocal bits
        dc, ac = codes[:2] if c == 0 else codes[2:]
        diff, last[c] = value - last[c], value
        size = abs(diff).bit_length()
        n, code = dc[size]
        bits += f"{code:0{n}b}" + (f"{diff if diff > 0 else diff + (1 << size) - 1:0{size}b}" if size else "")
        n, code = ac[0]
        bits += f"{code:0{n}b}"

    for my in range(-(-down // v)):
        for mx in range(-(-across // h)):
            for y in range(v):
                for x in range(h):
                    at = (my * v + y, mx * h + x)
                    put(0, luma[at[0] * across + at[1]] - 128 if at[0] < down and at[1] < across and at[0] * across + at[1] < len(luma) else 0)
            put(1, 5)
            put(2, -3)
    bits += "1" * (-len(bits) % 8)
    sof = bytes([8]) + (down * 8).to_bytes(2, "big") + (across * 8).to_bytes(2, "big") + bytes([3, 1, h << 4 | v, 0, 2, 0x11, 0, 3, 0x11, 0])
    head = b"\xff\xd8" + M._segment(0xDB, b"\x00" + bytes([8] * 64)) + M._segment(0xC0, sof) + M._segment(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0]))
    return head + int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00") + b"\xff\xd9"


@pytest.mark.parametrize(("h", "v"), [(1, 1), (2, 1), (2, 2), (1, 2)])
def test_colours_of_any_sampling_without_tables(h, v):
    luma = np.random.default_rng(3).integers(0, 256, 5 * 3).tolist()
    assert M.decode_frames([colour_frame(luma, 5, h, v)] * 2).tolist() == [luma, luma]


def test_pictures_of_many_strips(monkeypatch):
    luma = np.random.default_rng(4).integers(0, 256, 7 * 9).tolist()
    for strip in (1, 5, 64):
        monkeypatch.setattr(M, "STRIP", strip)
        for h, v in [(1, 1), (2, 2), (2, 1)]:
            assert M.decode_frames([colour_frame(luma, 7, h, v)]).tolist() == [luma]


def test_a_false_size_is_refused_before_it_is_decoded(spark):
    frame = colour_frame([9] * 15, 5, 2, 2)
    at = frame.index(b"\xff\xc0") + 5
    false = frame[:at] + b"\xff\xff\xff\xff" + frame[at + 4 :]
    with pytest.raises(M.Broken):
        M.decode_frames([false])
    whole = M.store(bytes(range(192)) * 3)
    size = whole.index(b"\xff\xc0") + 5
    media = whole[:size] + b"\xff\xff\xff\xff" + whole[size + 4 :]
    rows = {r.k: r for r in M.read_media(spark.createDataFrame([(0, bytearray(media)), (1, bytearray(whole))], "k long, media binary")).collect()}
    assert rows[0].error and rows[1].error is None and rows[1].n_frames == 3


def test_media_columns(spark, odd, nothing, clashing):
    out = M.media_round_trip(odd.select("doc_id", "text")).collect()
    assert len(out) == odd.count() and set(out[0].asDict()) == {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"}
    payload = {}
    for r in odd.collect():
        t = (r.text or "").encode()
        payload.setdefault(r.doc_id, t + b" " * (-len(t) % 192 or (0 if t else 192)))
    for r in out:
        p = payload[r.doc_id]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert r.feature.startswith(f"frames={len(p) // 192};shots=") and r.media_sha256 == hashlib.sha256(M.store(p)).hexdigest()
    same = [r for r in out if r.doc_id == 107]
    assert same[0] == same[1]
    assert M.store_media(nothing).count() == 0 and M.media_round_trip(nothing.select("doc_id", "text")).count() == 0
    found = M.clips(M.store_media(clashing)).filter("doc_id = 105").orderBy("clip").collect()
    assert found[0].first_frame == 0 and found[-1].end_frame == -(-150_000 // 192) and found[0].end_s > 0


def test_broken_media_are_told_and_fail_nothing(spark):
    payload = bytes(np.random.default_rng(1).integers(0, 256, 192 * 6, dtype=np.uint8))
    whole = M.store(payload)
    nested = b"RIFF\xff\xff\xff\x00AVI " + b"LIST\xff\xff\xff\x00abcd" * 50_000
    no_index = whole[: whole.index(b"idx1")]
    cases = [None, b"", b"RIFF", b"RIFF\0\0\0\0AVI LIST", nested, no_index, whole[:2000], whole.replace(M.HEAD[-14:], b"\xff\xda\x00\x0c" + b"\0" * 10), *[whole[:n] for n in range(0, len(whole), 97)]]
    df = spark.createDataFrame([(i, bytearray(c) if c is not None else None) for i, c in enumerate([*cases, whole])], "k long, media binary")
    got = {r.k: r for r in M.read_media(df).collect()}
    assert len(got) == len(cases) + 1 and all(got[i].error for i in range(len(cases)))
    last = got[len(cases)]
    assert last.error is None and last.payload_sha256 == hashlib.sha256(payload).hexdigest() and last.n_frames == 6
    assert got[5].n_frames == 6 and got[5].payload_sha256 == last.payload_sha256 and got[5].error == "cut off" and 0 < got[6].n_frames < 6
    assert {r.k for r in M.clips(df).collect()} >= {5, 6, len(cases)}
