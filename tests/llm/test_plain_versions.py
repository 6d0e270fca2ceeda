"""Operators against plain versions of themselves, streams made by hand, forced small limits, and rows that share an id."""

import collections
import hashlib
import math
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import groups, removed

from lodestone.llm import commonest, jaccard, mixing, quality, queries, repeats, sharding, toxicity, webp

RNG = np.random.default_rng(12)


# media


def plain_prediction(mode, left, top, right, corner):
    """One channel-wise prediction from (alpha, red, green, blue) neighbours, as the format describes it."""
    half = lambda a, b: tuple((x + y) // 2 for x, y in zip(a, b, strict=True))
    clamp = lambda v: max(0, min(255, v))
    simple = {0: (255, 0, 0, 0), 1: left, 2: top, 3: right, 4: corner, 6: half(left, corner), 7: half(left, top), 8: half(corner, top), 9: half(top, right)}
    if mode in simple:
        return simple[mode]
    if mode == 5:
        return half(half(left, right), top)
    if mode == 10:
        return half(half(left, corner), half(top, right))
    if mode == 11:
        guess = [a + b - c for a, b, c in zip(left, top, corner, strict=True)]
        near = [sum(abs(g - x) for g, x in zip(guess, side, strict=True)) for side in (left, top)]
        return left if near[0] < near[1] else top
    if mode == 12:
        return tuple(clamp(a + b - c) for a, b, c in zip(left, top, corner, strict=True))
    return tuple(clamp(m + int((m - c) / 2)) for m, c in zip(half(left, top), corner, strict=True))


def split(v):
    return tuple(int(v) >> s & 255 for s in (24, 16, 8, 0))


def plain_undo_predictor(rest, modes, block):
    height, width = rest.shape
    out = [[None] * width for _ in range(height)]
    for y in range(height):
        for x in range(width):
            mode = modes[y >> block][x >> block] >> 8 & 15
            if x == 0 or y == 0:
                guess = (255, 0, 0, 0) if x == y == 0 else out[y][x - 1] if y == 0 else out[y - 1][x]
            else:
                # behind the last pixel of the row above comes the first one of this row
                right = out[y - 1][x + 1] if x + 1 < width else out[y][0]
                guess = plain_prediction(mode, out[y][x - 1], out[y - 1][x], right, out[y - 1][x - 1])
            out[y][x] = tuple((a + b) & 255 for a, b in zip(guess, split(rest[y, x]), strict=True))
    return [[a << 24 | r << 16 | g << 8 | b for a, r, g, b in row] for row in out]


@pytest.mark.parametrize("mode", range(14))
def test_predictor_modes_equal_plain_ones(mode):
    for height, width in ((1, 1), (1, 9), (6, 1), (6, 9)):
        rest = RNG.integers(0, 1 << 32, (height, width), dtype=np.uint32)
        modes = np.full((2, 3), mode << 8, np.uint32)
        assert webp._undo_predictor(rest, modes, 2).tolist() == plain_undo_predictor(rest, modes.tolist(), 2)
        if mode:
            assert (webp.decode(webp.encode(rest, [("predict", mode)]))[0] == rest).all()


def test_predictor_blocks_may_differ():
    rest, modes = RNG.integers(0, 1 << 32, (9, 11), dtype=np.uint32), RNG.integers(0, 14, (3, 3)).astype(np.uint32) << np.uint32(8)
    assert webp._undo_predictor(rest, modes, 2).tolist() == plain_undo_predictor(rest, modes.tolist(), 2)


def test_every_transform_round_trips():
    for height, width in ((1, 1), (3, 5), (40, 30)):
        any_ = RNG.integers(0, 1 << 32, (height, width), dtype=np.uint32)
        for steps in ([], [("green",)], [("cross", (17, -90, 33))], [("green",), ("predict", 11), ("cross", (-128, 127, 1))]):
            assert (webp.decode(webp.encode(any_, steps))[0] == any_).all()
        for colours in (1, 2, 3, 4, 5, 16, 17, 200):
            few = np.unique(RNG.integers(0, 1 << 32, colours, dtype=np.uint32))
            image = few[RNG.integers(0, len(few), (height, width))]
            assert (webp.decode(webp.encode(image, [("palette", few)]))[0] == image).all() and (webp.decode(webp.encode(image))[0] == image).all()
    y, x = np.mgrid[0:60, 0:80]
    smooth = (0xFF << 24 | (x * 3 + y & 255) << 16 | (y * 2 & 255) << 8 | (x + y & 255)).astype(np.uint32)
    assert any(step[0] == "predict" for step in webp.plan(smooth)) and len(webp.encode(smooth)) < smooth.size
    red = RNG.integers(0, 256, (40, 40)).astype(np.uint32)
    assert [s[0] for s in webp.plan(red << 16 | red << 8 | red)] == ["green"]
    one = np.full((3, 3), 7, np.uint32)
    assert (webp.decode(webp.encode(one))[0] == one).all()


def put(w, *fields):
    for bits, value in fields:
        w.put(bits, value)


def header(width, height):
    w = webp.Writer()
    put(w, (8, webp.SIGNATURE), (14, width - 1), (14, height - 1), (4, 0), (1, 0))
    return w


def lengths(size, **used):
    out = np.zeros(size, np.uint8)
    for s, n in used.items():
        out[int(s[1:])] = n
    return out


def put_symbols(w, code, *symbols):
    values, bits = webp.codes_of(code)
    put(w, *[(int(bits[s]), int(values[s])) for s in symbols])


def test_copies_give_what_stood_before():
    w = header(4, 3)
    put(w, (1, 1), (4, 2), (1, 0))
    green = lengths(284, s5=2, s9=3, s258=3, s260=3, s280=3, s281=4, s282=4, s283=3)
    far = lengths(40, s0=1, s1=1)
    for n in (green, lengths(256, s0=1), lengths(256, s0=1), lengths(256, s255=1), far):
        webp._put_code(w, n)
    a, b = 0xFF000500, 0xFF000900
    slot = (0x1E35A7BD * a & 0xFFFFFFFF) >> 30
    put_symbols(w, green, 5, 9)
    put_symbols(w, green, 258)
    put_symbols(w, far, 1)  # one to the left, three times
    put_symbols(w, green, 280 + slot)
    put_symbols(w, green, 260)
    put(w, (1, 1))  # six pixels
    put_symbols(w, far, 0)  # from the row above
    assert webp.decode_stream(w.bytes()).reshape(-1).tolist() == [a, b, b, b, b, a, b, b, b, a, b, b]


def test_groups_of_a_meta_image():
    w = header(8, 4)
    put(w, (1, 0), (1, 1), (3, 0))  # no cache; groups by blocks of 4 pixels
    put(w, (1, 0))
    pair = lengths(280, s0=1, s1=1)
    for n in (pair, *[lengths(256, s0=1)] * 3, lengths(40, s0=1)):
        webp._put_code(w, n)
    put_symbols(w, pair, 0, 1)  # the left block is of group 0, the right one of group 1
    for first, second in ((10, 11), (20, 21)):
        for n in (lengths(280, **{f"s{first}": 1, f"s{second}": 1}), *[lengths(256, s0=1)] * 3, lengths(40, s0=1)):
            webp._put_code(w, n)
    bits = RNG.integers(0, 2, 32).tolist()
    put(w, *[(1, b) for b in bits])
    want = [((10 if k % 8 < 4 else 20) + b) << 8 for k, b in enumerate(bits)]
    assert webp.decode_stream(w.bytes()).reshape(-1).tolist() == want


def test_broken_streams_raise():
    good = webp.encode(RNG.integers(0, 1 << 32, (9, 9), dtype=np.uint32))
    with pytest.raises(ValueError):
        webp.decode_stream(good[20:60])
    with pytest.raises(ValueError, match="image"):
        webp.decode(b"RIFX" + good[4:])
    with pytest.raises(ValueError, match="prefix code"):
        webp.code_of(np.array([1, 2], np.uint8))


def test_media_of_texts_use_copies_and_are_smaller(spark):
    text = "the thought of an other nation is here and there. " * 20 + "".join(chr(97 + int(i)) for i in RNG.integers(0, 26, 3000))
    payload = np.full(-(-len(text) // 576) * 576, 255, np.uint8)
    payload[: len(text)] = np.frombuffer(text.encode(), np.uint8)
    pixels = webp.pixels_of(payload, webp.ROW).reshape(-1)
    assert webp.copies_in(pixels) and all((pixels[i : i + n] == pixels[i - far : i - far + n]).all() for i, n, far in webp.copies_in(pixels) if far >= n)
    rows = webp.media_report(spark.createDataFrame([(1, text), (2, text), (3, None)], "doc_id long, text string")).collect()
    assert rows[0].media_bytes < rows[0].payload_bytes and rows[0][1:] == rows[1][1:] and rows[2].media_bytes < 576
    assert rows[0].payload_sha256 == hashlib.sha256(payload.tobytes()).hexdigest() and rows[0].tail_crc32 == zlib.crc32(payload[-32:].tobytes())


def test_code_lengths_are_bounded_and_whole():
    for counts, most in ((np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377]), 7), (RNG.integers(0, 1000, 256), 10), (np.array([0, 4]), 15)):
        n = webp.code_lengths(counts, most).astype(int)
        assert ((n > 0) == (counts > 0)).all() and n.max() <= most and (sum(2.0 ** -n[n > 0]) == 1 or np.count_nonzero(n) == 1)


# quality


def plain_kneser_ney(trusted, order):
    """p(byte | context) of an interpolated modified Kneser-Ney model over bytes."""
    grams = collections.Counter(t[i : i + order] for t in trusted for i in range(len(t) - order + 1))
    counts = {order: grams}
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    cuts = {}
    for k, c in counts.items():
        n = [sum(v == j for v in c.values()) for j in range(1, 5)]
        if n[0] and n[1]:
            y = n[0] / (n[0] + 2 * n[1])
            d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1] if n[1] else 1.0, 3 - 4 * y * n[3] / n[2] if n[2] else 1.5]
            cuts[k] = [min(max(v, 0.01), j + 0.99) for j, v in enumerate(d)]
        else:
            cuts[k] = [0.5] * 3
    about = {k: collections.defaultdict(list) for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            about[k][g[:-1]].append(n)

    def p(gram):
        if not gram:
            return 1 / 256
        k, seen = len(gram), about[len(gram)].get(gram[:-1])
        if not seen:
            return p(gram[1:])
        total, d = sum(seen), cuts[k]
        n = counts[k].get(gram, 0)
        own = max(0, n - d[min(n, 3) - 1]) if n else 0
        return own / total + sum(d[min(v, 3) - 1] for v in seen) / total * p(gram[1:])

    return p


@pytest.mark.parametrize("table", [1, 1 << 19])
def test_perplexity_equals_a_plain_model(spark, monkeypatch, table):
    monkeypatch.setattr(quality, "TABLE", table)
    rng = random.Random(4)
    words = ["the", "then", "other", "Ätna", "on", "no"]
    trusted = [" ".join(rng.choice(words) for _ in range(20)) for _ in range(12)]
    rows = [(k, t) for k, t in enumerate(trusted[:4])] + [(10, "zzz qq the"), (11, "abc"), (12, ""), (13, None), (14, "The other " * 40), (15, "one half"), (15, "other half")]
    got = {r.doc_id: r.perplexity for r in quality.perplexities(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(t,) for t in trusted], "text string")).collect()}
    low = lambda t: t.encode().lower() if t.isascii() else bytes(b + 32 if 65 <= b <= 90 else b for b in t.encode())
    p = plain_kneser_ney([low(t) for t in trusted], quality.ORDER)
    logs = collections.defaultdict(list)
    for i, t in rows:
        raw = low(t or "")
        logs[i] += [math.log(p(raw[k : k + 5])) for k in range(len(raw) - 4)]
    want = {i: math.exp(-sum(v) / len(v)) for i, v in logs.items() if v}
    assert set(got) == set(want) and all(got[i] == pytest.approx(want[i], rel=1e-5) for i in want)


def test_quality_report_handles_odd_rows(spark):
    docs = spark.createDataFrame([(k, "plain words here " * 9, "en" if k % 2 else None) for k in range(40)] + [(50, "\x01\x02#*" * 50, "en"), (51, None, "xx"), (52, "ab", None), (None, "text of nobody", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1) for k in range(40)] + [(None, 1), (50, 0)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality_report(docs, labels).collect()}
    assert len(got) == 44 and not got[50].keep and all(got[k].keep for k in (*range(40), 51, 52, None)) and got[51].perplexity is None
    untrusted = quality.quality_report(docs, labels.where("false")).collect()
    assert len(untrusted) == 44 and all(r.keep for r in untrusted)


def test_commonest_rows_by_threshold(spark):
    rows = spark.range(1000).selectExpr("id", "CASE WHEN id < 10 THEN 500 + id WHEN id < 50 THEN 20 ELSE 1 END AS n")
    take = lambda most, least=1: sorted(commonest.commonest(rows, {"id": "int64"}, most, least)[0].tolist())
    assert (take(5), take(10), take(49), take(50), take(999), len(take(1000)), take(100, 2)) == ([], list(range(10)), list(range(10)), list(range(50)), list(range(50)), 1000, list(range(50)))


# toxicity


def test_long_texts_have_the_features_of_short_ones(monkeypatch):
    data = RNG.integers(97, 103, 5000).astype(np.uint8)
    whole = toxicity.row_features(data, np.array([0, len(data)]))
    monkeypatch.setattr(toxicity, "CHUNK", 700)
    parts = toxicity.row_features(data, np.array([0, len(data)]))
    assert sorted(whole[1].tolist()) == sorted(parts[1].tolist()) and not parts[0].any()


def test_buckets_and_ratios_equal_plain_counts(spark):
    rows = [(k, ("zak vox " if k % 3 == 0 else "garden river ") * (k % 4 + 1), int(k % 3 == 0)) for k in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    known = spark.createDataFrame([(r[0], r[2]) for r in rows], "l_id long, label int")
    sample, n = toxicity.sample_of(docs, known, 1000, 1 << 20, 1 << 20)
    assert n == {0: 40, 1: 20} and sample.count() == 60
    counts = sample.mapInArrow(toxicity._count, "bucket int, pos int, neg int").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    buckets, rate = toxicity.choose(counts, 20, 40, 20000)
    seen = {0: collections.Counter(), 1: collections.Counter()}
    for _, text, label in rows:
        raw = np.frombuffer(text.encode(), np.uint8)
        seen[label].update(toxicity.row_features(raw, np.array([0, len(raw)]))[1].tolist())
    want = {}
    for b in seen[0] | seen[1]:
        pos, neg = seen[1][b], seen[0][b]
        mean = (pos + neg) * 20 / 60
        if pos + neg >= 3 and (pos - mean) ** 2 / (mean * (1 - (pos + neg) / 61)) > 4:
            want[b] = math.log((pos + 1) / 22) - math.log((neg + 1) / 42)
    assert dict(zip(buckets.tolist(), rate.tolist(), strict=True)) == pytest.approx(want)


def test_weights_fall_where_the_gradient_is_none():
    features = [np.array([0, 1]), np.array([0]), np.array([1]), np.array([], int), np.array([1, 2])]
    y, rate = np.array([1, 1, 0, 0, 0]), np.array([1.2, -0.8, -0.5])
    weights, bias = toxicity.fit_rows(features, y, rate, ridge=1e-1, rounds=3000, mean_share=0.0)
    x = np.zeros((5, 3))
    for k, f in enumerate(features):
        x[k, f] = 1
    w = weights / rate
    error = np.where(y == 1, 0.25, 1 / 6) * (1 / (1 + np.exp(-(x * rate @ w + bias))) - y)
    assert np.abs((x * rate).T @ error + 1e-1 * w).max() < 1e-3 and abs(error.sum()) < 1e-3


def test_scores_of_odd_rows(spark):
    docs = spark.createDataFrame([(k, ("zak vox kro " if k % 2 else "garden river ") * 20) for k in range(90)] + [(200, "zak vox kro " * 60_000), (201, None), (202, ""), (None, "zak vox kro " * 9), (3, "garden river " * 9)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(90)] + [(None, 1), (200, None), (999, 1)], "doc_id long, toxic int")
    got = {(r.doc_id, k): r for k, r in enumerate(toxicity.toxicity_report(docs, labels).collect())}
    assert len(got) == 95
    by = collections.defaultdict(list)
    for (i, _), r in got.items():
        by[i].append(r)
    assert by[200][0].predicted == 1 and by[None][0].predicted == 1 and by[201][0].score == by[202][0].score and not by[201][0].predicted
    assert sorted(r.predicted for r in by[3]) == [0, 1]


# similarity, repeats and rows that share an id


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (2, 70)])
def test_groups_under_small_limits(spark, monkeypatch, n, percent):
    for name, value in (("BLOCK", 4), ("FREQUENT", 8), ("LOOK", 3), ("BLOCK_TOKENS", 60)):
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(percent)
    base = [[rng.choice("abcdefgh") + str(rng.randint(0, 30)) for _ in range(40)] for _ in range(4)]
    passage = " ".join("same" + str(k) for k in range(12))
    rows = []
    for i in range(90):
        words = [w if rng.random() > 0.03 else "new" + str(rng.randint(0, 5)) for w in rng.choice(base)]
        rows.append((i, (passage + " " if i % 3 else "") + " ".join(words)))
    got = jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), n, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == groups(rows, n, percent)


def test_prefix_trees_find_what_pairs_find():
    rng = random.Random(2)
    for trial in range(60):
        percent = rng.choice([80, 90])
        bases = [[rng.randrange(200) for _ in range(rng.randint(1, 40))] for _ in range(3)]
        sets = [np.array(sorted({x if rng.random() > 0.06 else rng.randrange(300) for x in rng.choice(bases)}), np.uint64) for _ in range(rng.randint(2, 25))]
        size, label = np.array([len(s) for s in sets]), np.array([rng.randrange(5) for _ in sets])
        side = np.array([rng.randrange(2) for _ in sets]) if trial % 2 else None
        prefix = [v[: len(v) - jaccard.least_overlap(len(v), -(-percent * len(v) // 100), percent) + 1] for v in sets]
        found = {tuple(sorted(p)) for p in jaccard.prefix_pairs(prefix, size, label, side, percent)}
        kept = {tuple(sorted(p)) for p in jaccard.likely(sorted(found), [jaccard.sketch(s).tobytes() for s in sets], size, percent)}
        linked = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if label[i] != label[j] and (side is None or side[i] != side[j]) and len(np.intersect1d(sets[i], sets[j])) >= jaccard.least_overlap(len(sets[i]), len(sets[j]), percent)}
        assert linked <= kept <= found


def test_repeats_of_rows_that_share_an_id(spark):
    rng = random.Random(8)
    text = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    p, own, more = text(200), text(300), text(150)
    rows = [(1, p), (2, p + own), (2, more), (2, more), (3, more + text(120)), (None, p), (4, "x" * 250), (4, "y" * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in repeats.repeat_report(docs).collect())
    assert got == sorted([(1, 200, 0), (2, 500, 200), (2, 150, 0), (2, 150, 0), (3, 270, 150), (0, 200, 0), (4, 250, 249), (4, 30, 0)])
    kept = sorted(r.text for r in repeats.without_repeats(docs).where("doc_id = 2").collect())
    assert kept == sorted([own, more, more])


def test_repeats_in_order_of_a_hash_under_one_id(spark):
    rng = random.Random(9)
    p = "".join(rng.choice("abcdefgh ") for _ in range(150))
    rows = [(7, p + "1" * 40), (7, p + "2" * 40), (8, p)]
    hashes = {r.t: r.h for r in spark.createDataFrame([(t,) for _, t in rows], "t string").selectExpr("t", "xxhash64(t) AS h").collect()}
    order = sorted(rows, key=lambda r: (r[0], hashes[r[1]]))
    want = removed([(k, t) for k, (_, t) in enumerate(order)])
    got = sorted((r.kept_sha256, r.n_removed) for r in repeats.repeat_report(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted((want[k][3], want[k][1]) for k in want)


def test_keep_one_of_rows_that_share_an_id(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(1, a, 1), (2, a + " tail", 2), (2, b, 3), (3, c, 4), (3, c, 5), (None, b, 6), (4, None, 7), (4, "", 8), (4, None, 9), (5, c, 10)]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string, row_key int"))
    assert kept.columns == ["doc_id", "text", "row_key"]
    got = [(r.doc_id, r.text) for r in kept.collect()]
    texts = collections.Counter(t for _, t in got)
    assert texts[a] == texts[b] == texts[c] == 1 and texts[None] == 2 and texts[""] == 1 and len(got) == 6
    assert (1, a) in got and (5, c) in got


# sharding and mixing


def plain_hilbert(point, bits):
    """Index of a point by Skilling's transform, digit by digit."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0], x[i] = x[0] ^ t, x[i] ^ t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        t ^= q - 1 if x[n - 1] & q else 0
        q >>= 1
    digits = "".join(str((v ^ t) >> b & 1) for b in range(bits - 1, -1, -1) for v in x)
    return int(digits, 2)


def test_hilbert_index_equals_a_plain_one(spark):
    rng = random.Random(3)
    points = [tuple(rng.randrange(16) for _ in range(4)) for _ in range(300)]
    rows = spark.createDataFrame(points, "a long, b long, c long, d long")
    got = rows.select("a", "b", "c", "d", sharding.hilbert_index([F.col(c) for c in "abcd"], 4).alias("h")).collect()
    assert all(r.h == plain_hilbert(tuple(r[:4]), 4) for r in got)


def test_shards_have_narrow_ranges(spark):
    rng = random.Random(6)
    rows = spark.createDataFrame([(k, rng.random(), rng.random()) for k in range(4000)], "doc_id long, x double, y double")
    got = sharding.hilbert_shards(rows, 16, ["x", "y"], [], ["doc_id"], ["doc_id", "x", "y"], 5).toPandas()
    width = lambda key: float(np.mean([g.x.max() - g.x.min() + g.y.max() - g.y.min() for _, g in got.groupby(key)]))
    assert width("shard") < 0.45 * width(got.doc_id % 16)


def test_water_filling_equals_small_steps():
    rng = random.Random(5)
    for _ in range(20):
        weights, caps = [rng.choice([5, 2, 1]) for _ in range(6)], [rng.randint(1, 80) for _ in range(6)]
        budget = min(sum(caps), rng.randint(1, 300))
        got = mixing.water_fill([Fraction(w) for w in weights], [Fraction(c) for c in caps], Fraction(budget))
        # the level at which all sources, each up to its cap, hold the budget
        low, high = 0.0, 1000.0
        for _ in range(100):
            level = (low + high) / 2
            low, high = (level, high) if sum(min(c, level * w) for c, w in zip(caps, weights, strict=True)) < budget else (low, level)
        assert [float(g) for g in got] == pytest.approx([min(c, low * w) for c, w in zip(caps, weights, strict=True)], abs=1e-6)


def mixed(spark, rows):
    docs = spark.createDataFrame([(k, " ".join(["w"] * n), s) for k, (n, s) in enumerate(rows)], "doc_id long, text string, source string").repartition(5)
    return mixing.mix_report(docs).toPandas().merge(docs.select("doc_id", "source").toPandas(), "outer", "doc_id")


def test_a_target_is_met_beside_a_document_that_cannot_fit(spark):
    got = mixed(spark, [(10, "a")] * 2499 + [(40_000, "a")])
    assert got.target[0] == 97_485 and got.taken.sum() == 64_990 + 24_990


def test_no_document_that_still_fits_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_A_GROUP", 20)
    sizes = np.concatenate([RNG.integers(1, 40, 700), RNG.integers(1, 3, 200), [5000, 3000, 0, 0, 777]])
    got = mixed(spark, [(int(n), [None, "x", "y", "é"][int(k)]) for n, k in zip(sizes, RNG.choice(4, len(sizes), p=[0.1, 0.6, 0.2, 0.1]), strict=True)])
    assert len(got) == len(sizes)
    for _, g in got.groupby("source", dropna=False):
        target, own = g.target.iloc[0], g["size"].sum()
        left = target - g.taken.sum()
        whole = int(target // own)
        assert ((g.taken == whole * g["size"]) | (g.taken == (whole + 1) * g["size"])).all() and left >= -1e-6
        out = g["size"][(g.taken == whole * g["size"]) & (g["size"] > 0)]
        assert left <= target * mixing.NEAR or not len(out) or left < out.min()


def test_stages_keep_columns_whose_names_clash(spark):
    import corpus_pipeline

    names = ["copy_", "mix_copies", "mix_size", "own_", "rows_", "row_", "first_", "size_", "had_text", "row_key", "kept", "p_no", "part", "gap", "doc"]
    rows = [(k, f"one two three four five six seven {k % 3}", "en", "s", 5) for k in range(12)] + [(20, None, None, None, None), (20, "", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for n, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(n))
    for stage in (corpus_pipeline.jaccard_stage, corpus_pipeline.repeats_stage, corpus_pipeline.mixing_stage):
        got = stage(spark, docs, "")
        assert got.columns == docs.columns
        assert all([r[name] for name in names] == list(range(len(names))) for r in got.collect()) and got.count() > 0


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_oracle(spark, sf, key):
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    want = con.execute(queries.ORACLES[key]).df()
    got = queries.QUERIES[key](spark, sf).toPandas()[list(want.columns)]
    whole = lambda f: sorted(tuple(None if v is None or v != v else v for v in r) for r in f.astype(object).where(f.notna(), None).itertuples(index=False))
    assert whole(got) == whole(want)


def test_copies_have_three_pixels_and_read_back_among_literals():
    v = np.array([1, 2, 9, 1, 2, 8, 5, 6, 7, 5, 6, 7, 3, 1, 2], np.uint32)
    assert webp.copies_in(v) == [(9, 3, 3)]
    rng = np.random.default_rng(3)
    text = b"the red fox and the old dog, ".ljust(64) * 30 + bytes(rng.integers(0, 256, 700, np.uint8)) + "Prüfung \U0001f600 ".encode() * 90
    payload = np.full(-(-len(text) // webp.UNIT) * webp.UNIT, 255, np.uint8)
    payload[: len(text)] = np.frombuffer(text, np.uint8)
    for part in (payload, payload[: webp.UNIT * 2], np.tile(payload, 12)):
        assert (webp.samples_of(webp.decode(webp.store(part))[0]) == part).all()


def test_counts_times_logarithms_are_looked_up():
    for counts in (np.arange(4096), np.array([0, 1, 70000])):
        assert webp._weighed(counts).tolist() == (counts * np.log2(np.maximum(counts, 1))).tolist()


def test_images_are_read_by_stretches_as_symbol_by_symbol(monkeypatch):
    rng = np.random.default_rng(5)
    text = ("It was seen, and seen again: é ü 12.5 % of it. " * 90 + "".join(map(chr, rng.integers(32, 126, 9000)))).encode()
    texts = np.frombuffer(text[: len(text) // 576 * 576], np.uint8)
    few = rng.integers(0, 40, 576 * 40).astype(np.uint8)  # pixels that come back, so a cache and copies
    flat, noise = np.full(576 * 9, 255, np.uint8), rng.integers(0, 256, 576 * 12).astype(np.uint8)
    colours = rng.integers(0, 2**32, 3000, dtype=np.uint32)[rng.integers(0, 3000, 144 * 90)].view(np.uint8)
    media = [webp.encode(webp.pixels_of(v, 144), steps) for v in (texts, few, flat, noise, colours) for steps in ([], None)]
    singly = []
    monkeypatch.setattr(webp, "_read_singly", lambda *a, plain=webp._read_singly: (singly.append(a[3]), plain(*a)))
    fast = [webp.decode(m)[0] for m in media]
    # only images of fewer pixels than a stretch is worth, and such of no bits, are read symbol by symbol
    assert len(singly) < len(media)
    monkeypatch.setattr(webp, "_read_stretches", webp._read_singly)
    for m, image in zip(media, fast, strict=True):
        assert (webp.decode(m)[0] == image).all()
    # a stream that ends early is an error in both ways of reading
    short = media[0][:16] + (2000).to_bytes(4, "little") + media[0][20:2020]
    for _ in (0, 1):
        with pytest.raises(ValueError, match="ends early"):
            webp.decode(short)
        monkeypatch.undo()
