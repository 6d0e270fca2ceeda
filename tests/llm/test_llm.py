"""The ten operators against brute force, exact round trips and held-out accuracy, and their edge cases."""

import collections
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from lodestone.llm import bpe, components, jaccard, licences, mixing, neighbours, quality, repeats, sharding, toxicity, webp

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows."""
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "All rights reserved cc by x", "en", "a", 1), (3, "All rights reserved cc by x", "en", "a", 1), (4, "é" * 70_000, "fr", None, 2), (5, "one", "en", "b", 3), (6, "one", "en", "b", 3), (7, "a b c d e f g h " * 3000, "de", "b", 9)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def toxic_labels(spark):
    return spark.createDataFrame([(k, 1, k % 2) for k in range(8)], "doc_id long, quality int, toxic int")


def test_empty_tables_give_no_rows(spark, none, toxic_labels):
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert [df.count() for df in (sharding.shard_documents(none), mixing.mix_report(none), bpe.token_report(none, PATH, public_tokenizers.PATTERN), repeats.repeat_report(none), licences.scan(none), jaccard.similar_groups(none), neighbours.search(vectors), webp.media_report(none), toxicity.toxicity_report(none, toxic_labels), quality.quality_report(none, toxic_labels))] == [0] * 10


def test_odd_rows_pass_every_operator(odd, toxic_labels):
    n = odd.count()
    for df in (sharding.shard_documents(odd), mixing.mix_report(odd), bpe.token_report(odd, PATH, public_tokenizers.PATTERN), repeats.repeat_report(odd), licences.scan(odd), jaccard.similar_groups(odd), webp.media_report(odd), toxicity.toxicity_report(odd, toxic_labels)):
        assert df.count() == n
    assert jaccard.keep_one(odd).columns == odd.columns
    assert repeats.without_repeats(odd).columns == odd.columns


def test_shards_differ_by_one_row_and_slots_have_no_gap(docs):
    got = sharding.shard_documents(docs).toPandas()
    assert sorted(got.doc_id) == sorted(r.doc_id for r in docs.collect())
    sizes = got.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and len(sizes) == 24
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_hilbert_neighbours_differ_in_one_step(spark):
    from pyspark.sql import functions as F

    cells = spark.range(16 * 16).select((F.col("id") % 16).alias("x"), (F.col("id") / 16).cast("long").alias("y"))
    path = [(r.x, r.y) for r in cells.orderBy(sharding.hilbert_index([F.col("x"), F.col("y")], 4)).collect()]
    assert all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(path, path[1:], strict=False))


def test_water_filling_reshares_what_caps_leave():
    assert mixing.water_fill([Fraction(5), Fraction(2), Fraction(1)], [Fraction(10), Fraction(100), Fraction(100)], Fraction(70)) == [10, 40, 20]


def test_mix_meets_its_targets_and_repeats(docs):
    got = mixing.mix_report(docs).toPandas()
    assert (got.taken <= 2 * got["size"]).all()
    for _, g in got.groupby("source_size"):
        target, whole = g.target.iloc[0], int(g.target.iloc[0] // g["size"].sum())
        out = g["size"][(g.taken == whole * g["size"]) & (g["size"] > 0)]
        assert -1e-6 <= target - g.taken.sum() and (target - g.taken.sum() <= target / 1000 or target - g.taken.sum() < out.min())
    again = mixing.mix_report(docs.repartition(5)).toPandas()
    assert dict(zip(got.doc_id, got.taken, strict=True)) == dict(zip(again.doc_id, again.taken, strict=True))


def test_bpe_equals_the_library(docs, odd):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
    for frame in (docs, odd):
        got = {r.doc_id: r for r in bpe.token_report(frame, PATH, public_tokenizers.PATTERN).collect()}
        for r in frame.collect():
            ids = library.encode_ordinary(r.text or "")
            assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_stitched_chunks_equal_the_whole():
    code, rng = bpe.coder(PATH, public_tokenizers.PATTERN), random.Random(1)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
    for _ in range(200):
        text = "".join(rng.choice(["a", " ", "  ", "\n", "'re", "'", "é", "日本", "12", "word ", "\x1c", "x" * rng.randint(1, 90)]) for _ in range(250))
        step, overlap = rng.choice([60, 100]), rng.choice([20, 40])
        chunk = step + overlap
        parts = [(b, text[b : b + chunk], code.starts(text[b : b + chunk], b + chunk >= len(text))) for b in range(0, len(text) - overlap, step)]
        assert [i for words in code.stitch(iter(parts)) for i in code.encode(words)] == library.encode_ordinary(text)


def test_decoding_gives_the_bytes(spark, docs):
    tokens = bpe.encode(docs.select("doc_id", "text").limit(20), PATH, public_tokenizers.PATTERN)
    assert all(bytes(r.decoded).decode() == r.text for r in bpe.decode(tokens, PATH, public_tokenizers.PATTERN).collect())


def removed(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        covered = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                covered[p : p + 100] = b"\1" * 100
            seen.add(raw[p : p + 100])
        runs = sum(1 for p, c in enumerate(covered) if c and not (p and covered[p - 1]))
        out[i] = (len(raw), sum(covered), runs, hashlib.sha256(bytes(x for x, c in zip(raw, covered, strict=True) if not c)).hexdigest())
    return out


def test_repeats_equal_brute_force(spark, docs):
    rng = random.Random(5)
    bits = ["alpha", "beta", "é", "日本", "delta ", "x" * 7, "\n"]
    passages = ["".join(rng.choice(bits) for _ in range(60)) for _ in range(6)]
    made = [(i, "".join(rng.choice([rng.choice(passages), rng.choice(passages)[rng.randint(0, 99) : rng.randint(100, 300)], "a" * rng.randint(1, 250), "".join(rng.choice(bits) for _ in range(30))]) for _ in range(rng.randint(0, 6)))) for i in range(80)]
    for rows in (made, [(r.doc_id, r.text) for r in docs.collect()]):
        got = repeats.repeat_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == removed(rows)


def test_merged_transforms_find_all_intervals():
    rng = np.random.default_rng(3)
    shards = [np.append(rng.integers(97, 99, 40), 255).astype(np.uint8) for _ in range(4)]
    place, block = repeats.merge_transforms(shards, 5)
    text = np.concatenate(shards)
    found = collections.defaultdict(set)
    for p, b in zip(place.tolist(), block.tolist(), strict=True):
        found[b].add(p)
    want = collections.defaultdict(set)
    for p in range(len(text) - 4):
        if 255 not in text[p : p + 5]:
            want[text[p : p + 5].tobytes()].add(p)
    assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_licence_scan_equals_brute_force(docs, odd):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    for frame in (docs, odd):
        got = {r.doc_id: r for r in licences.scan(frame).collect()}
        for r in frame.collect():
            words = word.findall((r.text or "").translate(LOWER))
            at = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
            g = got[r.doc_id]
            assert (g.n_words, g.n_base, g.base_labels) == (len(words), len(at), ",".join(sorted({label for _, label in at})))
            assert (g.first_word, g.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))


def licence_labels(text, cover=0.8):
    """Labels and score by trying every template at every place."""
    words, labels, score = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER)), set(), 0.0
    for t in licences.BASE + licences.OWN:
        want = t.text.split()
        for start in range(1 - len(want), len(words)):
            part = words[max(0, start) : start + len(want)]
            share = sum(0 <= start + k < len(words) and words[start + k] == w for k, w in enumerate(want)) / len(want)
            held = all(any(part[k : k + len(m.split())] == m.split() for k in range(len(part))) for m in t.mandatory)
            if share == 1 if t.base else share >= cover and held:
                labels.add(t.label)
                score = max(score, share)
    return ",".join(sorted(labels)), score


def test_licence_labels_equal_brute_force(spark, docs, odd):
    rng = random.Random(7)
    own = [t.text for t in licences.OWN]

    def torn(text):
        words = text.split()
        for _ in range(rng.randint(0, len(words) // 4)):
            words[rng.randrange(len(words))] = rng.choice(["other", "fee", "license"])
        return " ".join(words[rng.choice([0, 0, 1]) :])

    made = ["\n".join(own), "A fee hereby granted for any purpose, copy or modify it, for that person. " * 400 + "Released under the MIT License."]
    made += [" filler ".join(torn(t) for t in rng.choices(own, k=rng.randint(1, 8))) for _ in range(40)]
    for frame in (spark.createDataFrame(list(enumerate(made)), "doc_id long, text string"), odd, docs.limit(60)):
        got = {r.doc_id: (r.labels, r.score) for r in licences.scan(frame).collect()}
        assert got == {r.doc_id: licence_labels(r.text or "") for r in frame.collect()}
    assert "mit" in licence_labels(made[1])[0] and len(licence_labels(made[0])[0].split(",")) > 10


def test_kneser_ney_sums_to_one(spark, docs):
    tables = quality.model(docs.limit(20).select("text"))
    for context in (b"tion", b"zzzz"):
        wanted = spark.range(256).selectExpr(f"{int.from_bytes(context, 'big') << 8} + id AS gram", "1L AS n")
        assert abs(quality.probabilities(wanted, tables).selectExpr("sum(exp(logp))").first()[0] - 1) < 1e-9


def groups(rows, n, percent):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[i] = {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard_groups_equal_brute_force(spark, docs, n, percent):
    rng = random.Random(n)
    base = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 50)) for _ in range(40)) for _ in range(5)]
    made = [(1000 + i, " ".join(w if rng.random() > 0.02 else "new" + str(rng.randint(0, 9)) for w in rng.choice(base).split())) for i in range(60)]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + made + [(5000, None), (5001, ""), (5002, "two words"), (5003, "Two  words")]
    got = jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), n, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == groups(rows, n, percent)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 100), (None, 3)], "a long, b long")
    assert {r.component for r in components.components(links).collect()} == {0}


def test_neighbours_recall_and_order(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = collections.defaultdict(list)
    for r in neighbours.search(vectors).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    rows = vectors.toPandas()
    x, ids, hits = np.stack(rows.embedding).astype(float), rows.vec_id.to_numpy(), []
    for q, found in got.items():
        score = x @ x[ids == q][0]
        best = ids[np.lexsort([ids, -score])]
        hits.append(len({v for v, _ in found} & set(best[best != q][:20].tolist())) / 20)
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
    assert np.mean(hits) >= 0.9


def test_neighbours_leave_out_unusable_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0])]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), visit=1.0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 1), (0, 2), (0, 20), (20, 0), (20, 1), (20, 2)]


def test_neighbours_fill_k_at_the_default_visit(spark):
    rng = np.random.default_rng(11)
    # a repeated id, whose rows fill the query's best cell, and few others: all of them are found
    few = [(0, [9.0, 9.0])] * 30 + [(v, (-rng.random(2)).tolist()) for v in (1, 2, 3)]
    # 30 vectors, of which 60 % are fewer than 20 others; the smallest id has a length of its own
    more = [(-1, [1.0, 2.0, 3.0]), *[(v, rng.normal(size=4).tolist()) for v in range(30)]]
    for rows, dim in ((few, 2), (more, 4)):
        got = collections.defaultdict(list)
        for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect():
            got[r.query_id].append(r.vec_id)
        usable = [(v, np.array(e, np.float32).astype(float)) for v, e in rows if len(e) == dim]
        asked = {v: e for v, e in usable if v % 20 == 0}
        for q, e in asked.items():
            others = [v for _, v in sorted((-(x @ e), v) for v, x in usable if v != q)]
            assert len(got[q]) == len(set(got[q])) == min(20, len(others)) and set(got[q]) <= set(others)
            assert len(others) > 20 or got[q] == others
        assert set(got) == set(asked)


def test_webp_round_trip_and_features(odd):
    for units in (1, 2, 16385):
        payload = np.random.default_rng(units).integers(0, 256, 576 * units, dtype=np.uint8)
        assert (np.concatenate([webp.samples_of(i) for i in webp.decode(webp.store(payload))]) == payload).all()
    for r in webp.media_report(odd, with_media=True).collect():
        assert r.payload_bytes % 576 == 0 and hashlib.sha256(bytes(r.media)).hexdigest() == r.media_sha256
        raw = b"".join(webp.samples_of(i).tobytes() for i in webp.decode(bytes(r.media)))
        assert raw[r.n_bytes :] == b"\xff" * (len(raw) - r.n_bytes) and zlib.crc32(raw[-32:]) == r.tail_crc32


def test_webp_feature_sums_are_exact():
    samples = np.random.default_rng(4).integers(0, 256, 576 * 500, dtype=np.uint8)
    sides, sums, squares, changes = webp.feature_of(samples, 1).split(";")
    values = samples.tolist()
    assert (sides, sums) == ("144x500/1", ",".join(str(sum(values[c::4])) for c in range(4)))
    assert (int(squares), int(changes)) == (sum(v * v for v in values), sum(a != b for a, b in zip(values, values[1:], strict=False)))


class Writer:
    """Bits of a hand-made stream."""

    def __init__(self, width, height):
        self.value = self.n = 0
        for bits, v in ((8, 0x2F), (14, width - 1), (14, height - 1), (4, 0)):
            self.put(bits, v)

    def put(self, bits, v):
        self.value |= v << self.n
        self.n += bits
        return self

    def one(self, *symbols):
        """Simple codes of one symbol each."""
        for s in symbols:
            self.put(1, 1).put(1, 0).put(1, 1).put(8, s)
        return self

    def done(self):
        return self.value.to_bytes((self.n + 7) // 8, "little")


def test_webp_palette_and_predictor():
    # two colours, packed eight indices a pixel: the image's one stored pixel has green 0b0110
    w = Writer(4, 1).put(1, 1).put(2, 3).put(8, 1)
    w.put(1, 0)  # palette of two: alpha 255 and deltas (0, 0, 0) then (blue 9) by two-symbol codes
    w.one(0, 0).put(1, 1).put(1, 1).put(1, 1).put(8, 7).put(8, 9).one(255).one(0)
    w.put(1, 0).put(1, 1)
    w.put(1, 0).put(1, 0).put(1, 0).one(0b0110, 0, 0, 0, 0)
    assert webp.decode_stream(w.done()).tolist() == [[0xFF000007, 0xFE000010, 0xFE000010, 0xFF000007]]
    # left prediction: each pixel adds (1, 2, 3, 0) to the one on its left; the first to opaque black
    w = Writer(3, 1).put(1, 1).put(2, 0).put(3, 0).put(1, 0).one(1, 0, 0, 0, 0)
    w.put(1, 0).put(1, 0).put(1, 0).one(2, 1, 3, 0, 0)
    assert webp.decode_stream(w.done()).tolist() == [[0xFF010203, 0xFF020406, 0xFF030609]]


def test_webp_subtract_green_and_cross_colour():
    w = Writer(1, 1).put(1, 1).put(2, 2).put(1, 0).put(1, 0).put(1, 0).one(5, 250, 1, 255, 0)
    assert webp.decode_stream(w.done()).tolist() == [[0xFF000000 | 255 << 16 | 5 << 8 | 6]]
    w = Writer(1, 1).put(1, 1).put(2, 1).put(3, 0).put(1, 0).one(0, 0, 32, 0, 0)  # green to red: 32 / 32
    w.put(1, 0).put(1, 0).put(1, 0).one(5, 1, 1, 255, 0)
    assert webp.decode_stream(w.done()).tolist() == [[0xFF000000 | 6 << 16 | 5 << 8 | 1]]


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = toxicity.toxicity_report(spark.read.parquet(f"{folder}/documents.parquet"), labels).toPandas().merge(labels.toPandas(), on="doc_id")
    out = got[got.held_out]
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in out.doc_id]).all()
    bad, good = out[out.toxic == 1].score.to_numpy(), out[out.toxic == 0].score.to_numpy()
    assert (bad[:, None] > good).mean() > 0.9 and (good >= 0.7).mean() < 0.05


def test_extra_columns_that_clash(spark, docs, toxic_labels):
    named = docs.limit(5).selectExpr("*", "1 AS row", "2 AS ids", "3 AS n_tokens", "4 AS toxicity", "5 AS spans", "6 AS label", "7 AS kept_id", "8 AS size")
    assert bpe.encode(named, PATH, public_tokenizers.PATTERN).columns.count("n_tokens") == 1
    for df in (toxicity.drop_toxic(named, toxic_labels), jaccard.keep_one(named), repeats.without_repeats(named)):
        assert df.columns == named.columns and df.count() <= 5
    assert mixing.mix(named).count() == 5


def plain_pipeline(spark, rows, toxic):
    """(doc_id, token ids) of every copy, by plain Python; texts are ASCII and a source has under 1000 rows."""
    rows = sorted((i, text, source) for i, text, _, source, _ in rows if i not in toxic)
    root = groups([r[:2] for r in rows], 5, 80)
    seen, kept = set(), []
    for i, text, source in rows:
        if root[i][1] == i:
            covered = bytearray(len(text or ""))
            for p in range(len(covered) - 99):
                if text[p : p + 100] in seen:
                    covered[p : p + 100] = b"\1" * 100
                seen.add(text[p : p + 100])
            left = "".join(x for x, c in zip(text or "", covered, strict=True) if not c)
            if left or not text:
                kept.append((i, left, source))
    words = collections.Counter()
    for _, text, source in kept:
        words[source] += len(text.split())
    names = sorted(words)
    shares = mixing.water_fill([Fraction((5, 2, 1)[k % 3]) for k in range(len(names))], [Fraction(2 * words[n]) for n in names], Fraction(3 * sum(words.values()), 2))
    hashes = {r.i: r.h for r in spark.createDataFrame([(i,) for i, _, _ in kept], "i long").selectExpr("i", "xxhash64(20240602, i) AS h").collect()}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
    out = []
    for name, share in zip(names, shares, strict=True):
        whole = int(share // words[name])
        gap = share - whole * words[name]
        some = gap > 0
        for _, i, text in sorted((hashes[i], i, text) for i, text, source in kept if source == name):
            extra = some and len(text.split()) <= gap
            gap -= len(text.split()) * extra
            out += [(i, tuple(library.encode_ordinary(text)))] * (whole + extra)
    return sorted(out)


def test_pipeline_equals_plain_python(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    fair, foul = ([a + b for a in first for b in last] for first, last in ((("gar", "riv", "lum", "ten"), ("den", "er", "en", "dril", "sol")), (("zak", "vox", "qux", "kro"), ("ox", "uzz", "ikk", "azz", "uxx"))))
    rows = [(i, " ".join(rng.choice(foul if i % 2 else fair) for _ in range(60)), "en", "cd"[i % 4 // 2], 0) for i in range(60)]
    text = [" ".join(rng.choice(fair) for _ in range(80)) for _ in range(5)]
    planted = [" ".join(rng.choice(foul) for _ in range(60)), text[0], text[0] + " garden", text[1], text[2] + " " + text[1], text[1][20:300], "", None, text[3]]
    rows += [(100 + k, t, "en", "a", 0) for k, t in enumerate(planted)] + [(120, "", "en", "c", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    found = {i for i, _ in got}
    assert {106, 107} <= found and not {100, 102, 105} & found
    assert got == plain_pipeline(spark, rows, {i for i in range(60) if i % 2} | {100})


def test_arrow_slices_cover_all_rows():
    from lodestone.llm.textbytes import slices

    batch = pa.record_batch({"text": pa.array(["a" * 10, None, "", "é" * 4, "b" * 100])})
    parts = list(slices(iter([batch]), most=12))
    assert sum(r.num_rows for r, _, _ in parts) == 5 and b"".join(d.tobytes() for _, d, _ in parts) == ("a" * 10 + "é" * 4 + "b" * 100).encode()
