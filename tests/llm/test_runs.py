"""Periodic runs against every period of every start, and the work of comparing."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from lodestone.llm import runs

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_runs(w, shortest=24, times=3):
    """Every maximal stretch of each period; the least period of a stretch is its own."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i + q - s >= max(shortest, times * q):
                found.setdefault((s, i + q - s), q)
            i += 1
    return {(s, length, q) for (s, length), q in found.items()}


def some_words(rng):
    k, w = rng.choice([1, 2, 2, 3, 5]), []
    n = rng.randint(0, 60)
    if rng.random() < 0.5:
        w = [rng.randrange(k) for _ in range(n)]
    while len(w) < n:
        w += [rng.randrange(k + 1) for _ in range(rng.randint(1, 8))] * rng.randint(1, 6)
    return w * rng.choice([1, 1, 2])


@pytest.mark.parametrize(("shortest", "times"), [(2, 2), (6, 3), (24, 3)])
def test_runs_equal_plain_ones(shortest, times):
    rng = random.Random(shortest)
    for _ in range(800):
        w = np.array(some_words(rng), np.int64)
        assert runs.runs_of(w, shortest, times) == plain_runs(w.tolist(), shortest, times)


def test_candidate_stretches_hold_every_run_whole():
    rng = random.Random(3)
    for _ in range(500):
        parts = [some_words(rng) for _ in range(3)]
        w, rows = np.array(sum(parts, []), np.int64), np.repeat(range(3), [len(p) for p in parts])
        shortest, times = rng.choice([(4, 2), (6, 3), (24, 3)])
        stretches = list(runs.candidates(w, rows, shortest, times))
        assert all(rows[s] == rows[e - 1] for s, e in stretches)
        got = {(s + a, length, q) for s, e in stretches for a, length, q in runs.runs_of(w[s:e], shortest, times)}
        begins = np.cumsum([0] + [len(p) for p in parts])
        assert got == {(int(b) + s, length, q) for b, p in zip(begins, parts, strict=False) for s, length, q in plain_runs(p, shortest, times)}


def test_lyndon_edges_equal_sorted_suffixes_and_compare_in_linear_time():
    rng = random.Random(8)
    for _ in range(300):
        w = some_words(rng)
        to, equal = runs.lyndon_edges(w)
        for i in range(len(w)):
            assert to[i] == next((j for j in range(i + 1, len(w)) if w[j:] < w[i:]), len(w))
            if to[i] < len(w):
                assert equal[i] == next((x for x in range(len(w) - to[i]) if w[i + x] != w[to[i] + x]), len(w) - to[i])
    a, b = [0], [0, 1]
    while len(b) < 20_000:
        a, b = b, b + a
    thue = [bin(i).count("1") % 2 for i in range(20_000)]
    for w in (b, [-x for x in b], thue, [1] * 20_000, list(range(50)) * 400, [rng.randrange(2) for _ in range(20_000)], (([0] * 30 + [1]) * 20 + [2]) * 30):
        counted = []
        runs.lyndon_edges(w, counted)
        assert counted[0] <= 2 * len(w)


def plain_row(doc_id, text, plant=True):
    own = [bytes(x) for x in (text or "").encode().split()] if "\x1c" not in (text or "") else None
    assert own is not None
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(own)
    w = list(own)
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [own[i if i < a else a + (i - a) % p] for i in range(n)]
    found = sorted(plain_runs(w), key=lambda r: (r[0], r[2]))
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    milli = best[0] if best[0] is None else 1000 * best[1] // best[2]
    told = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *best, milli, digest(told.encode()), digest(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_report_equals_plain_rows_and_handles_odd_ones(spark, monkeypatch):
    rng = random.Random(4)
    texts = [None, "", " \n\t", "x", "a " * 24, "a " * 23, "é à " * 40, "one two three " * 9 + "one two", "w" * 300_000 + " b" * 30, "a b c d e f g h " * 3000]
    texts += [" ".join(map(str, sum((some_words(rng) for _ in range(3)), []))) for _ in range(60)]
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(texts)] + [(5, "again " * 30, None, None, None), (None, "b c " * 20, None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    key = lambda r: tuple((x is not None, x) for x in r)
    want = sorted((plain_row(r[0], r[1]) for r in rows if (r[1] or "")[:9] != "a b c d e"), key=key)
    got = runs.run_report(docs.selectExpr("*", "1 AS n_runs", "2 AS start", "3 AS rows"))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted((tuple(r) for r in got.collect() if r["doc_id"] != 9), key=key) == want
    assert runs.run_report(docs.where("doc_id = 9"), plant=False).first()[1:6] == (1, 0, 24_000, 8, 3_000_000)
    assert runs.run_report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_without_runs_keeps_rows_and_columns(spark):
    docs = spark.createDataFrame([(1, "x  y\n" + "go on " * 20 + "end", 7), (2, "as  it was\n", 8), (3, None, 9), (1, "x", None)], "doc_id long, text string, length int")
    got = runs.without_runs(docs)
    assert got.schema == docs.schema
    assert [tuple(r) for r in got.collect()] == [(1, "x y go on end", 7), (2, "as  it was\n", 8), (3, None, 9), (1, "x", None)]
