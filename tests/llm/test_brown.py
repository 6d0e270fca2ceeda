"""Class-based n-grams against a model of dictionaries, and exchange against likelihoods summed anew."""

import collections
import functools
import math
import re
import zlib

import numpy as np
import pytest

from lodestone.llm import brown

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RNG = np.random.default_rng(3)


def likelihood(table):
    f = lambda x: x * math.log(x) if x else 0.0
    return sum(f(x) for x in table.ravel()) - sum(f(x) for x in table.sum(0)) - sum(f(x) for x in table.sum(1))


def some_pairs(k):
    pairs = RNG.poisson(np.exp(RNG.normal(0, 1.5, (k, k))))
    return (pairs + pairs.T) // 2  # each word follows as often as it is followed


def test_gains_equal_differences_of_likelihood():
    c = 4
    table = RNG.integers(0, 30, (c + 2, c + 2)).astype(float)
    table = table + table.T
    before, after, own = RNG.integers(0, 4, (9, c + 2)), RNG.integers(0, 4, (9, c + 2)), RNG.integers(0, 3, 9)
    got = brown.gains(table, c, before.astype(float), after.astype(float), own.astype(float))
    for w in range(9):
        for b in range(c):
            put = table.copy()
            put[b] += after[w]
            put[:, b] += before[w]
            put[b, b] += own[w]
            # rows and columns of the other classes change by the same for every b
            f = lambda x: x * math.log(x) if x else 0.0
            change = sum(f(x) - f(y) for x, y in zip(put.ravel(), table.ravel(), strict=True))
            n = after[w].sum() + own[w]
            change -= sum(f(s + n) - f(s) for s in (table[b].sum(), table[:, b].sum()))
            assert got[w, b] == pytest.approx(change)


def test_exchange_raises_the_likelihood_to_where_no_word_gains():
    pairs = some_pairs(32)
    of, table = brown.exchange(pairs, 4)
    classes = lambda of: np.array([[pairs[np.ix_(of == a, of == b)].sum() for b in range(6)] for a in range(6)])
    whole = np.append(of, [4, 5])
    assert (classes(whole) == table).all()
    begin = np.append(np.arange(30) % 4, [4, 5])
    assert likelihood(table) > likelihood(classes(begin))
    for w in range(30):
        for b in range(4):
            other = whole.copy()
            other[w] = b
            assert likelihood(classes(other)) <= likelihood(table) + 1e-6


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [None]


def held_out(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def key_of(word):
    if word is None:
        return 0, 0
    raw = np.frombuffer(word.encode(), np.uint8)
    h, g = brown.keys(raw, np.array([0]), np.array([len(raw)]))
    return int(h[0]), int(g[0])


def plain_scores(rows, classes):
    """base_score, score, n_tokens, n_known of each row, from the class of each word."""
    counts = collections.Counter(t for i, text in rows if not held_out(i) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    of = {w: classes[key_of(w)] for w in counts}
    size, three, two_, once_after = collections.Counter(), collections.Counter(), collections.Counter(), collections.Counter()
    for w, m in counts.items():
        size[of[w]] += m
    for i, text in rows:
        c = [of[None] if counts else None] * 2
        if not held_out(i):
            for t in tokens(text):
                c.append(of[t])
                three[tuple(c[-3:])] += 1
                two_[tuple(c[-2:])] += 1
                once_after[c[-2]] += counts[t] == 1
    once = sum(m == 1 for m in counts.values())
    new = (once + 1) / (n + once + 2)

    @functools.cache
    def p(c, one, two):
        low = size[c] / n
        for table, context in ((two_, (one,)), (three, (two, one))):
            met = [m for k, m in table.items() if k[:-1] == context]
            if met:
                low = (table[(*context, c)] + len(met) * low) / (sum(met) + len(met))
        return low

    @functools.cache
    def unseen(one):
        met = sum(m for k, m in two_.items() if k[0] == one)
        return (once_after[one] + 100 * new) / (met + once_after[one] + 100)

    out = []
    for i, text in rows:
        base = score = 0.0
        c = [of.get(None, "?")] * 2
        for t in tokens(text):
            base += math.log10((counts[t] + 1) / (n + v + 1))
            if t in counts:
                score += math.log10((1 - unseen(c[-1])) * p(of[t], c[-1], c[-2]) * counts[t] / size[of[t]])
            elif n:
                score += math.log10(unseen(c[-1]))
            c.append(of.get(t, "?"))
        out.append((i, held_out(i), len(tokens(text)), sum(t in counts for t in tokens(text)), n, base, score))
    return out


def same(got, want):
    order = lambda r: (r[0] is None, *r[:5], round(r[5], 4))
    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5:] for r in got] == [pytest.approx(r[5:]) for r in want]


ODD = [(900_000, None), (900_001, ""), (900_002, " \t\n"), (900_003, "Ünseen wörds ZZQ zzq"), (900_004, "the " * 30_000), (900_005, "x" * 200_000), (7, "twice"), (7, "twice"), (None, "no id"), (None, None)]


@pytest.mark.parametrize(("core", "head", "held"), [(1024, 1 << 19, 1 << 20), (20, 60, 500)])
def test_scores_equal_a_plain_model(spark, sf, monkeypatch, core, head, held):
    learnt = []
    monkeypatch.setattr(brown, "CORE", core)
    monkeypatch.setattr(brown, "HEAD", head)
    monkeypatch.setattr(brown, "HELD", held)
    make = brown.Learnt
    monkeypatch.setattr(brown, "Learnt", lambda train: learnt.append(make(train)) or learnt[-1])
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60").collect()] + ODD
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).selectExpr("*", "'z' AS score", "1 AS n", "2 AS h", "3 AS seq").repartition(3)
    got = brown.score(docs)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    classes = {(r["h"], r["g"]): r["class"] for r in learnt[0].classes.collect()}
    counts = collections.Counter(t for i, text in rows if not held_out(i) for t in tokens(text))
    assert {(r["h"], r["g"]): r["n"] for r in learnt[0].classes.collect()} == {key_of(w): m for w, m in counts.items()}
    assert learnt[0].classes.where("h != 0").select("class").distinct().count() > 10
    same(got.collect(), plain_scores(rows, classes))


def test_rare_words_join_the_class_that_gains_most(spark, monkeypatch):
    monkeypatch.setattr(brown, "CORE", 12)
    texts = [(k, " ".join(f"w{int(x)}" for x in RNG.zipf(1.4, 60) if x < 400)) for k in range(40)]
    train = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = brown.Learnt(train)
    classes = {(r["h"], r["g"]): r["class"] for r in got.classes.collect()}
    counts = collections.Counter(w for _, t in texts for w in t.split())
    core = sorted(counts, key=lambda w: (-counts[w], key_of(w)))[:12]
    of = {w: classes[key_of(w)] for w in core} | {None: brown.END}
    for w in sorted(set(counts) - set(core)):
        before, after = np.zeros(brown.SYMBOLS), np.zeros(brown.SYMBOLS)
        for _, t in texts:
            line = [None, *t.split(), None]
            for a, b, c in zip(line, line[1:], line[2:], strict=False):
                if b == w:
                    before[of.get(a, brown.OTHER)] += 1
                    after[of.get(c, brown.OTHER)] += 1
        assert classes[key_of(w)] == brown.gains(got.table.astype(float), brown.CLASSES, before[None], after[None], np.zeros(1))[0].argmax()


def test_probabilities_sum_to_one():
    three = np.zeros((brown.SYMBOLS,) * 3, np.int64)
    used = [0, 1, 5, brown.END]
    for a in used:
        for b in used:
            three[a, b, used] = RNG.integers(0, 5, 4)
    logs = brown.transition_logs(three, np.where(three.sum((0, 2)) > 0, 2, 0), 9)
    for two, one in ((0, 1), (5, brown.END), (brown.OTHER, 0), (0, brown.OTHER), (30, 31)):
        assert (10.0 ** logs[two, one]).sum() == pytest.approx(1)


def test_held_out_texts_score_over_the_base(spark, sf):
    got = brown.score(spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet")).where("held_out").toPandas()
    assert (got.score > got.base_score).mean() > 0.95
    assert got.score.sum() / got.n_tokens.sum() > got.base_score.sum() / got.n_tokens.sum() + 0.5


def test_nothing_to_learn_from(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert brown.score(nothing).count() == 0
    ids = [i for i in range(60) if held_out(i)][:3]
    rows = brown.score(spark.createDataFrame([(i, "some words", "en", "s", 1) for i in ids], SCHEMA)).collect()
    assert [tuple(r)[1:] for r in rows] == [(True, 3, 0, 0, 0.0, 0.0)] * 3
