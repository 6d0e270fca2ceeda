"""Brown's class-based n-grams: words are put into classes by exchange, and a text is scored by class transitions and word emissions.

The commonest words exchange classes one after another on their exact counts of neighbours, until none gains. Every
other word of the corpus, however rare, is then put where the likelihood of the classes' pairs gains most, from the
classes beside all its places, in tasks that hold a share of the words. Words are keyed by 96 bits of hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .commonest import commonest, gathered
from .textbytes import LOWER, SPACE, lean, mix, powers, running_sum, slices, span_hashes, words

#: Word classes, then the class of the end token and a class for what has none yet (while learning) or was never seen (while scoring).
CLASSES = 60
END, OTHER = CLASSES, CLASSES + 1
SYMBOLS = CLASSES + 2
#: Words that exchange one after another; words whose counts and classes tasks hold (all others are joined); entries that a task holds before it passes them on.
CORE, HEAD, HELD = 1024, 1 << 19, 1 << 20
SWEEPS = 20
#: In a sequence of classes: a word that learning saw once; a word whose class is not looked up yet.
ONCE, OPEN = 64, 255
_SECOND = 0xC2B2AE3D27D4EB4F
_SECOND_INVERSE = pow(_SECOND, -1, 1 << 64)
_SECOND_VALUE = np.random.default_rng(20250711).integers(1, 1 << 63, 256, dtype=np.uint64)
Batches = Iterator[pa.RecordBatch]


def checksum(doc_id: str) -> Column:
    """crc32 of the id as text; a null id counts as no bytes."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of two hashes of each word."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_SECOND_VALUE[data] * powers(_SECOND, len(data) + 1)[: len(data)], out=sums[1:])
    second = mix((sums[ends] - sums[starts]) * powers(_SECOND_INVERSE, len(sums))[starts] + (ends - starts).astype(np.uint64))
    return span_hashes(running_sum(data), starts, ends).view(np.int64), (second >> np.uint64(32)).astype(np.uint32).view(np.int32)


class Tokens:
    """The words of a slice of texts, and a stream of symbols with an end after each text's words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        lower = LOWER[data]
        starts, ends, self.first = words(lower, offsets, ~SPACE[data])
        self.h, self.g = keys(lower, starts, ends)
        self.rows = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.at = np.arange(len(starts)) + self.rows
        self.ends = self.first[1:] + np.arange(len(offsets) - 1)

    def stream(self, symbols: np.ndarray, end: int) -> np.ndarray:
        out = np.full(len(self.at) + len(self.ends), end, symbols.dtype)
        out[self.at] = symbols
        return out


def _same(*columns: np.ndarray) -> np.ndarray:
    """Where a row begins that differs from the one before in any column."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


class Lookup:
    """Places of words in bounded tables, sorted by h; a word that shares h with another one may be missing."""

    def __init__(self, h: np.ndarray, g: np.ndarray) -> None:
        self.order = np.argsort(h, kind="stable")
        self.h, self.g = h[self.order], g[self.order]

    def __call__(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        if not len(self.h):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where((self.h[at] == h) & (self.g[at] == g), self.order[at], -1)


def word_counts(train: DataFrame) -> DataFrame:
    """h, g, n of every word of `text`; the end token has h = g = 0."""

    def merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        h, g, n = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(h, kind="stable")
        h, g, n = h[order], g[order], n[order]
        new = _same(h, g)
        return (h[new], g[new], np.add.reduceat(n, new)) if len(h) else (h, g, n)

    def run(batches: Batches) -> Batches:
        parts, size, texts = [], 0, 0
        told = lambda h, g, n: pa.RecordBatch.from_arrays([pa.array(h), pa.array(g), pa.array(n)], ["h", "g", "n"])
        for rows, data, offsets in slices(batches):
            t = Tokens(data, offsets)
            texts += rows.num_rows
            parts.append((t.h, t.g, np.ones(len(t.h), np.int64)))
            size += len(t.h)
            if size > HELD:
                parts = [merged(parts)]
                size = len(parts[0][0])
                if size > HELD // 2:
                    yield told(*parts[0])
                    parts, size = [], 0
        if parts:
            yield told(*merged(parts))
        if texts:
            yield told(np.zeros(1, np.int64), np.zeros(1, np.int32), np.array([texts]))

    return train.select("text").mapInArrow(lean(run), "h long, g int, n long").groupBy("h", "g").agg(F.sum("n").alias("n"))


def core_pairs(train: DataFrame, core: Broadcast) -> np.ndarray:
    """How often each pair of neighbours occurs: core words, then the end token, then all other words."""
    k = len(core.value.h)
    side = k + 2

    def run(batches: Batches) -> Batches:
        total, held, size = np.zeros(side * side, np.int64), [], 0
        for _, data, offsets in slices(batches):
            t = Tokens(data, offsets)
            own = core.value(t.h, t.g)
            stream = t.stream(np.where(own < 0, k + 1, own), k)
            held.append(np.concatenate([[k], stream[:-1]]) * side + stream)
            size += len(stream)
            if size > HELD:
                total += np.bincount(np.concatenate(held), minlength=side * side)
                held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=side * side)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "n"])

    cells, n = gathered(train.select("text").mapInArrow(lean(run), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")), {"cell": "<i8", "n": "<i8"})
    pairs = np.zeros(side * side, np.int64)
    pairs[cells] = n
    return pairs.reshape(side, side)


def _f(x: np.ndarray) -> np.ndarray:
    """x log x of counts."""
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """The class of each row of `pairs` but the last two, which keep classes of their own, and the pairs of classes.

    Words begin in classes dealt in their order. Each in turn leaves its class and joins the one of largest likelihood,
    staying at a tie, until a sweep moves none.
    """
    k = len(pairs) - 2
    of = np.concatenate([np.arange(k) % classes, [classes, classes + 1]])
    pairs = pairs.astype(float)
    by_class = np.zeros((k + 2, classes + 2))
    by_class[np.arange(k + 2), of] = 1
    table = by_class.T @ pairs @ by_class
    for _ in range(sweeps):
        moved = 0
        for w in range(k):
            a, self_ = of[w], pairs[w, w]
            after, before = np.bincount(of, pairs[w], classes + 2), np.bincount(of, pairs[:, w], classes + 2)
            table[a] -= after
            table[:, a] -= before
            table[a, a] += self_
            after[a] -= self_
            before[a] -= self_
            gain = gains(table, classes, before[None], after[None], np.array([self_]))[0]
            b = a if gain[a] >= gain.max() else int(gain.argmax())
            after[b] += self_
            before[b] += self_
            table[b] += after
            table[:, b] += before
            table[b, b] -= self_
            of[w] = b
            moved += b != a
        if not moved:
            break
    return of[:k], table.round().astype(np.int64)


def gains(table: np.ndarray, classes: int, before: np.ndarray, after: np.ndarray, self_: np.ndarray) -> np.ndarray:
    """What the likelihood gains by putting each word into each class: [word, class].

    before, after: [word, class of the neighbour] counts without the word itself; self_: the word beside itself.
    """
    out = np.zeros((len(before), classes))
    core, rows = table[:classes, :classes], table[:classes]
    columns = table[:, :classes].T
    for counts, cells in ((after, rows), (before, columns)):
        base = _f(cells)
        word, place = np.nonzero(counts)
        n = counts[word, place]
        for k in range(0, len(word), 4096):
            part = slice(k, k + 4096)
            at, c = place[part], cells[:, place[part]].T
            np.add.at(out, word[part], _f(c + n[part, None]) - base[:, at].T)
    # a class beside itself: its cell takes both counts at once
    x, y, own = after[:, :classes], before[:, :classes], np.diag(core)
    both = np.nonzero(((x > 0) & (y > 0)) | (self_ > 0)[:, None])
    d, xs, ys, s = own[both[1]], x[both], y[both], self_[both[0]]
    out[both] += _f(d + xs + ys + s) - _f(d + xs) - _f(d + ys) + _f(d)
    total = (after.sum(1) + self_)[:, None]
    for side in (rows.sum(1), columns.sum(1)):
        out -= _f(side[None] + total) - _f(side)[None]
    return out


def places(train: DataFrame, core: Broadcast, core_class: np.ndarray) -> DataFrame:
    """h, g and the classes beside the places of each word that isn't in the core, a row or more a task.

    A neighbour is a byte, 64 more where it stands after the word: `once` has a byte for each of the first three
    places, `often` five bytes (neighbour, count) for what goes beyond, so that a row is bounded.
    """
    class_of = np.append(core_class, OTHER).astype(np.uint8)

    def packed(h: np.ndarray, g: np.ndarray, beside: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((beside, h))
        h, g, beside = h[order], g[order], beside[order]
        new = _same(h, g, beside)
        n = np.diff(np.append(new, len(h)))
        h, g, beside = h[new], g[new], beside[new]
        word = _same(h, g)
        few, many = np.minimum(n, 3), n > 3
        ends = np.append(word[1:], len(h))
        entry = np.zeros(int(many.sum()), np.dtype([("c", "u1"), ("n", "<u4")]))
        entry["c"], entry["n"] = beside[many], n[many] - 3
        once_to, often_to = np.cumsum(few)[ends - 1], 5 * np.cumsum(many)[ends - 1]
        binary = lambda to, raw: pa.Array.from_buffers(pa.binary(), len(to), [None, pa.py_buffer(np.concatenate([[0], to]).astype("<i4").tobytes()), pa.py_buffer(raw)])
        return pa.RecordBatch.from_arrays([pa.array(h[word]), pa.array(g[word]), binary(once_to, np.repeat(beside, few).tobytes()), binary(often_to, entry.tobytes())], ["h", "g", "once", "often"])

    def run(batches: Batches) -> Batches:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for _, data, offsets in slices(batches):
            t = Tokens(data, offsets)
            stream = t.stream(class_of[core.value(t.h, t.g)], END)
            rare = core.value(t.h, t.g) < 0
            at = t.at[rare]
            left = np.where(at > 0, stream[at - 1], END).astype(np.uint8)
            held.append((np.repeat(t.h[rare], 2), np.repeat(t.g[rare], 2), np.stack([left, stream[at + 1] + np.uint8(64)], 1).ravel()))
            size += 2 * len(at)
            if size > HELD:
                yield packed(*(np.concatenate(c) for c in zip(*held, strict=True)))
                held, size = [], 0
        if size:
            yield packed(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return train.select("text").mapInArrow(lean(run), "h long, g int, once binary, often binary")


def _inserted(table: np.ndarray) -> Callable[[Batches], Batches]:
    """For rows of `places` in order of h and g: each word's count and the class that gains most (the first of equals)."""

    def told(h: np.ndarray, g: np.ndarray, beside: np.ndarray) -> pa.RecordBatch:
        before, after = beside[:, :64].astype(float), beside[:, 64:].astype(float)
        best = gains(table.astype(float), CLASSES, before[:, :SYMBOLS], after[:, :SYMBOLS], np.zeros(len(h))).argmax(1)
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(g), pa.array(before.sum(1).astype(np.int64)), pa.array(best.astype(np.int8))], ["h", "g", "n", "class"])

    def run(batches: Batches) -> Batches:
        last: tuple[np.ndarray, ...] | None = None  # the word that may go on in the next rows
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                b = batch.slice(k, 2048)
                h, g = b.column("h").to_numpy(), b.column("g").to_numpy()
                beside = np.zeros((len(h), 128), np.int64)
                for name, kind in (("once", np.dtype("u1")), ("often", np.dtype([("c", "u1"), ("n", "<u4")]))):
                    column = b.column(name)
                    to = np.frombuffer(column.buffers()[1], "<i4")[column.offset : column.offset + len(column) + 1]
                    raw = np.frombuffer(column.buffers()[2] or b"", "u1")[to[0] : to[-1]].view(kind)
                    of = np.repeat(np.arange(len(h)), np.diff(to) // kind.itemsize)
                    np.add.at(beside, (of, raw if kind.names is None else raw["c"]), 1 if kind.names is None else raw["n"].astype(np.int64))
                if last is not None:
                    h, g, beside = np.append(last[0], h), np.append(last[1], g), np.concatenate([last[2], beside])
                new = _same(h, g)
                h, g, beside = h[new], g[new], np.add.reduceat(beside, new)
                last = (h[-1:], g[-1:], beside[-1:])
                if len(h) > 1:
                    yield told(h[:-1], g[:-1], beside[:-1])
        if last is not None:
            yield told(*last)

    return run


class Learnt:
    """classes: h, g, n, class of every word (the end token too); tokens, kinds, once: their number, that of different ones and of those seen once."""

    def __init__(self, train: DataFrame) -> None:
        spark = train.sparkSession
        core = word_counts(train).where("h != 0 OR g != 0").orderBy(F.desc("n"), "h", "g").limit(CORE).collect()
        shared = spark.sparkContext.broadcast(Lookup(np.array([r["h"] for r in core], np.int64), np.array([r["g"] for r in core], np.int32)))
        pairs = core_pairs(train, shared)
        core_class, self.table = exchange(pairs)
        rare = places(train, shared, core_class).repartition("h", "g").sortWithinPartitions("h", "g").mapInArrow(lean(_inserted(self.table)), "h long, g int, n long, class byte")
        known = [(r["h"], r["g"], r["n"], int(c)) for r, c in zip(core, core_class, strict=True)]
        ends = int(pairs[-2].sum())
        if ends:
            known.append((0, 0, ends, END))
        self.classes = cut(rare.unionByName(spark.createDataFrame(known, "h long, g int, n long, class byte")))
        told = self.classes.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"), F.count_if(F.col("n") == 1).alias("once")).collect()  # a row a class
        self.tokens, self.kinds, self.once = (sum(r[k] for r in told) for k in ("n", "kinds", "once"))
        sizes = {r["class"]: r["n"] for r in told}
        self.sizes = np.array([sizes.get(c, 0) for c in range(SYMBOLS)], np.int64)


def sequences(docs: DataFrame, learnt: Learnt) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, emitted, seq: each text as one byte a token, with the sums that need no context."""
    h, g, n, c = commonest(learnt.classes, {"h": "<i8", "g": "<i4", "n": "<i8", "class": "u1"}, HEAD)
    shared = docs.sparkSession.sparkContext.broadcast((Lookup(h, g), n, c))
    below, sizes = learnt.tokens + learnt.kinds + 1, learnt.sizes

    def run(batches: Batches) -> Batches:
        find, n, c = shared.value
        byte = np.append(np.where(n == 1, c + ONCE, c), OPEN).astype(np.uint8)
        base = np.append(np.log10((n + 1) / below), 0.0)
        emitted = np.append(np.log10(n / np.maximum(sizes[c], 1)), 0.0)
        end_base = np.log10((sizes[END] + 1) / below)
        for rows, data, offsets in slices(batches):
            t = Tokens(data, offsets)
            at = find(t.h, t.g)
            stream = t.stream(byte[at], END if sizes[END] else OTHER)
            open_ = np.flatnonzero(at < 0)
            texts = np.arange(rows.num_rows)
            sums = lambda values: np.bincount(t.rows, values, rows.num_rows)  # noqa: B023, E731
            to = np.searchsorted(t.rows[open_], np.append(texts, rows.num_rows))
            lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.array(values, kind))  # noqa: B023, E731
            bounds = np.append(0, t.ends + 1).astype(np.int32)
            seq = pa.Array.from_buffers(pa.binary(), rows.num_rows, [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(stream.tobytes())])
            place = open_ - t.first[t.rows[open_]]
            columns = {
                "doc_no": rows.column("doc_no"), "doc_id": rows.column("doc_id"), "held_out": rows.column("held_out"),
                "n_tokens": pa.array(np.diff(t.first) + 1), "n_known": pa.array(sums(at >= 0).astype(np.int64) + int(sizes[END] > 0)),
                "base_score": pa.array(sums(base[at]) + end_base), "emitted": pa.array(sums(emitted[at])), "seq": seq,
                "places": lists(place, pa.int32()), "hs": lists(t.h[open_], pa.int64()), "gs": lists(t.g[open_], pa.int32()),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    first = "doc_no long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, emitted double, seq binary"
    rows = docs.select(F.monotonically_increasing_id().alias("doc_no"), F.col("doc_id").cast("long").alias("doc_id"), (checksum("doc_id") % 7 == 2).alias("held_out"), "text")
    told = cut(rows.mapInArrow(lean(run), f"{first}, places array<int>, hs array<long>, gs array<int>"))
    open_ = told.select("doc_no", F.explode(F.arrays_zip(F.col("places").alias("place"), F.col("hs").alias("h"), F.col("gs").alias("g"))).alias("o")).select("doc_no", "o.place", "o.h", "o.g")
    found = open_.join(learnt.classes, ["h", "g"], "left").select("doc_no", F.struct("place", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("class", F.lit(OTHER)).alias("class")).alias("o"))
    # no longer than its text
    return told.drop("places", "hs", "gs").join(found.groupBy("doc_no").agg(F.collect_list("o").alias("found")), "doc_no", "left").drop("doc_no").mapInArrow(lean(_closed(below, sizes)), first.removeprefix("doc_no long, "))


def _closed(below: int, sizes: np.ndarray) -> Callable[[Batches], Batches]:
    """Puts the classes that were looked up into their sequences, and their share into the sums."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                b = batch.slice(k, 256)
                found = b.column("found")
                of = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(found), 0).to_numpy())
                flat = found.flatten()
                place, n, c = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                column = b.column("seq")
                to = np.frombuffer(column.buffers()[1], "<i4")[column.offset : column.offset + len(column) + 1].astype(np.int64)
                seq = np.frombuffer(column.buffers()[2], "u1")[to[0] : to[-1]].copy()
                seq[to[of] - to[0] + place] = np.where(n == 1, c + ONCE, c)
                sums = lambda values: np.bincount(of, values, b.num_rows)  # noqa: B023, E731
                new = {
                    "n_known": b.column("n_known").to_numpy() + sums(n > 0).astype(np.int64),
                    "base_score": b.column("base_score").to_numpy() + sums(np.log10((n + 1) / below)),
                    "emitted": b.column("emitted").to_numpy() + sums(np.where(n > 0, np.log10(np.maximum(n, 1) / np.maximum(sizes[c], 1)), 0.0)),
                    "seq": pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer((to - to[0]).astype("<i4").tobytes()), pa.py_buffer(seq.tobytes())]),
                }
                names = [x for x in b.schema.names if x != "found"]
                yield pa.RecordBatch.from_arrays([new[x] if isinstance(new.get(x), pa.Array) else pa.array(new[x]) if x in new else b.column(x) for x in names], names)

    return run


def _contexts(seq: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all rows' sequences with the two before each (the end symbol before the first), and each row's first place."""
    to = np.frombuffer(seq.buffers()[1], "<i4")[seq.offset : seq.offset + len(seq) + 1].astype(np.int64)
    raw = np.frombuffer(seq.buffers()[2], "u1")[to[0] : to[-1]]
    to = to - to[0]
    c = (raw & (ONCE - 1)).astype(np.int64)
    one = np.append(END, c[:-1])
    one[to[:-1]] = END
    two = np.append([END, END], c[:-2])[: len(c)]
    two[to[:-1]] = END
    second = to[:-1] + 1
    two[second[second < to[1:]]] = END
    return raw, two, one, to


def transitions(train: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of three classes in a row, and of words seen once after each class."""

    def run(batches: Batches) -> Batches:
        total, once = np.zeros(SYMBOLS**3, np.int64), np.zeros(SYMBOLS, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                raw, two, one, _ = _contexts(batch.slice(k, 256).column("seq"))
                cells, n = np.unique((two * SYMBOLS + one) * SYMBOLS + (raw & (ONCE - 1)), return_counts=True)
                total[cells] += n
                once += np.bincount(one[(raw & ONCE) > 0], minlength=SYMBOLS)
        both = np.concatenate([total, once])
        at = np.flatnonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(both[at])], ["cell", "n"])

    cells, n = gathered(train.select("seq").mapInArrow(lean(run), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")), {"cell": "<i8", "n": "<i8"})
    both = np.zeros(SYMBOLS**3 + SYMBOLS, np.int64)
    both[cells] = n
    return both[: SYMBOLS**3].reshape((SYMBOLS,) * 3), both[SYMBOLS**3 :]


def transition_logs(three: np.ndarray, once_after: np.ndarray, once: int) -> np.ndarray:
    """log10 of P(class | two classes before), with OTHER as the word never seen: [two before, one before, class].

    An unseen word comes as often as a word seen once did after the class before it, drawn to its share of all tokens.
    All else is shared out among the classes by their counts after two, one and no classes, each drawn to the next
    by the number of different classes met (Witten and Bell).
    """
    tokens = int(three.sum())
    if not tokens:
        out = np.full((SYMBOLS,) * 3, -np.inf)
        out[:, :, OTHER] = 0.0
        return out
    drawn = lambda counts, lower: (counts + (counts > 0).sum(-1, keepdims=True) * lower) / np.maximum(counts.sum(-1, keepdims=True) + (counts > 0).sum(-1, keepdims=True), 1)
    p = three.sum((0, 1)) / tokens
    for counts in (three.sum(0), three):
        p = np.where(counts.sum(-1, keepdims=True) > 0, drawn(counts, p), p)
    new = (once + 1) / (tokens + once + 2)
    two = three.sum(0).sum(1)
    unseen = (once_after + 100 * new) / (two + once_after + 100)
    with np.errstate(divide="ignore"):
        out = np.log10(p) + np.log10(1 - unseen)[None, :, None]
        out[:, :, OTHER] = np.log10(unseen)[None]
    return out


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of `docs` (doc_id, text).

    Learns from rows whose checksum leaves other than 2 by 7. A null or empty text is its end token alone; rows that share
    an id are texts of their own, and each counts in learning; a null id has the checksum of no bytes. Where nothing is
    learnt from, every token is unseen and all scores are 0. Other columns are not read; no rows give none. Texts are read
    four times; per text, what is shuffled are the words outside the 2 ** 19 commonest, and a byte a token.
    """
    train = docs.where(checksum("doc_id") % 7 != 2)
    learnt = Learnt(train)
    told = cut(sequences(docs, learnt))
    three, once_after = transitions(told.where("NOT held_out"))
    logs = docs.sparkSession.sparkContext.broadcast(transition_logs(three, once_after, learnt.once))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score"]

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                b = batch.slice(k, 256)
                raw, two, one, to = _contexts(b.column("seq"))
                sums = np.add.reduceat(logs.value[two, one, raw & (ONCE - 1)], to[:-1])
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(sums + b.column("emitted").to_numpy())], [*names, "score"])

    rows = told.mapInArrow(lean(run), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(learnt.tokens).cast("long").alias("train_tokens"), "base_score", "score")
