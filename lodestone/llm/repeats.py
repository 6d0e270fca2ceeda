"""Removal of repeated byte strings with merged Burrows-Wheeler transforms.

Every string of `LENGTH` bytes that stands earlier too (in a smaller doc_id, or before in the same
document) is to go. Strings are grouped by the smallest hash among their GRAM-byte grams, their anchor:
equal strings have equal anchors at equal places, so a text falls into pieces, each the strings that share
one anchor, and only pieces of one anchor can have a string in common.

1. A piece that equals an earlier one is covered whole; tasks settle what they see before the shuffle.
2. Distinct pieces of one anchor are spread over shards. Each shard's transform is made by sorting its own
   suffixes. The transforms are then merged by refining their interleave: each round sorts, stably, by
   the symbol before, so that after k rounds rows are in order of their first k bytes. Bounds that are new
   in round k end a common prefix of k - 1; after LENGTH rounds what no bound parts is a repeated interval.
3. The covered strings of a document are joined to spans and taken out of its bytes.

Anchors that very many distinct pieces share (at most FREQUENT of them, found by counting all) are not
brought to one task: their strings are pieces of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .commonest import commonest
from .marks import keep, marked, own_hash
from .textbytes import lean, mix, running_sum, slices, span_hashes

LENGTH, GRAM = 100, 24
WINDOW = LENGTH - GRAM + 1
FREQUENT, MANY = 1 << 17, 20_000
SHARD, MERGE = 1 << 18, 1 << 20
FLUSH = 400_000
END = 255  # no byte of UTF-8
_SPOT = np.uint64((1 << 28) - 1)


def sliding_least(v: np.ndarray, n: int) -> np.ndarray:
    """Least of every n neighbours."""
    width = 1
    while width * 2 <= n:
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    return np.minimum(v[: len(v) - (n - width)], v[n - width :]) if n > width else v


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """row, first string's start in the row, number of strings, anchor, hash of the bytes, start in data."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none, np.zeros(1, np.uint64)
    sums = running_sum(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = span_hashes(sums, at, at + GRAM)
    least = sliding_least((grams & ~_SPOT) | at.astype(np.uint64), WINDOW)
    start = np.arange(len(least))
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
    inside = start + LENGTH <= ends
    spot = (least & _SPOT).astype(np.int64)
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (spot[1:] != spot[:-1]) | (ends[1:] != ends[:-1])
    last = inside.copy()
    last[:-1] &= ~inside[1:] | (spot[1:] != spot[:-1]) | (ends[1:] != ends[:-1])
    a, b = np.flatnonzero(new), np.flatnonzero(last)
    row = np.searchsorted(offsets, a, "right") - 1
    return row, a - offsets[row], b - a + 1, grams[spot[a]], span_hashes(sums, a, b + LENGTH), a, sums


def frequent_anchors(docs: DataFrame) -> np.ndarray:
    """At most FREQUENT anchors with MANY distinct pieces, sorted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            pair = np.unique(np.concatenate(held))
            anchor, n = np.unique(pair["anchor"], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(anchor[n >= 3].astype(np.int64)), pa.array(n[n >= 3].astype(np.int64))], ["anchor", "n"])

        for _, data, offsets in slices(batches):
            _, _, _, anchor, own, _, _ = pieces(data, offsets)
            both = np.empty(len(anchor), [("anchor", np.uint64), ("own", np.uint64)])
            both["anchor"], both["own"] = anchor, own
            held.append(both)
            size += len(both)
            if size > FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    counts = cut(docs.select("text").mapInArrow(lean(count), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")))
    return np.sort(commonest(counts, {"anchor": "int64"}, FREQUENT, MANY)[0].astype(np.uint64))


def _order(text: np.ndarray) -> np.ndarray:
    """Suffix array of a shard whose pieces end in END; ends are ranked by their place, so all suffixes differ."""
    n = len(text)
    wide = np.concatenate([text, text[:8]]).astype(np.uint64)
    rank = np.zeros(n, np.uint64)
    for k in range(8):
        rank = (rank << np.uint64(8)) | wide[k : k + n]
    # up to the first end byte only: what stands behind it must not decide
    ends = np.flatnonzero(text == END)
    nearest = ends[np.searchsorted(ends, np.arange(n))] if n else ends
    short = nearest - np.arange(n) < 8
    keep = np.where(short, (nearest - np.arange(n) + 1) * 8, 64)
    rank = np.where(keep < 64, rank | (np.uint64(2**64 - 1) >> np.minimum(keep, 63).astype(np.uint64)), rank)
    second = np.where(short, nearest, 0)
    order = np.lexsort([second, rank])
    key = np.empty(n, np.int64)
    key[order] = np.cumsum(np.concatenate([[0], ((rank[order][1:] != rank[order][:-1]) | (second[order][1:] != second[order][:-1])).astype(np.int64)]))
    width = 8
    while n and key.max() < n - 1:
        then = key[np.minimum(np.arange(n) + width, n - 1)]
        joint = key * n + then
        order = np.argsort(joint, kind="stable")
        sorted_ = joint[order]
        key[order] = np.cumsum(np.concatenate([[0], (sorted_[1:] != sorted_[:-1]).astype(np.int64)]))
        width *= 2
    return np.argsort(key)


def merge_transforms(shards: list[np.ndarray], depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Places (in the joined shards), in merged order, and intervals of the suffixes that share `depth` bytes with another.

    No suffix of the joined text is sorted: the interleave starts with the shards one after the other, and
    each round moves every row to where its previous symbol puts it. A row between two bounds has its common
    prefix and is left out of further rounds, as then is what stands before it; so is one that meets an end.
    """
    base = np.cumsum([0, *[len(s) for s in shards]])
    suffix, before, jump = [], [], []
    for s, offset in zip(shards, base, strict=False):
        order = _order(s)
        symbols = s[order - 1]
        to = np.empty(len(s), np.int64)
        to[np.argsort(symbols, kind="stable")] = np.arange(len(s))
        suffix.append(order + offset)
        before.append(symbols)
        jump.append(to + offset)
    suffix, before, jump = np.concatenate(suffix), np.concatenate(before), np.concatenate(jump).astype(np.int32)
    rows = np.arange(len(suffix), dtype=np.int32)
    block = np.zeros(len(rows), np.int32)
    for k in range(1, depth + 1):
        symbol = before[rows]
        order = np.argsort(symbol, kind="stable")
        symbol, was = symbol[order], block[order]
        rows = jump[rows[order]]
        live = int(np.searchsorted(symbol, END))  # ends are the last symbols
        symbol, was, rows = symbol[:live], was[:live], rows[:live]
        bound = np.ones(len(rows) + 1, bool)
        bound[1:-1] = (symbol[1:] != symbol[:-1]) | (was[1:] != was[:-1])
        block = np.cumsum(bound[:-1], dtype=np.int32)
        if k % 4 == 0 or k == depth:
            stay = ~(bound[:-1] & bound[1:])
            rows, block = rows[stay], block[stay]
    return suffix[rows], block


def repeated(texts: list[bytes], doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(text number, string's start in it) of every string of LENGTH bytes that a smaller (doc, place) has too."""
    lengths = np.array([len(t) + 1 for t in texts])
    shards, own, size = [], [], 0
    for t in texts:
        own.append(t + bytes([END]))
        size += len(t) + 1
        if size >= SHARD:
            shards.append(np.frombuffer(b"".join(own), np.uint8))
            own, size = [], 0
    if own:
        shards.append(np.frombuffer(b"".join(own), np.uint8))
    place, interval = merge_transforms(shards)
    begin = np.cumsum(lengths) - lengths
    text = np.searchsorted(begin, place, "right") - 1
    start = place - begin[text]
    valid = start + LENGTH < lengths[text]
    text, start, interval = text[valid], start[valid], interval[valid]
    order = np.lexsort([at[text] + start, doc[text], interval])
    text, start, interval = text[order], start[order], interval[order]
    new = np.ones(len(text), bool)
    new[1:] = interval[1:] != interval[:-1]
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.zeros(0, np.int64)
    later = (doc[text] != doc[text[first]]) | (at[text] + start != at[text[first]] + start[first])
    return np.stack([text[later], start[later]], 1)


ROW = ("key", "own", "doc", "text", "place")
SCHEMA = ", ".join(f"{c} long" for c in ROW)


def _first_of(key, own, doc, text, at, n) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns in order of key, own, doc, text, at; and for each row the first of its key and own, as a place in that order."""
    order = np.lexsort([at, text, doc, own, key])
    columns = [c[order] for c in (key, own, doc, text, at, n)]
    new = np.ones(len(order), bool)
    new[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])
    return columns, np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else order


def _later(doc, text, at, first) -> np.ndarray:
    return (doc != doc[first]) | (text != text[first]) | (at != at[first])


def _batch(key, own, doc, text, at, n, covered) -> pa.RecordBatch:
    """Start and number of strings in one value, inverted where the piece is covered: rows are many, and this keeps them short."""
    place = at << 8 | n
    return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(own.astype(np.int64)), pa.array(doc), pa.array(text), pa.array(np.where(covered, ~place, place))], [*ROW])


def _cut_up(frequent, shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            (key, own, doc, text, at, n), first = _first_of(*(np.concatenate(c) for c in zip(*held, strict=True)))
            later = _later(doc, text, at, first)
            # what is settled goes anywhere, evenly
            key = np.where(later, mix(key + doc.astype(np.uint64) + at.astype(np.uint64)), key)
            return _batch(key, own, doc, text, at, n, later)

        for rows, data, offsets in slices(batches):
            ids, texts = rows.column("doc_id").to_numpy(), own_hash(shared, rows, "doc_id", "hash")
            row, at, n, anchor, own, start, sums = pieces(data, offsets)
            spot = np.minimum(np.searchsorted(frequent.value, anchor), max(0, len(frequent.value) - 1))
            hot = frequent.value[spot] == anchor if len(frequent.value) else np.zeros(len(anchor), bool)
            if hot.any():
                each = n[hot]
                step = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                begin = np.repeat(start[hot], each) + step
                single = span_hashes(sums, begin, begin + LENGTH)
                row, at, n = (np.concatenate([c[~hot], m]) for c, m in ((row, np.repeat(row[hot], each)), (at, np.repeat(at[hot], each) + step), (n, np.ones(len(step), np.int64))))
                anchor, own = np.concatenate([anchor[~hot], mix(single)]), np.concatenate([own[~hot], single])
            held.append((anchor, own, ids[row], texts[row], at, n))
            size += len(row)
            if size > FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: covered ones, and the distinct pieces of keys that have several."""
    held: list[pa.RecordBatch] = []

    def flush(t: pa.Table) -> list[pa.RecordBatch]:
        key, own, doc, text, place = (t.column(c).to_numpy() for c in ROW)
        done = place < 0
        place = np.where(done, ~place, place)
        columns = (key, own, doc, text, place >> 8, place & 255)
        settled = _batch(*(c[done] for c in columns), done[done])
        columns, first = _first_of(*(c[~done] for c in columns))
        later = _later(*columns[2:5], first)
        lead = first == np.arange(len(first))
        value, many = np.unique(columns[0][lead], return_counts=True)
        open_ = lead & (many[np.searchsorted(value, columns[0])] > 1) if len(value) else lead
        keep = later | open_
        merged = _batch(*(c[keep] for c in columns), later[keep])
        return pa.Table.from_batches([settled, merged]).combine_chunks().to_batches(max_chunksize=1 << 30)

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        t = pa.Table.from_batches(held)
        start = int(np.searchsorted(t.column("key").to_numpy(), t.column("key")[t.num_rows - 1].as_py()))
        if start:
            yield from flush(t.slice(0, start))
        held = t.slice(start).to_batches()
    if held:
        yield from flush(pa.Table.from_batches(held))


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the open pieces of each document."""
    for rows, data, offsets in slices(batches):
        out: dict[str, list] = {c: [] for c in ("key", "doc", "text", "at", "bytes")}
        for i, (doc, own, open_) in enumerate(zip(rows.column("doc_id").to_pylist(), rows.column("hash").to_pylist(), rows.column("open").to_pylist(), strict=True)):
            whole = data[offsets[i] : offsets[i + 1]].tobytes()
            for p in open_:
                for c, v in zip(out, (p["key"], doc, own, p["at"], whole[p["at"] : p["at"] + p["n"] - 1 + LENGTH]), strict=True):
                    out[c].append(v)
        yield pa.RecordBatch.from_pydict(out, pa.schema([*[(c, pa.int64()) for c in ("key", "doc", "text", "at")], ("bytes", pa.binary())]))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key. Whole keys are gathered up to MERGE bytes, and their repeated strings found."""
    texts, doc, own, at, size, last = [], [], [], [], 0, None

    def flush() -> pa.RecordBatch:
        docs, hashes, places = np.array(doc, np.int64), np.array(own, np.int64), np.array(at, np.int64)
        hit = repeated(texts, np.unique(np.stack([docs, hashes]), axis=1, return_inverse=True)[1].reshape(-1), places)
        order = np.lexsort([hit[:, 1], hit[:, 0]])
        text, start = hit[order, 0], hit[order, 1]
        # neighbouring strings of one piece as one row
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1)
        begin = np.flatnonzero(new)
        n = np.diff(np.append(begin, len(text)))
        return pa.RecordBatch.from_arrays([pa.array(docs[text[begin]]), pa.array(hashes[text[begin]]), pa.array(places[text[begin]] + start[begin]), pa.array(n.astype(np.int32))], ["doc", "text", "at", "n"])

    for b in batches:
        for k, d, h, a, t in zip(*[b.column(c).to_pylist() for c in ("key", "doc", "text", "at", "bytes")], strict=True):
            if k != last and size >= MERGE:
                yield flush()
                texts, doc, own, at, size = [], [], [], [], 0
            last = k
            texts.append(t)
            doc.append(d)
            own.append(h)
            at.append(a)
            size += len(t)
    if texts:
        yield flush()


def shared_ids(docs: DataFrame) -> Broadcast:
    """A bitmap of the ids under which stand different texts."""
    hashes = docs.groupBy("doc_id").agg(F.min("hash").alias("least"), F.max("hash").alias("most"))
    return marked(hashes.where("least < most and doc_id is not null").select("doc_id"))


def spans(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """doc, text, spans array<struct<at: long, n: int>>: covered strings of each document that has some, as runs of starts.

    docs: doc_id, text, hash (of the text). `text` of the result is that hash where the id is marked in `shared`, else 0.
    """
    docs = docs.where("doc_id is not null")
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_anchors(docs))
    rows = docs.mapInArrow(lean(_cut_up(frequent, shared)), SCHEMA).repartition("key").sortWithinPartitions("key")
    place = F.when(F.col("place") < 0, F.bitwise_not("place")).otherwise(F.col("place"))
    kept = cut(rows.mapInArrow(lean(_settle), SCHEMA).select("key", "doc", "text", "place"))
    settled = kept.select("key", "doc", "text", F.shiftright(place, 8).alias("at"), place.bitwiseAND(255).cast("int").alias("n"), (F.col("place") < 0).alias("covered"))
    # a document has at most one piece for each of its bytes
    open_ = settled.where("not covered").groupBy("doc", F.col("text").alias("own")).agg(F.collect_list(F.struct("key", "at", "n")).alias("open"))
    some = docs.mapInArrow(lean(_marked_rows(marked(settled.where("not covered").select("doc")), shared)), docs.schema)
    fetched = some.join(open_, (some["doc_id"] == open_["doc"]) & (some["hash"] == open_["own"])).select("doc_id", "text", "hash", "open").mapInArrow(lean(_fetch), "key long, doc long, text long, at long, bytes binary")
    merged = fetched.repartition("key").sortWithinPartitions("key").mapInArrow(lean(_merge), "doc long, text long, at long, n int")
    covered = settled.where("covered").select("doc", "text", "at", "n").union(merged)
    return covered.groupBy("doc", "text").agg(F.collect_list(F.struct("at", "n")).alias("spans"))


def _marked_rows(marks: Broadcast, shared: Broadcast) -> Callable:
    """Rows whose id may be marked, their hash 0 unless the id is shared."""
    among = keep(marks, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in among(batches):
            yield b.set_column(b.schema.get_field_index("hash"), "hash", pa.array(own_hash(shared, b, "doc_id", "hash")))

    return run


def _runs(found: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal removed runs [begin, end) from runs of starts."""
    out: list[tuple[int, int]] = []
    for p in sorted(found or [], key=lambda p: p["at"]):
        begin, end = p["at"], min(length, p["at"] + p["n"] - 1 + LENGTH)
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        elif begin < end:
            out.append((begin, end))
    return out


def _with_spans(docs: DataFrame, run: Callable, schema) -> DataFrame:
    """run over docs (doc_id, text and others) and their spans; only texts that may have some are shuffled.

    Rows are in order of doc_id, and rows that share an id in order of a hash of their text. Rows equal in both
    are one document, whose strings do not cover each other. A null doc_id has no part in it.
    """
    hashed = docs.withColumn("hash", F.xxhash64("text"))
    shared = shared_ids(hashed)
    found = cut(spans(hashed.select("doc_id", "text", "hash"), shared))
    marks = marked(found.select("doc"))
    unmarked, spans_type = keep(marks, "doc_id", False), pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int32())]))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(b.append_column("spans", pa.nulls(b.num_rows, spans_type)) for b in unmarked(batches))

    rest = hashed.mapInArrow(lean(_marked_rows(marks, shared)), hashed.schema)
    own = found.select("doc", F.col("text").alias("own"), "spans")
    joined = rest.join(own, (rest["doc_id"] == own["doc"]) & (rest["hash"] == own["own"]), "left").select(*[rest[c] for c in docs.columns], "spans")
    return docs.mapInArrow(lean(clean), schema).union(joined.mapInArrow(lean(run), schema))


def repeat_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document; null texts are empty, texts have under 2 ** 28 bytes."""
    docs = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
            for a, b, found in zip(offsets[:-1].tolist(), offsets[1:].tolist(), rows.column("spans").to_pylist(), strict=True):
                runs, digest, at = _runs(found, b - a), hashlib.sha256(), a
                for begin, end in runs:
                    digest.update(data[at : a + begin])
                    at = a + end
                digest.update(data[at:b])
                for c, v in zip(out, (b - a, sum(e - s for s, e in runs), len(runs), digest.hexdigest()), strict=True):
                    out[c].append(v)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *[pa.array(v, pa.string() if c == "kept_sha256" else pa.int64()) for c, v in out.items()]], ["doc_id", *out])

    return _with_spans(docs, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The columns of docs with the repeated strings taken out of text. Characters of which only some bytes are covered stay whole."""
    columns = docs.columns
    packed = docs.select("doc_id", "text", F.struct(*[c for c in columns if c != "text"]).alias("rest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            texts = []
            nulls = rows.column("text").is_null().to_pylist()
            for i, found in enumerate(rows.column("spans").to_pylist()):
                text = data[offsets[i] : offsets[i + 1]]
                gone = np.zeros(len(text), bool)
                for begin, end in _runs(found, len(text)):
                    while begin < end and text[begin] & 0xC0 == 0x80:
                        begin += 1
                    while begin < end < len(text) and text[end] & 0xC0 == 0x80:
                        end -= 1
                    gone[begin:end] = True
                texts.append(None if nulls[i] else text[~gone].tobytes().decode())
            yield pa.RecordBatch.from_arrays([rows.column("rest"), pa.array(texts, pa.string())], ["rest", "text"])

    schema = packed.select("rest", "text").schema
    out = _with_spans(packed.select("doc_id", "text", "rest"), run, schema)
    return out.select(*[F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in columns])
