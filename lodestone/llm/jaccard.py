"""Similarity join of n-gram sets, and the groups of documents that it links.

A document's set holds the hashes of its distinct word shingles. All sets are sorted by one global order,
rare shingles first: the `FREQUENT` most frequent ones come last by their count, the others by their hash.
The order decides only how much work there is, never which links are found. Equal sets are one class.

1. Trie join. Classes that agree in a smallest hash meet, in blocks of bounded size if they are many. A
   block's sets make a prefix tree; each set walks it, sharing the overlap of common prefixes, and leaves
   out subtrees whose lengths, or remaining tokens, cannot reach the overlap that the threshold asks for.
2. Completion. Two sets over the threshold share a token among the first ones of each (the prefix). Tokens
   whose classes are already in one component need no work. For each other token the prefixes of its sets
   make a tree, walked once with the overlaps of all sets and pruned by what both sides lack; pairs of
   different components that it leaves are verified on their whole sets. First each set's likeliest pair of a
   token is tried, which joins most of a large group; then all pairs of components that are still different.
   So no link between components is lost, and neither copies nor groups are expanded into pairs.

Hot tokens are cut into blocks, and a task sees one pair of blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name
from .commonest import commonest
from .components import components
from .marks import keep, marked, test
from .textbytes import LOWER, SPACE, lean, mix, running_sum, slices, span_hashes, words

FREQUENT = 1 << 19
BLOCK, BLOCK_TOKENS, PIVOTS = 512, 1 << 22, 4
TOP = np.uint64(1 << 63)
SLICE = 1 << 18
CELL_BITS, CELL_MOST = 7, 255
LOOK = 128


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and 63-bit hash of every shingle of n words; a row with fewer words has its whole sequence as one."""
    low = LOWER[data]
    starts, ends, first = words(low, offsets, ~SPACE[low])
    count = np.diff(first)
    hashes = span_hashes(running_sum(low), starts, ends) if len(starts) else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(count)), count)
    value = np.zeros(len(hashes), np.uint64)
    left = np.repeat(first[1:], count) - np.arange(len(hashes))  # words from here to the row's end
    for k in range(n):
        moved = np.zeros(len(hashes), np.uint64)
        moved[: max(0, len(hashes) - k)] = hashes[k:]
        value += np.where(left > k, mix(moved + np.uint64(0x632BE59BD9B4E019 * (k + 1) & (1 << 64) - 1)), 0)
    short = np.repeat(count < n, count) & (np.arange(len(hashes)) == np.repeat(first[:-1], count))
    keep = (left >= n) | short
    return row[keep], mix(value[keep]) & ~TOP


def frequent(docs: DataFrame, n: int) -> np.ndarray:
    """At most FREQUENT shingles that some task meets often, rarest first, from all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            tokens = np.sort(np.concatenate(held))
            new = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])[: len(tokens)])
            times = np.diff(np.append(new, len(tokens)))
            often = times >= 3
            return pa.RecordBatch.from_arrays([pa.array(tokens[new[often]].astype(np.int64)), pa.array(times[often])], ["token", "n"])

        for _, data, offsets in slices(batches, most=SLICE):
            held.append(shingles(data, offsets, n)[1])
            size += len(held[-1])
            if size > 3 << 20:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    counts = cut(docs.select("text").mapInArrow(lean(count), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")))
    token, times = commonest(counts, {"token": "int64", "n": "int64"}, FREQUENT)
    return token[np.lexsort([token, times])].astype(np.uint64)


def ordered(h: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Hashes as values whose order is the global one. common: sorted; rank: its places by frequency."""
    if not len(common):
        return h
    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
    return np.where(common[at] == h, TOP | rank[at], h)


def _row_sets(common: np.ndarray, n: int) -> Callable:
    by = np.argsort(common)
    table, rank = common[by], by.astype(np.uint64)

    def sets(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each row its hashes and its set in global order."""
        row, h = shingles(data, offsets, n)
        value = ordered(h, table, rank)
        order = np.lexsort([value, row])
        row, h, value = row[order], h[order], value[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
        row, h, value = row[new], h[new], value[new]
        cuts = np.searchsorted(row, np.arange(1, len(offsets) - 1))
        return list(zip(np.split(h, cuts), np.split(value, cuts), strict=True))

    return sets


def least_overlap(a, b, percent: int):
    """Fewest common tokens with which sets of sizes a and b are linked: 100 * common >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


class Trie:
    """A compressed prefix tree over sets in global order; walked by set, largest index first excluded."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(sets[i].dtype.newbyteorder(">")).tobytes())
        self.percent, self.order, self.sets = percent, order, [sets[i] for i in order]
        self.size = np.array([len(s) for s in self.sets])
        self.shared = [0] * len(sets)
        for i in range(1, len(sets)):
            a, b = self.sets[i - 1], self.sets[i]
            k = min(len(a), len(b))
            differ = np.flatnonzero(a[:k] != b[:k])
            self.shared[i] = int(differ[0]) if len(differ) else k
        self.root = self._node(0, len(sets), 0)

    def _node(self, lo: int, hi: int, start: int) -> tuple:
        """(lo, hi, tokens of this edge, depth at its end, shortest, longest, children)."""
        end = min(self.shared[lo + 1 : hi], default=len(self.sets[lo]))
        cuts = [lo, *[i for i in range(lo + 1, hi) if self.shared[i] == end], hi] if hi - lo > 1 else []
        children = [self._node(a, b, end) for a, b in zip(cuts, cuts[1:], strict=False)] if hi - lo > 1 else []
        return lo, hi, self.sets[lo][start:end], end, int(self.size[lo:hi].min()), int(self.size[lo:hi].max()), children

    def links(self, parent: list[int]) -> Iterator[tuple[int, int]]:
        """Links that join two groups of `parent` (a union-find forest over the sets), which it updates."""

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i, own in enumerate(self.sets):
            n, me = len(own), self.order[i]
            stack = [(self.root, 0)]
            while stack:
                (lo, hi, edge, depth, short, long, children), overlap = stack.pop()
                if hi <= i + 1 or 100 * long < self.percent * n or self.percent * short > 100 * n:
                    continue
                if hi - lo == 1 and root(self.order[lo]) == root(me):
                    continue
                rest = n
                if len(edge):
                    at = np.searchsorted(own, edge)
                    overlap += int(np.count_nonzero(own[np.minimum(at, n - 1)] == edge))
                    rest = n - int(at[-1])
                if overlap + min(rest, long - depth) < least_overlap(n, short, self.percent):
                    continue
                if children:
                    stack += [(c, overlap) for c in children]
                elif hi - lo == 1 and overlap >= least_overlap(n, int(self.size[lo]), self.percent):
                    other = self.order[lo]
                    if root(other) != root(me):
                        parent[root(other)] = root(me)
                        yield me, other


def _join_blocks(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets = None, [], []

        def done() -> pa.RecordBatch:
            found = [(ids[i], ids[j]) for i, j in Trie(sets, percent).links(list(range(len(sets))))] if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

        for b in batches:
            for k, block, doc, tokens in zip(*[b.column(c).to_pylist() for c in ("key", "block", "node", "tokens")], strict=True):
                if key != (k, block):
                    yield done()
                    key, ids, sets = (k, block), [], []
                ids.append(doc)
                sets.append(np.frombuffer(tokens, np.uint64))
        yield done()

    return run


def _with_partner(percent: int) -> Callable:
    """Of rows sorted by token, those with a row of the same token that the length and position bounds let pass. Rows of a token that has many all pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        passing = None

        def flush(t: pa.Table) -> Iterator[pa.RecordBatch]:
            token, place = t.column("token").to_numpy(), t.column("place").to_numpy()
            size, at = place >> 32, place & ((1 << 32) - 1)
            new = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])[: len(token)])
            keep = np.repeat(np.diff(np.append(new, len(token))) > BLOCK, np.diff(np.append(new, len(token))))
            first, far = np.flatnonzero((token[1:] == token[:-1]) & ~keep[1:]), 1
            while len(first):
                # rows of one token that stand `far` rows apart
                a, b = size[first], size[first + far]
                ok = first[np.minimum(a - at[first], b - at[first + far]) >= least_overlap(a, b, percent)]
                keep[ok] = keep[ok + far] = True
                far += 1
                first = first[first + far < len(token)]
                first = first[token[first + far] == token[first]]
            yield from t.filter(pa.array(keep)).to_batches()

        # rows of one token may reach over batches, so the last ones wait, unless they are many already
        for b in batches:
            if passing is not None:
                more = int(np.searchsorted(b.column("token").to_numpy(), passing, "right"))
                yield b.slice(0, more)
                b = b.slice(more)
                passing = passing if not b.num_rows else None
            if not b.num_rows:
                continue
            held.append(b)
            t = pa.Table.from_batches(held)
            last = t.column("token")[t.num_rows - 1].as_py()
            start = int(np.searchsorted(t.column("token").to_numpy(), last))
            if start:
                yield from flush(t.slice(0, start))
            held = t.slice(start).to_batches()
            if t.num_rows - start > BLOCK:
                yield from held
                held, passing = [], last
        if held:
            yield from flush(pa.Table.from_batches(held))

    return run


def prefix_pairs(prefixes: list[np.ndarray], size: np.ndarray, label: np.ndarray, side: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Pairs of sets of different labels (and sides, if given) whose prefixes leave room for a link.

    The prefixes make a tree. It is walked once for all sets: `overlap` holds, for each set that is still in,
    how many tokens it shares with the path, so that a common path is compared once. Below the last token of
    its prefix a set lacks what it does not share; a set leaves a subtree when what both sides lack leaves too
    few tokens for its lengths, and the subtree is left when no set is in.
    """
    tree, out = Trie(prefixes, percent), []
    order = np.array(tree.order)
    n, label = size[order], label[order]
    side = None if side is None else side[order]
    count = np.array([len(p) for p in tree.sets])
    flat, start = np.concatenate(tree.sets), np.cumsum(count) - count
    last = flat[start + count - 1]
    by = np.argsort(flat, kind="stable")
    tokens, owner = flat[by], np.repeat(np.arange(len(n)), count)[by]
    place = np.full((len(n), int(count.max())), np.iinfo(np.int64).max)
    place[np.arange(int(count.max())) < count[:, None]] = np.searchsorted(tokens, flat)
    none = np.zeros(len(n), np.int64)
    # sets that are in; what each shares with the path; tokens of the path in its reach, and its own in the path's
    stack = [(tree.root, np.arange(len(n)), none, none, none)]
    while stack:
        (lo, hi, edge, depth, _, _, children), in_, overlap, theirs, own = stack.pop()
        if len(edge):
            a, b = np.searchsorted(tokens, edge), np.searchsorted(tokens, edge, "right")
            met = np.concatenate([owner[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)])
            overlap = overlap + np.bincount(met, minlength=len(n))[in_]
            theirs = theirs + np.searchsorted(edge, last[in_], "right")
            own = (place[in_] <= int(a[-1])).sum(1)
        short, long, size_in = int(n[lo:hi].min()), int(n[lo:hi].max()), n[in_]
        room = np.minimum(size_in - (own - overlap), long - (theirs - overlap))
        stay = (in_ < hi - 1) & (room >= least_overlap(size_in, short, percent)) & (100 * long >= percent * size_in) & (100 * size_in >= percent * short)
        if not children:
            stay &= label[in_] != label[lo]
            if side is not None:
                stay &= side[in_] != side[lo]
            out += [(int(order[i]), int(order[lo])) for i in in_[stay]]
        elif stay.any():
            stack += [(c, in_[stay], overlap[stay], theirs[stay], own[stay]) for c in children]
    return out


def sketch(h: np.ndarray) -> np.ndarray:
    """How many of a set's tokens fall into each of 2 ** CELL_BITS cells; CELL_MOST stands for any larger number."""
    return np.minimum(np.bincount((mix(h) >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=1 << CELL_BITS), CELL_MOST).astype(np.uint8)


def likely(pairs: list[tuple[int, int]], sketches: list[bytes], size: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """The pairs whose cells leave room for a link: two sets share at most the smaller number of each cell."""
    if not pairs:
        return []
    cells = np.stack([np.frombuffer(s, np.uint8) for s in sketches])
    out: list[tuple[int, int]] = []
    for at in range(0, len(pairs), 4096):
        i, j = np.array(pairs[at : at + 4096]).T
        least = np.minimum(cells[i], cells[j])
        ok = (least.sum(1, dtype=np.int64) >= least_overlap(size[i], size[j], percent)) | (least == CELL_MOST).any(1)
        out += zip(i[ok].tolist(), j[ok].tolist(), strict=True)
    return out


def _shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At most LOOK tokens of each prefix in 32 bits, in the same order: fewer and coarser tokens leave more room, never less."""
    for b in batches:
        short = []
        for p in b.column("prefix").to_pylist():
            v = np.frombuffer(p, np.uint64)[:LOOK]
            # rare tokens keep their upper bits; frequent ones are numbers under FREQUENT
            short.append(np.unique(np.where(v & TOP, np.uint64(1 << 31) | v & ~TOP, v >> np.uint64(32)).astype(np.uint32)).tobytes())
        yield b.set_column(b.schema.get_field_index("prefix"), "prefix", pa.array(short, pa.binary()))


def best_each(pairs: list[tuple[int, int]], sketches: list[bytes], size: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """For each set the pair whose cells speak most for a link; of equals that with the smallest label."""
    if not pairs:
        return []
    cells = np.stack([np.frombuffer(s, np.uint8) for s in sketches])
    i, j = np.array(pairs).T
    share = np.concatenate([np.minimum(cells[i[k : k + 4096]], cells[j[k : k + 4096]]).sum(1, dtype=np.int64) for k in range(0, len(i), 4096)]) / np.maximum(size[i], size[j])
    me, other, share = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([share, share])
    order = np.lexsort([label[other], -share, me])
    first = order[np.concatenate([[True], me[order][1:] != me[order][:-1]])]
    return [*{(min(a, b), max(a, b)) for a, b in zip(me[first].tolist(), other[first].tolist(), strict=True)}]


def _pairs(percent: int, one_each: bool) -> Callable:
    """Pairs of different components in one pair of blocks of one token, by the tree of their prefixes; all, or the likeliest one of each set, and then also the tokens with more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(t: pa.Table) -> pa.RecordBatch:
            c = {n: t.column(n).to_numpy() for n in ("token", "lo", "hi", "node", "label", "size", "mine")}
            prefix, sketches = t.column("prefix").to_pylist(), t.column("sketch").to_pylist()
            change = np.flatnonzero((np.diff(c["token"]) != 0) | (np.diff(c["lo"]) != 0) | (np.diff(c["hi"]) != 0)) + 1
            found: set[tuple[int, int]] = set()
            more: list[int] = []
            for s, e in zip([0, *change.tolist()], [*change.tolist(), len(prefix)], strict=True):
                label, mine, one = c["label"][s:e], c["mine"][s:e], c["lo"][s] == c["hi"][s]
                if e - s > 1 and label.min() < label.max() and (one or mine.min() < mine.max()):
                    node = c["node"][s:e].tolist()
                    # of two sets no path is shared
                    pairs = [(0, 1)] if e - s == 2 else prefix_pairs([np.frombuffer(p, np.uint32) for p in prefix[s:e]], c["size"][s:e], label, None if one else mine, percent)
                    pairs = likely(pairs, sketches[s:e], c["size"][s:e], percent)
                    if one_each:
                        every, pairs = len(pairs), best_each(pairs, sketches[s:e], c["size"][s:e], label)
                        more += [int(c["token"][s])] * (len(pairs) < every)
                    found.update((min(node[i], node[j]), max(node[i], node[j])) for i, j in pairs)
            none = [None] * len(more)
            return pa.RecordBatch.from_arrays([pa.array([*[x for x, _ in found], *none], pa.int64()), pa.array([*[y for _, y in found], *none], pa.int64()), pa.array([*[None] * len(found), *more], pa.int64())], ["x", "y", "token"])

        # rows come sorted by group; a group may reach over batches, so its last rows wait for the next one
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            t = pa.Table.from_batches(held)
            last = [t.column(n)[t.num_rows - 1].as_py() for n in ("token", "lo", "hi")]
            same = np.logical_and.reduce([t.column(n).to_numpy() == v for n, v in zip(("token", "lo", "hi"), last, strict=True)])
            start = int(np.flatnonzero(same)[0])
            if start:
                yield flush(t.slice(0, start))
            held = t.slice(start).to_batches()
        if held:
            yield flush(pa.Table.from_batches(held))

    return run


def _verify(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for s, t in zip(b.column("s").to_pylist(), b.column("t").to_pylist(), strict=True):
                s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                ok.append(len(np.intersect1d(s, t, assume_unique=True)) >= least_overlap(len(s), len(t), percent))
            ok = np.array(ok, bool)
            yield pa.RecordBatch.from_arrays([b.column("x").filter(pa.array(ok)), b.column("y").filter(pa.array(ok))], ["a", "b"])

    return run


def similar_groups(docs: DataFrame, n: int = 3, percent: int = 90, before: Callable = iter) -> DataFrame:
    """doc_id, n_shingles long, component_id long: the groups of documents that links connect.

    Letters A-Z count as a-z; words are runs of bytes other than white space. Texts without words have
    empty sets, linked with nothing, and are their own component; null texts likewise. A null doc_id takes
    part as a document of its own set, with that set's smallest id. Rows that repeat an id get one component.
    An empty table gives no rows; other columns are ignored, unless `before` turns batches of them into
    others (it runs inside the same tasks, so that no second worker is needed).
    """
    docs = docs.select("doc_id", "text") if before is iter else docs
    common = docs.sparkSession.sparkContext.broadcast(frequent(docs, n))

    def light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _row_sets(common.value, n)
        for rows, data, offsets in slices(batches, most=SLICE):
            found = [v for _, v in sets(data, offsets)]
            digests = [hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in found]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([len(v) for v in found], pa.int64()), pa.array(digests, pa.binary())], ["doc_id", "size", "class"])

    def rich(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """As light, with two smallest hashes and the prefix, for sets that are not empty."""
        sets = _row_sets(common.value, n)
        for rows, data, offsets in slices(batches, most=SLICE):
            found = sets(data, offsets)
            at = [i for i, (_, v) in enumerate(found) if len(v)]
            found = [found[i] for i in at]
            prefix = [v[: len(v) - least_overlap(len(v), -(-percent * len(v) // 100), percent) + 1].tobytes() for _, v in found]
            keys = [[int(h.min())] for h, _ in found]
            digests = [hashlib.blake2b(v.tobytes(), digest_size=16).digest() for _, v in found]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(at, pa.int64())), pa.array([len(v) for _, v in found], pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(prefix, pa.binary()), pa.array([sketch(h).tobytes() for h, _ in found], pa.binary())], ["doc_id", "size", "class", "keys", "prefix", "sketch"])

    # one node a class: its smallest document
    classed = (docs.where("doc_id is not null") if before is iter else docs).mapInArrow(lean(lambda b: rich(before(b))), "doc_id long, size long, class binary, keys array<long>, prefix binary, sketch binary")
    nodes = cut(classed.groupBy("class").agg(F.min(F.struct("doc_id", "size", "keys", "prefix", "sketch")).alias("r")).select(F.col("r.doc_id").alias("node"), "class", "r.size", "r.keys", "r.prefix", "r.sketch"))

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                tokens = [np.frombuffer(p, np.int64) for p in part.column("prefix").to_pylist()]
                many = [len(t) for t in tokens]
                place = np.repeat(part.column("size").to_numpy(), many) << 32 | np.concatenate([np.arange(m) for m in many])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.repeat(part.column("node").to_numpy(), many)), pa.array(place)], ["token", "node", "place"])

    listed = nodes.select("node", "size", "prefix").mapInArrow(lean(postings), "token long, node long, place long")
    # the top bit marks the frequent tokens: only those can have many nodes
    seldom = listed.where("token >= 0").repartition("token").sortWithinPartitions("token", "place").mapInArrow(lean(_with_partner(percent)), listed.schema)
    frequents = listed.where("token < 0")
    often = frequents.groupBy("token").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    shared = cut(seldom.union(frequents.join(often.select("token"), "token").select(*listed.columns)).select("token", "node"))

    active = shared.select("node").distinct()
    keyed = nodes.join(active, "node").select("node", "size", F.explode("keys").alias("key"))
    pivot = [F.min(F.when(F.pmod(F.xxhash64("node"), F.lit(PIVOTS)) == k, F.col("node"))).alias(f"p{k}") for k in range(PIVOTS)]
    met = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("tokens"), *pivot).where("m > 1")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("m") / BLOCK), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("int")
    met = cut(met.select("key", blocks.alias("blocks"), F.array_compact(F.array(*[f"p{k}" for k in range(PIVOTS)])).alias("pivots")))
    own = keyed.join(met, "key").select("key", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "node")
    # some nodes stand in every block of a large group, so that blocks are linked with each other
    pivots = met.where("blocks > 1").select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "pivots").select("key", "block", F.explode("pivots").alias("node"))
    placed = own.union(pivots).distinct()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _row_sets(common.value, n)
        for rows, data, offsets in slices(batches, most=SLICE):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([v.tobytes() for _, v in sets(data, offsets)], pa.binary())], ["node", "tokens"])

    def sets_of(nodes_: DataFrame) -> DataFrame:
        """Whole sets of the documents that nodes_ may hold."""
        among = keep(marked(nodes_), "doc_id")
        return docs.mapInArrow(lean(lambda b: whole(among(before(b)))), "node long, tokens binary")

    placed = cut(placed)
    met_rows = placed.join(sets_of(placed.select("node")), "node").repartition("key", "block").sortWithinPartitions("key", "block", "node")
    first = cut(met_rows.select("key", "block", "node", "tokens").mapInArrow(lean(_join_blocks(percent)), "a long, b long"))

    def completed(links: DataFrame, shared: DataFrame, one_each: bool) -> tuple[DataFrame, DataFrame]:
        """Links between components of `links`: all that there are, or one that is likely for each set and token, and the rows of tokens that may have more."""
        labelled = shared.join(components(links), "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
        open_ = labelled.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min("label").alias("least"), F.max("label").alias("most")).where("least < most")
        open_ = open_.select("token", F.ceil(F.col("m") / (2 * BLOCK)).cast("int").alias("blocks"))
        rest = cut(labelled.join(open_, "token").withColumn("mine", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int")))
        among_heads = keep(marked(rest.select("node")), "node")
        heads = nodes.select("node", "size", "prefix", "sketch")
        heads = heads.mapInArrow(lean(lambda b: _shortened(among_heads(b))), heads.schema)
        open_rows = rest.join(heads, "node")
        # a first look is taken inside of blocks only
        others = F.array("mine") if one_each else F.sequence(F.lit(0), F.col("blocks") - 1)
        spread = open_rows.select("token", "node", "label", "size", "prefix", "sketch", "mine", F.explode(others).alias("other"))
        spread = spread.select("token", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "node", "label", "size", "prefix", "sketch", "mine")
        sorted_ = spread.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi")
        told = cut(sorted_.mapInArrow(lean(_pairs(percent, one_each)), "x long, y long, token long").distinct())
        pairs = told.where("token is null").select("x", "y")
        more = told.where("token is not null").select("token").union(open_.where("blocks > 1").select("token")) if one_each else told.select("token").where("false")
        sets = cut(sets_of(pairs.select("x").union(pairs.select("y"))))
        both = pairs.join(sets.select(F.col("node").alias("x"), F.col("tokens").alias("s")), "x").join(sets.select(F.col("node").alias("y"), F.col("tokens").alias("t")), "y")
        return both.select("x", "y", "s", "t").mapInArrow(lean(_verify(percent)), "a long, b long"), shared.join(more, "token", "left_semi")

    # most of a large group is linked by its likeliest pairs, so that few of its pairs are left for the whole look
    likely_links, left = completed(first, shared, one_each=True)
    likeliest = cut(first.union(likely_links))
    final = components(likeliest.union(completed(likeliest, cut(left), one_each=False)[0]))

    classes = nodes.select("class", "node").join(final, "node", "left").select("class", F.coalesce("component", "node").alias("component"))
    result = docs.mapInArrow(lean(lambda b: light(before(b))), "doc_id long, size long, class binary").join(classes, "class", "left")
    return result.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


LARGE = 1 << 62


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, the one of the smallest doc_id, with all its columns.

    Rows of one id are documents of their own: where an id is null or stands in several rows, a hash of id and
    text, larger than any id, names the row instead. Of rows equal in both, one stays if they have words.
    """
    name, hashed = free_name(docs, "row_key"), F.xxhash64("doc_id", "text")
    shared = marked(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, h = b.column("doc_id"), b.column(name).to_numpy()
            alone = ids.is_valid().to_numpy(zero_copy_only=False) & ~test(shared, ids)
            own = np.where(alone, ids.fill_null(0).to_numpy(), h & (LARGE - 1) | LARGE)
            yield b.set_column(b.schema.get_field_index(name), name, pa.array(own))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in key(batches):
            yield pa.RecordBatch.from_arrays([b.column(name), b.column("text")], ["doc_id", "text"])

    found = cut(similar_groups(docs.select("doc_id", "text", hashed.alias(name)), n, percent, named))
    rows = found.groupBy(F.col("doc_id").alias("own_")).agg(F.min("component_id").alias("first_"), F.min("n_shingles").alias("size_"), F.count(F.lit(1)).alias("rows_"))
    odd = cut(rows.where("own_ != first_ or rows_ > 1"))
    marks = marked(odd.select("own_"))
    keyed = docs.withColumn(name, hashed)

    def among(wanted: bool) -> Callable:
        only = keep(marks, name, wanted)
        return lambda batches: only(key(batches))

    plain = keyed.mapInArrow(lean(among(False)), keyed.schema).select(*docs.columns)
    # the row travels as one struct, so that no column of it can clash with those made here
    rest = keyed.mapInArrow(lean(among(True)), keyed.schema).select(F.col(name).alias("own_"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"))
    rest = rest.join(odd, "own_", "left").where("first_ is null or own_ = first_")
    once = F.coalesce(F.col("rows_") > 1, F.lit(False)) & (F.col("size_") > 0)
    single = rest.where(once).groupBy("own_").agg(F.first("row_").alias("row_"))
    back = [F.col("row_").getField(c).alias(c) for c in docs.columns]
    return plain.union(rest.where(~once).select(*back)).union(single.select(*back))
