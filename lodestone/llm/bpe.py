"""Byte-level BPE encoding of overlapping chunks, and decoding.

A text is cut into chunks that overlap. Every chunk is split on its own, from an arbitrary first
character, into words that no pre-token crosses; the pattern splits those further. A match of the pattern depends only on the characters from its start on,
so two neighbours whose pre-tokens begin at the same character agree from there: they are stitched at
the first such place, and a chunk is trusted only as far as its matches cannot depend on characters
behind its end. Where no place agrees inside the overlap, the left chunk's matches are carried on over
the right one's characters. The stitched pieces are encoded by merging the pair of lowest rank first.
Decoding concatenates the bytes of the ids.

Texts of at most one chunk are encoded where they are read. The chunks of longer texts are dealt out
over the cluster for pre-tokenising, and come together, as boundaries, only to be stitched.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textbytes import lean

CHUNK = 32768
OVERLAP = 512
CACHE = 100_000
NONE = 1 << 40
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Runs of non-white characters with one space before, and white space between them. Pre-tokens of the
#: patterns that this encoder takes never reach over a bound of these, so texts are split here first.
WORDS = f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"
LOOK = 8  # no match of the pattern depends on so many characters behind its end


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from lines of base64 and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the adjacent pair whose join has the lowest rank is joined, leftmost first, until none has one."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) <= 64:
        none = 1 << 60
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pairs and (best := min(pairs)) != none:
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = ranks.get(parts[at] + parts[at + 1], none)
            if at:
                pairs[at - 1] = ranks.get(parts[at - 1] + parts[at], none)
        return [ranks[p] for p in parts]
    n = len(piece)
    end, left, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        j = end[i]
        alive[j], end[i] = False, stop
        if stop < n:
            left[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if left[i] >= 0 and (r := ranks.get(piece[left[i] : stop])) is not None:
            heapq.heappush(heap, (r, left[i], stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Coder:
    """Encodes and decodes with one vocabulary; words met lately are remembered, up to twice CACHE of them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern, self.words = ranks, regex.compile(pattern), re.compile(WORDS)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.decimal = [str(i) for i in range(len(self.bytes_of))]
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        keys = np.array([*pairs, (1 << 62)], np.int64)
        order = np.argsort(keys)
        self.pairs, self.joined = keys[order], np.array([*pairs.values(), NONE], np.int64)[order]
        self.single = np.array([ranks.get(bytes([i]), 0) for i in range(256)], np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank, and so id, of the joins of two tokens; NONE where there is none, or a token is missing."""
        key = (a << 32) | np.maximum(b, 0)
        at = np.searchsorted(self.pairs, key)
        return np.where((self.pairs[at] == key) & (a >= 0) & (b >= 0), self.joined[at], NONE)

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """merge() of every piece, as 4 bytes an id; pieces of like length side by side, one join a round in each."""
        out = [b""] * len(pieces)
        sizes = np.array([len(p) for p in pieces])
        for i in np.flatnonzero(sizes > 32).tolist():
            out[i] = np.array(merge(pieces[i], self.ranks), "<u4").tobytes()
        for least, width in ((0, 4), (4, 8), (8, 12), (12, 16), (16, 24), (24, 32)):
            own = np.flatnonzero((sizes > least) & (sizes <= width))
            if not len(own):
                continue
            text = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in own.tolist()), np.uint8).reshape(-1, width)
            inside = np.arange(width) < sizes[own, None]
            tokens = np.full((len(own), width + 1), -1, np.int64)
            tokens[:, :width] = np.where(inside, self.single[text], -1)
            ranks = self._rank(tokens[:, :-1], tokens[:, 1:])
            rows, place = np.arange(len(own)), np.arange(width)
            while len(rows):
                now = ranks[rows]
                at = now.argmin(1)
                best = now[np.arange(len(rows)), at]
                live = best < NONE
                rows, at, best = rows[live], at[live], best[live]
                # close the gap of the joined pair's second token, then rank the two pairs beside the join
                shift = np.minimum(place + (place > at[:, None]), width)
                tokens[rows[:, None], place] = tokens[rows[:, None], shift]
                tokens[rows, at] = best
                ranks[rows[:, None], place] = np.take_along_axis(now[live], np.minimum(shift, width - 1), 1)
                ranks[rows, width - 1] = NONE
                ranks[rows, at] = self._rank(best, tokens[rows, at + 1])
                left = np.maximum(at - 1, 0)
                ranks[rows, left] = np.where(at > 0, self._rank(tokens[rows, left], best), ranks[rows, left])
            there = tokens >= 0
            ends = (4 * np.cumsum(there.sum(1))).tolist()
            flat = tokens[there].astype("<u4").tobytes()
            for i, a, b in zip(own.tolist(), [0, *ends], ends, strict=False):
                out[i] = flat[a:b]
        return out

    def encode_many(self, texts: Sequence[Sequence[str]]) -> list[list[int]]:
        """Ids of texts that are given as words."""
        if len(self.known) > CACHE:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        new = []
        for word in set(chain.from_iterable(texts)):
            if word not in known:
                ids = before.get(word)
                if ids is None:
                    new.append(word)
                else:
                    known[word] = ids
        split = [[w] if w.isalpha() or (w[0] == " " and w[1:].isalpha()) else self.pattern.findall(w) for w in new]
        pieces = self.merge_many([p.encode("utf-8", "surrogatepass") for own in split for p in own])
        at = 0
        for word, own in zip(new, split, strict=True):
            known[word] = pieces[at] if len(own) == 1 else b"".join(pieces[at : at + len(own)])
            at += len(own)
        return [np.frombuffer(b"".join(map(known.__getitem__, words)), "<u4").tolist() for words in texts]

    def encode(self, words: Sequence[str]) -> list[int]:
        return self.encode_many([words])[0]

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digest(self, ids: Sequence[int]) -> str:
        return hashlib.sha256(",".join(map(self.decimal.__getitem__, ids)).encode()).hexdigest()

    def pieces(self, text: str) -> list[str]:
        return self.words.findall(text)

    def starts(self, chunk: str, last: bool) -> list[int]:
        """Starts of the chunk's matches, and the end of the last trusted one. One that reaches the end of a chunk with more text behind it may be wrong, and so may one that looks ahead to that end."""
        spans = [m.span() for m in self.words.finditer(chunk)]
        while not last and spans and spans[-1][1] > len(chunk) - LOOK:
            spans.pop()
        return [a for a, _ in spans] + [spans[-1][1]] if spans else []

    def stitch(self, chunks: Iterator[tuple[int, str, Sequence[int]]]) -> Iterator[list[str]]:
        """Pieces of a text, given its chunks in order: where each begins, its characters, and starts()."""
        at, text_at, text = 0, 0, ""
        for begin, chunk, bounds in chunks:
            here = {begin + b for b in bounds[:-1]}
            # the left chunk's rest and this chunk's characters, from the first that no piece has yet
            text = text[at - text_at : begin - text_at] + chunk if at < begin else chunk[at - begin :]
            text_at, out = at, []
            while at not in here:
                m = self.words.match(text, at - text_at)
                if not m or m.end() == m.start() or m.end() > len(text) - LOOK:
                    break
                out.append(m.group())
                at = text_at + m.end()
            if at in here:
                own = [begin + b for b in bounds]
                own = own[own.index(at) :]
                out += [chunk[a - begin : b - begin] for a, b in zip(own, own[1:], strict=False)]
                at = own[-1]
            yield out
        # the last chunk ends the text, so what is left matches as it stands
        yield [m.group() for m in self.words.finditer(text, at - text_at)]


_CODERS: dict[tuple[str, str], Coder] = {}


def coder(path: str, pattern: str) -> Coder:
    """The coder of this task; `forget` lets it go."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = Coder(load_ranks(path), pattern)
    return _CODERS[path, pattern]


def forget(run: Callable) -> Callable:
    """run, without a coder left behind: each worker would keep one, and workers outlive their tasks."""

    def outer(rows):
        try:
            out = run(rows)
            yield from out
        finally:
            _CODERS.clear()

    return outer


OUT = {
    "n_tokens": (T.LongType(), pa.int64()),
    "ids": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
    "ids_sha256": (T.StringType(), pa.string()),
    "decoded_sha256": (T.StringType(), pa.string()),
}


def encode(docs: DataFrame, path: str, pattern: str, with_ids: bool = True, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The columns of docs, then n_tokens, ids (if wanted) and the digests of the ids and of their decoded bytes.

    `path` names a rank file that every worker can read. Null and empty texts have no ids. Rows that
    repeat are encoded one by one. Characters that the pattern never matches have no ids. A column of
    docs that has the name of a result gives way to it.
    """
    fields = [f for f in OUT if with_ids or f != "ids"]
    columns = [c for c in docs.columns if c.lower() not in OUT]
    text_at = columns.index("text")
    packed = docs.select(F.struct(*columns).alias("row"))
    schema = packed.schema
    for f in fields:
        schema = schema.add(f, OUT[f][0])
    step = chunk - overlap

    def results(found: list[list[int]], code: Coder) -> list[pa.Array]:
        values = {"n_tokens": map(len, found), "ids": found, "ids_sha256": map(code.digest, found), "decoded_sha256": (hashlib.sha256(code.decode(ids)).hexdigest() for ids in found)}
        return [pa.array(list(values[f]), OUT[f][1]) for f in fields]

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path, pattern)
        for rows in batches:
            for at in range(0, rows.num_rows, 256):
                row = rows.column("row").slice(at, 256)
                found = code.encode_many([code.pieces(t or "") for t in row.field(text_at).to_pylist()])
                yield pa.RecordBatch.from_arrays([row, *results(found, code)], ["row", *fields])

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path, pattern)
        for rows in batches:
            found = [code.starts(t, last) for t, last in zip(rows.column("part").to_pylist(), rows.column("last").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(c) for c in ("doc_no", "row", "begin", "part")] + [pa.array(found, pa.list_(pa.int32()))], ["doc_no", "row", "begin", "part", "bounds"])

    def join_up(rows: pa.Table) -> pa.Table:
        code = coder(path, pattern)
        rows = rows.sort_by("begin")
        ids: list[int] = []
        for pieces in code.stitch(zip(*[rows.column(c).to_pylist() for c in ("begin", "part", "bounds")], strict=True)):
            ids += code.encode(pieces)
        return pa.Table.from_arrays([rows.column("row").slice(0, 1), *results([ids], code)], ["row", *fields])

    text = F.col("row").getField("text")
    n = F.length(text)
    whole = packed.where(F.coalesce(n, F.lit(0)) <= chunk).mapInArrow(lean(forget(short)), schema)
    long = packed.where(n > chunk).withColumn("doc_no", F.monotonically_increasing_id())
    begins = F.sequence(F.lit(0), n - 1 - overlap, F.lit(step))
    # the row itself travels with its first chunk only
    cut = F.transform(begins, lambda b: F.struct(F.when(b == 0, F.col("row")).alias("row"), b.alias("begin"), F.substring(text, b + 1, F.lit(chunk)).alias("part"), (b + chunk >= n).alias("last")))
    parts = long.select("doc_no", F.explode(cut).alias("c")).select("doc_no", "c.*")
    bounded = parts.repartition("doc_no", "begin").mapInArrow(lean(forget(bounds)), parts.select("doc_no", "row", "begin", "part").schema.add("bounds", T.ArrayType(T.IntegerType())))
    joined = bounded.groupBy("doc_no").applyInArrow(join_up, schema)
    result = whole.unionByName(joined)
    return result.select(*[F.col("row").getField(c).alias(c) for c in columns], *fields)


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """The columns of tokens, then decoded binary: the bytes of the array `ids`. A null array gives null."""
    columns = [c for c in tokens.columns if c.lower() != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path, pattern)
        for rows in batches:
            found = [None if ids is None else code.decode(ids) for ids in rows.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, pa.binary())], [*columns, "decoded"])

    return tokens.select(*columns).mapInArrow(lean(forget(run)), tokens.select(*columns).schema.add("decoded", "binary"))


def token_report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    return encode(docs.select("doc_id", "text"), path, pattern, with_ids=False).drop("text")
