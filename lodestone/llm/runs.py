"""Periodic runs of words, from Lyndon arrays over ordered alphabets, in linear time and without suffix structures or hashes.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends. Its root is a
Lyndon word under the order of words or under the reverse one, so that the edge from a root's start to the next
smaller suffix is one period long. Both Lyndon arrays are built from the left to the right with the number of
equal words along each edge; what an earlier comparison has matched is copied instead of compared again.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import SPACE, lean, slices, words

#: A run counts from so many words and so many periods on.
SHORTEST, TIMES = 24, 3
COLUMNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def lyndon_edges(w: list[int], counted: list[int] | None = None) -> tuple[list[int], list[int]]:
    """For every position the start of the next smaller suffix (len(w): none) and the number of equal words from both on.

    Suffixes are compared along the chain of previous smaller ones. The stretch [left, right) that was matched last and
    farthest equals the one `shift` before it: a pair inside has the result of its pair there unless that reaches the
    stretch's end, and then comparing goes on from the end. `counted` collects the comparisons of words.
    """
    n = len(w)
    before, before_equal, after, after_equal = [-1] * n, [0] * n, [n] * n, [0] * n
    left = right = shift = compared = 0
    for i in range(1, n):
        c, least = i - 1, 0
        while True:
            equal, known = least, -1
            if i < right:
                x = i - shift
                y = c - shift if c >= left else c
                if 0 <= y < x:
                    if after[y] == x:
                        known = after_equal[y]
                    elif before[x] == y:
                        known = before_equal[x]
            if known >= 0 and i + known < right:
                equal = known
            else:
                if known >= 0 and right - i > equal:
                    equal = right - i
                at = equal
                while i + equal < n and w[c + equal] == w[i + equal]:
                    equal += 1
                compared += equal - at + 1
                if i + equal > right:
                    left, right, shift = i, i + equal, i - c
            # pop all of the chain that is larger than suffix i; equal words up to a mismatch are known for most of it
            smaller = i + equal < n and w[c + equal] < w[i + equal]
            while not smaller:
                after[c], after_equal[c] = i, equal
                up, upper = before[c], before_equal[c]
                c = up
                if up < 0 or equal >= upper:
                    break
            if smaller:
                before[i], before_equal[i] = c, equal
                break
            if c < 0:
                break
            if equal > upper:
                before[i], before_equal[i] = c, upper
                break
            least = equal
    if counted is not None:
        counted.append(compared)
    return after, after_equal


def runs_of(codes: np.ndarray, shortest: int = SHORTEST, times: int = TIMES) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least `shortest` words and `times` periods (2 or more)."""
    found = set()
    n = len(codes)
    for w in (codes.tolist(), (-codes).tolist()):
        to, equal = (np.array(x, np.int64) for x in lyndon_edges(w))
        at = np.arange(n)
        period = to - at
        end = to + equal
        first = (to < n) & (end - at >= np.maximum(shortest, times * period) - period + 1)
        # the same run's root one period earlier tells it
        earlier = at - period
        had = first & (earlier >= 0)
        had[had] = (to[earlier[had]] == at[had]) & (end[earlier[had]] == end[had])
        for i in np.flatnonzero(first & ~had).tolist():
            q, e, s = int(period[i]), int(end[i]), i
            while s > 0 and w[s - 1] == w[s - 1 + q]:
                s -= 1
            if e - s >= max(shortest, times * q):
                found.add((s, e - s, q))
    return found


def candidates(codes: np.ndarray, rows: np.ndarray, shortest: int = SHORTEST, times: int = TIMES) -> Iterator[tuple[int, int]]:
    """Stretches, one after another, that hold every run whole; none spans two rows (`rows`: the row of each word).

    In a run of period q each word but the first q stands at most q after its last occurrence. So for every power of
    two at or over q, the rest of the run lies in a stretch of words that recur within that power.
    """
    n = len(codes)
    if n < shortest:
        return
    order = np.argsort(codes, kind="stable")
    gap = np.full(n, n + 1)
    same = (codes[order[1:]] == codes[order[:-1]]) & (rows[order[1:]] == rows[order[:-1]])
    gap[order[1:][same]] = (order[1:] - order[:-1])[same]
    row_start = np.searchsorted(rows, rows)
    edge = np.zeros(n + 1, np.int64)
    new_row = np.flatnonzero(row_start == np.arange(n))
    longest = int(np.diff(np.append(new_row, n)).max())
    reach = 1
    while True:
        # the least length of what is left of a run with a period over half of reach
        least = max(shortest - reach, (times - 1) * (reach // 2 + 1), 1)
        if least > longest:
            break
        inside = gap <= reach
        starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1] & (rows[1:] == rows[:-1])]))
        ends = np.flatnonzero(inside & ~np.concatenate([inside[1:] & (rows[1:] == rows[:-1]), [False]])) + 1
        long = ends - starts >= least
        np.add.at(edge, np.maximum(starts[long] - reach, row_start[starts[long]]), 1)
        np.add.at(edge, ends[long], -1)
        reach *= 2
    depth = np.cumsum(edge)[:-1] > 0
    starts = np.flatnonzero(depth & ~np.concatenate([[False], depth[:-1] & (rows[1:] == rows[:-1])]))
    ends = np.flatnonzero(depth & ~np.concatenate([depth[1:] & (rows[1:] == rows[:-1]), [False]])) + 1
    yield from zip(starts.tolist(), ends.tolist(), strict=True)


def ranks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """The rank of each word among the different ones, in order of bytes."""
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    return pc.rank(column, tiebreaker="dense").to_numpy().astype(np.int64)


def planted(h: int, n: int) -> np.ndarray:
    """Which word each of the n becomes, by the checksum of the document's id: every tenth document turns periodic."""
    at = np.arange(n)
    if h % 10 == 0 and n > 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        at[a:] = a + (at[a:] - a) % p
    return at


def dropped(found: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """The words that stand in any run after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge)[:-1] > 0


def _told(doc_id: int | None, found: list[tuple[int, int, int]], collapsed: bytes) -> tuple:
    found.sort(key=lambda r: (r[0], r[2]))
    first: tuple = (None,) * 4
    if found:
        # an exact comparison of length / period by cross products
        best = found[0]
        for run in found[1:]:
            if run[1] * best[2] > best[1] * run[2]:
                best = run
        first = (*best, 1000 * best[1] // best[2])
    told = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return (doc_id, len(found), *first, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest())


def _slice(ids: list, data: np.ndarray, offsets: np.ndarray, plant: bool) -> pa.RecordBatch:
    inside = ~SPACE[data]
    starts, ends, first = words(data, offsets, inside)
    n = np.diff(first)
    source = np.arange(len(starts))
    for k, doc_id in enumerate(ids):
        if plant and (h := zlib.crc32(b"" if doc_id is None else b"%d" % doc_id)) % 10 == 0:
            source[first[k] : first[k + 1]] = first[k] + planted(h, int(n[k]))
    rows = np.repeat(np.arange(len(ids)), n)
    codes = ranks(data, starts, ends, inside)[source] if len(starts) else np.zeros(0, np.int64)
    runs: dict[int, list[tuple[int, int, int]]] = {}
    for s, e in candidates(codes, rows):
        row = int(rows[s])
        runs.setdefault(row, []).extend((s - int(first[row]) + a, b, q) for a, b, q in runs_of(codes[s:e]))
    # what stays as it is: each word and one space between two
    keep, spaced = inside.copy(), data.copy()
    between = ends[:-1][rows[1:] == rows[:-1]]
    keep[between], spaced[between] = True, 0x20
    bounds = np.concatenate([[0], np.cumsum(keep)])[offsets]
    flat = spaced[keep]
    out = []
    for k, doc_id in enumerate(ids):
        found = runs.get(k, [])
        a, b = int(first[k]), int(first[k + 1])
        if found or (source[a:b] != np.arange(a, b)).any():
            left = source[a:b][~dropped(found, b - a)]
            text = b" ".join(data[s:e].tobytes() for s, e in zip(starts[left].tolist(), ends[left].tolist(), strict=True))
        else:
            text = flat[bounds[k] : bounds[k + 1]].tobytes()
        out.append(_told(doc_id, found, text))
    names, types = zip(*(c.split() for c in COLUMNS.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if t == "string" else pa.int64()) for c, t in zip(zip(*out, strict=True), types, strict=True)], list(names))


def run_report(docs: DataFrame, plant: bool = True) -> DataFrame:
    """The runs of every document and a digest of its text without their repetitions.

    A document without words, text or runs has no runs, four nulls, and its words joined by one space; rows that
    share an id are told each for itself; an id that is null has the checksum of no bytes; other columns are not read.
    `plant` false leaves texts as they are. Memory is some fifteen times the longest text; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            yield _slice(rows.column("doc_id").to_pylist(), data, offsets, plant)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), COLUMNS)


def without_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns, each text's runs cut to their first period; a text without runs stays byte for byte, null stays null."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches, text):
            inside = ~SPACE[data]
            starts, ends, first = words(data, offsets, inside)
            of = np.repeat(np.arange(rows.num_rows), np.diff(first))
            codes = ranks(data, starts, ends, inside) if len(starts) else np.zeros(0, np.int64)
            runs: dict[int, list[tuple[int, int, int]]] = {}
            for s, e in candidates(codes, of):
                row = int(of[s])
                runs.setdefault(row, []).extend((s - int(first[row]) + a, b, q) for a, b, q in runs_of(codes[s:e]))
            texts = rows.column(text).to_pylist()
            for k, found in runs.items():
                if found:
                    left = int(first[k]) + np.flatnonzero(~dropped(found, int(first[k + 1] - first[k])))
                    texts[k] = b" ".join(data[s:e].tobytes() for s, e in zip(starts[left].tolist(), ends[left].tolist(), strict=True)).decode()
            at = rows.schema.get_field_index(text)
            yield rows.set_column(at, rows.schema.field(at), pa.array(texts, rows.schema.field(at).type))

    return docs.mapInArrow(lean(run), schema)
