"""Nearest neighbours by largest inner product with an inverted multi-index.

Vectors are cut into two halves, each quantised with its own codebook; a pair of codes is a cell. For a
query, the pairs are taken from a heap in order of their summed inner products with the query's halves,
until the cells taken hold `visit` of all entries and `k` entries of other ids. The entries of those cells are ranked by their true
inner products. Codebooks are fitted on a bounded sample (`sample` rows in hash order); every row is indexed.

Entries and queries travel in packs of bounded rows. Entry packs are keyed by their slab (a first code) and a
salt, of which a slab has more the more entries it has; each query pack goes to every salt of the slabs of
which it visits a cell.
Vectors without structure need a large `visit` for a recall of 0.9; clustered ones much less.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .textbytes import lean

PACK, QUERY_PACK = 1024, 256


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part: no null, zero, null or non-finite component, and the most frequent dimension (of equally frequent ones, the one with the smallest id)."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0))
    sizes = rows.groupBy(F.size("embedding").alias("n")).agg(F.count(F.lit(1)).alias("rows"), F.min("vec_id").alias("id"))
    first = sizes.orderBy(F.desc("rows"), "id", "n").first()
    return rows.where(F.size("embedding") == (first["n"] if first else 0))


def k_means(points: np.ndarray, k: int, rounds: int = 12, seed: int = 20240601) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        own = nearest(points, centres)
        sums, sizes = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, points)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * points @ centres.T).argmin(1)


def fit(rows: DataFrame, codes: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Codebooks of the two halves."""
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").collect()
    points = np.array([r["embedding"] for r in picked])
    points = points[np.lexsort(points.T)]
    half = points.shape[1] // 2
    return k_means(points[:, :half], min(codes, len(points))), k_means(points[:, half:], min(codes, len(points)))


def visited(scores: tuple[np.ndarray, np.ndarray], sizes: np.ndarray, wanted: float) -> list[tuple[int, int]]:
    """Pairs of codes in order of the sum of their scores, until their cells hold `wanted` entries or all are taken."""
    order = [np.argsort(-s, kind="stable") for s in scores]
    best = [s[o].tolist() for s, o in zip(scores, order, strict=True)]
    heap, seen, out, held = [(-best[0][0] - best[1][0], 0, 0)], {(0, 0)}, [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        a, b = int(order[0][i]), int(order[1][j])
        out.append((a, b))
        held += int(sizes[a, b])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(best[0]) and y < len(best[1]) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (-best[0][x] - best[1][y], x, y))
    return out


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def search(vectors: DataFrame, every: int = 20, k: int = 20, visit: float = 0.6, codes: int = 32, sample: int = 20_000) -> DataFrame:
    """query_id, rank, vec_id, score: the k entries of largest inner product found for each query.

    Queries are the rows whose vec_id is divisible by `every`, and rows of equal id and embedding are one
    query; an entry with the query's vec_id is no candidate. A query has k rows, or all candidates if there
    are fewer, at every `visit`. Ties go to the smaller vec_id. Rows that repeat an id are entries of their
    own. Rows that `usable` leaves out take no part, and an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    schema = "query_id long, rank int, vec_id long, score double"
    if rows.isEmpty():
        return spark.createDataFrame([], schema)
    books = fit(rows, codes, sample)
    dim, half = books[0].shape[1] + books[1].shape[1], books[0].shape[1]
    shape = (len(books[0]), len(books[1]))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _vectors(b.column("embedding"), dim)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("embedding"), pa.array(nearest(x[:, :half], books[0]), pa.int32()), pa.array(nearest(x[:, half:], books[1]), pa.int32())], ["vec_id", "embedding", "a", "b"])

    indexed = cut(rows.mapInArrow(lean(assign), "vec_id long, embedding array<double>, a int, b int"))
    sizes = np.zeros(shape, np.int64)
    for r in indexed.groupBy("a", "b").count().collect():  # one row a cell
        sizes[r["a"], r["b"]] = r["count"]
    total = int(sizes.sum())
    salts = [max(1, int(-(-n // (4 * PACK)))) for n in sizes.sum(1)]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one slab come together; several slabs may be in one task."""
        held: dict[tuple[int, int], list] = {}
        for b in batches:
            keys = np.stack([b.column("a").to_numpy(), b.column("salt").to_numpy()], 1)
            x, ids, second = _vectors(b.column("embedding"), dim), b.column("vec_id").to_numpy(), b.column("b").to_numpy()
            for key in np.unique(keys, axis=0):
                own = (keys == key).all(1)
                held.setdefault((int(key[0]), int(key[1])), []).append((ids[own], second[own], x[own]))
                if sum(len(p[0]) for p in held[int(key[0]), int(key[1])]) >= PACK:
                    yield flush(int(key[0]), int(key[1]), held.pop((int(key[0]), int(key[1]))))
        for (a, salt_), parts in held.items():
            yield flush(a, salt_, parts)

    def flush(a: int, salt_: int, parts: list) -> pa.RecordBatch:
        ids, second, x = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.lexsort([second, ids])
        cuts = range(0, len(ids), PACK)
        return pa.RecordBatch.from_pydict({"slab": [a] * len(cuts), "salt": [salt_] * len(cuts), "e_ids": [ids[order[i : i + PACK]].tobytes() for i in cuts], "e_codes": [second[order[i : i + PACK]].tobytes() for i in cuts], "e_vectors": [x[order[i : i + PACK]].tobytes() for i in cuts]}, pa.schema([("slab", pa.int32()), ("salt", pa.int32()), ("e_ids", pa.binary()), ("e_codes", pa.binary()), ("e_vectors", pa.binary())]))

    salts_of = lambda slab: F.element_at(F.array(*[F.lit(s) for s in salts]), F.col(slab) + 1)
    salt = F.pmod(F.xxhash64("vec_id"), salts_of("a")).cast("int")
    entries = indexed.withColumn("salt", salt).repartition("a", "salt").mapInArrow(lean(pack), "slab int, salt int, e_ids binary, e_codes binary, e_vectors binary")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, QUERY_PACK):
                b = whole.slice(at, QUERY_PACK)
                x, ids, own_rows = _vectors(b.column("embedding"), dim), b.column("vec_id").to_numpy(), b.column("own").to_numpy()
                mask = np.zeros((len(ids), *shape), bool)
                scores = x[:, :half] @ books[0].T, x[:, half:] @ books[1].T
                for q in range(len(ids)):
                    for i, j in visited((scores[0][q], scores[1][q]), sizes, max(visit * total, k + int(own_rows[q]))):
                        mask[q, i, j] = True
                # one row for each slab of which a query of the pack visits a cell
                for a in np.flatnonzero(mask.any((0, 2))):
                    own = np.flatnonzero(mask[:, a].any(1))
                    yield pa.RecordBatch.from_pydict({"slab": [int(a)], "q_ids": [ids[own].tobytes()], "q_masks": [mask[own, a].tobytes()], "q_vectors": [x[own].tobytes()]}, pa.schema([("slab", pa.int32()), ("q_ids", pa.binary()), ("q_masks", pa.binary()), ("q_vectors", pa.binary())]))

    # entries of the query's own id are in the cells too, and don't count towards its k
    own = F.count(F.lit(1)).over(Window.partitionBy("vec_id"))
    queries = indexed.where(F.col("vec_id") % every == 0).select("vec_id", "embedding", own.alias("own")).dropDuplicates(["vec_id", "embedding"])
    probes = queries.mapInArrow(lean(probe), "slab int, q_ids binary, q_masks binary, q_vectors binary")
    # a slab's entries are dealt over its salts, so each of them gets the pack
    probes = probes.withColumn("salt", F.explode(F.sequence(F.lit(0), salts_of("slab") - 1)))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for q_ids, q_masks, q_vectors, e_ids, e_codes, e_vectors in zip(*[b.column(c).to_pylist() for c in ("q_ids", "q_masks", "q_vectors", "e_ids", "e_codes", "e_vectors")], strict=True):
                q, e = np.frombuffer(q_ids, np.int64), np.frombuffer(e_ids, np.int64)
                x, y = np.frombuffer(q_vectors).reshape(-1, dim), np.frombuffer(e_vectors).reshape(-1, dim)
                open_ = np.frombuffer(q_masks, bool).reshape(len(q), shape[1])[:, np.frombuffer(e_codes, np.int32)] & (q[:, None] != e)
                rough = np.where(open_, np.round(x @ y.T, 12), -np.inf)
                top = np.argsort(-rough, 1, kind="stable")[:, :k]
                score = (x[:, None, :] * y[top]).astype(np.longdouble).sum(2).astype(float)
                valid = np.take_along_axis(rough, top, 1) > -np.inf
                for i, own in enumerate(q.tolist()):
                    ids, found = e[top[i][valid[i]]], score[i][valid[i]]
                    if own in best:
                        ids, found = np.concatenate([best[own][0], ids]), np.concatenate([best[own][1], found])
                    order = np.lexsort([ids, -found])[:k]
                    best[own] = ids[order], found[order]
            if len(best) > 50_000:
                yield out(best)
                best = {}
        if best:
            yield out(best)

    def out(best: dict) -> pa.RecordBatch:
        own = np.repeat(np.array([*best], np.int64), [len(v[0]) for v in best.values()])
        return pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.concatenate([v[0] for v in best.values()])), pa.array(np.concatenate([v[1] for v in best.values()]))], ["query_id", "vec_id", "score"])

    found = probes.join(entries, ["slab", "salt"]).mapInArrow(lean(rank), "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
