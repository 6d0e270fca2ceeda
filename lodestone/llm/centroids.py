"""Lloyd's centroids by filtering: kd-trees of each partition's vectors, whose nodes are assigned whole where one centroid is left.

A node holds the number of its vectors, their sums and the box around them, all in integers. On the way down a
centroid goes as soon as another one is strictly nearer to every point of the box; leaves are resolved exactly,
so the result is that of comparing every vector with every centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .textbytes import lean

#: Vectors of one tree and of one leaf at most.
TREE, LEAF = 8192, 32
#: Components stay under this, so that no distance leaves 64 bits; products of those under SMALL are exact in doubles.
LIMIT, SMALL = 1 << 27, 1 << 20
_ROWS = "ids array<long>, points binary, nodes binary, low binary, high binary, sums binary"


def kept_vectors(vectors: DataFrame, size: int, id_name: str = "vec_id", vector_name: str = "embedding") -> DataFrame:
    """id, vector (doubles) of the rows with exactly `size` components, none of them null or non-finite."""
    vector = F.col(vector_name).cast("array<double>")
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.coalesce((F.size(vector_name) == size) & sound, F.lit(False))).select(F.col(id_name).cast("long").alias("id"), vector.alias("vector"))


def to_integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x); an error beyond LIMIT, where squared distances would leave 64 bits."""
    scaled = np.floor(vectors * float(scale))
    if scaled.size and not np.abs(scaled).max() < LIMIT:
        raise ArithmeticError(f"a component times {scale} is not under {LIMIT}")
    return scaled.astype(np.int64)


class Tree:
    """points in the order of the leaves; nodes: first and end of its points, left and right child (-1: leaf)."""

    def __init__(self, points: np.ndarray, nodes: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray) -> None:
        self.points, self.nodes, self.low, self.high, self.sums = points, nodes, low, high, sums

    @classmethod
    def of(cls, points: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
        """The tree and the place that each of its points had."""
        order = np.arange(len(points))
        nodes, low, high, sums = [], [], [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            here = points[order[a:b]]
            lo, hi = here.min(0), here.max(0)
            if parent >= 0:
                nodes[parent][side] = len(nodes)
            at = len(nodes)
            nodes.append([a, b, -1, -1])
            low.append(lo)
            high.append(hi)
            sums.append(here.sum(0))
            widest = int((hi - lo).argmax())
            if b - a > leaf and hi[widest] > lo[widest]:
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(here[:, widest], middle)]
                todo += [(a, a + middle, at, 2), (a + middle, b, at, 3)]
        return cls(points[order], np.array(nodes), np.array(low), np.array(high), np.array(sums)), order

    def assign(self, centroids: np.ndarray, parts: int = 512) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
        """Nodes assigned whole (node, centroid), and the points of undecided leaves with their centroids; ties go to the smaller number."""
        whole: list[tuple[int, int]] = []
        loose, masks = [], []
        front, alive = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
        while len(front):
            nxt, nxt_alive = [], []
            for k in range(0, len(front), parts):
                at = front[k : k + parts]
                left = self._undominated(at, alive[k : k + parts], centroids)
                one = left.sum(1) == 1
                whole += zip(at[one].tolist(), left[one].argmax(1).tolist(), strict=True)
                leaf = ~one & (self.nodes[at, 2] < 0)
                for node, mask in zip(at[leaf], left[leaf], strict=True):
                    a, b = self.nodes[node, :2]
                    loose.append(np.arange(a, b))
                    masks.append(np.broadcast_to(mask, (b - a, len(mask))))
                inner = ~one & ~leaf
                nxt += [self.nodes[at[inner], 2], self.nodes[at[inner], 3]]
                nxt_alive += [left[inner], left[inner]]
            front, alive = np.concatenate(nxt), np.concatenate(nxt_alive)
        if not loose:
            return whole, np.zeros(0, np.int64), np.zeros(0, np.int64)
        points = np.concatenate(loose)
        far = np.where(np.concatenate(masks), distances(self.points[points], centroids), np.iinfo(np.int64).max)
        return whole, points, far.argmin(1)

    def _undominated(self, at: np.ndarray, alive: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """The candidates that no point of a node's box is strictly farther from than from the one nearest its middle."""
        low, high = self.low[at], self.high[at]
        middle = (low + high) / 2
        near = (centroids.astype(float) ** 2).sum(1) - 2 * middle @ centroids.T.astype(float)
        best = centroids[np.where(alive, near, np.inf).argmin(1)]
        apart = centroids[None] - best[:, None]
        corner = np.where(apart > 0, high[:, None], low[:, None])
        return alive & ((apart * (centroids[None] + best[:, None] - 2 * corner)).sum(2) <= 0)


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points to all centroids; doubles hold the products of small components exactly."""
    if max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) < SMALL:
        p, c = points.astype(float), centroids.astype(float)
        return ((p**2).sum(1)[:, None] - 2 * p @ c.T + (c**2).sum(1)).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(1) for c in centroids], 1)


def _planted(vectors: DataFrame, scale: int, tree: int) -> DataFrame:
    """One row for each kd-tree, of at most `tree` vectors of a partition."""

    def rows(ids: list, points: np.ndarray) -> pa.RecordBatch:
        made, order = Tree.of(points)
        parts = [made.points.astype("<i4"), made.nodes.astype("<i4"), made.low.astype("<i4"), made.high.astype("<i4"), made.sums.astype("<i8")]
        return pa.RecordBatch.from_arrays([pa.array([[ids[k] for k in order.tolist()]], pa.list_(pa.int64())), *[pa.array([p.tobytes()], pa.binary()) for p in parts]], [c.split()[0] for c in _ROWS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        held: list[np.ndarray] = []
        for batch in batches:
            for k in range(0, batch.num_rows, tree):
                b = batch.slice(k, tree)
                if ids and len(ids) + b.num_rows > tree:
                    yield rows(ids, np.concatenate(held))
                    ids, held = [], []
                ids += b.column("id").to_pylist()
                held.append(to_integers(b.column("vector").flatten().to_numpy().reshape(b.num_rows, -1), scale))
        if ids:
            yield rows(ids, np.concatenate(held))

    return vectors.mapInArrow(lean(run), _ROWS)


def _trees(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, Tree]]:
    for batch in batches:
        for k in range(batch.num_rows):
            get = lambda name, kind: np.frombuffer(batch.column(name)[k].as_buffer(), kind).astype(np.int64)  # noqa: B023, E731
            shaped = lambda name, kind="<i4": get(name, kind).reshape(-1, size)  # noqa: B023, E731
            yield batch.column("ids")[k].as_py(), Tree(shaped("points"), get("nodes", "<i4").reshape(-1, 4), shaped("low"), shaped("high"), shaped("sums", "<i8"))


def _moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every non-empty centroid at the floor of its vectors' mean: sums of each task, added up by Spark."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, size + 1), np.int64)
        for _, tree in _trees(batches, size):
            whole, points, labels = tree.assign(centroids)
            for node, c in whole:
                total[c, :size] += tree.sums[node]
                total[c, size] += tree.nodes[node, 1] - tree.nodes[node, 0]
            for c in np.unique(labels):
                of = points[labels == c]
                total[c, :size] += tree.points[of].sum(0)
                total[c, size] += len(of)
        used = np.flatnonzero(total[:, size])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, size + 1), pa.int32()), pa.array(np.tile(np.arange(size + 1), len(used)), pa.int32()), pa.array(total[used].ravel())], ["cluster", "place", "total"])

    rows = trees.mapInArrow(lean(run), "cluster int, place int, total long").groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total")).collect()
    total = {(r["cluster"], r["place"]): int(r["total"]) for r in rows}  # centroids times components
    return np.array([[total[c, d] // total[c, size] for d in range(size)] if (c, size) in total else centroids[c] for c in range(k)], np.int64)


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, scale: int = 256, salt: str = "2:", tree: int = TREE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every row of `vectors` (vec_id, embedding) that takes part.

    Vectors of another length or with a null or non-finite component take no part; rows that share an id or a vector
    each count; a null id is kept and starts no centroid while others can. Fewer than k vectors make so many
    centroids, none gives no rows. A component of 2 ** 27 or more after scaling is an ArithmeticError, as its
    distances would not fit a long. Other columns are not read. The trees are kept in the checkpoint folder;
    only centroids, k times `size` numbers, come to the driver.
    """
    kept = kept_vectors(vectors, size)
    key = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    first = kept.orderBy(key.asc_nulls_last(), "vector").limit(k).select("vector").collect()
    spark = vectors.sparkSession
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = to_integers(np.array([r["vector"] for r in first]), scale)
    trees = cut(_planted(kept, scale, tree))
    for _ in range(rounds):
        centroids = _moved(trees, centroids)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, t in _trees(batches, size):
            whole, points, labels = t.assign(centroids)
            of = np.empty(len(ids), np.int64)
            of[points] = labels
            for node, c in whole:
                of[t.nodes[node, 0] : t.nodes[node, 1]] = c
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(of, pa.int32()), pa.array(((t.points - centroids[of]) ** 2).sum(1))], ["vec_id", "cluster", "distance"])

    rows = trees.mapInArrow(lean(assigned), "vec_id long, cluster int, distance long")
    own = {r["cluster"]: int(r["d"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()}  # k rows
    told = [(c, d, sum(own.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in own.items()]
    return rows.join(F.broadcast(spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
