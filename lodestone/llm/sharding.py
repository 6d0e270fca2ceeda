"""Sharding along a Hilbert curve, with DataFrame functions only.

Several metadata dimensions are quantised to a few bits each, the Hilbert index of the cell is
computed with Skilling's transform inside one `aggregate` expression, rows are range-partitioned and
sorted by (index, id, checksum), and the sorted order is cut into runs of equal length. Rows of one
run share narrow ranges in every dimension, so min/max statistics of a shard's files prune them.

Only the keys are shuffled, never the texts. A cell that holds a third of all rows is no hot group:
range bounds fall inside the cell, on the id. Positions come from per-partition counts, so no task
sees more than its own range. The bounds of a quantised number are at most 2**bits - 1 percentiles.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

LOCAL_BITS = 33  # monotonically_increasing_id() keeps the row's place in its partition in these bits


def bucket_of(value: Column, bounds: Sequence[float]) -> Column:
    """How many bounds are at or under the value; null values fall into bucket 0."""
    if not bounds:
        return F.lit(0).cast("long")
    edges = F.array(*[F.lit(b) for b in bounds])
    return F.coalesce(F.size(F.filter(edges, lambda b: b <= value)), F.lit(0)).cast("long")


def hashed(value: Column, bits: int) -> Column:
    """A category's cell: equal values share it, nulls have one of their own kind."""
    return F.pmod(F.xxhash64(value), F.lit(1 << bits))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hilbert_index(cells: Sequence[Column], bits: int) -> Column:
    """The place on the Hilbert curve of a cell given by one coordinate of `bits` bits per dimension."""
    n = len(cells)
    if n * bits > 62 or bits < 2:
        raise ValueError("two bits a dimension at least, and dimensions * bits <= 62")
    zero = F.lit(0).cast("long")
    planes = range(bits - 1, 0, -1)
    steps = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i")) for b in planes for i in range(n)])

    def undo(x: Column, s: Column) -> Column:
        first, own = F.get(x, F.lit(0)), F.get(x, s["i"])
        hit = own.bitwiseAND(s["q"]) != 0
        change = F.when(hit, s["q"] - 1).otherwise(first.bitwiseXOR(own).bitwiseAND(s["q"] - 1))
        # bit planes above the current one: swap the low bits with axis 0, or flip those of axis 0
        return _let(
            F.struct(change.alias("c"), hit.alias("h")),
            lambda t: F.transform(x, lambda v, k: F.when((k == 0) & (t["h"] | (s["i"] != 0)), v.bitwiseXOR(t["c"])).when((k == s["i"]) & ~t["h"], F.when(k == 0, v).otherwise(v.bitwiseXOR(t["c"]))).otherwise(v)),
        )

    def gray(x: Column) -> Column:
        return F.transform(x, lambda v, k: F.aggregate(F.slice(x, F.lit(1), k + 1), zero, lambda a, b: a.bitwiseXOR(b)))

    def flip(g: Column) -> Column:
        masks = F.array(*[F.lit(1 << b).cast("long") for b in planes])
        last = F.get(g, F.lit(n - 1))
        turn = F.aggregate(masks, zero, lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
        return _let(turn, lambda t: F.transform(g, lambda v: v.bitwiseXOR(t)))

    def interleave(x: Column) -> Column:
        digits = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])
        return F.aggregate(digits, zero, lambda out, d: out * 2 + F.when(F.get(x, d["i"]).bitwiseAND(d["q"]) != 0, 1).otherwise(0))

    axes = F.array(*[c.cast("long") for c in cells])
    return _let(F.aggregate(steps, axes, undo), lambda x: _let(gray(x), lambda g: _let(flip(g), interleave)))


def hilbert_shards(
    rows: DataFrame,
    n_shards: int,
    numeric: Sequence[str],
    categories: Sequence[str],
    order: Sequence[str],
    keep: Sequence[str],
    bits: int = 6,
) -> DataFrame:
    """`keep` columns plus hilbert long, shard int and slot long (gapless from 0 in each shard).

    Shard sizes differ by one row at most. `order` breaks ties inside a cell; rows equal in the cell
    and in `order` may swap places among themselves. Nulls: a null number falls into the lowest
    bucket, a null category into one cell. Empty input gives no rows.
    """
    bounds = {c: [] for c in numeric}
    if numeric:
        marks = [i / (1 << bits) for i in range(1, 1 << bits)]
        first = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), marks, 2000).alias(f"p{i}") for i, c in enumerate(numeric)]).first()
        bounds = {c: sorted(set(first[f"p{i}"] or [])) for i, c in enumerate(numeric)}
    cells = [bucket_of(F.col(c).cast("double"), bounds[c]) for c in numeric] + [hashed(F.col(c), bits) for c in categories]
    names = list(dict.fromkeys([*keep, *order]))
    keyed = rows.select(*names, hilbert_index(cells, bits).alias("hilbert"))
    sort = ["hilbert", *order]
    placed = cut(keyed.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", LOCAL_BITS)
    runs = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    # one row for each partition of the sorted rows
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = runs.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(whole).alias("total"))
    place = F.col("offset") + F.col("at").bitwiseAND((1 << LOCAL_BITS) - 1)
    ranked = placed.withColumn("part", part).join(offsets, "part").withColumn("place", place)
    shard = F.expr(f"place * {n_shards} div total")
    start = F.expr(f"(shard * total + {n_shards - 1}) div {n_shards}")
    return ranked.withColumn("shard", shard).withColumn("slot", F.col("place") - start).select(*keep, "hilbert", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = 24, bits: int = 6) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, hilbert for every document.

    The dimensions are UTF-8 size, doc_id, language and source. The law is `rows`: counts of shards
    differ by one at most; grown_shard is therefore null. A null text has no bytes and checksum 0; an
    empty text likewise. Repeated rows each get a place. Extra columns are ignored.
    """
    keys = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
        F.col("lang"),
        F.col("source"),
    )
    placed = hilbert_shards(keys, n_shards, ["size", "doc_id"], ["lang", "source"], ["doc_id", "text_crc32", "size"], ["doc_id", "size", "text_crc32"], bits)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
