"""Mixing sources to target weights by capped water-filling.

Each source gets a share of the budget in proportion to its weight; a share above the allowed epochs
is clamped there and the excess goes to the others, again by weight, until no source is above. A
target is then met by whole repetitions of every document plus one seeded fractional repetition.

The fractional repetition takes documents in the order of a seeded hash. The hash is cut into leaves,
leaf sums are added up per source, and only the one group of leaves in which the running sum crosses
the target is looked at row by row: it is streamed in hash order and takes each document that still
fits. All other groups are taken or left whole, so a hot source never meets in one task. What is then
left of the target is filled from the groups behind in the same way, with the documents that can still
fit, until none can or under a thousandth of the target is left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WORD = r"[^\x20\x09-\x0D]+"
LEAVES = 1 << 14
ROWS_A_GROUP = 1000
#: Rounds of filling at most (sizes that fall in small steps could take many), and the share of a target that needs no more.
ROUNDS, NEAR = 16, 0.001


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(weights: list[Fraction], caps: list[Fraction], budget: Fraction) -> list[Fraction]:
    """Shares of the budget by weight, none above its cap; the excess is dealt anew by weight."""
    shares, open_ = [Fraction(0)] * len(caps), set(range(len(caps)))
    left = min(budget, sum(caps, Fraction(0)))
    while open_ and left > 0:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] > caps[i] * total]
        if not over:
            for i in open_:
                shares[i] = left * weights[i] / total
            break
        for i in over:
            shares[i] = caps[i]
            open_.discard(i)
        left = min(budget, sum(caps, Fraction(0))) - sum(shares)
    return shares


def cycling(*weights: int) -> Callable[[int, str | None], int]:
    """Weights by the source's place in code point order, repeating."""
    return lambda place, source: weights[place % len(weights)]


def _fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a crossing group come together and in hash order; take what still fits."""
    key, gap = None, 0.0
    for rows in batches:
        picked = []
        for source, part, gap_at_start, size in zip(rows["p_no"], rows["part"], rows["gap"], rows["size"], strict=True):
            if (source, part) != key:
                key, gap = (source, part), gap_at_start
            hit = size <= gap
            gap -= size if hit else 0
            picked.append(hit)
        yield rows.assign(extra=pd.Series(picked, index=rows.index, dtype="int64"))


def _left(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What crossing groups leave of their gaps, told once a group and batch at least; the least is the last."""
    key, gap = None, 0.0
    for rows in batches:
        left = {}
        for source, gap_at_start, size in zip(rows["p_no"], rows["gap"], rows["size"], strict=True):
            if source != key:
                key, gap = source, gap_at_start
            gap -= size if size <= gap else 0
            left[source] = gap
        yield pd.DataFrame({"p_no": [*left], "left": [*left.values()]})


def _filling(narrow: DataFrame, sources: list[tuple], seed: int) -> dict[int, list[tuple[float, int, int, float]]]:
    """For each source the rounds (limit, first, crossing, gap): documents of the limit's size at most are taken from
    group `first` up to group `crossing`, and there while they fit the gap.

    sources: (source, number, groups, what is left of the target, target). The driver holds a few numbers a source.
    """
    spark = narrow.sparkSession
    rounds: dict[int, list[tuple[float, int, int, float]]] = {s[1]: [] for s in sources}
    open_ = {no: (source, groups, rest, 0, rest, target) for source, no, groups, rest, target in sources if rest > 0}
    for _ in range(ROUNDS):
        if not open_:
            break
        state = spark.createDataFrame([(s, no, g, gap, first) for no, (s, g, gap, first, _, _) in open_.items()], "p_source string, p_no int, p_groups int, p_gap double, p_first int")
        rows = narrow.join(F.broadcast(state), F.col("source").eqNullSafe(F.col("p_source"))).select("p_no", "doc_id", "size", "p_gap", "p_first", F.expr(PART).alias("part"))
        upto = Window.partitionBy("p_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        sums = rows.where("part >= p_first AND size <= p_gap").groupBy("p_no", "part").agg(F.sum("size").alias("words"), F.first("p_gap").alias("p_gap"))
        gaps = sums.select("p_no", "part", "words", (F.col("p_gap") - F.coalesce(F.sum("words").over(upto), F.lit(0))).alias("gap")).where("words > gap")
        found = {r["p_no"]: r["c"] for r in gaps.groupBy("p_no").agg(F.min(F.struct("part", "gap")).alias("c")).collect()}
        for no in open_.keys() - found.keys():  # all that can fit does
            rounds[no].append((open_[no][2], open_[no][3], open_[no][1], 0.0))
        if not found:
            break
        cross = spark.createDataFrame([(no, c["part"], float(c["gap"])) for no, c in found.items()], "c_no int, c_part int, gap double")
        close = rows.join(F.broadcast(cross), (F.col("p_no") == F.col("c_no")) & (F.col("part") == F.col("c_part"))).select("p_no", "part", "doc_id", "size", "gap")
        left = {r["p_no"]: r["left"] for r in _in_order(close, seed).mapInPandas(_left, "p_no int, left double").groupBy("p_no").agg(F.min("left").alias("left")).collect()}
        nxt = {}
        for no, c in found.items():
            source, groups, gap, first, rest, target = open_[no]
            rounds[no].append((gap, first, c["part"], float(c["gap"])))
            if left[no] > NEAR * target and c["part"] + 1 < groups:
                nxt[no] = (source, groups, left[no], c["part"] + 1, rest, target)
        open_ = nxt
    return rounds


def _in_order(rows: DataFrame, seed: int) -> DataFrame:
    """Each group's rows in one task, in the seeded order."""
    return rows.repartition("p_no", "part").sortWithinPartitions("p_no", "part", F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "size")


#: The group of a leaf.
PART = f"CAST(leaf * p_groups div {LEAVES} AS INT)"


def planned_copies(
    docs: DataFrame,
    weight_of: Callable[[int, str | None], int] = cycling(5, 2, 1),
    share: Fraction = Fraction(3, 2),
    max_epochs: Fraction = Fraction(2),
    seed: int = 20240601,
    max_sources: int = 1_000_000,
    size: Column | None = None,
) -> DataFrame:
    """Each row of docs as a struct `doc`, with mix_size, mix_source_size, mix_target and mix_copies.

    Sizes are words of the text, or `size`, a whole number, where docs hold it already. The list of sources is configuration: one weight each, held by the driver
    (`max_sources` guards that). Null sources count as one source, the last; null texts have size 0.
    Documents of size 0 are repeated as often as their source as a whole. Rows that repeat share one
    place in the seeded order and are taken one by one. An empty table gives no rows; a source whose
    texts are all empty has target 0.
    """
    spark = docs.sparkSession
    # the row travels as one struct, so that no column of it can clash with those made here
    sized = docs.select(
        F.struct(*docs.columns).alias("doc"),
        F.col("source"),
        F.col("doc_id"),
        (word_count(F.col("text")) if size is None else size).alias("size"),
        F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(LEAVES)).alias("leaf"),
    )
    narrow = cut(sized.select("source", "doc_id", "size", "leaf"))
    totals = narrow.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")).limit(max_sources + 1).collect()
    if len(totals) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    caps = [Fraction(r["words"]) * max_epochs for r in totals]
    targets = water_fill([Fraction(weight_of(i, r["source"])) for i, r in enumerate(totals)], caps, Fraction(sum(r["words"] for r in totals)) * share)
    plan = []
    for i, (r, t) in enumerate(zip(totals, targets, strict=True)):
        whole = int(t // r["words"]) if r["words"] else 0
        plan.append((r["source"], i, r["words"], float(t), whole, float(t - whole * r["words"]), max(1, min(LEAVES, r["rows"] // ROWS_A_GROUP))))
    rounds = _filling(narrow, [(source, i, groups, rest, target) for source, i, _, target, _, rest, groups in plan], seed)
    sources = spark.createDataFrame(
        [(source, i, words, target, whole, groups, rounds[i]) for source, i, words, target, whole, _, groups in plan],
        "p_source string, p_no int, p_words long, p_target double, p_whole long, p_groups int, p_rounds array<struct<most: double, first: int, crossing: int, gap: double>>",
    )
    planned = sized.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("p_source"))).select("*", F.expr(PART).alias("part"))
    gap = F.get(F.filter("p_rounds", lambda r: r["crossing"] == F.col("part")), F.lit(0))["gap"]
    taken = F.exists("p_rounds", lambda r: (F.col("part") >= r["first"]) & (F.col("part") < r["crossing"]) & (F.col("size") <= r["most"]))
    planned = planned.withColumn("gap", gap).withColumn("extra", taken.cast("long")).drop("p_rounds")
    sure = planned.where("gap IS NULL")
    close = _in_order(planned.where("gap IS NOT NULL"), seed)
    result = sure.unionByName(close.mapInPandas(_fill, close.schema))
    copies = F.col("p_whole") + F.when(F.col("p_words") > 0, F.col("extra")).otherwise(F.lit(0))
    return result.select("doc", F.col("size").alias("mix_size"), F.col("p_words").alias("mix_source_size"), F.col("p_target").alias("mix_target"), copies.alias("mix_copies"))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """All columns of docs, plus mix_size, mix_source_size, mix_target and mix_copies; the settings are those of `planned_copies`."""
    return planned_copies(docs, **settings).select(*[F.col("doc").getField(c).alias(c) for c in docs.columns], "mix_size", "mix_source_size", "mix_target", "mix_copies")


def repeated(docs: DataFrame, **settings) -> DataFrame:
    """Each row of docs as often as the mix takes it, with its own columns, whatever their names."""
    rows = planned_copies(docs, **settings).where("mix_copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))))
    return rows.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    # texts are read for their sizes only, and don't travel
    mixed = mix(docs.select("doc_id", "source", word_count(F.col("text")).alias("words")), size=F.col("words"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))
