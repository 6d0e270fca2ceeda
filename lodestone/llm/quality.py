"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over byte n-grams of ORDER bytes of lower-cased text. Counts of all trusted documents are
kept sharded by n-gram; discounts, continuation counts and interpolated probabilities of every order come
from joins of the count tables on contexts and suffixes, lowest order first. The n-grams of all
documents, counted once, are joined with them, so each distinct n-gram gets its probability, seen or not.

A document's perplexity sums over its n-grams. The most frequent ones (at most TABLE) are looked up in a
broadcast table; occurrences of all others leave as rows and are joined with the sharded table. A document
is kept if its perplexity is at most a quantile of the trusted documents of its language.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .commonest import commonest
from .members import bitmaps, only
from .textbytes import LOWER, lean, mix, slices

ORDER = 5
TABLE = 1 << 19
_SLOTS = 21


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of every run of ORDER bytes; earlier bytes stand in higher bits."""
    n = len(data) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = LOWER[data].astype(np.int64)
    value = np.zeros(n, np.int64)
    for k in range(ORDER):
        value = value << 8 | low[k : k + n]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    inside = np.arange(n) + ORDER <= offsets[1:][row]
    return row[inside], value[inside]


def gram_counts(docs: DataFrame, before: Callable = iter) -> DataFrame:
    """gram long, n long over all texts, or those that `before` leaves of batches with doc_id (it runs inside the same tasks, so that no second worker is needed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for _, data, offsets in slices(before(batches), most=1 << 18):
            own, n = np.unique(grams(data, offsets)[1], return_counts=True)
            both, total = np.concatenate([gram, own]), np.concatenate([times, n])
            gram, at = np.unique(both, return_inverse=True)
            times = np.bincount(at, total, len(gram)).astype(np.int64)
            if len(gram) > 1 << 19:
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(times)], ["gram", "n"])
                gram, times = gram[:0], times[:0]
        yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(times)], ["gram", "n"])

    return docs.select("text", *["doc_id"] * (before is not iter)).mapInArrow(lean(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> list[float]:
    """Discounts of counts 1, 2 and 3 or more, from how many n-grams have counts 1 to 4."""
    r = counts.agg(*[F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in range(1, 5)]).first()
    n = [r[f"n{k}"] for k in range(1, 5)]
    if not n[0] or not n[1]:
        return [0.5, 0.5, 0.5]
    y = n[0] / (n[0] + 2 * n[1])
    found = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1] if n[1] else 1.0, 3 - 4 * y * n[3] / n[2] if n[2] else 1.5]
    return [min(max(d, 0.01), k + 0.99) for k, d in enumerate(found)]


def model(trusted: DataFrame, before: Callable = iter) -> list[tuple[DataFrame, DataFrame]]:
    """For orders 1 to ORDER: (gram, p) of the seen n-grams and (context, back) of the seen contexts."""
    counts = {ORDER: cut(gram_counts(trusted, before))}
    for k in range(ORDER - 1, 0, -1):
        # how many different bytes stand before each shorter n-gram
        counts[k] = cut(counts[k + 1].groupBy(F.col("gram").bitwiseAND((1 << 8 * k) - 1).alias("gram")).agg(F.count(F.lit(1)).alias("n")))
    tables: list[tuple[DataFrame, DataFrame]] = []
    for k in range(1, ORDER + 1):
        d1, d2, d3 = _discounts(counts[k])
        n = F.col("n")
        discount = F.when(n == 1, d1).when(n == 2, d2).otherwise(d3)
        context = F.shiftright("gram", 8).alias("context")
        about = counts[k].groupBy(context).agg(F.sum("n").alias("total"), F.sum(discount).alias("taken"))
        backs = cut(about.select("context", "total", (F.col("taken") / F.col("total")).alias("back")))
        seen = counts[k].select("gram", context, (n - discount).alias("rest")).join(backs, "context")
        if k == 1:
            p = F.col("rest") / F.col("total") + F.col("back") / 256
            table = seen.select("gram", p.alias("p"))
        else:
            shorter = tables[-1][0].select(F.col("gram").alias("suffix"), F.col("p").alias("lower"))
            joined = seen.withColumn("suffix", F.col("gram").bitwiseAND((1 << 8 * (k - 1)) - 1)).join(shorter, "suffix")
            table = joined.select("gram", (F.col("rest") / F.col("total") + F.col("back") * F.col("lower")).alias("p"))
        tables.append((cut(table), backs.select("context", "back")))
    return tables


def probabilities(wanted: DataFrame, tables: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """wanted (gram, n) with logp: of seen n-grams as they are; others by backing off through seen contexts."""
    empty = F.lit(1 / 256)
    out = wanted.withColumn("p", F.lit(None).cast("double")).withColumn("weight", F.lit(1.0))
    for k in range(ORDER, 0, -1):
        table, backs = tables[k - 1]
        own = F.col("gram").bitwiseAND((1 << 8 * k) - 1)
        out = out.withColumn("own", own).withColumn("context", F.shiftright("own", 8))
        out = out.join(table.select(F.col("gram").alias("own"), F.col("p").alias("found")), "own", "left").join(backs, "context", "left")
        hit = F.col("p").isNull() & F.col("found").isNotNull()
        out = out.select("gram", "n", F.when(hit, F.col("weight") * F.col("found")).otherwise(F.col("p")).alias("p"), F.when(F.col("p").isNull() & ~hit, F.col("weight") * F.coalesce("back", F.lit(1.0))).otherwise(F.col("weight")).alias("weight"))
    return out.select("gram", "n", F.log(F.coalesce("p", F.col("weight") * empty)).alias("logp"))


def slot_of(gram: np.ndarray, level: int) -> np.ndarray:
    return (mix(gram.astype(np.uint64) + np.uint64(level)) >> np.uint64(64 - _SLOTS)).astype(np.int64)


def levels(keys: np.ndarray, values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hash tables of one key a slot; a key that finds its slot taken stands in the next table."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    while len(keys) or not out:
        table, value = np.full(1 << _SLOTS, -1, np.int64), np.zeros(1 << _SLOTS, np.float32)
        at, first = np.unique(slot_of(keys, len(out)), return_index=True)
        table[at], value[at] = keys[first], values[first]
        out.append((table, value))
        left = np.ones(len(keys), bool)
        left[first] = False
        keys, values = keys[left], values[left]
    return out


def perplexities(docs: DataFrame, trusted: DataFrame, before: Callable = iter) -> DataFrame:
    """doc_id, perplexity of every row with an id and ORDER bytes of text; rows of one id are one document."""
    logs = cut(probabilities(gram_counts(docs), model(trusted, before)))
    shared = docs.sparkSession.sparkContext.broadcast(commonest(logs, {"gram": "int64", "logp": "float32"}, TABLE))
    empty = pa.array([], pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = levels(*shared.value)
        for rows, data, offsets in slices(batches, most=1 << 18):
            row, gram = grams(data, offsets)
            total, n = np.zeros(rows.num_rows), np.zeros(rows.num_rows, np.int64)
            for level, (table, value) in enumerate(tables):
                slot = slot_of(gram, level)
                hit = table[slot] == gram
                total += np.bincount(row[hit], value[slot[hit]], rows.num_rows)
                n += np.bincount(row[hit], minlength=rows.num_rows)
                row, gram = row[~hit], gram[~hit]
            ids = rows.column("doc_id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(total), pa.array(n)], ["doc_id", "gram", "sum", "n"])
            order = np.lexsort([gram, row])
            row, gram = row[order], gram[order]
            new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])])[: len(row)])
            times = np.diff(np.append(new, len(row)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[row[new]]) if len(new) else empty, pa.array(gram[new]), pa.array(np.zeros(len(new))), pa.array(times)], ["doc_id", "gram", "sum", "n"])

    parts = cut(docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(lean(run), "doc_id long, gram long, sum double, n long"))
    joined = parts.where("gram is not null").select("doc_id", "gram", "n").join(logs.select("gram", "logp"), "gram").select("doc_id", (F.col("logp") * F.col("n")).alias("sum"), "n")
    sums = parts.where("gram is null").select("doc_id", "sum", "n").union(joined).groupBy("doc_id").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n"))
    return sums.where("n > 0").select("doc_id", F.exp(-F.col("sum") / F.col("n")).alias("perplexity"))


def quality_report(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, slack: float = 1.25, folds: int = 5) -> DataFrame:
    """doc_id, lang, perplexity, threshold, keep for every document.

    One in `folds` trusted documents (labels.quality = 1, by crc32 of the id) is left out of training; their
    quantile in each language, times `slack`, is the threshold, or that of all of them where a language has
    none. Texts of fewer than ORDER bytes, and null texts, have no perplexity and are kept. With no trusted
    text nothing is rejected. A null language is one of its own.
    """
    docs = docs.select("doc_id", "text", "lang")
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("t_id"), (F.crc32(F.col("doc_id").cast("string")) % folds == 0).alias("left_out")).distinct()
    learnt = good.where("not left_out").select(F.col("t_id").cast("long").alias("doc_id"))
    trusted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = bitmaps(trusted.select("doc_id"), learnt)
    if found is None:
        trusted, among = trusted.join(learnt.distinct(), "doc_id", "left_semi"), iter
    else:
        among = only(found, "doc_id")
    scored = cut(docs.select("doc_id", "lang").join(perplexities(docs, trusted, among), "doc_id", "left"))
    known = scored.join(good.where("left_out"), scored["doc_id"] == good["t_id"]).where("perplexity is not null")
    of_all = known.agg(F.percentile_approx("perplexity", quantile, 10000).alias("q")).first()["q"]
    own = known.groupBy(F.col("lang").alias("l")).agg(F.percentile_approx("perplexity", quantile, 10000).alias("q"))
    joined = scored.join(own, scored["lang"].eqNullSafe(own["l"]), "left")
    threshold = F.coalesce("q", F.lit(of_all).cast("double")) * slack
    return joined.select("doc_id", "lang", "perplexity", threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= threshold, F.lit(True)).alias("keep"))
