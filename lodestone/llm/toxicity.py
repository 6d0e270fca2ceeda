"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct n-grams of 3 to 6 bytes of its lower-cased UTF-8, hashed to 2**20
buckets, and once more those that it repeats twice or four times. A bounded sample of labelled rows
(`max_per_class` rows, `max_bytes` bytes) gives each bucket's log-count ratio, from counts that Spark sums; the
buckets with the largest chi-square are kept, scaled by that ratio, and weighed by a logistic
regression whose weights are then drawn towards their mean, as in NB-SVM. Only the kept buckets
and their weights (at most `max_features` pairs) go to the scoring tasks; every whole text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .textbytes import LOWER, lean, slices

SIZES = (3, 4, 5, 6)
BITS = 20
REPEATS = (2, 4)
CHUNK = 1 << 18
WIDTH = (max(REPEATS) + 1) << BITS


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: the place of every n-gram inside a row, and its bucket."""
    low = LOWER[data].astype(np.uint64)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    value = np.zeros(len(data), np.uint64)
    for n in range(1, max(SIZES) + 1):
        shifted = np.zeros(len(data), np.uint64)
        shifted[: len(data) - n + 1] = low[n - 1 :]
        value = value | (shifted << np.uint64(8 * (n - 1)))
        if n in SIZES:
            at = np.flatnonzero(left >= n)
            bucket = ((value[at] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
            yield at, bucket.astype(np.int64)


def row_features(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and buckets of all distinct (row, bucket) pairs; only of wanted n-grams, if given. One long row is counted chunk by chunk."""
    if len(offsets) == 2 and len(data) > CHUNK:
        counts = np.zeros(1 << BITS, np.int64)
        for at in range(0, len(data), CHUNK):
            part = data[at : at + CHUNK + max(SIZES) - 1]
            for place, bucket in grams(part, np.array([0, len(part)])):
                counts += np.bincount(bucket[place < CHUNK], minlength=1 << BITS)
        bucket = np.flatnonzero(counts if wanted is None else np.where(wanted, counts, 0))
        row, times = np.zeros(len(bucket), np.int64), counts[bucket]
    else:
        found = []
        for at, bucket in grams(data, offsets):
            if wanted is not None:
                hit = np.flatnonzero(wanted[bucket])
                at, bucket = at[hit], bucket[hit]
            row = np.searchsorted(offsets, at, "right") - 1
            found.append((row << BITS) | bucket)
        keys, times = np.unique(np.concatenate(found), return_counts=True)
        row, bucket = keys >> BITS, keys & ((1 << BITS) - 1)
    # an n-gram that a text repeats also counts as features of its own, one for each of these times
    more = [(row[times >= k], (k << BITS) | bucket[times >= k]) for k in REPEATS]
    return np.concatenate([row, *[r for r, _ in more]]), np.concatenate([bucket, *[b for _, b in more]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows of each class have each bucket."""
    counts = np.zeros((2, WIDTH), np.int32)
    for rows, data, offsets in slices(batches, most=CHUNK):
        row, bucket = row_features(data, offsets)
        toxic = rows.column("label").to_numpy()[row] == 1
        for k in (0, 1):
            np.add.at(counts[k], bucket[toxic == k], 1)
    for at in range(0, WIDTH, 1 << 18):
        part = counts[:, at : at + (1 << 18)]
        some = np.flatnonzero(part.any(0))
        yield pa.RecordBatch.from_arrays([pa.array((at + some).astype(np.int32)), pa.array(part[1, some]), pa.array(part[0, some])], ["bucket", "pos", "neg"])


def choose(counts: DataFrame, n_pos: int, n_neg: int, max_features: int, smoothing: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of largest chi-square (over 4, in 3 rows at least) in order, and their log-count ratios."""
    pos, neg, both = F.col("pos"), F.col("neg"), F.col("pos") + F.col("neg")
    expected = both * (n_pos / (n_pos + n_neg))
    chi = (pos - expected) ** 2 / F.greatest(expected * (1 - both / (n_pos + n_neg + 1)), F.lit(1e-9))
    rate = F.log((pos + smoothing) / (n_pos + 2 * smoothing)) - F.log((neg + smoothing) / (n_neg + 2 * smoothing))
    best = counts.where(both >= 3).select("bucket", chi.alias("chi"), rate.alias("rate")).where("chi > 4").orderBy(F.desc("chi"), "bucket").limit(max_features).collect()
    best.sort(key=lambda r: r["bucket"])
    return np.array([r["bucket"] for r in best], np.int64), np.array([r["rate"] for r in best], float)


def fit_rows(features: list[np.ndarray], y: np.ndarray, rate: np.ndarray, ridge: float = 1e-3, rounds: int = 300, mean_share: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on features (each row's places in `rate`) scaled by `rate`; both classes have rows."""
    # rows in blocks of bounded features
    blocks, first, size = [], 0, 0
    for i, f in enumerate([*features, None]):
        if f is None or size + len(f) > CHUNK and size:
            own = features[first:i]
            blocks.append((first, i, np.concatenate(own).astype(np.int32), np.repeat(np.arange(i - first, dtype=np.int32), [len(x) for x in own])))
            first, size = i, 0
        size += 0 if f is None else len(f)
    # both classes weigh the same, however few rows are of one
    share = np.where(y == 1, 0.5 / max(1, int((y == 1).sum())), 0.5 / max(1, int((y == 0).sum())))
    w, b, m_w, m_b, v_w, v_b = np.zeros(len(rate)), 0.0, 0.0, 0.0, 0.0, 0.0
    for step in range(1, rounds + 1):
        scaled, g_w, g_b = w * rate, np.zeros(len(rate)), 0.0
        for lo, hi, col, row in blocks:
            z = np.bincount(row, scaled[col], hi - lo) + b
            error = share[lo:hi] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[lo:hi])
            g_w += np.bincount(col, error[row], len(rate))
            g_b += error.sum()
        g_w = g_w * rate + ridge * w
        m_w, m_b, v_w, v_b = 0.9 * m_w + 0.1 * g_w, 0.9 * m_b + 0.1 * g_b, 0.99 * v_w + 0.01 * g_w**2, 0.99 * v_b + 0.01 * g_b**2
        rate_step = 0.05 / (1 - 0.9**step)
        w = w - rate_step * m_w / (np.sqrt(v_w / (1 - 0.99**step)) + 1e-8)
        b = b - rate_step * m_b / (np.sqrt(v_b / (1 - 0.99**step)) + 1e-8)
    return ((1 - mean_share) * w + mean_share * np.abs(w).mean()) * rate, b


def sample_of(docs: DataFrame, known: DataFrame, max_per_class: int, max_row_bytes: int, max_bytes: int) -> tuple[DataFrame, dict[int, int]]:
    """The labelled sample (label, text), and how many rows each label has in all.

    Of each class: the first `max_per_class` different (id, text) pairs in hash order, of at most `max_row_bytes`
    each and `max_bytes` together. Only ids and hashes are shuffled to find it.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    different = rows.groupBy("doc_id", "h").agg(F.min("size").alias("size"), F.count(F.lit(1)).alias("n"))
    pairs = cut(different.join(known, F.col("doc_id") == F.col("l_id")).select("doc_id", "h", "size", "n", "label").where("label in (0, 1)"))
    n = {r["label"]: r["n"] for r in pairs.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    picked: list[tuple[int, int, int]] = []
    for k in (0, 1):
        room = max_bytes
        first = pairs.where((F.col("label") == k) & (F.col("size") <= max_row_bytes)).orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(max_per_class)
        for r in first.collect():
            room -= r["size"]
            if room < 0:
                break
            picked.append((r["doc_id"], r["h"], k))
    wanted = F.broadcast(docs.sparkSession.createDataFrame(picked, "s_id long, s_h long, label int"))
    found = docs.select("doc_id", "text").join(wanted, (F.col("doc_id") == F.col("s_id")) & (F.xxhash64("text") == F.col("s_h")))
    return cut(found.groupBy("s_id", "s_h", "label").agg(F.first("text").alias("text")).select("label", "text")), n


def fit(docs: DataFrame, known: DataFrame, max_per_class: int = 3000, max_features: int = 20000, max_row_bytes: int = 1 << 18, max_bytes: int = 1 << 25) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets, weights and bias from docs (doc_id, text) and known (l_id, label 0 or 1, one row an id).

    Buckets are counted and chosen by Spark; the one task that fits the weights gets the chosen buckets of the
    sample only. With one class only, or no rows, no bucket has weight and the bias gives the share of label 1.
    """
    nothing = np.zeros(0, np.int64), np.zeros(0)
    sample, n = sample_of(docs, known, max_per_class, max_row_bytes, max_bytes)
    if not n:
        return *nothing, 0.0
    prior = min(max(n.get(1, 0) / sum(n.values()), 1e-4), 1 - 1e-4)
    bias = float(np.log(prior / (1 - prior)))
    held = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(held) < 2:
        return *nothing, bias
    counts = sample.coalesce(4).mapInArrow(lean(_count), "bucket int, pos int, neg int").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    buckets, rate = choose(counts, held[1], held[0], max_features)
    if not len(buckets):
        return *nothing, bias

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, wanted = np.full(WIDTH, -1, np.int32), np.zeros(1 << BITS, bool)
        place[buckets], wanted[buckets & ((1 << BITS) - 1)] = np.arange(len(buckets)), True
        for rows, data, offsets in slices(batches, most=CHUNK):
            row, bucket = row_features(data, offsets, wanted)
            row, at = row[place[bucket] >= 0], place[bucket][place[bucket] >= 0]
            order = np.argsort(row, kind="stable")
            parts = np.split(at[order], np.searchsorted(row[order], np.arange(1, rows.num_rows)))
            yield pa.RecordBatch.from_arrays([rows.column("label"), pa.array([p.tobytes() for p in parts], pa.binary())], ["label", "features"])

    def in_one_task(rows: pd.DataFrame) -> pd.DataFrame:
        weights, bias = fit_rows([np.frombuffer(f, np.int32) for f in rows["features"]], rows["label"].to_numpy(), rate)
        return pd.DataFrame({"weights": [weights.tobytes()], "bias": [bias]})

    # at most max_features buckets of each row of the bounded sample
    fitted = sample.mapInArrow(lean(extract), "label int, features binary").groupBy().applyInPandas(in_one_task, "weights binary, bias double").first()
    return buckets, np.frombuffer(fitted["weights"]), fitted["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], keep: list[str]) -> DataFrame:
    """`keep` columns and toxicity double (0 to 1) of every row; null and empty texts get the bias alone."""
    buckets, weights, bias = model
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((buckets, weights, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, weights, bias = shared.value
        table, wanted = np.zeros(WIDTH), np.zeros(1 << BITS, bool)
        table[buckets], wanted[buckets & ((1 << BITS) - 1)] = weights, True
        for rows, data, offsets in slices(batches):
            row, bucket = row_features(data, offsets, wanted)
            z = np.bincount(row, table[bucket], rows.num_rows) + bias
            p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in keep], pa.array(p, pa.float64())], [*keep, "toxicity"])

    schema = docs.select(*keep).schema.add("toxicity", "double")
    return docs.select(*keep, *([] if "text" in keep else ["text"])).mapInArrow(lean(run), schema)


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """The model of the labelled documents that are not held out. Ids labelled twice count once, as toxic if any row says so."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    return fit(docs, known.groupBy(F.col("doc_id").alias("l_id")).agg(F.max("toxic").cast("int").alias("label")))


def toxicity_report(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; a null doc_id is not held out."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels), ["doc_id"])
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents whose score is under the threshold, with all their columns."""
    packed = docs.select("text", F.struct(*[c for c in docs.columns if c != "text"]).alias("rest_"))
    kept = score(packed, train(docs, labels), ["rest_", "text"]).where(F.col("toxicity") < threshold)
    return kept.select(*[F.col("text") if c == "text" else F.col("rest_").getField(c).alias(c) for c in docs.columns])
