"""Filtered approximate vector search: sketches of signs tell which vectors are worth an exact score."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.views import chunk
from ..session import shared_dir, table
from .retrieval import clamped, dot, searched

#: Bits of a sketch, the share of the allowed vectors that is scored exactly, and how many for each one wanted at least.
BITS, SHARE, LEAST = 256, 0.15, 8
WORDS = [f"s{k}" for k in range(BITS // 64)]


def planes(dimension: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dimension, BITS))


def sketched(vector: Column) -> Column:
    """The sides of random hyperplanes on which a vector lies, as four long numbers; null for no vector."""

    @F.pandas_udf(", ".join(f"{w} long" for w in WORDS))
    def run(vectors: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame(0, index=vectors.index, columns=WORDS, dtype="int64")
        for n, rows in vectors.dropna().groupby(vectors.dropna().map(len)):
            if n:
                sides = np.stack(rows.to_list()).astype(float) @ planes(n) > 0
                out.loc[rows.index] = np.packbits(sides, axis=1).view(">i8").astype("int64")
        return out

    return run(vector)


def build(chunks: DataFrame, folder: str) -> None:
    """Chunks (chunk_id, doc_id, tenant_id, embedding) with their sketches, by tenant."""
    chunks.where("embedding IS NOT NULL").withColumn("s", sketched(F.col("embedding"))).select("*", "s.*").drop("s").write.partitionBy("tenant_id").parquet(folder)


def candidates(index: DataFrame, docs: DataFrame, probe: DataFrame, k: int, share: float = SHARE) -> DataFrame:
    """The allowed chunks whose sketches differ least from the probe's (one row, q): about `share` of them, LEAST * k at least, and all ties."""
    near = index.join(docs.select("doc_id", "tenant_id"), ["doc_id", "tenant_id"], "left_semi")
    q = probe.select("q", sketched(F.col("q")).alias("p"))
    apart = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"p.{w}"))) for w in WORDS), F.lit(0))
    measured = near.join(F.broadcast(q)).withColumn("apart", apart)
    bound = measured.agg(F.percentile_approx("apart", share, 10_000).alias("bound"))
    least = measured.select("apart").orderBy("apart").limit(LEAST * k).agg(F.max("apart").alias("least"))
    return measured.join(F.broadcast(bound)).join(F.broadcast(least)).where("apart <= greatest(bound, least)")  # one row each


def approximate(index: DataFrame, docs: DataFrame, probe: DataFrame, k: int, share: float = SHARE) -> DataFrame:
    """chunk_id, doc_id, score of the k nearest by cosine among the candidates, after the filters and before any rank."""
    q, e = F.col("q"), F.col("embedding")
    scored = candidates(index, docs, probe, k, share).select("chunk_id", "doc_id", F.round(dot(e, q) / F.sqrt(dot(e, e) * dot(q, q)), 4).alias("score"))
    return scored.orderBy(F.desc("score"), "chunk_id").limit(clamped(k))


@query("approximate_search")
def approximate_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten chunks nearest to vector 0 that the caller of `search` may see, by sketches."""
    folder = f"{shared_dir(spark)}/sketches-{uuid.uuid4()}"
    build(chunk(spark, sf_dir), folder)
    probe = table(spark, sf_dir, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))
    return approximate(spark.read.parquet(folder), searched(spark, sf_dir), probe, 10)
