"""Deterministic unit vectors of texts, for runs without a model."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(text: str | None, dimension: int) -> list[float]:
    """Digests of the text and a counter, read as signed 32-bit integers and scaled to length 1; a null text is an empty one."""
    raw = b"".join(hashlib.sha256(f"{text or ''}:{k}".encode()).digest() for k in range(-(-dimension // 8)))
    v = np.frombuffer(raw, "<i4")[:dimension] / 2**31
    return (v / (float(np.sqrt((v * v).sum())) or 1.0)).tolist()


def embedded(text: Column, dimension: int = 64) -> Column:
    """One vector a text, in Arrow batches; the order of rows is kept."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: vector(t, dimension))

    return run(text)
