"""Jaro-Winkler similarity, which Spark lacks, for Arrow batches of string pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .shipping import ship


def similarity(a: str, b: str, boost: float = 0.1) -> float:
    """Jaro's share of matching characters, raised for a common beginning of up to four, from 0 to 1."""
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, first = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                first.append(c)
                break
    m = len(first)
    if not m:
        return 0.0
    second = [c for c, hit in zip(b, used, strict=True) if hit]
    moved = sum(x != y for x, y in zip(first, second, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    common = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + common * boost * (1 - jaro) if jaro > 0.7 else jaro


def jaro_winkler(a: Column | str, b: Column | str) -> Column:
    """Similarity of two columns; null if either is null."""

    def batch(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else similarity(p, q) for p, q in zip(x, y, strict=True)])

    ship(SparkSession.active())
    return F.pandas_udf(batch, "double")(a, b)
