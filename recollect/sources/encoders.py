"""Encoders as slots: texts to vectors, with what comes back checked (SRC9).

No weights come with the engine; the default encoder hashes words, so equal words give equal vectors and nothing more.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], list[list[float]]]


def hashing_encoder(size: int) -> Encoder:
    """Each word adds a direction that its hash chooses; vectors have length one, that of no words is all zeros."""

    def encode(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(size)
            for w in t.lower().split():
                v += np.random.default_rng(zlib.crc32(w.encode())).normal(size=size)
            length = math.sqrt(float(v @ v))
            out.append((v / length if length else v).tolist())
        return out

    return encode


def encoded(df: DataFrame, text: str, encoder: Encoder, name: str = "vector") -> DataFrame:
    """``df`` with the vectors of a column, in batches."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(encoder(texts.fillna("").tolist()), index=texts.index)

    return df.withColumn(name, run(F.col(text)))


def sound(vector: Column, size: int) -> Column:
    """Whether a vector has the right length and only finite numbers."""
    return F.coalesce((F.size(vector) == size) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def half(vector: Column) -> Column:
    """Vectors as 16-bit floating point stores them (VEC10)."""

    @F.pandas_udf("array<float>")
    def run(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else np.asarray(v, np.float16).astype(np.float32).tolist())

    return run(vector)
