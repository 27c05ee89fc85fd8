"""Vector expressions, and the deterministic embedder used where no model is at hand."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision; null if a component is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    # the length is bound once, not worked out anew for each component
    scaled = F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))
    return F.element_at(scaled, 1)


@F.pandas_udf(ArrayType(FloatType()))
def from_bytes(blobs: pd.Series) -> pd.Series:
    """Little-endian float32 bytes as an array; null for null or a length that isn't a multiple of four."""
    return blobs.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4"))


def unit_from_bytes(dimension: int):
    """Unit vectors of little-endian float32 bytes, a batch at once; null for null, another length, a zero or not finite vector."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def decode(blobs: pd.Series) -> pd.Series:
        right = np.array([b is not None and len(b) == 4 * dimension for b in blobs], bool)
        rows = np.frombuffer(b"".join(blobs[right]), "<f4").reshape(-1, dimension).astype(np.float64)
        with np.errstate(all="ignore"):
            length = np.sqrt((rows * rows).sum(1, keepdims=True))
            rows = rows / length
        out = np.full(len(blobs), None, object)
        for k, row, n in zip(np.flatnonzero(right), rows, length[:, 0], strict=True):
            out[k] = row if np.isfinite(n) and n > 0 else None
        return pd.Series(out)

    return decode


@lru_cache(maxsize=500_000)
def _bucket(word: str, size: int) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % size


def hashing_embedder(size: int):
    """Unit vector of word counts by hashed word. A stand-in for a model: deterministic, not semantic."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            v = np.zeros(size)
            for w in re.findall(r"\w+", (t or "").lower()):
                v[_bucket(w, size)] += 1
            n = np.sqrt((v * v).sum())
            out.append(v / n if n else v)
        return pd.Series(out)

    return embed
