"""Bounded uniform samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STEPS = 1 << 30


def bounded_sample(df: DataFrame, key: str, rows: int, total: int, spare: float = 2.0) -> DataFrame:
    """At most ``rows`` rows of ``df``, chosen by a hash of ``key``, the same ones in every run.

    With ``total`` rows (about) in the table, all but some ``spare * rows`` are left out before the rest is ordered, so
    that what tasks send for the choice is bounded in sum, however many tasks there are.
    """
    share = min(1.0, spare * rows / max(total, 1))
    if share < 1:
        df = df.filter(F.pmod(F.xxhash64(key), F.lit(_STEPS)) < int(share * _STEPS))
    return df.orderBy(F.xxhash64(key), key).limit(rows)
