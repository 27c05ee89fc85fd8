"""Vectors of texts from a model server, in batches."""

from __future__ import annotations

import json
import math
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

BATCH = 8
QUERY_SECONDS, BATCH_SECONDS = 30, 300


class Unavailable(ConnectionError):
    """The model server does not answer."""


def request(url: str, model: str, texts: list[str], seconds: float = BATCH_SECONDS) -> list[list[float]]:
    """Unit vectors of ``texts`` by one call; a zero vector stays zero."""
    body = json.dumps({"model": model, "input": texts}).encode()
    call = urllib.request.Request(url, body, {"Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(call, timeout=seconds) as answer:
            found = json.loads(answer.read())["embeddings"]
    except (OSError, ValueError, KeyError) as error:
        raise Unavailable(str(error)) from error
    if len(found) != len(texts):
        raise Unavailable("the server gave another number of vectors")
    out = []
    for v in found:
        n = math.sqrt(sum(x * x for x in v))
        out.append([x / n for x in v] if n else v)
    return out


def query_vector(url: str, model: str, text: str) -> list[float]:
    return request(url, model, [text], QUERY_SECONDS)[0]


def column_embedder(url: str, model: str, batch: int = BATCH) -> Callable[[str], Column]:
    """An embedder of a text column; null texts have null vectors, and each distinct text of a batch is sent once."""

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            distinct = list(dict.fromkeys(t for t in texts if t is not None))
            known: dict[str, list[float]] = {}
            for a in range(0, len(distinct), batch):
                own = distinct[a : a + batch]
                known |= dict(zip(own, request(url, model, own), strict=True))
            yield texts.map(lambda t: known.get(t))

    return embed
