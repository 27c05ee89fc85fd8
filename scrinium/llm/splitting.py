"""Problem 3: cut oversized texts at natural boundaries by recursive bisection."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2500
OVERLAP = 400

_SPACES = re.compile(r"\s+")
_PIECES = "array<struct<n:int,testo:string,inizio:int,ripetuti:int,forzato:int>>"
#: Strengths of a boundary: any white space, space between words, after a clause, after a sentence, line, line after a sentence, paragraph.
ANY, WORD, CLAUSE, SENTENCE, LINE, SENTENCE_LINE, PARAGRAPH = range(1, 8)


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions where ``text`` may be cut, ascending, and the strength of each.

    A cut goes after a run of white space; inside a run and before it a cut is possible, but weakest.
    """
    where: list[int] = []
    strength: list[int] = []
    for run in _SPACES.finditer(text):
        a, b = run.span()
        where.extend(range(a, b))
        strength.extend([ANY] * (b - a))
        before = text[a - 1] if a else ""
        if before in "\"'»”’)" and a > 1:
            before = text[a - 2]
        ends, lines = before in ".!?…", text.count("\n", a, b) or text.count("\r", a, b)
        where.append(b)
        strength.append(PARAGRAPH if lines > 1 else (SENTENCE_LINE if ends else LINE) if lines else SENTENCE if ends else CLAUSE if before in ",;:" else WORD)
    at, rank = np.asarray(where, np.int64), np.asarray(strength, np.int64)
    inner = (at > 0) & (at < len(text))
    at, rank = at[inner], rank[inner]
    if len(at):  # a run's end and the next run's start never coincide, but keep the stronger if they do
        order = np.lexsort((-rank, at))
        at, rank = at[order], rank[order]
        first = np.r_[True, at[1:] != at[:-1]]
        at, rank = at[first], rank[first]
    return at, rank


def _cut(a: int, b: int, at: np.ndarray, rank: np.ndarray) -> tuple[int, bool]:
    """Where to bisect [a, b), and whether the cut is forced: strongest boundary in the middle half, else the nearest one anywhere."""
    middle, quarter = (a + b) // 2, (b - a) // 4
    lo, hi = np.searchsorted(at, [middle - quarter, middle + quarter + 1])
    if lo < hi:
        best = np.lexsort((np.abs(at[lo:hi] - middle), -rank[lo:hi]))[0] + lo
        if rank[best] > ANY:
            return int(at[best]), False
    lo, hi = np.searchsorted(at, [a + 1, b])
    if lo < hi:
        best = np.lexsort((np.abs(at[lo:hi] - middle), rank[lo:hi] == ANY))[0] + lo
        return int(at[best]), False
    return middle, True


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """Pieces of ``text`` as (start of what is new, end, forced, start with what is repeated), in order.

    Segments over ``limit - overlap`` are bisected; one between that and ``limit`` without any boundary stays
    whole and gets a shorter overlap, so a cut is forced only inside more than ``limit`` characters without
    white space.
    """
    if len(text) <= limit:
        return [(0, len(text), 0, 0)]
    at, rank = boundaries(text)
    done: list[tuple[int, int, int]] = []
    todo = [(0, len(text), 0)]
    while todo:
        a, b, forced = todo.pop()
        if b - a <= limit - overlap:
            done.append((a, b, forced))
            continue
        cut, hard = _cut(a, b, at, rank)
        if hard and b - a <= limit:
            done.append((a, b, forced))
            continue
        if hard and 0x300 <= ord(text[cut]) < 0x370 and cut - 1 > a:  # keep an accent with its letter
            cut -= 1
        todo.append((cut, b, max(forced, int(hard))))
        todo.append((a, cut, max(forced, int(hard))))
    return _with_overlap(text, done, at, rank, limit, overlap)


def _with_overlap(text: str, parts: list[tuple[int, int, int]], at: np.ndarray, rank: np.ndarray, limit: int, overlap: int) -> list:
    out, previous = [], 0
    for k, (a, b, forced) in enumerate(parts):
        start = a
        if k:
            room = min(overlap, limit - (b - a), a - previous)
            lo, hi = np.searchsorted(at, [a - room, a])
            usable = np.flatnonzero(rank[lo:hi] >= SENTENCE)
            words = np.flatnonzero(rank[lo:hi] > ANY)
            if len(usable) and a - at[lo + usable[0]] >= room // 2:
                start = int(at[lo + usable[0]])
            elif len(words):
                start = int(at[lo + words[0]])
            else:
                start = a - room
        out.append((a, b, forced, start))
        previous = start
    return out


def _pieces(limit: int, overlap: int):
    def cut(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            if text is None:
                out.append(None)
                continue
            out.append([{"n": n, "testo": text[start:b], "inizio": a, "ripetuti": a - start, "forzato": forced} for n, (a, b, forced, start) in enumerate(split_text(text, limit, overlap))])
        return pd.Series(out, dtype=object)

    # else the cut would be made once more for a filter on the number of pieces
    return F.pandas_udf(cut, _PIECES).asNondeterministic()


def split_oversized(df: DataFrame, text: str = "testo", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Every row of ``df`` as numbered pieces of at most ``limit`` characters.

    The piece replaces the text column; added are ``pezzo`` (0-based number), ``pezzi`` (how many), ``inizio``
    (offset of what is new), ``ripetuti`` (characters repeated from the piece before) and ``forzato`` (1: cut
    inside a run without white space).  Texts within the limit come back as they are, without entering Python.
    Null text: no piece; empty text: one empty piece; repeated rows: repeated pieces; other columns are kept,
    and a column that has the name of an added one gives way to it.
    """
    if overlap >= limit:
        raise ValueError("overlap must be less than limit")
    kept = [c for c in df.columns if c not in (text, "pezzo", "pezzi", "inizio", "ripetuti", "forzato", "_p")]
    long = F.length(text) > limit
    whole = F.array(F.struct(F.lit(0).alias("n"), F.col(text).alias("testo"), F.lit(0).alias("inizio"), F.lit(0).alias("ripetuti"), F.lit(0).alias("forzato")))
    cut = _pieces(limit, overlap)(F.when(long, F.col(text)))
    parts = df.filter(F.col(text).isNotNull()).select(*kept, F.when(long, cut).otherwise(whole).alias("_ps"))
    return parts.select(*kept, F.size("_ps").alias("pezzi"), F.explode("_ps").alias("_p")).select(
        *kept, F.col("_p.testo").alias(text), F.col("_p.n").alias("pezzo"), "pezzi", F.col("_p.inizio").alias("inizio"), F.col("_p.ripetuti").alias("ripetuti"), F.col("_p.forzato").alias("forzato")
    )
