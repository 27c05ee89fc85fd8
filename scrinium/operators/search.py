"""Exact vector search and its ranking, and the rule for identifiers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrinium.functions.text import basename, dirname, snippet
from scrinium.functions.vectors import dot

CUT, MOST_RESULTS, DEFAULT_RESULTS = 0.90, 50, 10
RARE, MOST_TERMS, LEAST_LENGTH = 0.01, 3, 3


def scored(index: DataFrame, query: list[float], vector: str = "vettore") -> DataFrame:
    """The index with ``punteggio``, the dot product with one query; native, no join: the query is a literal."""
    return index.withColumn("punteggio", dot(F.col(vector), F.array([F.lit(float(x)) for x in query])))


def best_per_file(rows: DataFrame, keys: list[str], order: str = "id") -> DataFrame:
    """The best row of each file; ties go to the smaller ``order``. Rows without a score are dropped."""
    w = Window.partitionBy(*keys).orderBy(F.desc("punteggio"), F.asc(order))
    return rows.filter(F.col("punteggio").isNotNull() & ~F.isnan("punteggio")).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def relative_cut(rows: DataFrame, cut: float = CUT, by: list[str] | None = None) -> DataFrame:
    """Rows with at least ``cut`` times the best score. A negative best score cuts everything, as the rule says."""
    if by:
        return rows.join(rows.groupBy(*by).agg(F.max("punteggio").alias("_m")), by).filter(F.col("punteggio") >= F.col("_m") * cut).drop("_m")
    return rows.crossJoin(F.broadcast(rows.agg(F.max("punteggio").alias("_m")))).filter(F.col("punteggio") >= F.col("_m") * cut).drop("_m")


def collapsed(ranked: DataFrame, key: str, order: str = "id") -> DataFrame:
    """One row for each copy key, the best; ``altre`` counts the others.

    The best row is found with a limit before the shuffle and the others are counted by partial sums, so a key with
    very many rows is no hot task.
    """
    w = Window.partitionBy(key).orderBy(F.desc("punteggio"), F.asc(order))
    best = ranked.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    return best.join(ranked.groupBy(key).agg((F.count("*") - 1).alias("altre")), key)


def result_limit(n: object) -> int:
    """The number of results asked for: 10 unless it is a whole number, 50 at most, and one at least."""
    try:
        return max(1, min(int(str(n).strip()), MOST_RESULTS))
    except (TypeError, ValueError):
        return DEFAULT_RESULTS


def dense_search(index: DataFrame, query: list[float], n: int = DEFAULT_RESULTS, cut: float = CUT, copies: DataFrame | None = None, only: DataFrame | None = None, vector: str = "vettore") -> DataFrame:
    """The search: score, best chunk of each file, cut, copies collapsed, top ``n``.

    ``index`` has (id, percorso, testo, chiave, vector); ``copies`` (chiave, copie) adds catalogued copies; ``only``
    (percorso) restricts to files of the identifier rule, which also turns the cut off.  ``copie`` counts catalogued
    copies plus lower ranked results of the same key.  Rows whose vector is null or has NaN never appear.
    """
    # text and vector stay out of the shuffles; the text of the results is brought at the end
    scores = scored(index.select("id", "percorso", "chiave", vector), query, vector).drop(vector)
    best = best_per_file(scores, ["percorso"])
    if only is not None:
        best, cut = best.join(only.select("percorso").distinct(), "percorso", "left_semi"), 0.0
    one = collapsed(relative_cut(best, cut), "chiave")
    if copies is not None:
        one = one.join(copies.select("chiave", "copie"), "chiave", "left").withColumn("copie", F.greatest(F.coalesce("copie", F.lit(1)) - 1, F.lit(0)) + F.col("altre"))
    else:
        one = one.withColumn("copie", F.col("altre"))
    top = F.broadcast(one.orderBy(F.desc("punteggio"), "id").limit(result_limit(n)))  # 50 rows at most
    top = index.select("id", "percorso", "testo").join(top, ["id", "percorso"]).dropDuplicates(["id", "percorso"]).orderBy(F.desc("punteggio"), "id")
    return top.select(F.col("percorso").alias("path"), basename(F.col("percorso")).alias("nome"), dirname(F.col("percorso")).alias("cartella"), F.round("punteggio", 4).alias("punteggio"), snippet(F.col("testo")).alias("frammento"), "copie")


#: Bytes of query vectors that are broadcast at once; a larger set of queries takes one more pass over the index for each.
QUERY_BYTES = 64_000_000
#: Rows of a side that is broadcast by request.
FEW = 100_000


def if_small(df: DataFrame, rows: int = FEW) -> DataFrame:
    """``df`` with a broadcast hint where it has at most ``rows`` rows, else as it is, so that the join is by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def batch_search(index: DataFrame, queries: DataFrame, k: int = 10, vector: str = "vettore", block: int = 1024) -> DataFrame:
    """(q, id, punteggio, posto): the ``k`` best rows of the index for each of many queries (q, vector).

    The queries come as matrices, as many at once as ``QUERY_BYTES`` allow; each task passes once over its part of the
    index in blocks of ``block`` queries and keeps its own best, so only k rows a query and task are shuffled.  A row is
    no match of a query with its own id (q = id); scores that are equal to nine digits go by id.
    """
    spark = index.sparkSession
    asked = queries.select(F.col("q").cast("long").alias("q"), F.col(vector).alias("v")).filter("v IS NOT NULL AND size(v) > 0")
    size = asked.agg(F.coalesce(F.sum(F.size("v") * 8 + 8), F.lit(0)).alias("b")).first().b
    passes = max(1, -(-size // QUERY_BYTES))
    rows = index.select(F.col("id").cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("v IS NOT NULL AND size(v) > 0")
    met = None
    for turn in range(passes):
        part = asked if passes == 1 else asked.filter(F.pmod(F.xxhash64("q"), F.lit(passes)) == turn)
        found = rows.mapInArrow(_best_of_part(spark.sparkContext.broadcast(_matrix(part)), k, block), "q long, id long, punteggio double")
        met = found if met is None else met.unionByName(found)
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("punteggio"), "id")).cast("long")
    return met.withColumn("posto", place).filter(F.col("posto") <= k)


def _matrix(queries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = queries.select("q", F.col("v").cast("array<double>").alias("v")).toArrow()
    ids = table.column("q").to_numpy()
    return ids, table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))


def _best_of_part(held, k: int, block: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, qv = held.value
        ids, values = np.zeros((len(qid), 0), np.int64), np.zeros((len(qid), 0))
        for batch in batches:
            xid = batch.column(0).to_numpy()
            if not len(xid) or not len(qid):
                continue
            xv = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(xid), -1)
            m = min(k, len(xid))
            best, score = np.empty((len(qid), m), np.int64), np.empty((len(qid), m))
            for a in range(0, len(qid), block):
                s = np.round(np.nan_to_num(qv[a : a + block] @ xv.T, nan=-np.inf), 9)
                s[qid[a : a + block, None] == xid] = -np.inf
                top = np.argpartition(-s, m - 1, axis=1)[:, :m]
                best[a : a + block], score[a : a + block] = xid[top], np.take_along_axis(s, top, 1)
            ids, values = np.concatenate([ids, best], 1), np.concatenate([values, score], 1)
            order = np.lexsort((ids, -values), axis=1)[:, :k]
            ids, values = np.take_along_axis(ids, order, 1), np.take_along_axis(values, order, 1)
        ok = np.isfinite(values)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, values.shape[1]).reshape(values.shape)[ok]), pa.array(ids[ok]), pa.array(values[ok])], names=["q", "id", "punteggio"])

    return work


def query_terms(query: str) -> list[str]:
    """Words of a query that may be identifiers."""
    return [w for w in re.findall(r"\w+", query.lower()) if len(w) >= LEAST_LENGTH]


def files_with_term(chunks: DataFrame, catalogue: DataFrame, term: str) -> DataFrame:
    """(percorso) of files with ``term`` in a chunk or in their path; case does not count."""
    has = lambda c: F.contains(F.lower(c), F.lit(term.lower()))
    return chunks.filter(has(F.col("testo"))).select("percorso").union(catalogue.filter(has(F.col("percorso"))).select("percorso")).distinct()


def term_counts(chunks: DataFrame, catalogue: DataFrame, terms: list[str]) -> DataFrame:
    """(termine, percorso) hits of all terms in one pass over the texts."""
    found = lambda c: F.filter(F.array([F.lit(t) for t in terms]), lambda t: F.contains(F.lower(c), t))
    hits = lambda df, c: df.select("percorso", F.explode(found(F.col(c))).alias("termine"))
    return hits(chunks, "testo").unionByName(hits(catalogue, "percorso")).distinct()


def identifier_gate(chunks: DataFrame, catalogue: DataFrame, terms: list[str]) -> DataFrame:
    """(termine, file, limite, raro): a term is rare if it is in one file at least and 1 % of the files with chunks at most."""
    limit = chunks.agg(F.greatest(F.lit(1), F.floor(F.countDistinct("percorso") * RARE)).cast("int").alias("limite"))
    wanted = chunks.sparkSession.createDataFrame([(t,) for t in dict.fromkeys(terms)], "termine string")
    counts = term_counts(chunks, catalogue, list(dict.fromkeys(terms))).groupBy("termine").agg(F.count("*").alias("file"))
    return wanted.join(counts, "termine", "left").crossJoin(limit).select("termine", F.coalesce("file", F.lit(0)).alias("file"), "limite", (F.coalesce("file", F.lit(0)).between(1, F.col("limite"))).alias("raro"))


def identifier_files(chunks: DataFrame, catalogue: DataFrame, query: str) -> DataFrame:
    """(percorso) of files that have all terms of an identifier-like query; empty where the rule doesn't apply.

    It applies to one to three terms, all rare; repeated terms count for the three.
    """
    terms = query_terms(query)
    if not 1 <= len(terms) <= MOST_TERMS:
        return catalogue.select("percorso").limit(0)
    distinct = list(dict.fromkeys(terms))
    hits = term_counts(chunks, catalogue, distinct)
    rare = identifier_gate(chunks, catalogue, terms).agg(F.min("raro").alias("tutti")).filter("tutti")
    all_terms = hits.groupBy("percorso").agg(F.countDistinct("termine").alias("k")).filter(F.col("k") == len(distinct)).select("percorso")
    return all_terms.crossJoin(F.broadcast(rare)).select("percorso")


def ranked(rows: DataFrame, by: list[str], order: str = "id", steps: int = 64) -> DataFrame:
    """Rows with ``posto``, their 1-based place within ``by``, by score and then ``order``.

    A ranking of any length is placed by many tasks: about equal ranges of scores are numbered side by side, and moved on
    by the number of rows in the ranges before.  Rows with one score stay in one range.
    """
    bounds = rows.groupBy(*by).agg(F.percentile_approx("punteggio", [k / steps for k in range(1, steps)], 1000).alias("_q"))
    spread = rows.join(bounds, by).withColumn("_p", F.size(F.filter("_q", lambda x: x > F.col("punteggio")))).drop("_q")
    local = spread.withColumn("posto", F.row_number().over(Window.partitionBy(*by, "_p").orderBy(F.desc("punteggio"), F.asc(order))).cast("long"))
    sizes = spread.groupBy(*by, "_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_b", F.sum("_n").over(Window.partitionBy(*by).orderBy("_p")) - F.col("_n")).drop("_n")
    return local.join(before, [*by, "_p"]).withColumn("posto", F.col("posto") + F.col("_b")).drop("_b", "_p")
