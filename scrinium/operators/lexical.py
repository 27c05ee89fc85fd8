"""Lexical ranking, fusion of rankings and the boost of rare words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrinium.functions.text import basename, words
from scrinium.operators.search import if_small, ranked

K1, B, RRF_K = 1.5, 0.75, 60
BOOST_RARE = 0.05


def query_words(cases: DataFrame) -> DataFrame:
    """(q, token, volte): words of each query, with their number; one row for each query text."""
    return cases.filter("q IS NOT NULL").select("q").distinct().select("q", F.explode(words(F.col("q"))).alias("token")).groupBy("q", "token").agg(F.count("*").alias("volte"))


def postings(docs: DataFrame, vocabulary: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lunghezza, token, tf) of the words in ``vocabulary`` only: other words never leave their row, but count for the length."""
    wanted = F.broadcast(vocabulary.agg(F.collect_set("token").alias("_w")))  # one row: the words of the queries
    rows = docs.crossJoin(wanted).select(*keys, words(F.col("testo")).alias("_t"), "_w")
    kept = rows.select(*keys, F.size("_t").alias("lunghezza"), F.filter("_t", lambda t: F.array_contains(F.col("_w"), t)).alias("_t"))
    counted = F.transform(F.array_distinct("_t"), lambda t: F.struct(t.alias("token"), F.size(F.filter("_t", lambda x: x == t)).alias("tf")))
    return kept.select(*keys, "lunghezza", F.explode(counted).alias("_x")).select(*keys, "lunghezza", "_x.*")


def searchable(chunks: DataFrame) -> DataFrame:
    """Chunks as lexical documents: text and file name."""
    return chunks.select("id", "percorso", F.concat_ws(" ", F.coalesce("testo", F.lit("")), basename(F.col("percorso"))).alias("testo"))


def collection_size(docs: DataFrame) -> DataFrame:
    """One row: number of documents and their mean length in words."""
    return docs.agg(F.count("*").alias("n"), F.avg(F.size(words(F.col("testo")))).alias("media"))


def bm25(docs: DataFrame, cases: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(q, id, percorso, punteggio) of documents that share a word with a query. A word repeated in a query counts as often."""
    asked = query_words(cases)
    found = postings(docs, asked, ["id", "percorso"])
    df = found.groupBy("token").agg(F.count("*").alias("df"))
    size = F.broadcast(collection_size(docs))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    term = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("lunghezza") / F.col("media")))
    weighted = found.join(df, "token").crossJoin(size).select("id", "percorso", "token", term.alias("_s"))
    return weighted.join(if_small(asked), "token").groupBy("q", "id", "percorso").agg(F.sum(F.col("_s") * F.col("volte")).alias("punteggio"))


def inverse_frequency(docs: DataFrame, cases: DataFrame) -> DataFrame:
    """(token, df, idf) of query words among documents."""
    df = postings(docs, query_words(cases), ["id"]).groupBy("token").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(docs.agg(F.count("*").alias("n")))).select("token", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def file_frequency(chunks: DataFrame, cases: DataFrame) -> DataFrame:
    """(token, percorso, df, n, idf): query words of files; df and ln(n / df) at the grain of files."""
    hits = postings(chunks.select("id", "percorso", F.coalesce("testo", F.lit("")).alias("testo")), query_words(cases), ["percorso"]).select("token", "percorso").distinct()
    n = F.broadcast(chunks.agg(F.countDistinct("percorso").alias("n")))
    df = hits.groupBy("token").agg(F.count("*").alias("df")).crossJoin(n).select("token", "df", "n", F.log(F.col("n") / F.col("df")).alias("idf"))
    return hits.join(if_small(df), "token")


def best_files(scores: DataFrame, k: int | None = None) -> DataFrame:
    """(q, percorso, id, punteggio, posto): best document of each file; with ``k`` a top-k report, and zero scores are dropped after it."""
    w = Window.partitionBy("q", "percorso").orderBy(F.desc("punteggio"), "id")
    best = scores.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    if k:
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("punteggio"), "id")).cast("long")
        best = best.withColumn("posto", place).filter(F.col("posto") <= k)
    else:
        best = ranked(best.filter("punteggio > 0"), ["q"])
    return best.filter("punteggio > 0")


def scored_files(scores: DataFrame) -> DataFrame:
    """(q, percorso, id, punteggio): the best document of each file with a score over zero, not placed."""
    w = Window.partitionBy("q", "percorso").orderBy(F.desc("punteggio"), "id")
    return scores.filter("punteggio > 0").withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def fused(*rankings: DataFrame, k: int = RRF_K) -> DataFrame:
    """(q, percorso, punteggio): reciprocal rank fusion of rankings (q, percorso, posto)."""
    all_ = rankings[0].select("q", "percorso", "posto")
    for r in rankings[1:]:
        all_ = all_.unionByName(r.select("q", "percorso", "posto"))
    return all_.groupBy("q", "percorso").agg(F.sum(1 / (k + F.col("posto"))).alias("punteggio"))


def boosted(ranking: DataFrame, frequency: DataFrame, cases: DataFrame, beta: float, rare: float = BOOST_RARE) -> DataFrame:
    """The ranking with ``beta`` times the share of rare query words (by idf) that a file has added to its score."""
    asked = query_words(cases)
    rows = frequency.join(if_small(asked), "token").filter(F.col("df") <= F.col("n") * rare)
    top = rows.groupBy("q").agg(F.max("idf").alias("_m"))
    gain = rows.groupBy("q", "percorso").agg(F.sum(F.col("idf") * F.col("volte")).alias("_g")).join(top, "q").select("q", "percorso", F.when(F.col("_m") > 0, F.col("_g") / F.col("_m")).otherwise(0.0).alias("_g"))
    return ranking.join(gain, ["q", "percorso"], "left").withColumn("punteggio", F.col("punteggio") + beta * F.coalesce("_g", F.lit(0.0))).drop("_g")
