"""Quality of rankings against cases with expected fragments of file names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrinium.functions.text import basename
from scrinium.operators.search import if_small

DEPTH = 8


def relevant(ranking: DataFrame, cases: DataFrame) -> DataFrame:
    """The ranking with ``pertinente``: an expected fragment is in the file's name; case does not count."""
    name = F.lower(basename(F.col("percorso")))
    once = cases.filter("q IS NOT NULL").groupBy("q").agg(F.array_distinct(F.flatten(F.collect_list("attesi"))).alias("attesi"))
    return ranking.join(if_small(once), "q").withColumn("pertinente", F.exists("attesi", lambda a: F.contains(name, F.lower(a)))).drop("attesi")


def metrics(ranking: DataFrame, cases: DataFrame, depth: int = DEPTH, by: list[str] | None = None) -> DataFrame:
    """(q, primo, pertinenti, rumore, restituiti): first relevant place, and hits, noise and rows among the first ``depth``.

    A ranking that has ``pertinente`` already is not matched with the cases again.
    """
    keys = ["q", *(by or [])]
    near = F.col("posto") <= depth
    marked = ranking if "pertinente" in ranking.columns else relevant(ranking, cases)
    return marked.groupBy(*keys).agg(F.min(F.when(F.col("pertinente"), F.col("posto"))).alias("primo"), F.count_if(near & F.col("pertinente")).alias("pertinenti"), F.count_if(near & ~F.col("pertinente")).alias("rumore"), F.count_if(near).alias("restituiti"))


def score_metrics(scored: DataFrame, keys: list[str], order: str = "id", depth: int = DEPTH, cuts: list[float] | None = None) -> DataFrame:
    """(keys, primo, pertinenti, rumore, restituiti) of rankings that aren't placed: rows with ``punteggio`` and ``pertinente``.

    The first relevant place is one more than the rows before the best relevant one, and only the first ``depth`` rows of
    a ranking are placed, so no ranking is sorted as a whole.  With ``cuts`` one row for each (``alfa``), of what has that
    share of the best score; 1 means no cut.
    """
    place = F.struct((-F.col("punteggio")).alias("s"), F.col(order).alias("o"))
    best = scored.groupBy(*keys).agg(F.max("punteggio").alias("_m"), F.min(F.when(F.col("pertinente"), place)).alias("_f"))
    first = scored.join(best, keys).groupBy(*keys).agg(F.first("_m").alias("_m"), F.first("_f").alias("_f"), F.count_if(place <= F.col("_f")).alias("primo"))
    w = Window.partitionBy(*keys).orderBy(F.desc("punteggio"), F.asc(order))
    top = scored.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= depth).groupBy(*keys).agg(F.collect_list(F.struct("punteggio", "pertinente")).alias("_t"))
    rows = first.join(top, keys).withColumn("alfa", F.explode(F.array([F.lit(float(c)) for c in cuts or [1.0]])))
    least = F.when(F.col("alfa") == 1, F.lit(float("-inf"))).otherwise(F.col("_m") * F.col("alfa"))
    kept = rows.withColumn("_l", least).withColumn("_t", F.filter("_t", lambda x: x["punteggio"] >= F.col("_l")))
    kept = kept.filter((F.col("alfa") == 1) | (F.col("_m") >= F.col("_l")))
    hits = F.size(F.filter("_t", lambda x: x["pertinente"])).cast("long")
    return kept.select(*keys, *(["alfa"] if cuts else []), F.when(-F.col("_f.s") >= F.col("_l"), F.col("primo")).alias("primo"), hits.alias("pertinenti"), (F.size("_t") - hits).alias("rumore"), F.size("_t").cast("long").alias("restituiti"))


def compared(rankings: dict[str, DataFrame], cases: DataFrame, order: str = "id") -> DataFrame:
    """(q, one column for each ranking): first relevant place of each; rankings have (q, percorso, punteggio, ``order``)."""
    rows = None
    for name, ranking in rankings.items():
        one = ranking.select("q", "percorso", order, "punteggio").withColumn("modello", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    found = score_metrics(relevant(rows, cases), ["q", "modello"], order)
    return found.groupBy("q").pivot("modello", list(rankings)).agg(F.first("primo"))
