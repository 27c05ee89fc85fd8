"""Continuous passes: arrivals in a folder of catalogue rows, merged batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scrinium.operators.catalogue import latest


def follow_catalogue(spark: SparkSession, arrivals: str, schema: str, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keep ``target`` the latest state of every path in the parquet files that arrive in ``arrivals``.

    Each batch is merged with the version written before it into a new one, named by the batch: a batch that is run
    again after a failure writes the same version.  Late rows with an older state change nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        before = f"{target}/v{number - 1:012d}"
        rows = batch if number == 0 else session.read.schema(batch.schema).parquet(before).unionByName(batch)
        latest(rows).write.mode("overwrite").parquet(f"{target}/v{number:012d}")

    stream = spark.readStream.schema(schema).parquet(arrivals)
    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def recent_searches(stream: DataFrame, late: str = "7 days", width: str = "1 day") -> DataFrame:
    """(inizio, ricerche): searches by window of the time they were asked; rows later than ``late`` are ignored."""
    counted = stream.withWatermark("chiesto_a", late).dropDuplicatesWithinWatermark(["ricerca_id"])
    return counted.groupBy(F.window("chiesto_a", width).alias("w")).agg(F.count("*").alias("ricerche")).select(F.col("w.start").alias("inizio"), "ricerche")
