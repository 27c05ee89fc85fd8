"""Tables that outlive the executors that made them.

``durable(df)`` writes ``df`` as parquet into the shared folder named by ``spark.checkpoint.dir`` and reads it back:
lineage is cut, a lost executor loses nothing, and later stages read only the columns they need.  ``release(spark)``
removes what a session has written there.  A temporary folder of our own is used only on one machine, where the session
names none (tests); a cluster must name one.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from scrinium.sources import storage

_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """This session's folder, which every executor can reach."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="scrinium-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        named = _OWN[0]
    return f"{named.rstrip('/')}/scrinium-{spark.sparkContext.applicationId}"


def durable(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove the tables of this session; frames that read them can't be used any more."""
    storage.remove(spark, shared_folder(spark))
