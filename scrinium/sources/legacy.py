"""Indexes kept as a matrix file beside JSON lines of metadata."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_META = "path string, testo string, nome string, impronta string"


def load_index(spark: SparkSession, prefix: str, rows_at_once: int = 50_000) -> DataFrame:
    """(id, percorso, testo, nome, chiave, vettore) of ``prefix``.npy and ``prefix``.meta.jsonl.

    Row k of the matrix belongs to line k; different counts are an error.  The matrix is mapped, and tasks read
    their own slice of it.
    """
    matrix = np.load(f"{prefix}.npy", mmap_mode="r")
    n = len(matrix)
    # lines are numbered within their partition, and moved on by the lines of the partitions before
    parts = spark.read.text(f"{prefix}.meta.jsonl").select(F.col("value").alias("riga"), F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_k"))
    before = parts.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b"))
    lines = parts.join(before, "_p").select((F.col("_b") + F.col("_k")).alias("id"), "riga")
    meta = lines.filter("riga <> ''").select("id", F.from_json("riga", _META).alias("m"))
    if meta.count() != n:
        raise ValueError("the matrix and its metadata have different numbers of rows")
    starts = spark.range(0, n, rows_at_once)

    def read(batches):
        held = np.load(f"{prefix}.npy", mmap_mode="r")
        for batch in batches:
            for a in batch.column(0).to_pylist():
                part = np.asarray(held[a : a + rows_at_once], np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + len(part))), pa.FixedSizeListArray.from_arrays(pa.array(part.ravel()), part.shape[1]).cast(pa.list_(pa.float32()))], names=["id", "vettore"])

    vectors = starts.mapInArrow(read, "id long, vettore array<float>")
    return meta.join(vectors, "id").select("id", F.col("m.path").alias("percorso"), F.col("m.testo").alias("testo"), F.col("m.nome").alias("nome"), F.coalesce(F.nullif(F.col("m.impronta"), F.lit("")), F.col("m.path")).alias("chiave"), "vettore")
