"""What plans must look like: pruned columns, pushed filters, no products of tables."""

import re

import pytest
from pyspark.sql import functions as F

from scrinium.operators import catalogue as C
from scrinium.operators import search as S


def plan(df):
    return df._jdf.queryExecution().toString()


def read_schema(df):
    return re.findall(r"ReadSchema: (struct<[^\n]*)", plan(df))


@pytest.fixture
def tables(spark, small):
    return spark.read.parquet(f"{small}/files.parquet"), spark.read.parquet(f"{small}/chunk.parquet")


def test_columns_are_pruned(tables):
    files, chunks = tables
    assert all("testo" not in s and "vettore" not in s for s in read_schema(C.health(chunks)))
    assert all("impronta:" not in s for s in read_schema(C.copies_per_text(files.select("percorso", "impronta_testo"))))


def test_filters_reach_the_scan(tables):
    files, _ = tables
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThan\(n_chunk,0\)", plan(C.duplicate_groups(files)))


def test_first_of_a_key_is_limited_before_the_shuffle(tables):
    files, _ = tables
    assert plan(C.latest(files)).count("WindowGroupLimit") >= 2


def test_orphans_are_an_anti_join_and_top_k_is_no_sort(tables):
    files, chunks = tables
    assert "LeftAnti" in plan(C.orphans(files)) and "NestedLoop" not in plan(C.orphans(files))
    assert "TakeOrderedAndProject" in plan(C.largest(files))


def test_no_products(tables):
    files, chunks = tables
    for df in (C.twins(files), C.compaction_plan(files), C.classify(files, files), C.vanished(files, files), S.ranked(chunks.select("id", F.col("percorso").alias("q"), F.lit(1.0).alias("punteggio")), ["q"])):
        assert "Cartesian" not in plan(df) and "NestedLoop" not in plan(df)
