import pytest

from scrinium import registry

WITH_SQL = sorted(registry.oracle_sql())


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_gives_what_its_sql_gives(name, agrees):
    agrees(registry.queries()[name], registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(WITH_SQL)))
def test_query_without_sql_runs(name, spark, small):
    assert registry.queries()[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_search_of_chunks_equals_brute_force(spark, small):
    import numpy as np

    got = {}
    for r in registry.queries()["dense_search_chunks"](spark, small).collect():
        got.setdefault(r.q, set()).add(r.id)
    rows = {r.id: np.frombuffer(r.vettore, "<f4").astype(float) for r in spark.read.parquet(f"{small}/chunk.parquet").collect() if r.vettore is not None and len(r.vettore) == 256}
    rows = {k: v / np.linalg.norm(v) for k, v in rows.items() if np.isfinite(v).all() and v.any()}
    for q in [k for k in rows if k % 100 == 0]:
        near = sorted((k for k in rows if k != q), key=lambda k: -float(rows[k] @ rows[q]))[:5]
        assert got[q] == set(near)


def test_html_texts_of_documents_without_tags(spark, tmp_path):
    rows = [(1, "<p>a&amp;b</p>"), (2, "a&amp;b"), (3, "a b"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.testo for r in registry.queries()["html_texts"](spark, str(tmp_path)).collect()}
    assert got == {1: " a&b ", 2: "a&b", 3: "a b", 4: None}
