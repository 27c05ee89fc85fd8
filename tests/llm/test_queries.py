import pytest

from scrinium.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_gives_what_its_sql_gives(name, agrees):
    agrees(Q.queries()[name], Q.oracle_sql()[name])


@pytest.mark.parametrize(("name", "columns"), [("p1_found", "id:bigint,tipo:string"), ("p2_found", "id_a:bigint,id_b:bigint"), ("p3_found", "id:bigint,forzato:int"), ("p4_found", "id_a:bigint,id_b:bigint"), ("p5_found", "id_a:bigint,id_b:bigint"), ("p6_ids", "doc_id:bigint,ids:array<int>"), ("p7_found", "doc_id:bigint"), ("p8_found", "doc_id:bigint")])
def test_columns(name, columns, spark, small):
    rows = Q.queries()[name](spark, small)
    assert rows.schema.simpleString() == f"struct<{columns}>"
    assert rows.count() >= 0
