import pytest

from scrinium.llm import queries
from scrinium.llm.canonical import canonical_form, look_classes, same_look_pairs

SAME = [
    ("è", "è"), ("Ａｂ１", "Ab1"), ("a b", "a b"), ("a b", "a　b"), ("ab", "a​b"), ("ab", "a­b"), ("ﬁne uﬃcio", "fine ufficio"), ("co-op", "co‐op"), ("co-op", "co‑op"),
    ("cassa", "cаssа"), ("pratica", "prаticа"), ("Torre", "Τοrre"), ("è", "ѐ"), ("ë", "ё"), ("привет", "пpивeт"), ("ρosa", "posa"), ("ՏOS", "SOS"), ("Ꭺlfa", "Alfa"), ("ｶﾞ", "ガ"), ("x-\ny", "x­\ny"), ("\U0001f4ce a", "\U0001f4ce a"),
]
OTHER = [("città", "citta"), ("Casa", "casa"), ("½", "1/2"), ("m²", "m2"), ("a–b", "a-b"), ("a  b", "a b"), ("a\nb", "a b"), ("1", "l"), ("\U0001f468‍\U0001f469", "\U0001f468\U0001f469"), ("т", "t"), ("α", "a"), ("к", "k")]


def forms(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, testo string")
    return [r.forma for r in canonical_form(df).orderBy("id").collect()]


def test_same_look(spark):
    a, b = forms(spark, [x for x, _ in SAME]), forms(spark, [y for _, y in SAME])
    assert a == b
    assert forms(spark, a) == a
    assert forms(spark, ["отчёт", "αντίγραφο", "Вода"]) == ["отчёт", "αντίγραφο", "Вода"]


def test_other_look(spark):
    assert [k for k, (x, y) in enumerate(zip(forms(spark, [x for x, _ in OTHER]), forms(spark, [y for _, y in OTHER]), strict=True)) if x == y] == []


def test_nulls_and_clashes(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y")], "id int, testo string, forma string")
    rows = canonical_form(df).orderBy("id").collect()
    assert [r.forma for r in rows] == [None, ""] and rows[0].asDict().keys() == {"id", "testo", "forma"}
    assert canonical_form(df.limit(0)).count() == 0


@pytest.mark.parametrize("extra", [0, 40])
def test_pairs(spark, extra):
    rows = [(1, "è qui"), (2, "è qui"), (2, "è qui"), (3, "è qui"), (4, "e qui"), (5, None), (6, ""), (7, "​")] + [(100 + k, "copia") for k in range(extra)]
    classes = look_classes(spark.createDataFrame([(*r, "x") for r in rows], "id long, testo string, classe string"))
    got = {tuple(r) for r in same_look_pairs(classes).collect()}
    assert got == {(1, 2), (2, 3), (6, 7)}
    assert [tuple(r) for r in classes.filter("id < 8").orderBy("id").collect()] == [(1, 1, 1), (2, 1, 2), (3, 1, 1), (4, 4, 4), (6, 6, 6), (7, 6, 7)]
    assert look_classes(spark.createDataFrame(rows[:0], "id long, testo string")).count() == 0


FORMS = [("ﬁne\u00admente", "finemente"), ("ÔｏＫ\u3000x", "ÔoK x"), ("e\u0301\u200b", "é"), ("x\u2011y\u00a0z", "x-y z"), ("\u00ad\n", "-\n"), ("Ձայն", "Ձայն"), ("ρas", "pas"), ("ᎪᏢI", "API"), ("ᎩᎴ", "ᎩᎴ"), ("ՏՕS", "SOS"), ("рaса", "paca"), ("\U0001f468\ufe0f\u200d\U0001f469\u200d\U0001f467", "\U0001f468\u200d\U0001f469\u200d\U0001f467"), ("a\u200db", "ab"), ("²½", "²½")]


def test_expected_forms(spark):
    import duckdb

    assert forms(spark, [a for a, _ in FORMS]) == [b for _, b in FORMS]
    con = duckdb.connect()
    con.execute("CREATE TABLE chunk (id INT, testo VARCHAR)")
    con.executemany("INSERT INTO chunk VALUES (?, ?)", [(k, a) for k, (a, _) in enumerate([*FORMS, *SAME, *OTHER])])
    assert [r[0] for r in con.execute(f"SELECT forma FROM ({queries.oracle_sql()['p2_forms']}) ORDER BY id").fetchall()] == forms(spark, [a for a, _ in [*FORMS, *SAME, *OTHER]])
