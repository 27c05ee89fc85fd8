import re

from hypothesis import given, settings
from hypothesis import strategies as st

from scrinium.llm.splitting import split_oversized, split_text


def checked(text, limit, overlap):
    parts = split_text(text, limit, overlap)
    assert "".join(text[a:b] for a, b, _, _ in parts) == text
    for k, (a, b, _, start) in enumerate(parts):
        assert b - start <= limit and 0 <= a - start <= overlap
        if k:
            assert start >= parts[k - 1][3]
    return parts


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \n,é", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_pieces_are_the_text_again(text, limit, overlap):
    parts = checked(text, limit, overlap)
    run = max((len(x) for x in re.split(r"\s", text)), default=0) > limit
    assert any(f for *_, f, _ in parts) == run


def test_cuts_are_at_the_strongest_boundary():
    text = "Prima frase lunga quanto basta.\n\nSeconda frase lunga quanto basta, con seguito."
    a, b = checked(text, 60, 10)
    assert text[b[0] :].startswith("Seconda")
    assert len(checked("x" * 100_000, 2500, 400)) > 40
    assert checked("", 10, 2) == [(0, 0, 0, 0)]
    assert len(checked(" " * 3000, 2500, 400)) > 1


def test_table(spark):
    long = "parola " * 600
    df = spark.createDataFrame([(1, None, "u"), (2, "", "v"), (3, "corto", "w"), (3, "corto", "w"), (4, long, "x"), (5, "y" * 2501, "z")], "id long, testo string, pezzo string")
    rows = split_oversized(df).orderBy("id", "pezzo").collect()
    assert split_oversized(df).columns == ["id", "testo", "pezzo", "pezzi", "inizio", "ripetuti", "forzato"]
    by = {}
    for r in rows:
        by.setdefault(r.id, []).append(r)
    assert 1 not in by and [r.testo for r in by[2]] == [""] and len(by[3]) == 2
    assert "".join(r.testo[r.ripetuti :] for r in by[4]) == long and all(not r.forzato for r in by[4])
    assert any(r.forzato for r in by[5]) and all(len(r.testo) <= 2500 for r in rows)
    assert split_oversized(df.limit(0)).count() == 0
