from pyspark.sql import functions as F

from scrinium.operators import catalogue as C
from scrinium.operators import evaluate as E
from scrinium.operators import lexical as L
from scrinium.operators import search as S

FILES = "percorso string, mtime double, dimensione long, impronta string, n_chunk int, ocr int, visto_a double, impronta_testo string, versione string"


def files(spark, rows):
    return spark.createDataFrame([(p, m, 1, "b" + p, n, 0, v, h, "1") for p, m, n, v, h in rows], FILES)


def paths(df):
    return sorted(r[0] for r in df.collect())


def test_latest_and_copies(spark):
    f = files(spark, [("a", 1.0, 1, 5.0, "x"), ("a", 2.0, 2, 6.0, "x"), ("a", 2.0, 2, 6.0, "x"), ("b", 1.0, 1, None, "x"), ("c", 1.0, 0, 1.0, "x"), ("d", 1.0, 0, 1.0, "y"), ("e", 1.0, 0, 1.0, "")])
    now = C.latest(f)
    assert now.count() == 5
    assert now.filter("percorso = 'a'").first().mtime == 2.0
    assert [tuple(r) for r in C.copies_per_text(now).collect()] == [("x", 3)]
    assert [tuple(r) for r in C.duplicate_groups(now).collect()] == [("x", 2)]
    assert paths(C.orphans(now)) == ["d"]
    assert {tuple(r) for r in C.twins(now).collect()} == {("a", "b"), ("b", "a"), ("c", "a")}
    assert paths(C.compaction_plan(now)) == ["b"]
    assert C.latest(f.limit(0)).count() == 0


def test_changes(spark):
    old = files(spark, [("a", 1.0, 1, 1.0, ""), ("b", 1.0, 1, 1.0, ""), ("d", 1.0, 1, 1.0, "")])
    new = files(spark, [("a", 1.0 + 1e-9, 1, 1.0, ""), ("b", 2.0, 1, 1.0, ""), ("c", 1.0, 1, 1.0, "")])
    assert dict(C.classify(new, old).collect()) == {"a": C.UNCHANGED, "b": C.CHANGED, "c": C.NEW}
    assert paths(C.vanished(old, new)) == ["d"]
    assert C.upsert(old, new, ["percorso"]).count() == 4


def test_listing_rules(spark):
    names = ["/r/a.txt", "/r/.x/a.txt", "/r/x.app/a.txt", "/r/App/a.TXT", "/r/~$a.txt", "/r/a.bin", "/q/a.txt", "/.r2/s/a.txt"]
    df = spark.createDataFrame([(n,) for n in names], "percorso string")
    assert paths(C.listed(df, ["/r", "/.r2/s/"], ["txt"], ["*.app/", "~$*"])) == ["/.r2/s/a.txt", "/r/App/a.TXT", "/r/a.txt"]
    assert paths(C.listed(df, [], ["txt"], [])) == []


def index(spark, rows):
    return spark.createDataFrame(rows, "id long, percorso string, testo string, chiave string, vettore array<double>")


def test_search_semantics(spark):
    rows = [(1, "/a/x", "t", "k1", [1.0, 0.0]), (2, "/a/x", "t", "k1", [1.0, 0.0]), (3, "/b/y", "t", "k1", [0.99, 0.1]), (4, "/c/z", "t", "k2", [0.5, 0.5]), (5, "/d/n", "t", "k3", [float("nan"), 0.0]), (6, "/e/w", None, "k4", None)]
    got = S.dense_search(index(spark, rows), [1.0, 0.0], 10, 0.9).collect()
    assert [(r.path, r.copie, r.nome, r.cartella) for r in got] == [("/a/x", 1, "x", "/a")]
    assert [r.path for r in S.dense_search(index(spark, rows), [1.0, 0.0], 10, 0.0).collect()] == ["/a/x", "/c/z"]
    # a negative best score cuts everything
    assert S.dense_search(index(spark, rows), [-1.0, -1.0], 10, 0.9).count() == 0
    only = spark.createDataFrame([("/c/z",)], "percorso string")
    assert [r.path for r in S.dense_search(index(spark, rows), [1.0, 0.0], 10, 0.9, only=only).collect()] == ["/c/z"]
    copies = spark.createDataFrame([("k1", 3)], "chiave string, copie long")
    assert S.dense_search(index(spark, rows), [1.0, 0.0], 10, 0.9, copies=copies).first().copie == 3
    assert S.dense_search(index(spark, rows[:0]), [1.0, 0.0]).count() == 0


def test_result_limit():
    assert [S.result_limit(x) for x in (None, "x", "7", "99", "-3", 0)] == [10, 10, 7, 50, 1, 1]


def test_identifier(spark):
    chunks = spark.createDataFrame([(k, f"/f{k}", "parola comune") for k in range(200)] + [(900, "/rara", "il Raro1 documento")], "id long, percorso string, testo string")
    cat = spark.createDataFrame([("/altro/raro1.pdf",), ("/f1",)], "percorso string")
    assert paths(S.identifier_files(chunks, cat, "RARO1")) == ["/altro/raro1.pdf", "/rara"]
    assert paths(S.identifier_files(chunks, cat, "raro1 comune")) == []
    assert paths(S.identifier_files(chunks, cat, "a b c")) == []
    assert paths(S.identifier_files(chunks, cat, "raro1 raro1 raro1 raro1")) == []


def test_batch_search_equals_brute_force(spark):
    import numpy as np

    x = np.random.default_rng(0).standard_normal((300, 8))
    rows = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(999, None)], "id long, vettore array<double>").repartition(5)
    got = {}
    for r in S.batch_search(rows, rows.filter("id < 40").select(F.col("id").alias("q"), "vettore"), 4, block=7).collect():
        got.setdefault(r.q, {})[r.posto] = r.id
    for q in range(40):
        s = x @ x[q]
        s[q] = -np.inf
        assert [got[q][p] for p in (1, 2, 3, 4)] == list(np.argsort(-s)[:4])


def test_lexical(spark):
    docs = spark.createDataFrame([(1, "/a", "gatto cane gatto"), (2, "/b", "cane"), (3, "/c", ""), (4, "/a", "gatto")], "id long, percorso string, testo string")
    cases = spark.createDataFrame([("gatto gatto", ["a"], None), (None, ["x"], None), ("", ["x"], None)], "q string, attesi array<string>, nota string")
    scores = L.bm25(docs, cases)
    assert sorted(r.id for r in scores.collect()) == [1, 4]
    best = L.best_files(scores).collect()
    assert [(r.percorso, r.posto) for r in best] == [("/a", 1)]
    assert [r.primo for r in E.metrics(L.best_files(scores), cases).collect()] == [1]
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "q string, percorso string, posto int")
    b = spark.createDataFrame([("q", "y", 1)], "q string, percorso string, posto int")
    one = {r.percorso: r.punteggio for r in L.fused(a, b).collect()}
    assert one == {r.percorso: r.punteggio for r in L.fused(b, a).collect()}
    assert abs(one["y"] - (1 / 61 + 1 / 62)) < 1e-12


def test_text_hash_streams_in_order(spark):
    import hashlib

    rows = spark.createDataFrame([(2, "/a", 1, "b"), (1, "/a", 0, "a"), (1, "/a", 0, "a"), (3, "/b", 0, None)], "id long, percorso string, n int, testo string")
    assert dict(C.text_hashes(rows).collect()) == {"/a": hashlib.sha256(b"ab").hexdigest(), "/b": hashlib.sha256(b"").hexdigest()}


def test_places_are_those_of_one_sort(spark):
    import random

    rng = random.Random(0)
    rows = [(f"q{rng.randint(0, 2)}", k, float(rng.randint(0, 20))) for k in range(2000)]
    df = spark.createDataFrame(rows, "q string, id long, punteggio double").repartition(7)
    got = {(r.q, r.id): r.posto for r in S.ranked(df, ["q"]).collect()}
    for q in ("q0", "q1", "q2"):
        order = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))
        assert [got[q, r[1]] for r in order] == list(range(1, len(order) + 1))
    assert S.ranked(df.limit(0), ["q"]).count() == 0


def test_measures_without_places_are_those_of_placed_rankings(spark):
    import random

    rng = random.Random(1)
    rows = [(f"q{rng.randint(0, 3)}", f"/p{k}", k, float(rng.randint(1, 30)), rng.random() < 0.05) for k in range(900)] + [("solo", "/x", 9000, 1.0, False)]
    df = spark.createDataFrame(rows, "q string, percorso string, id long, punteggio double, pertinente boolean")
    want = {r.q: tuple(r)[1:] for r in E.metrics(S.ranked(df, ["q"]), None).collect()}
    assert {r.q: tuple(r)[1:] for r in E.score_metrics(df, ["q"]).collect()} == want
    for cut in (1.0, 0.9, 0.5):
        for r in E.score_metrics(df, ["q"], cuts=[1.0, 0.9, 0.5]).filter(F.col("alfa") == cut).collect():
            own = sorted((x for x in rows if x[0] == r.q), key=lambda x: (-x[3], x[2]))
            own = [x for x in own if cut == 1 or x[3] >= own[0][3] * cut]
            first = next((k for k, x in enumerate(own, 1) if x[4]), None)
            assert (r.primo, r.pertinenti, r.restituiti) == (first, sum(x[4] for x in own[:8]), len(own[:8]))
    assert E.score_metrics(df.limit(0), ["q"]).count() == 0


def test_batch_search_in_several_passes(spark, monkeypatch):
    rows = spark.createDataFrame([(k, [float(k % 7), 1.0, float(k % 3)]) for k in range(60)] + [(70, [])], "id long, vettore array<double>").repartition(3)
    asked = rows.filter("id < 20").select(F.col("id").alias("q"), "vettore")
    one = sorted(map(tuple, S.batch_search(rows, asked, 3).collect()))
    monkeypatch.setattr(S, "QUERY_BYTES", 100)
    assert sorted(map(tuple, S.batch_search(rows, asked, 3).collect())) == one and len(one) == 60
    assert S.batch_search(rows, asked.limit(0), 3).count() == 0 and S.batch_search(rows.limit(0), asked, 3).count() == 0


def test_sides_are_broadcast_only_when_small(spark):
    df = spark.range(50)
    assert "strategy=broadcast" in S.if_small(df, 50)._jdf.queryExecution().toString()
    assert "strategy=broadcast" not in S.if_small(df, 49)._jdf.queryExecution().toString()
