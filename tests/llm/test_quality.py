import numpy as np
from pyspark.sql import functions as F

from scrinium.llm import quality as Q

PROSE = "Il perito ha verificato la relazione, e la segreteria ha inviato la copia. Dopo la riunione il notaio conferma il contratto per conto della proprietà."


def figures(spark, texts):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, frasi string")
    return {r.doc_id: r for r in Q.statistics(df, ["il", "la", "e", "di"]).collect()}


def test_figures(spark):
    f = figures(spark, [PROSE, None, "", "   ", "- la copia\n- il conto\n1. la nota", "a|b|c\nd\te\tf", "Ab1 2."])
    assert f[0].parole == 25 and f[0].quota_elenco == 0 and f[0].quota_corrente == 1 and round(f[0].quota_comuni, 6) == round(8 / 25, 6)
    assert f[1].parole is None and f[1].quota_simboli is None
    assert f[2].parole == 0 and f[2].quota_righe_punto == 0 and f[3].quota_simboli == 0
    assert f[4].quota_elenco > 0.8 and f[5].quota_tabella > 0.7
    assert f[6].lunghezza_media == 2 and round(f[6].quota_cifre, 6) == round(2 / 6, 6) and f[6].quota_righe_punto == 1


def test_rules_are_learned_and_agree_with_their_sql(spark):
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] < 0.3) & (x[:, 1] > 0.5)) | (x[:, 2] > 0.9)
    noisy = y ^ (rng.random(2000) < 0.03)
    rules = Q.learn(x, noisy)
    assert (Q.predict(rules, x) == y).mean() > 0.96
    names = ["a", "b", "c"]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:300]], "a double, b double, c double")
    assert [bool(r[0]) for r in df.select(F.expr(Q.case_sql(rules, names))).collect()] == list(Q.predict(rules, x[:300]))
    assert Q.learn(x[:0], y[:0]) == [] and Q.learn(x, np.zeros(2000, bool)) == [] and Q.case_sql([]) == "0"


def test_judgement(spark):
    junk = "Voce;Qta\n" + "\n".join(f"{k};{k * 7};{k}" for k in range(30))
    rows = [(k, PROSE + f" {k}." if k % 3 else junk + f";{k}", "x") for k in range(90)] + [(900, None, ""), (901, "", ""), (902, " \n", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, regola string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(60)] + [(0, 0), (5, 0)], "doc_id long, prosa int")
    words = spark.createDataFrame([("il",), ("la",), ("la",)], "parola string")
    judged = Q.quality(docs, labels, words)
    assert sorted(r[0] for r in Q.not_prose(judged).collect()) == [k for k in range(90) if k % 3 == 0]
    assert {r.doc_id: r.prosa for r in judged.filter("doc_id >= 900").collect()} == {900: None, 901: None, 902: None}
    assert Q.not_prose(Q.quality(docs, labels.limit(0), words)).count() == 0
    assert Q.quality(docs.limit(0), labels, words).count() == 0
