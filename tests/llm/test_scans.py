import random
from collections import Counter

import pytest

from scrinium.llm import scans as S

NOUNS = "contratto documento pagamento preventivo regolamento certificato calendario inventario magazzino bilancio".split()
VERBS = "conferma sollecita trasmette aggiorna archivia verifica rettifica sospende".split()
TAILS = ["dopo la riunione generale", "con ricevuta di ritorno", "prima della scadenza fissata", "per conto della proprietà", "secondo le tariffe vigenti"]


def sentence(rng):
    return f"Il {rng.choice(NOUNS)} {rng.choice(VERBS)} il {rng.choice(NOUNS)} {rng.choice(TAILS)}."


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(1)
    clean = [(k, f"/a/pulito{k}.txt", 0, " ".join(sentence(rng) for _ in range(12))) for k in range(300)]
    scan = "ARCHIVIO GENERALE VALNOVA\nIl contratto c0nferma il docu-\nmento dopo la riunione generale.\n- 1 -\nARCHIVIO GENERALE VALNOVA\nIl bilancio verifica il calen¬\n- 2 -\ndario secondo le tariffe vigenti.\nIl magazzino aggiorna il preventivo con ricevuta di ritorno e\nprima della scadenza fissata.\nARCHIVIO 9ENERALE VALNOVA\nCodice B8O18-I del 12/10/2012, 1.500,00 euro."
    rows = [*clean, (900, "/a/scan.pdf", 0, scan), (900, "/a/scan.pdf", 0, scan), (901, "/a/muto.pdf", 0, None), (902, "/a/vuoto.pdf", 0, "")]
    chunk = spark.createDataFrame([(*r, "x") for r in rows], "id long, percorso string, n int, testo string, tipi string")
    files = spark.createDataFrame([(p, 1.0, 1 if p.endswith(".pdf") else 0, 1.0) for p in {r[1] for r in rows}] + [("/a/scan.pdf", 0.5, None, None)], "percorso string, mtime double, ocr int, visto_a double")
    return chunk, files


def test_repair(spark, tables):
    rows = {r.id: r for r in S.repair_scans(*tables).collect()}
    assert set(rows) == {900, 902} and rows[902].testo == "" and rows[902].tipi == []
    text = rows[900].testo
    assert "conferma il documento dopo la riunione generale." in text and "il calendario secondo le tariffe vigenti." in text
    assert "VALNOVA" not in text and "- 1 -" not in text and "ritorno e prima della" in text
    assert text.endswith("Codice B8O18-I del 12/10/2012, 1.500,00 euro.")
    assert rows[900].tipi == ["glifo", "pagina", "sillabazione", "testata"]
    kinds = S.noise_kinds(S.repair_scans(*tables))
    assert kinds.count() == 4


def test_empty_tables(spark, tables):
    chunk, files = tables
    assert S.repair_scans(chunk.limit(0), files.limit(0)).count() == 0
    assert S.repair_scans(chunk.filter("id < 5"), files).count() == 0


# how the pages of these tests are misread; the editor isn't told
READ = [("o", "0"), ("rn", "m"), ("e", "c"), ("li", "h"), ("a", "@"), ("q", "g"), ("ti", "n"), ("d", "cl"), ("l", ""), ("m", "nm")]


def read(word, rng):
    sites = [(k, a, b) for a, b in READ for k in range(len(word)) if word.startswith(a, k)]
    if not sites or len(word) < 4:
        return word
    k, a, b = rng.choice(sites)
    return word[:k] + b + word[k + len(a) :]


def fitted(texts, scans):
    words, grams = Counter(w for t in texts for w in S._WORD.findall(t.lower())), Counter()
    for w in words:
        grams.update("\x00" + f"^{w}$"[k : k + 3] for k in range(len(w)))
    editor = S.Editor(S.Lexicon.of(words | grams), S.Lexicon.of(Counter(w for t in scans for w in S._WORD.findall(t.lower()))))
    unknown = sorted({w for t in scans for w in S._ATOM.findall(t) if len(w) > 3 and not editor.lexicon.known(w)})
    editor.confusions = S.learned_confusions(unknown, [w for w, c in words.items() if c == 1], [w for w, c in words.items() if c > 2 and len(w) > 3])
    editor.letters = "abcdefghilmnopqrstuvzàè"
    return S.train(texts, editor)


def test_held_out_accuracy():
    rng = random.Random(5)
    texts = [" ".join(sentence(rng) for _ in range(12)) for _ in range(400)]
    scans = [" ".join(read(w, rng) if rng.random() < 0.2 else w for w in sentence(rng).split()) for _ in range(300)]
    editor = fitted(texts[:300], scans)
    assert {(a, b) for a, own in editor.confusions.items() for b in own} >= {("0", "o"), ("c", "e"), ("cl", "d"), ("@", "a")}
    right = wrong = 0
    for t in texts[300:]:
        for w in S._ATOM.findall(t):
            noisy = read(w, rng)
            if len(w) > 3 and noisy != w and not editor.lexicon.known(noisy):
                right += editor.right(noisy) == w
                wrong += editor.right(noisy) != w
            assert editor.right(w) == w
    assert right > 0.95 * (right + wrong)
    for k in range(20):
        pages = S.noisy_pages(texts[300 + 4 * k : 304 + 4 * k], rng, editor.confusions)
        rows = S.lines_of_file(["\n".join(x for x, _, _ in pages)])[0]
        width = max(len(r.text) for r in rows)
        for i, (_, role, _) in enumerate(pages):
            if role == S.PAGE:
                assert editor.lines.best(S.line_candidates(rows, i, width)) == S.PAGE


def test_letters_that_no_confusion_names_and_long_words():
    rng = random.Random(8)
    long = "precipitevolissimevolmente" * 2
    texts = [f"{sentence(rng)} {long} {sentence(rng)}" * 6 for _ in range(60)]
    editor = fitted(texts, [])
    assert not editor.confusions
    assert editor.right("contxatto") == "contratto" and editor.right("regolmento") == "regolamento" and editor.right("inventaario") == "inventario"
    assert editor.right(long.replace("v", "b", 1)) == long


def test_alignment_finds_exchanges_of_any_letters():
    found = S.alignments(["bilaxcio", "bilncio", "bilanrcio", "moclmo"], ["bilancio", "modimo"])
    assert set(found) == {("x", "n"), ("", "a"), ("r", ""), ("cl", "di")}


def test_blocks_of_a_long_file_give_what_one_block_gives(spark, monkeypatch):
    rng = random.Random(9)
    clean = [(k, f"/a/p{k}.txt", 0, " ".join(sentence(rng) for _ in range(12))) for k in range(200)]
    head = "Verbale della riunione generale dei soci della cooperativa di produzione e lavoro di Valnova, copia conforme per l'archivio storico"
    lines = []
    for k in range(650):
        words = [f"Con atto {5 * k + j + 7000} {sentence(rng)[3:]}" for j in range(5)]
        lines += [head if k % 7 else head.replace("e", "c", 2), *(w.replace("o", "0", 1) if rng.random() < 0.1 else w for w in words[:3]), words[3][:23] + "-", words[3][23:] + " " + words[4], ["xli", "xlii"][k % 2] if k < 2 else str(k)]
    text = "\n".join(lines)
    pieces = [text[k : k + 2500] for k in range(0, len(text), 2100)]
    assert len(pieces) > 129
    scan = [(1000 + k, "/a/lungo.pdf", k, t) for k, t in enumerate(pieces)]
    odd = [(9000 + k, "/a/senza.pdf", None, t) for k, t in enumerate(pieces[:5])]
    chunk = spark.createDataFrame([*clean, *scan, *odd], "id long, percorso string, n int, testo string")
    files = spark.createDataFrame([(r[1], 1.0, 1 if r[1].endswith(".pdf") else 0, 1.0) for r in (*clean, scan[0], odd[0])], "percorso string, mtime double, ocr int, visto_a double")
    got = {}
    for block in (64, 1000):
        monkeypatch.setattr(S, "BLOCK", block)
        got[block] = {r.id: (r.testo, r.tipi) for r in S.repair_scans(chunk, files, 200).collect()}
    assert len(got[64]) == len(pieces) + 5 and got[64].keys() == got[1000].keys()
    mine = [k for k in got[64] if k < 9000]
    assert all(got[64][k][1] == got[1000][k][1] for k in mine)
    # a line that a piece's end cuts off may be held against lines more than a block away
    assert sum(got[64][k] != got[1000][k] for k in mine) < 0.1 * len(mine)
    assert sum(head not in got[64][1000 + k][0] for k in range(1, 120)) > 115
    assert "testata" in got[64][1064][1] and "pagina" in got[64][1064][1]


def test_perceptron_learns():
    p = S.Perceptron()
    data = [([["a", f"x{k % 2}"], ["b", f"y{k % 2}"]], {k % 2}) for k in range(20)]
    for _ in range(5):
        for c, r in data:
            p.learn(c, r)
    p.average()
    assert all(p.best(c) in r for c, r in data)


def test_page_numbers():
    assert [S.page_number(x) and S.page_number(x)[1] for x in ("12", "- 3 -", "[4]", "pag. 5", "Pagina 6 di 9", "7/9", "Foglio 8", "xiv", "xlii", "MCMXC", "12345", "Art. 4", "2 euro", "")] == [12, 3, 4, 5, 6, 7, 8, 14, 42, 1990, 12345, None, None, None]
    assert S.header_part("Riservato - copia per X | pag. 3") == ("Riservato - copia per X", True)
    assert S.header_part("Nome / Altro | xiv") == ("Nome / Altro", True)
    assert S.header_part("Verbale di assemblea") == ("Verbale di assemblea", False)


def test_unseen_words_are_unknown_whatever_the_vocabulary(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuvz") for _ in range(9))
    rows = [[word() for _ in range(2_000)] for _ in range(200)]
    lexicon = S.word_levels(S.word_counts(spark.createDataFrame([(" ".join(r),) for r in rows], "testo string")))
    have = {w for r in rows for w in r}
    assert all(lexicon.known(w) for w in rows[7])
    assert not [w for w in (word() for _ in range(5_000)) if w not in have and lexicon.known(w)]
    empty = S.word_levels(S.word_counts(spark.createDataFrame([], "testo string")))
    assert empty.known("parola") == 0


def test_header_misread_differently_on_each_page():
    for one, two in (("Lioridderra / Lirtgrertsso", "Liondderra / Lirtgrertsso"), ("Milri / Vospronri", "Milri / Vosproriri"), ("Verna8e", "Vernage")):
        rows = S.lines_of_file([f"{one}\nIl contratto conferma il documento.\nPoi il bilancio.\nAltro ancora.\n1\n{two}\nQuesto calendario verifica.\n2"])[0]
        assert [r.repeated for r in rows if r.text in (one, two)] == [2, 2]
        assert [r.repeated for r in rows if r.text.startswith(("Il", "Poi", "Questo"))] == [1, 1, 1]
    rows = S.lines_of_file(["Voce tredici articolo A\nVoce tredici articolo B\nfine"])[0]
    assert [r.repeated for r in rows] == [1, 1, 1]


def test_words_are_aligned_by_a_join_as_on_the_driver(spark):
    known = ["bilancio", "modimo", "contratto", "preventivo", "magazzino", "canto", "conto", "b1lancia"]
    unknown = ["bilaxcio", "Bilaxcio", "bilncio", "MAGA77INO", "c0ntratto", "prevent1vo", "c0nto", "m0dimo", "b1lancio", "moclmo", "bilanci0", "magazzin0", "cantto", "xyz"]
    rare = ["contatto", "bilancia", "conti", "modino"]
    table = lambda words: spark.createDataFrame([(w, w if w.isupper() else w.lower()) for w in words], "key string, w string")
    own = [r.w for r in table(unknown).collect()]
    aligned = {(r.read, r.right): r.n for r in S.joined_alignments(table(unknown), spark.createDataFrame([(w,) for w in known], "w string")).collect()}
    assert aligned == {k: pytest.approx(n, abs=1e-5) for k, n in S.alignments(own, known).items()}
    found = S.joined_confusions(table(unknown), table(rare), table(known).select("w"))
    assert found == S.learned_confusions(own, rare, known) and found["0"]["o"] >= 3


def test_all_clean_rows_train_the_editor(spark, tables):
    chunk, files = tables
    clean, scanned = chunk.filter("id < 900"), chunk.filter("id >= 900 AND testo IS NOT NULL")
    few, all_ = (S.fitted_editor(clean.filter(f"id < {n}"), scanned, 50) for n in (50, 300))
    # six times the rows, once each instead of three times
    assert all_.lines.examples > 1.5 * few.lines.examples and all_.ends.examples > 1.5 * few.ends.examples
    assert all_.characters.weights and all_.letters == few.letters
    assert {r.id: r.tipi for r in S.repair_scans(chunk, files, 50).collect()}[900] == ["glifo", "pagina", "sillabazione", "testata"]


def test_numbered_features_learn_what_named_ones_do():
    rng = random.Random(3)
    data = []
    for _ in range(400):
        candidates = [[f"{k} {rng.randrange(9)}" for _ in range(rng.randint(2, 5))] for k in range(rng.randint(2, 4))]
        data.append((candidates, {rng.randrange(len(candidates))} | ({0} if rng.random() < 0.2 else set())))
    one, other, mixed, order = S.Perceptron(), S.Perceptron(), list(data), random.Random(4)
    for _ in range(3):
        order.shuffle(mixed)
        for candidates, right in mixed:
            one.learn(candidates, right)
    one.average()
    other.learn_all(data, 3, random.Random(4))
    assert other.weights == one.weights and other.examples == 400


def test_few_candidates_are_looked_up_and_no_known_word_is_lost(monkeypatch):
    rng = random.Random(11)
    texts = [" ".join(sentence(rng) for _ in range(12)) for _ in range(100)]
    lexicon, letters = fitted(texts, []).lexicon, "abcdefghilmnopqrstuvzàè"
    words = [w for w in NOUNS + VERBS + ["Regolamento", "MAGAZZINO"] for _ in range(4)]
    words = [w[:k] + rng.choice(["", "x", "|", "0", w[k] * 2]) + w[k + 1 :] for w in words for k in (rng.randrange(len(w)),)] + ["Σontratto", "İnventario"]
    whole = {}
    for w in words:
        plans = [(k, w[k], c) for k in range(len(w)) for c in letters if c != w[k]] + [(k, w[k], "") for k in range(len(w))] + [(k, "", c) for k in range(len(w) + 1) for c in letters]
        level = lexicon.levels([S.apply(w, p).lower() for p in plans])
        whole[w] = [p for p, n in zip(plans, level, strict=True) if n >= 16]
    assert {w: S.other_edits(w, lexicon, letters) for w in words} == whole and sum(map(bool, whole.values())) > 40
    asked = []
    levels = S.Lexicon.levels
    monkeypatch.setattr(S.Lexicon, "levels", lambda self, own: asked.append(len(own)) or levels(self, own))
    for w in words[:-2]:
        S.other_edits(w, lexicon, letters)
    assert sum(asked) < 60 * len(words)  # over 400 a word, were all listed


def test_lines_are_compared_by_bounds_that_lose_none(monkeypatch):
    rng = random.Random(12)
    calls = []
    common = S._common
    monkeypatch.setattr(S, "_common", lambda a, b: calls.append(1) or common(a, b))
    plain = list(dict.fromkeys(f"{rng.choice(NOUNS)} {rng.choice(VERBS)} {rng.choice(TAILS)} {rng.choice(NOUNS)} {rng.choice(VERBS)}" for _ in range(150)))
    S.lines_of_file(["\n".join(plain[:120])])
    assert len(calls) < 120  # several a line before
    monkeypatch.undo()
    files = []
    for _ in range(12):
        lines = [x * rng.choice((1, 1, 2)) for x in rng.sample(plain, 12)]
        lines += [S.misread(x, rng, {"c": {"e": 3}, "m": {"rn": 3}}, "abcdeфß", rng.randint(1, 9)) for x in lines] + ["\U0001f600 uno due", "a" * 70 + "b" * 60, "a" * 66 + "b" * 60]
        files.append(lines)
    found = S._near([(x[5:], x) for x in files] + [([], []), (["solo"], [])])
    assert [{(a, b) for a, own in near.items() for b in own if S._similar(a, b)} for near in found[:12]] == [{(a, b) for a in x[5:] for b in x if a != b and abs(len(a) - len(b)) <= 4 and S._similar(a, b)} for x in files]
    assert found[12:] == [{}, {}]
    texts = [["\n".join(x[:14]), "\n".join(x[14:])] for x in files]
    assert S.lines_of_files(texts) == [S.lines_of_file(t) for t in texts]
    assert all(S._folded(x) == S.re.sub(r"[^\w]+", " ", x.lower().translate(S._FOLD)).strip() for x in [*map(chr, range(3000)), "È 5¬ – x", "  [12] (Ì)­ |a", "Å b\u0085c"])
    assert all(S.header_part(x) == ((m[1], True) if (m := S._TAIL.match(x)) else (x, False)) for x in ["Atti | 3", "Atti  xiv", "Atti\tpag. 3", "Atti - 3", "Atti – [3]", "Atti – 12 di 14", "Atti xiv", "Atti di", "A 3", "Atti | İ", "x | ٣", "", "|", "Atti · — 3 —"])


def test_pages_hold_all_words_in_order():
    rng = random.Random(13)
    for k in range(40):
        texts = ["\n".join(" ".join(sentence(rng) if rng.random() < 0.8 else "auto-moto " + "z" * rng.randint(1, 120) for _ in range(rng.randint(0, 4))) for _ in range(5)) + " fine" for _ in range(3)]
        pages = S.noisy_pages(texts, random.Random(k), {})
        body = "".join(x[: -(end == S.JOIN) or None] + ("" if end in (S.JOIN, -1) else " ") for x, role, end in pages if role == S.TEXT).split()
        rest = iter(body)
        assert all(w in rest for t in texts for w in t.split())


def test_words_are_counted_as_found_in_the_whole_text(spark):
    texts = ["Il contratto, l'atto; l'atto e_il co- ntratto  ΟΔΟΣ ΟΔΟΣ, x\x1cy", "l'atto è qui", None, ""]
    rows = S.word_counts(spark.createDataFrame([(t,) for t in texts], "testo string")).collect()
    assert {r.w: r.c for r in rows if r.w} == Counter(w for t in texts if t for w in S._WORD.findall(t.lower()))
