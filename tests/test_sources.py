import io
import json
import zipfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrinium import config, service
from scrinium.functions.vectors import hashing_embedder
from scrinium.plans.incremental import Store, run
from scrinium.sources import legacy
from scrinium.sources import readers as R

MAIL = b"""From: a@x.example\r\nTo: b@x.example\r\nSubject: =?utf-8?q?perch=C3=A9?=\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=Q\r\n\r\n--Q\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<p>Ciao&nbsp;a tutti</p><style>x</style>\r\n--Q\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment; filename="conto.pdf"\r\n\r\nx\r\n--Q--\r\n"""


def office(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


W = "xmlns:w='w'"
DOCX = office(**{"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>uno</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>due</w:t></w:r></w:p></w:body></w:document>"})
XLSX = office(**{
    "xl/workbook.xml": "<workbook xmlns:r='r'><sheets><sheet name='Conti' r:id='i1'/></sheets></workbook>",
    "xl/_rels/workbook.xml.rels": "<R><x Id='i1' Target='worksheets/foglio.xml'/></R>",
    "xl/sharedStrings.xml": "<sst><si><t>voce</t></si></sst>",
    "xl/worksheets/foglio.xml": "<ws><row><c t='s'><v>0</v></c><c/><c><v>3.5</v></c></row><row><c/></row></ws>",
})
PPTX = office(**{"ppt/slides/slide2.xml": "<s xmlns:a='a'><spTree><sp><txBody><a:p><a:t>B</a:t></a:p></txBody></sp></spTree></s>", "ppt/slides/slide1.xml": "<s xmlns:a='a'><spTree><sp><txBody><a:p><a:t>A</a:t></a:p></txBody></sp><graphicFrame/></spTree></s>"})


@pytest.mark.parametrize(
    ("ext", "content", "text"),
    [
        (".txt", b"a\xffb", "a�b"),
        (".csv", b"a;b", "a;b"),
        (".xml", b"<a> x <b>y</b>\n</a>", "x\ny"),
        (".xml", b"<a>x", " x"),
        (".html", b"<b>x</b>&lt;", " x <"),
        (".docx", DOCX, "uno\ndue\na | b"),
        (".xlsx", XLSX, "# foglio: Conti\nvoce | 3.5"),
        (".pptx", PPTX, "A\nB"),
    ],
)
def test_readers(ext, content, text):
    assert R.read_one(ext, content, R.READERS, None) == (text, False, R.READ)


def test_mail():
    text, _, _ = R.read_one(".eml", MAIL, R.READERS, None)
    assert text.startswith("From: a@x.example\nTo: b@x.example\nSubject: perché\n") and "Ciao\xa0a tutti" in text and text.endswith("\nallegati: conto.pdf")


def test_states_of_unreadable_files():
    assert R.read_one(".docx", b"broken", R.READERS, None)[2] == R.UNREADABLE
    assert R.read_one(".bin", b"", R.READERS, None)[2] == R.UNSUPPORTED
    assert R.read_one(".png", b"", R.READERS, None)[2] == R.DEFERRED
    assert R.read_one(".png", b"", R.READERS, lambda c, e: "testo")[:2] == ("testo", True)


def test_prose_strings():
    assert R.prose_strings({"a": ["una frase", {"b": "TSP.Archive"}], "c": ("altra frase", "una frase")}) == ["una frase", "altra frase"]


def test_incremental_pass_equals_rebuild(spark, tmp_path):
    docs = tmp_path / "docs"
    (docs / "sub").mkdir(parents=True)
    (docs / ".hidden").mkdir()
    (docs / "pacco").mkdir()
    (docs / "a.txt").write_text("alfa beta\n\n gamma")
    (docs / "sub/copia.txt").write_text("alfa beta\ngamma")
    (docs / "vuoto.txt").write_text(" \n")
    (docs / "lungo.md").write_text("parola " * 900)
    (docs / "img.png").write_bytes(b"x")
    (docs / ".hidden/x.txt").write_text("no")
    (docs / "pacco/[Content_Types].xml").write_text("<a/>")
    (docs / "pacco/x.txt").write_text("no")
    embed = hashing_embedder(8)
    how = dict(roots=[str(docs)], extensions=["txt", "md", "png"], rules=["~$*"], embed=embed)
    (tmp_path / "s").mkdir()
    store = Store(spark, str(tmp_path / "s"))
    assert dict(run(store, now=1.0, **how).collect()) == {"indicizzato": 2, "copia": 1, "vuoto": 1, "rimandato": 1}
    assert dict(run(store, now=2.0, **how).collect()) == {"invariato": 4, "rimandato": 1}

    def content(s):
        own = s.read("chunks").select("percorso", "n", "testo")
        return sorted(map(tuple, own.collect())), sorted(map(tuple, s.read("files").select("percorso", "n_chunk", "impronta_testo", "impronta").collect()))

    # the text's holder vanishes: its copy is read and takes over; a file changes; another comes
    (docs / "a.txt").unlink()
    (docs / "lungo.md").write_text("altro testo")
    (docs / "nuovo.txt").write_text("nuovo testo")
    before = content(store)
    run(store, complete=False, now=3.0, **how)
    assert any(p.endswith("/a.txt") for p, *_ in content(store)[1]) and before != content(store)
    counts = dict(run(store, now=4.0, **how).collect())
    assert counts["sparito"] == 1
    (tmp_path / "t").mkdir()
    fresh = Store(spark, str(tmp_path / "t"))
    run(fresh, now=5.0, **how)
    assert content(store) == content(fresh)
    left = sorted(p.name for p in (tmp_path / "s").iterdir())
    assert len([n for n in left if n.startswith("s")]) == 2 and not [n for n in left if n.startswith("lavoro")]


def test_legacy_index(spark, tmp_path):
    np.save(tmp_path / "i.npy", np.eye(3, dtype="f4"))
    lines = [json.dumps({"path": f"/{k}", "testo": "t", "nome": "n", **({"impronta": "z"} if k else {})}) for k in range(3)]
    (tmp_path / "i.meta.jsonl").write_text("\n".join(lines) + "\n")
    rows = legacy.load_index(spark, str(tmp_path / "i"), 2).orderBy("id").collect()
    assert [(r.percorso, r.chiave, r.vettore.index(1.0)) for r in rows] == [("/0", "/0", 0), ("/1", "z", 1), ("/2", "z", 2)]
    (tmp_path / "i.meta.jsonl").write_text("\n".join(lines[:2]))
    with pytest.raises(ValueError):
        legacy.load_index(spark, str(tmp_path / "i"))


def test_config(tmp_path):
    p = tmp_path / "c.json"
    assert config.load(p) == config.DEFAULTS
    p.write_text("{broken")
    assert config.load(p) == config.DEFAULTS
    config.save(p, {"radici": ["/x"], "altro": [1]})
    assert config.load(p)["radici"] == ["/x"] and "altro" not in json.loads(p.read_text())
    (tmp_path / "ignora").write_text("# c\n\nx/\n y \n")
    assert config.ignore_rules(tmp_path / "ignora", ["y", "z"]) == ["x/", "y", "z"]


def test_service(spark):
    with pytest.raises(service.BadRequest):
        service.search(None, None, None, None, " a ")
    index = spark.createDataFrame([(k, f"/f{k}", "testo comune", f"k{k}", [1.0, k / 10]) for k in range(5)], "id long, percorso string, testo string, chiave string, vettore array<double>")
    files = spark.createDataFrame([(f"/f{k}", f"k{k}", 1, 0) for k in range(5)], "percorso string, impronta_testo string, n_chunk int, ocr int")
    found = service.search(index, index, files, lambda q: [1.0, 0.0], "testo", "2", "0.5").collect()
    assert [r.path for r in found] == ["/f0", "/f1"]
    assert service.search(index, index, files, lambda q: [1.0, 0.0], "testo", None, "nan").count() == 0
    assert json.loads(service.as_json(files.limit(1)).first().json)["percorso"] == "/f0"
    state = service.state(files, spark.createDataFrame([("a", "b")], "chiave string, valore string"), spark.createDataFrame([("pdf",)], "estensione string"))
    assert state["totali"]["file"] == 5 and state["stato"] == {"a": "b"}


def test_followed_catalogue(spark, tmp_path):
    from scrinium.streaming.watch import follow_catalogue, recent_searches

    schema = "percorso string, mtime double, dimensione long, impronta string, n_chunk int, ocr int, visto_a double, impronta_testo string, versione string"
    spark.createDataFrame([("a", 1.0, 1, "", 0, 0, 1.0, "", "1")], schema).write.parquet(str(tmp_path / "in/1"))
    for late in (None, [("a", 2.0, 1, "", 0, 0, 2.0, "", "1"), ("b", 1.0, 1, "", 0, 0, 1.0, "", "1")], [("a", 1.5, 1, "", 0, 0, 1.5, "", "1")]):
        if late:
            spark.createDataFrame(late, schema).write.mode("append").parquet(str(tmp_path / "in/1"))
        follow_catalogue(spark, str(tmp_path / "in/1"), schema, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    last = sorted(Path(tmp_path / "out").iterdir())[-1]
    assert {(r.percorso, r.mtime) for r in spark.read.parquet(str(last)).collect()} == {("a", 2.0), ("b", 1.0)}
    rows = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (1, "2024-01-01 10:00:00"), (2, "2024-01-02 10:00:00")], "ricerca_id long, t string").select("ricerca_id", F.to_timestamp("t").alias("chiesto_a"))
    rows.write.parquet(str(tmp_path / "s"))
    q = recent_searches(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "s"))).writeStream.format("memory").queryName("cercate").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.ricerche for r in spark.table("cercate").collect()) == [1, 1]


def _archive(parts):
    import io
    import zipfile

    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return held.getvalue()


def test_office_text_keeps_tabs_breaks_dates_and_order(spark, tmp_path):
    w = 'xmlns:w="urn:w"'
    word = _archive({"word/document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:tabs><w:tab w:val="left"/></w:tabs></w:pPr><w:r><w:t>Nome</w:t><w:tab/><w:t>Cognome</w:t><w:br/><w:t>Via</w:t></w:r></w:p></w:body></w:document>'})
    assert R.word(word) == "Nome\tCognome\nVia"
    sheet = '<worksheet><sheetData><row><c s="1"><v>44197</v></c><c s="2"><v>44197.5</v></c><c s="0"><v>44197</v></c><c s="2"><v>0.25</v></c><c t="inlineStr"><is><t>a</t></is></c></row></sheetData></worksheet>'
    styles = '<styleSheet><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy hh:mm"/><numFmt numFmtId="171" formatCode="0.0 &quot;mesi&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>'
    book = _archive({"xl/workbook.xml": '<workbook><sheets><sheet name="Uno"/></sheets></workbook>', "xl/worksheets/sheet1.xml": sheet, "xl/styles.xml": styles})
    assert R.sheets(book) == "# foglio: Uno\n2021-01-01 00:00:00 | 2021-01-01 12:00:00 | 44197 | 06:00:00 | a"
    slide = "<p:sld xmlns:p='urn:p' xmlns:a='urn:a'><p:spTree><p:sp><p:txBody><a:p><a:r><a:t>{0}</a:t></a:r><a:br/><a:r><a:t>sotto</a:t></a:r></a:p></p:txBody></p:sp></p:spTree></p:sld>"
    rels = '<Relationships><Relationship Id="r1" Target="slides/slide1.xml"/><Relationship Id="r2" Target="slides/slide2.xml"/></Relationships>'
    deck = _archive({"ppt/slides/slide1.xml": slide.format("prima"), "ppt/slides/slide2.xml": slide.format("seconda"), "ppt/presentation.xml": '<p:presentation xmlns:p="urn:p" xmlns:r="urn:r"><p:sldIdLst><p:sldId id="256" r:id="r2"/><p:sldId id="257" r:id="r1"/></p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": rels})
    assert R.slides(deck) == "seconda\nsotto\nprima\nsotto"
    # through a plan, and by a path with a scheme
    for name, content in (("a.docx", word), ("b.xlsx", book), ("c.pptx", deck)):
        (tmp_path / name).write_bytes(content)
    paths = spark.createDataFrame([(f"file://{tmp_path}/{n}", 0.0, 1) for n in ("a.docx", "b.xlsx", "c.pptx", "manca.txt")], "percorso string, mtime double, dimensione long")
    got = {r.percorso.rsplit("/", 1)[1]: (r.stato, r.testo) for r in R.extract(spark, paths).collect()}
    assert got["a.docx"] == (R.READ, "Nome\tCognome\nVia") and got["c.pptx"] == (R.READ, "seconda\nsotto\nprima\nsotto") and got["b.xlsx"][0] == R.READ and got["manca.txt"][0] == R.UNREADABLE


def test_state_has_every_extension_and_a_query_all_rows(spark, tmp_path, capsys):
    from scrinium import registry, service

    rows = [(f"/a/f.e{k}", 1.0, 1, "h", 1, 0, 1.0, "", "1") for k in range(1500)]
    files = spark.createDataFrame(rows, "percorso string, mtime double, dimensione long, impronta string, n_chunk int, ocr int, visto_a double, impronta_testo string, versione string")
    status = spark.createDataFrame([("in_corso", "0")], "chiave string, valore string")
    state = service.state(files, status, spark.createDataFrame([("txt",)], "estensione string"))
    assert len(state["estensioni"]) == 1500 and len(state["attive"]) == 1501
    spark.createDataFrame([(f"k{k}", "v") for k in range(60)], "chiave string, valore string").write.parquet(f"{tmp_path}/stato.parquet")
    assert service.main(["query", str(tmp_path), "status"]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 60
    assert service.main(["query", str(tmp_path), "status", "--n", "7"]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 7 and "status" in registry.queries()


def test_commands_index_and_search(spark, tmp_path, capsys):
    import json

    from scrinium import service

    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.txt").write_text("il contratto di locazione")
    (tmp_path / "docs" / "b.txt").write_text("ricetta della torta")
    (tmp_path / "c.json").write_text(json.dumps({"radici": [str(tmp_path / "docs")], "estensioni_attive": [".txt"], "esclusioni": []}))
    assert service.main(["index", str(tmp_path / "store"), str(tmp_path / "c.json")]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"azione": "indicizzato", "file": 2}
    assert service.main(["search", str(tmp_path / "store"), "contratto di locazione"]) == 0
    assert [json.loads(x)["nome"] for x in capsys.readouterr().out.splitlines()] == ["a.txt"]
