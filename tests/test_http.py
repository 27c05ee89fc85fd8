import json
import threading
import time
import urllib.error
import urllib.request
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from scrinium import config
from scrinium.functions.vectors import hashing_embedder
from scrinium.http import Engine, server
from scrinium.plans.incremental import Store
from scrinium.sources.embedder import Unavailable, column_embedder, query_vector


class Model(BaseHTTPRequestHandler):
    """A model server: a vector is the text's length and its number of a's."""

    sizes: list = []

    def log_message(self, *_):
        pass

    def do_POST(self):
        texts = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"]
        Model.sizes.append(len(texts))
        body = json.dumps({"embeddings": [[len(t), t.count("a")] for t in texts]}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)


@pytest.fixture
def model():
    s = HTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/"
    s.shutdown()


def test_embedder(spark, model):
    assert query_vector(model, "m", "aaaa") == pytest.approx([2**-0.5, 2**-0.5])
    df = spark.createDataFrame([(k, "b" * (k % 20) if k else None) for k in range(30)], "id int, testo string").coalesce(1)
    got = {r.id: r.v for r in df.select("id", column_embedder(model, "m")("testo").alias("v")).collect()}
    assert got[0] is None and got[20] == [0.0, 0.0] and got[5] == [1.0, 0.0] and max(Model.sizes) <= 8
    with pytest.raises(Unavailable):
        query_vector("http://127.0.0.1:9/", "m", "x")


def call(port, path, body=None, origin=None):
    request = urllib.request.Request(f"http://127.0.0.1:{port}{path}", body, {"Origin": origin} if origin else {})
    try:
        with urllib.request.urlopen(request, timeout=60) as a:
            return a.status, json.loads(a.read())
    except urllib.error.HTTPError as e:
        return e.code, json.loads(e.read())


def test_routes(spark, tmp_path):
    docs, folder = tmp_path / "docs", tmp_path / "s"
    docs.mkdir()
    folder.mkdir()
    for k in range(3):
        (docs / f"f{k}.txt").write_text(f"testo comune numero {'uno due tre'.split()[k]}")
    path = str(tmp_path / "c.json")
    config.save(path, {"radici": [str(docs)], "estensioni_attive": [".txt"], "esclusioni": []})
    embed = hashing_embedder(32)

    def one(text):
        if text == "giù adesso":
            raise Unavailable("spento")
        return spark.createDataFrame([(text,)], "t string").select(embed("t")).first()[0]

    s = server(Engine(Store(spark, str(folder)), one, embed, path), 0)
    port = s.server_port
    threading.Thread(target=s.serve_forever, daemon=True).start()
    try:
        assert call(port, "/salute") == (200, {"ok": True, "chunk": 0, "file": 0})
        assert call(port, "/api/indicizza", b"")[1] == {"avviato": True}
        for _ in range(120):
            if call(port, "/salute")[1]["file"] == 3:
                break
            time.sleep(0.5)
        found = call(port, "/cerca?q=testo%20comune%20numero%20due&n=1")[1]
        assert [r["nome"] for r in found] == ["f1.txt"]
        assert call(port, "/cerca")[0] == 400 and call(port, "/cerca?q=gi%C3%B9%20adesso")[0] == 503 and call(port, "/x")[0] == 404
        assert call(port, "/api/stato")[1]["totali"]["file"] == 3
        assert call(port, "/api/config", b"{}", "http://altrove.example")[0] == 403
        assert call(port, "/api/config", b"[1]")[0] == 400
        assert call(port, "/api/config", json.dumps({"radici": ["/x"]}).encode(), "http://localhost:1")[1]["radici"] == ["/x"]
    finally:
        s.shutdown()
