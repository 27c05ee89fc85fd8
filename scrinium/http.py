"""The query surface over HTTP, for one machine."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import functions as F

from scrinium import config, service
from scrinium.operators import catalogue as C
from scrinium.plans.incremental import Store, run
from scrinium.sources.embedder import Unavailable


class Engine:
    """A store, an embedder and a configuration; the snapshot in memory changes with the store's pointer."""

    def __init__(self, store: Store, embed: Callable[[str], list[float]], column_embed: Callable, config_path: str) -> None:
        self.store, self.embed, self.column_embed, self.config_path = store, embed, column_embed, config_path
        self._lock, self._held, self._running = threading.Lock(), None, False
        self._status: dict[str, str] = {}

    def snapshot(self):
        """(name, files, chunks, index), read anew when there is a newer snapshot; a running search keeps its own."""
        with self._lock:
            name = self.store.current()
            if self._held is None or self._held[0] != name:
                files, chunks = self.store.read("files"), self.store.read("chunks").cache()
                index = chunks.join(C.copy_key(files), "percorso")
                old, self._held = self._held, (name, files, chunks, index)
                if old:
                    old[2].unpersist()
            return self._held

    def search(self, q: str | None, n: str | None, cut: str | None) -> list[dict]:
        _, files, chunks, index = self.snapshot()
        return [r.asDict() for r in service.search(index, chunks, files, self.embed, q, n, cut).collect()]

    def health(self) -> dict:
        return C.health(self.snapshot()[2]).first().asDict()

    def state(self) -> dict:
        spark, files = self.store.spark, self.snapshot()[1]
        with self._lock:
            now = self._status | {"in_corso": str(int(self._running))}
        status = spark.createDataFrame(sorted(now.items()), "chiave string, valore string")
        active = config.load(self.config_path)["estensioni_attive"]
        known = spark.createDataFrame([(e.lstrip("."),) for e in active], "estensione string").filter(F.col("estensione") != "")
        return service.state(files, status, known) | {"config": config.load(self.config_path)}

    def index(self) -> bool:
        """Start a pass; false if one is running."""
        with self._lock:
            if self._running:
                return False
            self._running = True

        def work() -> None:
            try:
                own = config.load(self.config_path)
                counts = run(self.store, own["radici"], own["estensioni_attive"], own["esclusioni"], self.column_embed)
                outcome = {r.azione: str(r.file) for r in counts.collect()} | {"errore": ""}
            except Exception as error:  # noqa: BLE001 - a pass that fails is reported, and the next one may start
                outcome = {"errore": f"{type(error).__name__}: {error}"[:500]}
            with self._lock:
                self._status = outcome | {"ultimo_passaggio": str(time.time())}
                self._running = False

        threading.Thread(target=work, daemon=True).start()
        return True


def server(engine: Engine, port: int = 8787) -> ThreadingHTTPServer:
    """A server on this machine's own address."""

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_: object) -> None:
            pass

        def answer(self, code: int, what: object) -> None:
            body = json.dumps(what, ensure_ascii=False).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self) -> None:
            url = urlsplit(self.path)
            given = {k: v[0] for k, v in parse_qs(url.query).items()}
            try:
                if url.path == "/cerca":
                    self.answer(200, engine.search(given.get("q"), given.get("n"), given.get("stacco")))
                elif url.path == "/salute":
                    self.answer(200, {"ok": True} | engine.health())
                elif url.path == "/api/stato":
                    self.answer(200, engine.state())
                else:
                    self.answer(404, {"errore": "sconosciuto"})
            except service.BadRequest:
                self.answer(400, {"errore": "manca q"})
            except Unavailable as error:
                self.answer(503, {"errore": str(error)})

        def local(self) -> bool:
            origin = self.headers.get("Origin")
            return origin is None or urlsplit(origin).hostname in ("127.0.0.1", "localhost")

        def do_POST(self) -> None:
            if not self.local():
                self.answer(403, {"errore": "origine"})
            elif self.path == "/api/config":
                try:
                    given = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)))
                except ValueError:
                    given = None
                if isinstance(given, dict):
                    self.answer(200, config.save(engine.config_path, given))
                else:
                    self.answer(400, {"errore": "corpo"})
            elif self.path == "/api/indicizza":
                self.answer(200, {"avviato": engine.index()})
            else:
                self.answer(404, {"errore": "sconosciuto"})

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
