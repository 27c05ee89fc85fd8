"""The query surface: parameters as strings in, JSON out."""

from __future__ import annotations

import argparse
import json
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrinium.operators import catalogue as C
from scrinium.operators import search as S


class BadRequest(ValueError):
    """A parameter is missing or wrong."""


def number(text: object, default: float) -> float:
    """A float, or the default where ``text`` is none. ``nan`` is a number and empties the result."""
    try:
        return float(str(text))
    except ValueError:
        return default


def search(index: DataFrame, chunks: DataFrame, files: DataFrame, embed: Callable[[str], list[float]], q: str | None, n: object = None, stacco: object = None) -> DataFrame:
    """The search as a client asks it: the identifier rule first, else the dense ranking with its cut."""
    text = (q or "").strip()
    if len(text) < 2:
        raise BadRequest("q")
    cut = S.CUT if stacco is None else number(stacco, S.CUT)
    only = None
    if 1 <= len(S.query_terms(text)) <= S.MOST_TERMS:
        found = S.identifier_files(chunks, files, text)
        only = found if found.limit(1).count() else None
    copies = C.copies_per_text(files).select(F.col("impronta_testo").alias("chiave"), "copie")
    result = S.dense_search(index, embed(text), S.result_limit(n), cut, copies, only)
    return result.limit(0) if math.isnan(cut) else result


def as_json(rows: DataFrame) -> DataFrame:
    """Each row as one JSON object."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json"))


def state(files: DataFrame, status: DataFrame, extensions: DataFrame) -> dict:
    """Everything the panel shows: one row for each extension, whatever their number."""
    total = C.totals(files).first().asDict()
    return {
        "stato": {r.chiave: r.valore for r in status.collect()},
        "totali": total | {"duplicati": C.duplicate_count(files).first()[0]},
        "estensioni": [r.asDict() for r in C.extension_statistics(files).collect()],
        "attive": [r.asDict() for r in C.extension_activity(files, extensions).collect()],
        "piu_grandi": [r.asDict() for r in C.largest(files).collect()],
    }


def _lines(rows: DataFrame) -> None:
    for line in as_json(rows).toLocalIterator():
        print(json.dumps(json.loads(line.json), ensure_ascii=False))


def main(args: list[str] | None = None) -> int:
    """Commands:

    query FOLDER NAME [--n N]: all rows of a registered query as JSON lines, or the first N
    index STORE CONFIG: bring a store up to date with the folders of a configuration
    search STORE TEXT [--n N] [--cut C]: search a store
    serve STORE CONFIG [--port P]: the same over HTTP

    The last three embed by a model server (--url, --model), or by hashed words without one.
    """
    from scrinium import config
    from scrinium.functions.vectors import hashing_embedder
    from scrinium.plans.incremental import Store, run
    from scrinium.registry import queries
    from scrinium.sources.embedder import column_embedder, query_vector

    parser = argparse.ArgumentParser(prog="scrinium", description=main.__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, places in (("query", ("folder", "name")), ("index", ("store", "config")), ("search", ("store", "text")), ("serve", ("store", "config"))):
        own = commands.add_parser(name)
        for place in places:
            own.add_argument(place, **({"choices": sorted(queries())} if place == "name" else {}))
        own.add_argument("--n", type=int if name == "query" else str, default=None)
        own.add_argument("--cut", default=None)
        own.add_argument("--url", default=None)
        own.add_argument("--model", default="bge-m3")
        own.add_argument("--port", type=int, default=8787)
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("scrinium").getOrCreate()
    if given.command == "query":
        rows = queries()[given.name](spark, given.folder)
        _lines(rows if given.n is None else rows.limit(given.n))
        return 0
    column = column_embedder(given.url, given.model) if given.url else hashing_embedder(256)
    one = (lambda t: query_vector(given.url, given.model, t)) if given.url else (lambda t: spark.createDataFrame([(t,)], "t string").select(column("t").alias("v")).first().v)
    store = Store(spark, given.store)
    if given.command == "index":
        own = config.load(given.config)
        _lines(run(store, own["radici"], own["estensioni_attive"], own["esclusioni"], column))
    elif given.command == "search":
        files, chunks = store.read("files"), store.read("chunks")
        _lines(search(chunks.join(C.copy_key(files), "percorso"), chunks, files, one, given.text, given.n, given.cut))
    else:
        from scrinium.http import Engine, server

        server(Engine(store, one, column, given.config), given.port).serve_forever()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
