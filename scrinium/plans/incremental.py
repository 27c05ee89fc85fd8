"""One pass of the index over a folder of documents, as a plan over sets.

A store is a folder of snapshots, on any file system that Spark knows.  An empty file beside a snapshot says that all of
it is there; the newest such file names the current one.  Readers see a whole snapshot, and an interrupted pass changes
nothing for them.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrinium.functions.text import extractor_version, suffix, windows
from scrinium.operators import catalogue as C
from scrinium.sources import readers as R
from scrinium.sources import storage

FILES = "percorso string, mtime double, dimensione long, impronta string, n_chunk int, ocr int, visto_a double, impronta_testo string, versione string"
CHUNKS = "id long, percorso string, n int, testo string, vettore array<double>"
_DONE = "completo-"


@dataclass
class Store:
    """Snapshots below ``folder``."""

    spark: SparkSession
    folder: str

    def _complete(self) -> list[str]:
        return [n.removeprefix(_DONE) for n in storage.names(self.spark, self.folder) if n.startswith(_DONE)]

    def current(self) -> str | None:
        return max(self._complete(), default=None)

    def read(self, name: str) -> DataFrame:
        now = self.current()
        if now is None:
            return self.spark.createDataFrame([], FILES if name == "files" else CHUNKS)
        return self.spark.read.parquet(f"{self.folder}/{now}/{name}")

    def write(self, files: DataFrame, chunks: DataFrame) -> str:
        """A new snapshot, the current one as soon as all of it is there."""
        name = f"s{max(int(time.time() * 1000), int((self.current() or 's0-')[1:].split('-')[0]) + 1):016d}-{uuid.uuid4().hex[:6]}"
        files.write.parquet(f"{self.folder}/{name}/files")
        chunks.write.parquet(f"{self.folder}/{name}/chunks")
        storage.create(self.spark, f"{self.folder}/{_DONE}{name}")
        return name

    def prune(self, keep: int = 2) -> list[str]:
        """Remove all but the last ``keep`` snapshots, which a reader may still use, and what broken passes left before them; returns what went."""
        done = self._complete()
        kept = sorted(done)[-keep:]
        gone = [n for n in storage.names(self.spark, self.folder) if n.startswith("s") and "-" in n and n not in kept and kept and n < kept[-1]]
        for name in gone:
            storage.remove(self.spark, f"{self.folder}/{_DONE}{name}")
            storage.remove(self.spark, f"{self.folder}/{name}")
        return gone


def canonical(new: DataFrame, kept: DataFrame) -> DataFrame:
    """``new`` with ``gemello``: the path that holds the same text, a kept file with chunks or the first new path; null for that path itself."""
    holders = kept.filter("n_chunk > 0 AND impronta_testo <> ''").groupBy("impronta_testo").agg(F.min("percorso").alias("_k"))
    first = new.filter("impronta_testo <> ''").groupBy("impronta_testo").agg(F.min("percorso").alias("_f"))
    both = new.join(holders, "impronta_testo", "left").join(first, "impronta_testo", "left")
    chosen = F.coalesce("_k", "_f")
    return both.withColumn("gemello", F.when(chosen != F.col("percorso"), chosen)).drop("_k", "_f")


def run(
    store: Store,
    roots: list[str],
    extensions: list[str],
    rules: list[str],
    embed: Callable[[str], Column],
    complete: bool = True,
    now: float | None = None,
    readers: dict | None = None,
    recognise: Callable | None = None,
    versions: dict[str, str] | None = None,
) -> DataFrame:
    """Bring the store up to date with the files below ``roots``; returns (azione, file), the counts of the pass.

    New and changed files are read, texts that another file holds are recorded without chunks, only the others are
    embedded.  With a complete listing vanished files go, copies that lost their text are read anew, and surplus
    chunks are dropped; an incomplete one deletes nothing.
    """
    spark, now = store.spark, time.time() if now is None else now
    work = f"{store.folder}/lavoro-{uuid.uuid4().hex[:8]}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{work}/{name}")
        return spark.read.parquet(f"{work}/{name}")

    files, chunks = store.read("files"), store.read("chunks")
    listing = C.listed(R.without_packages(R.scan(spark, roots)), roots, extensions, rules)
    listing = listing.withColumn("versione", extractor_version(suffix(F.col("percorso")), R.VERSIONS if versions is None else versions))
    gone = C.vanished(files, listing) if complete else files.select("percorso").limit(0)
    survivors = files.join(gone, "percorso", "left_anti")
    action = C.classify(listing, files)
    # copies whose text vanished are read again
    lost = C.orphans(survivors).withColumn("_o", F.lit(True)) if complete else survivors.select("percorso", F.lit(True).alias("_o")).limit(0)
    action = action.join(lost, "percorso", "left").select("percorso", F.when(F.col("_o") & (F.col("azione") == C.UNCHANGED), C.CHANGED).otherwise(F.col("azione")).alias("azione"))
    action = kept(action, "azioni")
    todo = listing.join(action.filter(F.col("azione") != C.UNCHANGED), "percorso")
    read = kept(R.extract(spark, todo.select("percorso", "mtime", "dimensione"), readers, recognise), "letti")
    good = read.filter(F.col("stato").isin(R.READ, R.EMPTY))
    pieces = R.chunked(good)
    text_hash = good.select("percorso", F.when(F.col("stato") == R.EMPTY, "").otherwise(F.sha2(F.array_join(windows(F.col("testo")), ""), 256)).alias("impronta_testo"))
    new = good.drop("testo").join(text_hash, "percorso").join(listing.select("percorso", "versione"), "percorso")
    untouched = survivors.join(good.select("percorso"), "percorso", "left_anti")
    new = kept(canonical(new, untouched), "nuovi")
    own = pieces.join(new.filter("gemello IS NULL").select("percorso"), "percorso", "left_semi")
    start = chunks.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first().m
    numbered = own.withColumn("id", F.monotonically_increasing_id())
    numbered = numbered.select((F.col("id") + F.lit(start) + 1).alias("id"), "percorso", "n", "testo", embed("testo").alias("vettore"))
    fresh = kept(numbered, "chunk")
    count = fresh.groupBy("percorso").agg(F.count("*").cast("int").alias("n_chunk"))
    rows = new.join(count, "percorso", "left").select(
        "percorso", "mtime", "dimensione", "impronta", F.coalesce("n_chunk", F.lit(0)).alias("n_chunk"), F.when(F.col("gemello").isNull() & F.col("ocr"), 1).otherwise(0).alias("ocr"), F.lit(float(now)).alias("visto_a"), "impronta_testo", "versione"
    )
    all_files = C.seen_at(untouched, listing, now).unionByName(rows)
    all_chunks = chunks.join(untouched.select("percorso"), "percorso", "left_semi").unionByName(fresh)
    if complete:
        all_files, all_chunks = C.compacted(all_files, all_chunks)
    store.write(all_files.select(*[c.split()[0] for c in FILES.split(", ")]), all_chunks.select(*[c.split()[0] for c in CHUNKS.split(", ")]))
    state = action.join(read.select("percorso", "stato"), "percorso", "left").join(new.select("percorso", F.col("gemello").isNotNull().alias("copia")), "percorso", "left")
    label = F.when(F.col("azione") == C.UNCHANGED, "invariato").when(F.col("stato") == R.READ, F.when(F.col("copia"), "copia").otherwise("indicizzato")).otherwise(F.col("stato"))
    counts = state.groupBy(label.alias("azione")).agg(F.count("*").alias("file"))
    rows = counts.unionByName(gone.select(F.lit("sparito").alias("azione")).groupBy("azione").agg(F.count("*").alias("file"))).collect()  # one for each outcome
    storage.remove(spark, work)
    store.prune()
    return spark.createDataFrame(rows, counts.schema)
