"""The catalogue of files and its chunks: state, changes, copies, statistics."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrinium.functions.text import basename, effective_key, glob_regex, path_extension, suffix

NEW, CHANGED, UNCHANGED = "nuovo", "cambiato", "invariato"


def latest(files: DataFrame) -> DataFrame:
    """One row for each path: what was seen last (upsert by path). Null paths are dropped, ties go to the larger mtime, size, hash."""
    last = Window.partitionBy("percorso").orderBy(*[F.col(c).desc_nulls_last() for c in ("visto_a", "mtime", "dimensione", "impronta", "n_chunk", "ocr")])
    return files.filter("percorso IS NOT NULL").withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r")


def earliest(files: DataFrame) -> DataFrame:
    """One row for each path: the oldest state that is known."""
    first = Window.partitionBy("percorso").orderBy(*[F.col(c).asc_nulls_last() for c in ("mtime", "visto_a", "dimensione", "impronta", "n_chunk", "ocr")])
    return files.filter("percorso IS NOT NULL").withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")


def chunks_once(chunks: DataFrame) -> DataFrame:
    """Chunks without repeated rows; one row for each id."""
    return chunks.dropDuplicates(["id"])


def needs_redo(old_mtime: Column, new_mtime: Column, old_size: Column, new_size: Column, old_version: Column, new_version: Column) -> Column:
    return (F.abs(old_mtime - new_mtime) > 1e-6) | (old_size != new_size) | (old_version != new_version)


def classify(listing: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(percorso, azione) of each listed path: new, changed or unchanged, by time, size and reader's version; one left join."""
    old = catalogue.select("percorso", F.col("mtime").alias("_m"), F.col("dimensione").alias("_d"), F.coalesce("versione", F.lit("1")).alias("_v"), F.lit(True).alias("_k"))
    redo = F.coalesce(needs_redo(F.col("_m"), F.col("mtime"), F.col("_d"), F.col("dimensione"), F.col("_v"), F.coalesce("versione", F.lit("1"))), F.lit(True))
    return listing.join(old, "percorso", "left").select("percorso", F.when(F.col("_k").isNull(), NEW).when(redo, CHANGED).otherwise(UNCHANGED).alias("azione"))


def vanished(catalogue: DataFrame, listing: DataFrame) -> DataFrame:
    """Catalogued paths that the listing lacks. Only for a complete listing: an interrupted one must delete nothing."""
    return catalogue.select("percorso").join(listing.select("percorso"), "percorso", "left_anti").distinct()


def without_files(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """Chunks whose file is still there (cascade)."""
    return chunks.join(gone.select("percorso").distinct(), "percorso", "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def seen_at(catalogue: DataFrame, seen: DataFrame, when: float) -> DataFrame:
    """The catalogue with ``visto_a`` set for seen paths."""
    mark = seen.select("percorso").distinct().withColumn("_s", F.lit(True))
    return catalogue.join(mark, "percorso", "left").withColumn("visto_a", F.when(F.col("_s"), F.lit(float(when))).otherwise(F.col("visto_a"))).drop("_s")


def replace_file_chunks(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks with those of every file in ``new`` replaced."""
    return chunks.join(new.select("percorso").distinct(), "percorso", "left_anti").unionByName(new)


def copies_per_text(catalogue: DataFrame) -> DataFrame:
    """(impronta_testo, copie) of texts that several files have."""
    return catalogue.filter("impronta_testo <> ''").groupBy("impronta_testo").agg(F.count("*").alias("copie")).filter("copie > 1")


def duplicate_groups(catalogue: DataFrame) -> DataFrame:
    """The same among files that hold chunks."""
    return copies_per_text(catalogue.filter("n_chunk > 0"))


def duplicate_count(catalogue: DataFrame) -> DataFrame:
    return duplicate_groups(catalogue).agg(F.count("*").alias("gruppi"))


def orphans(catalogue: DataFrame) -> DataFrame:
    """Copies without chunks whose text no file holds any more."""
    empty = catalogue.filter("n_chunk = 0 AND impronta_testo <> ''").select("percorso", "impronta_testo")
    return empty.join(catalogue.filter("n_chunk > 0").select("impronta_testo"), "impronta_testo", "left_anti").select("percorso")


def twins(catalogue: DataFrame) -> DataFrame:
    """(percorso, gemello): for each file the first other file that holds chunks of the same text. Two smallest paths suffice, so a hot text is aggregated, not joined with itself."""
    holders = catalogue.filter("n_chunk > 0 AND impronta_testo <> ''").select("impronta_testo", "percorso")
    first = holders.groupBy("impronta_testo").agg(F.min("percorso").alias("a"))
    second = holders.join(first, "impronta_testo").filter("percorso <> a").groupBy("impronta_testo").agg(F.min("percorso").alias("b"))
    found = catalogue.filter("impronta_testo <> ''").select("percorso", "impronta_testo").join(first, "impronta_testo").join(second, "impronta_testo", "left")
    return found.select("percorso", F.when(F.col("percorso") != F.col("a"), F.col("a")).otherwise(F.col("b")).alias("gemello")).filter("gemello IS NOT NULL")


def compaction_plan(catalogue: DataFrame) -> DataFrame:
    """(percorso) of files whose chunks go, since a file with a smaller path holds the same text."""
    holders = catalogue.filter("n_chunk > 0 AND impronta_testo <> ''").select("impronta_testo", "percorso")
    return holders.join(holders.groupBy("impronta_testo").agg(F.min("percorso").alias("tiene")), "impronta_testo").filter("percorso <> tiene").select("percorso")


def compacted(catalogue: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Catalogue and chunks after compaction."""
    surplus = compaction_plan(catalogue)
    mark = surplus.withColumn("_s", F.lit(True))
    files = catalogue.join(mark, "percorso", "left").withColumn("n_chunk", F.when(F.col("_s"), 0).otherwise(F.col("n_chunk"))).drop("_s")
    return files, without_files(chunks, surplus)


def text_hashes(chunks: DataFrame) -> DataFrame:
    """(percorso, impronta_testo): SHA-256 of a file's chunk texts in order, overlaps included.

    Chunks are sorted by file and streamed through the hash, so a file of any length takes no memory; the hash itself
    is sequential.  Null texts count as empty, repeated rows once.
    """
    rows = chunks_once(chunks.select("id", "percorso", "n", "testo")).filter("percorso IS NOT NULL")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, state = None, hashlib.sha256()
        names = ["percorso", "impronta_testo"]
        for batch in batches:
            done: list[tuple[str, str]] = []
            for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if p != path:
                    if path is not None:
                        done.append((path, state.hexdigest()))
                    path, state = p, hashlib.sha256()
                state.update((t or "").encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string()) for k in (0, 1)], names=names)
        if path is not None:
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([state.hexdigest()])], names=names)

    return rows.repartition("percorso").sortWithinPartitions("percorso", "n", "id").select("percorso", "testo").mapInArrow(work, "percorso string, impronta_testo string")


def totals(catalogue: DataFrame) -> DataFrame:
    return catalogue.agg(F.count("*").alias("file"), F.coalesce(F.sum("n_chunk"), F.lit(0)).alias("chunk"), F.count_if(F.col("ocr") == 1).alias("ocr"))


def extension_statistics(catalogue: DataFrame) -> DataFrame:
    """(estensione, file, chunk, ocr), the most frequent first."""
    grouped = catalogue.groupBy(path_extension(F.col("percorso")).alias("estensione"))
    return grouped.agg(F.count("*").alias("file"), F.coalesce(F.sum("n_chunk"), F.lit(0)).alias("chunk"), F.count_if(F.col("ocr") == 1).alias("ocr")).orderBy(F.desc("file"), "estensione")


def extension_activity(catalogue: DataFrame, active: DataFrame) -> DataFrame:
    """(estensione, file, attiva): extensions seen, configured or both."""
    seen = catalogue.groupBy(path_extension(F.col("percorso")).alias("estensione")).agg(F.count("*").alias("file"))
    known = active.select(F.concat(F.lit("."), F.lower("estensione")).alias("estensione")).distinct().withColumn("attiva", F.lit(1))
    return seen.join(known, "estensione", "full").select("estensione", F.coalesce("file", F.lit(0)).alias("file"), F.coalesce("attiva", F.lit(0)).alias("attiva"))


def largest(catalogue: DataFrame, n: int = 8) -> DataFrame:
    """The files with the most chunks (a top-n report)."""
    return catalogue.select("percorso", "n_chunk").orderBy(F.desc_nulls_last("n_chunk"), "percorso").limit(n)


def health(chunks: DataFrame) -> DataFrame:
    """Chunks, and files that hold any."""
    return chunks_once(chunks.select("id", "percorso")).agg(F.count("*").alias("chunk"), F.countDistinct("percorso").alias("file"))


def listed(paths: DataFrame, roots: list[str], extensions: list[str], rules: list[str]) -> DataFrame:
    """Paths that a scan with this configuration visits.

    Below a root, active extension, no hidden segment, no directory that a rule ending in '/' matches, no file name
    that another rule matches.  Rules match one name, with case, not a whole path.
    """
    path = F.col("percorso")
    root = F.array([F.lit(r.rstrip("/") + "/") for r in roots]).cast("array<string>")
    under = F.exists(root, lambda r: path.startswith(r))
    deepest = F.array_max(F.transform(F.filter(root, lambda r: path.startswith(r)), F.length))
    inner = F.split(F.expr("substring(percorso, _b + 1)"), "/")
    rows = paths.filter(under).withColumn("_b", deepest).withColumn("_s", inner)
    directories = F.slice(F.col("_s"), 1, F.size("_s") - 1)
    keep = suffix(path).isin([("." + e.lstrip(".")).lower() for e in extensions]) & ~F.exists(F.col("_s"), lambda s: s.startswith("."))
    for rule in rules:
        if rule.endswith("/"):
            keep &= ~F.exists(directories, _matches(glob_regex(rule[:-1])))
        else:
            keep &= ~basename(path).rlike(glob_regex(rule))
    return rows.filter(keep).drop("_b", "_s")


def _matches(regex: str):
    return lambda name: name.rlike(regex)


def skipped_types(paths: DataFrame, extensions: list[str], n: int = 8) -> DataFrame:
    """The most frequent extensions that a scan skips (a top-n report)."""
    return paths.select(suffix(F.col("percorso")).alias("estensione")).filter(~F.col("estensione").isin([("." + e.lstrip(".")).lower() for e in extensions])).groupBy("estensione").agg(F.count("*").alias("file")).orderBy(F.desc("file"), "estensione").limit(n)


def copy_key(catalogue: DataFrame) -> DataFrame:
    """(percorso, chiave): by which results of copies are collapsed."""
    return catalogue.select("percorso", F.coalesce(F.nullif(effective_key(F.col("impronta_testo"), F.col("impronta")), F.lit("")), F.col("percorso")).alias("chiave"))
