"""Registered queries for the operators of the core, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrinium.durable import durable
from scrinium.functions import text as T
from scrinium.functions.vectors import dot, hashing_embedder, norm, unit_from_bytes
from scrinium.operators import catalogue as C
from scrinium.operators import evaluate as E
from scrinium.operators import lexical as L
from scrinium.operators import search as S
from scrinium.sources.readers import PACKAGE_PART, VERSIONS, without_packages
from scrinium.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---------------------------------------------------------------- pieces of SQL
CUR = """cur AS (SELECT * EXCLUDE (_r) FROM (SELECT *, row_number() OVER (PARTITION BY percorso ORDER BY visto_a DESC NULLS LAST, mtime DESC NULLS LAST, dimensione DESC NULLS LAST,
 impronta DESC NULLS LAST, n_chunk DESC NULLS LAST, ocr DESC NULLS LAST) AS _r FROM files WHERE percorso IS NOT NULL) WHERE _r = 1)"""
OLD = """old AS (SELECT * EXCLUDE (_r) FROM (SELECT *, row_number() OVER (PARTITION BY percorso ORDER BY mtime NULLS LAST, visto_a NULLS LAST, dimensione NULLS LAST,
 impronta NULLS LAST, n_chunk NULLS LAST, ocr NULLS LAST) AS _r FROM files WHERE percorso IS NOT NULL) WHERE _r = 1)"""
CH = "ch AS (SELECT DISTINCT id, percorso, n, testo FROM chunk)"
DOT = "list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)))"
IDX = f"idx AS (SELECT vec_id AS id, '/e/' || label AS percorso, 'k' || (label % 4) AS chiave, {DOT} AS punteggio FROM embeddings WHERE vec_id > (SELECT min(vec_id) FROM embeddings))"
BEST = "best AS (SELECT * EXCLUDE (_r) FROM (SELECT *, row_number() OVER (PARTITION BY percorso ORDER BY punteggio DESC, id) AS _r FROM idx) WHERE _r = 1)"
WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
EXT = "CASE WHEN contains(percorso, '.') THEN '.' || lower(regexp_extract(percorso, '\\.([^.]*)$', 1)) ELSE '(nessuna)' END"
SUFFIX = "lower(regexp_extract(regexp_extract(percorso, '[^/]*$'), '^.+?(\\.[^.]+)$', 1))"
NAME, FOLDER = "regexp_extract({}, '[^/]*$')", "regexp_replace({}, '/[^/]*$', '')"
WINDOWS = "list_transform(CASE WHEN length({0}) = 0 THEN [] WHEN length({0}) <= 2500 THEN [0] ELSE range(0, ceil(length({0}) / 2100.0)::BIGINT) END, lambda i: substring({0}, i::INT * 2100 + 1, 2500))"
FLAT = "trim(regexp_replace({}, '[\\s\\x0B\\x{{1C}}-\\x{{1F}}\\x{{85}}\\pZ]+', ' ', 'g'), ' ')"
LEX = "docs AS (SELECT DISTINCT id, percorso, coalesce(testo, '') || ' ' || regexp_extract(percorso, '[^/]*$') AS testo FROM chunk)"
ASKED = f"asked AS (SELECT q, token, count(*) AS volte FROM (SELECT q, unnest({WORDS.format('q')}) AS token FROM (SELECT DISTINCT q FROM casi WHERE q IS NOT NULL)) GROUP BY ALL)"
BM25 = f"""{LEX}, {ASKED}, toks AS (SELECT id, percorso, {WORDS.format("testo")} AS t FROM docs), size AS (SELECT count(*) AS n, avg(len(t)) AS media FROM toks),
post AS (SELECT id, percorso, l, token, count(*) AS tf FROM (SELECT id, percorso, len(t) AS l, unnest(t) AS token FROM toks) WHERE token IN (SELECT token FROM asked) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM post GROUP BY token),
bm AS (SELECT q, id, percorso, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * l / media)) * volte) AS punteggio FROM post JOIN df USING (token) JOIN asked USING (token), size GROUP BY ALL),
bf AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(punteggio, 9) DESC, id) AS posto FROM (SELECT *, row_number() OVER (PARTITION BY q, percorso ORDER BY round(punteggio, 9) DESC, id) AS r FROM bm) WHERE r = 1)"""
FREQ = f"""{CH}, {ASKED}, hits AS (SELECT DISTINCT token, percorso FROM (SELECT percorso, unnest({WORDS.format("coalesce(testo, '')")}) AS token FROM ch) WHERE token IN (SELECT token FROM asked)),
size AS (SELECT count(DISTINCT percorso) AS n FROM ch), fdf AS (SELECT token, count(*) AS df, any_value(n) AS n FROM hits, size GROUP BY token),
gain AS (SELECT q, percorso, sum(ln(n / df) * volte) AS g FROM hits JOIN fdf USING (token) JOIN asked USING (token) WHERE df <= n * 0.05 GROUP BY ALL),
top AS (SELECT q, max(ln(n / df)) AS m FROM fdf JOIN asked USING (token) WHERE df <= n * 0.05 GROUP BY q)"""
RELEVANT = "len(list_filter(attesi, lambda a: contains(lower(regexp_extract(percorso, '[^/]*$')), lower(a)))) > 0"
CASES = "cases AS (SELECT q, list_distinct(flatten(list(attesi))) AS attesi FROM casi WHERE q IS NOT NULL GROUP BY q)"
#: Terms for the identifier queries: a name, a word of many files, and one that doesn't occur.
TERMS = ["tresmasti", "pagamenti", "zzzassente"]
HITS = "hits AS (SELECT DISTINCT termine, percorso FROM (SELECT percorso, lower(coalesce(testo, '')) AS t FROM ch UNION ALL SELECT percorso, lower(percorso) FROM cur) , (SELECT unnest({}) AS termine) WHERE contains(t, termine))"


def _catalogue(spark: SparkSession, folder: str) -> DataFrame:
    return C.latest(table(spark, folder, "files"))


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return C.chunks_once(table(spark, folder, "chunk").select("id", "percorso", "n", "testo"))


def _index(spark: SparkSession, folder: str) -> tuple[DataFrame, list[float]]:
    """Embeddings as an index of files, and the first vector as the query."""
    e = table(spark, folder, "embeddings")
    first = e.orderBy("vec_id").first()
    rows = e.filter(F.col("vec_id") > first.vec_id).select(F.col("vec_id").alias("id"), F.concat(F.lit("/e/"), "label").alias("percorso"), F.concat(F.lit("k"), F.col("label") % 4).alias("chiave"), F.lit("").alias("testo"), F.col("embedding").alias("vettore"))
    return rows, first.embedding


# ---------------------------------------------------------------- vectors
@query(f"WITH {IDX} SELECT id, round(punteggio, 4) AS punteggio FROM idx ORDER BY idx.punteggio DESC, id LIMIT 20")
def dense_topk(spark, folder):
    index, q = _index(spark, folder)
    return S.scored(index, q).orderBy(F.desc("punteggio"), "id").limit(20).select("id", F.round("punteggio", 4).alias("punteggio"))


@query(f"WITH {IDX}, {BEST} SELECT percorso, id, round(punteggio, 4) AS punteggio FROM best")
def best_chunk_per_file(spark, folder):
    index, q = _index(spark, folder)
    return S.best_per_file(S.scored(index, q), ["percorso"]).select("percorso", "id", F.round("punteggio", 4).alias("punteggio"))


@query(f"WITH {IDX}, {BEST} SELECT percorso, id FROM best WHERE punteggio >= 0.6 * (SELECT max(punteggio) FROM best)")
def relative_cut(spark, folder):
    index, q = _index(spark, folder)
    return S.relative_cut(S.best_per_file(S.scored(index, q), ["percorso"]), 0.6).select("percorso", "id")


@query(f"""WITH {IDX}, {BEST}, cut AS (SELECT * FROM best WHERE punteggio >= 0.5 * (SELECT max(punteggio) FROM best)),
one AS (SELECT *, row_number() OVER (PARTITION BY chiave ORDER BY punteggio DESC, id) AS r, count(*) OVER (PARTITION BY chiave) - 1 AS altre FROM cut)
SELECT percorso AS path, regexp_extract(percorso, '[^/]*$') AS nome, '/e' AS cartella, round(punteggio, 4) AS punteggio, '' AS frammento, altre AS copie FROM one WHERE r = 1 ORDER BY one.punteggio DESC, id LIMIT 10""")
def dense_search(spark, folder):
    index, q = _index(spark, folder)
    return S.dense_search(index, q, 10, 0.5)


@query("""WITH q AS (SELECT vec_id AS q, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q, vec_id AS id, list_dot_product(a, embedding::DOUBLE[]) AS p FROM q, embeddings WHERE vec_id <> q)
SELECT q, id, round(p, 4) AS punteggio, posto FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY p DESC, id) AS posto FROM s) WHERE posto <= 10""")
def batch_search(spark, folder):
    e = table(spark, folder, "embeddings")
    found = S.batch_search(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vettore")), e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("vettore")))
    return found.withColumn("punteggio", F.round("punteggio", 4))


@query("SELECT label, count(*) AS righe, round(avg(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS norma FROM embeddings GROUP BY label")
def vector_norms(spark, folder):
    return table(spark, folder, "embeddings").groupBy("label").agg(F.count("*").alias("righe"), F.round(F.avg(norm(F.col("embedding"))), 6).alias("norma"))


#: Unit vectors of the chunk table's bytes: little-endian float32, put together from their bits.
_UNIT = """bits AS (SELECT id, list_transform(range(0, 64), lambda i: ('0x' || substr(h, 8 * i + 7, 2) || substr(h, 8 * i + 5, 2) || substr(h, 8 * i + 3, 2) || substr(h, 8 * i + 1, 2))::BIGINT) AS b FROM (SELECT DISTINCT id, hex(vettore) AS h FROM chunk WHERE octet_length(vettore) = 256)),
real_ AS (SELECT id, list_transform(b, lambda x: (CASE WHEN x >= 2147483648 THEN -1 ELSE 1 END) * (CASE (x >> 23) & 255 WHEN 0 THEN (x & 8388607) * pow(2, -149) WHEN 255 THEN NULL ELSE ((x & 8388607) + 8388608) * pow(2, ((x >> 23) & 255) - 150) END)) AS v FROM bits),
unit AS (SELECT id, list_transform(v, lambda x: x / n) AS u FROM (SELECT id, v, CASE WHEN len(list_filter(v, lambda x: x IS NULL)) = 0 THEN sqrt(list_sum(list_transform(v, lambda x: x * x))) ELSE 0 END AS n FROM real_) WHERE n > 0)"""


@query(f"WITH {_UNIT} SELECT id, round(u[1], 6) AS prima, round(u[64], 6) AS ultima, round(list_dot_product(u, u), 6) AS norma FROM unit")
def chunk_vectors(spark, folder):
    """Valid vectors of the chunk table, decoded and brought to unit length."""
    rows = table(spark, folder, "chunk").select("id", "vettore").dropDuplicates(["id"]).select("id", unit_from_bytes(64)("vettore").alias("v")).filter("v IS NOT NULL")
    return rows.select("id", F.round(F.col("v")[0], 6).alias("prima"), F.round(F.col("v")[63], 6).alias("ultima"), F.round(dot(F.col("v"), F.col("v")), 6).alias("norma"))


@query(f"WITH {_UNIT}, s AS (SELECT a.id AS q, b.id, round(list_dot_product(a.u, b.u), 9) AS p FROM unit a, unit b WHERE a.id % 100 = 0 AND a.id <> b.id) SELECT q, id, round(p, 4) AS punteggio, posto FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY p DESC, id) AS posto FROM s) WHERE posto <= 5")
def dense_search_chunks(spark, folder):
    """The search over the chunk table itself, in batches: every id divisible by 100 against all rows."""
    rows = table(spark, folder, "chunk").select("id", "vettore").dropDuplicates(["id"]).select("id", unit_from_bytes(64)("vettore").alias("vettore"))
    return S.batch_search(rows, rows.filter("id % 100 = 0").select(F.col("id").alias("q"), "vettore"), 5).withColumn("punteggio", F.round("punteggio", 4))


# ---------------------------------------------------------------- texts
@query(r"""SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(nfc_normalize(text), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'),
lambda x: regexp_replace(x, '^[\s\x0b\x1c-\x1f\x{85}\pZ]+|[\s\x0b\x1c-\x1f\x{85}\pZ]+$', '', 'g')), lambda x: x <> ''), chr(10)) AS testo FROM documents""")
def normalise_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.normalised(F.col("text")).alias("testo"))


@query(f"SELECT doc_id, (u.i - 1)::INT AS n, u.t AS testo FROM (SELECT doc_id, {WINDOWS.format('text')} AS w FROM documents WHERE text IS NOT NULL), (SELECT unnest(range(1, len(w) + 1)) AS i, unnest(w) AS t) AS u")
def chunk_documents(spark, folder):
    return table(spark, folder, "documents").filter("text IS NOT NULL").select("doc_id", F.posexplode(T.windows(F.col("text"))).alias("n", "testo"))


@query(f"SELECT coalesce(source, '') AS source, sum(len(w))::BIGINT AS finestre, count(*) AS documenti FROM (SELECT source, {WINDOWS.format('text')} AS w FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def chunk_stats(spark, folder):
    d = table(spark, folder, "documents").filter("text IS NOT NULL")
    return d.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.sum(F.size(T.windows(F.col("text"))).cast("long")).alias("finestre"), F.count("*").alias("documenti"))


@query(f"SELECT doc_id, sha256(array_to_string({WINDOWS.format('text')}, '')) AS impronta_testo FROM documents WHERE text IS NOT NULL")
def text_hash(spark, folder):
    return table(spark, folder, "documents").filter("text IS NOT NULL").select("doc_id", F.sha2(F.array_join(T.windows(F.col("text")), ""), 256).alias("impronta_testo"))


@query(f"SELECT doc_id, CASE WHEN length(f) > 180 THEN substring(f, 1, 180) || '…' ELSE f END AS frammento FROM (SELECT doc_id, {FLAT.format('text')} AS f FROM documents)")
def snippets(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.snippet(F.col("text")).alias("frammento"))


@query(f"SELECT doc_id, CASE WHEN length(f) > 100 THEN substring(f, 1, 100) || '…' ELSE f END AS frammento FROM (SELECT doc_id, {FLAT.format('text')} AS f FROM documents)")
def short_snippets(spark, folder):
    """The snippet of the ranking report."""
    return table(spark, folder, "documents").select("doc_id", T.snippet(F.col("text"), 100).alias("frammento"))


@query(f"SELECT doc_id, len({WORDS.format('text')})::INT AS parole FROM documents WHERE text IS NOT NULL")
def word_counts(spark, folder):
    return table(spark, folder, "documents").filter("text IS NOT NULL").select("doc_id", F.size(T.words(F.col("text"))).alias("parole"))


@query(r"""SELECT id, riga FROM (SELECT id, unnest(string_split(testo, chr(10))) AS riga FROM (SELECT DISTINCT id, testo FROM chunk WHERE testo IS NOT NULL)) WHERE length(riga) BETWEEN 4 AND 5000 AND contains(riga, ' ')
AND regexp_matches(riga, '\p{L}') AND length(riga) - length(replace(riga, '-', '')) < 4""")
def prose_filter(spark, folder):
    lines = table(spark, folder, "chunk").filter("testo IS NOT NULL").select("id", "testo").dropDuplicates(["id"]).select("id", F.explode(F.split("testo", "\n")).alias("riga"))
    return lines.filter(T.is_prose(F.col("riga")))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(text, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g') AS testo FROM documents""")
def strip_tags(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.without_tags(F.col("text")).alias("testo"))


@query(r"""SELECT doc_id, replace(replace(replace(replace(regexp_replace(regexp_replace(text, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', chr(160)), '&amp;', '&') AS testo FROM documents""")
def html_texts(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.html_text(F.col("text")).alias("testo"))


@query(f"SELECT DISTINCT percorso, {NAME.format('percorso')} AS nome, {FOLDER.format('percorso')} AS cartella, {EXT} AS estensione, {SUFFIX} AS suffisso, CASE {SUFFIX} WHEN '.xml' THEN '2' ELSE '1' END AS versione FROM files WHERE percorso IS NOT NULL")
def path_parts(spark, folder):
    p = F.col("percorso")
    rows = table(spark, folder, "files").filter("percorso IS NOT NULL").select("percorso").distinct()
    return rows.select("percorso", T.basename(p).alias("nome"), T.dirname(p).alias("cartella"), T.path_extension(p).alias("estensione"), T.suffix(p).alias("suffisso"), T.extractor_version(T.suffix(p), VERSIONS).alias("versione"))


# ---------------------------------------------------------------- catalogue
@query(f"WITH {CUR} SELECT percorso, mtime, dimensione, impronta, n_chunk, ocr, impronta_testo FROM cur")
def current_catalogue(spark, folder):
    return _catalogue(spark, folder).select("percorso", "mtime", "dimensione", "impronta", "n_chunk", "ocr", "impronta_testo")


@query(f"""WITH {CUR}, {OLD} SELECT percorso, CASE WHEN coalesce(abs(o.mtime - c.mtime) > 1e-6 OR o.dimensione <> c.dimensione OR coalesce(o.versione, '1') <> coalesce(c.versione, '1'), true) THEN 'cambiato' ELSE 'invariato' END AS azione
FROM cur c JOIN old o USING (percorso)""")
def classify_changes(spark, folder):
    """The latest state of every path against the earliest."""
    f = table(spark, folder, "files")
    return C.classify(C.latest(f), C.earliest(f))


@query(f"WITH {CUR}, {OLD}, pub AS (SELECT percorso FROM old WHERE n_chunk > 0) SELECT azione, count(*) AS file FROM (SELECT CASE WHEN pub.percorso IS NULL THEN 'nuovo' WHEN coalesce(abs(o.mtime - c.mtime) > 1e-6 OR o.dimensione <> c.dimensione OR coalesce(o.versione, '1') <> coalesce(c.versione, '1'), true) THEN 'cambiato' ELSE 'invariato' END AS azione FROM cur c LEFT JOIN pub USING (percorso) LEFT JOIN old o ON o.percorso = pub.percorso) GROUP BY azione")
def run_counters(spark, folder):
    """How many files a pass finds new, changed and unchanged, against a catalogue of the files that first had chunks."""
    f = table(spark, folder, "files")
    return C.classify(C.latest(f), C.earliest(f).filter("n_chunk > 0")).groupBy("azione").agg(F.count("*").alias("file"))


@query(f"WITH {CUR}, {OLD} SELECT percorso, mtime, dimensione FROM cur UNION SELECT percorso, mtime, dimensione FROM old WHERE percorso NOT IN (SELECT percorso FROM cur)")
def upsert_snapshot(spark, folder):
    f = table(spark, folder, "files")
    return C.upsert(C.earliest(f), C.latest(f), ["percorso"]).select("percorso", "mtime", "dimensione")


LISTED = f"""listed AS (SELECT DISTINCT percorso FROM files WHERE starts_with(percorso, '/archivio/') AND {SUFFIX} IN (SELECT '.' || lower(unnest(estensioni_attive)) FROM configurazione)
AND NOT contains(percorso, '/.') AND NOT contains(regexp_replace(percorso, '[^/]*$', ''), '/bozze/') AND NOT starts_with(regexp_extract(percorso, '[^/]*$'), '~$') AND NOT ends_with(percorso, '.tmp'))"""


def _listed(spark, folder):
    config = table(spark, folder, "configurazione").first()
    paths = table(spark, folder, "files").filter("percorso IS NOT NULL").select("percorso").distinct()
    return C.listed(paths, config.radici, config.estensioni_attive, config.esclusioni)


@query(f"WITH {LISTED} SELECT percorso FROM listed")
def listing_filter(spark, folder):
    return _listed(spark, folder)


@query(f"WITH p AS (SELECT {FOLDER.format('min(percorso)')} AS cartella FROM files WHERE percorso IS NOT NULL) SELECT DISTINCT percorso FROM files, p WHERE percorso IS NOT NULL AND NOT starts_with(percorso, cartella || '/')")
def unpacked_packages(spark, folder):
    """Paths without those of an unpacked office package: the folder of the first path is made one by a content-types part."""
    paths = table(spark, folder, "files").filter("percorso IS NOT NULL").select("percorso").distinct()
    part = paths.agg(F.concat(T.dirname(F.min("percorso")), F.lit(f"/{PACKAGE_PART}")).alias("percorso"))
    return without_packages(paths.unionByName(part))


@query(f"WITH {LISTED} SELECT DISTINCT percorso FROM files WHERE percorso IS NOT NULL AND percorso NOT IN (SELECT percorso FROM listed)")
def vanished(spark, folder):
    """Paths that a scan with the configuration no longer finds."""
    return C.vanished(_catalogue(spark, folder), _listed(spark, folder))


@query(f"WITH {LISTED}, {CH} SELECT id, percorso FROM ch WHERE percorso NOT IN (SELECT percorso FROM files WHERE percorso IS NOT NULL AND percorso NOT IN (SELECT percorso FROM listed))")
def delete_vanished_chunks(spark, folder):
    gone = C.vanished(_catalogue(spark, folder), _listed(spark, folder))
    return C.without_files(_chunks(spark, folder), gone).select("id", "percorso")


@query(f"WITH {CUR}, {LISTED} SELECT percorso, CASE WHEN percorso IN (SELECT percorso FROM listed) THEN 1.8e9::DOUBLE ELSE visto_a END AS visto_a FROM cur")
def mark_seen(spark, folder):
    return C.seen_at(_catalogue(spark, folder), _listed(spark, folder), 1.8e9).select("percorso", "visto_a")


@query(f"WITH x AS (SELECT {SUFFIX} AS estensione FROM (SELECT DISTINCT percorso FROM files WHERE percorso IS NOT NULL)) SELECT estensione, count(*) AS file FROM x WHERE estensione NOT IN (SELECT '.' || lower(unnest(estensioni_attive)) FROM configurazione) GROUP BY 1 ORDER BY file DESC, estensione LIMIT 8")
def skipped_types(spark, folder):
    config = table(spark, folder, "configurazione").first()
    return C.skipped_types(table(spark, folder, "files").filter("percorso IS NOT NULL").select("percorso").distinct(), config.estensioni_attive)


@query(f"WITH {CUR} SELECT impronta_testo, count(*) AS copie FROM cur WHERE impronta_testo <> '' GROUP BY 1 HAVING count(*) > 1")
def copies_per_text(spark, folder):
    return C.copies_per_text(_catalogue(spark, folder))


@query(f"WITH {CUR} SELECT impronta_testo, count(*) AS copie FROM cur WHERE impronta_testo <> '' AND n_chunk > 0 GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark, folder):
    return C.duplicate_groups(_catalogue(spark, folder))


@query(f"WITH {CUR} SELECT count(*) AS gruppi FROM (SELECT 1 FROM cur WHERE impronta_testo <> '' AND n_chunk > 0 GROUP BY impronta_testo HAVING count(*) > 1)")
def duplicate_count(spark, folder):
    return C.duplicate_count(_catalogue(spark, folder))


@query(f"WITH {CUR} SELECT percorso FROM cur z WHERE n_chunk = 0 AND impronta_testo <> '' AND NOT EXISTS (SELECT 1 FROM cur f WHERE f.n_chunk > 0 AND f.impronta_testo = z.impronta_testo)")
def orphans(spark, folder):
    return C.orphans(_catalogue(spark, folder))


@query(f"WITH {CUR}, {LISTED}, here AS (SELECT * FROM cur WHERE percorso IN (SELECT percorso FROM listed)) SELECT percorso FROM here z WHERE n_chunk = 0 AND impronta_testo <> '' AND NOT EXISTS (SELECT 1 FROM here f WHERE f.n_chunk > 0 AND f.impronta_testo = z.impronta_testo)")
def orphans_after_vanish(spark, folder):
    """Copies that lose their text when the paths go that a scan no longer finds."""
    files = _catalogue(spark, folder)
    return C.orphans(files.join(C.vanished(files, _listed(spark, folder)), "percorso", "left_anti"))


@query(f"WITH {CUR} SELECT a.percorso, min(b.percorso) AS gemello FROM cur a JOIN cur b ON a.impronta_testo = b.impronta_testo AND a.percorso <> b.percorso WHERE a.impronta_testo <> '' AND b.n_chunk > 0 GROUP BY a.percorso")
def twins(spark, folder):
    return C.twins(_catalogue(spark, folder))


@query(f"WITH {CUR} SELECT percorso FROM (SELECT percorso, row_number() OVER (PARTITION BY impronta_testo ORDER BY percorso) AS r FROM cur WHERE impronta_testo <> '' AND n_chunk > 0) WHERE r > 1")
def compaction_plan(spark, folder):
    return C.compaction_plan(_catalogue(spark, folder))


@query(f"WITH {CUR}, {CH}, plan AS (SELECT percorso FROM (SELECT percorso, row_number() OVER (PARTITION BY impronta_testo ORDER BY percorso) AS r FROM cur WHERE impronta_testo <> '' AND n_chunk > 0) WHERE r > 1) SELECT id, percorso FROM ch WHERE percorso NOT IN (SELECT percorso FROM plan)")
def compacted_chunks(spark, folder):
    return C.compacted(_catalogue(spark, folder), _chunks(spark, folder))[1].select("id", "percorso")


@query(f"WITH {CH} SELECT percorso, sha256(string_agg(coalesce(testo, ''), '' ORDER BY n, id)) AS impronta_testo FROM ch WHERE percorso IS NOT NULL GROUP BY percorso")
def backfill_text_hashes(spark, folder):
    return C.text_hashes(table(spark, folder, "chunk"))


@query(f"WITH {CUR} SELECT {EXT} AS estensione, count(*) AS file, coalesce(sum(n_chunk), 0)::BIGINT AS chunk, count(*) FILTER (ocr = 1) AS ocr FROM cur GROUP BY 1")
def extension_statistics(spark, folder):
    return C.extension_statistics(_catalogue(spark, folder))


@query(f"WITH {CUR}, a AS (SELECT DISTINCT '.' || lower(unnest(estensioni_attive)) AS estensione FROM configurazione), s AS (SELECT {EXT} AS estensione, count(*) AS file FROM cur GROUP BY 1) SELECT coalesce(s.estensione, a.estensione) AS estensione, coalesce(file, 0) AS file, (a.estensione IS NOT NULL)::INT AS attiva FROM s FULL JOIN a ON s.estensione = a.estensione")
def extension_activity(spark, folder):
    return C.extension_activity(_catalogue(spark, folder), table(spark, folder, "configurazione").select(F.explode("estensioni_attive").alias("estensione")))


@query(f"WITH {CUR} SELECT count(*) AS file, coalesce(sum(n_chunk), 0)::BIGINT AS chunk, count(*) FILTER (ocr = 1) AS ocr FROM cur")
def totals(spark, folder):
    return C.totals(_catalogue(spark, folder))


@query(f"WITH {CUR} SELECT percorso, n_chunk FROM cur ORDER BY n_chunk DESC NULLS LAST, percorso LIMIT 8")
def largest_files(spark, folder):
    return C.largest(_catalogue(spark, folder))


@query("SELECT count(*) AS chunk, count(DISTINCT percorso) AS file FROM (SELECT DISTINCT id, percorso FROM chunk)")
def health(spark, folder):
    return C.health(table(spark, folder, "chunk"))


@query("SELECT chiave, valore FROM stato")
def status(spark, folder):
    return table(spark, folder, "stato").select("chiave", "valore")


@query("SELECT CASE WHEN chiave = 'in_corso' THEN '1' ELSE valore END AS valore, chiave FROM stato UNION ALL SELECT '3', 'passaggi'")
def status_upsert(spark, folder):
    return C.upsert(table(spark, folder, "stato").select("chiave", "valore"), spark.createDataFrame([("in_corso", "1"), ("passaggi", "3")], "chiave string, valore string"), ["chiave"])


@query(f"WITH {CUR} SELECT percorso, CASE WHEN impronta_testo <> '' THEN impronta_testo WHEN impronta <> '' THEN impronta ELSE percorso END AS chiave FROM cur")
def copy_keys(spark, folder):
    return C.copy_key(_catalogue(spark, folder))


@query(f"WITH {CUR}, {CH} SELECT id, c.percorso, n, CASE WHEN impronta_testo <> '' THEN impronta_testo ELSE impronta END AS chiave FROM ch c JOIN cur USING (percorso)")
def load_index(spark, folder):
    """Chunks with their file's copy key: the index that searches load."""
    return _chunks(spark, folder).join(C.copy_key(_catalogue(spark, folder)), "percorso").select("id", "percorso", "n", "chiave")


# ---------------------------------------------------------------- identifiers
@query(f"WITH {CUR}, {CH} SELECT percorso FROM ch WHERE contains(lower(testo), 'tresmasti') UNION SELECT percorso FROM cur WHERE contains(lower(percorso), 'tresmasti')")
def files_with_term(spark, folder):
    return S.files_with_term(_chunks(spark, folder), _catalogue(spark, folder), "tresmasti")


_LIMIT = "greatest(1, floor((SELECT count(DISTINCT percorso) FROM ch) * 0.01))::INT"


@query(f"WITH {CUR}, {CH}, {HITS.format(TERMS)} SELECT t.termine, count(h.percorso) AS file, {_LIMIT} AS limite, count(h.percorso) BETWEEN 1 AND {_LIMIT} AS raro FROM (SELECT unnest({TERMS}) AS termine) t LEFT JOIN hits h USING (termine) GROUP BY t.termine")
def identifier_gate(spark, folder):
    return S.identifier_gate(_chunks(spark, folder), _catalogue(spark, folder), TERMS)


@query(f"WITH {CUR}, {CH}, {HITS.format(['0000010'])} SELECT percorso FROM hits WHERE (SELECT count(*) FROM hits) BETWEEN 1 AND {_LIMIT}")
def identifier_search(spark, folder):
    return S.identifier_files(_chunks(spark, folder), _catalogue(spark, folder), "0000010")


# ---------------------------------------------------------------- words
def _lexical(spark, folder):
    return L.searchable(_chunks(spark, folder)), table(spark, folder, "casi")


def _bm25_scores(spark, folder):
    return L.bm25(*_lexical(spark, folder)).withColumn("punteggio", F.round("punteggio", 9))


@query(f"WITH {BM25} SELECT token, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, size")
def inverse_frequency(spark, folder):
    return L.inverse_frequency(*_lexical(spark, folder)).withColumn("idf", F.round("idf", 6))


@query(f"WITH {FREQ} SELECT token, df, n, round(ln(n / df), 6) AS idf FROM fdf")
def file_frequency(spark, folder):
    return L.file_frequency(_chunks(spark, folder), table(spark, folder, "casi")).select("token", "df", "n", F.round("idf", 6).alias("idf")).distinct()


@query(f"WITH {BM25} SELECT q, id, percorso, round(punteggio, 5) AS punteggio FROM bm")
def bm25(spark, folder):
    return L.bm25(*_lexical(spark, folder)).withColumn("punteggio", F.round("punteggio", 5))


@query(f"WITH {BM25} SELECT q, percorso, id, round(punteggio, 5) AS punteggio, posto FROM bf WHERE posto <= 10 AND punteggio > 0")
def bm25_files(spark, folder):
    scores = L.bm25(*_lexical(spark, folder)).withColumn("punteggio", F.round("punteggio", 9))
    return L.best_files(scores, 10).select("q", "percorso", "id", F.round("punteggio", 5).alias("punteggio"), "posto")


_DENSE = """embw AS (SELECT id, unnest({w}) AS t FROM docs), embc AS (SELECT id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 256 AS b, count(*) AS c FROM embw GROUP BY ALL), embn AS (SELECT id, sqrt(sum(c * c)) AS n FROM embc GROUP BY id),
qc AS (SELECT q, ('0x' || substr(md5(token), 1, 8))::BIGINT % 256 AS b, sum(volte) AS c FROM asked GROUP BY ALL), qn AS (SELECT q, sqrt(sum(c * c)) AS n FROM qc GROUP BY q),
dn AS (SELECT q, id, round(sum(qc.c * embc.c) / any_value(qn.n) / any_value(embn.n), 9) AS punteggio FROM qc JOIN embc USING (b) JOIN qn USING (q) JOIN embn USING (id) GROUP BY q, id),
df_ AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY punteggio DESC, id) AS posto FROM (SELECT q, id, percorso, punteggio, row_number() OVER (PARTITION BY q, percorso ORDER BY punteggio DESC, id) AS r FROM dn JOIN docs USING (id)) WHERE r = 1)"""
DENSE = _DENSE.format(w=WORDS.format("testo"))


def _dense_scores(spark, folder):
    """Scores of all chunks by the hashing embedder: a stated set of queries against all rows."""
    docs, cases = _lexical(spark, folder)
    embed = hashing_embedder(256)
    asked = S.if_small(cases.filter("q IS NOT NULL").select("q").distinct().filter(F.size(T.words(F.col("q"))) > 0).withColumn("v", embed("q")), 1_000)
    return docs.select("id", "percorso", embed("testo").alias("e")).crossJoin(asked).select("q", "id", "percorso", F.round(dot(F.col("e"), F.col("v")), 9).alias("punteggio"))


def _dense_best(spark, folder):
    """Each file's best chunk; scores are made once, since a ranking and its measures read them several times."""
    return durable(L.scored_files(_dense_scores(spark, folder)))


def _bm25_best(spark, folder):
    return durable(L.scored_files(_bm25_scores(spark, folder)))


def _dense_files(spark, folder, k=None):
    return L.best_files(_dense_scores(spark, folder), k)


@query(f"WITH {BM25}, {DENSE} SELECT q, percorso, id, round(punteggio, 4) AS punteggio, posto FROM df_ WHERE posto <= 10 AND punteggio > 0")
def text_search(spark, folder):
    """Text to ranking without a model: hashing embedder, dot product, best chunk of each file."""
    return _dense_files(spark, folder, 10).select("q", "percorso", "id", F.round("punteggio", 4).alias("punteggio"), "posto")


@query(f"WITH {BM25}, {DENSE}, both_ AS (SELECT q, percorso, posto FROM bf WHERE punteggio > 0 UNION ALL SELECT q, percorso, posto FROM df_ WHERE punteggio > 0) SELECT q, percorso, round(sum(1 / (60 + posto)), 7) AS punteggio FROM both_ GROUP BY ALL")
def rank_fusion(spark, folder):
    return L.fused(S.ranked(_bm25_best(spark, folder), ["q"]), S.ranked(_dense_best(spark, folder), ["q"])).withColumn("punteggio", F.round("punteggio", 7))


@query(f"WITH {BM25}, {DENSE}, {FREQ.replace('asked AS', 'asked2 AS').replace('size AS', 'size2 AS').replace('FROM hits, size GROUP', 'FROM hits, size2 GROUP')} SELECT df_.q, df_.percorso, round(punteggio + 0.1 * coalesce(g / m, 0), 6) AS punteggio FROM df_ LEFT JOIN gain USING (q, percorso) LEFT JOIN top USING (q) WHERE punteggio > 0")
def rare_boost(spark, folder):
    cases = table(spark, folder, "casi")
    frequency = L.file_frequency(_chunks(spark, folder), cases)
    return L.boosted(L.scored_files(_dense_scores(spark, folder)), frequency, cases, 0.1).select("q", "percorso", F.round("punteggio", 6).alias("punteggio"))


# ---------------------------------------------------------------- evaluation
_METRICS = "min(posto) FILTER (p) AS primo, count(*) FILTER (p AND posto <= 8) AS pertinenti, count(*) FILTER (NOT p AND posto <= 8) AS rumore, count(*) FILTER (posto <= 8) AS restituiti"


@query(f"WITH {BM25}, {CASES}, r AS (SELECT *, {RELEVANT} AS p FROM bf JOIN cases USING (q) WHERE punteggio > 0) SELECT q, {_METRICS} FROM r GROUP BY q")
def evaluate_bm25(spark, folder):
    return E.score_metrics(E.relevant(_bm25_best(spark, folder), table(spark, folder, "casi")), ["q"])


@query(f"""WITH {BM25}, {DENSE}, {CASES}, {FREQ.replace("asked AS", "asked2 AS").replace("size AS", "size2 AS").replace("FROM hits, size GROUP", "FROM hits, size2 GROUP")},
grid AS (SELECT * FROM (SELECT unnest([1.0, 0.95, 0.9, 0.85])::DOUBLE AS alfa), (SELECT unnest([0.0, 0.05, 0.1])::DOUBLE AS beta)),
b AS (SELECT df_.q, percorso, alfa, beta, round(punteggio + beta * coalesce(g / m, 0), 9) AS s FROM df_ LEFT JOIN gain USING (q, percorso) LEFT JOIN top USING (q), grid WHERE punteggio > 0),
c AS (SELECT * FROM (SELECT *, max(s) OVER (PARTITION BY q, alfa, beta) AS m FROM b) WHERE alfa = 1 OR s >= m * alfa),
r AS (SELECT *, {RELEVANT} AS p FROM (SELECT *, row_number() OVER (PARTITION BY q, alfa, beta ORDER BY s DESC, percorso) AS posto FROM c) JOIN cases USING (q)) SELECT q, alfa, beta, {_METRICS} FROM r GROUP BY q, alfa, beta""")
def parameter_sweep(spark, folder):
    cases = table(spark, folder, "casi")
    plain = _dense_best(spark, folder)
    gain = L.boosted(plain.withColumn("punteggio", F.lit(0.0)), L.file_frequency(_chunks(spark, folder), cases), cases, 1.0).select("q", "percorso", F.col("punteggio").alias("guadagno"))
    boosts = F.explode(F.array([F.lit(b) for b in (0.0, 0.05, 0.1)])).alias("beta")
    rows = E.relevant(plain, cases).join(gain, ["q", "percorso"], "left").select("q", "percorso", "pertinente", F.coalesce("guadagno", F.lit(0.0)).alias("g"), "punteggio", boosts)
    rows = rows.select("q", "percorso", "pertinente", "beta", F.round(F.col("punteggio") + F.col("beta") * F.col("g"), 9).alias("punteggio"))
    return E.score_metrics(rows, ["q", "beta"], "percorso", cuts=[1.0, 0.95, 0.9, 0.85])


@query(f"WITH {BM25}, {DENSE}, {CASES}, r AS (SELECT 'lessicale' AS m, q, percorso, posto FROM bf WHERE punteggio > 0 UNION ALL SELECT 'denso', q, percorso, posto FROM df_ WHERE punteggio > 0), x AS (SELECT *, {RELEVANT} AS p FROM r JOIN cases USING (q)) SELECT q, min(posto) FILTER (p AND m = 'denso') AS denso, min(posto) FILTER (p AND m = 'lessicale') AS lessicale FROM x GROUP BY q")
def model_comparison(spark, folder):
    return E.compared({"denso": _dense_best(spark, folder), "lessicale": _bm25_best(spark, folder)}, table(spark, folder, "casi"))


@query(f"""WITH {BM25}, {DENSE}, {CASES}, r AS (SELECT 'lessicale' AS modello, q, percorso, posto FROM bf WHERE punteggio > 0 UNION ALL SELECT 'denso', q, percorso, posto FROM df_ WHERE punteggio > 0),
h AS (SELECT 'ibrido' AS modello, q, percorso, row_number() OVER (PARTITION BY q ORDER BY s DESC, percorso) AS posto FROM (SELECT q, percorso, round(sum(1 / (60 + posto)), 12) AS s FROM r GROUP BY ALL)),
x AS (SELECT *, {RELEVANT} AS p FROM (SELECT * FROM r UNION ALL SELECT * FROM h) JOIN cases USING (q)) SELECT modello, q, {_METRICS} FROM x GROUP BY modello, q""")
def ranking_report(spark, folder):
    """The report of the three rankings: dense, lexical and fused, with the first relevant place and what the first eight hold."""
    cases = table(spark, folder, "casi")
    rankings = {"denso": _dense_best(spark, folder), "lessicale": _bm25_best(spark, folder)}
    mixed = L.fused(*(S.ranked(r, ["q"]) for r in rankings.values())).withColumn("punteggio", F.round("punteggio", 12))
    rows = mixed.select(F.lit("ibrido").alias("modello"), "q", "percorso", F.lit(0).cast("long").alias("id"), "punteggio")
    for name, r in rankings.items():
        rows = rows.unionByName(r.select(F.lit(name).alias("modello"), "q", "percorso", "id", "punteggio"))
    # ties: by the chunk's id in a ranking of chunks, by the path in a fused one
    rows = rows.withColumn("o", F.struct("id", "percorso"))
    return E.score_metrics(E.relevant(rows, cases), ["modello", "q"], "o")


def _searched(spark, folder, text, only=None, cut=0.5):
    """The search over chunks and catalogue, by the hashing embedder: snippet, copies, and the identifier rule where it applies."""
    chunks, files = _chunks(spark, folder), _catalogue(spark, folder)
    embed = hashing_embedder(256)
    index = chunks.join(C.copy_key(files), "percorso").select("id", "percorso", F.coalesce("testo", F.lit("")).alias("testo"), "chiave", embed("testo").alias("vettore"))
    query = spark.range(1).select(F.lit(text).alias("t")).select(embed("t").alias("v")).first().v
    copies = C.copies_per_text(files).select(F.col("impronta_testo").alias("chiave"), "copie")
    return S.dense_search(index, query, 10, cut, copies, only)


def _search_sql(text, only=None, cut=0.5, more=""):
    asked = f"asked AS (SELECT 0 AS q, token, count(*) AS volte FROM (SELECT unnest({WORDS.format(repr(text))}) AS token) GROUP BY ALL)"
    dense = _DENSE.format(w=WORDS.format("testo"))
    inside = f"AND percorso IN ({only})" if only else ""
    return f"""WITH {CUR}, {CH}, {more}docs AS (SELECT ch.id, ch.percorso, coalesce(testo, '') AS testo FROM ch JOIN cur USING (percorso)), {asked}, {dense},
all_ AS (SELECT ch.id, ch.percorso, coalesce(testo, '') AS testo, CASE WHEN impronta_testo <> '' THEN impronta_testo WHEN impronta <> '' THEN impronta ELSE percorso END AS chiave, coalesce(dn.punteggio, 0) AS punteggio FROM ch JOIN cur USING (percorso) LEFT JOIN dn ON dn.id = ch.id),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY percorso ORDER BY round(punteggio, 9) DESC, id) AS r FROM all_) WHERE r = 1 {inside}),
cut AS (SELECT * FROM best WHERE punteggio >= {0.0 if only else cut} * (SELECT max(punteggio) FROM best)),
one AS (SELECT *, row_number() OVER (PARTITION BY chiave ORDER BY round(punteggio, 9) DESC, id) AS k, count(*) OVER (PARTITION BY chiave) - 1 AS altre FROM cut),
cop AS (SELECT impronta_testo, count(*) AS copie FROM cur WHERE impronta_testo <> '' GROUP BY 1 HAVING count(*) > 1),
f AS (SELECT one.*, greatest(coalesce(copie, 1) - 1, 0) + altre AS copie, {FLAT.format('testo')} AS piano FROM one LEFT JOIN cop ON chiave = impronta_testo WHERE k = 1)
SELECT percorso AS path, {NAME.format('percorso')} AS nome, {FOLDER.format('percorso')} AS cartella, round(punteggio, 4) AS punteggio, CASE WHEN length(piano) > 180 THEN substring(piano, 1, 180) || '…' ELSE piano END AS frammento, copie FROM f ORDER BY round(f.punteggio, 9) DESC, id LIMIT 10"""


@query(_search_sql("verbale di consegna del contratto"))
def search_chunks(spark, folder):
    """The whole search: best chunk of each file, cut, copies collapsed and counted, top ten with their snippets."""
    return _searched(spark, folder, "verbale di consegna del contratto")


_BOTH = f"SELECT percorso FROM hits WHERE (SELECT min(c) FROM (SELECT count(*) AS c FROM hits GROUP BY termine)) >= 1 AND (SELECT max(c) FROM (SELECT count(*) AS c FROM hits GROUP BY termine)) <= {_LIMIT} GROUP BY percorso HAVING count(DISTINCT termine) = 2"


@query(f"WITH {CUR}, {CH}, {HITS.format(['0000010', '_0000010'])} {_BOTH}")
def identifier_two_terms(spark, folder):
    """Files with both terms of an identifier-like query, by path."""
    return S.identifier_files(_chunks(spark, folder), _catalogue(spark, folder), "0000010 _0000010").orderBy("percorso")


@query(_search_sql("0000010 _0000010", only=_BOTH, more=f"{HITS.format(['0000010', '_0000010'])}, "))
def search_identifier(spark, folder):
    """The whole search where the identifier rule applies: only files with all terms, and no cut."""
    only = S.identifier_files(_chunks(spark, folder), _catalogue(spark, folder), "0000010 _0000010")
    return _searched(spark, folder, "0000010 _0000010", only)


@query(f"WITH {CUR}, {CH}, {HITS.format(['tresmasti', '0000010'])} SELECT termine, percorso FROM hits")
def term_hits(spark, folder):
    """Each file that has a term in a chunk or in its path."""
    return S.term_counts(_chunks(spark, folder), _catalogue(spark, folder), ["tresmasti", "0000010"])


@query("SELECT ricerca_id, count(*) AS risultati, round(max(punteggio), 4) AS primo, count(*) FILTER (punteggio >= 0.9 * m) AS sopra FROM (SELECT *, max(punteggio) OVER (PARTITION BY ricerca_id) AS m FROM (SELECT DISTINCT ricerca_id, path, punteggio FROM risultati)) GROUP BY ricerca_id")
def result_cuts(spark, folder):
    """Stored results: how many of each search pass the cut."""
    rows = table(spark, folder, "risultati").select("ricerca_id", "path", "punteggio").distinct()
    top = rows.groupBy("ricerca_id").agg(F.max("punteggio").alias("m"))
    return rows.join(top, "ricerca_id").groupBy("ricerca_id").agg(F.count("*").alias("risultati"), F.round(F.max("punteggio"), 4).alias("primo"), F.count_if(F.col("punteggio") >= 0.9 * F.col("m")).alias("sopra"))


@query("SELECT q, count(DISTINCT ricerca_id) AS ricerche FROM (SELECT ricerca_id, trim(coalesce(q, '')) AS q FROM risultati) WHERE length(q) > 1 GROUP BY q")
def search_frequency(spark, folder):
    """Searches by trimmed text; texts of one character or none are no searches."""
    rows = table(spark, folder, "risultati").select("ricerca_id", F.trim(F.coalesce("q", F.lit(""))).alias("q")).filter(F.length("q") > 1).distinct()
    return rows.groupBy("q").agg(F.count("*").alias("ricerche"))
