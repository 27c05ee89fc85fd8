"""The registered queries of this package, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrinium.llm import canonical, near_duplicates, neighbours, packing, quality, scans, splitting, tokens
from scrinium.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds of noise of scanned pages that each chunk has whole."""
    return scans.noise_kinds(scans.repair_scans(table(spark, folder, "chunk"), table(spark, folder, "files")))


def p1_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """The repaired text of every chunk of a scanned file."""
    return scans.repair_scans(table(spark, folder, "chunk"), table(spark, folder, "files"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of chunks that differ in characters and look the same."""
    return canonical.same_look_pairs(canonical.look_classes(table(spark, folder, "chunk")))


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Each chunk's class of texts that look the same, and of equal texts."""
    return canonical.look_classes(table(spark, folder, "chunk"))


def p2_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Each chunk's text in canonical form."""
    return canonical.canonical_form(table(spark, folder, "chunk").select("id", "testo")).select("id", "forma")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that had to be split, and whether a cut was forced."""
    pieces = splitting.split_oversized(table(spark, folder, "chunk").select("id", "testo"))
    return pieces.filter("pezzi > 1").groupBy("id").agg(F.max("forzato").alias("forzato"))


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All pieces of all chunks."""
    return splitting.split_oversized(table(spark, folder, "chunk").select("id", "percorso", "n", "testo"))


def p3_cover(spark: SparkSession, folder: str) -> DataFrame:
    """What the pieces of each chunk must keep: all of the text, the limit, the overlap, and their order."""
    pieces = splitting.split_oversized(table(spark, folder, "chunk").select("id", "testo").distinct())
    new = F.substring("testo", F.col("ripetuti") + 1, F.length("testo"))
    rows = pieces.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pezzo", new.alias("t")))).alias("p"), F.max(F.length("testo")).alias("massimo"), F.max("ripetuti").alias("ripetuti"), F.count_if((F.col("pezzo") > 0) & (F.col("ripetuti") == 0)).alias("senza"))
    # a group has the pieces of one text
    return rows.select("id", F.md5(F.array_join(F.transform("p", lambda x: x["t"]), "")).alias("impronta"), (F.col("massimo") <= splitting.LIMIT).alias("entro"), (F.col("ripetuti") <= splitting.OVERLAP).alias("ripetuti_entro"), (F.col("senza") == 0).alias("tutti_ripetono"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of chunks of which one is among the other's five most similar."""
    return neighbours.neighbour_pairs(neighbours.nearest_vectors(table(spark, folder, "chunk")))


def p4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five most similar chunks of every chunk with a valid vector."""
    return neighbours.nearest_vectors(table(spark, folder, "chunk"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of chunks that are copies or slightly edited versions of each other."""
    return near_duplicates.similar_pairs(*near_duplicates.near_duplicates(table(spark, folder, "chunk")))


def p5_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Each chunk's class of copies, and how many classes that is linked to."""
    members, links = near_duplicates.near_duplicates(table(spark, folder, "chunk"))
    count = links.select(F.explode(F.array("a", "b")).alias("classe")).groupBy("classe").agg(F.count("*").alias("legami"))
    return members.join(count, "classe", "left").select("id", "classe", F.coalesce("legami", F.lit(0)).alias("legami"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode_corpus(table(spark, folder, "documents"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that needed more than one container."""
    return packing.split_rows(packing.pack_corpus(table(spark, folder, "documents")))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's container and place."""
    return packing.pack_corpus(table(spark, folder, "documents"))


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents"), table(spark, folder, "etichette"), table(spark, folder, "parole_comuni"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are not natural prose."""
    return quality.not_prose(_judged(spark, folder))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The figures of every document that need no look at its lines."""
    figures = quality.statistics(table(spark, folder, "documents").select("doc_id", "text"), [])
    return figures.select("doc_id", F.col("parole").cast("long").alias("parole"), *(F.round(c, 6).alias(c) for c in ("lunghezza_media", "quota_simboli", "quota_cifre", "quota_lettere")))


def p8_figures(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's figures, rule and verdict."""
    return _judged(spark, folder)


def _form_sql(source: str) -> str:
    """(id, testo, t) of ``source`` in one form, character by character: SQL of its own beside the operator's statement."""

    def code(c: str) -> str:
        return " || ".join(f"chr({ord(x)})" for x in c)

    def table_of(pairs: dict[str, str]) -> str:
        return f"MAP {{{', '.join(f'{code(a)}: {code(b)}' for a, b in pairs.items())}}}"

    def picture(c: str) -> str:
        return f"regexp_full_match(coalesce({c}, ' '), '[\\x{{2190}}-\\x{{2BFF}}\\x{{1F000}}-\\x{{1FAFF}}]')"

    def letters(c: str) -> str:
        return f"regexp_extract_all({c}, '(?s).')"

    one: dict[str, str] = dict(zip(*canonical.widths(), strict=True)) | dict.fromkeys(canonical.spaces(), " ") | dict.fromkeys(canonical.HYPHENS.replace("\u00ad", ""), "-")
    for own, latin in canonical.LOOKALIKES.values():
        one |= dict(zip(own, latin, strict=True))
    before = f"({picture('l[i - 1]')} OR l[i - 1] = chr(65039) AND {picture('l[i - 2]')})"
    seen = f"list_filter(l, lambda c, i: NOT regexp_full_match(c, '[{canonical.INVISIBLE}]') OR c = chr(8205) AND {before} AND {picture('l[i + 1]')})"
    home = "".join(f" WHEN len(list_filter(w, lambda c: regexp_full_match(c, '\\p{{{script}}}'))) > 0 AND len(list_filter(w, lambda c: regexp_full_match(c, '[A-Za-z]') AND NOT contains('{latin}', c))) = 0 THEN list_transform(w, lambda c: coalesce(({table_of(dict(reversed(list(zip(latin, own, strict=True)))))})[c], c))" for script, (own, latin) in canonical.LOOKALIKES.items())
    return f"""
SELECT id, testo, nfc_normalize(array_to_string(list_transform(list_transform(regexp_extract_all(t, '[\\p{{L}}\\p{{M}}]+|[^\\p{{L}}\\p{{M}}]+'), lambda x: {letters('x')}), lambda w: array_to_string(CASE{home} ELSE w END, '')), '')) AS t
FROM (SELECT id, testo, nfc_normalize(array_to_string(list_transform({seen}, lambda c: coalesce(({table_of(canonical.JOINED)})[c], c)), '')) AS t
FROM (SELECT id, testo, list_transform(c, lambda x, i: CASE WHEN x = chr(173) AND c[i + 1] IN (chr(10), chr(13)) THEN '-' ELSE coalesce(({table_of(one)})[x], x) END) AS l
FROM (SELECT id, testo, {letters('testo')} AS c FROM {source})))
"""


P2_FORMS = f"forms AS (SELECT DISTINCT id, testo, t FROM ({_form_sql('chunk')}) WHERE testo IS NOT NULL)"
P2_SQL = f"WITH {P2_FORMS} SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM forms a JOIN forms b ON a.t = b.t AND a.id < b.id AND a.testo <> b.testo"
P2_CLASSES_SQL = f"WITH {P2_FORMS} SELECT id, min(id) OVER (PARTITION BY t) AS classe, min(id) OVER (PARTITION BY t, testo) AS variante FROM forms"

P5_SQL = r"""
WITH words AS (SELECT id, regexp_extract_all(lower(testo), '[\p{L}\p{N}_]+') AS w FROM (SELECT DISTINCT id, testo FROM chunk WHERE testo IS NOT NULL)),
sets AS (SELECT id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS s FROM words WHERE len(w) >= 60),
sizes AS (SELECT id, count(*) AS n FROM sets GROUP BY id),
shared AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.id < b.id GROUP BY ALL)
SELECT id_a, id_b FROM shared JOIN sizes x ON x.id = id_a JOIN sizes y ON y.id = id_b WHERE c >= 0.6 * (x.n + y.n - c) - 1e-9
"""

P3_SQL = r"""
SELECT id, max(CASE WHEN list_max(list_transform(regexp_split_to_array(testo, '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]'), lambda s: length(s))) > 2500 THEN 1 ELSE 0 END)::INT AS forzato
FROM chunk WHERE length(testo) > 2500 GROUP BY id
"""


P3_COVER_SQL = "SELECT DISTINCT id, md5(testo) AS impronta, true AS entro, true AS ripetuti_entro, true AS tutti_ripetono FROM chunk WHERE testo IS NOT NULL"

P5_CLASSES_SQL = r"""
WITH texts AS (SELECT testo, min(id) AS classe FROM chunk WHERE testo IS NOT NULL GROUP BY testo), words AS (SELECT classe, regexp_extract_all(lower(testo), '[\p{L}\p{N}_]+') AS w FROM texts),
sets AS (SELECT classe, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS s FROM words WHERE len(w) >= 60),
sizes AS (SELECT classe, count(*) AS n FROM sets GROUP BY classe), shared AS (SELECT a.classe AS a, b.classe AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.classe < b.classe GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.classe = a JOIN sizes y ON y.classe = b WHERE c >= 0.6 * (x.n + y.n - c) - 1e-9), n AS (SELECT classe, count(*) AS legami FROM (SELECT a AS classe FROM links UNION ALL SELECT b FROM links) GROUP BY classe)
SELECT DISTINCT chunk.id, texts.classe, coalesce(legami, 0) AS legami FROM chunk JOIN texts USING (testo) JOIN sizes ON sizes.classe = texts.classe LEFT JOIN n ON n.classe = texts.classe
"""

P8_SHARES_SQL = r"""
WITH f AS (SELECT doc_id, length(text) AS n, length(regexp_replace(text, '[^\p{L}\p{M}]+', '', 'g')) AS l, length(regexp_replace(text, '[^\p{N}]+', '', 'g')) AS d, length(regexp_replace(text, '[^\s\x0B]+', '', 'g')) AS s, len(regexp_extract_all(text, '[\p{L}\p{M}]+')) AS w FROM documents)
SELECT doc_id, w AS parole, round(CASE WHEN n IS NULL THEN NULL WHEN w > 0 THEN l / w ELSE 0 END, 6) AS lunghezza_media, round(CASE WHEN n IS NULL THEN NULL WHEN n > 0 THEN (n - l - d - s) / n ELSE 0 END, 6) AS quota_simboli,
round(CASE WHEN n IS NULL THEN NULL WHEN n > 0 THEN d / n ELSE 0 END, 6) AS quota_cifre, round(CASE WHEN n IS NULL THEN NULL WHEN n > 0 THEN l / n ELSE 0 END, 6) AS quota_lettere FROM f
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_repaired, p2_found, p2_classes, p2_forms, p3_found, p3_pieces, p3_cover, p4_found, p4_neighbours, p5_found, p5_classes, p6_ids, p7_found, p7_containers, p8_found, p8_figures, p8_shares)}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": P2_SQL,
        "p2_classes": P2_CLASSES_SQL,
        "p2_forms": f"SELECT id, CASE WHEN testo IS NOT NULL THEN t END AS forma FROM ({_form_sql('chunk')})",
        "p3_found": P3_SQL,
        "p3_cover": P3_COVER_SQL,
        "p5_found": P5_SQL,
        "p5_classes": P5_CLASSES_SQL,
        "p8_shares": P8_SHARES_SQL,
    }
