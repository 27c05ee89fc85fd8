"""Problem 2: one form for texts that look the same, by DuckDB inside Arrow partitions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrinium.durable import durable

#: Letters of other scripts that look like Latin ones in upright type, and these: a choice made here.  Letters that only
#: resemble one (α, ι, к, т) are none.
LOOKALIKES = {
    "Cyrillic": ("АВЕЁЅІЇЈКМНОРСТУХаеёѕіїјорсухԁһԛԜԝԌӀӏҮүѴѵ", "ABEËSIÏJKMHOPCTYXaeësiïjopcyxdhqWwGIlYyVv"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧΪΫΆΈΉΊΌΎϹνοόρϲϳ", "ABEZHIKMNOPTYXÏŸÁÉHÍÓÝCvoópcj"),
    "Armenian": ("ՍՏՕԼսոհօցզյ", "USOLunhogqj"),
    "Cherokee": ("ᎪᎬᎠᏴᏟᎡᏀᎻᎫᏦᏞᎷᏢᎢᏙᎳᎩᏃᏚ", "AEDBCRGHJKLMPTVWYZS"),
}
#: Signs for joined letters, and what they join.
JOINED = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "Ĳ": "IJ", "ĳ": "ij", "Ǆ": "DŽ", "ǅ": "Dž", "ǆ": "dž", "Ǉ": "LJ", "ǈ": "Lj", "ǉ": "lj", "Ǌ": "NJ", "ǋ": "Nj", "ǌ": "nj"}
#: Short hyphens; dashes of another length look different and stay.
HYPHENS = "\u2010\u2011\ufe63\uff0d\u00ad"
#: Characters without a look of their own, as ranges of a regular expression.
INVISIBLE = r"\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}"
_EMOJI = r"[\x{2190}-\x{2BFF}\x{1F000}-\x{1FAFF}]"


def widths() -> tuple[str, str]:
    """Characters that differ from another one only in width, and that one; the pairs are in the character database."""
    a, b = [], []
    for k in [0x3000, *range(0xFF01, 0xFFEF)]:
        how = unicodedata.decomposition(chr(k)).split()
        if how and how[0] in ("<wide>", "<narrow>") and len(how) == 2 and chr(k) not in HYPHENS:
            a.append(chr(k))
            b.append(chr(int(how[1], 16)))
    return "".join(a), "".join(b)


def spaces() -> str:
    """Every space of the character database."""
    return "".join(chr(k) for k in range(0x80, 0x10000) if unicodedata.category(chr(k)) == "Zs" and k != 0x3000)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def canonical_sql(column: str, source: str = "lotto") -> str:
    """The statement that DuckDB runs on a batch: all its columns, ``column`` in canonical form.

    In order: widths, spaces, hyphens and look-alikes by one ``translate`` (a soft hyphen that ends a line is
    seen and becomes a hyphen; any other is invisible), invisible characters by a regular expression (a joiner
    between two pictographs stays, since it changes the picture), joined letters, then ``nfc_normalize``.  Last, a
    word that has letters only its own script has, and none that only Latin has, goes back to that script as a whole.
    """
    wide, narrow = widths()
    blanks = spaces()
    hyphens = HYPHENS.replace("\u00ad", "")
    pairs: dict[str, str] = {}
    for a, b in ((wide, narrow), (blanks, " " * len(blanks)), (hyphens, "-" * len(hyphens)), *LOOKALIKES.values()):
        pairs |= dict(zip(a, b, strict=True))
    text = f"replace(replace({column}, chr(173) || chr(10), '-' || chr(10)), chr(173) || chr(13), '-' || chr(13))"
    text = f"CASE WHEN contains({column}, chr(173)) THEN {text} ELSE {column} END"
    text = f"translate({text}, {_quoted(''.join(pairs))}, {_quoted(''.join(pairs.values()))})"
    kept = f"regexp_replace(regexp_replace(t, '({_EMOJI}\\x{{FE0F}}?)\\x{{200D}}({_EMOJI})', '\\1\ue000\\2', 'g'), '({_EMOJI}\\x{{FE0F}}?)\\x{{200D}}({_EMOJI})', '\\1\ue000\\2', 'g')"
    visible = f"CASE WHEN regexp_matches(t, '{_EMOJI}\\x{{FE0F}}?\\x{{200D}}{_EMOJI}') THEN replace(regexp_replace({kept}, '[{INVISIBLE}]', '', 'g'), '\ue000', chr(8205)) ELSE regexp_replace(t, '[{INVISIBLE}]', '', 'g') END"
    apart = "t"
    for sign, letters in JOINED.items():
        apart = f"replace({apart}, {_quoted(sign)}, {_quoted(letters)})"
    apart = f"CASE WHEN regexp_matches(t, '[{''.join(JOINED)}]') THEN {apart} ELSE t END"
    cases = ""
    for script, (own, latin) in LOOKALIKES.items():
        here = dict(reversed(list(zip(latin, own, strict=True))))
        foreign = "".join(c for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" if c not in latin)
        cases += f" WHEN regexp_matches(w, '\\p{{{script}}}') AND NOT regexp_matches(w, '[{foreign}]') THEN translate(w, {_quoted(''.join(here))}, {_quoted(''.join(here.values()))})"
    home = f"array_to_string(list_transform(regexp_extract_all(t, '[\\p{{L}}\\p{{M}}]+|[^\\p{{L}}\\p{{M}}]+'), lambda w: CASE{cases} ELSE w END), '')"
    home = f"CASE WHEN regexp_matches(t, '[{''.join(f'\\p{{{s}}}' for s in LOOKALIKES)}]') THEN {home} ELSE t END"
    sql = f"SELECT *, {text} AS t FROM {source}"
    for step in (visible, apart, "nfc_normalize(t)", home, "nfc_normalize(t)"):
        sql = f"SELECT * REPLACE ({step} AS t) FROM ({sql})"
    return sql


def canonical_form(df: DataFrame, text: str = "testo", out: str = "forma") -> DataFrame:
    """``df`` with the canonical form of ``text`` in ``out``: equal exactly where texts look the same.

    One pass without a shuffle; only ``text`` is worked on, the other columns ride along in Arrow.  Null text: null
    form; empty text: empty form; repeated rows stay repeated; a column that already has the name ``out`` is replaced.
    """
    df = df.select(*[c for c in df.columns if c != out])
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])
    names = df.columns
    sql = f'SELECT * RENAME (t AS o) FROM ({canonical_sql("c", "lotto")})'

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        # a file-less database with one thread: Spark gives each core its own worker
        con = duckdb.connect(config={"threads": 1})
        for batch in batches:
            lotto = pa.table({"i": pa.array(range(batch.num_rows), pa.int32()), "c": batch.column(names.index(text))})  # noqa: F841
            con.register("lotto", lotto)
            done = con.sql(sql + " ORDER BY i").to_arrow_table()
            con.unregister("lotto")
            form = done.column("o").combine_chunks().cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, form], names=[*names, out])

    return df.mapInArrow(work, schema)


def look_classes(df: DataFrame, key: str = "id", text: str = "testo") -> DataFrame:
    """(id, classe, variante): the smallest id whose text looks the same, and the smallest one whose text is the same.

    Only hashes of form and text (SHA-256) are shuffled, never texts, and both smallest ids are found by partial
    aggregation.  Null text: no row; repeated rows count once.
    """
    source = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("testo")).filter(F.col("testo").isNotNull() & F.col("id").isNotNull())
    hashed = canonical_form(source).select("id", F.unhex(F.sha2("forma", 256)).alias("f"), F.unhex(F.sha2("testo", 256)).alias("t")).distinct()
    hashed = durable(hashed)  # the forms are made once
    variants = hashed.groupBy("f", "t").agg(F.min("id").alias("variante"))
    looks = variants.groupBy("f").agg(F.min("variante").alias("classe"))
    return durable(hashed.join(variants, ["f", "t"]).join(looks, "f").select("id", "classe", "variante"))


def same_look_pairs(classes: DataFrame) -> DataFrame:
    """Pairs (id_a, id_b), id_a < id_b, of rows whose texts differ in characters and look the same.

    Different texts of a class are paired by their representatives; then each side brings the rows with its text.  Equal
    texts never meet, so copies without a variant, however many, make no candidates.
    """
    texts = classes.select("classe", "variante").distinct()
    mixed = texts.filter("variante <> classe").select("classe").distinct()
    texts = texts.join(mixed, "classe", "left_semi")
    pairs = texts.select("classe", F.col("variante").alias("a")).join(texts.select("classe", F.col("variante").alias("b")), "classe").filter("a < b").select("a", "b")
    members = classes.join(mixed, "classe", "left_semi").select("variante", "id")
    both = pairs.join(members.select(F.col("variante").alias("a"), F.col("id").alias("x")), "a").join(members.select(F.col("variante").alias("b"), F.col("id").alias("y")), "b")
    return both.filter("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
