"""Text expressions; all native but Unicode composition and entity decoding, which Spark lacks."""

from __future__ import annotations

import fnmatch
import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WINDOW, OVERLAP = 2500, 400
SNIPPET = 180
WORD = r"[\p{L}\p{N}_]+"
# What counts as white space at the ends of a line.
_BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"
_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def _entities(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else html.unescape(t))


def composed(text: Column) -> Column:
    """NFC; only texts with a character beyond Latin-1 can change, so only these visit Python."""
    odd = text.rlike(r"[^\x00-\xff]")
    return F.when(odd, _composed(F.when(odd, text))).otherwise(text)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{_BLANK}+|{_BLANK}+\z", "")


def normalised(text: Column) -> Column:
    """NFC, each line stripped, blank lines dropped, lines joined by a line feed. Null stays null, blank becomes empty."""
    lines = F.transform(F.split(composed(text), _LINE_END), stripped)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def windows(text: Column, size: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """Array of windows: a text up to ``size`` is one, a longer one gives a window every ``size - overlap``. Empty or null text: none."""
    step = size - overlap
    n = F.when(F.length(text) == 0, 0).when(F.length(text) <= size, 1).otherwise(F.ceil(F.length(text) / step)).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(text, i * step + 1, F.lit(size)))


def words(text: Column) -> Column:
    """Lower-case words: longest runs of letters, digits and underscore."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1)


def snippet(text: Column, limit: int = SNIPPET) -> Column:
    """White space collapsed, cut to ``limit`` characters, with an ellipsis if anything was cut."""
    flat = stripped(F.regexp_replace(text, rf"{_BLANK}+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("…"))).otherwise(flat)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def suffix(path: Column) -> Column:
    """Lower-case suffix of the file name ('' if it has none), by which readers are chosen."""
    return F.lower(F.regexp_extract(basename(path), r"^.+?(\.[^.]+)$", 1))


def path_extension(path: Column) -> Column:
    """Extension for statistics: from the last dot of the whole path, lower case; '(nessuna)' without a dot."""
    return F.when(path.contains("."), F.concat(F.lit("."), F.lower(F.substring_index(path, ".", -1)))).otherwise("(nessuna)")


def extractor_version(ext: Column, versions: dict[str, str]) -> Column:
    """Version of the reader of an extension, '1' where none is given."""
    out = F.lit("1")
    for e, v in versions.items():
        out = F.when(ext == e, v).otherwise(out)
    return out


def is_prose(text: Column) -> Column:
    """Strings worth keeping from a binary package: 4 to 5000 characters, a space (names of types have none), a letter, few hyphens."""
    return F.length(text).between(4, 5000) & text.contains(" ") & text.rlike(r"\p{L}") & (F.regexp_count(text, F.lit("-")) < 4)


def without_tags(markup: Column) -> Column:
    """Markup without scripts, styles and tags (each becomes a space), entities not yet decoded."""
    bare = F.regexp_replace(markup, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>", " ")
    return F.regexp_replace(bare, r"(?s)<[^>]+>", " ")


def html_text(markup: Column) -> Column:
    """``without_tags`` with entities decoded."""
    return _entities(without_tags(markup))


def glob_regex(pattern: str) -> str:
    """A file-name pattern (case counts) as a regular expression of the whole name, in syntax that Java knows."""
    return "^" + fnmatch.translate(pattern).replace("\\Z", "\\z")


def effective_key(text_hash: Column, byte_hash: Column) -> Column:
    """By which copies are recognised: the text's hash if known, else the bytes'."""
    return F.when(F.coalesce(text_hash, F.lit("")) != "", text_hash).otherwise(byte_hash)
