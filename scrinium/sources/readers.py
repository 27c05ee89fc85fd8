"""Readers of document formats: bytes to text, by suffix.

Each reader is a plain function of bytes; ``extract`` runs the right one inside Arrow partitions.  Formats that need a
program or library that isn't here (old Word files, recognition of images) go through hooks, and a file whose format no
reader or hook takes is reported as such, never dropped silently.
"""

from __future__ import annotations

import datetime
import email
import email.policy
import html
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrinium.functions.text import normalised, suffix, windows

Reader = Callable[[bytes], str]
#: Versions of readers, by suffix; where one changes, its files are read again.
VERSIONS: dict[str, str] = {".xml": "2"}
IMAGES = frozenset({".png", ".jpg", ".jpeg", ".tiff", ".tif", ".heic"})
PACKAGE_PART = "[Content_Types].xml"


def plain(content: bytes) -> str:
    """UTF-8 text; broken bytes become U+FFFD. Comma separated values stay text."""
    return content.decode("utf-8", "replace")


_MARKUP = re.compile(r"<(script|style)\b.*?</\1\s*>|<[^>]+>", re.IGNORECASE | re.DOTALL)


def markup_text(text: str) -> str:
    """Text without scripts, styles and tags, entities decoded."""
    return html.unescape(_MARKUP.sub(" ", text))


def web_page(content: bytes) -> str:
    return markup_text(plain(content))


def xml(content: bytes) -> str:
    """Text of all elements, a line each; malformed markup loses its tags."""
    try:
        return "\n".join(filter(None, map(str.strip, ET.fromstring(content).itertext())))
    except ET.ParseError:
        return markup_text(plain(content))


def mail(content: bytes) -> str:
    """Headers, body (plain rather than marked up; empty if damaged) and names of attachments."""
    message = email.message_from_bytes(content, policy=email.policy.default)
    bodies: dict[str, str] = {}
    names = []
    for part in message.walk():
        if part.is_multipart():
            continue
        if part.is_attachment() or part.get_filename():
            names += [part.get_filename()] if part.get_filename() else []
        elif part.get_content_type() in ("text/plain", "text/html"):
            try:
                bodies.setdefault(part.get_content_subtype(), part.get_content())
            except (LookupError, ValueError, KeyError):
                bodies.setdefault(part.get_content_subtype(), "")
    text = bodies["plain"] if "plain" in bodies else markup_text(bodies.get("html", ""))
    # The headers that are kept, and what stands before the names.
    lines = [f"{h}: {message[h]}" for h in ("From", "To", "Cc", "Subject", "Date") if message[h]]
    return "\n".join([*lines, text, *(["allegati: " + ", ".join(names)] if names else [])])


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


#: What stands for a tab and for a break in office markup, and what holds settings instead of text.
_SIGNS = {"tab": "\t", "br": "\n", "cr": "\n"}
_SETTINGS = frozenset({"pPr", "rPr", "sectPr", "tblPr", "del", "instrText", "rPh", "phoneticPr"})


def _joined(element: ET.Element) -> str:
    """The text of a paragraph, with its tabs and breaks."""
    out = []
    for e in element:
        name = _local(e.tag)
        if name == "t":
            out.append(e.text or "")
        elif name in _SIGNS:
            out.append(_SIGNS[name])
        elif name not in _SETTINGS:
            out.append(_joined(e))
    return "".join(out)


def word(content: bytes) -> str:
    """Paragraphs of the body, then the rows of all its tables, cells apart by ' | '."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    body = next(e for e in root if _local(e.tag) == "body")
    paragraphs = [_joined(e) for e in body if _local(e.tag) == "p"]
    rows = []
    for table in (e for e in body if _local(e.tag) == "tbl"):
        for row in (e for e in table if _local(e.tag) == "tr"):
            rows.append(" | ".join("\n".join(_joined(p) for p in cell if _local(p.tag) == "p") for cell in row if _local(cell.tag) == "tc"))
    return "\n".join([*paragraphs, *rows])


def sheets(content: bytes) -> str:
    """A title line for each sheet, then its rows: stored values, empty cells and rows left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = [_joined(e) for e in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        targets = {}
        if "xl/_rels/workbook.xml.rels" in names:
            targets = {e.get("Id"): e.get("Target", "").lstrip("/") for e in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        book = ET.fromstring(z.read("xl/workbook.xml"))
        dated = _dated(z.read("xl/styles.xml") if "xl/styles.xml" in names else None)
        start = 1904 if any(_local(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true") for e in book) else 1899
        for k, sheet in enumerate((e for e in book.iter() if _local(e.tag) == "sheet"), 1):
            link = next((v for a, v in sheet.attrib.items() if _local(a) == "id"), None)
            at = targets.get(link, f"worksheets/sheet{k}.xml")
            at = at if at.startswith("xl/") else f"xl/{at}"
            out.append(f"# foglio: {sheet.get('name')}")
            if at not in names:
                continue
            for row in (e for e in ET.fromstring(z.read(at)).iter() if _local(e.tag) == "row"):
                cells = [c for c in (_cell(e, shared, dated, start) for e in row if _local(e.tag) == "c") if c is not None]
                if cells:
                    out.append(" | ".join(cells))
    return "\n".join(out)


def _dated(styles: bytes | None) -> set[int]:
    """Numbers of the cell styles that show a date or a time."""
    if styles is None:
        return set()
    root = ET.fromstring(styles)
    # Formats that are dates or times without being written out.
    dates = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
    for e in root.iter():
        if _local(e.tag) == "numFmt" and re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\\.|\[(?!h|m|s)[^\]]*\]|_.|\*.', "", e.get("formatCode", "").lower())):
            dates.add(int(e.get("numFmtId", -1)))
    cells = next((e for e in root if _local(e.tag) == "cellXfs"), [])
    return {k for k, e in enumerate(cells) if int(e.get("numFmtId", 0)) in dates}


def _date(value: str, start: int) -> str:
    """A serial number of days as date and time, less than one as a time."""
    days = float(value)
    if 0 <= days < 1:
        return str((datetime.datetime(1900, 1, 1) + datetime.timedelta(milliseconds=round(days * 86_400_000))).time())
    days += 1 if start == 1899 and days < 60 else 0  # the calendar of the format has a 29 February 1900
    return str((datetime.datetime(1904, 1, 1) if start == 1904 else datetime.datetime(1899, 12, 30)) + datetime.timedelta(milliseconds=round(days * 86_400_000)))


def _cell(cell: ET.Element, shared: list[str], dated: set[int], start: int) -> str | None:
    value = next((e.text for e in cell if _local(e.tag) == "v"), None)
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return _joined(cell) or None
    if value is None:
        return None
    if kind == "s":
        return shared[int(value)]
    if kind == "n" and int(cell.get("s", 0)) in dated:
        try:
            return _date(value, start)
        except (ValueError, OverflowError):
            return value
    return {"1": "True", "0": "False"}.get(value, value) if kind == "b" else value


def slides(content: bytes) -> str:
    """Text frames of all slides, in order; no tables, notes or groups."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        found = sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
        if {"ppt/presentation.xml", "ppt/_rels/presentation.xml.rels"} <= names:  # the order in which they are shown
            targets = {e.get("Id"): e.get("Target", "").lstrip("/") for e in ET.fromstring(z.read("ppt/_rels/presentation.xml.rels"))}
            shown = [next((v for a, v in e.attrib.items() if a.startswith("{") and _local(a) == "id"), None) for e in ET.fromstring(z.read("ppt/presentation.xml")).iter() if _local(e.tag) == "sldId"]
            parts = [t if t.startswith("ppt/") else f"ppt/{t}" for t in (targets.get(k, "") for k in shown)]
            found = [n for n in parts if n in names] or found
        lines = []
        for name in found:
            root = ET.fromstring(z.read(name))
            tree = next((e for e in root.iter() if _local(e.tag) == "spTree"), root)
            for shape in (e for e in tree if _local(e.tag) == "sp"):
                for body in (e for e in shape if _local(e.tag) == "txBody"):
                    lines.append("\n".join(_joined(p) for p in body if _local(p.tag) == "p"))
    return "\n".join(lines)


def pdf(content: bytes) -> str:
    """Text layer of a PDF, page after page, by whichever library is installed."""
    try:
        from pypdf import PdfReader
    except ImportError as error:
        raise Unsupported("no PDF library") from error
    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages)


def prose_strings(tree: object) -> list[str]:
    """Strings of prose anywhere in nested dicts and lists, each once, in order."""
    found: dict[str, None] = {}
    todo = [tree]
    while todo:
        value = todo.pop()
        if isinstance(value, str):
            text = value.strip()
            if 4 <= len(text) <= 5000 and " " in text and any(map(str.isalpha, text)) and text.count("-") < 4:
                found.setdefault(text)
        elif isinstance(value, dict):
            todo.extend(reversed(list(value.values())))
        elif isinstance(value, (list, tuple)):
            todo.extend(reversed(value))
    return list(found)


def presentation(content: bytes) -> str:
    """Prose of a presentation archive, whose parts an optional library decodes."""
    try:
        from keynote_parser.codec import IWAFile
    except ImportError as error:
        raise Unsupported("no library for this archive") from error
    found, broken = [], 0
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in sorted(n for n in z.namelist() if n.endswith(".iwa")):
            try:
                found.append(IWAFile.from_buffer(z.read(name), name).to_dict())
            except Exception:  # noqa: BLE001 - a part that can't be read doesn't take the others with it
                broken += 1
    if broken and not found:
        raise ValueError("no part of the archive can be read")
    return "\n".join(prose_strings(found))


def spreadsheet_package(content: bytes) -> str:
    """Sheets, tables and rows of a spreadsheet package, by an optional library."""
    try:
        from numbers_parser import Document
    except ImportError as error:
        raise Unsupported("no library for this package") from error
    import tempfile

    with tempfile.NamedTemporaryFile(suffix=".numbers") as f:
        f.write(content)
        f.flush()
        lines = []
        for sheet in Document(f.name).sheets:
            lines.append(f"# foglio: {sheet.name}")
            for table in sheet.tables:
                for row in table.rows(values_only=True):
                    cells = [str(c) for c in row if c is not None]
                    lines += [" | ".join(cells)] if cells else []
    return "\n".join(lines)


def outlook(content: bytes) -> str:
    """A message file, by an optional library: headers, body, names of attachments."""
    try:
        import extract_msg
    except ImportError as error:
        raise Unsupported("no library for this message format") from error
    with extract_msg.Message(content) as m:
        heads = [f"{name}: {value}" for name, value in (("From", m.sender), ("To", m.to), ("Subject", m.subject), ("Date", m.date)) if value]
        names = [n for a in m.attachments or [] if (n := a.longFilename or a.shortFilename)]
        return "\n".join([*heads, m.body or ""]) + (f"\nallegati: {', '.join(names)}" if names else "")


class Unsupported(Exception):
    """No reader, library or hook for this format here."""


READERS: dict[str, Reader] = {
    ".txt": plain, ".md": plain, ".csv": plain, ".html": web_page, ".htm": web_page, ".xml": xml, ".eml": mail,
    ".docx": word, ".xlsx": sheets, ".pptx": slides, ".pdf": pdf, ".msg": outlook, ".numbers": spreadsheet_package, ".key": presentation,
}

_OUT = "percorso string, mtime double, dimensione long, impronta string, testo string, ocr boolean, stato string"
READ, EMPTY, DEFERRED, UNREADABLE, UNSUPPORTED = "letto", "vuoto", "rimandato", "errore", "non_supportato"


def read_one(ext: str, content: bytes, readers: dict[str, Reader], recognise: Callable[[bytes, str], str] | None) -> tuple[str | None, bool, str]:
    """(text, from recognition, state) of one file.

    Images, and PDFs without a text layer, go to ``recognise``; without that hook they are deferred: nothing is recorded,
    so that a later pass tries again.  An error concerns its file only.
    """
    try:
        if ext in IMAGES:
            return (recognise(content, ext), True, READ) if recognise else (None, False, DEFERRED)
        if ext not in readers:
            return None, False, UNSUPPORTED
        text = readers[ext](content)
        if ext == ".pdf" and not text.strip():
            return (recognise(content, ext), True, READ) if recognise else (None, False, DEFERRED)
        return text, False, READ
    except Unsupported:
        return None, False, UNSUPPORTED
    except Exception as error:  # noqa: BLE001 - any damage of a file is that file's
        return f"{type(error).__name__}: {error}"[:300], False, UNREADABLE


def read_bytes(path: str) -> bytes:
    """A file's content; a path with a scheme (an object store, HDFS) is opened by the Arrow file system of that scheme."""
    if "://" in path:
        files, inner = pa.fs.FileSystem.from_uri(path)
        with files.open_input_stream(inner, compression=None) as f:
            return f.read()
    with open(path, "rb") as f:
        return f.read()


def scan(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(percorso, mtime, dimensione) of all files below the roots; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    path = F.regexp_replace(F.col("path"), r"^file:/+", "/")
    return files.select(path.alias("percorso"), F.col("modificationTime").cast("double").alias("mtime"), F.col("length").alias("dimensione"))


def without_packages(listing: DataFrame) -> DataFrame:
    """The listing without what lies in an unpacked office package (a directory with a content-types part)."""
    packages = listing.filter(F.endswith("percorso", F.lit("/" + PACKAGE_PART))).select(F.regexp_replace("percorso", r"/[^/]*$", "").alias("cartella"))
    parts = F.split("percorso", "/")
    # each directory above a file is looked up: an equality join instead of a comparison of prefixes
    above = listing.select("percorso", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("cartella"))
    inside = above.join(packages, "cartella", "left_semi").select("percorso").distinct()
    return listing.join(inside, "percorso", "left_anti")


def extract(spark: SparkSession, paths: DataFrame, readers: dict[str, Reader] | None = None, recognise: Callable[[bytes, str], str] | None = None) -> DataFrame:
    """(percorso, mtime, dimensione, impronta, testo, ocr, stato): text of the listed files, normalised.

    Only the listed files are opened, each by the task that got its path; ``impronta`` is the SHA-256 of the bytes.
    """
    import hashlib

    table = dict(READERS if readers is None else readers)
    rows = paths.select("percorso", "mtime", "dimensione", suffix(F.col("percorso")).alias("ext")).repartition(F.col("percorso"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, mtime, size, ext in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    content = read_bytes(path)
                    text, ocr, state = read_one(ext, content, table, recognise)
                    digest = hashlib.sha256(content).hexdigest()
                except (OSError, pa.ArrowInvalid) as error:
                    text, ocr, state, digest = str(error)[:300], False, UNREADABLE, None
                yield pa.RecordBatch.from_pylist([{"percorso": path, "mtime": mtime, "dimensione": size, "impronta": digest, "testo": text, "ocr": ocr, "stato": state}], schema=pa.schema([("percorso", pa.string()), ("mtime", pa.float64()), ("dimensione", pa.int64()), ("impronta", pa.string()), ("testo", pa.string()), ("ocr", pa.bool_()), ("stato", pa.string())]))

    read = rows.mapInArrow(work, _OUT)
    text = F.when(F.col("stato") == READ, normalised(F.col("testo"))).otherwise(F.col("testo"))
    read = read.withColumn("testo", text)
    return read.withColumn("stato", F.when((F.col("stato") == READ) & (F.col("testo") == ""), EMPTY).otherwise(F.col("stato")))


def chunked(extracted: DataFrame) -> DataFrame:
    """(percorso, n, testo): windows of the texts that were read."""
    return extracted.filter(F.col("stato") == READ).select("percorso", F.posexplode(windows(F.col("testo"))).alias("n", "testo"))
