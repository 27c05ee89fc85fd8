import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scrinium.functions import text as T
from scrinium.functions import vectors as V


def run(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in df.select(expression(F.col("x"))).collect()]


def windows(t):
    return [t] if 0 < len(t) <= 2500 else [t[i : i + 2500] for i in range(0, len(t), 2100)]


def test_windows(spark):
    texts = ["", "a", "b" * 2500, "c" * 2501, "d" * 4200, "e" * 4201, "f" * 4300, "😀" * 2600]
    assert run(spark, texts, T.windows) == [windows(t) for t in texts]
    assert run(spark, [None], T.windows) == [[]]


def test_normalised(spark):
    texts = ["éa\r\n\n  x  \n\x1cy\x85z", "", "   ", None, "a b", "x" * 10000 + " "]

    def plain(t):
        return None if t is None else "\n".join(x for x in (r.strip() for r in unicodedata.normalize("NFC", t).splitlines()) if x)

    assert run(spark, texts, T.normalised) == [plain(t) for t in texts]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aÀ1_ \n\t'-²½ж", max_size=30), min_size=1, max_size=20))
def test_words_are_those_of_python(spark, texts):
    assert run(spark, texts, T.words) == [re.findall(r"\w+", t.lower()) for t in texts]


def test_snippet(spark):
    assert run(spark, ["a  b\n c", "x" * 181, "", None, " \t "], T.snippet) == ["a b c", "x" * 180 + "…", "", None, ""]


@pytest.mark.parametrize(("path", "ext", "suffix"), [("/a.b/c", ".b/c", ""), ("/a/c.PDF", ".pdf", ".pdf"), ("/a/b", "(nessuna)", ""), ("/a/.nascosto", ".nascosto", ""), ("/a/x.tar.gz", ".gz", ".gz")])
def test_extensions(spark, path, ext, suffix):
    assert run(spark, [path], T.path_extension) == [ext]
    assert run(spark, [path], T.suffix) == [suffix]


def test_html(spark):
    assert run(spark, ["<p>a&amp;b</p><script>x<1</script>c&egrave;"], T.html_text) == [" a&b  cè"]


def test_prose(spark):
    texts = ["TSP.ArchiveInfo", "una frase", "abc", "a-b-c-d e-f", "1234 567", None]
    assert run(spark, texts, T.is_prose) == [False, True, False, False, False, None]


def test_vectors(spark):
    import struct

    blobs = [struct.pack("<2f", 3, 4), b"abc", None]
    df = spark.createDataFrame([(b,) for b in blobs], "x binary").select(V.from_bytes("x").alias("v"))
    got = df.select(V.unit(F.col("v")).alias("u"), V.norm(F.col("v")).alias("n")).collect()
    assert got[0].u == pytest.approx([0.6, 0.8])
    assert got[0].n == 5
    assert got[1].u is None and got[2].u is None
    blobs += [struct.pack("<2f", 0, 0), struct.pack("<2f", float("nan"), 1), struct.pack("<2f", float("inf"), 1)]
    units = run(spark, blobs, V.unit_from_bytes(2), "binary")
    assert units[0] == pytest.approx([0.6, 0.8]) and units[1:] == [None] * 5
    assert run(spark, [[0.0, 0.0]], V.unit, "array<double>") == [[0.0, 0.0]]
    a, b, c = (r[0] for r in spark.createDataFrame([("Casa casa",), ("casa",), (None,)], "x string").select(V.hashing_embedder(16)("x")).collect())
    assert a == pytest.approx(b) and not any(c)
