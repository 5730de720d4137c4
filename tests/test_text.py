"""Text functions against Python's own, and the expectations of FIXTURES.md."""

import re
import unicodedata

import pytest

from corpuslens.functions import text as T
from corpuslens.functions import values as V
from corpuslens.functions.unicode_tables import combining_class

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
MAP = {0x2018: "'", 0x2019: "'", 0x201A: "'", 0x201C: '"', 0x201D: '"', 0x201E: '"', 0x2013: "-", 0x2014: "-", 0x2026: "...", 0xA0: " "}
TEXTS = ["", " ", "Ē t'orla, “vin'de”!", "T’orla 12", "solēmi  pōraati\t x", "áb̧ …–—", "ﬁ ½ Ⅷ x2y _z", "İ ß Σς", "é​é  z", "a. b? c d e; f g h\nx y z", None]


def norm(x):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFC", x).translate(MAP)).strip()


def strip(x):
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c)))


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)], "id int, text string")


def column(df, col):
    return [r.x for r in df.select("id", col.alias("x")).orderBy("id").collect()]


@pytest.mark.parametrize(
    "made, wanted",
    [
        (T.normalize_text, norm),
        (T.strip_diacritics, strip),
        (T.detect_diacritics, lambda x: unicodedata.normalize("NFC", x) != strip(x)),
        (T.words, lambda x: WORD.findall(norm(x).lower())),
        (T.plain_words, lambda x: WORD.findall(strip(norm(x)).lower())),
        (T.sentences, lambda x: [s.strip() for s in re.split(r"(?<=[.!?;:])\s+|\n+", x) if len(WORD.findall(strip(norm(s)).lower())) >= 3]),
        (T.scoring_form, lambda x: " ".join(re.sub(r"[^\w\s']", " ", norm(x).lower()).split())),
    ],
)
def test_as_python(rows, made, wanted):
    assert column(rows, made("text")) == [None if x is None else wanted(x) for x in TEXTS]


def test_strip_every_code_point(spark):
    """All code points that Java knows give what Python gives."""
    points = [i for i in range(0x30000) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i)) != "Cn"]
    df = spark.createDataFrame([(i, f"a{chr(i)}b") for i in points], "id int, text string")
    found = dict(df.select("id", T.strip_diacritics("text").alias("x")).collect())
    wrong = [hex(i) for i in points if found[i] != strip(f"a{chr(i)}b")]
    assert len(wrong) < 40, wrong  # characters newer than Java's Unicode version


def test_combining_class_is_from_unicode_data():
    assert re.match(r"^\[\\x\{300\}-", combining_class())


def test_cells_and_contexts(spark):
    df = spark.createDataFrame([("\ta\r\nb ",), (None,)], "text string")
    assert [r[0] for r in df.select(T.clean_cell("text")).collect()] == ["a b", ""]
    one = spark.createDataFrame([("ab",), ("",), ("xyz",)], "p string").select("p", T.char_contexts("p").alias("c")).collect()
    assert [(c.at, c.k, c.key) for c in one[0].c] == [(0, 0, "0|_|a"), (0, 1, "1|^_b|a"), (0, 2, "2|^_b$|a"), (0, 3, "3|^_b$|a")]
    assert one[1].c == [] and one[2].c == []


def test_match_case(spark):
    cases = [("abc", "ābc", "ābc"), ("ABC", "ābc", "ĀBC"), ("Abc", "ābc", "Ābc"), ("A", "ā", "Ā"), ("", "x", ""), ("aB", "āb", "āB")]
    df = spark.createDataFrame(cases, "s string, r string, want string")
    assert all(r.x == r.want for r in df.withColumn("x", T.match_case("s", "r")).collect())


def test_values(spark):
    sizes = spark.createDataFrame([(None,), (999,), (1500,), (3_400_000,), (8_300_000_000,)], "n bigint")
    assert [r[0] for r in sizes.select(V.human_bytes("n")).collect()] == ["size unknown", "999 B", "1.5 KB", "3.4 MB", "8.3 GB"]
    cite = spark.createDataFrame([("h_Ort[11-19];5501",)], "s string").select(V.citation_keys("s").alias("k")).first().k
    assert set(cite) == {"h_Ort", "5501"}


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "a", "b", "a"],), (["a"],)], "w array<string>")
    assert [r[0] for r in df.select(T.ngrams("w", 2)).collect()] == [["a b", "b a"], []]


def test_streams_run_the_same_plan(spark, tmp_path):
    from corpuslens.streaming import text_stream

    spark.createDataFrame([(1, "Élan  vital"), (2, " ")], "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    out = text_stream.normalized(text_stream.read_stream(spark, f"{tmp_path}/in"))
    query = out.writeStream.format("memory").queryName("normal").option("checkpointLocation", f"{tmp_path}/ck").start()
    query.processAllAvailable()
    query.stop()
    assert [(r.norm, r.marked, r.n_words) for r in spark.table("normal").collect()] == [("Élan vital", True, 2)]
