"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.functions import values as V
from corpuslens.plans import base as B
from corpuslens.plans.base import dirty, query, read


@query(f"SELECT doc_id, {B.norm('text')} AS norm FROM {B.DIRTY}")
def normalize_text(spark, sf_dir):
    return dirty(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.normalize_text("text").alias("norm"))


@query(f"SELECT doc_id, {B.strip('text')} AS stripped FROM {B.DIRTY}")
def strip_diacritics(spark, sf_dir):
    return dirty(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.strip_diacritics("text").alias("stripped"))


@query(f"SELECT doc_id, nfc_normalize(text) <> {B.strip('text')} AS marked FROM {B.DIRTY}")
def detect_diacritics(spark, sf_dir):
    return dirty(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.detect_diacritics("text").alias("marked"))


@query(f"SELECT doc_id, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS pos, unnest(w) AS word FROM (SELECT doc_id, {B.words('text')} AS w FROM documents)")
def word_tokens(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.words("text").alias("w")).select("doc_id", F.posexplode("w").alias("pos", "word"))


@query(f"SELECT doc_id, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS pos, unnest(w) AS word FROM (SELECT doc_id, {B.plain_words('text')} AS w FROM documents)")
def word_tokens_plain(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.plain_words("text").alias("w")).select("doc_id", F.posexplode("w").alias("pos", "word"))


@query(rf"SELECT doc_id, CAST(len(regexp_extract_all(text, '{B.LETTER}+(?:[''’]{B.LETTER}+)*')) AS BIGINT) AS n FROM documents")
def count_words_raw(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.count_words("text").cast("bigint").alias("n"))


@query(f"SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS sent, unnest(s) AS sentence FROM (SELECT doc_id, {B.sentences('text')} AS s FROM documents)")
def sentence_split(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.sentences("text").alias("s")).select("doc_id", F.posexplode("s").alias("sent", "sentence"))


@query(rf"SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '[\t\r\n]+', ' ', 'g'), '^{B.SPACE}+|{B.SPACE}+$', '', 'g') AS cell FROM documents")
def clean_cells(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.clean_cell("text").alias("cell"))


@query(f"SELECT conv_id, turn, lower({B.norm('text')}) AS key FROM conversations")
def sentence_key(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.sentence_key("text").alias("key"))


@query(f"SELECT conv_id, turn, {B.scoring('text')} AS normalized, {B.scoring(B.strip('text'))} AS lenient FROM conversations")
def score_normalizers(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.scoring_form("text").alias("normalized"), T.lenient_form("text").alias("lenient"))


@query(f"""
WITH p AS (SELECT DISTINCT unnest({B.plain_words('text')}) AS plain FROM documents),
v AS (SELECT plain, '^' || plain || '$' AS padded, i FROM (SELECT plain, unnest(range(1, length(plain) + 1)) AS i FROM p) WHERE plain[i] IN ('a', 'e', 'i', 'o', 'u')),
c AS (SELECT *, unnest(range(0, 4)) AS k FROM v)
SELECT plain, CAST(i - 1 AS INTEGER) AS at, CAST(k AS INTEGER) AS k,
    k || '|' || (CASE WHEN k = 0 THEN '' ELSE substr(padded, greatest(1, i + 1 - k), i + 1 - greatest(1, i + 1 - k)) END) || '_'
    || (CASE WHEN k = 0 THEN '' ELSE substr(padded, i + 2, k) END) || '|' || padded[i + 1] AS key FROM c
""")
def char_contexts(spark, sf_dir):
    words = read(spark, sf_dir, "documents").select(F.explode(T.plain_words("text")).alias("plain")).distinct()
    return words.select("plain", F.explode(T.char_contexts("plain")).alias("c")).select("plain", "c.at", "c.k", "c.key")


@query(f"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all({B.norm('text')}, '{B.WORD}')) AS source FROM documents),
f AS (SELECT source, lower(source) AS form FROM w)
SELECT source, form, CASE WHEN upper(source) <> lower(source) AND source = lower(source) THEN form
    WHEN upper(source) <> lower(source) AND source = upper(source) AND length(source) > 1 THEN upper(form)
    ELSE array_to_string(list_transform(range(1, least(length(source), length(form)) + 1), lambda i: CASE WHEN source[i] = lower(source[i]) THEN form[i] ELSE upper(form[i]) END), '') END AS cased
FROM f
""")
def case_transfer(spark, sf_dir):
    words = read(spark, sf_dir, "documents").select(T.normalize_text("text").alias("t")).select(F.explode(F.regexp_extract_all("t", F.lit(T.WORD), F.lit(0))).alias("source")).distinct()
    return words.select("source", F.lower("source").alias("form"), T.match_case(F.col("source"), F.lower("source")).alias("cased"))


_VERSES = "(VALUES ('MRK.1.1'), ('RUT.4.2'), ('TIT.1.9'), ('1JN.2.3'), ('ZEP.3.1'), ('GEN.1.1'), ('JON'), ('')) v(verse_key)"


@query(f"SELECT verse_key, split_part(verse_key, '.', 1) AS book, CASE WHEN split_part(verse_key, '.', 1) IN ('RUT', 'JON', 'PHP', 'JAS', '1JN') THEN 'test' WHEN split_part(verse_key, '.', 1) IN ('TIT', 'ZEP') THEN 'dev' ELSE 'train' END AS split FROM {_VERSES}")
def verse_route(spark, sf_dir):
    return spark.sql(f"SELECT * FROM {_VERSES}").select("verse_key", V.book("verse_key").alias("book"), V.verse_split("verse_key").alias("split"))


_CITED = "(VALUES (1, 'h_Ort[11-19];5501'), (2, ' a ; b[12-14];a'), (3, ''), (4, ';;'), (5, 'x[1][2]')) v(id, source)"


@query(rf"SELECT id, unnest(list_distinct(list_filter(list_transform(string_split(source, ';'), lambda s: regexp_replace(trim(s), '\[.*?\]$', '')), lambda s: s <> ''))) AS key FROM {_CITED}")
def citation_keys(spark, sf_dir):
    return spark.sql(f"SELECT * FROM {_CITED}").select("id", F.explode(V.citation_keys("source")).alias("key"))


_FEATURES = "(VALUES ('GB020'), ('GB003'), ('10A'), ('9B'), ('9A'), ('100A'), ('other-1'), ('B')) v(feature_id)"


@query(rf"""
SELECT feature_id, CAST(row_number() OVER (ORDER BY CASE WHEN n <> '' THEN a ELSE feature_id END, CAST(CASE WHEN n <> '' THEN n ELSE '0' END AS BIGINT), b) AS INTEGER) AS place
FROM (SELECT *, regexp_extract(feature_id, '^([A-Z]*)(\d+)([A-Z]*)$', 1) AS a, regexp_extract(feature_id, '^([A-Z]*)(\d+)([A-Z]*)$', 2) AS n, regexp_extract(feature_id, '^([A-Z]*)(\d+)([A-Z]*)$', 3) AS b FROM {_FEATURES})
""")
def natural_sort(spark, sf_dir):
    from pyspark.sql.window import Window

    rows = spark.sql(f"SELECT * FROM {_FEATURES}")
    return rows.select("feature_id", F.row_number().over(Window.orderBy(*V.natural_key("feature_id"))).alias("place"))  # eight rows


_TENTHS = "(n // {0} + CASE WHEN n % {0} * 2 > {0} OR (n % {0} * 2 = {0} AND n // {0} % 2 = 1) THEN 1 ELSE 0 END)"
_SCALED = f"({_TENTHS} // 10) || '.' || ({_TENTHS} % 10)"


@query(f"""
SELECT o_orderkey, CASE WHEN n < 1000 THEN n || ' B' WHEN n < 1000000 THEN {_SCALED.format(100)} || ' KB' WHEN n < 1000000000 THEN {_SCALED.format(100000)} || ' MB' ELSE {_SCALED.format(100000000)} || ' GB' END AS size
FROM (SELECT o_orderkey, o_orderkey * o_orderkey + o_custkey AS n FROM orders)
""")
def human_bytes(spark, sf_dir):
    n = F.col("o_orderkey") * F.col("o_orderkey") + F.col("o_custkey")
    return read(spark, sf_dir, "orders").select("o_orderkey", V.human_bytes(n).alias("size"))


_BIB = "@book{a1,\n title={A}}\n@article{b2,\n title={B}}\n@misc{c3, note={x}}"


@query(rf"""
WITH e AS (SELECT trim(unnest(string_split_regex(regexp_replace(t, '\n@', chr(1) || '@', 'g'), chr(1))), chr(10) || ' ') AS entry FROM (SELECT chr(10) || '{_BIB.replace(chr(10), "' || chr(10) || '")}' AS t)),
k AS (SELECT entry, regexp_extract(entry, '^@\w+\s*\{{\s*([^,\s]+)\s*,', 1) AS key FROM e)
SELECT string_agg(entry, chr(10) || chr(10) ORDER BY entry) || chr(10) AS bib FROM k WHERE key IN ('a1', 'c3')
""")
def bib_filter(spark, sf_dir):
    from corpuslens.operators.lexicon import bib_subset

    return bib_subset(spark.createDataFrame([(_BIB,)], "text string"), spark.createDataFrame([("a1",), ("c3",)], "key string"))


_MODELS = "(VALUES ('omniASR_CTC_300M_v2'), ('omniASR_LLM_7B_v2'), ('org/whisper-x'), ('base')) v(model)"


@query(f"SELECT model, CASE WHEN model = 'org/whisper-x' THEN 'Whisper fine-tune' WHEN starts_with(model, 'omniASR_') THEN 'Omnilingual ' || replace(regexp_replace(regexp_replace(model, '^omniASR_', ''), '_v2$', ''), '_', ' ') ELSE model END AS label, regexp_replace(model, '[^A-Za-z0-9]+', '_', 'g') AS slug FROM {_MODELS}")
def model_labels(spark, sf_dir):
    return spark.sql(f"SELECT * FROM {_MODELS}").select("model", V.model_label("model", {"org/whisper-x": "Whisper fine-tune"}).alias("label"), V.slug("model").alias("slug"))


@query("SELECT doc_id, CASE WHEN (n_chars % 10) / 10.0 < 0.5 THEN 'unclear' WHEN lang = 'fr' THEN 'target' WHEN lang IN ('es', 'de') THEN 'neighbour' ELSE 'other' END AS label FROM documents")
def lang_groups(spark, sf_dir):
    score = (F.col("n_chars") % 10) / 10.0
    return read(spark, sf_dir, "documents").select("doc_id", V.language_group("lang", score, {"fr": "target", "es": "neighbour", "de": "neighbour"}).alias("label"))


@query(f"SELECT doc_id, draw < 0.5 AS dropped, CASE WHEN draw < 0.5 THEN {B.strip('text')} ELSE text END AS text FROM (SELECT doc_id, text, CAST('0x' || md5('42:' || doc_id)[1:8] AS BIGINT) / 4294967296.0 AS draw FROM documents)")
def diacritic_dropout(spark, sf_dir):
    from corpuslens.operators.parallel import diacritic_dropout as drop

    return drop(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", "dropped", "text")
