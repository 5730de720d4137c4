"""Queries of the corpus operators: statistics, scores, splits, audits, restoration, tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.functions import values as V
from corpuslens.operators import audit, infer, restore, scoring, split, stats, tokens
from corpuslens.plans import base as B
from corpuslens.plans.base import query, r6, read

_TOKENS = f"(SELECT doc_id, lang, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS word FROM (SELECT doc_id, lang, {B.words('text')} AS w FROM documents))"


@query(f"SELECT word, count(*) AS n FROM {_TOKENS} GROUP BY word ORDER BY n DESC, min((doc_id, pos)) LIMIT 20")
def top_words(spark, sf_dir):
    return stats.top(stats.word_counts(stats.tokens(read(spark, sf_dir, "documents"), "doc_id")), 20)


@query(f"""
SELECT lower(c) AS letter, count(*) AS n FROM (SELECT unnest(string_split({B.norm('text')}, '')) AS c FROM documents)
WHERE regexp_full_match(c, '\\p{{L}}') AND {B.strip('c')} <> c GROUP BY lower(c)
""")
def diacritic_chars(spark, sf_dir):
    return stats.diacritic_letters(read(spark, sf_dir, "documents"), "doc_id").groupBy("letter").agg(F.count("*").alias("n"))


@query(f"SELECT CAST(len({B.words('text')}) AS INTEGER) AS words, count(*) AS sentences FROM documents WHERE {B.norm('text')} <> '' GROUP BY 1")
def length_histogram(spark, sf_dir):
    return stats.length_counts(read(spark, sf_dir, "documents")).select("words", "sentences")


@query(f"""
WITH n AS (SELECT lang, {B.norm('text')} AS norm FROM documents WHERE {B.norm('text')} <> ''),
s AS (SELECT lang, count(*) AS sentences, count(DISTINCT norm) AS unique_sentences, CAST(sum(len({B.words('norm')})) AS BIGINT) AS tokens,
      CAST(count(*) FILTER (norm <> {B.strip('norm')}) AS BIGINT) AS sentences_with_diacritics FROM n GROUP BY lang),
w AS (SELECT lang, word, count(*) AS n FROM {_TOKENS} GROUP BY lang, word),
v AS (SELECT lang, count(*) AS vocabulary, count(DISTINCT {B.strip('word')}) AS vocabulary_without_diacritics, count(*) FILTER (n = 1) AS hapax_words FROM w GROUP BY lang)
SELECT lang, sentences, unique_sentences, tokens, vocabulary, vocabulary_without_diacritics, hapax_words, round(vocabulary / tokens, 6) AS type_token_ratio,
    sentences_with_diacritics, round(sentences_with_diacritics / sentences, 6) AS diacritic_share FROM s JOIN v USING (lang)
""")
def corpus_stats(spark, sf_dir):
    found = stats.summary(read(spark, sf_dir, "documents"), "lang")
    return found.withColumn("type_token_ratio", r6("type_token_ratio")).withColumn("diacritic_share", r6("diacritic_share"))


@query(f"""
WITH n AS (SELECT lang, CAST(len({B.words('text')}) AS INTEGER) AS words FROM documents WHERE {B.norm('text')} <> ''),
l AS (SELECT lang, list_sort(list(words)) AS v, avg(words) AS mean, median(words) AS median, max(words) AS max FROM n GROUP BY lang)
SELECT lang, round(mean, 6) AS mean, median, v[CAST(round_even(0.1 * (len(v) - 1), 0) AS INTEGER) + 1] AS p10, v[CAST(round_even(0.9 * (len(v) - 1), 0) AS INTEGER) + 1] AS p90, CAST(max AS DOUBLE) AS max FROM l
""")
def length_percentiles(spark, sf_dir):
    return stats.lengths(read(spark, sf_dir, "documents"), "lang").select("lang", r6("mean").alias("mean"), "median", "p10", "p90", "max")


@query(f"""
SELECT lang, count(*) AS total, count(*) FILTER (trim(regexp_replace(text, '{B.SPACE}+', ' ', 'g')) = '') AS empty, count(*) - count(DISTINCT text) AS duplicates, count(DISTINCT text) AS "unique",
    count(*) FILTER (nfc_normalize(text) <> {B.strip('text')}) AS with_diacritics, round(count(*) FILTER (nfc_normalize(text) <> {B.strip('text')}) / count(*), 6) AS diacritic_share
FROM (SELECT lang, coalesce(text, '') AS text FROM documents) GROUP BY lang
""")
def validate_sentences(spark, sf_dir):
    return stats.validate(read(spark, sf_dir, "documents"), "lang").withColumn("diacritic_share", r6("diacritic_share"))


def _turns(spark, sf_dir):
    """Each turn against its text without diacritics."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", T.normalize_text("text").alias("ref"))
    return turns.withColumn("hyp", T.strip_diacritics("ref"))


def _next_turns(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", T.normalize_text("text").alias("ref"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ref").alias("hyp"))
    return turns.join(after, ["conv_id", "turn"])


_NEXT = f"""
t AS MATERIALIZED (SELECT conv_id, turn, {B.norm('text')} AS r FROM conversations),
n AS MATERIALIZED (SELECT a.conv_id, a.turn, a.r AS ref, b.r AS hyp, {B.split_words('a.r')} AS rw, {B.split_words('b.r')} AS hw, list_distinct(string_split(a.r || b.r, '')) AS letters FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
"""
# SQL's distance counts bytes: a pair's different letters become single bytes first.
_LETTERS = "array_to_string(list_transform(string_split({0}, ''), lambda c: chr(CAST(list_position(letters, c) AS INTEGER))), '')"
_CHAR_EDITS = f"CASE WHEN ref = '' OR hyp = '' THEN greatest(length(ref), length(hyp)) ELSE levenshtein({_LETTERS.format('ref')}, {_LETTERS.format('hyp')}) END"
# Rows of the distance table less their column numbers: a step takes the lesser of what stands above and before, the next one the least so far.
_WORD_EDITS = """len(hw) + list_reduce(
    flatten(list_transform(rw, lambda w: [list_transform(hw, lambda v: CASE WHEN v = w THEN 0 ELSE 1 END), CAST([] AS INTEGER[])])),
    lambda s, c: CASE WHEN len(c) = 0 THEN list_transform(range(1, len(s) + 1), lambda j: list_min(s[1:j]))
        ELSE [s[1] + 1] || list_transform(range(1, len(c) + 1), lambda j: least(s[j + 1] + 1, s[j] + c[j] - 1)) END,
    list_transform(range(0, len(hw) + 1), lambda j: 0))[-1]"""
_WORD_EDITS = f"CASE WHEN len(rw) = 0 OR len(hw) = 0 THEN greatest(len(rw), len(hw)) ELSE {_WORD_EDITS} END"


@query(f"WITH {_NEXT} SELECT conv_id, turn, CAST({_CHAR_EDITS} AS BIGINT) AS edits FROM n")
def edit_distance_chars(spark, sf_dir):
    """Each turn against the one after it."""
    return _next_turns(spark, sf_dir).select("conv_id", "turn", scoring.char_edits("ref", "hyp").alias("edits"))


@query(f"WITH {_NEXT} SELECT conv_id, turn, CAST({_WORD_EDITS} AS BIGINT) AS edits FROM n")
def edit_distance_words(spark, sf_dir):
    rows = _next_turns(spark, sf_dir).select("conv_id", "turn", scoring.split_words("ref").alias("r"), scoring.split_words("hyp").alias("h"))
    return rows.select("conv_id", "turn", scoring.word_edits("r", "h").alias("edits"))


_RATE = "round(CASE WHEN {1} = 0 THEN CASE WHEN {2} = 0 THEN 0 ELSE 1 END ELSE ({0}) / {1} END, 6)"


@query(f"WITH {_NEXT} SELECT conv_id, turn, {_RATE.format(_WORD_EDITS, 'len(rw)', 'len(hw)')} AS wer, {_RATE.format(_CHAR_EDITS, 'length(ref)', 'length(hyp)')} AS cer FROM n")
def pair_wer_cer(spark, sf_dir):
    return scoring.pair_rates(_next_turns(spark, sf_dir)).select("conv_id", "turn", r6("wer").alias("wer"), r6("cer").alias("cer"))


@query(f"""
WITH {_NEXT} SELECT conv_id, round(coalesce(sum({_WORD_EDITS}) / nullif(sum(len(rw)), 0), 0), 6) AS wer, round(coalesce(sum({_CHAR_EDITS}) / nullif(sum(length(ref)), 0), 0), 6) AS cer
FROM n GROUP BY conv_id
""")
def corpus_wer_cer(spark, sf_dir):
    return scoring.corpus_rates(_next_turns(spark, sf_dir), "conv_id").select("conv_id", r6("wer").alias("wer"), r6("cer").alias("cer"))


# The hypotheses are the references without diacritics: what carries a mark has no equal there, so each such word or letter is one edit.
_PAIRS = f"(SELECT conv_id, turn, r, {B.strip('r')} AS h FROM (SELECT conv_id, turn, {B.norm('text')} AS r FROM conversations))"
_MARKED = f"lambda x: x <> {B.strip('x')}"
_LEVEL = "SELECT '{0}' AS level, round(sum(len(list_filter(w, {1}))) / sum(len(w)), 6) AS wer, round(sum(len(list_filter(string_split(x, ''), {1}))) / sum(length(x)), 6) AS cer FROM (SELECT x, {2} AS w FROM (SELECT {3} AS x FROM {4}))"


@query(" UNION ALL ".join(_LEVEL.format(a, _MARKED, B.split_words("x"), b, _PAIRS) for a, b in (("strict", "r"), ("normalized", B.scoring("r")), ("diacritic_blind", B.scoring("h")))))
def score_levels(spark, sf_dir):
    return scoring.score_levels(_turns(spark, sf_dir)).select("level", r6("wer").alias("wer"), r6("cer").alias("cer"))


_RANKED = "(SELECT doc_id, text, CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) > count(*) OVER () - greatest(1, CAST(round_even(count(*) OVER () * 0.1, 0) AS BIGINT)) THEN 'test' ELSE 'train' END AS split FROM documents)"


@query(f"SELECT doc_id, split FROM {_RANKED}")
def train_test_split(spark, sf_dir):
    return split.train_test_split(read(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", "split")


@query(f"""
SELECT CAST(sum(train) AS BIGINT) AS train, CAST(sum(test) AS BIGINT) AS test, count(*) FILTER (train > 0 AND test > 0) AS overlap, count(*) FILTER (train > 0 AND test > 0) = 0 AS leak_free
FROM (SELECT text, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'test') AS test FROM {_RANKED} GROUP BY text)
""")
def validate_split(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text"))
    return split.validate_split(split.train_test_split(docs, "doc_id"))


@query("SELECT doc_id, lang FROM documents WHERE n_chars <= 4000 ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def seeded_sample(spark, sf_dir):
    return split.seeded_sample(read(spark, sf_dir, "documents").where("n_chars <= 4000").select("doc_id", "lang"), "doc_id", 100)


_LINKED = """
WITH RECURSIVE items AS ({items}), edges AS (
    SELECT item, '0:' || k0 AS key FROM items WHERE k0 IS NOT NULL UNION SELECT item, '1:' || k1 FROM items WHERE k1 IS NOT NULL
), pairs AS (SELECT DISTINCT item, min(item) OVER (PARTITION BY key) AS low FROM edges),
links AS (SELECT item AS a, low AS b FROM pairs UNION SELECT low, item FROM pairs),
reach(item, seen) AS (SELECT item, item FROM items UNION SELECT r.item, l.b FROM reach r JOIN links l ON l.a = r.seen),
low AS (SELECT item, min(seen) AS root FROM reach GROUP BY item)
SELECT item, dense_rank() OVER (ORDER BY root) - 1 AS grp FROM low
"""


def _conversation_groups(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("item"), F.col("conv_id").alias("k0"), F.col("text").alias("k1"))
    return split.linked_groups(turns, "item", ["k0", "k1"])


@query(_LINKED.format(items="SELECT conv_id * 1000 + turn AS item, CAST(conv_id AS VARCHAR) AS k0, text AS k1 FROM conversations"))
def linked_groups(spark, sf_dir):
    return _conversation_groups(spark, sf_dir)


@query(_LINKED.format(items="SELECT doc_id AS item, CAST(n_chars AS VARCHAR) AS k0, md5(text) AS k1 FROM documents"))
def linked_documents(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.col("n_chars").alias("k0"), F.md5(F.col("text").cast("binary")).alias("k1"))
    return split.linked_groups(docs, "item", ["k0", "k1"])


_DISJOINT = _LINKED.format(items="SELECT conv_id * 1000 + turn AS item, CAST(conv_id AS VARCHAR) AS k0, text AS k1 FROM conversations").rstrip().removesuffix("SELECT item, dense_rank() OVER (ORDER BY root) - 1 AS grp FROM low")


@query(f"""
{_DISJOINT}, grouped AS (SELECT item, dense_rank() OVER (ORDER BY root) - 1 AS grp FROM low),
sizes AS MATERIALIZED (SELECT grp, count(*) AS n, row_number() OVER (ORDER BY md5('42:' || grp), grp) AS place FROM grouped GROUP BY grp),
aims AS MATERIALIZED (SELECT 0.1 * sum(n) AS test, 0.075 * sum(n) AS validation FROM sizes),
fill(place, grp, split, test, validation) AS (
    SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), '', CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)
    UNION ALL
    SELECT place, grp, split, test + CASE WHEN split = 'test' THEN n ELSE 0 END, validation + CASE WHEN split = 'validation' THEN n ELSE 0 END
    FROM (SELECT s.place, s.grp, s.n, f.test, f.validation, CASE WHEN a.test - f.test >= a.validation - f.validation
            THEN CASE WHEN a.test - f.test > 0 AND s.n / 2 <= a.test - f.test THEN 'test' ELSE 'train' END
            ELSE CASE WHEN a.validation - f.validation > 0 AND s.n / 2 <= a.validation - f.validation THEN 'validation' ELSE 'train' END END AS split
        FROM fill f JOIN sizes s ON s.place = f.place + 1 CROSS JOIN aims a)
)
SELECT item, grp, split FROM grouped JOIN fill USING (grp)
""")
def disjoint_split(spark, sf_dir):
    return split.disjoint_split(_conversation_groups(spark, sf_dir), {"test": 0.1, "validation": 0.075})


def _utterances(spark, sf_dir):
    part = lambda x: F.substring(F.md5(x.cast("binary")), 1, 1)
    side = lambda x: F.when(part(x).isin("0", "1"), "test").when(part(x) == "2", "validation").otherwise("train")
    c = read(spark, sf_dir, "conversations")
    name = F.concat(F.lit("o:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
    return c.select(
        F.col("conv_id").alias("speaker"),
        T.sentence_key("text").alias("text_key"),
        (F.length("text") / 15).alias("duration_seconds"),
        F.when(F.col("conv_id") % 2 == 0, "Female").otherwise("Male").alias("gender"),
        F.when(F.col("turn") % 3 == 0, "Outdoor").otherwise("Indoor").alias("environment"),
        side(name).alias("official"),
        side(F.concat(F.lit("d:"), F.col("conv_id").cast("string"))).alias("disjoint"),
    )


_SIDE = "CASE WHEN md5({0})[1] IN ('0', '1') THEN 'test' WHEN md5({0})[1] = '2' THEN 'validation' ELSE 'train' END"
_UTTERANCES = f"""(SELECT conv_id AS speaker, lower({B.norm('text')}) AS text_key, length(text) / 15 AS duration_seconds, CASE WHEN conv_id % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
    CASE WHEN turn % 3 = 0 THEN 'Outdoor' ELSE 'Indoor' END AS environment, {_SIDE.format("'o:' || conv_id || ':' || turn")} AS official, {_SIDE.format("'d:' || conv_id")} AS disjoint FROM conversations)"""


def _leak(key: str, side: str, held: str, extra: str = "") -> str:
    return f"""SELECT {extra} CAST(coalesce(sum(held), 0) AS BIGINT) AS items, count(*) AS unique_keys, CAST(coalesce(sum(CASE WHEN train THEN held END), 0) AS BIGINT) AS leaked_items,
        count(*) FILTER (train) AS leaked_unique_keys, round(coalesce(sum(CASE WHEN train THEN held ELSE 0 END) / sum(held), 0), 6) AS leaked_share
        FROM (SELECT {key}, count(*) FILTER ({side} = '{held}') AS held, bool_or({side} = 'train') AS train FROM {_UTTERANCES} GROUP BY {key} HAVING count(*) FILTER ({side} = '{held}') > 0)"""


@query(_leak("text_key", "official", "test"))
def split_leakage(spark, sf_dir):
    return split.split_leakage(_utterances(spark, sf_dir), "text_key", "official").withColumn("leaked_share", r6("leaked_share"))


@query(f"""
SELECT official AS split, count(*) AS utterances, round_even(sum(duration_seconds) / 3600, 2) AS hours, count(DISTINCT speaker) AS speakers, count(DISTINCT text_key) AS sentences,
    round_even(avg(CASE WHEN gender = 'Female' THEN 1.0 ELSE 0.0 END), 3) AS female_share, round_even(avg(CASE WHEN environment = 'Outdoor' THEN 1.0 ELSE 0.0 END), 3) AS outdoor_share
FROM {_UTTERANCES} GROUP BY official
""")
def split_describe(spark, sf_dir):
    return split.describe(_utterances(spark, sf_dir), "official").withColumnRenamed("official", "split")


@query(" UNION ALL ".join(_leak(k, s, h, f"'{s}' AS label, '{m}' AS measure,") for s in ("official", "disjoint") for m, k, h in (("test_sentence_leak", "text_key", "test"), ("test_speaker_leak", "speaker", "test"), ("validation_sentence_leak", "text_key", "validation"))))
def split_audit(spark, sf_dir):
    return split.audit(_utterances(spark, sf_dir), "official", "disjoint").withColumn("leaked_share", r6("leaked_share"))


_SENTS = f"(SELECT doc_id, lang, source, generate_subscripts(s, 1) - 1 AS sent, unnest(s) AS sentence FROM (SELECT doc_id, lang, source, {B.sentences('text')} AS s FROM documents))"
_GRAMS = "list_distinct(list_transform(range(1, len(w) - 4), lambda i: array_to_string(w[i : i + 5], ' ')))"
_FLAGS = f"""
s AS MATERIALIZED (SELECT doc_id, lang, source, sent, {B.plain_words('sentence')} AS w FROM {_SENTS}),
b AS MATERIALIZED (SELECT DISTINCT unnest({_GRAMS}) AS gram FROM (SELECT {B.plain_words('text')} AS w FROM benchmark)),
g AS (SELECT doc_id, sent, unnest({_GRAMS}) AS gram FROM s),
h AS (SELECT doc_id, sent, count(*) AS n, count(b.gram) AS hits FROM g LEFT JOIN b USING (gram) GROUP BY doc_id, sent),
f AS (SELECT s.doc_id, s.lang, s.source, s.sent, CAST(len(s.w) AS INTEGER) AS n_words, coalesce(h.hits / h.n, 0) AS overlap, coalesce(h.hits / h.n, 0) >= 0.5 AS flagged FROM s LEFT JOIN h USING (doc_id, sent))
"""


@query(f"WITH {_FLAGS} SELECT doc_id, CAST(sent AS INTEGER) AS sent, n_words, round(overlap, 6) AS overlap, flagged FROM f")
def ngram_overlap(spark, sf_dir):
    sents = audit.sentence_frame(read(spark, sf_dir, "documents"), "doc_id")
    found = audit.overlap(sents, audit.reference_grams(read(spark, sf_dir, "benchmark")), "doc_id")
    return found.withColumn("overlap", r6("overlap"))


@query(f"WITH {_FLAGS} SELECT doc_id, count(*) AS flagged_sentences, CAST(sum(n_words) AS BIGINT) AS flagged_words FROM f WHERE flagged GROUP BY doc_id")
def contaminated_docs(spark, sf_dir):
    sents = audit.sentence_frame(read(spark, sf_dir, "documents"), "doc_id")
    found = audit.overlap(sents, audit.reference_grams(read(spark, sf_dir, "benchmark")), "doc_id").where("flagged")
    return found.groupBy("doc_id").agg(F.count("*").alias("flagged_sentences"), F.sum("n_words").alias("flagged_words"))


LABELS = ["target", "neighbour", "english", "other", "unclear"]
_GROUPS = {"fr": "target", "es": "neighbour", "de": "neighbour", "en": "english"}
_LABEL = "CASE WHEN sent % 7 = 3 THEN 'unclear' WHEN lang = 'fr' THEN 'target' WHEN lang IN ('es', 'de') THEN 'neighbour' WHEN lang = 'en' THEN 'english' ELSE 'other' END"


def _label():
    """The document's language stands for the predictor's answer; every seventh sentence is unsure."""
    return V.language_group("lang", F.when(F.col("sent") % 7 == 3, 0.4).otherwise(0.9), _GROUPS)


@query(f"""
WITH {_FLAGS}, l AS (SELECT *, {_LABEL} AS label FROM f),
m AS (SELECT doc_id, arg_min(label, (-words, first)) AS label FROM (SELECT doc_id, label, sum(n_words) AS words, min(sent) AS first FROM l GROUP BY doc_id, label) GROUP BY doc_id)
SELECT d.source, d.documents, a.sentences, a.words, {", ".join(f"round(a.w_{x} / a.words, 6) AS share_{x}, (SELECT count(*) FROM m JOIN documents USING (doc_id) WHERE source = d.source AND label = '{x}') AS docs_{x}" for x in LABELS)},
    round(coalesce(a.hit / nullif(a.w_target, 0), 0), 6) AS overlap_share
FROM (SELECT source, count(*) AS documents FROM documents GROUP BY source) d JOIN (
    SELECT source, count(*) AS sentences, CAST(sum(n_words) AS BIGINT) AS words, {", ".join(f"coalesce(sum(n_words) FILTER (label = '{x}'), 0) AS w_{x}" for x in LABELS)},
        coalesce(sum(n_words) FILTER (label = 'target' AND flagged), 0) AS hit FROM l GROUP BY source) a ON a.source = d.source
""")
def web_audit(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    found = audit.web_audit(docs, read(spark, sf_dir, "benchmark"), _label(), "target", LABELS)
    return found.select(*[r6(c).alias(c) if "share" in c else F.col(c) for c in found.columns])


@query(f"""
WITH l AS (SELECT doc_id, sent, {_LABEL} AS label, len({B.plain_words('sentence')}) AS n_words FROM {_SENTS})
SELECT doc_id, arg_min(label, (-words, first)) AS label FROM (SELECT doc_id, label, sum(n_words) AS words, min(sent) AS first FROM l GROUP BY doc_id, label) GROUP BY doc_id
""")
def document_majority(spark, sf_dir):
    sents = audit.sentence_frame(read(spark, sf_dir, "documents"), "doc_id", "lang").withColumn("label", _label())
    return audit.majority(sents.select("doc_id", "sent", "label", F.size("words").alias("n_words")))


@query(f"""
WITH l AS (SELECT source, {_LABEL} AS label, len({B.plain_words('sentence')}) AS n_words FROM {_SENTS}),
s AS (SELECT source, label, count(*) AS sentences, CAST(sum(n_words) AS BIGINT) AS words FROM l GROUP BY source, label),
e AS (SELECT DISTINCT source, unnest(['target', 'neighbour', 'english', 'other', 'unclear']) AS label FROM l)
SELECT source, label, coalesce(sentences, 0) AS sentences, coalesce(words, 0) AS words, round(coalesce(words, 0) / sum(words) OVER (PARTITION BY source), 6) AS word_share FROM e LEFT JOIN s USING (source, label)
""")
def label_shares(spark, sf_dir):
    sents = audit.sentence_frame(read(spark, sf_dir, "documents"), "source", "lang").withColumn("label", _label())
    found = audit.by_label(sents.select("source", "label", F.size("words").alias("n_words")), LABELS, "source")
    return found.withColumn("word_share", r6("word_share"))


# Training pairs: all documents with a mark; the restorer sees each word, its plain form and the plain form before it.
_PAIR_ROWS = f"""
w AS MATERIALIZED (SELECT doc_id, {B.words('text')} AS w FROM documents WHERE nfc_normalize(text) <> {B.strip('text')}),
p AS MATERIALIZED (SELECT doc_id, pos, word, {B.strip('word')} AS plain, coalesce(lag({B.strip('word')}) OVER (PARTITION BY doc_id ORDER BY pos), '<s>') AS prev
    FROM (SELECT doc_id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS word FROM w)),
u AS MATERIALIZED (SELECT * FROM p WHERE length(word) = length(plain)),
tw AS MATERIALIZED (SELECT plain AS key, word AS form, count(*) AS n, min((doc_id, pos)) AS first FROM u GROUP BY plain, word),
tb AS MATERIALIZED (SELECT prev || ' ' || plain AS key, word AS form, count(*) AS n, min((doc_id, pos)) AS first FROM u GROUP BY 1, word)
"""
_CHAR_ROWS = """
v AS (SELECT key AS plain, form, n, first, '^' || key || '$' AS padded, i FROM (SELECT *, unnest(range(1, length(key) + 1)) AS i FROM tw) WHERE key[i] IN ('a', 'e', 'i', 'o', 'u')),
vk AS (SELECT *, unnest(range(0, 4)) AS k FROM v),
vc AS (SELECT n, first, i, form[i] AS letter, k || '|' || (CASE WHEN k = 0 THEN '' ELSE substr(padded, greatest(1, i + 1 - k), i + 1 - greatest(1, i + 1 - k)) END) || '_'
    || (CASE WHEN k = 0 THEN '' ELSE substr(padded, i + 2, k) END) || '|' || padded[i + 1] AS key FROM vk),
tc AS MATERIALIZED (SELECT key, letter AS form, CAST(sum(n) AS BIGINT) AS n, min((first, i)) AS first FROM vc GROUP BY key, letter)
"""


def _pairs(spark, sf_dir):
    return restore.plain_pairs(read(spark, sf_dir, "documents"))


@query(f"WITH {_PAIR_ROWS} SELECT key, form, n FROM tw")
def restorer_words(spark, sf_dir):
    return restore.fit_words(_pairs(spark, sf_dir)).select("key", "form", "n")


@query(f"WITH {_PAIR_ROWS} SELECT key, form, n FROM tb")
def restorer_bigrams(spark, sf_dir):
    return restore.fit_bigrams(_pairs(spark, sf_dir)).select("key", "form", "n")


@query(f"WITH {_PAIR_ROWS}, {_CHAR_ROWS} SELECT key, form, n FROM tc")
def restorer_chars(spark, sf_dir):
    return restore.fit_chars(_pairs(spark, sf_dir)).select("key", "form", "n")


@query(f"""
WITH {_PAIR_ROWS}, {_CHAR_ROWS}, a AS (SELECT key FROM tw GROUP BY key HAVING count(*) > 1)
SELECT 'words' AS part, key, form, n FROM tw WHERE n >= 2 UNION ALL SELECT 'chars', key, form, n FROM tc WHERE n >= 2
UNION ALL SELECT 'bigrams', key, form, n FROM tb WHERE string_split(key, ' ')[-1] IN (SELECT key FROM a)
""")
def restorer_pruned(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    parts = restore.pruned(*restore.fit(pairs), 2)
    rows = [df.select(F.lit(name).alias("part"), "key", "form", "n") for name, df in zip(("words", "bigrams", "chars"), parts, strict=True)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


_BEST = """
bw AS MATERIALIZED (SELECT key, arg_min(form, (-n, first)) AS form, count(*) AS forms FROM tw GROUP BY key),
bb AS MATERIALIZED (SELECT key, arg_min(form, (-n, first)) AS form FROM tb GROUP BY key)
"""
_TURN_WORDS = f"""
tokens AS MATERIALIZED (SELECT conv_id, turn, pos, plain, coalesce(lag(plain) OVER (PARTITION BY conv_id, turn ORDER BY pos), '<s>') AS prev FROM (
    SELECT conv_id, turn, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS plain FROM (SELECT conv_id, turn, {B.plain_words('text')} AS w FROM conversations)))
"""


def _turn_words(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", T.plain_words("text").alias("p"))
    before = F.concat(F.array(F.lit(restore.START)), F.slice("p", 1, F.size("p") - 1))
    zipped = F.when(F.size("p") > 0, F.arrays_zip(F.col("p").alias("plain"), before.alias("prev")))
    return rows.select("conv_id", "turn", F.posexplode(zipped).alias("pos", "t")).select("conv_id", "turn", "pos", "t.plain", "t.prev")


@query(f"""
WITH {_PAIR_ROWS}, {_BEST}, {_TURN_WORDS}
SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, plain, CASE WHEN bw.forms > 1 THEN coalesce(bb.form, bw.form) ELSE bw.form END AS form, bw.form IS NOT NULL AS known
FROM tokens LEFT JOIN bw ON bw.key = plain LEFT JOIN bb ON bb.key = prev || ' ' || plain
""")
def restore_words(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    return restore.restore_words(_turn_words(spark, sf_dir), *restore.fit(pairs)[:2]).select("conv_id", "turn", "pos", "plain", "form", "known")


_UNSEEN = f"""
WITH {_PAIR_ROWS}, {_CHAR_ROWS}, bc AS MATERIALIZED (SELECT key, arg_min(form, (-n, first)) AS letter FROM tc GROUP BY key),
q AS MATERIALIZED (SELECT DISTINCT unnest({B.plain_words('text')}) AS plain FROM conversations),
qv AS (SELECT plain, '^' || plain || '$' AS padded, i, unnest(range(0, 4)) AS k FROM (SELECT plain, unnest(range(1, length(plain) + 1)) AS i FROM q) WHERE plain[i] IN ('a', 'e', 'i', 'o', 'u')),
qc AS (SELECT plain, i, k, k || '|' || (CASE WHEN k = 0 THEN '' ELSE substr(padded, greatest(1, i + 1 - k), i + 1 - greatest(1, i + 1 - k)) END) || '_'
    || (CASE WHEN k = 0 THEN '' ELSE substr(padded, i + 2, k) END) || '|' || padded[i + 1] AS key FROM qv),
hit AS MATERIALIZED (SELECT plain, i, arg_max(letter, k) AS letter FROM qc JOIN bc USING (key) GROUP BY plain, i),
each AS (SELECT plain, unnest(range(1, length(plain) + 1)) AS i FROM q)
SELECT plain, string_agg(coalesce(letter, plain[i]), '' ORDER BY i) AS form FROM each LEFT JOIN hit USING (plain, i) GROUP BY plain
"""


@query(_UNSEEN)
def restore_unseen(spark, sf_dir):
    chars = restore.fit_chars(_pairs(spark, sf_dir))
    return restore.restore_unseen(_turn_words(spark, sf_dir), chars)


_CASED = """CASE WHEN upper({0}) <> lower({0}) AND {0} = lower({0}) THEN {1} WHEN upper({0}) <> lower({0}) AND {0} = upper({0}) AND length({0}) > 1 THEN upper({1})
    ELSE array_to_string(list_transform(range(1, least(length({0}), length({1})) + 1), lambda i: CASE WHEN ({0})[i] = lower(({0})[i]) THEN ({1})[i] ELSE upper(({1})[i]) END), '') END"""


def _restored(train: str, texts: str) -> str:
    """Common table expressions that restore texts (sid, text) from training documents; the last one is done (sid, restored)."""
    unseen = _UNSEEN[_UNSEEN.index("qv AS") : _UNSEEN.index("SELECT plain, string_agg")]
    return f"""{_PAIR_ROWS.replace("FROM documents", f"FROM {train}")}, {_CHAR_ROWS}, {_BEST},
bc AS MATERIALIZED (SELECT key, arg_min(form, (-n, first)) AS letter FROM tc GROUP BY key),
given AS MATERIALIZED (SELECT sid, text FROM {texts}),
pc AS MATERIALIZED (SELECT sid, generate_subscripts(l, 1) AS nth, unnest(l) AS piece FROM (SELECT sid, regexp_extract_all(nfc_normalize(text), '{B.WORD}|[^\\p{{L}}\\p{{Nl}}\\p{{No}}]+') AS l FROM given)),
wd AS MATERIALIZED (SELECT sid, nth, piece, plain, coalesce(lag(plain) OVER (PARTITION BY sid ORDER BY nth), '<s>') AS prev FROM (SELECT *, lower({B.strip('piece')}) AS plain FROM pc WHERE regexp_matches(piece, '^{B.LETTER}'))),
q AS MATERIALIZED (SELECT DISTINCT plain FROM wd WHERE plain NOT IN (SELECT key FROM bw)),
{unseen.rstrip()},
made AS MATERIALIZED (SELECT plain, string_agg(coalesce(letter, plain[i]), '' ORDER BY i) AS form FROM each LEFT JOIN hit USING (plain, i) GROUP BY plain),
forms AS (SELECT sid, nth, piece, coalesce(CASE WHEN bw.forms > 1 THEN coalesce(bb.form, bw.form) ELSE bw.form END, made.form) AS form
    FROM wd LEFT JOIN bw ON bw.key = wd.plain LEFT JOIN bb ON bb.key = wd.prev || ' ' || wd.plain LEFT JOIN made ON made.plain = wd.plain),
outs AS (SELECT sid, nth, {_CASED.format("piece", "form")} AS out FROM forms UNION ALL SELECT sid, nth, piece FROM pc WHERE NOT regexp_matches(piece, '^{B.LETTER}')),
done AS MATERIALIZED (SELECT g.sid, coalesce(o.restored, '') AS restored FROM given g LEFT JOIN (SELECT sid, string_agg(out, '' ORDER BY nth) AS restored FROM outs GROUP BY sid) o ON o.sid = g.sid)"""


@query(f"WITH {_restored('documents', f'(SELECT conv_id * 1000 + turn AS sid, {B.strip("text")} AS text FROM conversations)')} SELECT sid, restored FROM done")
def restore_text(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    turns = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("sid"), T.strip_diacritics("text").alias("text"))
    return restore.restore(turns, *restore.fit(pairs))


def _evaluated(run: str, train: str, test: str) -> str:
    """restorer_eval of one run in SQL: train and test are conditions on documents and their side."""
    sides = _RANKED.replace("SELECT doc_id, text,", "SELECT doc_id, text, lang,", 1)
    return f"""(WITH sides AS MATERIALIZED (SELECT * FROM {sides}), train AS MATERIALIZED (SELECT doc_id, text FROM sides WHERE split = 'train' AND {train}), test AS MATERIALIZED (SELECT doc_id AS sid, text FROM sides WHERE split = 'test' AND {test}),
{_restored("train", f"(SELECT sid, {B.strip(B.norm('text'))} AS text FROM test)")},
lists AS (SELECT {B.words('t.text')} AS r, {B.words('d.restored')} AS h FROM test t JOIN done d USING (sid)),
tokens AS (SELECT ref, hyp, {B.strip('ref')} AS plain FROM (SELECT unnest(r) AS ref, unnest(h) AS hyp FROM lists WHERE len(r) = len(h))),
flags AS (SELECT ref = hyp AS good, ref <> plain AS marked, plain NOT IN (SELECT key FROM tw) AS unseen FROM tokens)
SELECT '{run}' AS run, count(*) AS words, round(coalesce(count(*) FILTER (good) / nullif(count(*), 0), 0), 6) AS word_accuracy, round(coalesce(count(*) FILTER (NOT marked) / nullif(count(*), 0), 0), 6) AS baseline_accuracy,
    count(*) FILTER (marked) AS marked_words, round(coalesce(count(*) FILTER (marked AND good) / nullif(count(*) FILTER (marked), 0), 0), 6) AS marked_word_accuracy,
    count(*) FILTER (unseen) AS unseen_words, round(coalesce(count(*) FILTER (unseen AND good) / nullif(count(*) FILTER (unseen), 0), 0), 6) AS unseen_word_accuracy FROM flags)"""


def _sides(spark, sf_dir):
    docs = split.train_test_split(read(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id")
    return docs.where("split = 'train'"), docs.where("split = 'test'")


@query(f"SELECT * FROM {_evaluated('all', 'true', 'true')}")
def restorer_eval(spark, sf_dir):
    train, test = _sides(spark, sf_dir)
    found = restore.experiment({"all": (train, test)})
    return found.select(*[r6(c).alias(c) if "accuracy" in c else F.col(c) for c in found.columns])


_RUNS = {"fr to fr": (["fr"], "fr"), "fr to es": (["fr"], "es"), "es to es": (["es"], "es"), "both to es": (["fr", "es"], "es"), "both to fr": (["fr", "es"], "fr")}


@query(" UNION ALL ".join(f"SELECT * FROM {_evaluated(run, f'lang IN ({chr(44).join(repr(x) for x in langs)})', f'lang = {to!r}')}" for run, (langs, to) in _RUNS.items()))
def restorer_matrix(spark, sf_dir):
    train, test = _sides(spark, sf_dir)
    found = restore.experiment({run: (train.where(F.col("lang").isin(*langs)), test.where(F.col("lang") == to)) for run, (langs, to) in _RUNS.items()})
    return found.select(*[r6(c).alias(c) if "accuracy" in c else F.col(c) for c in found.columns])


_COUNTERS = {"characters": lambda x: F.length(x), "pieces of four": lambda x: F.ceil(F.length(x) / 4), "words and marks": lambda x: F.regexp_count(x, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"))}
_TAX = r"""
e AS (SELECT lang, len(regexp_extract_all(text, '[\p{L}\p{Nl}\p{No}]+(?:[''’][\p{L}\p{Nl}\p{No}]+)*')) AS words, length(text) AS a, CAST(ceil(length(text) / 4) AS BIGINT) AS b, len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}\s]')) AS c FROM documents),
s AS (SELECT lang, CAST(sum(words) AS BIGINT) AS words, CAST(sum(a) AS BIGINT) AS a, CAST(sum(b) AS BIGINT) AS b, CAST(sum(c) AS BIGINT) AS c FROM e GROUP BY lang),
u AS (SELECT 'characters' AS tokenizer, lang, words, a AS tokens FROM s UNION ALL SELECT 'pieces of four', lang, words, b FROM s UNION ALL SELECT 'words and marks', lang, words, c FROM s),
t AS (SELECT tokenizer, lang, words, tokens, tokens / words AS tokens_per_word, tokens / (SELECT tokens FROM u x WHERE x.tokenizer = u.tokenizer AND x.lang = 'en') AS tax FROM u)
"""


@query(f"WITH {_TAX} SELECT tokenizer, lang, words, tokens, round(tokens_per_word, 6) AS tokens_per_word, round(tax, 6) AS tax FROM t")
def token_tax(spark, sf_dir):
    return tokens.token_tax(read(spark, sf_dir, "documents"), _COUNTERS, "en").withColumn("tokens_per_word", r6("tokens_per_word")).withColumn("tax", r6("tax"))


@query(f"""
WITH {_TAX}, o AS (SELECT tokens FROM t WHERE lang = 'fr' AND tokenizer = 'words and marks')
SELECT arg_min(tokenizer, (tokens, tokenizer)) AS best, min(tokens) AS best_tokens, (SELECT tokens FROM o) AS own_tokens, round(1 - (SELECT tokens FROM o) / min(tokens), 6) AS saving FROM t WHERE lang = 'fr' AND tokenizer <> 'words and marks'
""")
def best_tokenizer(spark, sf_dir):
    tax = tokens.token_tax(read(spark, sf_dir, "documents"), _COUNTERS, "en")
    return tokens.best_tokenizer(tax, "fr", "words and marks").withColumn("saving", r6("saving"))


@query(f"""
SELECT lang, CAST(sum(len(CASE WHEN x = '' THEN [] ELSE string_split(x, ' ') END)) AS BIGINT) AS words, CAST(sum(ceil(length(text) / 4)) AS BIGINT) AS pieces, round(sum(ceil(length(text) / 4)) / sum(len(CASE WHEN x = '' THEN [] ELSE string_split(x, ' ') END)), 6) AS pieces_per_word
FROM (SELECT lang, text, trim(regexp_replace(text, '{B.SPACE}+', ' ', 'g')) AS x FROM documents) GROUP BY lang
""")
def fertility(spark, sf_dir):
    return tokens.fertility(read(spark, sf_dir, "documents"), _COUNTERS["pieces of four"], "lang").withColumn("pieces_per_word", r6("pieces_per_word"))


class _Whisper:
    """A stand-in for a model: it fails on large batches, as a full device does."""

    def __init__(self, most: int = 4):
        self.most = most

    def __call__(self):
        def call(items: list) -> list:
            if len(items) > self.most:
                raise MemoryError("out of memory")
            return [f"{len(x)} samples" if not isinstance(x, str) else x.lower() for x in items]

        return call


@query("SELECT CAST(event_id AS VARCHAR) AS id, n / 10.0 AS seconds, event_type AS text, n || ' samples' AS hyp FROM (SELECT *, CAST(floor(abs(coalesce(value, 0)) % 400) AS BIGINT) + 1 AS n FROM events) WHERE n <= 400")
def batched_inference(spark, sf_dir):
    """Clips drawn from events: a waveform as long as the value says."""
    e = read(spark, sf_dir, "events")
    clips = e.select(F.col("event_id").cast("string").alias("id"), F.array_repeat(F.lit(0.0).cast("float"), (F.abs(F.coalesce("value", F.lit(0.0))) % 400).cast("int") + 1).alias("waveform"), F.lit(10).alias("sample_rate"), F.col("event_type").alias("text"))
    return infer.transcribe(clips, _Whisper()).select("id", "seconds", "text", "hyp")


@query("SELECT conv_id, turn, lower(text) AS hyp FROM conversations WHERE trim(text) <> '' UNION ALL SELECT conv_id, turn, '' FROM conversations WHERE trim(coalesce(text, '')) = ''")
def translate_batches(spark, sf_dir):
    return infer.translate(read(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), _Whisper()).select("conv_id", "turn", "hyp")


_GRAM = "list_transform(range(1, len({0}) - {1} + 2), lambda i: array_to_string(({0})[i : i + {1} - 1], {2}))"


def _both(x: str, name: str) -> str:
    """Letters and words of a text as chrF++ takes them: words with the marks at their ends apart."""
    apart = rf"regexp_replace(regexp_replace({x}, '([^\p{{L}}\p{{N}}\s])(\s|$)', ' \1\2', 'g'), '(^|\s)([^\p{{L}}\p{{N}}\s])', '\1\2 ', 'g')"
    return rf"list_filter(string_split(regexp_replace({x}, '\s+', '', 'g'), ''), lambda c: c <> '') AS {name}c, list_filter(string_split_regex({apart}, '{B.SPACE}+'), lambda c: c <> '') AS {name}m, {B.split_words(x)} AS {name}w"


_ORDERS = [("c", n, "''") for n in range(1, 7)] + [("m", n, "' '") for n in (1, 2)] + [("w", n, "' '") for n in range(1, 5)]


@query(f"""
WITH {_NEXT}, l AS MATERIALIZED (SELECT conv_id, turn, {_both('hyp', 'h')}, {_both('ref', 'r')} FROM n),
g AS MATERIALIZED ({" UNION ALL ".join(f"SELECT conv_id, turn, '{kind}' AS kind, {n} AS n, {side} AS of_hyp, unnest({_GRAM.format(('h' if side else 'r') + kind, n, sep)}) AS gram FROM l WHERE len({('h' if side else 'r') + kind}) >= {n}" for kind, n, sep in _ORDERS for side in (1, 0))}),
c AS (SELECT conv_id, turn, kind, n, gram, count(*) FILTER (of_hyp = 1) AS hyp, count(*) FILTER (of_hyp = 0) AS ref FROM g GROUP BY ALL),
s AS MATERIALIZED (SELECT conv_id, kind, n, sum(least(hyp, ref)) AS matched, sum(hyp) AS hyp, sum(ref) AS ref FROM c GROUP BY ALL),
f AS (SELECT conv_id, avg(CASE WHEN matched = 0 THEN 0 ELSE 5 * (matched / hyp) * (matched / ref) / (4 * (matched / hyp) + matched / ref) END) AS f FROM s WHERE kind <> 'w' AND hyp > 0 AND ref > 0 GROUP BY conv_id),
z AS (SELECT *, sum(CASE WHEN matched = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY n) AS zeros FROM s WHERE kind = 'w' AND hyp > 0),
p AS (SELECT conv_id, count(*) AS orders, avg(CASE WHEN matched > 0 THEN ln(matched / hyp) ELSE ln(1 / (power(2, zeros) * hyp)) END) AS mean FROM z GROUP BY conv_id),
k AS (SELECT conv_id, sum(len(hw)) AS h, sum(len(rw)) AS r FROM l GROUP BY conv_id)
SELECT conv_id, round(100 * f, 6) AS chrf, round(CASE WHEN orders < 4 THEN 0 ELSE 100 * exp(mean) * CASE WHEN h >= r THEN 1 ELSE exp(1 - r / h) END END, 6) AS bleu FROM f JOIN p USING (conv_id) JOIN k USING (conv_id)
""")
def mt_scores(spark, sf_dir):
    rows = _next_turns(spark, sf_dir).select(F.col("conv_id").alias("conv_id"), F.concat_ws(":", "conv_id", "turn").alias("id"), "hyp", "ref")
    both = scoring.chrf(rows, "conv_id").join(scoring.bleu(rows.withColumn("refs", F.array("ref")), "conv_id"), "conv_id")
    return both.select("conv_id", r6("chrf").alias("chrf"), r6("bleu").alias("bleu"))


@query("SELECT event_type, round(sum(CAST(floor(abs(coalesce(value, 0)) % 400) AS BIGINT) + 1) / 10.0 / 3600, 6) AS hours FROM events GROUP BY event_type")
def audio_hours(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    clips = e.select("event_type", F.array_repeat(F.lit(0.0).cast("float"), (F.abs(F.coalesce("value", F.lit(0.0))) % 400).cast("int") + 1).alias("waveform"), F.lit(10).alias("sample_rate"))
    return infer.audio_hours(clips, "event_type").withColumn("hours", r6("hours"))
