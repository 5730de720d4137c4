"""Corpus statistics. A corpus is a DataFrame with an ordinal and a text column; groups share one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.functions import text as T


def normalized(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """keep columns and `norm`, normalized text; empty and null texts dropped (after normalizing)."""
    return df.where(F.col(text).isNotNull()).select(*keep, T.normalize_text(text).alias("norm")).where("norm <> ''")


def tokens(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """(keep, pos, word) for each word of each text."""
    return df.select(*keep, T.words(text).alias("_words")).select(*keep, F.posexplode("_words").alias("pos", "word"))


def word_counts(words: DataFrame, *by: str, ordinal: str = "doc_id") -> DataFrame:
    """(by, word, n, first): occurrences and the place (ordinal, pos) of the first, which settles ties."""
    return words.groupBy(*by, "word").agg(F.count("*").alias("n"), F.min(F.struct(ordinal, "pos")).alias("first"))


def top(counts: DataFrame, k: int = 20, what: str = "word") -> DataFrame:
    """The k most frequent, ties as first seen."""
    return counts.orderBy(F.desc("n"), "first").limit(k).select(what, "n")


def nearest_rank(counts: DataFrame, by: list[str], value: str, many: str, shares: dict[str, float]) -> DataFrame:
    """Percentiles at rank rint(share * (n - 1)) from a table of values with their counts: no list of all values is gathered."""
    running = Window.partitionBy(*by).orderBy(value)
    ranked = counts.withColumn("_last", F.sum(many).over(running.rowsBetween(Window.unboundedPreceding, 0)) - 1).withColumn("_n", F.sum(many).over(Window.partitionBy(*by)))
    picks = [F.min(F.when(F.col("_last") >= F.rint(share * (F.col("_n") - 1)), F.col(value))).alias(name) for name, share in shares.items()]
    return ranked.groupBy(*by).agg(*picks)


def length_counts(df: DataFrame, *by: str, text: str = "text") -> DataFrame:
    """(by, words, sentences): how many texts have how many words."""
    sized = normalized(df, *by, text=text).select(*by, F.size(T.words_of_normal("norm")).alias("words"))
    return sized.groupBy(*by, "words").agg(F.count("*").alias("sentences"))


def lengths(df: DataFrame, *by: str, text: str = "text") -> DataFrame:
    """(by, mean, median, p10, p90, max) of words a text."""
    hist = length_counts(df, *by, text=text)
    whole = hist.groupBy(*by).agg(F.coalesce(F.try_divide(F.sum(F.col("words") * F.col("sentences")), F.sum("sentences")), F.lit(0.0)).alias("mean"), F.max("words").cast("double").alias("max"))
    running = Window.partitionBy(*by).orderBy("words")
    ranked = hist.withColumn("_last", F.sum("sentences").over(running.rowsBetween(Window.unboundedPreceding, 0)) - 1).withColumn("_n", F.sum("sentences").over(Window.partitionBy(*by)))
    low, high = F.floor((F.col("_n") - 1) / 2), F.ceil((F.col("_n") - 1) / 2)
    middle = ranked.groupBy(*by).agg(((F.min(F.when(F.col("_last") >= low, F.col("words"))) + F.min(F.when(F.col("_last") >= high, F.col("words")))) / 2).alias("median"))
    ranks = nearest_rank(hist, list(by), "words", "sentences", {"p10": 0.1, "p90": 0.9})
    if not by:
        return whole.crossJoin(middle).crossJoin(ranks)  # one row each
    return whole.join(middle, list(by)).join(ranks, list(by))


def summary(df: DataFrame, by: str, text: str = "text") -> DataFrame:
    """Per group: sentences, unique sentences, tokens, vocabulary, the same without diacritics, hapax words, type-token ratio, sentences with diacritics and their share."""
    rows = normalized(df, by, text=text).withColumn("marked", T.detect_diacritics("norm")).withColumn("words", T.words_of_normal("norm"))
    whole = rows.groupBy(by).agg(
        F.count("*").alias("sentences"),
        F.count_distinct(F.md5(F.col("norm").cast("binary"))).alias("unique_sentences"),
        F.sum(F.size("words")).alias("tokens"),
        F.sum(F.col("marked").cast("bigint")).alias("sentences_with_diacritics"),
    )
    vocabulary = rows.select(by, F.explode("words").alias("word")).groupBy(by, "word").agg(F.count("*").alias("n"))
    stripped = vocabulary.withColumn("plain", T.strip_diacritics("word"))
    kinds = stripped.groupBy(by).agg(
        F.count("*").alias("vocabulary"), F.count_distinct("plain").alias("vocabulary_without_diacritics"), F.sum((F.col("n") == 1).cast("bigint")).alias("hapax_words")
    )
    zero = [F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in ("vocabulary", "vocabulary_without_diacritics", "hapax_words")]
    ratio = F.coalesce(F.try_divide(F.col("vocabulary"), F.col("tokens")), F.lit(0.0)).alias("type_token_ratio")
    share = (F.col("sentences_with_diacritics") / F.col("sentences")).alias("diacritic_share")
    return whole.join(kinds, by, "left").select(by, "sentences", "unique_sentences", "tokens", *zero, ratio, "sentences_with_diacritics", share)


def diacritic_letters(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """(keep, pos, letter): letters that carry a diacritic, lower case, in order."""
    letters = normalized(df, *keep, text=text).where(T.detect_diacritics("norm")).select(*keep, F.posexplode(F.split("norm", "")).alias("pos", "letter"))
    marked = letters.where(F.col("letter").rlike(r"^\p{L}$") & (F.octet_length("letter") > 1)).withColumn("plain", T.strip_diacritics("letter"))
    return marked.where("plain <> letter").select(*keep, "pos", F.lower("letter").alias("letter"))


def validate(df: DataFrame, *by: str, text: str = "text") -> DataFrame:
    """Per group: total, empty (blank) and duplicate texts, unique ones, those with diacritics and their share."""
    blank = T.collapse_space(text) == ""
    rows = df.select(*by, F.coalesce(F.col(text), F.lit("")).alias(text)).select(*by, F.md5(F.col(text).cast("binary")).alias("digest"), blank.alias("blank"), T.detect_diacritics(text).alias("marked"))
    found = rows.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.sum(F.col("blank").cast("bigint")).alias("empty"),
        F.count_distinct("digest").alias("unique"),
        F.sum(F.col("marked").cast("bigint")).alias("with_diacritics"),
    )
    share = F.coalesce(F.try_divide(F.col("with_diacritics"), F.col("total")), F.lit(0.0)).alias("diacritic_share")
    return found.select(*by, "total", "empty", (F.col("total") - F.col("unique")).alias("duplicates"), "unique", "with_diacritics", share)
