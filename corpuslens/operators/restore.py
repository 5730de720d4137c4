"""Diacritic restoration: three count tables learnt from marked text, applied by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.functions import text as T
from corpuslens.functions.unicode_tables import LETTER, WORD
from corpuslens.storage import stored

START = "<s>"


def plain_pairs(df: DataFrame, ordinal: str = "doc_id", text: str = "text", require_diacritics: bool = True) -> DataFrame:
    """(ordinal, pos, word, plain, prev): each word of the training texts with its unmarked form and that of the word before."""
    rows = df.where(F.col(text).isNotNull())
    if require_diacritics:
        rows = rows.select(ordinal, text, T.detect_diacritics(text).alias("_marked")).where("_marked")
    lists = rows.select(ordinal, T.words(text).alias("w")).withColumn("p", F.split(T.strip_diacritics(F.array_join("w", " ")), " "))
    before = F.concat(F.array(F.lit(START)), F.slice("p", 1, F.size("p") - 1))
    zipped = F.when(F.size("w") > 0, F.arrays_zip(F.col("w").alias("word"), F.col("p").alias("plain"), before.alias("prev")))
    return lists.select(ordinal, F.posexplode(zipped).alias("pos", "t")).select(ordinal, "pos", "t.word", "t.plain", "t.prev")


def _usable(pairs: DataFrame) -> DataFrame:
    """A word whose unmarked form has another length teaches nothing, though it was the word before its successor."""
    return pairs.where(F.length("word") == F.length("plain"))


def fit_words(pairs: DataFrame, ordinal: str = "doc_id") -> DataFrame:
    return _usable(pairs).groupBy(F.col("plain").alias("key"), F.col("word").alias("form")).agg(F.count("*").alias("n"), F.min(F.struct(ordinal, "pos")).alias("first"))


def fit_bigrams(pairs: DataFrame, ordinal: str = "doc_id") -> DataFrame:
    return _usable(pairs).groupBy(F.concat_ws(" ", "prev", "plain").alias("key"), F.col("word").alias("form")).agg(F.count("*").alias("n"), F.min(F.struct(ordinal, "pos")).alias("first"))


def fit_chars(pairs: DataFrame, ordinal: str = "doc_id") -> DataFrame:
    """Counts by context; words are counted first, so that contexts are made once per distinct word."""
    return _chars(fit_words(pairs, ordinal), ordinal)


def _chars(words: DataFrame, ordinal: str) -> DataFrame:
    words = words.select(F.col("key").alias("plain"), F.col("form").alias("word"), F.col("n").alias("m"), "first")
    each = words.select("word", "m", "first", F.explode(T.char_contexts("plain")).alias("c"))
    place = F.struct(F.col(f"first.{ordinal}").alias(ordinal), F.col("first.pos").alias("pos"), F.col("c.at").alias("at"))
    return each.groupBy(F.col("c.key").alias("key"), F.substring(F.col("word"), F.col("c.at") + 1, F.lit(1)).alias("form")).agg(F.sum("m").alias("n"), F.min(place).alias("first"))


def fit(pairs: DataFrame, ordinal: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """words, bigrams and chars of pairs, as by the three functions above, from one pass over the texts.

    Words are counted by their predecessor first; that table, of distinct rows only, is stored and the three are summed from it.
    """
    seen = F.min(F.struct(ordinal, "pos")).alias("first")
    counts = stored(_usable(pairs).groupBy("prev", "plain", "word").agg(F.count("*").alias("n"), seen), "restorer-counts")
    words = counts.groupBy(F.col("plain").alias("key"), F.col("word").alias("form")).agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    bigrams = counts.select(F.concat_ws(" ", "prev", "plain").alias("key"), F.col("word").alias("form"), "n", "first")
    return words, bigrams, _chars(words, ordinal)


def best(table: DataFrame) -> DataFrame:
    """(key, form, forms): the most counted form of each key, of equals the first seen, and how many forms it has."""
    return table.groupBy("key").agg(F.min_by("form", F.struct(-F.col("n"), "first")).alias("form"), F.count("*").alias("forms"))


def pruned(words: DataFrame, bigrams: DataFrame, chars: DataFrame, min_count: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a saved model holds: words and contexts of at least min_count, bigrams of words with several forms only."""
    kept = words.where(F.col("n") >= min_count)
    ambiguous = words.groupBy("key").agg(F.count("*").alias("forms")).where("forms > 1").select(F.col("key").alias("plain"))
    last = F.element_at(F.split("key", " "), -1)
    return kept, bigrams.withColumn("plain", last).join(ambiguous, "plain", "left_semi").drop("plain"), chars.where(F.col("n") >= min_count)


def restore_words(tokens: DataFrame, words: DataFrame, bigrams: DataFrame) -> DataFrame:
    """tokens (plain, prev, ...) with form: the word's best form, after its predecessor where it has several; null if unknown. Also known."""
    w = best(words).select(F.col("key").alias("plain"), F.col("form").alias("_word"), "forms")
    b = best(bigrams).select(F.col("key").alias("_pair"), F.col("form").alias("_bigram"))
    joined = tokens.withColumn("_pair", F.concat_ws(" ", "prev", "plain")).join(w, "plain", "left").join(b, "_pair", "left")
    form = F.when(F.col("forms") > 1, F.coalesce("_bigram", "_word")).otherwise(F.col("_word"))
    return joined.withColumn("form", form).withColumn("known", F.col("_word").isNotNull()).drop("_pair", "_word", "_bigram", "forms")


def restore_unseen(plain: DataFrame, chars: DataFrame) -> DataFrame:
    """(plain, form) for each distinct unmarked word: every vowel as its widest known context has it most, other letters as they are."""
    words = plain.select("plain").distinct()
    contexts = words.select("plain", F.explode(T.char_contexts("plain")).alias("c")).select("plain", "c.at", "c.k", "c.key")
    hits = contexts.join(best(chars).select("key", F.col("form").alias("letter")), "key")
    chosen = hits.groupBy("plain", "at").agg(F.max_by("letter", "k").alias("letter"))
    by_word = chosen.groupBy("plain").agg(F.map_from_entries(F.collect_list(F.struct("at", "letter"))).alias("m"))
    letters = F.filter(F.split("plain", ""), lambda c: c != "")
    made = F.array_join(F.transform(letters, lambda c, i: F.coalesce(F.try_element_at(F.col("m"), i), c)), "")
    return words.join(by_word, "plain", "left").select("plain", F.when(F.col("m").isNull(), F.col("plain")).otherwise(made).alias("form"))


def running_tokens(df: DataFrame, ordinal: str = "sid", text: str = "text") -> DataFrame:
    """(ordinal, at, piece, is_word, plain, prev): words and what lies between, in order; together they are the text in NFC."""
    cut = df.select(ordinal, T.nfc(F.coalesce(F.col(text), F.lit(""))).alias("t")).select(ordinal, F.regexp_extract_all("t", F.lit(rf"{WORD}|(?:(?!{LETTER})[\s\S])+"), F.lit(0)).alias("pieces"))
    pieces = cut.select(ordinal, F.posexplode("pieces").alias("at", "piece")).withColumn("is_word", F.col("piece").rlike(f"^{LETTER}"))
    plain = pieces.withColumn("_stripped", T.strip_diacritics("piece")).withColumn("plain", F.when(F.col("is_word"), F.lower("_stripped"))).drop("_stripped")
    order = Window.partitionBy(ordinal).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return plain.withColumn("prev", F.coalesce(F.last("plain", ignorenulls=True).over(order), F.lit(START)))


def restore(df: DataFrame, words: DataFrame, bigrams: DataFrame, chars: DataFrame, ordinal: str = "sid", text: str = "text") -> DataFrame:
    """(ordinal, restored): each text with diacritics put back; spacing, punctuation and case stay as they are. The model is asked for each distinct (plain, prev) once."""
    pieces = running_tokens(df, ordinal, text)
    asked = stored(pieces.where("is_word").select("plain", "prev").distinct(), "restorer-asked")
    source = restore_words(asked, words, bigrams)
    unseen = restore_unseen(source.where("not known").select("plain"), chars).select("plain", F.col("form").alias("_made"))
    forms = source.join(unseen, "plain", "left").select(F.col("plain").alias("_plain"), F.col("prev").alias("_prev"), F.coalesce("form", "_made").alias("_form"))
    # What is no word has a key of its own that matches nothing, so that it spreads over the tasks.
    key = F.coalesce("plain", F.concat_ws(" ", F.lit(""), F.col(ordinal).cast("string"), "at"))
    told = pieces.join(forms, (key == F.col("_plain")) & (F.col("prev") == F.col("_prev")), "left")
    out = F.when(F.col("is_word"), T.match_case("piece", "_form")).otherwise(F.col("piece"))
    whole = told.select(ordinal, "at", out.alias("out")).groupBy(ordinal).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "out"))), lambda x: x["out"]), "").alias("restored"))
    return df.select(ordinal).distinct().join(whole, ordinal, "left").select(ordinal, F.coalesce("restored", F.lit("")).alias("restored"))


def evaluate(df: DataFrame, words: DataFrame, bigrams: DataFrame, chars: DataFrame, ordinal: str = "doc_id", text: str = "text") -> DataFrame:
    """One row: words, word_accuracy, baseline_accuracy, marked_words, marked_word_accuracy, unseen_words, unseen_word_accuracy; texts whose word counts differ are left out."""
    stripped = df.select(ordinal, T.normalize_text(text).alias("_norm")).select(ordinal, T.strip_diacritics("_norm").alias(text))
    hyp = restore(stripped, words, bigrams, chars, ordinal, text)
    both = df.select(ordinal, T.words(text).alias("ref")).join(hyp.select(ordinal, T.words("restored").alias("hyp")), ordinal).where(F.size("ref") == F.size("hyp"))
    each = both.select(F.explode(F.arrays_zip("ref", "hyp")).alias("t")).select("t.ref", "t.hyp").withColumn("plain", T.strip_diacritics("ref"))
    known = words.select(F.col("key").alias("plain"), F.lit(True).alias("known")).distinct()
    flagged = each.groupBy("ref", "hyp", "plain").agg(F.count("*").alias("n")).join(known, "plain", "left")
    count = lambda test: F.coalesce(F.sum(F.when(test, F.col("n")).otherwise(0)), F.lit(0)).cast("bigint")
    share = lambda test, of: F.coalesce(F.try_divide(F.sum(F.when(test & of, F.col("n")).otherwise(0)), F.sum(F.when(of, F.col("n")).otherwise(0))), F.lit(0.0))
    right, every, marked, unseen = F.col("ref") == F.col("hyp"), F.lit(True), F.col("ref") != F.col("plain"), F.col("known").isNull()
    return flagged.agg(
        count(every).alias("words"),
        share(right, every).alias("word_accuracy"),
        share(~marked, every).alias("baseline_accuracy"),
        count(marked).alias("marked_words"),
        share(right, marked).alias("marked_word_accuracy"),
        count(unseen).alias("unseen_words"),
        share(right, unseen).alias("unseen_word_accuracy"),
    )


def experiment(runs: dict[str, tuple[DataFrame, DataFrame]], ordinal: str = "doc_id", text: str = "text") -> DataFrame:
    """A row of evaluate() for each named (train, test)."""
    out = None
    for name, (train, test) in runs.items():
        pairs = plain_pairs(train, ordinal, text)
        row = evaluate(test, *fit(pairs, ordinal), ordinal, text).select(F.lit(name).alias("run"), "*")
        out = row if out is None else out.unionByName(row)
    return out


