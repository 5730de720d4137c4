"""Web-text audit: language of each sentence, n-gram overlap with a reference, shares by source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.storage import fits

NGRAM = 6
OVERLAP = 0.5


def sentence_frame(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """(keep, sent, sentence, words): sentences of each document with their words without diacritics, worked out once."""
    rows = docs.select(*keep, F.posexplode(T.sentences_with_words(text)).alias("sent", "_s"))
    return rows.select(*keep, "sent", "_s.sentence", "_s.words")


def reference_grams(reference: DataFrame, text: str = "text", n: int = NGRAM) -> DataFrame:
    """(gram): distinct n-grams of a reference's texts."""
    return reference.select(T.plain_words(text).alias("w")).select(F.explode(T.ngrams("w", n)).alias("gram")).distinct()


def overlap(sentences: DataFrame, grams: DataFrame, *keep: str, n: int = NGRAM, only: Column | None = None) -> DataFrame:
    """(keep, sent, n_words, overlap, flagged): share of a sentence's distinct n-grams that the reference has; shorter sentences have none and are never flagged.

    keep and sent name a sentence. Each n-gram looks its match up and the sentence's are counted at once: what is shuffled is a row per sentence.
    Where only is false, no n-grams are looked up (overlap 0).
    """
    few = F.broadcast(grams) if fits(grams) else grams
    g = T.ngrams("words", n)
    sized = sentences.select(*keep, "sent", F.size("words").alias("n_words"), (g if only is None else F.when(only, g)).alias("_g"))
    each = sized.select(*keep, "sent", "n_words", F.explode_outer("_g").alias("gram"))
    marked = each.join(few.select("gram", F.lit(1).alias("_hit")), "gram", "left")
    counts = marked.groupBy(*keep, "sent", "n_words").agg(F.count("_hit").alias("_hits"), F.count("gram").alias("_grams"))
    share = F.coalesce(F.try_divide("_hits", "_grams"), F.lit(0.0))
    return counts.select(*keep, "sent", "n_words", share.alias("overlap"), ((F.col("_grams") > 0) & (share >= OVERLAP)).alias("flagged"))


def labelled(sentences: DataFrame, label: Column | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """sentences with label: a column, or a function of a frame (a language predictor given as a pandas UDF, say)."""
    return label(sentences) if callable(label) else sentences.withColumn("label", label)


def by_label(found: DataFrame, labels: list[str], *by: str) -> DataFrame:
    """(by, label, sentences, words, word_share) over a fixed set of labels, zeros filled, from rows with label and n_words."""
    sums = found.groupBy(*by, "label").agg(F.count("*").alias("sentences"), F.sum("n_words").alias("words"))
    every = found.select(*by).distinct().select(*by, F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"))
    total = found.groupBy(*by).agg(F.sum("n_words").alias("_all"))
    filled = every.join(sums, [*by, "label"], "left").na.fill(0, ["sentences", "words"]).join(total, list(by))
    return filled.select(*by, "label", "sentences", "words", F.coalesce(F.try_divide("words", "_all"), F.lit(0.0)).alias("word_share"))


def majority(found: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, label): the label with most words of each document, of equals the first seen."""
    sums = found.groupBy(doc, "label").agg(F.sum("n_words").alias("words"), F.min("sent").alias("first"))
    return sums.groupBy(doc).agg(F.min_by("label", F.struct(-F.col("words"), "first")).alias("label"))


def web_audit(docs: DataFrame, reference: DataFrame, label: Column | Callable[[DataFrame], DataFrame], target: str, labels: list[str], source: str = "source") -> DataFrame:
    """Per source: documents, sentences, words, each label's word share and documents of that majority, and the share of target words that are reference text.

    Sentences are made once: each is labelled and looked up in one row, rows are summed by document (which settles its majority) and those by source.
    """
    sents = labelled(sentence_frame(docs, "doc_id", source, *[c for c in docs.columns if c not in ("doc_id", source, "text")]), label)
    found = overlap(sents, reference_grams(reference), "doc_id", source, "label", only=F.col("label") == target)
    of = lambda x, c: F.when(F.col("label") == x, F.col(c))
    by_doc = found.groupBy(source, "doc_id").agg(
        F.count("*").alias("sentences"),
        F.sum("n_words").alias("words"),
        F.sum(F.when(F.col("flagged"), F.col("n_words")).otherwise(0)).alias("overlap_words"),
        *[F.coalesce(F.sum(of(x, "n_words")), F.lit(0)).alias(f"words_{x}") for x in labels],
        *[F.min(of(x, "sent")).alias(f"_first_{x}") for x in labels],
    )
    places = F.array(*[F.when(F.col(f"_first_{x}").isNotNull(), F.struct((-F.col(f"words_{x}")).alias("w"), F.col(f"_first_{x}").alias("f"), F.lit(x).alias("label"))) for x in labels])
    told = by_doc.withColumn("_most", F.array_min(places)["label"])
    whole = told.groupBy(source).agg(
        *[F.sum(c).alias(c) for c in ("sentences", "words", "overlap_words", *(f"words_{x}" for x in labels))],
        *[F.sum((F.col("_most") == x).cast("bigint")).alias(f"docs_{x}") for x in labels],
    )
    counts = docs.groupBy(source).agg(F.count("*").alias("documents"))
    out = counts.join(whole, counts[source].eqNullSafe(whole[source]), "left").drop(whole[source]).na.fill(0)
    shares = [F.coalesce(F.try_divide(f"words_{x}", "words"), F.lit(0.0)).alias(f"share_{x}") for x in labels]
    ratio = F.coalesce(F.try_divide("overlap_words", f"words_{target}"), F.lit(0.0)).alias("overlap_share")
    return out.select(source, "documents", "sentences", "words", *shares, *[f"docs_{x}" for x in labels], ratio)
