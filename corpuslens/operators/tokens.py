"""Sub-word cost of languages: token counts by injected tokenizers, tax against a base language, fertility."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import text as T


def counter(count: Callable[[str], int]) -> Callable[[Column | str], Column]:
    """A token counter (text to number) as a function of columns, by Arrow batches."""

    @F.pandas_udf("bigint")
    def run(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(count).astype("int64")

    return lambda x: run(T._col(x))


def sentencepiece_counter(model_file: str) -> Callable[[Column | str], Column]:
    """Pieces by a SentencePiece model, loaded once per Python worker."""
    held: dict = {}

    def count(text: str) -> int:
        if "model" not in held:
            import sentencepiece

            held["model"] = sentencepiece.SentencePieceProcessor(model_file=model_file)
        return len(held["model"].encode(text))

    return counter(count)


def token_tax(texts: DataFrame, counters: dict[str, Callable[[Column], Column]], base: str, lang: str = "lang", text: str = "text") -> DataFrame:
    """(tokenizer, lang, words, tokens, tokens_per_word, tax): tax is tokens by those of the base language for the same content."""
    each = texts.select(lang, T.count_words(text).alias("words"), *[c(F.col(text)).cast("bigint").alias(f"_{name}") for name, c in counters.items()])
    pairs = F.array(*[F.struct(F.lit(name).alias("tokenizer"), F.col(f"_{name}").alias("tokens")) for name in counters])
    sums = each.select(lang, "words", F.explode(pairs).alias("p")).groupBy("p.tokenizer", lang).agg(F.sum("words").alias("words"), F.sum("p.tokens").alias("tokens"))
    of_base = sums.where(F.col(lang) == base).select("tokenizer", F.col("tokens").alias("_base"))
    return sums.join(of_base, "tokenizer", "left").select("tokenizer", lang, "words", "tokens", F.try_divide("tokens", "words").alias("tokens_per_word"), F.try_divide("tokens", "_base").alias("tax"))


def best_tokenizer(tax: DataFrame, lang_value: str, own: str, lang: str = "lang") -> DataFrame:
    """One row: the other tokenizer of fewest tokens for a language, its tokens, those of the own one and the share saved."""
    rows = tax.where(F.col(lang) == lang_value)
    best = rows.where(F.col("tokenizer") != own).agg(F.min_by("tokenizer", F.struct("tokens", "tokenizer")).alias("best"), F.min("tokens").alias("best_tokens"), F.lit(own).alias("own"))
    mine = rows.where(F.col("tokenizer") == own).select(F.col("tokenizer").alias("own"), F.col("tokens").alias("own_tokens"))
    return best.join(mine, "own").select("best", "best_tokens", "own_tokens", (1 - F.col("own_tokens") / F.col("best_tokens")).alias("saving"))


def fertility(texts: DataFrame, pieces: Callable[[Column], Column], *by: str, text: str = "text") -> DataFrame:
    """(by, words, pieces, pieces_per_word); words are parted by white space."""
    from corpuslens.operators.scoring import split_words

    each = texts.select(*by, F.size(split_words(text)).alias("w"), pieces(F.col(text)).cast("bigint").alias("p"))
    return each.groupBy(*by).agg(F.sum("w").alias("words"), F.sum("p").alias("pieces"), F.coalesce(F.try_divide(F.sum("p"), F.sum("w")), F.lit(0.0)).alias("pieces_per_word"))


def train_tokenizer(texts: DataFrame, prefix: str, vocab_size: int = 8000, model_type: str = "unigram", text: str = "text") -> str:
    """Train a SentencePiece model on a driver that can hold the texts' stream (they are read row by row); returns the model's path."""
    import sentencepiece

    if model_type not in ("unigram", "bpe"):
        raise ValueError("model_type must be 'unigram' or 'bpe'")
    rows = (r[0] for r in texts.where(F.col(text) != "").select(text).toLocalIterator())
    sentencepiece.SentencePieceTrainer.train(sentence_iterator=rows, model_prefix=prefix, vocab_size=vocab_size, model_type=model_type, character_coverage=1.0, hard_vocab_limit=False, minloglevel=2)
    return f"{prefix}.model"


def tokenizer_experiment(texts: DataFrame, key: str, folder: str, vocab_size: int = 8000, seed: int = 42, text: str = "text") -> DataFrame:
    """(variant, words, pieces, pieces_per_word): models trained on a deduplicated train split with and without diacritics, measured on the test split."""
    from corpuslens.operators.split import train_test_split

    rows = texts.select(F.col(key).alias("_key"), T.normalize_text(text).alias("t")).where("t <> ''").groupBy("t").agg(F.min("_key").alias("key"))
    split = train_test_split(rows, "key", seed=seed)
    variants = {"with diacritics": split, "without diacritics": split.withColumn("t", T.strip_diacritics("t"))}
    found = []
    for n, (name, frame) in enumerate(variants.items()):
        model = train_tokenizer(frame.where("split = 'train'"), f"{folder}/tokenizer_{n}", vocab_size, text="t")
        found.append(fertility(frame.where("split = 'test'"), sentencepiece_counter(model), text="t").select(F.lit(name).alias("variant"), "*"))
    return reduce(DataFrame.unionByName, found)
