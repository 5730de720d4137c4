"""Text functions: Column in, Column out. A null gives null.

Normal forms come from ICU, which ships with Spark, by java_method. Catalyst holds that call for nondeterministic:
filters aren't pushed through it and it can't stand in an aggregate. So filter before, and project a result before
aggregating it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens.functions.unicode_tables import PUNCTUATION, RAW_WORD, SPACE, VOWELS, WORD, combining_class

# Typographic characters and what they count as.
ONE_TO_ONE = {"\u2018": "'", "\u2019": "'", "\u201a": "'", "\u201c": '"', "\u201d": '"', "\u201e": '"', "\u2013": "-", "\u2014": "-", "\u00a0": " "}
ELLIPSIS, DOTS = "\u2026", "..."


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(x: Column, made: Callable[[Column], Column]) -> Column:
    """made(x) with x worked out once, however often made uses it: nested expressions would else be worked out again for each use."""
    return F.get(F.transform(F.array(x), made), F.lit(0))


def _icu(x: Column, call: str) -> Column:
    """ICU's normal form; text of ASCII only, the usual case in many corpora, is its own."""

    def form(v: Column) -> Column:
        java = F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit(call), F.coalesce(v, F.lit("")), F.lit(False))
        return F.when(v.isNull() | (F.octet_length(v) == F.length(v)), v).otherwise(java)

    return once(x, form)


def nfc(x: Column | str) -> Column:
    return _icu(_col(x), "compose")


def nfd(x: Column | str) -> Column:
    return _icu(_col(x), "decompose")


def collapse_space(x: Column | str) -> Column:
    """Every run of Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(_col(x), SPACE + "+", " "))


def normalize_text(x: Column | str) -> Column:
    """NFC, typographic punctuation as ASCII, white space collapsed."""
    mapped = F.translate(nfc(x), "".join(ONE_TO_ONE), "".join(ONE_TO_ONE.values()))
    return collapse_space(F.replace(mapped, F.lit(ELLIPSIS), F.lit(DOTS)))


def strip_diacritics(x: Column | str) -> Column:
    """Without combining marks; letters keep their base."""
    return nfc(F.regexp_replace(nfd(x), combining_class(), ""))


def detect_diacritics(x: Column | str) -> Column:
    """Does the text hold a combining mark, composed or not?"""
    return nfd(x).rlike(combining_class())


def words_of_normal(x: Column | str) -> Column:
    """Lower-case words of text that is normalized already."""
    return F.regexp_extract_all(F.lower(_col(x)), F.lit(WORD), F.lit(0))


def words(x: Column | str) -> Column:
    """Lower-case words, diacritics kept."""
    return words_of_normal(normalize_text(x))


def plain_words(x: Column | str) -> Column:
    """Lower-case words without diacritics."""
    return F.regexp_extract_all(F.lower(strip_diacritics(normalize_text(x))), F.lit(WORD), F.lit(0))


def count_words(x: Column | str) -> Column:
    """Words of raw text; either apostrophe may stand inside."""
    return F.regexp_count(_col(x), F.lit(RAW_WORD))


def _sentence_parts(x: Column | str) -> Column:
    parts = F.split(_col(x), rf"(?<=[.!?;:]){SPACE}+|\n+")
    return F.transform(parts, lambda s: F.regexp_replace(s, rf"^{SPACE}+|{SPACE}+$", ""))


def sentences(x: Column | str, least_words: int = 3) -> Column:
    """Sentences that end in . ! ? ; or : before white space, or at a line's end, of at least so many words."""
    return F.filter(_sentence_parts(x), lambda s: F.size(plain_words(s)) >= least_words)


def sentences_with_words(x: Column | str, least_words: int = 3) -> Column:
    """sentences() as structs of the sentence and its plain_words, which are worked out once."""
    both = F.transform(_sentence_parts(x), lambda s: F.struct(s.alias("sentence"), plain_words(s).alias("words")))
    return F.filter(both, lambda s: F.size(s["words"]) >= least_words)


def clean_cell(x: Column | str) -> Column:
    """Fit for a cell of a tab-separated file: tabs and line ends as spaces, no white space at the ends; null as ''."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(_col(x), F.lit("")), r"[\t\r\n]+", " "), rf"^{SPACE}+|{SPACE}+$", "")


def sentence_key(x: Column | str) -> Column:
    return F.lower(normalize_text(x))


def scoring_form(x: Column | str) -> Column:
    """Normalized, lower case, punctuation but the apostrophe as spaces, single-spaced."""
    return collapse_space(F.regexp_replace(F.lower(normalize_text(x)), PUNCTUATION, " "))


def lenient_form(x: Column | str) -> Column:
    """scoring_form without diacritics (stripped first)."""
    return scoring_form(strip_diacritics(x))


def match_case(source: Column | str, restored: Column | str) -> Column:
    """restored in the case of source: lower as it is; upper of two letters or more as upper; else letter by letter, as far as both reach."""
    s, r = _col(source), _col(restored)
    n = F.least(F.length(s), F.length(r))
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.when(F.substring(s, i, F.lit(1)) == F.lower(F.substring(s, i, F.lit(1))), F.substring(r, i, F.lit(1))).otherwise(F.upper(F.substring(r, i, F.lit(1)))))
    letter_by_letter = F.when(n > 0, F.array_join(each, "")).otherwise("")
    has_case = F.upper(s) != F.lower(s)
    return F.when(has_case & (s == F.lower(s)), r).when(has_case & (s == F.upper(s)) & (F.length(s) > 1), F.upper(r)).otherwise(letter_by_letter)


def ngrams(tokens: Column | str, n: int = 6) -> Column:
    """Distinct n-grams of a word list, each joined by spaces; none of a list that is shorter."""
    t = _col(tokens)
    grams = F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))
    return F.when(F.size(t) >= n, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def char_contexts(plain: Column | str, widest: int = 3) -> Column:
    """Array of (at, k, key): for each vowel of a plain word (at counts from 0) the k letters around it, for k of 0 to widest."""
    p = _col(plain)
    padded = F.concat(F.lit("^"), p, F.lit("$"))

    def around(i: Column, k: Column) -> Column:
        pos = i + 1  # of the vowel in padded, from 0
        first = F.greatest(F.lit(0), pos - k)
        left = F.when(k > 0, F.substring(padded, first + 1, pos - first)).otherwise("")
        right = F.when(k > 0, F.substring(padded, pos + 2, k)).otherwise("")
        key = F.concat(k.cast("string"), F.lit("|"), left, F.lit("_"), right, F.lit("|"), F.substring(padded, pos + 1, F.lit(1)))
        return F.struct(i.alias("at"), k.alias("k"), key.alias("key"))

    places = F.filter(F.sequence(F.lit(0), F.length(p) - 1), lambda i: F.substring(p, i + 1, F.lit(1)).isin(*VOWELS))
    wide = F.array(*[F.lit(k) for k in range(widest + 1)])
    made = F.flatten(F.transform(places, lambda i: F.transform(wide, lambda k: around(i, k))))
    return F.when(F.length(p) > 0, made).otherwise(F.array().cast("array<struct<at:int,k:int,key:string>>"))
