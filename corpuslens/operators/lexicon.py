"""Lexicon and typology tables: joins of forms, parameters and codes, bibliography subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.values import citation_keys, natural_key


def lexicon(forms: DataFrame, parameters: DataFrame, language: str) -> DataFrame:
    """Forms of a language with their parameter's name and concept, in parameter order; parameters are a small side, left to the optimizer."""
    mine = forms.where(F.col("Language_ID") == language)
    named = parameters.select(F.col("ID").alias("Parameter_ID"), F.col("Name").alias("concept"), F.col("Concepticon_Gloss").alias("gloss"))
    return mine.join(named, "Parameter_ID").select("Parameter_ID", "concept", "gloss", "Form", "Source").orderBy(*natural_key("Parameter_ID"), "Form")


def structure(values: DataFrame, parameters: DataFrame, codes: DataFrame, language: str) -> DataFrame:
    """(feature_id, feature, value, value_label, comment, source) of a language in the features' natural order; a code's description, else its name."""
    mine = values.where(F.col("Language_ID") == language)
    features = parameters.select(F.col("ID").alias("Parameter_ID"), F.col("Name").alias("feature"))
    labels = codes.select(F.col("ID").alias("Code_ID"), F.coalesce(F.nullif("Description", F.lit("")), "Name").alias("value_label"))
    joined = mine.join(features, "Parameter_ID", "left").join(labels, "Code_ID", "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c.lower())
    rows = joined.select(F.col("Parameter_ID").alias("feature_id"), blank("feature"), blank("Value"), blank("value_label"), blank("Comment"), blank("Source"))
    return rows.orderBy(*natural_key("feature_id"))


def language_rows(df: DataFrame, language: str, columns: list[str], by: str = "Language_ID") -> DataFrame:
    """A table's rows of one language, some columns only, nulls as ''."""
    return df.where(F.col(by) == language).select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c.lower()) for c in columns])


def cited(df: DataFrame, source: str = "Source") -> DataFrame:
    """(key): distinct citation keys of a column of citation lists."""
    return df.select(F.explode(citation_keys(source)).alias("key")).distinct()


def bib_subset(bib: DataFrame, keys: DataFrame, text: str = "text") -> DataFrame:
    """One row: the BibTeX entries of one file's text whose key is cited, sorted and parted by a blank line."""
    entries = bib.select(F.explode(F.split(F.concat(F.lit("\n"), F.col(text)), r"\n(?=@)")).alias("raw"))
    named = entries.select(F.regexp_replace("raw", r"^\s+|\s+$", "").alias("entry")).withColumn("key", F.regexp_extract("entry", r"^@\w+\s*\{\s*([^,\s]+)\s*,", 1))
    kept = named.where("key <> ''").join(keys, "key", "left_semi")
    joined = F.array_join(F.array_sort(F.collect_list("entry")), "\n\n")
    return kept.agg(F.when(F.count("*") > 0, F.concat(joined, F.lit("\n"))).otherwise("").alias("bib"))


#: Extractors of tables by name: each takes a dictionary of the tables it needs and a language's id.
EXTRACTORS = {
    "lexicon": lambda tables, language: lexicon(tables["forms"], tables["parameters"], language),
    "structure": lambda tables, language: structure(tables["values"], tables["parameters"], tables["codes"], language),
    "rows": lambda tables, language: language_rows(tables["rows"], language, tables["rows"].columns),
}


def extract(kind: str, tables: dict[str, DataFrame], language: str) -> DataFrame:
    """The rows of a language by a registered extractor; KeyError for another name."""
    if kind not in EXTRACTORS:
        raise KeyError(f"unknown extractor {kind!r}, known: {sorted(EXTRACTORS)}")
    return EXTRACTORS[kind](tables, language)
