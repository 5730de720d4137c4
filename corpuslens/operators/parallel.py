"""Parallel text: sections of numbered articles, alignment across languages, verse-pair splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.functions import text as T
from corpuslens.functions.values import verse_split


def sections(lines: DataFrame, number: Column, doc: str = "doc", line: str = "line", text: str = "text") -> DataFrame:
    """(doc, section, body): lines under their last header. number is a header's section, null for other lines.

    Lines before the first header count for nothing, a repeated header goes on with its section, empty bodies are dropped.
    """
    so_far = Window.partitionBy(doc).orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    filled = lines.withColumn("_head", number).withColumn("section", F.last("_head", ignorenulls=True).over(so_far))
    body = filled.where("section is not null and _head is null").withColumn("_text", T.collapse_space(text)).where("_text <> ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(line).alias("l"), F.col("_text").alias("t")))), lambda x: x["t"]), " ")
    return body.groupBy(doc, "section").agg(joined.alias("body"))


def aligned(texts: DataFrame, langs: list[str], key: str = "section", lang: str = "lang", text: str = "body") -> DataFrame:
    """(key, one column per language): keys that every language has."""
    wide = texts.where(F.col(lang).isin(*langs)).groupBy(key).agg(*[F.max(F.when(F.col(lang) == x, F.col(text))).alias(x) for x in langs])
    return wide.where(" and ".join(f"`{x}` is not null" for x in langs))


def pair_rows(df: DataFrame, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """Pairs normalized on both sides, blank ones dropped."""
    made = df.withColumn(src, T.normalize_text(src)).withColumn(tgt, T.normalize_text(tgt))
    return made.where(f"{src} <> '' and {tgt} <> ''")


def pair_split(pairs: DataFrame) -> DataFrame:
    """(split, key, src, tgt) of train and dev: pairs (key, src, tgt, src_version, tgt_version as ranks) deduplicated per split, the first by versions and key kept."""
    routed = pairs.withColumn("split", verse_split("key")).where("split <> 'test'")
    first = Window.partitionBy("split", "src", "tgt").orderBy("src_version", "tgt_version", "key")
    return routed.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("split", "key", "src", "tgt")


def test_rows(pairs: DataFrame, source_version: int, target_versions: list[int]) -> DataFrame:
    """(key, src, ref_<version>...): test verses of one source version that every target version translates; of repeated rows the last by seq counts."""
    rows = pairs.withColumn("split", verse_split("key")).where((F.col("split") == "test") & (F.col("src_version") == source_version))
    last = lambda c, v=None: F.max_by(F.when(F.lit(True) if v is None else F.col("tgt_version") == v, F.col(c)), F.when(F.lit(True) if v is None else F.col("tgt_version") == v, F.col("seq")))
    wide = rows.groupBy("key").agg(last("src").alias("src"), *[last("tgt", v).alias(f"ref_{v}") for v in target_versions])
    return wide.where(" and ".join(f"coalesce(ref_{v}, '') <> ''" for v in target_versions))


def split_counts(pairs: DataFrame, source_version: int, target_versions: list[int]) -> DataFrame:
    """(split, n): rows of each split."""
    rest = pair_split(pairs).groupBy("split").agg(F.count("*").alias("n"))
    test = test_rows(pairs, source_version, target_versions).agg(F.lit("test").alias("split"), F.count("*").alias("n"))
    return rest.unionByName(test)


def diacritic_dropout(df: DataFrame, key: str, seed: int = 42, share: float = 0.5, text: str = "text") -> DataFrame:
    """df with text stripped of diacritics in a seeded share of rows (by a hash, so that it can be reproduced)."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.withColumn("dropped", draw < share).withColumn(text, F.when(F.col("dropped"), T.strip_diacritics(text)).otherwise(F.col(text)))
