"""Registry of queries with their SQL, and the SQL twins of the text functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.storage import read as read  # for the modules of queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) by its name, with the SQL that DuckDB answers the same by."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def dirty(df: DataFrame) -> DataFrame:
    """documents with what the generated texts lack: combining marks, no-break spaces, typographic quotes."""
    made = F.replace(F.replace(F.col("text"), F.lit("\u00e9"), F.lit("e\u0301")), F.lit(". "), F.lit(".\u00a0\u201c"))
    return df.withColumn("text", made)


DIRTY = "(SELECT * REPLACE (replace(replace(text, 'é', 'e' || chr(769)), '. ', '.' || chr(160) || '“') AS text) FROM documents)"

LETTER = r"[\p{L}\p{Nl}\p{No}]"
WORD = rf"{LETTER}+(?:''{LETTER}+)*"
_SPACES = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE = f"[{_SPACES}]"


def norm(x: str) -> str:
    mapped = f"replace(translate(nfc_normalize({x}), '\u2018\u2019\u201a\u201c\u201d\u201e\u2013\u2014\u00a0', '''''''\"\"\"-- '), '\u2026', '...')"
    return f"trim(regexp_replace({mapped}, '{SPACE}+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"nfc_normalize(strip_accents({x}))"


def words(x: str) -> str:
    return f"regexp_extract_all(lower({norm(x)}), '{WORD}')"


def plain_words(x: str) -> str:
    return f"regexp_extract_all(lower({strip(norm(x))}), '{WORD}')"


def sentences(x: str) -> str:
    cut = f"string_split_regex(regexp_replace({x}, '([.!?;:]){SPACE}+', '\\1' || chr(10), 'g'), '\\n+')"
    trimmed = f"list_transform({cut}, lambda s: regexp_replace(s, '^{SPACE}+|{SPACE}+$', '', 'g'))"
    return f"list_filter({trimmed}, lambda s: len({plain_words('s')}) >= 3)"


def scoring(x: str) -> str:
    bare = f"regexp_replace(lower({norm(x)}), '[^\\p{{L}}\\p{{Nl}}\\p{{No}}\\p{{Nd}}_''{_SPACES}]', ' ', 'g')"
    return f"trim(regexp_replace({bare}, '{SPACE}+', ' ', 'g'))"


def split_words(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split({x}, ' ') END"


def r6(x: Column | str) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6)
