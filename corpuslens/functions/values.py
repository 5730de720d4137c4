"""Scalar functions over keys, sizes and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens.functions.text import _col, collapse_space

# Books whose verses are held out.
DEV_BOOKS = ("TIT", "ZEP")
TEST_BOOKS = ("RUT", "JON", "PHP", "JAS", "1JN")


def book(verse_key: Column | str) -> Column:
    """What stands before the first full stop of a verse key."""
    return F.split_part(_col(verse_key), F.lit("."), F.lit(1))


def verse_split(verse_key: Column | str, dev: tuple[str, ...] = DEV_BOOKS, test: tuple[str, ...] = TEST_BOOKS) -> Column:
    b = book(verse_key)
    return F.when(b.isin(*test), "test").when(b.isin(*dev), "dev").otherwise("train")


def citation_keys(value: Column | str) -> Column:
    """Distinct keys of a citation list: parted by semicolons, page ranges in brackets dropped."""
    parts = F.transform(F.split(F.coalesce(_col(value), F.lit("")), ";"), lambda v: F.regexp_replace(collapse_space(v), r"\[.*?\]$", ""))
    return F.array_distinct(F.filter(parts, lambda v: v != ""))


def natural_key(feature: Column | str) -> list[Column]:
    """Three columns that sort identifiers such as GB020, 10A and 9B by their number; any other sorts as itself with 0."""
    f = _col(feature)
    parts = [F.regexp_extract(f, r"^([A-Z]*)(\d+)([A-Z]*)$", g) for g in (1, 2, 3)]
    numbered = parts[1] != ""
    return [F.when(numbered, parts[0]).otherwise(f), F.when(numbered, parts[1]).otherwise("0").cast("bigint"), parts[2]]


def human_bytes(n: Column | str) -> Column:
    """A size in decimal units to one place, ties to even; 'size unknown' for null."""
    x = _col(n).cast("bigint")

    def scaled(unit: str, size: int) -> Column:
        step = size // 10
        tenths, rest = F.floor(x / step), x % step
        rounded = tenths + F.when((rest * 2 > step) | ((rest * 2 == step) & (tenths % 2 == 1)), 1).otherwise(0)
        return F.format_string(f"%d.%d {unit}", F.floor(rounded / 10).cast("bigint"), (rounded % 10).cast("bigint"))

    out = F.when(x.isNull(), "size unknown").when(x < 1000, F.format_string("%d B", x))
    return out.when(x < 10**6, scaled("KB", 10**3)).when(x < 10**9, scaled("MB", 10**6)).otherwise(scaled("GB", 10**9))


def model_label(model: Column | str, names: dict[str, str] | None = None) -> Column:
    """Readable name of a speech model: known names by table, the omniASR family by its parts, any other as it is."""
    m = _col(model)
    out = F.when(m.startswith("omniASR_"), F.concat(F.lit("Omnilingual "), F.replace(F.regexp_replace(F.regexp_replace(m, "^omniASR_", ""), "_v2$", ""), F.lit("_"), F.lit(" "))))
    for known, label in (names or {}).items():
        out = out.when(m == known, label)
    return out.otherwise(m)


def slug(name: Column | str) -> Column:
    return F.regexp_replace(_col(name), "[^A-Za-z0-9]+", "_")


def language_group(code: Column | str, score: Column | str, groups: dict[str, str], least: float = 0.5) -> Column:
    """Label of a predicted language: 'unclear' below a score, a named group, else 'other'."""
    out = F.when(F.coalesce(_col(score), F.lit(0.0)) < least, "unclear")
    for known, label in groups.items():
        out = out.when(_col(code) == known, label)
    return out.otherwise("other")
