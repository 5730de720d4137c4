"""Benchmark items inside long documents: MinHash containment search, verified on exact shingles. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.common import fits, read, stored

SHINGLE_WORDS = 5
MIN_CONTAINMENT = 0.8
#: A pair of exactly MIN_CONTAINMENT stays unfound with at most this probability.
MISS = 1e-6
#: Items of at least this many distinct shingles take two MinHash values a band, smaller ones a single one.
LARGE_ITEM = 64


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def shingles(w: Column, n: int, of) -> Column:
    """of(the n words from each position) for each position."""
    at = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: of([F.get(w, i + k) for k in range(n)]))


def _text(parts: list[Column]) -> Column:
    return F.concat_ws(" ", *parts)


def _hash(parts: list[Column]) -> Column:
    return F.xxhash64(*parts)


def item_shingles(items: DataFrame) -> DataFrame:
    """(item_id, n, shingle, hash, size): distinct shingles; an item of fewer words than a shingle has is one shingle of n words; wordless items have none."""
    w = items.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    short = w.where(F.size("w") < SHINGLE_WORDS).select("item_id", F.size("w").alias("n"), F.array(F.array_join("w", " ")).alias("s"))
    full = w.where(F.size("w") >= SHINGLE_WORDS).select("item_id", F.lit(SHINGLE_WORDS).alias("n"), F.array_distinct(shingles(F.col("w"), SHINGLE_WORDS, _text)).alias("s"))
    rows = full.unionByName(short).groupBy("item_id", "n").agg(F.array_distinct(F.flatten(F.collect_list("s"))).alias("s"))
    parts = F.split("shingle", " ")
    hashes = F.when(F.col("n") == 5, F.xxhash64(*[F.get(parts, F.lit(k)) for k in range(5)]))
    for n in range(1, SHINGLE_WORDS):
        hashes = hashes.when(F.col("n") == n, F.xxhash64(*[F.get(parts, F.lit(k)) for k in range(n)]))
    return rows.select("item_id", "n", F.size("s").alias("size"), F.explode("s").alias("shingle")).withColumn("hash", hashes)


def bands(rows: int) -> int:
    """Bands of that many MinHash values, so that an item contained to MIN_CONTAINMENT is missed with probability MISS at most."""
    return math.ceil(math.log(MISS) / math.log(1 - MIN_CONTAINMENT**rows))


def item_bands(sh: DataFrame) -> DataFrame:
    """(hash, item_id, band, rows): the MinHash signature of each item, by size partition."""
    parts = []
    for rows, of_size in ((1, F.col("size") < LARGE_ITEM), (2, F.col("size") >= LARGE_ITEM)):
        each = sh.where(of_size).select("item_id", "hash", F.explode(F.sequence(F.lit(0), F.lit(bands(rows) * rows - 1))).alias("p"))
        least = each.groupBy("item_id", "p").agg(F.min_by("hash", F.struct(F.xxhash64("hash", "p"), "hash")).alias("hash"))
        parts.append(least.groupBy("item_id", F.floor(F.col("p") / rows).cast("int").alias("band")).agg(F.collect_set("hash").alias("hs")))
    both = parts[0].unionByName(parts[1])
    return both.groupBy("item_id", "hs").agg(F.min("band").alias("band")).select("item_id", "band", F.size("hs").alias("rows"), F.explode("hs").alias("hash"))


def _lookup(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it fits; beyond, the join shuffles both sides and large keys are split as skewed."""
    return F.broadcast(df) if fits(df) else df


def contained(docs: DataFrame, items: DataFrame, min_containment: float = MIN_CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, n_shared, item_size, containment): items whose distinct 5-word shingles a document holds to min_containment or more.

    Items are partitioned by size. An item's signature is its MinHash values under as many permutations as its partition
    needs; a document is asked for them among all of its shingles, as the chance that a set holds another's MinHash is the
    other's containment in it, however long the document is (a document's own short signature would be blind to an
    item a thousandth of its size). Documents that hold a band are candidates. Each candidate pair then asks for the item's shingles, as texts, among those of its
    document that any item has: a shingle that many items share is compared for the pairs that are candidates only.

    Words are lower-case runs of letters and digits. Wordless items and documents match nothing; an item of fewer words than five is
    one shorter shingle. Rows that share a doc_id or item_id count as one whose shingles they share. Rows with null ids are left out of the pairs.
    Empty tables give no rows; other columns are ignored.
    """
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sh = stored(item_shingles(items.where("item_id is not null")), "item-shingles")
    signature = stored(item_bands(sh), "item-bands")
    sizes = sorted(r[0] for r in sh.select("n").distinct().collect())  # of 1 to 5
    if not sizes:
        return docs.select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0).cast("long").alias("n_shared"), F.lit(0).alias("item_size"), F.lit(0.0).alias("containment")).limit(0)

    def of_all(of) -> Column:
        made = [shingles(F.col("w"), n, of) for n in sizes]
        return made[0] if len(made) == 1 else F.concat(*made)

    worded = docs.select("doc_id", words(F.col("text")).alias("w"))
    held = worded.select("doc_id", F.explode(of_all(_hash)).alias("hash"))
    hits = held.join(_lookup(signature), "hash").groupBy("doc_id", "item_id", "band", "rows").agg(F.count_distinct("hash").alias("n"))
    candidates = stored(hits.where("n >= rows").select("doc_id", "item_id").distinct(), "candidates")
    asked = docs.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", words(F.col("text")).alias("w"))
    any_item = sh.select("shingle").distinct()
    exact = asked.select("doc_id", F.explode(F.array_distinct(of_all(_text))).alias("shingle")).join(_lookup(any_item), "shingle", "left_semi").distinct()
    wanted = candidates.join(_lookup(sh.select("item_id", "shingle", "size")), "item_id")
    shared = wanted.join(exact, ["doc_id", "shingle"]).groupBy("doc_id", "item_id", "size").agg(F.count("*").alias("n_shared"))
    part = (F.col("n_shared") / F.col("size")).alias("containment")
    return shared.select("doc_id", "item_id", "n_shared", F.col("size").alias("item_size"), part).where(F.col("containment") >= min_containment)


def without_leaks(docs: DataFrame, items: DataFrame, min_containment: float = MIN_CONTAINMENT) -> DataFrame:
    """docs without rows that contain a benchmark item, with all their columns.

    Each row counts by itself: those without doc_id, or with a shared one, are told apart by a hash of doc_id and text; repeated rows go or stay alike. Null, empty and
    wordless texts stay; so does everything if items is empty. Items without item_id or words match nothing. Columns may have any name but _leak.
    """
    row = F.xxhash64(docs.doc_id.cast("long"), docs.text.cast("string"))
    found = stored(contained(docs.select(row.alias("doc_id"), "text"), items, min_containment).select(F.col("doc_id").alias("_leak")).distinct(), "leaks")
    return docs.join(found, row == F.col("_leak"), "left_anti")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shared", F.col("item_size").cast("long").alias("item_size"), F.round("containment", 6).alias("containment"))


_WORDED = r"""
    SELECT {id}, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w
    FROM {table}
"""
_SHINGLED = """
    SELECT DISTINCT {id}, array_to_string(w[i : i + 4], ' ') AS shingle
    FROM (SELECT {id}, w, unnest(range(1, len(w) - 3)) AS i FROM {name})
"""
QUERIES = {"op4_decontaminate": op4_decontaminate}
ORACLE = {
    "op4_decontaminate": f"""
WITH d AS ({_WORDED.format(id="doc_id", table="documents")}), b AS ({_WORDED.format(id="item_id", table="benchmark")}),
ds AS ({_SHINGLED.format(id="doc_id", name="d")}), bs AS ({_SHINGLED.format(id="item_id", name="b")}),
sizes AS (SELECT item_id, count(*) AS item_size FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, item_size, round(count(*) / item_size, 6) AS containment
FROM ds JOIN bs USING (shingle) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id, item_size HAVING count(*) / item_size >= 0.8
"""
}
