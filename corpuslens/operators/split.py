"""Leak-free splits: connected components over shared keys, seeded splits, leakage and audits."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.functions import text as T
from corpuslens.storage import drop, stored


def linked_groups(items: DataFrame, item: str, keys: list[str]) -> DataFrame:
    """(item, grp): items that share a key, directly or through others, share a group; groups are numbered from 0 by their least item.

    Keys are tagged with their position, so equal strings in different positions don't link, and go by a 128-bit hash: whole texts may be
    keys. Labels are the least item reached; each round takes the least of an item's keys' least labels and then follows labels
    once (pointer jumping), so the rounds grow with the logarithm of a chain's length; they end when no label changes. Each
    round's labels are written to the shared folder and those before it removed. What is joined is stored first, so that a key that many items hold
    is split over tasks as a skewed join.
    """
    tagged = F.array(*[F.when(F.col(k).isNotNull(), F.md5(F.concat(F.lit(f"{n}:"), F.col(k).cast("string")).cast("binary"))) for n, k in enumerate(keys)])
    edges = items.select(F.col(item).alias("item"), F.explode(tagged).alias("key")).where("key is not null").distinct()
    edges = stored(edges, "links")
    labels = stored(items.select(F.col(item).alias("item"), F.col(item).alias("label")).distinct(), "labels")
    while True:
        of_key = stored(edges.join(labels, "item").groupBy("key").agg(F.min("label").alias("low")), "keys")
        pulled = edges.join(of_key, "key").groupBy("item").agg(F.min("low").alias("low"))
        lower = stored(labels.join(pulled, "item", "left").select("item", "label", F.least("label", F.coalesce("low", "label")).alias("low")), "lower")
        target = lower.select(F.col("item").alias("_to"), F.col("low").alias("_low"))
        new = stored(lower.join(target, lower.low == target["_to"]).select("item", F.least("low", "_low").alias("label"), F.col("label").alias("old")), "labels")
        drop(of_key, lower, labels)
        labels = new
        if not new.where("label <> old").limit(1).count():
            break
    drop(edges)
    labels = labels.select("item", "label")
    roots = labels.select("label").distinct()
    numbered = _numbered(roots, "label").select("label", (F.col("_rank") - 1).alias("grp"))
    return labels.join(numbered, "label").select(F.col("item").alias(item), "grp")


def _numbered(df: DataFrame, order: str) -> DataFrame:
    """df with _rank from 1 in the order of a column of distinct values: sorted in ranges, ranges counted, no task that sees all rows."""
    dealt = stored(df.repartitionByRange(order).select("*", F.spark_partition_id().alias("_part")), "ranges")
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))  # a row per range
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    within = dealt.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    return within.join(F.broadcast(before), "_part").withColumn("_rank", F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")


def hash_order(seed: int, key: Column | str) -> Column:
    """A seeded order that SQL can reproduce: md5 of 'seed:key'."""
    return F.md5(F.concat(F.lit(f"{seed}:"), T._col(key).cast("string")).cast("binary"))


def train_test_split(df: DataFrame, key: str, test_size: float = 0.1, seed: int = 42, shuffle: bool = True, n: int | None = None) -> DataFrame:
    """df with split: the last fraction of a seeded order is 'test' (at least one row, rounded half to even), the rest 'train'."""
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")
    total = df.count() if n is None else n
    held = max(1, round(total * test_size))
    order = hash_order(seed, key) if shuffle else F.col(key)
    ranked = _numbered(df.withColumn("_order", F.struct(order, F.col(key))), "_order")
    return ranked.withColumn("split", F.when(F.col("_rank") > total - held, "test").otherwise("train")).drop("_order", "_rank")


def permutation_split(n: int, test_size: float = 0.1, seed: int = 42) -> list[str]:
    """Split of positions 0 to n - 1 by Python's seeded shuffle: for results that must equal those of random.Random."""
    order = list(range(n))
    random.Random(seed).shuffle(order)
    held = max(1, round(n * test_size))
    out = ["train"] * n
    for i in order[n - held :]:
        out[i] = "test"
    return out


def validate_split(df: DataFrame, text: str = "text", split: str = "split") -> DataFrame:
    """One row: train and test sizes, overlap (distinct texts in both), leak_free."""
    sides = df.groupBy(F.md5(F.col(text).cast("binary"))).agg(*[F.sum((F.col(split) == s).cast("bigint")).alias(s) for s in ("train", "test")])
    both = F.sum(((F.col("train") > 0) & (F.col("test") > 0)).cast("bigint"))
    return sides.agg(F.sum("train").alias("train"), F.sum("test").alias("test"), both.alias("overlap"), (both == 0).alias("leak_free"))


def split_leakage(df: DataFrame, key: str, split: str = "split", held_out: str = "test") -> DataFrame:
    """One row: held-out items, their unique keys, items and keys that train has too, leaked share of items."""
    per_key = df.groupBy(key).agg(F.sum((F.col(split) == held_out).cast("bigint")).alias("held"), F.max((F.col(split) == "train").cast("int")).alias("in_train")).where("held > 0")
    leaked = F.sum(F.when(F.col("in_train") == 1, F.col("held")).otherwise(0))
    return per_key.agg(
        F.coalesce(F.sum("held"), F.lit(0)).cast("bigint").alias("items"),
        F.count("*").alias("unique_keys"),
        F.coalesce(leaked, F.lit(0)).cast("bigint").alias("leaked_items"),
        F.coalesce(F.sum("in_train"), F.lit(0)).cast("bigint").alias("leaked_unique_keys"),
        F.coalesce(F.try_divide(leaked, F.sum("held")), F.lit(0.0)).alias("leaked_share"),
    )


def fill_splits(sizes: list[tuple[int, int]], fractions: dict[str, float]) -> dict[int, str]:
    """Split of each component (id, size), taken in order: the split furthest below its target takes it if that at least halves the gap, else train."""
    if not fractions or any(f <= 0 for f in fractions.values()) or sum(fractions.values()) >= 1 or "train" in fractions:
        raise ValueError("sizes must be positive, sum to less than 1 and not name 'train'")
    total = sum(n for _, n in sizes)
    target = {k: f * total for k, f in fractions.items()}
    filled = dict.fromkeys(fractions, 0)
    out = {}
    for ident, n in sizes:
        name = max(target, key=lambda k: target[k] - filled[k])
        gap = target[name] - filled[name]
        out[ident] = name if gap > 0 and n / 2 <= gap else "train"
        if out[ident] != "train":
            filled[name] += n
    return out


def disjoint_split(groups: DataFrame, fractions: dict[str, float] | None = None, seed: int = 42, shuffle: str = "hash") -> DataFrame:
    """groups (item columns and grp) with split: whole components only.

    Components are taken in the order of hash_order, or of Python's seeded shuffle ('python'). The fill is sequential; it runs over
    component sizes alone and stops when all targets are met, as all further components go to train: so what the driver
    reads is what held-out splits need, in order, and the rest is joined as train.
    """
    fractions = fractions or {"test": 0.1}
    sizes = groups.groupBy("grp").agg(F.count("*").alias("n"))
    if shuffle == "python":
        rows = sorted((r.grp, r.n) for r in sizes.collect())
        random.Random(seed).shuffle(rows)
        taken = fill_splits(rows, fractions)
    else:
        total = sizes.agg(F.sum("n")).first()[0] or 0
        taken = _fill_in_order(sizes.orderBy(hash_order(seed, "grp"), "grp"), total, fractions)
    held = [(g, s) for g, s in taken.items() if s != "train"]
    table = groups.sparkSession.createDataFrame(held, "grp long, split string") if held else groups.select(F.col("grp"), F.lit("").alias("split")).limit(0)
    return groups.join(table, "grp", "left").withColumn("split", F.coalesce("split", F.lit("train")))


def _fill_in_order(ordered: DataFrame, total: int, fractions: dict[str, float]) -> dict[int, str]:
    fill_splits([], fractions)  # checks the fractions
    target = {k: f * total for k, f in fractions.items()}
    filled, out = dict.fromkeys(fractions, 0), {}
    for row in ordered.toLocalIterator():
        name = max(target, key=lambda k: target[k] - filled[k])
        gap = target[name] - filled[name]
        if gap <= 0:  # every target is met: all that follows is train
            break
        if row.n / 2 <= gap:
            out[row.grp] = name
            filled[name] += row.n
    return out


def describe(df: DataFrame, split: str = "split") -> DataFrame:
    """Per split: utterances, hours, speakers, sentences, female and outdoor share (rounded half to even). Columns speaker, text_key, duration_seconds, gender, environment."""
    share = lambda c, v: F.bround(F.avg(F.when(F.col(c) == v, 1.0).otherwise(0.0)), 3)
    return df.groupBy(split).agg(
        F.count("*").alias("utterances"),
        F.bround(F.sum("duration_seconds") / 3600, 2).alias("hours"),
        F.count_distinct("speaker").alias("speakers"),
        F.count_distinct("text_key").alias("sentences"),
        share("gender", "Female").alias("female_share"),
        share("environment", "Outdoor").alias("outdoor_share"),
    )


def audit(df: DataFrame, official: str, disjoint: str) -> DataFrame:
    """(label, measure, items, unique_keys, leaked_items, leaked_unique_keys, leaked_share) for both splits: test sentences, test speakers, validation sentences."""
    parts = []
    for label, split in (("official", official), ("disjoint", disjoint)):
        for measure, key, held in (("test_sentence_leak", "text_key", "test"), ("test_speaker_leak", "speaker", "test"), ("validation_sentence_leak", "text_key", "validation")):
            parts.append(split_leakage(df, key, split, held).select(F.lit(label).alias("label"), F.lit(measure).alias("measure"), "*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of a seeded order (a sampling operator: the limit is what it is for)."""
    return df.orderBy(hash_order(seed, key), key).limit(n)
