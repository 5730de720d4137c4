"""Document fingerprints: bottom-k sketches of shingle hashes. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.llm.common import partitions, read

SHINGLE_WORDS = 5
#: Hashes that a sketch keeps: an estimate of resemblance has a standard error of 1 / (2 * sqrt(SKETCH)) at most.
SKETCH = 256
#: Ranges of doc_id that documents are sorted in, for each shuffle partition of the session; their bounds (some 40 bytes each) go to the driver.
RANGES = 4
_MASK = (1 << 63) - 1
_SPACE = " \t\n\x0b\f\r"


def with_sketch(df: DataFrame, text: str, name: str, k: int = SKETCH) -> DataFrame:
    """df with the bottom-k sketch (array of long, ascending) of the words of a text column as column name.

    Hashes are 63 bits of XXH64 over each five lower-case words; a shorter text is one shingle, a wordless or null one has an empty sketch.
    """
    w, h, few = f"_{name}_w", f"_{name}_h", f"_{name}_few"
    bare = F.btrim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(_SPACE))
    df = df.withColumn(w, F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t\n\x0B\f\r]+")))
    at = F.sequence(F.lit(0), F.size(w) - SHINGLE_WORDS)
    hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(F.col(w), i + n) for n in range(SHINGLE_WORDS)]).bitwiseAND(F.lit(_MASK)))
    one = F.array(F.xxhash64(F.array_join(w, " ")).bitwiseAND(F.lit(_MASK)))
    df = df.withColumn(h, F.when(F.size(w) >= SHINGLE_WORDS, hashes).when(F.size(w) > 0, one).otherwise(F.array().cast("array<bigint>")))
    # Of a long text first only hashes below a bound that about 3 k of them pass: sorting all is needed only if too few differ.
    bound = F.when(F.size(h) > 4 * k, (F.lit(3.0 * k) / F.size(h) * float(_MASK)).cast("long")).otherwise(F.lit(_MASK))
    df = df.withColumn(few, F.sort_array(F.array_distinct(F.filter(h, lambda x: x <= bound))))
    full = F.when((F.size(few) >= k) | (F.size(h) <= 4 * k), F.col(few)).otherwise(F.sort_array(F.array_distinct(h)))
    return df.withColumn(name, F.slice(full, 1, k)).drop(w, h, few)


def merged(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merged_by(df: DataFrame, by: list[str], sketch: str, k: int = SKETCH) -> DataFrame:
    """One sketch per group of parts: the k least hashes, limited before the shuffle too, so that a hot group sends k hashes a task."""
    # explode() would have the optimizer test the array's size below, and inline into that test all that makes the sketch.
    each = df.select(*by, F.explode_outer(sketch).alias("_hash")).where("_hash is not null").distinct()
    least = each.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_hash"))).where(f"_n <= {k}")
    return least.groupBy(*by).agg(F.sort_array(F.collect_list("_hash")).alias(sketch))


def _union(a: Column, b: Column, k: int) -> Column:
    """The hashes that both sketches vouch for: all if neither is full, else the k least."""
    both = F.sort_array(F.array_union(a, b))
    return F.when((F.size(a) < k) & (F.size(b) < k), both).otherwise(F.slice(both, 1, k))


def resemblance(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Estimated share of shingles in both among those in either; 1 for two empty sketches."""
    union = _union(a, b, k)
    same = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(same / F.size(union))


def containment(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Estimated share of a's shingles that b has; 1 if a is empty."""
    union = _union(a, b, k)
    mine = F.size(F.array_intersect(a, union))
    return F.when(mine == 0, F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(F.size(F.array_intersect(F.array_intersect(a, b), union)) / mine)


def distinct_shingles(a: Column, k: int = SKETCH) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / (F.element_at(a, -1) / float(_MASK)))


def written(a: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits for each hash, ascending."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def _ranges(keys: DataFrame, many: int) -> list[tuple[int, int]]:
    """Least (key, tie) of each of about `many` ranges of about equal size, ascending."""
    dealt = keys.repartitionByRange(many, "key", "tie").select(F.spark_partition_id().alias("range"), F.struct("key", "tie").alias("at"))
    return sorted((r.least.key, r.least.tie) for r in dealt.groupBy("range").agg(F.min("at").alias("least")).collect())


def with_next(docs: DataFrame, ranges: int) -> tuple[DataFrame, Window]:
    """Rows (doc_id, key, tie, text, real) dealt out in ranges of (doc_id, hash of the text), and the window that orders each range.

    Each range also gets a copy (real = false) of the first row of the next one, the last range of the first row of all, so that
    lead() finds every row's successor in its own range: one shuffle of the texts, no task that sees all rows. Rows without a doc_id are
    dealt by their hash.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"), text.alias("text")).withColumn("tie", F.xxhash64("text"))
    least = _ranges(keyed.select("key", "tie"), ranges) or [(0, 0)]
    bounds, ties = (F.split(F.lit(",".join(str(x[n]) for x in least)), ",").cast("array<bigint>") for n in (0, 1))
    steps = F.array(*[F.lit(1 << b) for b in range(len(least).bit_length() - 1, -1, -1)])
    reached = lambda at: (F.get(bounds, at) < F.col("key")) | ((F.get(bounds, at) == F.col("key")) & (F.get(ties, at) <= F.col("tie")))
    ranked = keyed.withColumn("range", F.aggregate(steps, F.lit(0), lambda lo, s: F.when(reached(lo + s), lo + s).otherwise(lo)))
    here = F.struct("range", F.lit(0).alias("wrap"), F.lit(True).alias("real"))
    before = F.struct(F.when(F.col("range") == 0, F.lit(len(least) - 1)).otherwise(F.col("range") - 1).alias("range"), (F.col("range") == 0).cast("int").alias("wrap"), F.lit(False).alias("real"))
    first = (F.get(bounds, F.col("range")) == F.col("key")) & (F.get(ties, F.col("range")) == F.col("tie"))
    rows = ranked.select("doc_id", "key", "tie", "text", F.explode(F.when(first, F.array(here, before)).otherwise(F.array(here))).alias("p")).select("doc_id", "key", "tie", "text", "p.*")
    return rows, Window.partitionBy("range").orderBy("wrap", "key", "tie", F.desc("real"))


def neighbours(docs: DataFrame, k: int = SKETCH) -> DataFrame:
    """Each row of docs with its sketch, its edited text (the last half of its code points replaced by the next document's first) and both likenesses.

    Null texts count as empty. Rows that share a doc_id follow each other in the order of a hash of their text; rows without
    doc_id come first. A single row is its own successor, an empty table gives no rows, other columns are ignored.
    """
    rows, order = with_next(docs, RANGES * partitions(docs.sparkSession))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring(F.lead("text").over(order), F.lit(1), half))
    both = rows.withColumn("edited", F.coalesce(edited, F.lit("")))
    sketched = with_sketch(with_sketch(both, "text", "sketch", k), "edited", "edited_sketch", k)
    return sketched.withColumn("next_sketch", F.lead("sketch").over(order)).where("real").drop("real", "wrap", "range", "key", "tie")


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written(F.col("sketch")).alias("fingerprint"),
        written(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


QUERIES = {"op1_fingerprint": op1_fingerprint}
ORACLE: dict[str, str] = {}
