"""Readers: text, CSV, TSV, JSON lines, Parquet and zip members as DataFrames with ordinals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t
from pyspark.sql.window import Window

from corpuslens.functions import text as T

#: Columns that hold text, in the order tried.
TEXT_COLUMNS = ("text", "transcription", "transcript", "content", "sentence")
#: Columns of a CSV that don't hold text.
KEY_COLUMNS = ("verse_key", "id", "book", "chapter", "verse")
SPLITS = ("train", "validation", "test")
_BOM = "\ufeff"


def _place() -> list[Column]:
    """Where a row was read: its file and the start of the part of it."""
    return [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block")]


def csv(spark: SparkSession, path: str | list[str], sep: str = ",", quote: str = '"', multi_line: bool | None = None, placed: bool = False) -> DataFrame:
    """Headed delimited text, all strings, a byte-order mark before the first name dropped; quote '' reads quotes as text.

    Quoted cells may hold line ends, so such a file is read by one task; multi_line=False reads files in parts, if no cell does. placed adds
    the file and the place in it, for _numbered().
    """
    many = bool(quote) if multi_line is None else multi_line
    df = spark.read.option("header", True).option("sep", sep).option("quote", quote).option("escape", quote or "\\").option("multiLine", many).csv(path)
    names = df.columns
    return df.select(*[F.col(f"`{c}`").alias(c.removeprefix(_BOM)) for c in names], *(_place() if placed else []))


def tsv(spark: SparkSession, path: str | list[str], quote: str = "") -> DataFrame:
    return csv(spark, path, "\t", quote)


def tsv_texts(spark: SparkSession, path: str | list[str], column: str = "text") -> DataFrame:
    """(text): the text column of tab-separated files with the usual quotes; empty ones dropped."""
    return tsv(spark, path, '"').select(F.col(column).alias("text")).where("text <> ''")


#: Line ends that Python's splitlines knows besides line feeds.
_ENDS = r"[\r\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, row, text): a row per line, also at the line ends that Python's splitlines knows (form feed, U+2028 and so on).

    Files are read in parts. Whether a file's last line has its line feed shows in the file's size, as texts are UTF-8.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(*_place(), F.col("_metadata.file_size").alias("_size"), "value", F.monotonically_increasing_id().alias("_at"))
    ends = raw.groupBy("file").agg((F.sum(F.octet_length("value") + 1) > F.max("_size")).alias("_open"), F.max(F.struct("_block", "_at")).alias("_last"))
    told = raw.join(ends, "file").withColumn("_open", F.col("_open") & (F.struct("_block", "_at") == F.col("_last")))
    whole = F.when(F.col("_open"), F.col("value")).otherwise(F.regexp_replace("value", r"\r$", ""))
    parts = told.select("file", "_block", "_at", "_open", F.split(whole, _ENDS).alias("_p"))
    kept = F.when(F.col("_open") & (F.element_at("_p", -1) == ""), F.slice("_p", 1, F.size("_p") - 1)).otherwise(F.col("_p"))
    return _numbered(parts.select("file", "_block", "_at", F.posexplode(kept).alias("_part", "text")), "_at", "_part")


def resolve(df: DataFrame, wanted: str | None = None, names: tuple[str, ...] = TEXT_COLUMNS) -> str:
    """The text column of a frame, settled when the plan is made; KeyError if there is none."""
    for name in ([wanted] if wanted else []) + list(names):
        if name in df.columns:
            return name
    raise KeyError(f"no text column among {df.columns}")


def parquet_text(spark: SparkSession, path: str | list[str], column: str | None = None) -> DataFrame:
    """(file, row, text) of one Parquet column (only that is read); null as ''."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return _numbered(df.select(*_place(), F.coalesce(F.col(resolve(df, column)).cast("string"), F.lit("")).alias("text")))


def jsonl_text(spark: SparkSession, path: str | list[str], column: str = "text", fallback: tuple[str, ...] = TEXT_COLUMNS) -> DataFrame:
    """(file, row, text) of JSON lines: a field, else the first of others that isn't null, else ''; blank lines don't count."""
    raw = spark.read.text(path).select(*_place(), "value").where(F.trim("value") != "")
    names = list(dict.fromkeys([column, *fallback]))
    value = F.coalesce(*[F.get_json_object("value", f"$['{n}']") for n in names], F.lit(""))
    return _numbered(raw.select("file", "_block", value.alias("text")))


def csv_text(spark: SparkSession, path: str | list[str], column: str | None = None) -> DataFrame:
    """(file, row, text) of CSV files: a named column, else the first that isn't a key. Each file's rows count from 0."""
    df = csv(spark, path, placed=True)
    names = df.columns[:-2]
    name = column if column in names else next((c for c in names if c not in KEY_COLUMNS), names[0])
    return _numbered(df.select("file", "_block", F.coalesce(F.col(f"`{name}`"), F.lit("")).alias("text")))


def _numbered(df: DataFrame, *order: str) -> DataFrame:
    """(file, row, text) of rows with the file and the _block of it that they were read from, numbered in each file from 0.

    The rows of a block are counted in one task, and a block's first number is the sum of the counts before it: a large file takes as many tasks as it has blocks.
    """
    if not order:
        df, order = df.withColumn("_at", F.monotonically_increasing_id()), ("_at",)
    counts = df.groupBy("file", "_block").agg(F.count("*").alias("_n"))
    before = counts.select("file", "_block", (F.sum("_n").over(Window.partitionBy("file").orderBy("_block")) - F.col("_n")).alias("_before"))
    within = df.withColumn("_in", F.row_number().over(Window.partitionBy("file", "_block").orderBy(*order)))
    return within.join(before, ["file", "_block"]).select("file", (F.col("_before") + F.col("_in") - 1).cast("bigint").alias("row"), "text")


READERS: dict[str, Callable] = {"parquet": parquet_text, "jsonl": jsonl_text, "csv": csv_text}


def extract_text(spark: SparkSession, files: str | list[str], spec: dict | None) -> DataFrame | None:
    """(file, row, text) of a source's files by its spec (format, column): cells cleaned, empty ones dropped, rows numbered before that; None without a spec."""
    if not spec:
        return None
    if spec["format"] not in READERS:
        raise KeyError(f"unknown format {spec['format']!r}")
    found = READERS[spec["format"]](spark, files, spec.get("column") or "text")
    return found.select("file", "row", T.clean_cell("text").alias("text")).where("text <> ''")


def corpus(spark: SparkSession, path: str, column: str = "text") -> DataFrame:
    """(sid, text): a corpus of sentences, normalized, empty ones dropped, in file order.

    A CSV with the named column gives that column; any other file, also a CSV without it, gives its lines.
    """
    if path.endswith(".csv") and column in csv(spark, path).columns:
        rows = _numbered(csv(spark, path, placed=True).select("file", "_block", F.col(column).alias("text")))
    else:
        rows = lines(spark, path)
    return rows.select(F.col("row").alias("sid"), T.normalize_text("text").alias("text")).where("text <> ''")


def read_lines(spark: SparkSession, path: str, column: str = "text") -> DataFrame:
    """(sid, text) of a .tsv (its text column, quotes as text), a .csv or plain lines; not normalized."""
    if path.endswith(".tsv"):
        df = csv(spark, path, "\t", "", placed=True)
        if column not in df.columns:
            raise ValueError(f"{path} has no column {column!r}")
        rows = _numbered(df.select("file", "_block", F.coalesce(column, F.lit("")).alias("text")))
    elif path.endswith(".csv"):
        return corpus(spark, path, column)
    else:
        rows = lines(spark, path)
    return rows.select(F.col("row").alias("sid"), "text")


def report_name(path: str) -> str:
    """What a report on a file is called: its folder where the file is text.tsv, else the file without its ending."""
    parts = path.rstrip("/").split("/")
    return parts[-2] if parts[-1] == "text.tsv" and len(parts) > 1 else parts[-1].rsplit(".", 1)[0]


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place))


def first_column(spark: SparkSession, path: str) -> DataFrame:
    """(text): the first column of a headed CSV, whatever its name; no rows if there is no such file."""
    if not exists(spark, path):
        return spark.createDataFrame([], "text string")
    df = csv(spark, path)
    return df.select(F.col(df.columns[0]).alias("text")).where("text <> ''")


UTTERANCE = t.StructType(
    [t.StructField(n, t.StringType()) for n in ("utterance_id", "text")]
    + [t.StructField("duration_seconds", t.DoubleType())]
    + [t.StructField(n, t.StringType()) for n in ("split", "participant_record_id", "gender", "recording_environment", "file_name")]
)


def utterances(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Speech metadata: JSON lines of several splits, one schema."""
    return spark.read.schema(UTTERANCE).json(paths)


def split_sentences(meta: DataFrame, assignment: DataFrame) -> DataFrame:
    """(split, text): distinct sentences of each split by the assignment (utterance_id, split)."""
    return meta.select("utterance_id", "text").join(assignment.select("utterance_id", "split"), "utterance_id").select("split", "text").distinct()


def speech(spark: SparkSession, path: str, split: str) -> DataFrame:
    if split not in SPLITS:
        raise ValueError(f"split must be one of {SPLITS}")
    return spark.read.parquet(f"{path}/{split}*.parquet")


def transcripts(df: DataFrame, column: str | None = None) -> DataFrame:
    """(text): normalized transcripts, empty ones dropped."""
    return df.select(T.normalize_text(resolve(df, column)).alias("text")).where("text <> ''")


def pairs(spark: SparkSession, path: str, src: str, tgt: str) -> DataFrame:
    """(verse_key, src, tgt): both sides normalized and not blank."""
    df = csv(spark, path)
    return df.select("verse_key", T.normalize_text(src).alias("src"), T.normalize_text(tgt).alias("tgt")).where("src <> '' and tgt <> ''")


def result_files(spark: SparkSession, path: str, needed: tuple[str, ...] = ("model", "dataset", "clips", "normalized")) -> DataFrame:
    """Benchmark results, a JSON file each, with path; files that lack a needed key are left out."""
    df = spark.read.option("multiLine", True).json(path).withColumn("path", F.col("_metadata.file_path"))
    missing = [n for n in needed if n not in df.columns]
    return df.limit(0) if missing else df.where(" and ".join(f"`{n}` is not null" for n in needed))


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """A row per source of a JSON catalogue {"sources": [...]}."""
    from corpuslens.operators.catalog import SOURCE

    return spark.read.option("multiLine", True).schema(f"sources array<struct<{_as_struct(SOURCE)}>>").json(path).select(F.explode("sources").alias("s")).select("s.*")


def _as_struct(schema: str) -> str:
    """'name type' pairs as 'name: type' at the top level."""
    parsed = t.StructType.fromDDL(schema)
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in parsed)


def zip_lines(spark: SparkSession, path: str, member: str) -> DataFrame:
    """(file, line, text): lines of a zip member, any line end, read on the executors."""
    import io
    import zipfile

    @F.udf("string", useArrow=True)
    def unzipped(content: bytes) -> str:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return z.read(member).decode("utf-8").replace("\r\n", "\n") if member in z.namelist() else ""

    raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), unzipped("content").alias("t"))
    return raw.select("file", F.posexplode(F.split(F.regexp_replace("t", r"\n$", ""), "\n")).alias("line", "text"))


def audio_clips(spark: SparkSession, path: str, decode: Callable[[bytes], tuple[list[float], int]], n: int | None = None, most_seconds: float = 40.0) -> DataFrame:
    """(id, waveform, sample_rate, text): clips decoded by an injected function, long ones left out, the first n by id."""
    df = spark.read.parquet(path)

    @F.udf("waveform array<float>, sample_rate int", useArrow=True)
    def decoded(content: bytes):
        waveform, rate = decode(content)
        return list(waveform), rate

    rows = df.select(F.col("audio.path").alias("id"), F.col(resolve(df)).alias("text"), decoded("audio.bytes").alias("a")).select("id", "a.waveform", "a.sample_rate", "text")
    short = rows.where(F.size("waveform") / F.col("sample_rate") <= most_seconds)
    return short.orderBy("id").limit(n) if n else short


def keep_first(df: DataFrame, text: Column | str, order: list[str]) -> DataFrame:
    """One row per text, the first in an order."""
    first = Window.partitionBy(T._col(text)).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def version_pairs(src: DataFrame, tgt: DataFrame, key: str = "verse_key", text: str = "text") -> DataFrame:
    """(verse_key, src, tgt): verses that two versions share, both texts normalized and not blank."""
    left = src.select(key, T.normalize_text(text).alias("src"))
    right = tgt.select(key, T.normalize_text(text).alias("tgt"))
    return left.join(right, key).where("src <> '' and tgt <> ''").select(F.col(key).alias("verse_key"), "src", "tgt")
