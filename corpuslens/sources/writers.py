"""Writers: tab-separated and CSV text, models, provenance and manifests."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.sources.readers import SPLITS
from corpuslens.storage import map_arrow, stored

MODEL_FORMAT = 1


def clean(df: DataFrame) -> DataFrame:
    """All columns as cells: strings without tabs and line ends, trimmed, null as ''."""
    return df.select(*[T.clean_cell(F.col(c).cast("string")).alias(c) for c in df.columns])


def write_tsv(df: DataFrame, path: str, quote: str = "") -> None:
    """Tab-separated, header, UTF-8; without quotes cells are cleaned first, else quoted where needed. A file per partition."""
    rows = df if quote else clean(df)
    rows.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", quote or "\0").option("escape", quote or "\\").option("emptyValue", "").option("nullValue", "").csv(path)


def write_split_csv(df: DataFrame, path: str, key: str = "utterance_id") -> None:
    df.orderBy(key).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """A Parquet table for each split, as readers.speech() reads them."""
    for name in SPLITS:
        df.where(F.col(split) == name).drop(split).write.mode("overwrite").parquet(f"{path}/{name}.parquet")


def write_hypotheses(df: DataFrame, path: str) -> None:
    """A row per clip: id, seconds, reference and hypothesis, tab-separated."""
    write_tsv(df.select("id", "seconds", F.col("text").alias("reference"), F.col("hyp").alias("hypothesis")), path)


def write_predictions(df: DataFrame, path: str, target: str = "hyp") -> None:
    """A row per test text: key, source, prediction and the references as columns, tab-separated, quoted where needed; texts without a reference are left out."""
    refs = F.filter("refs", lambda x: x.isNotNull() & (x != ""))
    many = df.agg(F.max(F.size("refs"))).first()[0] or 0
    columns = [F.coalesce(F.get("refs", F.lit(k)), F.lit("")).alias(f"reference_{k + 1}") for k in range(many)]
    write_tsv(df.where(F.size(refs) > 0).select("key", "src", F.col(target).alias("prediction"), *columns), path, quote='"')


def save_model(path: str, words: DataFrame, bigrams: DataFrame, chars: DataFrame) -> None:
    """A restorer's three tables as Parquet with a format number; any size, unlike one JSON object."""
    for name, df in (("words", words), ("bigrams", bigrams), ("chars", chars)):
        df.withColumn("format", F.lit(MODEL_FORMAT)).write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    frames = [spark.read.parquet(f"{path}/{name}") for name in ("words", "bigrams", "chars")]
    for df in frames:
        if "format" not in df.columns or df.where(F.col("format") != MODEL_FORMAT).limit(1).count():
            raise ValueError(f"{path} isn't a restorer of format {MODEL_FORMAT}")
    return tuple(df.drop("format") for df in frames)


def model_json(words: DataFrame, bigrams: DataFrame, chars: DataFrame) -> str:
    """A small restorer as one JSON object {format, words, bigrams, chars: key -> form -> count}, forms as first seen."""

    def nested(df: DataFrame) -> dict:
        out: dict = {}
        for r in df.orderBy("first").select("key", "form", "n").toLocalIterator():
            out.setdefault(r.key, {})[r.form] = r.n
        return out

    return json.dumps({"format": MODEL_FORMAT, "words": nested(words), "bigrams": nested(bigrams), "chars": nested(chars)}, ensure_ascii=False)


def model_from_json(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    data = json.loads(text)
    if data.get("format") != MODEL_FORMAT:
        raise ValueError("unknown restorer format")
    out = []
    for part in ("words", "bigrams", "chars"):
        rows = [(k, f, n, i) for i, (k, f, n) in enumerate((k, f, n) for k, forms in data[part].items() for f, n in forms.items())]
        out.append(spark.createDataFrame(rows, "key string, form string, n long, first long"))
    return tuple(out)


PROVENANCE = ("id", "name", "license", "license_url", "homepage", "citation")


def provenance(sources: DataFrame) -> DataFrame:
    """(source_id, json): what a download's folder tells of its source."""
    return sources.select(F.col("id").alias("source_id"), F.to_json(F.struct(*[c for c in PROVENANCE if c in sources.columns])).alias("json"))


#: Bytes of a line from which on a manifest reads its file as one value; the line reader holds a line several times over.
LONG_LINE = 32 << 20
_MARK = b"\xef\xbb\xbf"


class _Digest:
    """SHA-256 of a file and its line feeds, from its lines in order, each with a line feed.

    The line reader tells neither whether the last line has one nor whether it dropped a byte-order mark; the file's size tells both.
    """

    def __init__(self):
        self.plain, self.marked, self.held, self.size, self.ends = hashlib.sha256(), hashlib.sha256(_MARK), b"", 0, 0

    def add(self, data: memoryview, ends: int) -> None:
        for h in (self.plain, self.marked):
            h.update(self.held)
            h.update(data[:-1])
        self.held, self.size, self.ends = bytes(data[-1:]), self.size + len(data), self.ends + ends

    def told(self, size: int) -> tuple[str | None, int | None]:
        """The digest and the number of line feeds of a file of so many bytes; nulls if lines are missing."""
        more = size - self.size
        if more not in (-1, 0, 2, 3):
            return None, None
        found = self.marked if more > 0 else self.plain
        if more in (0, 3):
            found.update(self.held)
        return found.hexdigest(), self.ends - (more in (-1, 2))


_PIECE = "file string, size long, block long, n long, ends long, sha256 string, data binary"
_TOLD = "file string, sha256 string, ends long"


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    made = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, made[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_PIECE rows of lines (file, size, block, length, data) as they are read: the digest of a file that is one block, the bytes of other blocks."""
    at, digest, n = None, None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block, data = batch.column("file"), batch.column("block"), batch.column("data").cast(pa.large_binary())
        new = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(block[1:], block[:-1]))
        cuts = [0, *(np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
        places = np.frombuffer(data.buffers()[1], np.int64)[data.offset :]
        held = memoryview(data.buffers()[2] or b"")
        for a, b in pairwise(cuts):
            here = tuple(batch.column(c)[a].as_py() for c in ("file", "size", "block", "length"))
            if here != at:
                if digest:
                    yield _rows(_PIECE, [(*at[:3], 0, *digest.told(at[1])[::-1], None)])
                at, n, digest = here, 0, _Digest() if here[1] == here[3] else None
            part = held[places[a] : places[b]]
            if digest:
                digest.add(part, b - a)
            else:
                yield _rows(_PIECE, [(*here[:3], n, b - a, None, bytes(part))])  # pyarrow never gives back a memoryview
                n += 1
    if digest:
        yield _rows(_PIECE, [(*at[:3], 0, *digest.told(at[1])[::-1], None)])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_TOLD rows of files from their _PIECE rows in order."""
    at, digest = None, None
    for batch in batches:
        done = []
        for file, size, _, _, ends, sha256, data in zip(*(batch.column(c) for c in range(batch.num_columns)), strict=True):
            if digest and file.as_py() != at[0]:
                done.append((at[0], *digest.told(at[1])))
                digest = None
            if data.is_valid:
                at, digest = (file.as_py(), size.as_py()), digest or _Digest()
                digest.add(memoryview(data.as_buffer()), ends.as_py())
            else:
                done.append((file.as_py(), sha256.as_py(), ends.as_py()))
        if done:
            yield _rows(_TOLD, done)
    if digest:
        yield _rows(_TOLD, [(at[0], *digest.told(at[1]))])


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, sha256, bytes, rows, lines) of files: rows of .tsv without the header, lines of .txt.

    No file is held whole, only its lines one by one. Text and what the line reader would decompress is read through a codec that changes nothing, as such
    files aren't split: the task that reads one makes its digest. Other files of several blocks are brought together in pieces, in order. Files with lines of
    LONG_LINE bytes and more, which the line reader leaves out or cuts, are read again as one value. Spark lists no empty files.
    """
    passed = spark._jvm.org.apache.hadoop.io.compress.PassthroughCodec
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    codecs = [spark._jvm.org.apache.hadoop.util.ReflectionUtils.newInstance(c, conf) for c in spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory.getCodecClasses(conf)]
    endings = sorted({".txt", ".tsv"} | {c.getDefaultExtension() for c in codecs}, key=len, reverse=True)

    def found(kind: str, **options: str | int) -> DataFrame:
        df = spark.read.format(kind).options(pathGlobFilter=pattern, recursiveFileLookup=True, **options).load(path)
        file = F.col("_metadata.file_path")
        return df.withColumns({"file": file, "ending": F.coalesce(*[F.when(file.endswith(e), e) for e in endings], F.lit(""))})

    def pieces(ending: str) -> DataFrame:
        whole = {"io.compression.codecs": passed.CLASSNAME, passed.OPT_EXTENSION: ending} if ending else {}
        df = found("text", lineSep="\n", **{"mapreduce.input.linerecordreader.line.maxlength": LONG_LINE}, **whole).where(F.col("ending") == ending)
        place = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_size", "size"), ("file_block_start", "block"), ("file_block_length", "length"))]
        line = F.when(F.octet_length("value") < LONG_LINE, F.concat("value", F.lit("\n")).cast("binary"))
        return map_arrow(df.select("file", *place, line.alias("data")), _pieces, _PIECE)

    files = found("binaryFile").select("path", "length", "file", "ending")
    parts = [pieces(r.ending) for r in files.select("ending").distinct().collect()] or [pieces("")]
    told = stored(map_arrow(reduce(DataFrame.unionByName, parts).repartition("file").sortWithinPartitions("file", "block", "n"), _joined, _TOLD), "manifest")
    rows = files.join(told, "file", "left").select("path", "length", "sha256", "ends")
    again = [re.sub(r"([][{}*?\\])", r"\\\1", r.path) for r in rows.where("sha256 is null").select("path").collect()]
    if again:  # without _metadata, for which Spark would copy the content
        ends = F.length("content") - F.length(F.replace(F.decode("content", "ISO-8859-1"), F.lit("\n"), F.lit("")))
        counted = F.when(F.col("path").endswith(".txt") | F.col("path").endswith(".tsv"), ends).cast("bigint")
        whole = spark.read.format("binaryFile").load(again).select("path", "length", F.sha2("content", 256).alias("sha256"), counted.alias("ends"))
        rows = rows.where("sha256 is not null").unionByName(whole)
    return rows.select(
        F.element_at(F.split("path", "/"), -1).alias("path"),
        "sha256",
        F.col("length").alias("bytes"),
        F.when(F.col("path").endswith(".tsv"), F.greatest(F.col("ends") - 1, F.lit(0))).cast("bigint").alias("rows"),
        F.when(F.col("path").endswith(".txt"), F.col("ends")).cast("bigint").alias("lines"),
    )
