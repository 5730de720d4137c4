"""The row-wise operators on streams: the same plans, started from readStream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions import text as T


def read_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def normalized(stream: DataFrame, text: str = "text") -> DataFrame:
    """Each row's normalized text, marks and words; empty texts are dropped. Stateless: the same for a batch and a stream."""
    rows = stream.withColumn("norm", T.normalize_text(text)).where("norm <> ''")
    return rows.withColumn("marked", T.detect_diacritics("norm")).withColumn("n_words", F.size(T.words_of_normal("norm")))


def windowed_counts(stream: DataFrame, time: str, width: str = "1 day", late: str = "1 hour", *by: str) -> DataFrame:
    """(window, by, n): counts by event time; rows later than the watermark are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))
