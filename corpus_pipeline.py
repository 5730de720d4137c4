"""The corpus pipeline: documents through toxicity, near copies, repeated passages, benchmark leaks, to packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuslens.llm.common import drop, read, stored
from corpuslens.llm.decontaminate import without_leaks
from corpuslens.llm.packing import pack, vocabulary_path
from corpuslens.llm.simhash import one_of_each
from corpuslens.llm.suffix import without_copies
from corpuslens.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. Null and empty texts have the score of the base rate; rows without doc_id and repeated rows are scored each."""
    return without_toxic(docs, read(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row of the least doc_id stays; rows without doc_id come last, of ties and repeated rows one stays; null and empty texts are copies of each other."""
    return one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay where they occur first; documents with nothing else go. Each row is cut by its own passages, whatever its doc_id; null, empty and short texts stay."""
    return without_copies(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go, each row by its own text; null and empty texts stay."""
    return without_leaks(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences (a digest of their ids); null and empty texts give the end id alone."""
    return pack(docs, vocabulary_path(), with_ids=False)


STAGES = [("toxicity", toxicity), ("near_copies", near_copies), ("repeated_passages", repeated_passages), ("benchmark_leaks", benchmark_leaks), ("packing", packing)]

#: SimHash groups, trained weights and token ids are beyond SQL; tests hold each stage's operator against a brute-force version and run() against the stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read by the next, then the table before it is removed."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
