"""Catalogue of sources: what to fetch and how, totals, listing, best runs, manifests."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.functions.values import human_bytes

#: Schema of a source as the planner reads it.
SOURCE = """id string, name string, kind string, description string, stats string, license string, license_url string, redistributable boolean, in_repo boolean, homepage string, citation string, notes string,
access struct<type: string, repo_id: string, repo: string, commit: string, files: array<string>, url: string, text_patterns: array<string>, audio_patterns: array<string>, text_bytes: bigint, audio_bytes: bigint,
transcripts_in_audio: boolean, extract_text: struct<format: string, column: string, glob: string>>"""


def unknown_ids(sources: DataFrame, wanted: Iterable[str]) -> list[str]:
    asked = sources.sparkSession.createDataFrame([(w,) for w in sorted(set(wanted))], "id string")
    return sorted(r.id for r in asked.join(sources.select("id"), "id", "left_anti").collect())


def plan(sources: DataFrame, only: Iterable[str] | None = None, audio: bool = False, skip_restricted: bool = False) -> DataFrame:
    """(source_id, action, reason, repo_id, patterns, approx_bytes): what to do for each source; an unknown id is an error.

    The first that holds: in the repository, by hand, of an unknown access type, restricted (if those are skipped), download.
    """
    if only is not None:
        only = list(only)
        if missing := unknown_ids(sources, only):
            raise ValueError(f"unknown source id(s): {', '.join(missing)}")
        sources = sources.where(F.col("id").isin(*only))
    kind, none = F.col("access.type"), F.array().cast("array<string>")
    text, sound = F.coalesce("access.text_patterns", none), F.coalesce("access.audio_patterns", none)
    has_audio, with_audio = F.size(sound) > 0, (F.size(sound) > 0) & F.lit(audio)
    action = (
        F.when((kind == "github") | F.coalesce("in_repo", F.lit(False)), "in_repo").when(kind == "manual", "manual").when(kind.isNull() | (kind != "hf"), "skip")
        .when(F.lit(skip_restricted) & ~F.coalesce("redistributable", F.lit(False)), "skip").otherwise("download")
    )
    fetched = F.col("action") == "download"
    reason = (
        F.when(F.col("action") == "in_repo", "already in the repository")
        .when(F.col("action") == "manual", F.concat(F.lit("download by hand: "), F.coalesce("access.url", F.lit(""))))
        .when(~fetched & (kind.isNull() | (kind != "hf")), F.concat(F.lit("unsupported access type "), F.coalesce(kind, F.lit("none"))))
        .when(~fetched, F.concat(F.lit("restricted license: "), F.coalesce("license", F.lit(""))))
        .when(with_audio, "text + audio")
        .when(has_audio & F.coalesce("access.transcripts_in_audio", F.lit(False)), "transcripts are inside the audio files")
        .otherwise("text")
    )
    size = F.when(with_audio, F.col("access.text_bytes") + F.col("access.audio_bytes")).otherwise(F.col("access.text_bytes"))
    return sources.withColumn("action", action).select(
        F.col("id").alias("source_id"), "action", reason.alias("reason"), F.when(fetched, F.col("access.repo_id")).alias("repo_id"),
        F.when(fetched & with_audio, F.concat(text, sound)).when(fetched, text).otherwise(none).alias("patterns"), F.when(fetched, size).alias("approx_bytes"),
    )


def totals(steps: DataFrame) -> DataFrame:
    """One row: downloads, the known sum of bytes, downloads of unknown size."""
    got = steps.where("action = 'download'")
    return got.agg(F.count("*").alias("downloads"), F.coalesce(F.sum("approx_bytes"), F.lit(0)).cast("bigint").alias("known_bytes"), F.count_if(F.col("approx_bytes").isNull()).alias("unknown"))


def listing(sources: DataFrame) -> DataFrame:
    """(id, kind, license, location, size): the catalogue for reading."""
    a = F.col("access")
    place = F.coalesce(a["repo_id"], a["repo"], a["url"], F.lit(""))
    size = F.when(F.size(F.coalesce(a["audio_patterns"], F.array().cast("array<string>"))) > 0, F.concat_ws(" / ", human_bytes(a["text_bytes"]), human_bytes(a["audio_bytes"]))).otherwise(human_bytes(a["text_bytes"]))
    return sources.select("id", "kind", "license", place.alias("location"), size.alias("size"))


def download(steps: DataFrame, fetch: Callable[[dict], None]) -> list[tuple[str, str]]:
    """Fetch each download step with an injected callable; one that fails doesn't stop the rest. Returns (source_id, error)."""
    failed = []
    for step in steps.where("action = 'download'").orderBy("source_id").collect():  # a row per source
        try:
            fetch(step.asDict())
        except Exception as e:  # noqa: BLE001
            failed.append((step.source_id, f"{type(e).__name__}: {e}"))
    return failed


def best_runs(results: DataFrame, ranks: dict[str, int], first_dataset: str) -> DataFrame:
    """The run of most clips of each (model, dataset), of equals the first by path, in report order: a dataset first, models by rank."""
    most = Window.partitionBy("model", "dataset").orderBy(F.desc("clips"), "path")
    one = results.where("model is not null and dataset is not null and clips is not null").withColumn("_n", F.row_number().over(most)).where("_n = 1").drop("_n")
    rank: Column = F.lit(99)
    for model, place in ranks.items():
        rank = F.when(F.col("model") == model, place).otherwise(rank)
    return one.orderBy(F.col("dataset") != first_dataset, rank, "model")


def manifest_diff(committed: DataFrame, built: DataFrame) -> DataFrame:
    """(path, status): files missing, unexpected or changed between two manifests (path, sha256)."""
    both = committed.select("path", F.col("sha256").alias("a")).join(built.select("path", F.col("sha256").alias("b")), "path", "full_outer")
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unexpected").when(F.col("a") != F.col("b"), "changed")
    return both.select("path", status.alias("status")).where("status is not null")
