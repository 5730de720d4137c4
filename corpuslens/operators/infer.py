"""Batched inference with injected models: batches in Arrow, retries on memory errors, order kept by an ordinal."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

#: Clips above this many seconds are left out, those above LONG go one at a time.
MOST_SECONDS, LONG = 40.0, 30.0


def out_of_memory(error: Exception) -> bool:
    return isinstance(error, MemoryError) or "out of memory" in str(error).lower()


def with_backoff(items: list, run: Callable[[list], list], size: int) -> tuple[list, int]:
    """Results of run over batches; a batch that runs out of memory is halved, down to one, and the smaller size is kept."""
    out, at = [], 0
    while at < len(items):
        try:
            out += run(items[at : at + size])
            at += size
        except Exception as e:
            if not out_of_memory(e) or size == 1:
                raise
            size //= 2
    return out, size


def infer(df: DataFrame, model: Callable[[], Callable[[list], list]], value: str, out: str = "hyp", batch: int = 16, bucket: str | None = None) -> DataFrame:
    """df with out, a string per row; model() is called once per task and gives a function of a list of values.

    Rows with bucket true go alone. A result has the place of its row, so order needs no restoring; a smaller batch that
    memory forced is kept for the task.
    """
    schema, columns = df.withColumn(out, F.lit("")).schema, df.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, size = None, batch
        for frame in frames:
            call = call or model()
            alone = frame[bucket].astype(bool) if bucket else pd.Series(False, index=frame.index)
            result = pd.Series("", index=frame.index, dtype=object)
            short = frame.index[~alone]
            found, size = with_backoff(frame.loc[short, value].tolist(), call, size)
            result[short] = found
            for i in frame.index[alone]:
                result[i] = call([frame.loc[i, value]])[0]
            yield frame[columns].assign(**{out: result})

    return df.mapInPandas(run, schema)


def transcribe(clips: DataFrame, model: Callable[[], Callable[[list], list]], batch: int = 8, waveform: str = "waveform", rate: str = "sample_rate") -> DataFrame:
    """clips (id, waveform, sample_rate, text) of at most MOST_SECONDS with seconds and hyp; clips over LONG seconds alone."""
    timed = clips.withColumn("seconds", F.size(waveform) / F.col(rate)).where(F.col("seconds") <= MOST_SECONDS).withColumn("is_long", F.col("seconds") > LONG)
    return infer(timed, model, waveform, batch=batch, bucket="is_long").drop("is_long")


def translate(df: DataFrame, model: Callable[[], Callable[[list], list]], text: str = "text", batch: int = 16, out: str = "hyp") -> DataFrame:
    """df with its texts translated; blank texts give ''."""
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    done = infer(df.where(~blank), model, text, out, batch)
    return done.unionByName(df.where(blank).withColumn(out, F.lit("")))


def audio_hours(clips: DataFrame, *by: str, waveform: str = "waveform", rate: str = "sample_rate") -> DataFrame:
    return clips.groupBy(*by).agg((F.sum(F.size(waveform) / F.col(rate)) / 3600).alias("hours"))


def evaluate_systems(sets: dict[str, DataFrame], systems: dict[str, Callable[[], Callable[[list], list]]]) -> DataFrame:
    """(test_set, system, n, chrf, bleu) for sets of (id, src, refs) and injected translators."""
    from corpuslens.operators.scoring import bleu, chrf

    if not systems:
        raise ValueError("no system to evaluate")
    out = None
    for name, frame in sets.items():
        for system, model in systems.items():
            done = translate(frame, model, "src")
            row = chrf(done).crossJoin(bleu(done)).crossJoin(done.agg(F.count("*").alias("n")))  # one row each
            row = row.select(F.lit(name).alias("test_set"), F.lit(system).alias("system"), "n", "chrf", "bleu")
            out = row if out is None else out.unionByName(row)
    return out


def mono(channels: str = "channels"):
    """The mean of channels (array of arrays of samples)."""
    c = F.col(channels)
    at = F.sequence(F.lit(0), F.size(c[0]) - 1)
    return F.when(F.size(c) == 1, c[0]).otherwise(F.transform(at, lambda i: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + F.get(x, i)) / F.size(c)))


@F.pandas_udf(ArrayType(FloatType()))
def to_16k(channels: pd.Series, rate: pd.Series) -> pd.Series:
    """Channels (array of arrays of samples) mixed to one at 16 kHz: linear interpolation, after a moving average where the rate falls."""
    import numpy as np

    def one(c, r):
        x = np.mean([np.asarray(w, np.float64) for w in c], axis=0)
        if r == 16000 or not len(x):
            return x.astype(np.float32)
        if r > 16000:
            k = max(1, round(r / 16000))
            x = np.convolve(x, np.ones(k) / k, "same")
        n = round(len(x) * 16000 / r)
        return np.interp(np.arange(n) * r / 16000, np.arange(len(x)), x).astype(np.float32)

    return pd.Series([one(c, r) for c, r in zip(channels, rate, strict=True)])
