"""A default language predictor: character trigrams, trained from labelled text, applied in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import text as T

#: Trigrams kept per language.
KEPT = 2000


def train(df: DataFrame, lang: str = "lang", text: str = "text") -> dict[str, dict[str, float]]:
    """Log shares of the most frequent trigrams of each language."""
    low = df.select(lang, T.sentence_key(text).alias("t")).where("length(t) >= 3")
    grams = low.select(lang, F.explode(F.transform(F.sequence(F.lit(1), F.length("t") - 2), lambda i: F.substring(F.col("t"), i, F.lit(3)))).alias("g"))
    counts = grams.groupBy(lang, "g").agg(F.count("*").alias("n"))
    from pyspark.sql.window import Window

    ranked = counts.withColumn("_r", F.row_number().over(Window.partitionBy(lang).orderBy(F.desc("n"), "g"))).where(f"_r <= {KEPT}")
    model: dict[str, dict[str, float]] = {}
    for r in ranked.collect():  # KEPT rows a language at most
        model.setdefault(r[lang], {})[r.g] = float(r.n)
    return {k: {g: math.log(n / sum(v.values())) for g, n in v.items()} for k, v in model.items()}


def predictor(model: dict[str, dict[str, float]]) -> Callable:
    """A pandas UDF text -> struct(label, score)."""
    floor = math.log(1e-6)

    @F.pandas_udf("label string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        def one(x: str) -> tuple[str, float]:
            t = x.lower()
            n = max(1, len(t) - 2)
            sums = {k: sum(v.get(t[i : i + 3], floor) for i in range(len(t) - 2)) for k, v in model.items()}
            best = max(sums, key=sums.get)
            top = sums[best]
            return best, 1 / sum(math.exp(max(-50.0, (s - top) / math.sqrt(n))) for s in sums.values())

        return pd.DataFrame([one(x or "") for x in texts], columns=["label", "score"])

    return predict
