"""Quality scores by co-training: a classifier of text content and one of page metadata teach each other."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.common import map_arrow, read, stored

#: Labelled rows to learn from at most, those of least hash. Rows without a label all take part.
MOST_LABELLED = 8000
#: Rounds, and the share of the other rows that each view may label for the other one in a round (half of it as each class).
ROUNDS, TAUGHT = 5, 0.04
#: A view teaches only what it is this sure of.
SURE = 0.9
#: Steps between this certainty and the greatest log odds by which the surest rows are counted.
BINS = 1024
#: Labelled rows whose crc32 of doc_id modulo this is 0 calibrate the views and aren't learnt from.
FOLDS = 4
SOURCES, LANGUAGES, WORDS = 32, 8, 128
#: Rows whose views are held as a matrix at a time.
ROWS = 1024
#: A word's share is kept in steps of 1 / STEPS of the logarithm, as a byte.
STEPS = 32

STYLE = ("marks per character", "marks per word", "upper case", "digits", "word length", "long words", "short words", "different words", "repeated lines", "ends as a sentence", "bars")
#: The view of a text: how it is written, and which words and runs of marks it holds, by hash.
TEXT = (*STYLE, *(f"words {i}" for i in range(WORDS)))
#: The view of the metadata: nothing of it is read from the text.
META = ("log characters", "characters unknown", *(f"source {i}" for i in range(SOURCES)), *(f"language {i}" for i in range(LANGUAGES)))
_UPPER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = _DIGIT[48:58] = True
_MARK = np.array([32 < b < 127 and not chr(b).isalnum() and chr(b) not in ".,;:'\"!?()-" for b in range(256)])
_TOKEN = re.compile(r"\w+|[^\w\s]+")


def style(text: str | None) -> list[float]:
    """STYLE of a text; zeros of a null or empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    total, words = max(1, len(raw)), raw.split()
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    marks = float(counts[_MARK].sum())
    return [
        marks / total,
        marks / n,
        float(counts[_UPPER].sum() / total),
        float(counts[_DIGIT].sum() / total),
        float(lengths.mean()) / 10 if len(words) else 0.0,
        float((lengths > 12).mean()) if len(words) else 0.0,
        float((lengths <= 3).mean()) if len(words) else 0.0,
        len(set(words)) / n,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / max(1, len(lines)),
        float(counts[124] / n),
    ]


def words(text: str | None) -> bytes:
    """Shares of a text's words and runs of marks by hash: for each of WORDS numbers the logarithm of one and its parts per thousand, in steps, as a byte."""
    found = _TOKEN.findall((text or "").lower())
    at = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)) % np.uint64(WORDS)
    share = np.bincount(at.astype(np.int64), minlength=WORDS) * (1000 / max(1, len(found)))
    return np.rint(np.log1p(share) * STEPS).astype(np.uint8).tobytes()


def metadata(source: str | None, lang: str | None, n_chars: int | None) -> list[float]:
    """META as four numbers, source and language by number; null metadata counts as ''."""
    known = n_chars is not None and n_chars >= 0
    return [float(np.log1p(n_chars)) / 10 if known else 0.0, float(not known), float(zlib.crc32((source or "").encode()) % SOURCES), float(zlib.crc32((lang or "").encode()) % LANGUAGES)]


def views(x: np.ndarray) -> np.ndarray:
    """Rows of measures (STYLE, metadata's four numbers, words) as TEXT, then META with a column of their own for each source and language."""
    k, t = len(STYLE), len(TEXT)
    out = np.zeros((len(x), t + len(META)))
    out[:, :k], out[:, k:t] = x[:, :k], x[:, k + 4 :]
    out[:, t : t + 2] = x[:, k : k + 2]
    out[np.arange(len(x)), t + 2 + x[:, k + 2].astype(int)] = 1
    out[np.arange(len(x)), t + 2 + SOURCES + x[:, k + 3].astype(int)] = 1
    return out


def packed(plain: list[float], held: bytes) -> bytes:
    """A row of measures: STYLE and metadata as doubles, then words."""
    return np.array(plain, "<f8").tobytes() + held


def matrix(x: pa.Array) -> np.ndarray:
    """Rows of measures from packed()."""
    k = 8 * (len(STYLE) + 4)
    raw = np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(len(x), k + WORDS)
    return np.hstack([np.ascontiguousarray(raw[:, :k]).view("<f8"), raw[:, k:] / (STEPS * 10)])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights (the intercept last) by Newton's method with a ridge penalty."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge * w
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def _chance(o: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-o))


def _parts(model: dict, x: np.ndarray) -> list[np.ndarray]:
    z = (views(x) - model["mean"]) / model["scale"]
    return [z[:, : len(TEXT)], z[:, len(TEXT) :]]


def _bins(o: np.ndarray) -> np.ndarray:
    """The step of each of the log odds for a class, -1 below SURE."""
    low = np.log(SURE / (1 - SURE))
    return np.where(o >= low - 1e-12, np.clip((o - low) / (30 - low) * BINS, 0, BINS - 1), -1).astype(np.int64)


def _cut(counts: np.ndarray, n: int) -> tuple[int, float]:
    """(step, share): rows above the step and that share of those in it are the n surest, or all if they are fewer."""
    above = np.cumsum(counts[::-1])[::-1]
    if above[0] <= n:
        return 0, 1.0
    at = int(np.flatnonzero(above >= n)[-1])
    return at, float((n - (above[at] - counts[at])) / counts[at])


def _taught(model: dict, parts: list[np.ndarray], draw: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """The pseudo-labels of rows for each view after the rounds so far (-1: none). They follow from the rounds, so they are stored nowhere."""
    known = [np.full(len(y), -1.0), np.full(len(y), -1.0)]
    for views_then, cuts in model["rounds"]:
        o = [odds(parts[v], views_then[v]) for v in (0, 1)]
        for v, other in ((0, 1), (1, 0)):
            free = (y == -1) & (known[other] < 0)
            for label in (0, 1):
                at, share = cuts[v][label]
                b = _bins(o[v] if label else -o[v])
                known[other][free & ((b > at) | ((b == at) & (draw < share)))] = label
    return known


def _counted(model: dict, x: np.ndarray, draw: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Counts of the rows that each view could still teach, by view, class and step."""
    parts = _parts(model, x)
    known = _taught(model, parts, draw, y)
    out = []
    for v, other in ((0, 1), (1, 0)):
        o = odds(parts[v], model["views"][v])
        for label in (0, 1):
            b = _bins(o if label else -o)
            out.append(np.bincount(b[(y == -1) & (known[other] < 0) & (b >= 0)], minlength=BINS))
    return np.concatenate(out).astype(float)


def _newton(x: np.ndarray, y: np.ndarray, weight: float, w: np.ndarray) -> np.ndarray:
    """Loss, gradient and curvature of the rows at w, in one array."""
    o = odds(x, w)
    x, p = np.hstack([x, np.ones((len(x), 1))]), _chance(o)
    curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x
    return np.concatenate([[weight * (np.logaddexp(0, o) - y * o).sum()], weight * (x.T @ (p - y)), curve.ravel()])


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ROWS rows, none empty."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _summed(rows: DataFrame, made: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum of made(x, draw, y) over all rows; None of no rows. Each task sums its rows, then about the square root of as many tasks sum those sums, so
    that the driver gets few arrays however many tasks there are."""

    def told(total: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in slices(batches):
            part = made(matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False))
            total = part if total is None else total + part
        yield from told(total)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for one in batch.column(0):
                part = one.values.to_numpy()
                total = part if total is None else total + part
        yield from told(total)

    sums = map_arrow(rows.select("x", "draw", "y"), run, "total array<double>")
    tasks = rows.rdd.getNumPartitions()
    if tasks > 64:
        sums = map_arrow(sums.repartition(math.isqrt(tasks)), again, "total array<double>")
    found = sums.toArrow()["total"].to_pylist()
    return np.array(found).sum(0) if found else None


def _fitted(rows: DataFrame, model: dict, known: list[tuple[np.ndarray, np.ndarray]], penalty: float = 1.0, steps: int = 25) -> list[np.ndarray]:
    """Both views by Newton's method from where they are: known rows (x, y) here, rows with pseudo-labels where they lie, at half weight."""

    def made(at: list[np.ndarray]):
        def sums(x: np.ndarray, draw: np.ndarray, y: np.ndarray) -> np.ndarray:
            parts = _parts(model, x)
            taught = _taught(model, parts, draw, y)
            return np.concatenate([np.concatenate([[(t >= 0).sum()], _newton(p[t >= 0], t[t >= 0], 0.5, w)]) for p, t, w in zip(parts, taught, at, strict=True)])

        return sums

    w, last, step = [x.copy() for x in model["views"]], [np.inf, np.inf], [np.zeros_like(x) for x in model["views"]]
    for _ in range(steps):
        total, at, moved = _summed(rows, made(w)), 0, 0.0
        for v in (0, 1):
            k = len(w[v])
            model["taught"][v] = int(total[at])
            mine = total[at + 1 : at + 2 + k + k * k] + _newton(*known[v], 1.0, w[v])
            at += 2 + k + k * k
            ridge = np.full(k, penalty)
            ridge[-1] = 1e-6
            loss = mine[0] + (ridge * w[v] ** 2).sum() / 2
            if loss > last[v] * (1 + 1e-9) + 1e-9:  # too far: half of the way back
                step[v] = step[v] / 2
                w[v] = w[v] + step[v]
            else:
                last[v] = loss
                step[v] = np.linalg.solve(mine[1 + k :].reshape(k, k) + np.diag(ridge), mine[1 : 1 + k] + ridge * w[v])
                w[v] = w[v] - step[v]
            moved = max(moved, float(np.abs(step[v]).max()))
        if moved < 1e-4:  # the error is about the square of the last step
            break
    return w


def train(rows: DataFrame, x: np.ndarray, y: np.ndarray, fold: np.ndarray, rounds: int = ROUNDS) -> dict:
    """The model of rows (x, draw, y; y is -1 without a label) and of the labelled sample x, y, of which fold 0 calibrates.

    Mean and scale are those of all rows. In each round every row without a label is scored where it lies, the surest are found by
    counts and the views fitted by sums; what comes to the driver is some thousand numbers a task.
    """
    total = _summed(rows, lambda x, draw, y: np.concatenate([[len(x), (y == -1).sum()], views(x).sum(0)]))
    mean = total[2:] / total[0]
    scale = np.sqrt(_summed(rows, lambda x, draw, y: ((views(x) - mean) ** 2).sum(0)) / total[0])
    scale[scale < 1e-9] = 1.0
    model = {"mean": mean, "scale": scale, "rounds": [], "taught": [0, 0], "pool": int(total[1])}
    n = max(1, int(model["pool"] * TAUGHT / 2))
    parts = _parts(model, x)
    known = [(p[fold != 0], y[fold != 0].astype(float)) for p in parts]
    model["views"] = [logistic(p, k, np.ones(len(k))) for p, k in known]
    for _ in range(rounds if model["pool"] else 0):
        counts = _summed(rows, lambda x, draw, y: _counted(model, x, draw, y)).reshape(2, 2, BINS)
        model["rounds"].append((model["views"], [[_cut(counts[v, label], n) for label in (0, 1)] for v in (0, 1)]))
        model["views"] = _fitted(rows, model, known)
    held = fold == 0
    if held.sum() < 20 or len(set(y[held])) < 2:
        held = np.ones(len(y), bool)
    each = np.column_stack([odds(parts[v], model["views"][v]) for v in (0, 1)])
    ones = np.ones(int(held.sum()))
    model["calibrated"] = [logistic(each[held][:, [v]], y[held], ones, 0.01) for v in (0, 1)]
    both = np.column_stack([odds(each[:, [v]], model["calibrated"][v]) for v in (0, 1)])
    model["combined"] = logistic(both[held], y[held], ones, 1.0)
    return model


def score(model: dict, x: np.ndarray) -> np.ndarray:
    """Columns: calibrated text view, calibrated metadata view, combined."""
    parts = _parts(model, x)
    both = np.column_stack([odds(odds(parts[v], model["views"][v])[:, None], model["calibrated"][v]) for v in (0, 1)])
    return _chance(np.column_stack([both, odds(both, model["combined"])]))


def _columns(docs: DataFrame) -> list:
    have = lambda c, kind: F.col(c).cast(kind).alias(c) if c in docs.columns else F.lit(None).cast(kind).alias(c)
    return [have("doc_id", "long"), have("text", "string"), have("source", "string"), have("lang", "string"), have("n_chars", "long")]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, text, source, lang, n_chars = (c.to_pylist() for c in batch.columns)
        made = [style(t) + metadata(s, g, n) for t, s, g, n in zip(text, source, lang, n_chars, strict=True)]
        rows = [packed(x, words(t)) for x, t in zip(made, text, strict=True)]
        draw = [zlib.crc32(repr(d).encode() + x) / 2**32 for d, x in zip(doc, rows, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), pa.array(draw, pa.float64())], names=["doc_id", "x", "draw"])


def measured(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, x, draw, y) for each row of docs, stored: its measures, a number of [0, 1) by which ties are parted, and its label: -1 for none, -2 for one beyond the sample."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min((F.col("quality") == 1).cast("int")).alias("quality"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(MOST_LABELLED).select("_id", F.lit(True).alias("_in"))
    marks = known.join(F.broadcast(sample), "_id", "left").select("_id", F.when(F.col("_in"), F.col("quality")).otherwise(-2).alias("y"))
    rows = map_arrow(docs.select(*_columns(docs)), _measured, "doc_id long, x binary, draw double")
    # Rows without doc_id have no label; a hash spreads them over the tasks.
    same = (F.coalesce("doc_id", F.xxhash64("draw")) == F.col("_id")) & F.col("doc_id").isNotNull()
    return stored(rows.join(marks.hint("merge"), same, "left").select("doc_id", "x", "draw", F.coalesce("y", F.lit(-1)).alias("y")), "measures")


def fit(rows: DataFrame) -> dict | None:
    """The model learnt from measured rows: those of the labelled sample and all without a label; None without two classes of labels."""
    found = rows.where("y >= 0").select("doc_id", "y", "x").toArrow().combine_chunks()
    ids, y = found["doc_id"].to_pylist(), found["y"].to_numpy()
    if not {0, 1} <= set(y.tolist()):
        return None
    x = matrix(found["x"])
    at = sorted(range(len(ids)), key=lambda i: (ids[i], x[i].tolist()))
    fold = np.array([zlib.crc32(str(ids[i]).encode()) % FOLDS for i in at])
    return train(rows, x[at], y[at], fold)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text_score, meta_score, score, keep) for each row of docs: chances of label 1; keep is score >= 0.5.

    docs needs doc_id and text and may have source, lang and n_chars; other columns are ignored. Nulls and empty texts are scored. Of a
    doc_id's labels the least counts. Without labels of both classes all scores are 0.5. An empty table gives no rows; repeated rows are scored each.
    The text's view holds how a text is written and its words by hash, the other view source, lang and n_chars as the table has them. Texts are read once:
    their measures (15 numbers and 128 bytes) are stored.
    """
    rows = measured(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(fit(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in slices(batches):
            n = batch.num_rows
            s = score(model, matrix(batch.column(1))) if model else np.full((n, 3), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(s[:, k]) for k in range(3))], names=["doc_id", "text_score", "meta_score", "score"])

    found = map_arrow(rows.select("doc_id", "x"), run, "doc_id long, text_score double, meta_score double, score double")
    return found.withColumn("keep", F.col("score") >= 0.5)


def op8_cotrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {"op8_cotrain": op8_cotrain}
ORACLE: dict[str, str] = {}
