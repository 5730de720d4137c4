"""Repeated passages by a sparse suffix array over minimiser positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.common import map_arrow, mix, neighbours, read, stored

#: A passage is repeated if this many words of it are.
MIN_WORDS = 50
#: Words of a suffix that every repeated passage holds from a retained position on.
KEY_WORDS = 25
#: The order key of rows without doc_id: they come after all others.
LAST = (1 << 63) - 1

_LONG = (1 << 64) - 1
#: Multipliers of two independent hashes of word sequences; odd, so that they have an inverse modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def word_hashes(text: str | None) -> tuple[list[bytes], np.ndarray]:
    """Words of a text (parted by ASCII white space) and their hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    return words, np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


class Sequences:
    """Hashes of any stretch of a text's words, from sums of powers."""

    def __init__(self, h: np.ndarray, base: int = BASES[0]):
        power, inverse = np.full(len(h) + 1, base, np.uint64), np.full(len(h) + 1, pow(base, -1, 1 << 64), np.uint64)
        power[0] = inverse[0] = 1
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * np.cumprod(power)[:-1], dtype=np.uint64)])
        self.inverse = np.cumprod(inverse)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.inverse[start] + (stop - start).astype(np.uint64))

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each position."""
        at = np.arange(max(0, len(self.sums) - n))
        return self.of(at, at + n)


def anchors(keys: np.ndarray, window: int) -> np.ndarray:
    """For each run of window keys the position of the least, the first of equals: what is chosen depends on the run alone."""
    runs = np.lib.stride_tricks.sliding_window_view(keys, window)
    out = np.empty(len(runs), np.int64)
    for at in range(0, len(runs), 1 << 14):
        out[at : at + (1 << 14)] = runs[at : at + (1 << 14)].argmin(1)
    return out + np.arange(len(runs))


def _suffixes(min_words: int, key_words: int):
    """The retained suffixes of each text: their first words, those that follow and those before, as far as a passage that holds the suffix may reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for ident, tie, text in zip(batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist(), strict=True):
                _, h = word_hashes(text)
                if len(h) >= min_words:
                    seq = Sequences(h)
                    grams = seq.grams(key_words)
                    at = np.unique(anchors(grams, min_words - key_words + 1))
                    follow = seq.of(np.minimum(at + key_words, len(h)), np.minimum(at + min_words, len(h)))
                    before = seq.of(np.maximum(at - (min_words - key_words), 0), at)
                    for x, y in zip(made, (grams[at].view(np.int64), follow.view(np.int64), before.view(np.int64), np.full(len(at), ident), np.full(len(at), tie), at.astype(np.int32)), strict=True):
                        x.append(y)
            if made[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in made], names=["first", "follow", "before", "row_id", "tie", "at"])

    return run


def places(text: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code points before each word and up to its end."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    inside = (raw != 32) & ((raw < 9) | (raw > 13))
    step = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return points[np.flatnonzero(step == 1)], points[np.flatnonzero(step == -1)]


EXTENDED = "passage long, check long, row_id long, tie long, word int, more int, start int, chars int, run boolean, kept boolean"


def _extended(min_words: int, key_words: int):
    """Each retained suffix that is shared, extended left and right to the passages of min_words words that hold it.

    Where another row with the same words all around comes first, its passages are copies: they come out as runs, whose hashes are those of their place. Else
    each passage comes out by its two hashes, to be compared with those of other suffixes that start alike. more counts the words beyond min_words; kept tells of
    runs and of passages that others are known to repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[list[np.ndarray]] = [[] for _ in range(10)]
            for ident, tie, text, shared in zip(batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words, h = word_hashes(text)
                if len(h) < min_words:
                    continue
                seq = Sequences(h)
                code = np.zeros(len(h), np.int8)  # 1 a copy, 2 the first of its surroundings, 3 one that others follow
                for x in shared:
                    code[x["at"]] = 1 if not x["leads"] else 3 if x["matched"] else 2
                of_window = code[anchors(seq.grams(key_words), min_words - key_words + 1)]
                first, last = places(text, words)
                copies = np.flatnonzero(np.diff(np.concatenate([[0], (of_window == 1).view(np.int8), [0]])))
                starts, stops = copies[::2], copies[1::2] + min_words - 1
                own = np.flatnonzero(of_window > 1)
                word, stop = np.concatenate([starts, own]), np.concatenate([stops, own + min_words])
                place = mix(mix(starts.astype(np.uint64) ^ np.uint64(int(ident) & _LONG)) ^ np.uint64(int(tie) & _LONG))
                is_run = np.arange(len(word)) < len(starts)
                cols = (
                    np.concatenate([place, seq.of(own, own + min_words)]).view(np.int64), np.concatenate([~place, Sequences(h, BASES[1]).of(own, own + min_words)]).view(np.int64),
                    np.full(len(word), ident), np.full(len(word), tie), word.astype(np.int32), (stop - word - min_words).astype(np.int32),
                    first[word].astype(np.int32), (last[stop - 1] - first[word]).astype(np.int32), is_run, is_run | np.concatenate([np.ones(len(starts), bool), of_window[own] == 3]),
                )
                for x, y in zip(made, cols, strict=True):
                    x.append(y)
            if made[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in made], names=[x.split()[0] for x in EXTENDED.split(", ")])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping passages of a row to spans, copies and others apart."""
    for batch in batches:
        rows: list[tuple] = []
        for ident, tie, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            for copy in (False, True):
                mine = sorted((x["word"], x["stop_word"], x["start"], x["stop"]) for x in found if x["is_copy"] == copy)
                span: list[int] | None = None
                for word, stop_word, start, stop in mine:
                    if span and word <= span[1]:
                        span[1], span[3] = max(span[1], stop_word), max(span[3], stop)
                    else:
                        if span:
                            rows.append((ident, tie, copy, *span))
                        span = [word, stop_word, start, stop]
                if span:
                    rows.append((ident, tie, copy, *span))
        if rows:
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["row_id", "tie", "is_copy", "word", "stop_word", "start", "stop"])


def _keys(docs: DataFrame) -> tuple[Column, Column]:
    """What names and orders a row: doc_id (rows without one last), then a hash of its text."""
    return F.coalesce(docs.doc_id.cast("long"), F.lit(LAST)), F.xxhash64(docs.text.cast("string"))


def spans(docs: DataFrame, min_words: int = MIN_WORDS, key_words: int = KEY_WORDS) -> DataFrame:
    """repeats() by row: (row_id, tie, is_copy, word, stop_word, start, stop), where row_id is doc_id or LAST, and tie a hash of the text."""
    ident, tie = _keys(docs)
    keyed = docs.select(ident.alias("row_id"), tie.alias("tie"), F.coalesce(docs.text.cast("string"), F.lit("")).alias("text"))
    suffixes = map_arrow(keyed, _suffixes(min_words, key_words), "first long, follow long, before long, row_id long, tie long, at int")
    sorted_suffixes = neighbours(suffixes, [["first"], ["first", "follow", "before"]], ["row_id", "tie", "at"], "suffixes")
    shared = sorted_suffixes.groupBy("row_id", "tie").agg(F.collect_list(F.struct("at", F.col("leads1").alias("leads"), F.col("matched1").alias("matched"))).alias("shared"))
    # What is shared grows with the corpus: it is shuffled at every size, not broadcast while it happens to be little.
    wanted = keyed.join(shared.hint("merge"), ["row_id", "tie"]).select("row_id", "tie", "text", "shared")
    extended = map_arrow(wanted, _extended(min_words, key_words), EXTENDED)
    passages = neighbours(extended, [["passage", "check"]], ["row_id", "tie", "word"], "passages", always="kept")
    is_copy = (F.col("run") | ~F.col("leads0")).alias("is_copy")
    found = passages.select("row_id", "tie", F.struct("word", (F.col("word") + min_words + F.col("more")).alias("stop_word"), "start", (F.col("start") + F.col("chars")).alias("stop"), is_copy).alias("found"))
    by_row = found.groupBy("row_id", "tie").agg(F.collect_set("found").alias("found"))
    return map_arrow(by_row, _merged, "row_id long, tie long, is_copy boolean, word int, stop_word int, start int, stop int")


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, key_words: int = KEY_WORDS) -> DataFrame:
    """(doc_id, is_copy, word, n_words, start, stop) for each longest run of words of docs that occurs elsewhere too.

    Suffixes are retained where a minimiser of the text lies, so that each passage of min_words words has one at a
    place that its words alone decide. They are sorted by their first key_words words, then by those that follow, then by those before, each taken as one letter
    in the order of its hash, and compared with their neighbours. A suffix whose neighbour agrees with it in all of these extends to the left and to
    the right as far as a passage can: all its passages are copies of the first such row's. Only the first one of each surroundings, and only if
    its first words are shared, is extended word by word to the passages that hold it; those are sorted and compared in turn by 128 bits of hash,
    as the best partner to the left and the best one to the right may be others than the neighbours. Thus no partner is missed and no pairs are made.

    Overlapping passages merge into spans: of passages that occur first here by (doc_id, hash of the text, place) (is_copy false) and of later
    copies (true). start and stop count characters of the text, word and n_words words parted by ASCII white space.

    Texts of fewer words, empty and null ones have no spans. Rows that share a doc_id and differ in text, and rows without doc_id, are documents of their own; the
    latter come last, so that a copy in one gives way to the one with a doc_id. Rows equal in doc_id and text count as one. doc_id 2**63 - 1 counts as null.
    An empty table gives no rows; other columns are ignored.
    """
    doc_id = F.when(F.col("row_id") != LAST, F.col("row_id")).alias("doc_id")
    return spans(docs, min_words, key_words).select(doc_id, "is_copy", "word", (F.col("stop_word") - F.col("word")).alias("n_words"), "start", "stop")


def without_copies(docs: DataFrame, min_words: int = MIN_WORDS, key_words: int = KEY_WORDS) -> DataFrame:
    """docs with later copies of repeated passages cut out of their text and n_chars set anew; rows left without words go, all other rows stay.

    Each row is cut by its own spans, whether its doc_id is null, shared or its own; what occurs first stays whole. Of rows equal in doc_id and text all stay, cut
    alike. Null, empty and short texts stay as they are, an empty table gives no rows. Columns may have any name that doesn't start with '_suffix'.
    """
    ident, tie = _keys(docs)
    cuts = spans(docs, min_words, key_words).where("is_copy").groupBy("row_id", "tie").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("_suffix_cut"))
    cuts = stored(cuts, "copies").withColumnsRenamed({"row_id": "_suffix_id", "tie": "_suffix_tie"})
    told = docs.select("*", ident.alias("_suffix_id"), tie.alias("_suffix_tie"))
    joined = told.join(cuts.hint("merge"), ["_suffix_id", "_suffix_tie"], "left")
    left = F.aggregate(
        "_suffix_cut",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.struct(x["stop"].alias("at"), F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"])).alias("out")),
        lambda acc: F.trim(F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))),
    )
    uncut = F.col("_suffix_cut").isNull()
    cut = joined.withColumn("text", F.when(uncut, F.col("text")).otherwise(left))
    kept = cut.where(uncut | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(uncut, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(read(spark, sf_dir, "documents"))


QUERIES = {"op7_suffix": op7_suffix}
ORACLE: dict[str, str] = {}
