"""Helpers that the training-data operators share: shared storage, Arrow batches, neighbour comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.storage import drop as drop
from corpuslens.storage import fits as fits
from corpuslens.storage import map_arrow as map_arrow
from corpuslens.storage import read as read
from corpuslens.storage import stored as stored


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche 64-bit integers (the finaliser of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


#: What a sorted partition tells of a row: it stands at the partition's start, at its end, or both.
AT_START, AT_END = 1, 2


def _runs(places: int, levels: list[int], always: int | None):
    """Compare sorted rows with their neighbours. The first `places` columns name and order a row; a level is a number of leading columns.

    Adds leads<n> (the first row of those that agree in the n-th level's columns) and matched<n> (there are others). Rows matched in the first level
    are kept, those at the ends of the partition, and those whose column `always` is true.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        opened = [False] * len(levels)  # whether the held row follows one that agrees with it
        start = AT_START

        def told(rows: pa.Table, follows: list[np.ndarray], followed: list[np.ndarray], edge: np.ndarray) -> Iterator[pa.RecordBatch]:
            keep = follows[0] | followed[0] | (edge > 0)
            if always is not None:
                keep |= rows.column(always).to_numpy()
            for n in range(len(levels)):
                rows = rows.append_column(f"leads{n}", pa.array(~follows[n])).append_column(f"matched{n}", pa.array(follows[n] | followed[n]))
            yield from rows.append_column("edge", pa.array(edge)).filter(pa.array(keep)).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            if held is not None:
                rows = pa.concat_tables([held, rows]).combine_chunks()
            cols = [rows.column(i).to_numpy() for i in range(places)]
            again = np.zeros(len(rows), bool)
            again[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in cols])
            if again.any():  # a repeated row is one occurrence
                rows = rows.filter(pa.array(~again)).combine_chunks()
                cols = [c[~again] for c in cols]
            follows = []
            for n, level in enumerate(levels):
                same = np.zeros(len(rows), bool)
                same[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in cols[:level]])
                same[0] = opened[n]
                opened[n] = bool(same[-1])
                follows.append(same)
            if len(rows) > 1:
                edge = np.zeros(len(rows) - 1, np.int32)
                edge[0], start = start, 0
                yield from told(rows.slice(0, len(rows) - 1), [f[:-1] for f in follows], [f[1:] for f in follows], edge)
            held = rows.slice(len(rows) - 1)
        if held is not None:
            yield from told(held, [np.array([o]) for o in opened], [np.array([False])] * len(levels), np.array([start | AT_END], np.int32))

    return run


def neighbours(df: DataFrame, levels: list[list[str]], order: list[str], name: str, always: str | None = None) -> DataFrame:
    """Rows of df that agree with others in the columns of the first level, by one global sort and a comparison of neighbours.

    The rows are sorted by the columns of the last level (those of the first lead them) and then by order; both together name a row and hold no nulls;
    equal rows count once. The sort is by range of all these columns, so a key held by a third of the rows spreads over many tasks. Adds, for the
    n-th level, leads<n>: the row is the first of those that agree with it, and matched<n>: there are others. Rows where the column `always` is true
    are kept too. Partitions' end rows, at most two each, settle runs that cross a border.
    """
    spark, cols = df.sparkSession, [*levels[-1], *order]
    rest = [c for c in df.columns if c not in cols]
    kinds = dict(df.dtypes)
    flags = [f"{f}{n}" for n in range(len(levels)) for f in ("leads", "matched")]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*cols, *rest]) + "".join(f", {f} boolean" for f in flags) + ", edge int"
    ordered = df.select(*cols, *rest).repartitionByRange(partitions(spark), *cols).sortWithinPartitions(*cols)
    fn = _runs(len(cols), [len(x) for x in levels], len(cols) + rest.index(always) if always else None)
    found = stored(map_arrow(ordered, fn, schema), name)
    out = found
    for n, level in enumerate(levels):
        place = F.struct(*cols[len(level) :])
        ends = found.where("edge > 0").groupBy(*level).agg(F.count("*").alias("_ends"), F.min(F.when(F.col("edge") >= AT_END, place)).alias("_before")).where("_ends > 1")
        crossed = out.join(F.broadcast(ends), level, "left")
        leads = F.col(f"leads{n}") & ~F.coalesce(F.col("_before") < place, F.lit(False))
        out = crossed.withColumns({f"leads{n}": leads, f"matched{n}": F.col(f"matched{n}") | F.col("_ends").isNotNull()}).drop("_ends", "_before")
    return out.where(F.col("matched0") | F.col(always) if always else F.col("matched0")).select(*cols, *rest, *flags)
