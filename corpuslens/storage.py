"""Tables in the shared folder, inputs dealt out over the cores, Arrow batches of bounded bytes: what every part of the engine stores and reads by."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of long texts.
TEXTS = ("documents", "pages", "conversations")
#: Bytes up to which a table is broadcast.
MOST_BROADCAST = 64 << 20
#: Bytes handed to a Python worker at a time: texts may be long, and a batch is held several times over.
BATCH_BYTES = 4 << 20
_MADE: dict[str, SparkSession] = {}
_ROOT = str(Path(__file__).resolve().parents[1])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. Texts that fewer tasks read than there are cores (a small file has one row group) are dealt out by a hash of
    their first column, so that a reread deals them alike; large inputs stay as they are read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, df.columns[0]) if name in TEXTS and df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local master gets a new one; a cluster gets an error, as executors can't share the driver's disk."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpuslens-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df by way of a Parquet table in the shared folder: its lineage ends there, and the table survives lost executors. drop() or clean() removes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    _MADE[path] = spark
    return back


def fits(df: DataFrame, most: int | None = None) -> bool:
    """Whether a table takes few enough bytes to be broadcast: 16 for each value and those of its strings, counted in the cluster."""
    each = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) if t == "string" else F.lit(0) for c, t in df.dtypes]
    size = df.agg(F.sum(sum(each, F.lit(16 * (len(each) + 1))).cast("long"))).first()[0] or 0
    return size <= (MOST_BROADCAST if most is None else most)


def drop(*dfs: DataFrame) -> None:
    """Remove tables made by stored() that nothing will read again; other DataFrames are left alone."""
    for df in dfs:
        path = getattr(df, "_stored_at", None)
        spark = _MADE.pop(path, None)
        if spark is not None:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def clean(spark: SparkSession) -> None:
    """Remove every table that this driver has stored and not dropped: for the end of a job, when results are written."""
    for path in [p for p, s in _MADE.items() if s is spark]:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        del _MADE[path]


#: What Python workers are told, so that the memory of large arrays goes back to the system when they are freed.
_WORKERS = {"MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": str(1 << 19), "MALLOC_TRIM_THRESHOLD_": str(1 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow in batches of at most BATCH_BYTES (the setting is read when the plan is made); workers find this package where the driver does."""
    spark = df.sparkSession
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") not in (str(BATCH_BYTES), f"{BATCH_BYTES}b"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    held = spark.sparkContext.environment
    held.update({k: v for k, v in _WORKERS.items() if k not in held})
    if _ROOT not in held.get("PYTHONPATH", "").split(os.pathsep):
        held["PYTHONPATH"] = os.pathsep.join(filter(None, [_ROOT, held.get("PYTHONPATH"), os.environ.get("PYTHONPATH")]))
    return df.mapInArrow(fn, schema)
