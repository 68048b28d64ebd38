"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folder for the tables of the step at hand, if it has one.
STEP_FOLDER: ContextVar[str | None] = ContextVar("STEP_FOLDER", default=None)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other character alone; null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder of its own; on a
    cluster that would not be shared, so it is refused there.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="undula-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, or in that of the step at hand, that no other run uses."""
    return f"{(STEP_FOLDER.get() or shared_folder(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Whether Spark removes a job's shuffle files at its end, or when the driver next collects garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, path: str) -> None:
    """Write the rows as Parquet. What the job shuffled is removed at its end, as nothing else reads it."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANED, "false")
    conf.set(CLEANED, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANED, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written as a table to the shared folder and read back, which cuts their lineage.

    Unlike a checkpoint's, the table's size is known to the planner, so that of plans
    which build on many rounds of joins stays true.
    """
    path = fresh_path(df.sparkSession, "table")
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A function from frames, the first argument one, to a frame, whose rows are written as a table at once.

    The tables that the step wrote on its way lie in a folder of its own, which is
    removed then, or when it fails. So what a long job holds on disk is that of the
    steps at hand. What comes out depends on the written table alone.
    """

    @functools.wraps(step)
    def run(first: DataFrame, *args, **kwargs) -> DataFrame:
        spark = first.sparkSession
        path, folder = fresh_path(spark, "table"), fresh_path(spark, "step")
        outer = STEP_FOLDER.set(folder)
        try:
            found = step(first, *args, **kwargs)
            write_table(found, path)
        finally:
            STEP_FOLDER.reset(outer)
            at = spark._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        return spark.read.schema(found.schema).parquet(path)

    return run


def broadcast_if_small(df: DataFrame, most: int, weight: Column | None = None) -> DataFrame:
    """Mark a frame for broadcast only where it has at most `most` rows, or sum of weight.

    weight: what a row counts where it holds an array or text, such as its length in
    units of some tens of bytes. A larger frame is returned as it is, and Spark joins it
    by a shuffle. Give a frame that is cheap to evaluate twice, such as one read from a
    checkpoint.
    """
    if weight is None:
        small = df.limit(most + 1).count() <= most
    else:
        small = (df.agg(F.sum(weight + 1)).first()[0] or 0) <= most
    return F.broadcast(df) if small else df


def release_memory() -> None:
    """Give back what a worker has freed: workers live on between tasks, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of sorted batches, cut between groups of the integer columns `keys` only.

    A table holds a batch's groups; a group that several batches hold comes at once.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        last = int(np.argmax(np.logical_and.reduce([c == c[-1] for c in columns])))
        ended = bool(held) and (last > 0 or any(held[0].column(k)[0].as_py() != c[0] for k, c in zip(keys, columns)))
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks()
        elif ended:
            yield pa.Table.from_batches(held).combine_chunks()
        held = ([] if last or ended else held) + [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
