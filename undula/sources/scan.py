"""Scans of folders of sessions: what is there, which file counts for a key, and what was left out and why.

A listing is a table, made by Spark's own reader from any store it can open; choices
and reports are joins of it. Files are read in one scan of their folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Keys = Sequence[str]


def listing(spark: SparkSession, root: str, pattern: str, names: Keys, files: str = "*") -> DataFrame:
    """(path, length, names) of the files below root whose path the pattern matches, its groups by name, as strings.

    Contents are not read. Files without any bytes are not listed, and so count as missing.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", files).load(root).select("path", "length")
    parts = [F.regexp_extract("path", pattern, i + 1).alias(n) for i, n in enumerate(names)]
    return found.where(F.col("path").rlike(pattern)).select("path", "length", *parts)


def either(files: DataFrame, keys: Keys, choice: str, order: list[str]) -> DataFrame:
    """One row of files for each key: of the choices in `order` the first that is there; of files of one choice the first by path."""
    rank = F.array_position(F.array(*[F.lit(c) for c in order]), F.col(choice))
    known = files.where(rank > 0)
    others = [c for c in files.columns if c not in keys]
    best = known.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(rank, F.col("path"))).alias("_f"))
    return best.select(*keys, *[F.col(f"_f.{c}").alias(c) for c in others])


def left_out(expected: DataFrame, chosen: DataFrame, keys: Keys, denied: DataFrame | None = None, least: int = 1) -> DataFrame:
    """(keys, reason) of the expected keys that are not read: denied, missing, or empty, where the file has fewer than `least` bytes."""
    sizes = chosen.select(*keys, "length").withColumn("_there", F.lit(True))
    rows = expected.select(*keys).distinct().join(sizes, list(keys), "left")
    barred = F.lit(False)
    if denied is not None:
        rows = rows.join(denied.select(*keys).distinct().withColumn("_denied", F.lit(True)), list(keys), "left")
        barred = F.coalesce("_denied", F.lit(False))
    reason = F.when(barred, "denied").when(F.col("_there").isNull(), "missing").when(F.col("length") < least, "empty")
    return rows.select(*keys, reason.alias("reason")).where(F.col("reason").isNotNull())


def read_chosen(spark: SparkSession, root: str, chosen: DataFrame, keys: Keys, schema: str | T.StructType, skipped: DataFrame | None = None, kind: str = "parquet", files: str = "*", tolerant: bool = False) -> DataFrame:
    """(keys, columns of the schema) of the chosen files below root, without the skipped keys: one scan, of which other files' rows go.

    tolerant: files that can't be read give no rows, wherever they are below root.
    """
    wanted = chosen.select("path", *keys)
    wanted = wanted if skipped is None else wanted.join(skipped.select(*keys), list(keys), "left_anti")
    rows = spark.read.schema(schema).format(kind).option("recursiveFileLookup", True).option("pathGlobFilter", files).option("ignoreCorruptFiles", tolerant).load(root)
    return rows.withColumn("path", F.col("_metadata.file_path")).join(wanted, "path").drop("path")


def label_map(spark: SparkSession, first: str, whole: str) -> DataFrame:
    """(voxel, label): the labels of `first`, and from `whole` those of voxels beyond; of `first` alone where there is no such path.

    Any other error in reading is raised.
    """
    own = spark.read.parquet(first).select("voxel", "label")
    try:
        more = spark.read.parquet(whole).select("voxel", "label")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return own
    last = own.agg(F.max("voxel").alias("_last"))
    return own.unionByName(more.join(F.broadcast(last)).where("_last is null or voxel > _last").drop("_last"))
