"""Files of the time-series engine: panels, attribute tables, event lists, and their sinks."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of an event list.
EVENTS = "onset double, duration double"


def panel(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet panel, its keys from columns or from folders named key=value."""
    return spark.read.parquet(path)


def folder_keys(file_name: Column, separator: str = "_") -> Column:
    """The parts of the name of the folder that a file is in."""
    return F.split(F.element_at(F.split(file_name, "/"), -2), separator)


def attributes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header, of the schema given; nothing is inferred."""
    return spark.read.schema(schema).option("header", True).csv(path)


def numbers(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Rows of numbers parted by blanks or tabs, named in order, with the file of each; missing files are left out."""
    cells = F.split(F.trim("value"), r"\s+")
    lines = spark.read.option("ignoreMissingFiles", True).text(path)
    return lines.where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("file"), *[F.get(cells, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(names)])


def events(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(trial_type, file, onset, duration) of tab-parted lists, one path for each trial type."""
    read = lambda kind, path: spark.read.schema(EVENTS).option("sep", "\t").option("ignoreMissingFiles", True).csv(path).select(F.lit(kind).alias("trial_type"), F.col("_metadata.file_path").alias("file"), "onset", "duration")
    return reduce(DataFrame.unionByName, [read(k, p) for k, p in paths.items()])


def noise(spark: SparkSession, replicates: int, channels: int, samples: int, seed: int = 1) -> DataFrame:
    """(replicate, channel, t, value): standard normal noise, made where it is used.

    A cell's value comes from hashes of its number, so it is the same however rows are dealt to tasks.
    """
    cell = F.col("id")
    uniform = lambda salt: (F.shiftrightunsigned(F.xxhash64("id", F.lit(seed), F.lit(salt)), 11) + 0.5) / float(1 << 53)
    normal = F.sqrt(-2 * F.log(uniform(0))) * F.cos(2 * math.pi * uniform(1))
    return spark.range(replicates * channels * samples).select(
        F.floor(cell / (channels * samples)).cast("int").alias("replicate"), (F.floor(cell / samples) % channels + 1).cast("int").alias("channel"), (cell % samples).alias("t"), normal.alias("value")
    )


def write_artifact(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """A named result as Parquet, in folders by the columns given."""
    df.write.mode("overwrite").partitionBy(*(by or [])).parquet(path)


def write_attributes(df: DataFrame, path: str, columns: dict[str, str]) -> None:
    """A CSV table with a header, columns chosen and renamed."""
    df.select(*[F.col(old).alias(new) for old, new in columns.items()]).write.mode("overwrite").option("header", True).csv(path)
