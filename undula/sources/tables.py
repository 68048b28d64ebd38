"""The panels and tables that queries read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.operators.panel import dense

START = "2024-01-01"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hour_of(ts: str = "ts"):
    """Hours since the start of the events."""
    return F.datediff(F.to_date(ts), F.lit(START).cast("date")) * 24 + F.hour(ts)


def hourly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel, t, value): mean event value of each type and hour; hours without events are 0."""
    events = read(spark, sf_dir, "events")
    cells = events.groupBy(F.col("event_type").alias("channel"), hour_of().alias("t")).agg(F.avg("value").alias("value"))
    return dense(cells, events.select(F.col("event_type").alias("channel")).distinct())


def embedding_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel, t, value): dimension 1.. of the vector with vec_id t."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("t"), F.posexplode(F.col("embedding").cast("array<double>")).alias("p", "value")).select(
        (F.col("p") + 1).alias("channel"), "t", "value"
    )


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, session, channel, t, value): events counted by user group, quarter of the days, type and hour."""
    events = read(spark, sf_dir, "events")
    return events.groupBy(
        (F.col("user_id") % 10).alias("subject"), (F.floor(hour_of() / 180) + 1).cast("int").alias("session"), F.col("event_type").alias("channel"), hour_of().alias("t")
    ).agg(F.avg("value").alias("value"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
