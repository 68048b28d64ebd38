"""Panels: rows (keys..., channel, t, value), one for each sample of a channel.

Keys name a session, such as (subject, session); an absent session has no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from undula.operators.ordering import TIME_CHUNK, following, numbered

Keys = Sequence[str]


def dense(cells: DataFrame, channels: DataFrame, fill: float = 0.0) -> DataFrame:
    """Every channel at every t from 0 to the last, absent cells filled. channels: (channel).

    Times are dealt out in chunks, so no row or task holds all of them.
    """
    last = cells.agg(F.max("t").alias("last")).where("last is not null")
    chunks = last.select("last", F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / TIME_CHUNK))).alias("chunk"))
    low = F.col("chunk") * TIME_CHUNK
    times = chunks.select(F.explode(F.sequence(low, F.least(low + TIME_CHUNK - 1, F.col("last").cast("long")))).alias("t")).withColumn("t", F.col("t").cast(dict(cells.dtypes)["t"]))
    grid = times.join(F.broadcast(channels.select("channel")))  # a row for each channel
    return grid.join(cells, ["channel", "t"], "left").select("channel", "t", F.coalesce("value", F.lit(fill)).alias("value"))


def group_mean(samples: DataFrame, labels: DataFrame, keys: Keys = ()) -> DataFrame:
    """Mean over the voxels of a label at each t; label 0 is background. samples: (keys, voxel, t, value), labels: (voxel, label)."""
    inside = labels.where("label <> 0").select("voxel", "label")
    return samples.join(inside, "voxel").groupBy(*keys, F.col("label").alias("channel"), "t").agg(F.avg("value").alias("value"))


def conforming(panel: DataFrame, length: int | Column, keys: Keys) -> DataFrame:
    """Sessions all of whose channels have exactly `length` samples."""
    counted = panel.groupBy(*keys, "channel").agg(F.count("*").alias("n"))
    right = counted.groupBy(*keys).agg(F.bool_and(F.col("n") == length).alias("ok")).where("ok").drop("ok")
    return panel.join(right, list(keys), "left_semi")


def complete_subjects(sessions: DataFrame, subject: str, at_least: int = 2) -> DataFrame:
    """Sessions of subjects that have at least so many."""
    enough = sessions.groupBy(subject).agg(F.count("*").alias("n")).where(F.col("n") >= at_least)
    return sessions.join(enough, subject, "left_semi")


def low_variance_channels(panel: DataFrame, least: float = 0.001) -> DataFrame:
    """(channel, variance) of channels whose sample variance over all rows is below `least`."""
    return panel.groupBy("channel").agg(F.var_samp("value").alias("variance")).where(F.col("variance") < least)


def global_signal(panel: DataFrame, keys: Keys = ()) -> DataFrame:
    """Mean over channels at each t."""
    return panel.groupBy(*keys, "t").agg(F.avg("value").alias("value"))


def _with_channel_sums(panel: DataFrame, keys: Keys, **sums: Column) -> DataFrame:
    """The panel with aggregates of each channel of a session, joined back to its samples."""
    by = [*keys, "channel"]
    return panel.join(panel.groupBy(*by).agg(*[v.alias(k) for k, v in sums.items()]), by)


def demeaned(panel: DataFrame, keys: Keys = ()) -> DataFrame:
    centred = _with_channel_sums(panel, keys, _m=F.avg("value")).withColumn("value", F.col("value") - F.col("_m"))
    return centred.select(panel.columns)


def zscored(panel: DataFrame, keys: Keys = ()) -> DataFrame:
    """Standard scores by the sample deviation; a constant channel scores 0."""
    sd = F.when((F.col("_sd") == 0) | F.col("_sd").isNull(), F.lit(1.0)).otherwise(F.col("_sd"))
    scored = _with_channel_sums(panel, keys, _m=F.avg("value"), _sd=F.stddev_samp("value"))
    return scored.withColumn("value", (F.col("value") - F.col("_m")) / sd).select(panel.columns)


def lag1_pairs(panel: DataFrame, keys: Keys = ()) -> DataFrame:
    """(keys, channel, t, y, x): each sample and the next of its session; the last has none. Null samples don't count."""
    each = following(panel.where("value is not null"), "value", [*keys, "channel"])
    return each.select(*keys, "channel", "t", F.col("value").alias("y"), "x").where("x is not null")


def regress_global_signal(panel: DataFrame, keys: Keys = ()) -> DataFrame:
    """Residual of each channel on an intercept and the mean over channels."""
    with_signal = panel.withColumn("_g", F.avg("value").over(Window.partitionBy(*keys, "t")))  # the channels of a t
    slope = F.try_divide(F.covar_pop("value", "_g"), F.var_pop("_g"))
    fitted = _with_channel_sums(with_signal, keys, _m=F.avg("value"), _b=F.coalesce(slope, F.lit(0.0)), _mg=F.avg("_g"))
    return fitted.withColumn("value", F.col("value") - (F.col("_m") + F.col("_b") * (F.col("_g") - F.col("_mg")))).select(panel.columns)


def split_in_time(panel: DataFrame, keys: Keys = (), share: float = 0.8) -> DataFrame:
    """The panel with `is_fit`: whether a sample is among the first `share` of its channel's, its rank from 1."""
    by = [*keys, "channel"]
    sizes = panel.groupBy(*by).agg(F.count("*").alias("_all"))
    ranked = numbered(panel, by, "_n").join(sizes, by)
    return ranked.withColumn("is_fit", F.col("_n") + 1 <= F.round(F.lit(share) * F.col("_all"))).select(*panel.columns, "is_fit")


def folds(ids: DataFrame, id_col: str, n_folds: int = 5, seed: int = 111) -> DataFrame:
    """(id, fold): ids dealt out in the order of a seeded hash, the last fold takes the remainder.

    Positions come from counts of hash ranges, so that no task orders all ids.
    """
    hashed = ids.select(id_col).distinct().withColumn("_h", F.xxhash64(id_col, F.lit(seed))).withColumn("_range", F.shiftright("_h", 52))
    sizes = hashed.groupBy("_range").agg(F.count("*").alias("n"))
    total = hashed.agg(F.count("*").alias("total"))
    before = sizes.select("_range", (F.sum("n").over(Window.orderBy("_range")) - F.col("n")).alias("before"))  # at most 4,096 rows
    placed = hashed.join(F.broadcast(before), "_range").join(F.broadcast(total))
    position = F.col("before") + F.row_number().over(Window.partitionBy("_range").orderBy("_h", id_col)) - 1
    size = F.greatest(F.floor(F.col("total") / n_folds), F.lit(1))
    return placed.select(id_col, (F.least(F.floor(position / size), F.lit(n_folds - 1)) + 1).cast("int").alias("fold"))


def paint(labels: DataFrame, values: DataFrame) -> DataFrame:
    """(voxel, value): each voxel with the value of its label; background and labels without one have null."""
    return labels.join(values, "label", "left").select("voxel", "value")
