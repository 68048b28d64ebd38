"""Order-dependent operators over the samples of a channel or pair."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from undula.functions.columns import safe_corr
from undula.operators.moments import channel_pairs
from undula.operators.ordering import at_positions, beside, joined, numbered, sign_runs, tiled, value_ranks
from undula.operators.panel import demeaned
from undula.sources.staging import written

Keys = Sequence[str]


def sliding_correlation(pairs: DataFrame, length: int, keys: Keys = ()) -> DataFrame:
    """(keys, i, j, t, rho): correlation over the `length` samples that end at t, full windows only; 0 where a side is constant.

    Samples are numbered and dealt to tiles, each with the samples before it that its
    windows need.
    """
    group = [*keys, "i", "j"]
    w = Window.partitionBy(*group, "_tile").orderBy("_n").rowsBetween(-(length - 1), 0)
    spread = F.stddev_pop("vi").over(w) * F.stddev_pop("vj").over(w)
    rho = F.when(spread > 1e-12, F.covar_pop("vi", "vj").over(w) / spread).otherwise(F.lit(0.0))
    tiles = tiled(numbered(pairs, group, "_n"), before=length - 1, n="_n")
    return tiles.select(*group, "t", "_n", "_own", rho.alias("rho")).where(F.col("_own") & (F.col("_n") >= length - 1)).select(*group, "t", "rho")


def dfc_std(sliding: DataFrame, keys: Keys = ()) -> DataFrame:
    """(keys, i, j, dfc_std): population deviation of sliding correlations."""
    return sliding.groupBy(*keys, "i", "j").agg(F.stddev_pop("rho").alias("dfc_std"))


def excursion(sliding: DataFrame, keys: Keys = (), alpha: float = 0.9, beta: float = 1.0) -> DataFrame:
    """(keys, i, j, excursion): sum over runs on one side of the median of run length^alpha times the run's greatest rho^beta.

    Samples equal to the median, to nine digits, are runs of their own side.
    """
    group = [*keys, "i", "j"]
    sliding = written(sliding.select(*group, "t", F.round("rho", 9).alias("rho")))
    mid = at_positions(value_ranks(sliding, "rho", group, (-1.0, 1.0)), "rho", (F.col("total") + 1) / 2, group, "_m")
    signed = sliding.join(mid, group).withColumn("_s", F.signum(F.round(F.col("rho") - F.col("_m"), 10)))
    runs = sign_runs(signed, "_s", "rho", group)
    return runs.groupBy(*group).agg(F.sum(F.pow(F.col("length"), F.lit(alpha)) * F.pow(F.col("top"), F.lit(beta))).alias("excursion"))


def lagged_covariance(panel: DataFrame, lags: int, keys: Keys = ()) -> DataFrame:
    """(keys, i, j, lag, value) for i < j: mean over t of vi(t) times vj(t + lag), over n - |lag| terms; demean first.

    Lags count samples that both channels have. The lagged partners of a sample are
    carried in its row by lead and lag, one sort for all lags, tile by tile.
    """
    group = [*keys, "i", "j"]
    by = Window.partitionBy(*group, "_tile").orderBy("_n")
    tiles = tiled(numbered(channel_pairs(panel, keys), group, "_n"), before=lags, after=lags, n="_n")
    moved = {f"_v{k + lags}": (F.lead("vj", k) if k >= 0 else F.lag("vj", -k)).over(by) for k in range(-lags, lags + 1)}
    shifted = F.array(*[F.struct(F.lit(k - lags).alias("lag"), F.col(f"_v{k}").alias("v")) for k in range(2 * lags + 1)])
    each = tiles.withColumns(moved).where("_own").select(*group, "vi", F.explode(shifted).alias("_s")).where("_s.v is not null")
    return each.groupBy(*group, F.col("_s.lag").alias("lag")).agg(F.avg(F.col("vi") * F.col("_s.v")).alias("value"))


def framed_covariance(panel: DataFrame, lags: int, keys: Keys = ()) -> DataFrame:
    """(keys, i, j, lag, value) for i < j as lagged_covariance, for panels of many channels; demean first.

    Lags count the frames of a session, a frame being a t at which any channel has a
    sample, and a mean is over the frames at which both samples are known. Frames are
    rows with arrays of their samples, dealt once to tiles that also have the frames
    their lags reach; a task sums matrix products of one tile at a time, and neither a
    row for each lag of a sample nor one for each pair and frame is made. A negative lag
    is the positive one of the pair turned round.
    """
    kinds = dict(panel.dtypes)
    cells = written(panel.groupBy(*keys, "t").agg(F.collect_list(F.struct("channel", F.col("value").cast("double").alias("value"))).alias("_c")).select(*keys, "t", "_c.channel", "_c.value"))
    tiles = tiled(numbered(cells, keys, "_n"), after=lags, n="_n").where("_tile >= 0").select(*keys, "_tile", "_n", "_own", "channel", "value")

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = pa.Table.from_batches(batches).combine_chunks()
        n, own = tile.column("_n").to_numpy(), pc.sum(tile.column("_own")).as_py()
        channel, value = (tile.column(c).combine_chunks() for c in ("channel", "value"))
        coded = channel.flatten().dictionary_encode()
        wide = np.full((len(n), len(coded.dictionary)), np.nan)
        np.fmax.at(wide, (np.repeat(n - n.min(), np.diff(channel.offsets.to_numpy())), coded.indices.to_numpy()), value.flatten().to_numpy(zero_copy_only=False))
        known, wide = (~np.isnan(wide)).astype(float), np.nan_to_num(wide)
        for lag in range(min(lags, len(n) - 1) + 1):
            at = slice(0, min(own, len(n) - lag)), slice(lag, min(own + lag, len(n)))
            count, total = (x[at[0]].T @ x[at[1]] for x in (known, wide))
            np.fill_diagonal(count, 0)
            i, j = np.nonzero(count)
            same = [pa.repeat(k, len(i)) for k in (*key[: len(keys)], pa.scalar(lag, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*same, *(coded.dictionary.take(pa.array(x)) for x in (i, j)), pa.array(count[i, j]), pa.array(total[i, j])], names=[*keys, "lag", "i", "j", "n", "lr"])

    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + ["lag int", *(f"{c} {kinds['channel']}" for c in "ij"), "n double", "lr double"])
    sums = tiles.groupBy(*keys, "_tile").applyInArrow(run, schema).groupBy(*keys, "lag", "i", "j").agg(F.sum("n").alias("n"), F.sum("lr").alias("lr"))
    ahead = F.col("i") < F.col("j")
    turned = sums.where(ahead | (F.col("lag") > 0))
    first, second = F.when(ahead, F.col("i")).otherwise(F.col("j")), F.when(ahead, F.col("j")).otherwise(F.col("i"))
    lag = F.when(ahead, F.col("lag")).otherwise(-F.col("lag"))
    return turned.select(*keys, first.alias("i"), second.alias("j"), lag.alias("lag"), (F.col("lr") / F.col("n")).alias("value"))


def peak_lag(lagged: DataFrame, keys: Keys = (), step: float = 1.0, longest: float | None = None) -> DataFrame:
    """(keys, i, j, lag, peak): the vertex of the parabola through the largest magnitude and its neighbours.

    Null where the largest stands at an end; lag is also null beyond `longest`. Ties go to the smaller lag.
    """
    by = Window.partitionBy(*keys, "i", "j").orderBy("lag")
    near = lagged.select(*keys, "i", "j", "lag", "value", F.lag("value").over(by).alias("before"), F.lead("value").over(by).alias("after"))
    best = near.groupBy(*keys, "i", "j").agg(F.max_by(F.struct("lag", "value", "before", "after"), F.struct(F.abs("value"), -F.col("lag"))).alias("b"))
    bend = F.col("b.before") - 2 * F.col("b.value") + F.col("b.after")
    delta = F.try_divide(F.col("b.before") - F.col("b.after"), 2 * bend)
    lag = (F.col("b.lag") + delta) * step
    kept = lag if longest is None else F.when(F.abs(lag) <= longest, lag)
    return best.select(*keys, "i", "j", kept.alias("lag"), (F.col("b.value") - (F.col("b.before") - F.col("b.after")) * delta / 4).alias("peak"))


def lag_structure(panel: DataFrame, lags: int, step: float = 1.0, longest: float | None = None, keys: Keys = ()) -> DataFrame:
    """(keys, i, j, lag, peak, zero, awtd) for i < j of each session.

    lag and peak are peak_lag's, of the demeaned channels' covariance; zero is the Fisher z
    of the correlation at lag 0, and awtd is lag times peak. zero and awtd are null where
    the lag is; a correlation of 1 counts as the largest below.
    """
    centred = demeaned(panel, keys)
    lagged = written(lagged_covariance(centred, lags, keys))
    spread = centred.groupBy(*keys, "channel").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("sd"))
    of = lambda name: spread.select(*keys, F.col("channel").alias(name), F.col("sd").alias(f"_{name}"))
    now = lagged.where("lag = 0").select(*keys, "i", "j", F.col("value").alias("_c")).join(of("i"), [*keys, "i"]).join(of("j"), [*keys, "j"])
    edge = 1 - 2.0**-52
    r = F.least(F.greatest(F.try_divide(F.col("_c"), F.col("_i") * F.col("_j")), F.lit(-edge)), F.lit(edge))
    both = peak_lag(lagged, keys, step, longest).join(now, [*keys, "i", "j"])
    known = F.col("lag").isNotNull()
    return both.select(*keys, "i", "j", "lag", "peak", F.when(known, F.atanh(r)).alias("zero"), (F.col("lag") * F.col("peak")).alias("awtd"))


def mean_lag_structure(sessions: DataFrame) -> DataFrame:
    """(i, j, lag, peak, zero, awtd): means over sessions, nulls skipped, zero brought back to a correlation."""
    return sessions.groupBy("i", "j").agg(F.avg("lag").alias("lag"), F.avg("peak").alias("peak"), F.tanh(F.avg("zero")).alias("zero"), F.avg("awtd").alias("awtd"))


def local_maxima(series: DataFrame, value: str, keys: Keys = (), least: float | None = None) -> DataFrame:
    """Samples above both neighbours, a plateau counting at its first sample; ends are none."""
    steps = beside(series, value, keys, "_before", back=True).withColumn("_d", F.col(value) - F.col("_before"))
    moved = beside(steps.where("_d is null or _d <> 0"), "_d", keys, "_next")
    out = moved.where("_d > 0 and _next < 0").select(series.columns)
    return out if least is None else out.where(F.col(value) >= least)


def strided_windows(panel: DataFrame, length: int, stride: int, keys: Keys = ()) -> DataFrame:
    """The panel with `window`: each sample once for every full window of `length` starting at a multiple of `stride`. t counts from 0."""
    last = panel.groupBy(*keys).agg(F.max("t").alias("_last")) if keys else panel.agg(F.max("t").alias("_last"))
    joined = panel.join(last, list(keys)) if keys else panel.join(F.broadcast(last))
    first = F.greatest(F.ceil((F.col("t") - length + 1) / stride), F.lit(0))
    final = F.least(F.floor(F.col("t") / stride), F.floor((F.col("_last") - length + 1) / stride))
    return joined.where(first <= final).withColumn("window", F.explode(F.sequence(first, final))).drop("_last")


def lateralisation(panel: DataFrame, is_left: Column, length: int, stride: int, keys: Keys = ()) -> DataFrame:
    """(keys, channel, index): mean over windows of the correlation with the left mean less that with the right mean."""
    w = Window.partitionBy(*keys, "t")
    sides = panel.select(*keys, "channel", "t", "value", F.avg(F.when(is_left, F.col("value"))).over(w).alias("l"), F.avg(F.when(~is_left, F.col("value"))).over(w).alias("r"))
    each = strided_windows(sides, length, stride, keys).groupBy(*keys, "channel", "window").agg(
        safe_corr(F.col("value"), F.col("l")).alias("cl"), safe_corr(F.col("value"), F.col("r")).alias("cr")
    )
    return each.groupBy(*keys, "channel").agg(F.avg(F.col("cl") - F.col("cr")).alias("index"))


def framewise_displacement(motion: DataFrame, shifts: list[str], degrees: list[str], keys: Keys, radius: float = 50.0) -> DataFrame:
    """(keys, fd): mean over frames of summed absolute changes, rotations as arcs on a sphere of that radius."""
    parameters = [F.col(c) for c in shifts] + [F.radians(F.col(c)) * radius for c in degrees]
    placed = motion.select(*keys, "t", F.array(*[p.cast("double") for p in parameters]).alias("_p"))
    moved = F.aggregate(F.zip_with("_p", "_q", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, x: a + x)
    return beside(placed, "_p", keys, "_q", back=True).select(*keys, moved.alias("_fd")).groupBy(*keys).agg(F.avg("_fd").alias("fd"))


def boxcar(samples: DataFrame, events: DataFrame, keys: Keys, bin_width: float) -> DataFrame:
    """samples (keys, t) with `on`: 1 where an event (keys, onset, duration) covers t, both ends included.

    Events are cut into bins of bin_width, which both sides join on.
    """
    low, high = F.floor(F.col("onset") / bin_width), F.floor((F.col("onset") + F.col("duration")) / bin_width)
    binned = events.where("duration >= 0").withColumn("_bin", F.explode(F.sequence(low, high)))
    hit = samples.withColumn("_bin", F.floor(F.col("t") / bin_width)).join(binned, [*keys, "_bin"]).where(F.col("t").between(F.col("onset"), F.col("onset") + F.col("duration")))
    on = hit.select(*keys, "t").distinct().withColumn("on", F.lit(1))
    return samples.join(on, [*keys, "t"], "left").withColumn("on", F.coalesce("on", F.lit(0)))


def convolved(samples: DataFrame, value: str, response: Sequence[float], keys: Keys = ()) -> DataFrame:
    """samples (keys, t, value) with `response`: the sum over lags of the response at a lag times the value so many t before.

    The response is short; samples that are zero send nothing, and none is sent beyond
    the samples that there are.
    """
    weights = F.array(*[F.lit(float(w)) for w in response])
    sent = samples.where(F.col(value) != 0).select(*keys, F.col("t").alias("_at"), F.col(value).alias("_v"), F.posexplode(weights).alias("_lag", "_w"))
    sums = sent.groupBy(*keys, (F.col("_at") + F.col("_lag")).alias("t")).agg(F.sum(F.col("_v") * F.col("_w")).alias("response"))
    return samples.join(sums, [*keys, "t"], "left").withColumn("response", F.coalesce("response", F.lit(0.0)))


def task_regressor(sessions: DataFrame, events: DataFrame, keys: Keys, tr: float, response: Sequence[float], factor: int = 30) -> DataFrame:
    """(keys, n, response): the boxcar of the events on a grid of tr / factor, convolved with the response on that grid, at every tr.

    sessions: (keys, samples); events: (keys, onset, duration) in the units of tr. Grid
    points from onset to its end, both included, are on, and events that overlap count
    once. Sample n from 0 is at grid point n * factor + ceil(factor / 2) - 1. A run of
    points that are on adds a difference of two cumulated responses to the samples
    within its reach, so the fine grid itself is never made.
    """
    fine, length = tr / factor, len(response)
    total = F.array(*[F.lit(float(x)) for x in np.concatenate([[0.0], np.cumsum(response)])])
    low, high = F.greatest(F.ceil(F.col("onset") / fine - 1e-9), F.lit(0)), F.floor((F.col("onset") + F.col("duration")) / fine + 1e-9)
    spans = events.where("duration >= 0").select(*keys, low.alias("a"), high.alias("b")).where("b >= a")
    by = Window.partitionBy(*keys).orderBy("a", "b")
    reached = F.max("b").over(by.rowsBetween(Window.unboundedPreceding, -1))
    told = spans.withColumn("_new", F.coalesce((F.col("a") > reached + 1).cast("int"), F.lit(1)))
    runs = told.withColumn("_run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "_run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    offset = -(-factor // 2) - 1
    first = F.greatest(F.ceil((F.col("a") - offset) / factor), F.lit(0))
    last = F.floor((F.col("b") + length - 1 - offset) / factor)
    sent = joined(runs, sessions.select(*keys, "samples"), keys).withColumn("last", F.least(last, F.col("samples") - 1)).where(first <= F.col("last"))
    each = sent.withColumn("n", F.explode(F.sequence(first, F.col("last"))))
    at = F.col("n") * factor + offset
    clip = lambda x: F.least(F.greatest(x, F.lit(0)), F.lit(length)).cast("int")
    part = F.get(total, clip(at - F.col("a") + 1)) - F.get(total, clip(at - F.col("b")))
    sums = each.groupBy(*keys, "n").agg(F.sum(part).alias("response"))
    grid = sessions.where("samples > 0").select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("samples").cast("long") - 1)).alias("n"))
    return grid.join(sums, [*keys, "n"], "left").select(*keys, "n", F.coalesce("response", F.lit(0.0)).alias("response"))
