"""Oscillatory modes of a linear one-step model, estimated from summed second moments."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from undula.functions.columns import safe_corr, wrap_phase
from undula.functions.dense import band_pass, forward_backward, is_noise, lasso_rows, matched_modes, modes, refit, spline
from undula.operators.moments import HELD_KEYS, key_rows
from undula.operators.ordering import following, numbered
from undula.operators.panel import folds
from undula.sources.staging import written

Keys = Sequence[str]
SAMPLES = "t long, channel int, value double"


def _matrix(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(channels, times, matrix of channels by times) of one session; absent samples are 0."""
    wide = rows.pivot_table(index="channel", columns="t", values="value", aggfunc="mean", fill_value=0.0).sort_index().sort_index(axis=1)
    return wide.index.to_numpy(), wide.columns.to_numpy(), wide.to_numpy(float)


def _long(keys: Keys, first: pd.DataFrame, channels: np.ndarray, times: np.ndarray, values: np.ndarray) -> pd.DataFrame:
    out = pd.DataFrame({"channel": np.repeat(channels, len(times)), "t": np.tile(times, len(channels)), "value": values.ravel()})
    return out.assign(**{k: first[k].iat[0] for k in keys})


def _schema(panel: DataFrame, keys: Keys, rest: str) -> str:
    kinds = dict(panel.dtypes)
    return ", ".join([f"{k} {kinds[k]}" for k in keys] + [rest])


def filtered(panel: DataFrame, keys: Keys, rate: float, low: float, high: float) -> DataFrame:
    """The panel band-passed, each channel of a session, its samples in order of t, in a task of its own."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        return rows.assign(value=band_pass(rows[["value"]].to_numpy(float).T, rate, low, high)[0])[[*keys, "channel", "t", "value"]]

    return panel.groupBy(*keys, "channel").applyInPandas(run, _schema(panel, [*keys, "channel", "t"], "value double"))


def resampled(panel: DataFrame, keys: Keys, step: float, new_step: float) -> DataFrame:
    """The panel on another grid, by not-a-knot cubic splines; sample i of a channel is at (i + 1) steps.

    Each channel of a session is solved in a task of its own, in time and memory that
    grow with its samples.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        y = rows.sort_values("t")["value"].to_numpy(float)
        end = step * len(y)
        at = np.arange(1, int(np.floor(end / new_step + 1e-9)) + 1) * new_step
        at = at[(at >= step) & (at <= end + 1e-9)]
        y = spline(step, y, at) if len(y) > 3 and step != new_step else y
        return pd.DataFrame({**{k: rows[k].iat[0] for k in keys}, "channel": rows["channel"].iat[0], "t": np.arange(len(y)), "value": y})

    return panel.groupBy(*keys, "channel").applyInPandas(run, _schema(panel, keys, "channel int, t long, value double"))


def nuisance_residual(panel: DataFrame, regressors: DataFrame, keys: Keys) -> DataFrame:
    """Residual of every channel on the session's regressors (keys, t, name, value), an intercept and a quadratic trend."""

    def run(rows: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=[*keys, "channel", "t", "value"])
        channels, times, x = _matrix(rows)
        design = other.pivot_table(index="t", columns="name", values="value").reindex(times).fillna(0.0).to_numpy(float) if len(other) else np.zeros((len(times), 0))
        s = np.linspace(-1, 1, len(times))
        a = np.column_stack([design, np.ones(len(times)), s, s * s])
        return _long(keys, rows, channels, times, x - x @ a @ np.linalg.pinv(a))[[*keys, "channel", "t", "value"]]

    return panel.groupBy(*keys).cogroup(regressors.groupBy(*keys)).applyInPandas(run, _schema(panel, keys, "channel int, t long, value double"))


def time_sums(panel: DataFrame, keys: Keys, n_channels: int, part: Callable[[np.ndarray, np.ndarray | None], np.ndarray], paired: bool) -> DataFrame:
    """(keys, sums): sums over the samples of each key of what `part` gives for some of them.

    part takes samples by channels 1..n_channels, absent ones 0, and with `paired` each
    one's next sample, the last of a key having none; it returns a flat array of sums.
    Channels of a t are gathered into one row, tasks sum the rows they have, and the
    tasks' sums are added as whole arrays: a session may be spread over any number of tasks.
    """
    frames = panel.groupBy(*keys, "t").agg(F.collect_list(F.struct(F.col("channel").cast("int").alias("c"), F.col("value").cast("double").alias("v"))).alias("now"))
    sides = ["now", "next"] if paired else ["now"]
    frames = following(frames, "now", keys, "next").where("next is not null") if paired else frames
    flat = frames.select(*keys, *[F.col(f"{side}.{f}").alias(f"{side}_{f}") for side in sides for f in "cv"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        types: list[pa.DataType] = []

        def out() -> Iterator[pa.RecordBatch]:
            for key, value in sums.items():
                yield pa.RecordBatch.from_arrays([*(pa.array([k], t) for k, t in zip(key, types)), pa.array([value], pa.list_(pa.float64()))], names=[*keys, "sums"])
            sums.clear()

        for batch in batches:
            types = [batch.column(k).type for k in keys]
            wide = []
            for side in sides:
                channel, value = batch.column(f"{side}_c"), batch.column(f"{side}_v")
                x = np.zeros((batch.num_rows, n_channels))
                x[np.repeat(np.arange(batch.num_rows), np.diff(channel.offsets.to_numpy())), channel.flatten().to_numpy() - 1] = np.nan_to_num(value.flatten().to_numpy(zero_copy_only=False))
                wide.append(x)
            for key, of in key_rows(batch, keys):
                value = part(wide[0][of], wide[1][of] if paired else None)
                sums[key] = sums[key] + value if key in sums else value
            if len(sums) > HELD_KEYS:
                yield from out()
        yield from out()

    parts = flat.mapInArrow(run, _schema(panel, keys, "sums array<double>"))
    return added(parts, keys)


#: Rows of sums of one key are first added in so many parts, then these.
ADDED_PARTS = 16


def added(parts: DataFrame, keys: Keys) -> DataFrame:
    """(keys, sums): the arrays of each key added, as streams sorted by key that hold one array at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, types, names = None, None, [], [*keys, "sums"]

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([k], t) for k, t in zip(held, types)), pa.array([total], pa.list_(pa.float64()))], names=names)

        for batch in batches:
            types = [batch.column(k).type for k in keys]
            rows = zip(*(batch.column(k).to_pylist() for k in keys)) if keys else [()] * batch.num_rows
            for key, sums in zip(rows, batch.column("sums")):
                value = sums.values.to_numpy()
                if key == held:
                    total = total + value
                else:
                    if held is not None:
                        yield out()
                    held, total = key, value.copy()
        if held is not None:
            yield out()

    def step(rows: DataFrame, *by: str) -> DataFrame:
        dealt = rows.repartition(*by) if by else rows.coalesce(1)
        return (dealt.sortWithinPartitions(*keys) if keys else dealt).mapInArrow(run, _schema(parts, keys, "sums array<double>"))

    salted = parts.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(ADDED_PARTS)))
    return step(step(salted, *keys, "_salt"), *keys)


def session_moments(panel: DataFrame, keys: Keys, n_channels: int) -> DataFrame:
    """(keys, tau, yy, xy, xx): pairs of a session and their second moments, flat arrays over channels 1..n_channels.

    One row for each session, the only size that later steps see.
    """

    def part(y: np.ndarray, x: np.ndarray | None) -> np.ndarray:
        return np.concatenate([[len(y)], (y.T @ y).ravel(), (x.T @ y).ravel(), (x.T @ x).ravel()])

    whole, size = time_sums(panel, keys, n_channels, part, True), n_channels * n_channels
    cut = lambda i, name: F.slice("sums", 2 + i * size, size).alias(name)
    return whole.select(*keys, F.col("sums")[0].cast("long").alias("tau"), cut(0, "yy"), cut(1, "xy"), cut(2, "xx"))


def summed(moments: DataFrame, keys: Keys = ()) -> DataFrame:
    """(keys, place, yy, xy, xx): the moments summed over sessions, place by place.

    Partitions sum their sessions first, some keys at a time, so the shuffle carries a
    matrix for each partition and key, not for each session.
    """
    flat = moments.select(*keys, F.concat("yy", "xy", "xx").alias("sums"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        types: list[pa.DataType] = []

        def out() -> Iterator[pa.RecordBatch]:
            for key, value in sums.items():
                yield pa.RecordBatch.from_arrays([*(pa.array([k], t) for k, t in zip(key, types)), pa.array([value], pa.list_(pa.float64()))], names=[*keys, "sums"])
            sums.clear()

        for batch in batches:
            types = [batch.column(k).type for k in keys]
            rows = zip(*(batch.column(k).to_pylist() for k in keys)) if keys else [()] * batch.num_rows
            for key, value in zip(rows, batch.column("sums")):
                value = value.values.to_numpy()
                sums[key] = sums[key] + value if key in sums else value.copy()
                if len(sums) > HELD_KEYS:
                    yield from out()
        yield from out()

    total = added(flat.mapInArrow(partial, _schema(flat, keys, "sums array<double>")), keys)
    n = F.size("sums") / 3
    third = lambda i: F.slice("sums", (i * n + 1).cast("int"), n.cast("int"))
    zipped = total.select(*keys, F.posexplode(F.arrays_zip(third(0).alias("yy"), third(1).alias("xy"), third(2).alias("xx"))).alias("place", "m"))
    return zipped.select(*keys, "place", "m.yy", "m.xy", "m.xx")


def group_operator(moments: DataFrame, n_channels: int) -> tuple[np.ndarray, float]:
    """(one-step operator, imaginary share of its root). The driver sees n_channels^2 sums, whatever the data."""
    m = summed(moments).orderBy("place").toPandas()
    yy, xy, xx = (m[c].to_numpy().reshape(n_channels, n_channels) for c in ("yy", "xy", "xx"))
    return forward_backward(xy, yy, xy.T, xx)


def fit_group(moments: DataFrame, n_channels: int, low: float, high: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(vectors, values, imaginary share) of the group's modes."""
    operator, imaginary = group_operator(moments, n_channels)
    return *modes(operator, low, high), imaginary


def fit_report(moments: DataFrame, n_channels: int, low: float, high: float) -> DataFrame:
    """One row: eigenvalues of the group's operator in the band, outside of it, and left out as rounding noise; the imaginary share of its root."""
    operator, imaginary = group_operator(moments, n_channels)
    noise = int(is_noise(np.linalg.eigvals(operator)).sum())
    kept = modes(operator, low, high)[1]
    row = (len(kept), n_channels - len(kept) - noise, noise, imaginary)
    return moments.sparkSession.createDataFrame([row], "in_band long, outside long, noise long, imaginary_share double")


def mode_table(spark, vectors: np.ndarray, values: np.ndarray) -> DataFrame:
    """(mode_idx, channel, re, im, lambda_re, lambda_im), numbered from 1; odd ones stand before their conjugates."""
    k, n = vectors.shape[1], vectors.shape[0]
    rows = pd.DataFrame({
        "mode_idx": np.repeat(np.arange(1, k + 1), n), "channel": np.tile(np.arange(1, n + 1), k), "re": vectors.T.real.ravel(), "im": vectors.T.imag.ravel(),
        "lambda_re": np.repeat(values.real, n), "lambda_im": np.repeat(values.imag, n),
    })
    return spark.createDataFrame(rows, "mode_idx int, channel int, re double, im double, lambda_re double, lambda_im double")


def subject_metrics(moments: DataFrame, keys: Keys, vectors: np.ndarray, n_channels: int) -> DataFrame:
    """(keys, mode_idx, d_re, d_im, persistence, progression): eigenvalues refitted to each key's moments; mode_idx 0 is the residual's."""
    per = summed(moments, keys)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        m = rows.sort_values("place")
        yy, xy = (m[c].to_numpy().reshape(n_channels, n_channels) for c in ("yy", "xy"))
        d = refit(vectors, yy, xy)
        return pd.DataFrame({**{k: rows[k].iat[0] for k in keys}, "mode_idx": np.arange(len(d)), "d_re": d.real, "d_im": d.imag, "persistence": np.abs(d), "progression": np.angle(d)})

    return per.groupBy(*keys).applyInPandas(run, _schema(per, keys, "mode_idx int, d_re double, d_im double, persistence double, progression double"))


def engagement(panel: DataFrame, keys: Keys, vectors: np.ndarray, n_channels: int) -> DataFrame:
    """(keys, mode_idx, b_mean, b_var): mean and variance over samples, but the last, of the magnitude of each mode's projection."""
    v, k = np.linalg.pinv(vectors), vectors.shape[1]

    def part(y: np.ndarray, x: np.ndarray | None) -> np.ndarray:
        b = np.abs(y @ v.T)
        return np.concatenate([np.full(k, len(b), float), b.sum(0), (b * b).sum(0)])

    s = _by_mode(time_sums(panel, keys, n_channels, part, True), keys, k, ("_n", "_s", "_q"))
    mean = F.col("_s") / F.col("_n")
    var = F.when(F.col("_n") > 1, F.greatest(F.col("_q") - F.col("_s") * mean, F.lit(0.0)) / (F.col("_n") - 1)).otherwise(0.0)
    return s.select(*keys, "mode_idx", mean.alias("b_mean"), var.alias("b_var"))


def _by_mode(sums: DataFrame, keys: Keys, k: int, names: tuple[str, ...]) -> DataFrame:
    """(keys, mode_idx, names): sums of k modes after one another, a row for each mode."""
    each = F.arrays_zip(*[F.slice("sums", i * k + 1, k).alias(n) for i, n in enumerate(names)])
    return sums.select(*keys, F.posexplode(each).alias("_m", "_s")).select(*keys, (F.col("_m") + 1).cast("int").alias("mode_idx"), *[F.col(f"_s.{n}").alias(n) for n in names])


def fold_modes(moments: DataFrame, unit: str, n_channels: int, low: float, high: float, n_folds: int = 5) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """((unit, fold), vectors by fold): modes fitted on the units outside each fold.

    The moments of the units of a fold are summed once; the driver sees a matrix of
    sums for each fold, and takes each from the sum of all.
    """
    dealt = folds(moments, unit, n_folds)
    m = summed(moments.join(dealt, unit), ["fold"]).toPandas()
    each = {f: {c: g.sort_values("place")[c].to_numpy().reshape(n_channels, n_channels) for c in ("yy", "xy", "xx")} for f, g in m.groupby("fold")}
    found = {}
    for f in each:
        if rest := [x for g, x in each.items() if g != f]:
            yy, xy, xx = (sum(x[c] for x in rest) for c in ("yy", "xy", "xx"))
            found[int(f)] = modes(forward_backward(xy, yy, xy.T, xx)[0], low, high)[0]
    return dealt, found


def _of_fold(parameter: float | dict[int, float], row: dict) -> float:
    return parameter[int(row["fold"])] if isinstance(parameter, dict) else parameter


#: Held-out pairs of a session that a task forecasts, earlier pairs that it compares them with, and how many of the former at a time.
AHEAD, PAST, AT_A_TIME = 4096, 32_768, 64
#: Bits of a distance that one pass over all of them settles.
MEDIAN_BITS = 21
#: (model, modes, parameter, one-step matrix).
Step = tuple[str, int, float, np.ndarray]


def _wide(batch: pa.RecordBatch | pa.Table, name: str, n_channels: int) -> np.ndarray:
    column = batch.column(name)
    return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy().reshape(-1, n_channels)


def _arrays(rows: list, kind: pa.DataType = pa.float64()) -> pa.Array:
    return pa.array(rows, pa.list_(kind))


def _split_pairs(panel: DataFrame, keys: Keys, n_channels: int) -> tuple[DataFrame, DataFrame]:
    """((_s, n, cut, size, y, x), (_s, keys, cut, size)), both written: frames of a session with the next ones, and its sessions.

    A frame is a t at which any channel has a sample; absent ones are 0, several are
    averaged. Pairs from position `cut` on are held out. _s names a session, also where a key is null.
    """
    known = panel.where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))
    cells = known.groupBy(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("_s"), *keys, "t").agg(F.collect_list(F.struct(F.col("channel").cast("int").alias("c"), F.col("value").cast("double").alias("v"))).alias("_c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            channel, value = batch.column("c"), batch.column("v").flatten().to_numpy(zero_copy_only=False)
            at = np.repeat(np.arange(batch.num_rows), np.diff(channel.offsets.to_numpy())), channel.flatten().to_numpy() - 1
            total, count = np.zeros((batch.num_rows, n_channels)), np.zeros((batch.num_rows, n_channels))
            np.add.at(total, at, value)
            np.add.at(count, at, 1.0)
            names = ["_s", *keys, "t"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), _arrays([*(total / np.maximum(count, 1))])], names=[*names, "y"])

    frames = written(cells.select("_s", *keys, "t", "_c.c", "_c.v").mapInArrow(run, "_s string, " + _schema(panel, [*keys, "t"], "y array<double>")))
    sizes = frames.groupBy("_s", *keys).agg(F.count("*").alias("size"))
    cut = F.floor(F.lit(0.8) * (F.col("size") - 1) + 0.5).cast("long")
    sessions = written(sizes.withColumn("cut", cut).where("cut >= 2 and size - 1 - cut >= 2"))
    each = following(numbered(frames.select("_s", "t", "y"), ["_s"], "n"), "y", ["_s"], "x").where("x is not null")
    return written(each.join(sessions.select("_s", "cut", "size"), "_s").select("_s", "n", "cut", "size", "y", "x")), sessions


def _fitted_steps(pairs: DataFrame, sessions: DataFrame, keys: Keys, n_channels: int, steps: Callable, widths: Callable) -> DataFrame:
    """(_s, a, mean, model, n_modes, parameter, steps, widths), written: a session's linear models, from the moments of the pairs before its cut."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, x = (_wide(batch, c, n_channels) for c in "yx")
            ahead = batch.column("n").to_numpy() >= batch.column("cut").to_numpy()
            for (s,), of in key_rows(batch, ["_s"]):
                yt, xt, out = y[of][~ahead[of]], x[of][~ahead[of]], x[of][ahead[of]]
                yield pa.RecordBatch.from_arrays([pa.array([s]), _arrays([np.concatenate([[len(out)], out.sum(0), (yt.T @ yt).ravel(), (xt.T @ yt).ravel()])])], names=["_s", "sums"])

    names = ["a", "mean", "model", "n_modes", "parameter", "steps", "widths"]

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                v = np.array(row["sums"])
                yy, xy = v[1 + n_channels :].reshape(2, n_channels, n_channels)
                a = np.trace(xy) / max(np.trace(yy), 1e-300)
                found = steps(row, a, yy, xy)
                columns = [pa.array([row["_s"]]), pa.array([float(a)]), _arrays([v[1 : 1 + n_channels] / v[0]]), _arrays([[m for m, *_ in found]], pa.string()), _arrays([[k for _, k, *_ in found]], pa.int32())]
                columns += [_arrays([[float(p) for _, _, p, _ in found]]), _arrays([np.concatenate([s.ravel() for *_, s in found])]), _arrays([[float(h) for h in widths(row)]])]
                yield pa.RecordBatch.from_arrays(columns, names=["_s", *names])

    tasks = _tasks(sessions, F.lit(1))
    whole = added(pairs.mapInArrow(sums, "_s string, sums array<double>"), ["_s"]).join(sessions, "_s").repartition(tasks, "_s")
    return written(whole.mapInArrow(fit, "_s string, a double, mean array<double>, model array<string>, n_modes array<int>, parameter array<double>, steps array<double>, widths array<double>"))


def _step_errors(pairs: DataFrame, sessions: DataFrame, fits: DataFrame, n_channels: int) -> DataFrame:
    """(_s, sums): for each channel the held-out squares about its mean, then the squared errors of each model of fits."""
    block = F.floor((F.col("n") - F.col("cut")) / AHEAD)
    last = F.floor((F.col("size") - 2 - F.col("cut")) / AHEAD)

    def run(rows: pa.Table, own: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and own.num_rows:
            y, x = (_wide(rows, c, n_channels) for c in "yx")
            mean, steps = (own.column(c)[0].values.to_numpy() for c in ("mean", "steps"))
            out = [np.concatenate([((x - mean) ** 2).sum(0), *(((x - y @ s.T) ** 2).sum(0) for s in steps.reshape(-1, n_channels, n_channels))])]
        return pa.Table.from_arrays([pa.array([rows.column("_s")[0].as_py()] if out else [], pa.string()), _arrays(out)], names=["_s", "sums"])

    held = pairs.where("n >= cut").select("_s", block.alias("block"), "y", "x")
    models = fits.join(sessions.select("_s", F.explode(F.sequence(F.lit(0), last)).alias("block")), "_s").select("_s", F.col("block").cast("long").alias("block"), "mean", "steps")
    return added(held.groupBy("_s", "block").cogroup(models.groupBy("_s", "block")).applyInArrow(run, "_s string, sums array<double>"), ["_s"])


def _tasks(sessions: DataFrame, groups: Column) -> int:
    """As many tasks as the sessions have groups, up to the session's number of shuffle partitions."""
    return max(1, min(sessions.agg(F.sum(groups)).first()[0] or 1, int(sessions.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def _met(pairs: DataFrame, tasks: int, info: DataFrame, *columns: str) -> DataFrame:
    """Held-out pairs, with what info (_s, ...) has for their session, in blocks, each once for every slab of earlier pairs, which are there once for every block."""
    names = ["_s", "block", "slab", "n", *columns]
    last, slabs = F.floor((F.col("size") - 2 - F.col("cut")) / AHEAD), F.floor((F.col("cut") - 1) / PAST)
    held = pairs.where("n >= cut").join(info, "_s").withColumn("block", F.floor((F.col("n") - F.col("cut")) / AHEAD)).withColumn("slab", F.explode(F.sequence(F.lit(0), slabs)))
    past = pairs.where("n < cut").withColumn("slab", F.floor(F.col("n") / PAST)).withColumn("block", F.explode(F.sequence(F.lit(0), last)))
    known = [c for c in info.columns if c != "_s"]
    both = held.select(*names, *known, F.lit(True).alias("ahead")).unionByName(past.select(*names, F.lit(False).alias("ahead")), allowMissingColumns=True)
    return both.repartition(tasks, "_s", "block", "slab")


def _squared_distances(y: np.ndarray, yt: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first, distances from every y) of so many rows of yt at a time."""
    own = (y * y).sum(1)[:, None]
    for i in range(0, len(yt), AT_A_TIME):
        part = yt[i : i + AT_A_TIME]
        yield i, np.maximum(own + (part * part).sum(1)[None] - 2 * y @ part.T, 0)


def _middle_distances(pairs: DataFrame, sessions: DataFrame, tasks: int, n_channels: int) -> DataFrame:
    """(_s, low, high), written: the bits of the two middle squared distances between held-out and earlier frames of a session, the same one if their number is odd.

    Bits of doubles that are not negative have their order. Tasks count distances by their
    first bits, then those that share the first bits of the middle ones by the next bits,
    so no distance is kept or sent.
    """
    size = 1 << MEDIAN_BITS
    total = F.col("cut") * (F.col("size") - 1 - F.col("cut"))
    middle = sessions.select("_s", F.explode(F.array(F.struct(F.lit(0).alias("which"), F.floor((total - 1) / 2).alias("rank")), F.struct(F.lit(1).alias("which"), F.floor(total / 2).alias("rank")))).alias("_r"))
    ranks = written(middle.select("_s", "_r.which", F.lit(0).cast("long").alias("first"), F.col("_r.rank").cast("long").alias("rank")))
    for shift in (2 * MEDIAN_BITS, MEDIAN_BITS, 0):
        firsts = ranks.groupBy("_s").agg(F.collect_set("first").alias("firsts"))

        def count(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by([("ahead", "ascending"), ("n", "ascending")])
            ahead, y = rows.column("ahead").to_numpy(), _wide(rows, "y", n_channels)
            keys_, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            if ahead.any() and not ahead.all():
                found = {first: np.zeros(size, np.int64) for first in rows.column("firsts")[rows.num_rows - 1].as_py()}
                for _, d2 in _squared_distances(y[~ahead], y[ahead]):
                    bits = d2.ravel().view(np.int64) >> shift
                    for first, held in found.items():
                        held += np.bincount(bits[bits >> MEDIAN_BITS == first] & (size - 1), minlength=size)
                for first, held in found.items():
                    keys_.append(np.flatnonzero(held) + (first << MEDIAN_BITS))
                    counts.append(held[held > 0])
            keys_, counts = np.concatenate(keys_), np.concatenate(counts)
            return pa.Table.from_arrays([pa.array([rows.column("_s")[0].as_py()] * len(keys_), pa.string()), pa.array(keys_), pa.array(counts)], names=["_s", "key", "count"])

        counted = _met(pairs, tasks, firsts, "y").groupBy("_s", "block", "slab").applyInArrow(count, "_s string, key long, count long").groupBy("_s", "key").agg(F.sum("count").alias("count"))
        by = Window.partitionBy("_s", "first").orderBy("key")  # at most 2^MEDIAN_BITS rows
        placed = counted.withColumn("first", F.shiftright("key", MEDIAN_BITS)).withColumn("before", F.sum("count").over(by) - F.col("count"))
        met = ranks.join(placed, ["_s", "first"]).where("before <= rank").groupBy("_s", "which").agg(F.max_by(F.struct("key", "before"), "key").alias("_k"))
        ranks = written(met.join(ranks, ["_s", "which"]).select("_s", "which", F.col("_k.key").alias("first"), (F.col("rank") - F.col("_k.before")).alias("rank")))
    return written(ranks.groupBy("_s").agg(F.min("first").alias("low"), F.max("first").alias("high")))


def _kernel_errors(pairs: DataFrame, sessions: DataFrame, fits: DataFrame, n_channels: int) -> DataFrame:
    """(_s, sums): for each width of fits and each channel the squared errors of the kernel model.

    Every held-out pair meets every earlier one of its session, in blocks. A slab of the
    latter gives sums under weights that are 1 at its nearest one; slabs meet there.
    """
    size = n_channels + 1
    tasks = _tasks(sessions, F.ceil((F.col("size") - 1 - F.col("cut")) / AHEAD) * F.ceil(F.col("cut") / PAST))
    info = written(fits.select("_s", "a", "widths").join(_middle_distances(pairs, sessions, tasks, n_channels), "_s"))

    def weigh(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("ahead", "ascending"), ("n", "ascending")])
        ahead, (y, x) = rows.column("ahead").to_numpy(), (_wide(rows, c, n_channels) for c in "yx")
        s, block, slab = (rows.column(c)[0].as_py() for c in ("_s", "block", "slab"))
        a, widths, low, high = (rows.column(c)[rows.num_rows - 1].as_py() for c in ("a", "widths", "low", "high"))
        middle, out = np.sqrt(np.array([low, high]).view(float)).mean(), []
        yt, xt, rest = y[ahead], x[ahead], np.column_stack([x[~ahead] - a * y[~ahead], np.ones(int((~ahead).sum()))])
        for i, d2 in _squared_distances(y[~ahead], yt):
            least, sums = d2.min(0), []
            d2 -= least
            for h in widths:
                width = max(middle * h / 50, 1e-300)
                sums.append((rest.T @ np.exp(-d2 / (2 * width * width))).ravel())
            truth = (xt[i : i + AT_A_TIME] - a * yt[i : i + AT_A_TIME]).ravel() if slab == 0 else np.empty(0)
            out.append((s, block, i // AT_A_TIME, least, np.concatenate(sums), truth, widths, float(middle)))
        cast = [pa.string(), pa.int64(), pa.int64(), *[pa.list_(pa.float64())] * 4, pa.float64()]
        return pa.Table.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(cast)], names=["_s", "block", "piece", "least", "sums", "truth", "widths", "middle"])

    def meet(rows: pa.Table) -> pa.Table:
        least = np.stack([v.values.to_numpy() for v in rows.column("least")])
        widths, middle, m = rows.column("widths")[0].as_py(), rows.column("middle")[0].as_py(), least.shape[1]
        truth = next(v.values.to_numpy() for v in rows.column("truth") if len(v)).reshape(m, n_channels)
        far, errors = least - least.min(0), []
        parts = [v.values.to_numpy().reshape(len(widths), size, m) for v in rows.column("sums")]
        for k, h in enumerate(widths):
            width = max(middle * h / 50, 1e-300)
            whole = sum(p[k] * np.exp(-f / (2 * width * width)) for p, f in zip(parts, far))
            errors.append(((truth - (whole[:-1] / whole[-1]).T) ** 2).sum(0))
        return pa.Table.from_arrays([pa.array([rows.column("_s")[0].as_py()]), _arrays([np.concatenate(errors)])], names=["_s", "sums"])

    weighed = _met(pairs, tasks, info, "y", "x").groupBy("_s", "block", "slab").applyInArrow(weigh, "_s string, block long, piece long, least array<double>, sums array<double>, truth array<double>, widths array<double>, middle double")
    return added(weighed.groupBy("_s", "block", "piece").applyInArrow(meet, "_s string, sums array<double>"), ["_s"])


def _scored(panel: DataFrame, keys: Keys, n_channels: int, steps: Callable[[dict, float, np.ndarray, np.ndarray], list[Step]], widths: Callable[[dict], Sequence[float]], with_kernel: bool, beside_null: bool = True) -> DataFrame:
    """(keys, model, n_modes, parameter, r2, loss): forecasts of a session's last fifth, fitted on what is before.

    steps: from a row of keys, the null coefficient a and the moments yy and xy, the linear
    models, the first one the null; widths: those of the kernel model. Sessions of any
    length: pairs are summed and compared in blocks. beside_null: channels that the null
    model forecasts without error are left out.
    """
    pairs, sessions = _split_pairs(panel, keys, n_channels)
    fits = _fitted_steps(pairs, sessions, keys, n_channels, steps, widths)
    linear = _step_errors(pairs, sessions, fits, n_channels)
    whole = fits.select("_s", "model", "n_modes", "parameter", "widths").join(linear, "_s").join(sessions.select("_s", *keys), "_s")
    kernel = _kernel_errors(pairs, sessions, fits, n_channels).withColumnRenamed("sums", "kernel") if with_kernel else None
    whole = whole.join(kernel, "_s") if with_kernel else whole.withColumn("kernel", F.array().cast("array<double>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sst, *errors = np.array(row["sums"] + row["kernel"]).reshape(-1, n_channels)
                ok = (sst > 0) & (errors[0] > 0) if beside_null else sst > 0
                r2 = [float((1 - e[ok] / sst[ok]).mean()) if ok.any() else 0.0 for e in errors]
                with np.errstate(divide="ignore", invalid="ignore"):
                    loss = [float((e[ok] / errors[0][ok]).mean()) if ok.any() else 0.0 for e in errors]
                k = len(row["widths"]) if with_kernel else 0
                names, n, p = row["model"] + ["kernel"] * k, row["n_modes"] + [0] * k, row["parameter"] + row["widths"][:k]
                yield pa.RecordBatch.from_arrays([*(pa.array([row[c]] * len(n), batch.column(c).type) for c in keys), pa.array(names), pa.array(n, pa.int32()), pa.array(p), pa.array(r2), pa.array(loss)], names=[*keys, "model", "n_modes", "parameter", "r2", "loss"])

    return whole.mapInArrow(run, _schema(panel, keys, "model string, n_modes int, parameter double, r2 double, loss double"))


def _sparse_steps(a: float, yy: np.ndarray, xy: np.ndarray, cut: int, weights: Sequence[float]) -> list[Step]:
    """The null model plus lasso of its residual, row by row, from the largest weight down, each from the solution before."""
    theta, out = None, []
    for weight in sorted(weights, reverse=True):
        theta = lasso_rows(yy / cut, (xy - a * yy) / cut, weight, theta)
        out.append(("sparse", 0, weight, a * np.eye(len(yy)) + theta))
    return out


def parameter_scores(panel: DataFrame, keys: Keys, n_channels: int, weights: Sequence[float], widths: Sequence[float], beside_null: bool = True) -> DataFrame:
    """(keys, model, parameter, r2, loss) of the sparse model with each weight, and the kernel model with each width."""
    steps = lambda row, a, yy, xy: [("null", 0, 0.0, a * np.eye(n_channels)), *_sparse_steps(a, yy, xy, row["cut"], weights)]
    each = _scored(panel, keys, n_channels, steps, lambda row: widths, bool(widths), beside_null)
    return each.where("model <> 'null'").select(*keys, "model", "parameter", "r2", "loss")


def parameter_curves(panel: DataFrame, keys: Keys, n_channels: int, weights: Sequence[float], widths: Sequence[float]) -> DataFrame:
    """(keys, model, parameter, r2): how well the sparse model with each weight, and the kernel model with each width, forecasts a session's last fifth."""
    return parameter_scores(panel, keys, n_channels, weights, widths, beside_null=False).select(*keys, "model", "parameter", "r2")


def chosen_parameters(curves: DataFrame, dealt: DataFrame, unit: str, first: dict[str, int] | None = None, fineness: int = 1000) -> dict[str, dict[int, float]]:
    """{model: {fold: parameter}}: for each fold the parameter of the largest mean r2 over the units outside it.

    curves: from parameter_curves, on even grids; dealt: (unit, fold). A fold's mean
    curve, without its first points where `first` says so, is followed by a spline in
    steps of the grid's step / fineness; the driver sees one curve for each fold and model.
    """
    per = curves.groupBy(unit, "model", "parameter").agg(F.avg("r2").alias("r2")).join(dealt, unit)
    other = dealt.select(F.col("fold").alias("left_out")).distinct()
    means = per.join(F.broadcast(other), F.col("fold") != F.col("left_out")).groupBy("left_out", "model", "parameter").agg(F.avg("r2").alias("r2")).toPandas()  # a row for each fold and point
    out: dict[str, dict[int, float]] = {}
    for (model, fold), curve in means.sort_values("parameter").groupby(["model", "left_out"]):
        at, y = (curve[c].to_numpy()[(first or {}).get(model, 0) :] for c in ("parameter", "r2"))
        if len(at) > 3:
            step = (at[-1] - at[0]) / (len(at) - 1)
            fine = np.linspace(at[0], at[-1], (len(at) - 1) * fineness + 1)
            at, y = fine, spline(step, y, fine - at[0] + step)
        out.setdefault(model, {})[int(fold)] = float(at[int(y.argmax())])
    return out


def mode_matches(spark, folds_: dict[int, np.ndarray], first: np.ndarray, most: int = 12) -> DataFrame:
    """(mode, fold, other, correlation, cosine) for folds fold < other: how alike what they have of a mode is.

    The first of each conjugate pair stands for it. Modes are matched one to one by their
    magnitudes (matched_modes), with the order of `first`; correlation is that of the
    magnitudes, cosine the magnitude of that of the vectors.
    """
    k = min([most, first.shape[1] // 2, *(v.shape[1] // 2 for v in folds_.values())])
    odd = {f: v[:, : 2 * k : 2] for f, v in folds_.items()}
    places = matched_modes(odd, first[:, : 2 * k : 2])
    alike = {f: v[:, places[f]] / np.linalg.norm(v[:, places[f]], axis=0) for f, v in odd.items()}
    rows = [(m + 1, f, g, float(np.corrcoef(abs(alike[f][:, m]), abs(alike[g][:, m]))[0, 1]), float(abs(np.vdot(alike[f][:, m], alike[g][:, m])))) for f in alike for g in alike if f < g for m in range(k)]
    return spark.createDataFrame(rows, "mode int, fold int, other int, correlation double, cosine double")


def forecasts(panel: DataFrame, keys: Keys, vectors: np.ndarray | dict[int, np.ndarray], n_channels: int, pairs: Sequence[int], sparse: float | dict[int, float] | None = None, kernel: float | dict[int, float] | None = None) -> DataFrame:
    """(keys, model, n_modes, r2, loss): one-step forecasts of a session's last fifth, fitted on what is before.

    vectors, sparse, kernel: the modes and parameters, or those of each `fold`, which then is one of the keys. Sessions
    may be of any length (`_scored`). model: modes (with each number of conjugate pairs), null (one coefficient),
    persistence, sparse (null plus row-wise lasso of its residual) where a weight is
    given, and kernel (null plus the residual averaged by Gaussian weights of the
    distance, the median distance times kernel / 50 wide) where a width is given. r2: mean over channels of 1 - SSE / SST about the held-out mean. loss: mean
    of SSE over the null model's.
    """

    def steps(row: dict, a: float, yy: np.ndarray, xy: np.ndarray) -> list[Step]:
        out: list[Step] = [("null", 0, 0.0, a * np.eye(n_channels)), ("persistence", 0, 0.0, np.eye(n_channels))]
        own = vectors.get(row.get("fold")) if isinstance(vectors, dict) else vectors
        for k in pairs:
            if own is None or own.shape[1] < 2 * k:
                continue
            u = own[:, : 2 * k]
            d, v = refit(u, yy, xy), np.linalg.pinv(u)
            out.append(("modes", k, 0.0, (d[0] * (np.eye(n_channels) - u @ v) + u @ np.diag(d[1:]) @ v).real))
        return out if sparse is None else out + _sparse_steps(a, yy, xy, row["cut"], [_of_fold(sparse, row)])

    widths = lambda row: [] if kernel is None else [_of_fold(kernel, row)]
    return _scored(panel, keys, n_channels, steps, widths, kernel is not None).select(*keys, "model", "n_modes", "r2", "loss")


def reconstructed(modes_: DataFrame, frames: int, steps_per_frame: float = 1.0, unit: bool = False, keys: Keys = ()) -> DataFrame:
    """(keys, channel, t, value): summed over modes of the keys Re(lambda^(t steps) phi), conjugates included; unit: lambda / |lambda|."""
    m = F.hypot("lambda_re", "lambda_im")
    size, angle = (F.lit(1.0) if unit else m), F.atan2("lambda_im", "lambda_re")
    each = modes_.select(*keys, "channel", "re", "im", size.alias("m"), angle.alias("a"), F.explode(F.sequence(F.lit(0), F.lit(frames - 1))).alias("t"))
    p = F.col("t") * steps_per_frame
    value = F.pow("m", p) * (F.col("re") * F.cos(F.col("a") * p) - F.col("im") * F.sin(F.col("a") * p))
    return each.groupBy(*keys, "channel", "t").agg(F.sum(value).alias("value"))


def phase_coupling(modes_: DataFrame) -> DataFrame:
    """(mode_idx, i, j, coupling) for i < j: cosine of the difference of phases; the lag of a mode is that difference wrapped."""
    p = modes_.select("mode_idx", "channel", F.atan2("im", "re").alias("phase"))
    cells = p.groupBy("mode_idx").agg(F.array_sort(F.collect_list(F.struct("channel", "phase"))).alias("c"))  # a row of channels
    first = cells.select("mode_idx", "c", F.posexplode("c").alias("n", "a"))
    each = first.select("mode_idx", "a", F.explode(F.slice("c", F.col("n") + 2, F.size("c"))).alias("b"))
    return each.select("mode_idx", F.col("a.channel").alias("i"), F.col("b.channel").alias("j"), F.cos(F.col("a.phase") - F.col("b.phase")).alias("coupling"))


def global_coupling(panel: DataFrame, keys: Keys, vectors: np.ndarray, n_channels: int) -> DataFrame:
    """(keys, mode_idx, r, share): correlation of the mean over channels with each mode's part of it, and |r| as a share of all modes'."""
    v, mean, k = np.linalg.pinv(vectors), vectors.mean(0), vectors.shape[1]

    def part(x: np.ndarray, _: np.ndarray | None) -> np.ndarray:
        signal, parts = x.mean(1), ((x @ v.T) * mean).real
        ones = np.ones(k)
        return np.concatenate([ones * len(x), ones * signal.sum(), ones * (signal * signal).sum(), parts.sum(0), (parts * parts).sum(0), signal @ parts])

    s = _by_mode(time_sums(panel, keys, n_channels, part, False), keys, k, ("_n", "_s", "_ss", "_p", "_pp", "_sp"))
    n = F.col("_n")
    vs, vp, c = F.col("_ss") - F.col("_s") * F.col("_s") / n, F.col("_pp") - F.col("_p") * F.col("_p") / n, F.col("_sp") - F.col("_s") * F.col("_p") / n
    r = F.when((vs > 0) & (vp > 0), c / F.sqrt(vs * vp)).otherwise(0.0)
    total = F.sum(F.abs("r")).over(Window.partitionBy(*keys))
    return s.select(*keys, "mode_idx", r.alias("r")).withColumn("share", F.abs("r") / F.greatest(total, F.lit(1e-300)))


def lag_projection(modes_: DataFrame) -> DataFrame:
    """(mode_idx, channel, lag): mean over the other channels of the wrapped phase difference."""
    p = modes_.select("mode_idx", "channel", F.atan2("im", "re").alias("phase"))
    every = p.groupBy("mode_idx").agg(F.collect_list(F.struct("channel", "phase")).alias("c"))  # a row of channels
    each = every.select("mode_idx", "c", F.explode("c").alias("a")).select("mode_idx", "a", F.explode("c").alias("b")).where("a.channel <> b.channel")
    return each.groupBy("mode_idx", F.col("a.channel").alias("channel")).agg(F.avg(wrap_phase(F.col("a.phase") - F.col("b.phase"))).alias("lag"))


def lag_agreement(modes_: DataFrame, lags: DataFrame) -> DataFrame:
    """(mode_idx, n, matrix_r, projection_r): how the phase delays of each mode's channels agree with measured lags.

    lags: (i, j, lag) for i < j, positive where j follows i; null lags take no part. A
    mode's delay of j behind i is the wrapped difference of their phases, for modes that
    turn forward. matrix_r is over the n pairs, projection_r over channels, as means over
    the channels that they make pairs with. Null where a side is constant.
    """
    phase = modes_.select("mode_idx", "channel", F.atan2("im", "re").alias("phase"))
    of = lambda name: phase.select("mode_idx", F.col("channel").alias(name), F.col("phase").alias(f"_{name}"))
    pairs = lags.where("lag is not null").select("i", "j", "lag").join(of("i"), "i").join(of("j"), ["mode_idx", "j"])
    each = pairs.select("mode_idx", "i", "j", wrap_phase(F.col("_i") - F.col("_j")).alias("delay"), "lag")
    whole = each.groupBy("mode_idx").agg(F.count("*").alias("n"), safe_corr(F.col("delay"), F.col("lag")).alias("matrix_r"))
    ends = F.explode(F.array(F.struct(F.col("j").alias("channel"), F.col("delay"), F.col("lag")), F.struct(F.col("i").alias("channel"), (-F.col("delay")).alias("delay"), (-F.col("lag")).alias("lag"))))
    channels = each.select("mode_idx", ends.alias("_e")).groupBy("mode_idx", "_e.channel").agg(F.avg("_e.delay").alias("delay"), F.avg("_e.lag").alias("lag"))
    return whole.join(channels.groupBy("mode_idx").agg(safe_corr(F.col("delay"), F.col("lag")).alias("projection_r")), "mode_idx")


def feature_course(frames: DataFrame, features: DataFrame, keys: Keys = ()) -> DataFrame:
    """(keys, t, feature, r): correlation over channels of each frame (keys, channel, t, value) with each feature (feature, channel, weight)."""
    return frames.join(features, "channel").groupBy(*keys, "t", "feature").agg(safe_corr(F.col("value"), F.col("weight")).alias("r"))
