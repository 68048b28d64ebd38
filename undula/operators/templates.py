"""Templates of several frames: their correlation with every window of a panel, and quasi-periodic patterns.

A panel's frames are written once in tiles, each with the frames behind it that its
windows need. Every pass over the tiles takes all templates at once, in Arrow; what a
task hands on is a row for each window, or sums of the size of a template.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.operators.ordering import numbered
from undula.sources.staging import written

Keys = Sequence[str]
#: Frames of a tile; a row of a few hundred channels stays within some megabytes.
TILE = 1024


def frame_tiles(panel: DataFrame, n_channels: int, length: int, keys: Keys = ()) -> DataFrame:
    """(keys, tile, from, own, t, x): frames in order of t, channels 1..n_channels one after another in x.

    own frames of a tile stand from position `from` on; before them is the last frame of
    the tile before, behind them are the next `length`. Absent samples count as 0. The
    tiles are written to the shared folder.
    """
    cell = F.struct(F.col("channel").cast("int").alias("c"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("v"))
    frames = numbered(panel.groupBy(*keys, "t").agg(F.map_from_entries(F.collect_list(cell)).alias("m")), keys, "n")
    channels = F.sequence(F.lit(1), F.lit(n_channels))
    full = frames.select(*keys, "t", "n", F.transform(channels, lambda c: F.coalesce(F.element_at("m", c), F.lit(0.0))).alias("x"))
    tile, place = F.floor(F.col("n") / TILE), F.col("n") % TILE
    # a long template needs frames of several tiles behind
    behind = F.floor((F.col("n") - length) / TILE)
    first = F.greatest(F.when(behind < tile, behind).otherwise(tile), F.lit(0))
    copies = full.withColumn("tile", F.explode(F.sequence(first, tile + F.when(place == TILE - 1, 1).otherwise(0))))
    sorted_ = F.array_sort(F.collect_list(F.struct("n", "t", "x")))
    each = copies.groupBy(*keys, "tile").agg(sorted_.alias("f"))
    is_own = F.filter("f", lambda f: F.floor(f["n"] / TILE) == F.col("tile"))
    start = F.size(F.filter("f", lambda f: F.floor(f["n"] / TILE) < F.col("tile")))
    return written(each.select(*keys, "tile", start.alias("from"), F.size(is_own).alias("own"), F.transform("f", lambda f: f["t"].cast("long")).alias("t"), F.flatten(F.transform("f", lambda f: f["x"])).alias("x")).where("own > 0"))


def window_correlations(x: np.ndarray, templates: np.ndarray) -> np.ndarray:
    """Templates by windows: correlation of each template (frames by channels) with all windows of x, 0 where a side is constant."""
    length = templates.shape[1]
    n = len(x) - length + 1
    if n < 1:
        return np.zeros((len(templates), 0))
    size = length * x.shape[1]
    centred = templates - templates.mean((1, 2), keepdims=True)
    dots = np.zeros((len(templates), n))
    for i in range(length):
        dots += centred[:, i] @ x[i : i + n].T
    rolled = lambda v: np.convolve(v, np.ones(length), "valid")
    s, q = rolled(x.sum(1)), rolled((x * x).sum(1))
    spread = np.sqrt(np.maximum(q - s * s / size, 0))[None] * np.sqrt((centred**2).sum((1, 2)))[:, None]
    return np.divide(dots, spread, out=np.zeros_like(dots), where=spread > 1e-12 * np.maximum(q, 1e-300)[None])


def _tiles_of(batches: Iterator[pa.RecordBatch], n_channels: int) -> Iterator[tuple[dict[str, pa.Array], np.ndarray, np.ndarray, int, int]]:
    """(keys, times, frames by channels, from, own) of each tile, one after another."""
    for batch in batches:
        keys = [c for c in batch.schema.names if c not in ("tile", "from", "own", "t", "x")]
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            t, x = (row.column(c).flatten().to_numpy() for c in ("t", "x"))
            start, own = row.column("from")[0].as_py(), row.column("own")[0].as_py()
            yield {k: row.column(k) for k in keys}, t, x.reshape(-1, n_channels), start, own


def template_course(tiles: DataFrame, templates: dict[int, np.ndarray]) -> DataFrame:
    """(keys, template, t, r): correlation of every template (frames by channels, all of one shape) with the window that begins at t.

    tiles: from frame_tiles, for windows as long or longer. Windows lie within their
    keys and hold frames that follow one another in t.
    """
    names, stack = list(templates), np.stack(list(templates.values()))
    keys = [c for c in tiles.columns if c not in ("tile", "from", "own", "t", "x")]
    kinds = dict(tiles.dtypes)
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + ["template int", "t long", "r double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, t, x, start, own in _tiles_of(batches, stack.shape[2]):
            r = window_correlations(x, stack)[:, start : start + own]
            n = r.shape[1]
            columns = [*(pa.array(v.to_pylist() * r.size, v.type) for v in key.values()), pa.array(np.repeat(np.array(names, np.int32), n)), pa.array(np.tile(t[start : start + n], len(names))), pa.array(r.ravel())]
            yield from pa.Table.from_arrays(columns, names=[*keys, "template", "t", "r"]).to_batches()

    return tiles.mapInArrow(run, schema)


def peak_windows(tiles: DataFrame, templates: dict[int, np.ndarray], least: float) -> dict[int, tuple[int, float, int, np.ndarray]]:
    """{template: (peaks, summed r of all windows, windows, summed frames of the peaks)}, added up over all tiles.

    A peak is a window whose correlation is above `least`, above that of the window
    before and not below that of the next; the first and the last of a key are none.
    Tasks add up what they have, so the driver sees sums of the templates' size.
    """
    names, stack = list(templates), np.stack(list(templates.values()))
    shape = stack.shape[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((len(names), 3)), np.zeros((len(names), *shape))
        for _, _, x, start, own in _tiles_of(batches, shape[1]):
            r = window_correlations(x, stack)
            mine = r[:, start : start + own]
            counts[:, 1] += mine.sum(1)
            counts[:, 2] += mine.shape[1]
            at = np.arange(max(start, 1), min(start + own, r.shape[1] - 1))
            peak = (r[:, at] > least) & (r[:, at] > r[:, at - 1]) & (r[:, at] >= r[:, at + 1])
            counts[:, 0] += peak.sum(1)
            for k in range(len(names)):
                places = at[peak[k]]
                for i in range(shape[0]):
                    sums[k, i] += x[places + i].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(names), dtype=np.int32)), pa.array([*np.concatenate([counts, sums.reshape(len(names), -1)], 1)], pa.list_(pa.float64()))], names=["k", "sums"])

    parts = tiles.mapInArrow(run, "k int, sums array<double>").select("k", F.posexplode("sums").alias("place", "v"))
    total = parts.groupBy("k", "place").agg(F.sum("v").alias("v")).toPandas().sort_values(["k", "place"])
    out = {}
    for k, rows in total.groupby("k"):
        v = rows["v"].to_numpy()
        out[names[k]] = (int(v[0]), float(v[1]), int(v[2]), v[3:].reshape(shape))
    return out


def first_windows(tiles: DataFrame, n_channels: int, length: int, runs: int, seed: int) -> dict[int, np.ndarray]:
    """A window for each run, told by seeded hashes of the tiles: the same however rows are dealt to tasks."""
    keys = [c for c in tiles.columns if c not in ("tile", "from", "own", "t", "x")]
    windows = F.least(F.col("own"), F.size("t") - F.col("from") - length + 1)
    hashed = [F.xxhash64(*[F.col(c) for c in [*keys, "tile"]], F.lit(seed), F.lit(run)) for run in range(1, runs + 1)]
    place = lambda h: F.col("from") + F.pmod(F.xxhash64(h), windows).cast("int")
    window = lambda h: F.slice("x", place(h) * n_channels + 1, length * n_channels)
    chosen = tiles.where(windows > 0).agg(*[F.min_by(window(h), h).alias(f"w{i}") for i, h in enumerate(hashed)]).first()
    return {run: np.array(w).reshape(length, n_channels) for run, w in enumerate(chosen, 1) if w is not None}


def quasi_periodic(tiles: DataFrame, n_channels: int, length: int, runs: int = 10, most: int = 50, early: float = 0.1, late: float = 0.2, same: float = 0.9999, seed: int = 1) -> tuple[list[tuple], dict[int, np.ndarray]]:
    """(reports, templates) of quasi-periodic patterns, found from several windows at once.

    A run begins with a window drawn from the panel. In each round its template meets
    every window, and the mean of the windows at peaks above `early` (`late` from the
    third round on) is the next one, until two that follow correlate above `same`, no
    window is left, or after `most` rounds. Runs that are still open share a pass.
    A report: (run, rounds, converged, peaks of its last round, mean correlation with all windows).
    """
    open_, reports, found = first_windows(tiles, n_channels, length, runs, seed), {}, {}
    for round_ in range(1, most + 1):
        if not open_:
            break
        met = peak_windows(tiles, open_, early if round_ < 3 else late)
        for run, template in list(open_.items()):
            peaks, r, windows, sums = met[run]
            new = sums / peaks if peaks else template
            alike = float(np.corrcoef(new.ravel(), template.ravel())[0, 1]) if peaks and new.std() and template.std() else 0.0
            reports[run], found[run] = (run, round_, alike > same, peaks, r / max(windows, 1)), new
            if alike > same or not peaks:
                del open_[run]
            else:
                open_[run] = new
    return [reports[k] for k in sorted(reports)], found


def best_run(reports: list[tuple]) -> int | None:
    """The run with the largest mean correlation; of equal ones the first."""
    return max(reports, key=lambda r: (r[4], -r[0]))[0] if reports else None


def template_table(spark, template: np.ndarray) -> DataFrame:
    """(frame, channel, value), both from 1."""
    rows = [(i + 1, c + 1, float(v)) for i, frame in enumerate(template) for c, v in enumerate(frame)]
    return spark.createDataFrame(rows, "frame int, channel int, value double")
