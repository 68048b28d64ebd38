"""Second moments, correlations and what follows from them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.functions.columns import cosine, fisher_mean, safe_corr

Keys = Sequence[str]


def rows_by_time(panel: DataFrame, keys: Keys = (), value: str = "value") -> DataFrame:
    """(keys, t, cells): the channels at each t as a sorted array of (channel, value)."""
    return panel.groupBy(*keys, "t").agg(F.array_sort(F.collect_list(F.struct("channel", F.col(value).alias("value")))).alias("cells"))


def channel_pairs(panel: DataFrame, keys: Keys = (), with_self: bool = False) -> DataFrame:
    """(keys, t, i, j, vi, vj) for channels i < j (or i <= j) of one t.

    Channels of a t are gathered in an array of bounded size and paired inside the row,
    so panels are shuffled once and never joined with themselves.
    """
    cells = rows_by_time(panel, keys)
    first = cells.select(*keys, "t", "cells", F.posexplode("cells").alias("p", "a"))
    rest = F.slice("cells", F.col("p") + (1 if with_self else 2), F.size("cells"))
    return first.select(*keys, "t", "a", F.explode(rest).alias("b")).select(
        *keys, "t", F.col("a.channel").alias("i"), F.col("b.channel").alias("j"), F.col("a.value").alias("vi"), F.col("b.value").alias("vj")
    )


#: Keys whose sums a task holds at a time, each of channels by channels.
HELD_KEYS = 16


def key_rows(batch: pa.RecordBatch, keys: Keys) -> list[tuple[tuple, np.ndarray | slice]]:
    """Each key of a batch with the places of its rows, told in one pass over the rows."""
    if not keys:
        return [((), slice(None))] if batch.num_rows else []
    codes: dict[tuple, int] = {}
    of = np.fromiter((codes.setdefault(k, len(codes)) for k in zip(*(batch.column(c).to_pylist() for c in keys))), np.int64, batch.num_rows)
    order = np.argsort(of, kind="stable")
    return list(zip(codes, np.split(order, np.cumsum(np.bincount(of, minlength=len(codes)))[:-1])))


def pair_sums(samples: DataFrame, left: str, right: str, keys: Keys = (), half: bool = False) -> DataFrame:
    """(keys, i, j, n, l, r, ll, rr, lr): sums over t of left of channel i and right of channel j, and of their products.

    samples: (keys, channel, t, left, right). A pair counts the t at which both are
    known. The channels of a t are gathered into one row, and tasks sum matrix products
    of their rows, so that shuffles carry a row for each sample, and then one for each
    task, key and pair, never one for each sample and pair. half: only i < j.
    """
    kinds = {**dict(samples.dtypes), "i": dict(samples.dtypes)["channel"], "j": dict(samples.dtypes)["channel"]}
    cells = F.array_sort(F.collect_list(F.struct("channel", F.col(left).cast("double").alias("l"), F.col(right).cast("double").alias("r"))))
    gathered = samples.groupBy(*keys, "t").agg(cells.alias("c")).select(*keys, *[F.col(f"c.{n}").alias(n) for n in ("channel", "l", "r")])
    names = ["n", "l", "r", "ll", "rr", "lr"]
    schema = ", ".join([f"{k} {kinds[k]}" for k in [*keys, "i", "j"]] + [f"{n} double" for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        types: list[pa.DataType] = []

        def out() -> Iterator[pa.RecordBatch]:
            for (key, channels), m in sums.items():
                i, j = np.triu_indices(len(channels), 1) if half else (x.ravel() for x in np.indices((len(channels),) * 2))
                known = m[0][i, j] > 0
                i, j = i[known], j[known]
                each = pa.array(channels, types[-1])
                columns = [*(pa.array([k] * len(i), t) for k, t in zip(key, types)), each.take(pa.array(i)), each.take(pa.array(j)), *(pa.array(x[i, j]) for x in m)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "i", "j", *names])
            sums.clear()

        for batch in batches:
            types = [*(batch.column(k).type for k in keys), batch.column("channel").type.value_type]
            coded = batch.column("channel").flatten().dictionary_encode()
            channels = tuple(coded.dictionary.to_pylist())
            offsets = batch.column("channel").offsets.to_numpy()
            row, at = np.repeat(np.arange(batch.num_rows), np.diff(offsets)), coded.indices.to_numpy()
            x = []
            for name in ("l", "r"):
                wide = np.full((batch.num_rows, len(channels)), np.nan)
                wide[row, at] = batch.column(name).flatten().to_numpy(zero_copy_only=False)
                x += [np.nan_to_num(wide), (~np.isnan(wide)).astype(float)]
            for key, of in key_rows(batch, keys):
                lv, lk, rv, rk = (c[of] for c in x)
                m = np.stack([lk.T @ rk, lv.T @ rk, lk.T @ rv, (lv * lv).T @ rk, lk.T @ (rv * rv), lv.T @ rv])
                sums[key, channels] = sums[key, channels] + m if (key, channels) in sums else m
            if len(sums) > HELD_KEYS:
                yield from out()
        yield from out()

    parts = gathered.mapInArrow(run, schema)
    return parts.groupBy(*keys, "i", "j").agg(*[F.sum(n).alias(n) for n in names])


def gram(pairs: DataFrame, left: str, right: str, keys: Keys = ()) -> DataFrame:
    """(keys, i, j, value): sums over t of left of channel i times right of channel j.

    pairs: (keys, channel, t, left, right).
    """
    return pair_sums(pairs, left, right, keys).select(*keys, "i", "j", F.col("lr").alias("value"))


def correlation_matrix(panel: DataFrame, keys: Keys = ()) -> DataFrame:
    """(keys, i, j, r) for i < j over the t at which both have samples; null where a channel is constant.

    Channels are centred on their means over all keys first, so that sums lose no digits.
    """
    means = panel.groupBy("channel").agg(F.avg("value").alias("_m"))  # one row for each channel
    centred = panel.join(means, "channel").select(*keys, "channel", "t", (F.col("value") - F.col("_m")).alias("value"))
    s = pair_sums(centred, "value", "value", keys, half=True)
    n = F.col("n")
    vl, vr, c = F.col("ll") - F.col("l") * F.col("l") / n, F.col("rr") - F.col("r") * F.col("r") / n, F.col("lr") - F.col("l") * F.col("r") / n
    return s.select(*keys, "i", "j", F.when((vl > 1e-20 * n) & (vr > 1e-20 * n), c / F.sqrt(vl * vr)).alias("r"))


def mean_correlation(correlations: DataFrame) -> DataFrame:
    """(i, j, r): Fisher-z mean over sessions; null correlations are skipped."""
    return correlations.groupBy("i", "j").agg(fisher_mean(F.col("r")).alias("r"))


def symmetric(pairs: DataFrame, value: str = "r", diagonal: float | None = None) -> DataFrame:
    """(i, j, value) both ways round, and the diagonal if a value for it is given."""
    turned = pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), value)
    out = pairs.select("i", "j", value).unionByName(turned)
    if diagonal is None:
        return out
    nodes = out.select("i").distinct()
    return out.unionByName(nodes.select("i", F.col("i").alias("j"), F.lit(diagonal).alias(value)))


def seed_mean(matrix: DataFrame, seeds: list, value: str = "r") -> DataFrame:
    """(i, value): mean of the columns of the seed channels, for every channel i."""
    return matrix.where(F.col("j").isin(*seeds)).groupBy("i").agg(F.avg(value).alias(value))


def weighted_mean(rows: DataFrame, value: str, weight: str, keys: Keys) -> DataFrame:
    w = F.when(F.col(value).isNotNull(), F.col(weight))
    return rows.groupBy(*keys).agg(F.try_divide(F.sum(F.col(value) * w), F.sum(w)).alias(value))


def mean_of_means(rows: DataFrame, value: str, inner: Keys, outer: Keys) -> DataFrame:
    """Mean over outer groups of the means of inner groups."""
    return rows.groupBy(*outer, *inner).agg(F.avg(value).alias(value)).groupBy(*outer).agg(F.avg(value).alias(value))


def share_of_total(rows: DataFrame, value: str, keys: Keys) -> DataFrame:
    """The value as a share of its group's sum; null where that is zero."""
    totals = rows.groupBy(*keys).agg(F.sum(value).alias("_total"))
    return rows.join(totals, list(keys)).withColumn("share", F.try_divide(F.col(value), F.col("_total"))).drop("_total")


def ar1(pairs: DataFrame, keys: Keys = ()) -> DataFrame:
    """(keys, a): one coefficient for all channels, the least-squares slope of x on y without intercept."""
    return pairs.groupBy(*keys).agg(F.try_divide(F.sum(F.col("x") * F.col("y")), F.sum(F.col("y") * F.col("y"))).alias("a"))


def forecast_scores(pairs: DataFrame, forecast: Column, keys: Keys = ()) -> DataFrame:
    """(keys, r2, sse): mean over channels of 1 - SSE / SST about the channel's own mean, and the summed SSE.

    SST is by moments about the mean (a population variance times n), in one pass.
    """
    each = pairs.groupBy(*keys, "channel").agg(
        F.sum(F.pow(F.col("x") - forecast, F.lit(2.0))).alias("sse"), (F.var_pop("x") * F.count("x")).alias("sst")
    )
    return each.groupBy(*keys).agg(F.avg(1 - F.try_divide(F.col("sse"), F.col("sst"))).alias("r2"), F.sum("sse").alias("sse"))


def cosine_by(rows: DataFrame, x: str, y: str, keys: Keys) -> DataFrame:
    return rows.groupBy(*keys).agg(cosine(F.col(x), F.col(y)).alias("cosine"))


def nmi(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row: normalised mutual information in bits, sqrt(MI/Hx * MI/Hy), not below 0; null if a side is constant.

    Rows with a null on either side don't count.
    """
    cells = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("_all"))

    def entropy(of: DataFrame, name: str) -> DataFrame:
        p = F.col("n") / F.col("_all")
        return of.join(F.broadcast(total)).agg((-F.sum(p * F.log2(p))).alias(name))

    hx = entropy(cells.groupBy("x").agg(F.sum("n").alias("n")), "hx")
    hy = entropy(cells.groupBy("y").agg(F.sum("n").alias("n")), "hy")
    each = hx.join(F.broadcast(hy)).join(F.broadcast(entropy(cells, "hxy")))
    mi = F.greatest(F.col("hx") + F.col("hy") - F.col("hxy"), F.lit(0.0))
    return each.select(F.when((F.col("hx") > 0) & (F.col("hy") > 0), F.sqrt(mi / F.col("hx") * mi / F.col("hy"))).alias("nmi"))
