"""Chunks, tiles and ranges: small ones give what numpy gives on whole series."""

import numpy as np
import pandas as pd
import pytest

from undula.operators import moments, ordering, panel, patterns, series, statistics


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(ordering, "TIME_CHUNK", 16)
    monkeypatch.setattr(ordering, "RANGES", 3)


@pytest.fixture
def walk():
    """Two sessions of three channels with gaps in time, repeated values and a long constant part."""
    rng, rows = np.random.default_rng(0), []
    for s in (1, 2):
        times = np.sort(rng.choice(200, 90, replace=False))
        for c in (1, 2, 3):
            x = np.round(rng.standard_normal(90).cumsum(), 1)
            x[30:60] = np.where(c == 2, 1.5, x[30:60])
            rows += [(s, c, int(t), float(v)) for t, v in zip(times, x)]
    return pd.DataFrame(rows, columns=["s", "channel", "t", "value"])


@pytest.fixture
def frame(spark, walk):
    return spark.createDataFrame(walk, "s int, channel int, t int, value double")


def wide(walk, s):
    return walk[walk.s == s].pivot(index="channel", columns="t", values="value")


def test_numbers_and_neighbours(frame, walk):
    got = ordering.beside(ordering.numbered(frame, ["s", "channel"]), "value", ["s", "channel"], "before", back=True)
    got = ordering.following(got, "value", ["s", "channel"], "after").toPandas().sort_values(["s", "channel", "t"])
    each = walk.sort_values(["s", "channel", "t"]).groupby(["s", "channel"])
    assert got["n"].tolist() == each.cumcount().tolist()
    for name, step in (("before", 1), ("after", -1)):
        assert np.allclose(got[name], each["value"].shift(step), equal_nan=True)


def plain_sliding(x, y, n):
    out = []
    for i in range(n, len(x) + 1):
        a, b = x[i - n : i], y[i - n : i]
        out.append(0.0 if a.std() * b.std() <= 1e-12 else np.cov(a, b, bias=True)[0, 1] / (a.std() * b.std()))
    return np.array(out)


def test_sliding_correlation_and_excursion(frame, walk):
    pairs = moments.channel_pairs(frame, ["s"])
    sliding = series.sliding_correlation(pairs, 7, ["s"])
    rows, excursion = sliding.toPandas(), series.excursion(sliding, ["s"]).toPandas()
    for s in (1, 2):
        x = wide(walk, s)
        for i, j in ((1, 2), (1, 3), (2, 3)):
            want = plain_sliding(x.loc[i].to_numpy(), x.loc[j].to_numpy(), 7)
            mine = rows[(rows.s == s) & (rows.i == i) & (rows.j == j)].sort_values("t")
            assert mine["t"].tolist() == x.columns[6:].tolist() and np.allclose(mine["rho"], want, atol=1e-9)
            rho = np.round(want, 9)
            sign = np.sign(np.round(rho - np.median(rho), 10))
            cuts = [0, *(np.flatnonzero(np.diff(sign)) + 1), len(rho)]
            total = sum((b - a) ** 0.9 * rho[a:b].max() for a, b in zip(cuts, cuts[1:]))
            assert excursion[(excursion.s == s) & (excursion.i == i) & (excursion.j == j)]["excursion"].iat[0] == pytest.approx(total, abs=1e-6)


def test_lagged_covariance(frame, walk):
    got = series.lagged_covariance(frame, 3, ["s"]).toPandas().set_index(["s", "i", "j", "lag"])["value"]
    x = wide(walk, 2)
    for lag in range(-3, 4):
        a, b = x.loc[1].to_numpy(), x.loc[3].to_numpy()
        want = (a[: len(a) - lag] * b[lag:]).mean() if lag >= 0 else (a[-lag:] * b[:lag]).mean()
        assert got[2, 1, 3, lag] == pytest.approx(want)


def test_local_maxima(frame, walk):
    got = series.local_maxima(frame, "value", ["s", "channel"]).toPandas()
    for (s, c), g in walk.groupby(["s", "channel"]):
        g, want = g.sort_values("t"), []
        v, t = g["value"].to_numpy(), g["t"].to_numpy()
        for i in range(1, len(v)):
            later = v[i:][v[i:] != v[i]]
            if v[i] > v[i - 1] and len(later) and later[0] < v[i]:
                want.append(t[i])
        assert sorted(got[(got.s == s) & (got.channel == c)]["t"]) == want


def test_scores_residuals_and_split(frame, walk):
    keyed = lambda df: df.toPandas().sort_values(["s", "channel", "t"])
    each = walk.sort_values(["s", "channel", "t"]).groupby(["s", "channel"])["value"]
    assert np.allclose(keyed(panel.demeaned(frame, ["s"]))["value"], each.transform(lambda v: v - v.mean()))
    assert np.allclose(keyed(panel.zscored(frame, ["s"]))["value"], each.transform(lambda v: (v - v.mean()) / v.std()))
    fit = keyed(panel.split_in_time(frame, ["s"]))
    assert fit.groupby(["s", "channel"])["is_fit"].sum().eq(72).all() and fit.groupby(["s", "channel"])["is_fit"].apply(lambda v: v.is_monotonic_decreasing).all()
    left = keyed(panel.regress_global_signal(frame, ["s"]))
    x = wide(walk, 1)
    g = x.mean().to_numpy()
    for c in (1, 2, 3):
        y = x.loc[c].to_numpy()
        slope = np.cov(y, g, bias=True)[0, 1] / g.var()
        assert np.allclose(left[(left.s == 1) & (left.channel == c)]["value"], y - y.mean() - slope * (g - g.mean()))


@pytest.fixture
def tests(spark):
    rng = np.random.default_rng(3)
    p = np.round(np.concatenate([rng.random(200), rng.random(60) ** 6]), 3)
    frame = pd.DataFrame({"k": np.arange(260) % 2, "p": p})
    return frame, spark.createDataFrame(frame, "k int, p double").unionByName(spark.createDataFrame([(0, None), (1, None)], "k int, p double"))


def test_adjusted_and_q_values(tests):
    frame, rows = tests
    for keys in ([], ["k"]):
        adjusted, q = (df.toPandas() for df in (statistics.bh_adjusted(rows, "p", keys), statistics.q_values(rows, "p", keys)))
        dependent = statistics.bh_adjusted(rows, "p", keys, dependent=True).toPandas()
        assert adjusted["adjusted"].isna().sum() == q["q"].isna().sum() == 2 and len(adjusted) == 262
        for _, g in frame.groupby(keys or (lambda _: 0)):
            mine = lambda df, c: df[df["k"].isin(g["k"].unique())].dropna().sort_values("p")[c].to_numpy()  # noqa: B023, E731
            p = np.sort(g["p"].to_numpy())
            n = len(p)
            want = np.minimum(np.minimum.accumulate((p * n / np.arange(1, n + 1))[::-1])[::-1], 1)
            assert np.allclose(mine(adjusted, "adjusted"), want)
            assert np.allclose(mine(dependent, "adjusted"), np.minimum(np.minimum.accumulate((p * n * (1 / np.arange(1, n + 1)).sum() / np.arange(1, n + 1))[::-1])[::-1], 1))
            assert np.allclose(mine(q, "q"), patterns.storey_q(p))


def test_percentiles_and_ranks(tests):
    frame, rows = tests
    got = statistics.midpoint_percentile(rows, "p", 85, ["k"]).toPandas().set_index("k")["percentile"]
    ranks = ordering.value_ranks(rows, "p", ["k"]).toPandas().set_index(["k", "p"])
    for k, g in frame.groupby("k"):
        v = np.sort(g["p"].to_numpy())
        n = len(v)
        assert got[k] == pytest.approx(np.interp(85, 100 * (np.arange(1, n + 1) - 0.5) / n, v))
        for x in np.unique(v):
            assert ranks.loc[(k, x), ["count", "below", "total"]].tolist() == [(v == x).sum(), (v < x).sum(), n]


def test_empty_tables(spark, frame):
    none = frame.where("t < 0")
    assert series.excursion(series.sliding_correlation(moments.channel_pairs(none, ["s"]), 5, ["s"]), ["s"]).count() == 0
    assert series.lagged_covariance(none, 2, ["s"]).count() == series.local_maxima(none, "value", ["s"]).count() == panel.zscored(none, ["s"]).count() == 0
    p = spark.createDataFrame([], "p double")
    assert statistics.bh_adjusted(p, "p").count() == statistics.q_values(p, "p").count() == statistics.bonferroni(p, "p").count() == 0
