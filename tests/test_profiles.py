"""Profile queries against numpy: gradients, clusters, patterns, regressors, filters."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from undula.functions import dense
from undula.operators import modes, ordering, patterns, series
from undula.plans import models, profiles
from undula.sources.tables import hourly_panel

N = models.CHANNELS


@pytest.fixture(scope="module")
def by_label(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    return {k: np.array([r["embedding"] for r in rows if r["label"] == k], float).T for k in sorted({r["label"] for r in rows})}


@pytest.fixture(scope="module")
def group_fc(by_label):
    z = np.mean([np.arctanh(np.where(np.eye(N) > 0, 0, np.corrcoef(x))) for x in by_label.values()], 0)
    return np.tanh(z) + np.eye(N)


def fixed(scores, loadings):
    return scores * np.sign(loadings[np.abs(loadings).argmax(0), np.arange(loadings.shape[1])])


def plain_gradients(m, k=5):
    c = m - m.mean(0)
    _, _, v = np.linalg.svd(c, full_matrices=False)
    return fixed(c @ v[:k].T, v[:k].T)


def test_filters_keep_the_band_and_drop_the_rest(spark):
    """L-01: sinusoids inside the band stay, slower and faster ones go; nothing is shifted."""
    t = np.arange(600)
    waves = {1: 0.004, 2: 0.05, 3: 0.3}
    rows = pd.DataFrame([("x", str(c), int(i), float(v)) for c, f in waves.items() for i, v in zip(t, np.sin(2 * np.pi * f * 0.72 * t))], columns=["s", "channel", "t", "value"])
    got = modes.filtered(spark.createDataFrame(rows), ["s"], 1 / 0.72, 0.01, 0.1).toPandas().pivot(index="channel", columns="t", values="value").to_numpy()
    middle = slice(100, 500)
    assert np.abs(got[0, middle]).max() < 0.1 and np.abs(got[2, middle]).max() < 0.05
    assert np.allclose(got[1, middle], np.sin(2 * np.pi * 0.05 * 0.72 * t)[middle], atol=0.05)


def test_dfc_of_what_is_fast(spark, sf_dir):
    from undula.sources.tables import hourly_panel

    x = hourly_panel(spark, sf_dir).toPandas().pivot(index="channel", columns="t", values="value")
    y = dense.band_pass(x.to_numpy(), 1 / 0.72, 1 / (0.72 * 30), 0.5 / 0.72)
    got = profiles.dfc_std_highpassed(spark, sf_dir).toPandas().set_index(["i", "j"])["dfc_std"]
    names = list(x.index)
    for a in range(3):
        rho = [np.corrcoef(y[a, i : i + 30], y[4, i : i + 30])[0, 1] for i in range(y.shape[1] - 29)]
        assert got[names[a], names[4]] == pytest.approx(np.std(rho), abs=1e-6)
    assert len(got) == 10


def test_sparse_gradients(spark, sf_dir, group_fc):
    got = np.array([list(r["score"]) for r in profiles.fc_gradients_sparse(spark, sf_dir).orderBy("i").collect()])
    size = np.sort(np.abs(group_fc).ravel())[::-1]
    limit = size[int(np.ceil(len(size) * 0.2)) - 1]
    m = np.where(np.abs(group_fc) > limit + 1e-9, group_fc, 0)
    # of equal magnitudes at the limit some may stay
    if np.isclose(size, limit).sum() <= 2:
        want = plain_gradients(m)
        assert np.allclose(np.abs(np.linalg.norm(got, axis=0)), np.linalg.norm(want, axis=0), rtol=0.02)
    assert got.shape == (N, 5) and np.allclose(got.mean(0), 0, atol=1e-8)


def test_area_gradients_and_courses(spark, sf_dir, group_fc):
    got = profiles.area_gradients(spark, sf_dir).toPandas()
    course = profiles.area_time_course(spark, sf_dir).toPandas().set_index(["area", "t"])["r"]
    frames = models.mode_reconstruction(spark, sf_dir).toPandas().pivot(index="channel", columns="t", values="value").to_numpy()
    for area in range(1, 7):
        own = np.arange(8 * (area - 1), 8 * area)
        s = np.corrcoef(np.delete(group_fc[own], own, 1))
        want = plain_gradients(s)
        mine = got[got["area"] == area].pivot(index="i", columns="component", values="score").to_numpy()
        assert np.allclose(mine[:, :3], want[:, :3], atol=1e-6)
        assert course[area, 4] == pytest.approx(np.corrcoef(frames[own, 4], mine[:, 0])[0, 1], abs=1e-8)


def cost(x, labels):
    return sum(((x[labels == c] - x[labels == c].mean(0)) ** 2).sum() for c in np.unique(labels))


def plain_kmeans(x, k, runs=20):
    rng, best = np.random.default_rng(0), np.inf
    for _ in range(runs):
        centres = x[rng.choice(len(x), k, replace=False)]
        for _ in range(100):
            labels = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            centres = np.array([x[labels == c].mean(0) if (labels == c).any() else centres[c] for c in range(k)])
        best = min(best, cost(x, labels))
    return best


@pytest.mark.parametrize("name, k", [("network_clusters", 7), ("network_clusters_17", 17), ("network_clusters_gsr", 7)])
def test_clusters_are_as_tight_as_plain_ones(spark, sf_dir, by_label, name, k):
    """Every row is nearest to its own cluster's mean, and the cost is that of a plain search, about."""
    if name == "network_clusters_gsr":
        fc = []
        for x in by_label.values():
            g = x.mean(0) - x.mean()
            y = x - x.mean(1, keepdims=True)
            fc.append(np.arctanh(np.where(np.eye(N) > 0, 0, np.corrcoef(y - np.outer(y @ g / (g @ g), g)))))
        m = np.tanh(np.mean(fc, 0)) + np.eye(N)
        x = (m - m.mean(1, keepdims=True)) / m.std(1, ddof=1, keepdims=True)
        got = profiles.network_clusters_gsr(spark, sf_dir)
    else:
        x = np.corrcoef(np.concatenate(list(by_label.values()), 1))
        got = models.QUERIES[name](spark, sf_dir)
    labels = got.toPandas().sort_values("i")["cluster"].to_numpy()
    assert len(labels) == N and set(labels) <= set(range(1, k + 1))
    centres = np.array([x[labels == c].mean(0) for c in np.unique(labels)])
    assert (np.unique(labels)[((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)] == labels).all()
    assert cost(x, labels) <= 1.05 * plain_kmeans(x, k)


def test_coactivation_frames_and_profiles(spark, sf_dir, by_label):
    frames, loadings = patterns.coactivation_frames(models.labelled_panel(spark, sf_dir), [3, 35], ["label"])
    rows = frames.toPandas().sort_values(["label", "t"])
    picked = []
    for k, x in by_label.items():
        z = (x - x.mean(1, keepdims=True)) / x.std(1, ddof=1, keepdims=True)
        seed, n = z[[2, 34]].mean(0), x.shape[1]
        limit = np.interp(85, 100 * (np.arange(1, n + 1) - 0.5) / n, np.sort(seed))
        picked.append(z[:, seed > limit].T)
    z = np.concatenate(picked)
    assert len(rows) == len(z)
    c = z - z.mean(0)
    values = np.linalg.eigvalsh(np.cov(c.T, bias=True))[::-1]
    k = int(np.flatnonzero(np.cumsum(values) / values.sum() >= 0.999)[0]) + 1
    assert loadings.shape == (N, k) and np.allclose(loadings.T @ loadings, np.eye(k), atol=1e-8)
    scores = np.stack(rows["scores"])
    assert np.allclose(np.sort((scores**2).sum(0))[::-1], np.sort(((c @ loadings) ** 2).sum(0))[::-1]) and np.allclose(scores.mean(0), 0, atol=1e-8)
    labels = rows["cluster"].to_numpy()
    means = np.array([scores[labels == g].mean(0) for g in np.unique(labels)])
    assert len(means) == 8 and (((scores[:, None] - means[None]) ** 2).sum(2).argmin(1) == np.searchsorted(np.unique(labels), labels)).mean() > 0.97
    assert cost(scores, labels) <= 1.1 * plain_kmeans(scores, 8, 10)
    got = {r["cluster"]: r for r in patterns.coactivation_profiles(frames, loadings).collect()}
    for g in np.unique(labels):
        assert got[g]["n"] == (labels == g).sum() and np.allclose(got[g]["pattern"], loadings @ scores[labels == g].mean(0))
    query = profiles.coactivation_profiles(spark, sf_dir).toPandas()
    assert query["n"].sum() == len(z)


def test_first_components_of_few(spark):
    x = np.outer(np.arange(20.0), [1, 2, 0]) + np.random.default_rng(0).standard_normal((20, 3)) * 0.01
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").select("id", array_to_vector("v").alias("row"))
    scored, loadings = patterns.first_components(rows, 0.99)
    assert loadings.shape == (3, 1) and np.allclose(loadings[:, 0], np.array([1, 2, 0]) / np.sqrt(5), atol=0.01)
    assert np.allclose([r["scores"][0] for r in scored.orderBy("id").collect()], (x - x.mean(0)) @ loadings[:, 0])


def plain_regressor(onsets, samples, tr, factor, response):
    t = np.arange(0, samples * tr + tr / factor / 2, tr / factor)
    on = np.zeros(len(t))
    for a, w in onsets:
        on[(a <= t + 1e-9) & (t <= a + w + 1e-9)] = 1
    return np.convolve(on, response)[-(-factor // 2) - 1 :: factor][:samples]


def test_task_regressor(spark):
    response = dense.hrf(0.72 / 30)
    events = {1: [(3.0, 5.0), (6.0, 1.0), (8.0, 4.0), (40.0, 0.0)], 2: [(0.0, 100.0)], 3: []}
    sessions = spark.createDataFrame([(1, 60), (2, 50), (3, 10)], "k int, samples int")
    rows = spark.createDataFrame([(k, *e) for k, each in events.items() for e in each] + [(1, 5.0, -1.0)], "k int, onset double, duration double")
    got = series.task_regressor(sessions, rows, ["k"], 0.72, response).toPandas()
    for k, n in ((1, 60), (2, 50), (3, 10)):
        mine = got[got["k"] == k].sort_values("n")
        assert mine["n"].tolist() == list(range(n)) and np.allclose(mine["response"], plain_regressor(events[k], n, 0.72, 30, response), atol=1e-9)


def test_task_regressor_query(spark, sf_dir):
    got = profiles.task_regressor(spark, sf_dir).toPandas()
    e = spark.read.parquet(f"{sf_dir}/events.parquet").toPandas()
    e["hours"] = (e["ts"] - pd.Timestamp("2024-01-01")).dt.total_seconds().astype(int) / 3600
    for user in sorted(e["user_id"].unique())[:3]:
        own = e[(e["user_id"] == user) & (e["event_type"] == e["event_type"].min())]
        want = plain_regressor([(h, 6.0) for h in own["hours"]], 720, 1.0, 30, dense.hrf(1 / 30))
        assert np.allclose(got[got["user_id"] == user].sort_values("n")["response"], want, atol=1e-9)


def test_nuisance_motion(spark, sf_dir, by_label):
    clean = profiles.nuisance_motion(spark, sf_dir).where("label = 3").toPandas().pivot(index="channel", columns="t", values="value").to_numpy()
    x = by_label[3]
    s = np.arange(x.shape[1])
    a = np.column_stack([x[:6].T, x[:6].T ** 2, np.ones_like(s), s, s * s])
    assert np.allclose(clean, (x[6:].T - a @ np.linalg.pinv(a) @ x[6:].T).T, atol=1e-7)


def test_lag_structure_of_known_delays(spark):
    t = np.arange(300)
    rows = [(1, c, int(i), float(np.sin(2 * np.pi * (i - d) / 25))) for c, d in ((1, 0), (2, 2)) for i in t] + [(2, 1, int(i), 1.0) for i in t] + [(2, 2, int(i), float(i % 7)) for i in t]
    got = series.lag_structure(spark.createDataFrame(rows, "s int, channel int, t int, value double"), 6, longest=4.0, keys=["s"]).toPandas().set_index("s")
    assert got.loc[1, "lag"] == pytest.approx(2, abs=0.1) and np.tanh(got.loc[1, "zero"]) == pytest.approx(np.cos(2 * np.pi * 2 / 25), abs=0.02)
    assert got.loc[1, "awtd"] == pytest.approx(got.loc[1, "lag"] * got.loc[1, "peak"])
    assert series.mean_lag_structure(series.lag_structure(spark.createDataFrame(rows, "s int, channel int, t int, value double").where(F.col("s") == 1), 6, keys=["s"])).count() == 1


def test_framed_covariance_equals_the_pairwise_one(spark, sf_dir):
    panel = hourly_panel(spark, sf_dir).withColumn("s", F.floor(F.col("t") / 180))
    want, got = (f(panel, 6, ["s"]).toPandas().set_index(["s", "i", "j", "lag"])["value"].sort_index() for f in (series.lagged_covariance, series.framed_covariance))
    assert got.index.equals(want.index) and np.allclose(got, want)


def test_framed_covariance_of_missing_samples(spark):
    rows = [(1, 0, 1.0), (2, 0, 3.0), (1, 5, 2.0), (2, 5, None), (1, 9, 4.0), (2, 9, 5.0)]
    got = series.framed_covariance(spark.createDataFrame(rows, "channel int, t int, value double"), 2).toPandas().set_index("lag")["value"].to_dict()
    assert got == {0: (1 * 3 + 4 * 5) / 2, 1: 2 * 5, 2: 1 * 5, -1: 2 * 3, -2: 4 * 3}
    assert series.framed_covariance(spark.createDataFrame([], "channel int, t int, value double"), 2).count() == 0


def test_framed_covariance_across_tiles(spark, monkeypatch):
    monkeypatch.setattr(ordering, "TIME_CHUNK", 16)
    rng = np.random.default_rng(3)
    x = np.where(rng.random((3, 70)) < 0.1, np.nan, rng.standard_normal((3, 70)))
    rows = [(s, f"c{c}", 10 * t, float(v)) for s in (0, 1) for c in range(3) for t, v in enumerate(x[c] * (s + 1))]
    got = series.framed_covariance(spark.createDataFrame(rows, "s int, channel string, t int, value double"), 3, ["s"]).toPandas().set_index(["s", "i", "j", "lag"])["value"]
    want = {(s, f"c{i}", f"c{j}", k): (s + 1) ** 2 * np.nanmean(x[i, max(0, -k) : 70 - max(0, k)] * x[j, max(0, k) : 70 - max(0, -k)]) for s in (0, 1) for i in range(3) for j in range(i + 1, 3) for k in range(-3, 4)}
    assert len(got) == len(want) and all(np.isclose(got[k], v) for k, v in want.items())


def test_framed_covariance_makes_no_row_for_each_lag(spark, capsys):
    panel = spark.range(3000).select((F.col("id") % 3).alias("channel"), F.floor(F.col("id") / 3).alias("t"), F.rand(1).alias("value"))
    plans = []
    for lags in (1, 6):
        series.framed_covariance(panel, lags).explain()
        plans.append(capsys.readouterr().out)
    assert all("Union" not in p and "sequence(" not in p and p.count("Generate explode") == 1 for p in plans)  # frames are copied to tiles, samples to no lags


def test_mode_lag_agreement(spark, sf_dir, by_label):
    each = []
    for x in by_label.values():
        x = x - x.mean(1, keepdims=True)
        n = x.shape[1]
        cov = np.stack([(x[:, max(0, -k) : n - max(0, k)] @ x[:, max(0, k) : n - max(0, -k)].T) / (n - abs(k)) for k in range(-6, 7)])
        at = np.abs(cov).argmax(0)
        inner = (at > 0) & (at < 12)
        a, b, c = (np.take_along_axis(cov, np.clip(at + s, 0, 12)[None], 0)[0] for s in (-1, 0, 1))
        lag = (at - 6 + (a - c) / (2 * (a - 2 * b + c))) * 0.72
        each.append(np.where(inner & (np.abs(lag) <= 4), lag, np.nan))
    upper = np.triu_indices(len(each[0]), 1)
    mean = np.nanmean(each, axis=0)
    lags = profiles.group_lags(spark, sf_dir).toPandas().sort_values(["i", "j"])
    assert np.allclose(lags["lag"], mean[upper], atol=1e-6)
    rows = models.group_modes(spark, sf_dir).where("mode_idx = 3").toPandas().sort_values("channel")
    phase = np.arctan2(rows["im"], rows["re"]).to_numpy()
    delay = np.angle(np.exp(1j * (phase[:, None] - phase[None])))
    got = profiles.mode_lag_agreement(spark, sf_dir).where("mode_idx = 3").first()
    assert got["n"] == len(upper[0]) and got["matrix_r"] == pytest.approx(np.corrcoef(delay[upper], mean[upper])[0, 1], abs=1e-6)
    m = np.triu(mean, 1)
    assert got["projection_r"] == pytest.approx(np.corrcoef(delay.sum(0), (m - m.T).sum(0))[0, 1], abs=1e-6)


def test_lag_agreement_of_a_travelling_wave(spark):
    modes_ = spark.createDataFrame([(1, c, float(np.cos(-0.4 * c)), float(np.sin(-0.4 * c))) for c in range(1, 6)], "mode_idx int, channel int, re double, im double")
    lags = spark.createDataFrame([(i, j, float(j - i)) for i in range(1, 6) for j in range(i + 1, 6)] + [(1, 9, None)], "i int, j int, lag double")
    got = modes.lag_agreement(modes_, lags).first()
    assert got["n"] == 10 and got["matrix_r"] == pytest.approx(1) and got["projection_r"] == pytest.approx(1)
