"""The registered model queries against numpy over the same tables."""

import numpy as np
import pandas as pd
import pytest

from undula.functions import dense
from undula.operators import patterns
from undula.plans import models

N = models.CHANNELS


@pytest.fixture(scope="module")
def series(spark, sf_dir):
    """Vectors of each label in the order of vec_id: channels by samples."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    return {k: np.array([r["embedding"] for r in rows if r["label"] == k], float).T for k in sorted({r["label"] for r in rows})}


def pair_sums(x):
    y, z = x[:, :-1], x[:, 1:]
    return y @ y.T, z @ y.T, z @ z.T


def fitted(parts):
    yy, xy, xx = (sum(m) for m in zip(*map(pair_sums, parts)))
    return dense.modes(dense.forward_backward(xy, yy, xy.T, xx)[0], models.LOW, models.HIGH)


@pytest.fixture(scope="module")
def group(series):
    return fitted(series.values())


def test_group_modes(spark, sf_dir, group):
    vectors, values = group
    got = models.group_modes(spark, sf_dir).toPandas().sort_values(["mode_idx", "channel"])
    assert len(got) == vectors.size
    assert np.allclose(got.drop_duplicates("mode_idx")["lambda_re"], values.real, atol=1e-8)
    # a vector is known up to a phase
    mine = (got["re"] + 1j * got["im"]).to_numpy().reshape(-1, N).T
    cosines = np.abs((mine.conj() * vectors).sum(0)) / np.linalg.norm(mine, axis=0) / np.linalg.norm(vectors, axis=0)
    assert np.allclose(cosines, 1, atol=1e-6)


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_group_modes_hold_no_rounding_noise(spark, sf_dir, group, partitions):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = models.group_modes(spark, sf_dir).toPandas()
        report = models.group_fit(spark, sf_dir).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert len(got) == group[0].size and np.hypot(got["lambda_re"], got["lambda_im"]).min() > 1e-6
    assert report["in_band"] == group[0].shape[1] and report["in_band"] + report["outside"] + report["noise"] == N


def test_noise_of_rounding_changes_no_mode(series):
    yy, xy, xx = (sum(m) for m in zip(*map(pair_sums, series.values())))
    rng, want = np.random.default_rng(0), fitted(series.values())[1]
    for _ in range(20):
        shaken = [m * (1 + 1e-15 * rng.standard_normal(m.shape)) for m in (xy, yy, xx)]
        got = dense.modes(dense.forward_backward(shaken[0], shaken[1], shaken[0].T, shaken[2])[0], models.LOW, models.HIGH)[1]
        assert np.allclose(got, want, atol=1e-8)


def test_subject_metrics(spark, sf_dir, series, group):
    got = models.subject_metrics(spark, sf_dir).toPandas()
    for label, x in series.items():
        yy, xy, _ = pair_sums(x)
        d = dense.refit(group[0][:, :10], yy, xy)
        mine = got[got["label"] == label].sort_values("mode_idx")
        assert np.allclose(mine["persistence"], np.abs(d), atol=1e-6) and np.allclose(mine["d_re"], d.real, atol=1e-6)


def test_mode_engagement(spark, sf_dir, series, group):
    got, v = models.mode_engagement(spark, sf_dir).toPandas(), np.linalg.pinv(group[0][:, :10])
    for label, x in series.items():
        b = np.abs(v @ x[:, :-1])
        mine = got[got["label"] == label].sort_values("mode_idx")
        assert np.allclose(mine["b_mean"], b.mean(1), atol=1e-8) and np.allclose(mine["b_var"], b.var(1, ddof=1), atol=1e-8)


def test_global_signal_coupling(spark, sf_dir, series, group):
    got, u = models.global_signal_coupling(spark, sf_dir).toPandas(), group[0][:, :10]
    for label, x in series.items():
        parts = ((np.linalg.pinv(u) @ x) * u.mean(0)[:, None]).real
        r = [np.corrcoef(x.mean(0), p)[0, 1] for p in parts]
        mine = got[got["label"] == label].sort_values("mode_idx")
        assert np.allclose(mine["r"], r, atol=1e-6) and np.allclose(mine["share"], np.abs(r) / np.abs(r).sum(), atol=1e-6)


def test_forecasts_are_of_modes_that_have_not_seen_the_label(spark, sf_dir, series):
    got = models.forecast_cv(spark, sf_dir).toPandas()
    fold = dict(got[["label", "fold"]].drop_duplicates().itertuples(index=False))
    assert set(fold) == set(series) and len(set(fold.values())) == 5
    for label, x in series.items():
        u = fitted([s for k, s in series.items() if fold[k] != fold[label]])[0]
        cut = int(np.floor(0.8 * (x.shape[1] - 1) + 0.5))
        y, z, yt, zt = x[:, :cut], x[:, 1 : cut + 1], x[:, cut:-1], x[:, cut + 1 :]
        null = ((zt - (z * y).sum() / (y * y).sum() * yt) ** 2).sum(1)
        mine = got[(got["label"] == label) & (got["model"] == "modes")].set_index("n_modes")["loss"]
        assert set(mine.index) == set(range(1, min(12, u.shape[1] // 2) + 1))
        for k in mine.index:
            w = u[:, : 2 * k]
            d, v = dense.refit(w, y @ y.T, z @ y.T), np.linalg.pinv(w)
            step = (d[0] * (np.eye(N) - w @ v) + w @ np.diag(d[1:]) @ v).real
            assert mine[k] == pytest.approx((((zt - step @ yt) ** 2).sum(1) / null).mean(), rel=1e-4)


def test_band_passed_and_resampled(spark, sf_dir, series):
    passed = models.band_passed(spark, sf_dir).where("label = 3").toPandas().pivot(index="channel", columns="t", values="value").to_numpy()
    assert np.allclose(passed, dense.band_pass(series[3], 1 / 0.72, 0.01, 0.1), atol=1e-9)
    again = models.spline_resampled(spark, sf_dir).where("label = 3").toPandas().pivot(index="channel", columns="t", values="value").to_numpy()
    at = np.arange(1, int(0.72 * series[3].shape[1] / 1.5 + 1e-9) + 1) * 1.5
    assert np.allclose(again, series[3] @ dense.spline_matrix(0.72 * np.arange(1, series[3].shape[1] + 1), at).T, atol=1e-8)


def test_reconstruction_phases_and_lags(spark, sf_dir, group):
    vectors, values = group
    got = models.mode_reconstruction(spark, sf_dir).toPandas().pivot(index="channel", columns="t", values="value").to_numpy()
    rows = models.group_modes(spark, sf_dir).toPandas().sort_values(["mode_idx", "channel"])
    mine = (rows["re"] + 1j * rows["im"]).to_numpy().reshape(-1, N).T
    want = sum((mine[:, [k]] * values[k] ** np.arange(20)).real for k in (0, 1))
    assert np.allclose(got, want, atol=1e-8)
    phase = np.angle(vectors[:, 0])
    fc = models.phase_fc(spark, sf_dir).where("mode_idx = 1").toPandas()
    assert np.allclose(fc["coupling"], np.cos(phase[fc["i"] - 1] - phase[fc["j"] - 1]), atol=1e-6)
    lag = models.mode_lag_projection(spark, sf_dir).where("mode_idx = 1").toPandas().sort_values("channel")["lag"]
    wrapped = np.angle(np.exp(1j * (phase[:, None] - phase[None])))
    assert np.allclose(lag, wrapped.sum(1) / (N - 1), atol=1e-6)


def test_feature_courses(spark, sf_dir, series):
    frames = models.mode_reconstruction(spark, sf_dir).toPandas().pivot(index="channel", columns="t", values="value").to_numpy()
    got = models.feature_time_course(spark, sf_dir).where("t = 5").toPandas().set_index("feature")["r"]
    for label, x in series.items():
        assert got[label] == pytest.approx(np.corrcoef(frames[:, 5], x.mean(1))[0, 1], abs=1e-8)


@pytest.fixture(scope="module")
def fc(series, spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    return np.corrcoef(np.array([r["embedding"] for r in rows], float).T)


def test_gradients_clusters_and_communities(spark, sf_dir, fc):
    got = np.array([list(r["score"]) for r in models.fc_gradients(spark, sf_dir).orderBy("i").collect()])
    centred = fc - fc.mean(0)
    sizes = np.linalg.svd(centred, compute_uv=False)
    assert np.allclose(np.linalg.norm(got, axis=0), sizes[: got.shape[1]], rtol=1e-6)
    named = models.network_clusters(spark, sf_dir).toPandas()
    assert sorted(named["i"]) == list(range(1, N + 1)) and named["cluster"].between(1, 7).all()
    found = models.fc_communities(spark, sf_dir).toPandas().sort_values("i")["community"].to_numpy()
    w = fc - np.eye(N)
    want = dense.leading_communities(w)
    assert all((found[i] == found[j]) == (want[i] == want[j]) for i in range(N) for j in range(i))


def as_edges(spark, w):
    i, j = np.nonzero(w)
    return spark.createDataFrame(pd.DataFrame({"i": i + 1, "j": j + 1, "r": w[i, j]}))


def test_spread_communities(spark, sf_dir, fc):
    """L-30: known graphs, and no less modularity than splits without single changes."""
    blocks = np.kron(np.eye(4), np.ones((6, 6))) - np.eye(24)
    blocks[5, 6] = blocks[6, 5] = blocks[11, 12] = blocks[12, 11] = 1
    found = patterns.spread_communities(as_edges(spark, blocks)).orderBy("i").toPandas()["community"].to_numpy()
    assert all((found[a] == found[b]) == (a // 6 == b // 6) for a in range(24) for b in range(24))
    ring = np.roll(np.eye(12), 1, 1) + np.roll(np.eye(12), -1, 1)
    found = patterns.spread_communities(as_edges(spark, ring)).orderBy("i").toPandas()["community"].to_numpy()
    assert dense.modularity(ring, found) >= dense.modularity(ring, dense.leading_communities(ring, tune=False)) - 1e-9
    w = fc - np.eye(N)
    found = models.fc_communities_spread(spark, sf_dir).orderBy("i").toPandas()
    assert found["i"].tolist() == list(range(1, N + 1))
    assert dense.modularity(w, found["community"].to_numpy()) >= dense.modularity(w, dense.leading_communities(w, tune=False)) - 1e-9


def test_spread_communities_of_odd_graphs(spark, monkeypatch):
    rows = [("a", "b", 1.0), ("c", "d", 1.0), ("e", "e", 5.0), ("a", "c", None), ("a", "b", 0.5)]
    found = {r["i"]: r["community"] for r in patterns.spread_communities(spark.createDataFrame(rows, "i string, j string, r double")).collect()}
    assert set(found) == set("abcde") and found["a"] == found["b"] != found["c"] == found["d"]
    none = spark.createDataFrame([], "i int, j int, r double")
    assert patterns.spread_communities(none).count() == 0
    flat = spark.createDataFrame([(1, 2, 0.0), (2, 3, 0.0)], "i int, j int, r double")
    assert {r["community"] for r in patterns.spread_communities(flat).collect()} == {1}
    monkeypatch.setattr(patterns, "SPREAD_NODES", 2)
    with pytest.raises(ValueError, match="3 nodes"):
        patterns.spread_communities(flat)


def test_coactivation_patterns(spark, sf_dir):
    got = models.coactivation_patterns(spark, sf_dir).collect()
    assert len(got) == 4 and all(len(r["pattern"]) == N for r in got) and all(r["n"] > 0 for r in got)


def test_linear_models(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet").toPandas()
    a, y = np.column_stack([np.ones(len(x)), x["l_quantity"], x["l_discount"]]), x["l_extendedprice"].to_numpy()
    b, _, _, _ = np.linalg.lstsq(a, y, rcond=None)
    rest, df = y - a @ b, len(y) - 3
    se = np.sqrt(rest @ rest / df * np.linalg.inv(a.T @ a)[2, 2])
    t = models.glm_contrast(spark, sf_dir).first()
    assert t["df"] == df and t["t"] == pytest.approx(b[2] / se, rel=1e-6)
    f = models.glm_f_test(spark, sf_dir).first()
    assert f["f"] == pytest.approx((((y - y.mean()) ** 2).sum() - rest @ rest) / 2 / (rest @ rest / df), rel=1e-6) and (f["df1"], f["df2"]) == (2, df)
    b, _, _, _ = np.linalg.lstsq(a[:, :2], y, rcond=None)
    got = models.covariate_residuals(spark, sf_dir).toPandas()["residual"]
    assert np.allclose(np.sort(got), np.sort(y - a[:, :2] @ b), atol=0.006)


def test_comparisons_of_forecasts(spark, sf_dir):
    got = models.forecast_comparison(spark, sf_dir).toPandas()
    assert {"modes", "persistence", "sparse", "kernel"} == set(got["model"]) and got["w"].between(0, 55).all()
    grid = models.forecast_grid(spark, sf_dir).toPandas()
    assert len(grid) == 8 and grid["loss"].notna().all()
    same = models.mode_consistency(spark, sf_dir).toPandas()
    assert len(same) == 10 and same["cosine"].between(0, 1 + 1e-9).all()
    again = models.test_retest(spark, sf_dir).toPandas()
    assert sorted(again["mode_idx"]) == [1, 3] and again["icc"].between(-1, 1).all()


def test_periods_and_cleaning(spark, sf_dir, series, group):
    got = models.mode_periods(spark, sf_dir).toPandas().sort_values("mode_idx")
    assert np.allclose(got["period"], 1.5 * 2 * np.pi / np.abs(np.angle(group[1])), rtol=1e-6) and np.allclose(got["persistence"], np.abs(group[1]), atol=1e-8)
    x = series[2]
    s = np.linspace(-1, 1, x.shape[1])
    a = np.column_stack([x.mean(0), np.ones_like(s), s, s * s])
    want = x.T - a @ np.linalg.lstsq(a, x.T, rcond=None)[0]
    clean = models.nuisance_cleaned(spark, sf_dir).where("label = 2").toPandas().pivot(index="channel", columns="t", values="value").to_numpy()
    assert np.allclose(clean, want.T, atol=1e-8)


def test_labelled_panel_sorts_no_samples(spark, sf_dir, capsys):
    panel = models.labelled_panel(spark, sf_dir)
    panel.explain()
    assert "Join" not in capsys.readouterr().out  # labels stand beside the vectors
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    assert {tuple(r) for r in panel.collect()} == {(r["label"], i + 1, r["vec_id"], float(x)) for r in vectors for i, x in enumerate(r["embedding"])}
