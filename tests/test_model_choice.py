"""Parameter choice, mode matching, retest, reconstructions and p-values against numpy."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from undula.functions import dense
from undula.operators import modes as O
from undula.operators import statistics as T
from undula.plans import models

N = models.CHANNELS


@pytest.fixture(scope="module")
def series(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    return {k: np.array([r["embedding"] for r in rows if r["label"] == k], float).T for k in sorted({r["label"] for r in rows})}


@pytest.fixture(scope="module")
def chosen(spark, sf_dir):
    return models.forecast_chosen(spark, sf_dir).toPandas()


@pytest.fixture(scope="module")
def choice(spark, sf_dir):
    return models.forecast_choice(spark, sf_dir).toPandas()


def moments(x):
    y, z = x[:, :-1], x[:, 1:]
    return y @ y.T, z @ y.T, z @ z.T


def fitted(parts):
    yy, xy, xx = (sum(m) for m in zip(*map(moments, parts)))
    return dense.modes(dense.forward_backward(xy, yy, xy.T, xx)[0], models.LOW, models.HIGH)


def test_lasso_rows():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((40, 6))
    c = rng.standard_normal((3, 6)) @ (a.T @ a / 40)
    b = dense.lasso_rows(a.T @ a / 40, c, 0.05)
    slope = b @ (a.T @ a / 40) - c
    # the conditions of the minimum
    assert np.allclose(slope[b != 0], -0.05 * np.sign(b[b != 0]), atol=1e-8) and (np.abs(slope[b == 0]) <= 0.05 + 1e-8).all()
    assert np.allclose(dense.lasso_rows(a.T @ a / 40, c, 0.05, start=b + 1), b, atol=1e-8) and np.allclose(dense.lasso(a.T @ a / 40, c[1], 0.05), b[1])
    with pytest.raises(RuntimeError):
        dense.lasso_rows(a.T @ a / 40, c, 0.0001, rounds=1)


def plain_curve(x):
    """{(model, parameter): r2} of one session."""
    cut = int(np.floor(0.8 * (x.shape[1] - 1) + 0.5))
    y, z, yt, zt = x[:, :cut], x[:, 1 : cut + 1], x[:, cut:-1], x[:, cut + 1 :]
    a = (z * y).sum() / (y * y).sum()
    sst = ((zt - zt.mean(1, keepdims=True)) ** 2).sum(1)
    r2 = lambda f: (1 - ((zt - f) ** 2).sum(1) / sst).mean()
    out = {}
    for w in models.WEIGHTS:
        theta = np.stack([dense.lasso(y @ y.T / cut, y @ row / cut, w) for row in z - a * y])
        out["sparse", w] = r2(a * yt + theta @ yt)
    d = np.sqrt(((y[:, :, None] - yt[:, None, :]) ** 2).sum(0))
    for h in models.WIDTHS:
        w = np.exp(-(d**2) / (2 * (np.median(d) * h / 50) ** 2))
        w = np.where(w.sum(0) > 1e-290, w, np.exp(-(d**2 - (d**2).min(0)) / (2 * (np.median(d) * h / 50) ** 2)))
        out["kernel", float(h)] = r2(a * yt + (z - a * y) @ (w / w.sum(0)))
    return out


def test_choice_sees_the_other_labels_only(spark, sf_dir, series, chosen, choice):
    got, dealt = choice, chosen[["fold", "label"]].drop_duplicates()
    fold = dict(zip(dealt["label"], dealt["fold"]))
    curves = {k: plain_curve(x) for k, x in series.items()}
    for _, row in got.iterrows():
        grid = list(models.WEIGHTS)[1:] if row["model"] == "sparse" else [float(h) for h in models.WIDTHS]
        mean = np.array([np.mean([curves[k][row["model"], p] for k in series if fold[k] != row["fold"]]) for p in grid])
        t = np.arange(1, len(grid) + 1.0)
        fine = np.linspace(1, len(grid), (len(grid) - 1) * 1000 + 1)
        best = fine[(dense.spline_matrix(t, fine) @ mean).argmax()]
        assert row["parameter"] == pytest.approx(grid[0] + (best - 1) * (grid[1] - grid[0]), abs=(grid[1] - grid[0]) / 500)
    assert len(got) == 10
    # a label's own rows don't move its fold's choice
    panel = models.labelled_panel(spark, sf_dir)
    one = next(iter(series))
    shaken = panel.withColumn("value", F.when(F.col("label") == one, F.col("value") * F.sin(F.col("t") * F.col("channel"))).otherwise(F.col("value")))
    again = O.chosen_parameters(O.parameter_curves(shaken, ["label"], N, models.WEIGHTS, models.WIDTHS), spark.createDataFrame(dealt), "label", {"sparse": 1})
    for model in ("sparse", "kernel"):
        assert again[model][fold[one]] == pytest.approx(got[(got["model"] == model) & (got["fold"] == fold[one])]["parameter"].iat[0], rel=1e-9)


def test_chosen_forecasts_and_their_tests(spark, sf_dir, series, chosen, choice):
    choice, got = choice.set_index(["model", "fold"])["parameter"], chosen
    for label, x in list(series.items())[:3]:
        mine = got[got["label"] == label].set_index(["model", "n_modes"])
        cut = int(np.floor(0.8 * (x.shape[1] - 1) + 0.5))
        y, z, yt, zt = x[:, :cut], x[:, 1 : cut + 1], x[:, cut:-1], x[:, cut + 1 :]
        a = (z * y).sum() / (y * y).sum()
        theta = np.stack([dense.lasso(y @ y.T / cut, y @ row / cut, choice["sparse", mine["fold"].iat[0]]) for row in z - a * y])
        sst = ((zt - zt.mean(1, keepdims=True)) ** 2).sum(1)
        assert mine.loc[("sparse", 0)]["r2"] == pytest.approx((1 - ((zt - a * yt - theta @ yt) ** 2).sum(1) / sst).mean(), abs=1e-8)
    tests = models.forecast_tests(spark, sf_dir).toPandas()
    r2 = {(m, k): g.set_index("label")["r2"] for (m, k), g in got.groupby(["model", "n_modes"])}
    for _, t in tests.iterrows():
        other = r2["modes", int(t["second"])] if t["second"].isdigit() else r2[t["second"], 0]
        d = (r2["modes", t["first"]] - other).dropna().round(12)
        d = d[d != 0]
        rank = d.abs().rank()
        assert (t["n"], t["w"]) == (len(d), rank[d > 0].sum())
        signs = [sum(c) for c in (np.array(list(itertools.product([0, 1], repeat=len(d)))) * rank.to_numpy()).tolist()]
        low = min(t["w"], rank.sum() - t["w"])
        assert t["p"] == pytest.approx(min(1, 2 * np.mean(np.array(signs) <= low + 1e-9)))
    assert {"null", "sparse", "kernel"} < set(tests["second"])


def test_planted_permuted_modes_are_matched(spark):
    rng = np.random.default_rng(1)
    first = rng.standard_normal((20, 6)) + 1j * rng.standard_normal((20, 6))
    both = lambda v: np.stack([v, v.conj()], 2).reshape(len(v), -1)
    orders = {f: rng.permutation(6) for f in (1, 2, 3)}
    folds = {f: first[:, o] * np.exp(1j * rng.random(6)) + 0.05 * rng.standard_normal((20, 6)) for f, o in orders.items()}
    places = dense.matched_modes(folds, first)
    assert all((orders[f][places[f]] == np.arange(6)).all() for f in folds)
    got = O.mode_matches(spark, {f: both(v) for f, v in folds.items()}, both(first)).toPandas()
    assert len(got) == 18 and got["cosine"].min() > 0.98 and got["correlation"].min() > 0.9


def test_mode_matching_query(spark, sf_dir, series, chosen):
    got, dealt = models.mode_matching(spark, sf_dir).toPandas(), chosen[["fold", "label"]].drop_duplicates()
    folds = {int(f): fitted([series[k] for k in series if k not in set(g["label"])])[0] for f, g in dealt.groupby("fold")}
    first = fitted(series.values())[0]
    k = min(12, first.shape[1] // 2, *(v.shape[1] // 2 for v in folds.values()))
    odd = {f: v[:, : 2 * k : 2] for f, v in folds.items()}
    places = dense.matched_modes(odd, first[:, : 2 * k : 2])
    for p in places.values():
        assert sorted(p) == list(range(k))
    for f, g in itertools.combinations(sorted(folds), 2):
        mine = got[(got["fold"] == f) & (got["other"] == g)].sort_values("mode")
        x, y = odd[f][:, places[f]], odd[g][:, places[g]]
        want = np.abs((x.conj() * y).sum(0)) / np.linalg.norm(x, axis=0) / np.linalg.norm(y, axis=0)
        assert np.allclose(mine["cosine"], want, atol=1e-6)


def test_retest_eigenvalues(spark, sf_dir, series):
    got = models.retest_eigenvalues(spark, sf_dir).toPandas().set_index(["metric", "mode_idx"])
    halves = {k: (x[:, : int(np.floor(x.shape[1] * 0.5 + 0.5))], x[:, int(np.floor(x.shape[1] * 0.5 + 0.5)) :]) for k, x in series.items()}
    u = fitted([h for two in halves.values() for h in two])[0][:, :10]
    d = {(k, i): dense.refit(u, *moments(h)[:2]) for k, two in halves.items() for i, h in enumerate(two)}
    for metric, of in (("persistence", np.abs), ("progression", lambda v: np.abs(np.angle(v)))):
        for m in (1, 3, 5, 7, 9):
            a, b = (np.array([of(d[k, i][m]) for k in series]) for i in (0, 1))
            row = got.loc[(metric, m)]
            up, down = (a + b).var(ddof=1), (a - b).var(ddof=1)
            assert row["r"] == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-6) and row["icc"] == pytest.approx((up - down) / (up + down), abs=1e-6)


def test_reconstructed_correlations(spark, sf_dir, series):
    vectors, values = fitted(series.values())
    v = np.linalg.pinv(vectors[:, :10])
    weight = np.mean([np.abs(v @ x[:, :-1]).mean(1) for x in series.values()], 0)
    x = np.concatenate(list(series.values()), 1)
    low, step = np.tril_indices(N, -1), 0.72 / 1.5
    course = lambda k, n: sum((np.exp(np.log(values[m].astype(complex)) * step * np.arange(n))[None] * vectors[:, [m]]).real for m in (2 * k, 2 * k + 1))
    got = models.reconstructed_fc(spark, sf_dir).toPandas().sort_values("n")["r"].to_numpy()
    for n in range(1, 6):
        fc = np.corrcoef(np.mean([weight[2 * k] * course(k, 60) for k in range(n)], 0))
        assert got[n - 1] == pytest.approx(np.corrcoef(fc[low], np.corrcoef(x)[low])[0, 1], abs=1e-5)
    phases = np.angle(vectors[:, :10:2])
    each = np.cos(phases[:, None] - phases[None])
    p = models.phase_fc_accumulated(spark, sf_dir).toPandas().sort_values("n")
    for n in range(1, 6):
        assert p["own"].iat[n - 1] == pytest.approx(np.corrcoef(each[:, :, n - 1][low], np.corrcoef(x)[low])[0, 1], abs=1e-6)
        assert p["accumulated"].iat[n - 1] == pytest.approx(np.corrcoef(each[:, :, :n].mean(2)[low], np.corrcoef(x)[low])[0, 1], abs=1e-6)
    dfc = models.reconstruction_dfc(spark, sf_dir).where("pair = 2 and i = 3 and j = 7").first()["deviation"]
    y = course(1, 91)
    assert dfc == pytest.approx(np.std([np.corrcoef(y[2, i : i + 31], y[6, i : i + 31])[0, 1] for i in range(61)], ddof=1), abs=1e-5)


def test_p_values(spark, sf_dir):
    got = models.t_tests(spark, sf_dir).toPandas().set_index(["test", "l_linestatus"])
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet").toPandas()
    for status, g in x.groupby("l_linestatus"):
        v = g["l_discount"] - 0.05
        t = v.mean() / (v.std() / np.sqrt(len(v)))
        row = got.loc[("one", status)]
        assert row["t"] == pytest.approx(t) and row["p"] == pytest.approx(dense.student_p(t, len(v) - 1))
    assert dense.student_p(2.228138852, 10) == pytest.approx(0.05, abs=1e-8) and (got["p"] == [dense.student_p(t, d) for t, d in zip(got["t"], got["df"])]).all()
    odd = spark.createDataFrame(pd.DataFrame({"t": [1.0, None, 2.0], "df": [0.0, 3.0, 5.0]}))
    assert [r["p"] is None or np.isnan(r["p"]) for r in T.with_p(odd).orderBy("df").collect()] == [True, True, False]


def test_forecasts_of_sessions_in_several_blocks(spark, monkeypatch):
    # a long session is met block by block, and the session without a name counts too
    monkeypatch.setattr(O, "AHEAD", 70)
    monkeypatch.setattr(O, "PAST", 300)
    rng = np.random.default_rng(3)
    series = {"a": rng.standard_normal((3, 1001)).cumsum(1) / 5, None: rng.standard_normal((3, 46))}
    rows = [(k, c + 1, t * 7, float(x[c, t])) for k, x in series.items() for c in range(3) for t in range(x.shape[1])]
    panel = spark.createDataFrame(rows, "session string, channel int, t long, value double")
    got = O.parameter_scores(panel, ["session"], 3, (0.01, 0.002), (5.0, 20.0)).toPandas()
    assert len(got) == 8
    for k, x in series.items():
        mine = got[got["session"].isna() if k is None else got["session"] == k].set_index(["model", "parameter"])
        cut = int(np.floor(0.8 * (x.shape[1] - 1) + 0.5))
        y, z, yt, zt = x[:, :cut], x[:, 1 : cut + 1], x[:, cut:-1], x[:, cut + 1 :]
        a = (z * y).sum() / (y * y).sum()
        d2 = ((y[:, :, None] - yt[:, None, :]) ** 2).sum(0)
        null, sst = ((zt - a * yt) ** 2).sum(1), ((zt - zt.mean(1, keepdims=True)) ** 2).sum(1)
        plain = {}
        for h in (5.0, 20.0):
            w = np.exp(-(d2 - d2.min(0)) / (2 * (np.median(np.sqrt(d2)) * h / 50) ** 2))
            plain["kernel", h] = a * yt + (z - a * y) @ (w / w.sum(0))
        for p in (0.01, 0.002):
            plain["sparse", p] = a * yt + dense.lasso_rows(y @ y.T / cut, (z - a * y) @ y.T / cut, p) @ yt
        for at, forecast in plain.items():
            e = ((zt - forecast) ** 2).sum(1)
            assert mine.loc[at, "r2"] == pytest.approx((1 - e / sst).mean(), abs=1e-8) and mine.loc[at, "loss"] == pytest.approx((e / null).mean(), rel=1e-7)
    assert not O.parameter_scores(panel.where("false"), ["session"], 3, (0.01,), (5.0,)).count()
