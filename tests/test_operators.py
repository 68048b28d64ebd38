"""Operators on small tables: nulls, ties, constant channels and empty input."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from undula.operators import modes, moments, panel, patterns, series, statistics, subjects


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def walk(spark, n=60, channels=3):
    rng = np.random.default_rng(0)
    rows = [(int(c), int(t), float(v)) for c in range(1, channels + 1) for t, v in enumerate(rng.standard_normal(n))]
    return table(spark, rows, "channel int, t int, value double")


def test_constant_channel(spark):
    p = walk(spark, 40, 1).unionByName(spark.range(40).select(F.lit(9).alias("channel"), F.col("id").cast("int").alias("t"), F.lit(1.0).alias("value")))
    assert moments.correlation_matrix(p).first()["r"] is None
    assert series.sliding_correlation(moments.channel_pairs(p), 10).agg(F.max(F.abs("rho"))).first()[0] == 0
    assert panel.zscored(p).where("channel = 9").agg(F.max(F.abs("value"))).first()[0] == 0
    assert [r["channel"] for r in panel.low_variance_channels(p).collect()] == [9]


def test_sliding_correlation_equals_numpy(spark):
    p = walk(spark)
    x = p.toPandas().pivot(index="channel", columns="t", values="value").to_numpy()
    got = series.sliding_correlation(moments.channel_pairs(p), 20).where("i = 1 and j = 3").orderBy("t").toPandas()
    want = [np.corrcoef(x[0, t - 19 : t + 1], x[2, t - 19 : t + 1])[0, 1] for t in range(19, 60)]
    assert np.allclose(got["rho"], want)


def test_excursion_by_hand(spark):
    rho = [0.1, 0.2, 0.5, 0.7, 0.6, 0.1, 0.9]
    s = table(spark, [(1, 2, t, v) for t, v in enumerate(rho)], "i int, j int, t int, rho double")
    want = 2**0.9 * 0.2 + 1 * 0.5 + 2**0.9 * 0.7 + 1 * 0.1 + 1 * 0.9
    assert series.excursion(s).first()["excursion"] == pytest.approx(want)


def test_peak_lag_is_antisymmetric(spark):
    t = np.arange(200)
    a, b = np.sin(2 * np.pi * t / 25), np.sin(2 * np.pi * (t - 2) / 25)
    rows = lambda x, y: [(1, int(i), float(v)) for i, v in enumerate(x)] + [(2, int(i), float(v)) for i, v in enumerate(y)]
    lag = lambda x, y: series.peak_lag(series.lagged_covariance(table(spark, rows(x, y), "channel int, t int, value double"), 6)).first()["lag"]
    assert lag(a, b) == pytest.approx(2, abs=0.1) and lag(b, a) == pytest.approx(-2, abs=0.1)


def test_local_maxima_with_plateau(spark):
    s = table(spark, list(enumerate([5.0, 1.0, 3.0, 3.0, 2.0, 4.0, 4.0])), "t int, v double")
    assert [r["t"] for r in series.local_maxima(s, "v").collect()] == [2]


def test_boxcar_includes_both_ends(spark):
    s = spark.range(10).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    e = table(spark, [(1, 2.0, 3.0), (1, 7.0, 0.0)], "k int, onset double, duration double")
    assert sorted(r["t"] for r in series.boxcar(s, e, ["k"], 2.0).where("on = 1").collect()) == [2, 3, 4, 5, 7]


def test_midpoint_percentile(spark):
    x = table(spark, [(1.0,), (2.0,), (3.0,), (10.0,)], "v double")
    assert statistics.midpoint_percentile(x, "v", 85).first()[0] == pytest.approx(9.3)


def test_bh(spark):
    p = table(spark, [(0.01,), (0.02,), (0.03,), (0.04,)], "p double")
    assert [r["adjusted"] for r in statistics.bh_adjusted(p, "p").collect()] == pytest.approx([0.04] * 4)
    assert [r["adjusted"] for r in statistics.bh_adjusted(p, "p", published_scale=True).collect()] == pytest.approx([0.8] * 4)


def test_nmi(spark):
    same = table(spark, [(i % 3, i % 3) for i in range(30)], "x int, y int")
    apart = table(spark, [(i % 2, (i // 2) % 2) for i in range(40)], "x int, y int")
    assert moments.nmi(same, "x", "y").first()["nmi"] == pytest.approx(1)
    assert moments.nmi(apart, "x", "y").first()["nmi"] == pytest.approx(0, abs=1e-9)


def test_folds_cover_everyone_once(spark):
    f = panel.folds(spark.range(103).withColumnRenamed("id", "s"), "s").toPandas()
    assert sorted(f["s"]) == list(range(103)) and f["fold"].value_counts().to_dict() == {1: 20, 2: 20, 3: 20, 4: 20, 5: 23}


def test_conforming_sessions(spark):
    p = table(spark, [(1, 1, 0, 1.0), (1, 1, 1, 1.0), (2, 1, 0, 1.0)], "s int, channel int, t int, value double")
    assert {r["s"] for r in panel.conforming(p, 2, ["s"]).collect()} == {1}


def test_kinship(spark):
    p = table(spark, [(1, "m", "f", "MZ"), (2, "m", "f", "MZ"), (3, "m", "g", "NT"), (4, None, None, "DZ"), (5, None, None, "DZ")], "id int, m string, f string, z string")
    found = subjects.kinship_pairs(p, "id", "m", "f", "z")
    assert {(r["a"], r["b"], r["kinship"]) for r in found.collect()} == {(1, 2, "MZ"), (1, 3, "Sibling"), (2, 3, "Sibling")}
    assert subjects.unrelated_pairs(p, found).first()[0] == 7


def test_motion_missing_is_excluded(spark):
    s = table(spark, [(1, 1), (1, 2), (2, 1)], "subject int, run int")
    m = table(spark, [(1, 1, 0.1), (1, 1, 0.2), (1, 2, 0.1)], "subject int, run int, rms double")
    got = {(r["subject"], r["run"]): r["moved"] for r in subjects.motion_flags(s, m, ["subject", "run"], "rms").collect()}
    assert got == {(1, 1): True, (1, 2): False, (2, 1): True}


def rotating(spark, subjects_=3, n=300):
    a = np.zeros((4, 4))
    c, s = np.cos(0.5) * 0.95, np.sin(0.5) * 0.95
    a[:2, :2], a[2:, 2:] = [[c, -s], [s, c]], 0.5 * np.eye(2)
    rng, rows = np.random.default_rng(4), []
    for k in range(subjects_):
        x = rng.standard_normal(4)
        for t in range(n):
            rows += [(k, i + 1, t, float(v)) for i, v in enumerate(x)]
            x = a @ x + rng.standard_normal(4)
    return spark.createDataFrame(pd.DataFrame(rows, columns=["s", "channel", "t", "value"]), "s int, channel int, t long, value double")


def test_group_modes_and_metrics(spark):
    p = rotating(spark)
    m = modes.session_moments(p, ["s"], 4)
    vectors, values, _ = modes.fit_group(m, 4, 0.1, 1.0)
    assert np.allclose(np.angle(values[:2]), [0.5, -0.5], atol=0.05)
    got = modes.subject_metrics(m, ["s"], vectors[:, :2], 4).where("mode_idx = 1").toPandas()
    assert np.allclose(got["persistence"], 0.95, atol=0.05) and np.allclose(got["progression"], 0.5, atol=0.05)
    table_ = modes.forecasts(p, ["s"], vectors, 4, [1], sparse=0.05).toPandas().groupby("model")["r2"].mean()
    assert table_["modes"] > table_["null"] and table_["sparse"] > table_["null"] > table_["persistence"] - 1


def test_moments_add_up(spark):
    m = modes.session_moments(rotating(spark), ["s"], 4)
    whole = modes.summed(m).orderBy("place").toPandas()["yy"].to_numpy()
    parts = modes.summed(m, ["s"]).groupBy("place").agg(F.sum("yy").alias("yy")).orderBy("place").toPandas()["yy"].to_numpy()
    assert np.allclose(whole, parts)


def test_max_t_is_repeatable(spark):
    rng = np.random.default_rng(0)
    x, y = rng.standard_normal((30, 2)), rng.standard_normal(30)
    a, b = (patterns.max_t_permutations(spark, x, y, 50).orderBy("permutation").toPandas() for _ in range(2))
    assert a.equals(b) and len(a) == 50


def test_empty_panels(spark):
    e = walk(spark).where("false")
    for f in (panel.lag1_pairs, panel.zscored, panel.global_signal, moments.correlation_matrix, panel.regress_global_signal):
        assert f(e).count() == 0


def test_q_values():
    # no p above 0.05, so the share of true nulls is the least allowed, 1 / 4; q of all is 0.25 * 0.04 * 4 / 4
    assert np.allclose(patterns.storey_q([0.01, 0.02, 0.03, 0.04]), 0.01, atol=1e-12)
    # half of them above every point of the grid up to 0.9: nulls 0.5 / 0.95 at 0.05 is the least
    assert np.allclose(patterns.storey_q([0.01, 0.95]), [0.5 / 0.95 * 0.02, 0.5 / 0.95 * 0.95], atol=1e-12)
    p = np.random.default_rng(0).uniform(size=400)
    assert (patterns.storey_q(p) >= p * 0.5).all()


def test_seed_frames_are_the_highest(spark):
    p = spark.range(100).select(F.lit(1).alias("s"), F.lit(1).alias("channel"), F.col("id").alias("t"), F.col("id").cast("double").alias("value"))
    assert sorted(r["t"] for r in patterns.seed_frames(p, [1], ["s"]).collect()) == list(range(85, 100))
    assert patterns.seed_frames(p, [1], ["s"], most=3).count() == 3


def test_residuals_and_contrasts(spark):
    x = spark.range(40).select(F.lit(1.0).alias("one"), F.col("id").cast("double").alias("x"), (3 + 2 * F.col("id") + F.pmod("id", F.lit(2))).cast("double").alias("y"))
    r = statistics.residualised(x, ["one", "x"], "y").toPandas()
    assert abs(r["residual"].sum()) < 1e-6 and abs((r["residual"] * r["x"]).sum()) < 1e-5
    t = statistics.glm_contrast(x, ["one", "x"], "y", [0, 1], 2.0).first()
    assert t["df"] == 38 and abs(t["t"]) < 1
    assert statistics.glm_f(x, ["one", "x"], "y", [[0, 1]]).first()["p"] < 1e-20


def test_following_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(panel, "TIME_CHUNK", 4)
    rows = [(k, t, float(10 * k + t)) for k in (1, 2) for t in (0, 1, 3, 4, 9, 10, 30)]
    got = {(r["k"], r["t"]): r["x"] for r in panel.following(table(spark, rows, "k int, t int, value double"), "value", ["k"]).collect()}
    want = {(k, a): 10.0 * k + b for k in (1, 2) for a, b in zip((0, 1, 3, 4, 9, 10), (1, 3, 4, 9, 10, 30))}
    assert got == {**want, (1, 30): None, (2, 30): None}


def test_dense_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(panel, "TIME_CHUNK", 3)
    cells = table(spark, [("a", 0, 1.0), ("b", 7, 2.0)], "channel string, t int, value double")
    got = panel.dense(cells, cells.select("channel").distinct())
    assert {(r["channel"], r["t"]): r["value"] for r in got.collect()} == {**{(c, t): 0.0 for c in "ab" for t in range(8)}, ("a", 0): 1.0, ("b", 7): 2.0}


def test_pair_sums_count_only_what_both_know(spark):
    rows = [("u", c, t, v) for t in range(40) for c, v in ((1, t * 1.5), (2, None if t % 3 else t - 5.0), (3, float(t * t)))] + [("v", 1, 0, 2.0), ("v", 3, 0, 4.0), ("v", 3, 1, 1.0)]
    got = {(r["k"], r["i"], r["j"]): (r["n"], r["lr"], r["l"]) for r in moments.pair_sums(table(spark, rows, "k string, channel int, t int, value double"), "value", "value", ["k"]).collect()}
    known = [(t * 1.5, t - 5.0) for t in range(0, 40, 3)]
    assert got["u", 1, 2] == pytest.approx((14, sum(a * b for a, b in known), sum(a for a, _ in known)))
    assert got["v", 1, 3] == pytest.approx((1, 8.0, 2.0)) and ("v", 1, 2) not in got and got["v", 3, 3] == pytest.approx((2, 17.0, 5.0))
