"""Templates and quasi-periodic patterns against numpy and planted patterns."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from undula.operators import templates
from undula.plans import models

C, L = 5, 6


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(templates, "TILE", 32)


def panel(spark, x, session=1):
    rows = pd.DataFrame({"s": session, "channel": np.tile(np.arange(1, x.shape[1] + 1), len(x)), "t": np.repeat(3 * np.arange(len(x)), x.shape[1]), "value": x.ravel()})
    return spark.createDataFrame(rows, "s int, channel int, t long, value double")


def plain_course(x, template):
    w = len(template)
    return np.array([np.corrcoef(x[i : i + w].ravel(), template.ravel())[0, 1] if x[i : i + w].std() else 0.0 for i in range(len(x) - w + 1)])


@pytest.mark.parametrize("length", [L, 40])
def test_course_equals_numpy(spark, length):
    rng = np.random.default_rng(0)
    x, y = rng.standard_normal((150, C)), rng.standard_normal((length + 3, C))
    x[60 : 60 + length] = 1.0
    tiles = templates.frame_tiles(panel(spark, x).unionByName(panel(spark, y, 2)).unionByName(panel(spark, y[: length - 1], 3)), C, length, ["s"])
    wanted = {1: x[:length], 7: rng.standard_normal((length, C))}
    got = templates.template_course(tiles, wanted).toPandas()
    for s, v in ((1, x), (2, y)):
        for k, w in wanted.items():
            mine = got[(got.s == s) & (got.template == k)].sort_values("t")
            assert mine["t"].tolist() == (3 * np.arange(len(v) - length + 1)).tolist() and np.allclose(mine["r"], plain_course(v, w), atol=1e-9)
    assert not (got.s == 3).any()


def test_peaks_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, C))
    template = x[100 : 100 + L] + 0.1
    tiles = templates.frame_tiles(panel(spark, x), C, L, ["s"])
    peaks, r, windows, sums = templates.peak_windows(tiles, {4: template}, 0.1)[4]
    course = plain_course(x, template)
    at = [i for i in range(1, len(course) - 1) if course[i] > 0.1 and course[i] > course[i - 1] and course[i] >= course[i + 1]]
    assert (peaks, windows) == (len(at), len(course)) and r == pytest.approx(course.sum())
    assert np.allclose(sums, sum(x[i : i + L] for i in at))


def test_planted_pattern_is_found(spark):
    """A pattern put in at known times comes out of most runs; the loop does what numpy does."""
    rng, n = np.random.default_rng(2), 24
    pattern = np.outer(np.sin(np.arange(L) * 2 * np.pi / L), rng.standard_normal(n)) * 3
    x = 0.3 * rng.standard_normal((600, n))
    for i in range(10, 580, 9):
        x[i : i + L] += pattern
    tiles = templates.frame_tiles(panel(spark, x), n, L)
    reports, found = templates.quasi_periodic(tiles, n, L, runs=6)
    best = templates.best_run(reports)
    assert len(reports) == 6 and all(r[2] for r in reports)
    course = plain_course(x, found[best])
    moved = np.concatenate([np.zeros_like(pattern), pattern, np.zeros_like(pattern)])
    alike = {k: np.abs(plain_course(moved, w)).max() for k, w in found.items()}
    assert sum(a > 0.9 for a in alike.values()) >= 3, alike and reports[best - 1][4] == max(r[4] for r in reports)
    # one run by hand, from the same window
    template = templates.first_windows(tiles, n, L, 6, 1)[best]
    for round_ in range(1, 51):
        least = 0.1 if round_ < 3 else 0.2
        course = plain_course(x, template)
        at = [i for i in range(1, len(course) - 1) if course[i] > least and course[i] > course[i - 1] and course[i] >= course[i + 1]]
        new = np.mean([x[i : i + L] for i in at], 0)
        alike, template = np.corrcoef(new.ravel(), template.ravel())[0, 1], new
        if alike > 0.9999:
            break
    assert reports[best - 1][1] == round_ and np.allclose(found[best], template) and reports[best - 1][4] == pytest.approx(course.mean())


def test_no_windows(spark):
    tiles = templates.frame_tiles(panel(spark, np.ones((3, C))), C, L, ["s"])
    assert templates.quasi_periodic(tiles, C, L) == ([], {}) and templates.best_run([]) is None
    assert templates.template_course(tiles, {1: np.ones((L, C))}).count() == 0


def test_queries(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf_dir}/embeddings.parquet')")
    want = dict(con.execute(f"SELECT t, r FROM ({models.ORACLE['template_course']})").fetchall())
    assert {r["t"]: r["r"] for r in models.template_course(spark, sf_dir).collect()} == want
    runs = models.qpp_runs(spark, sf_dir).toPandas()
    template = models.qpp_template(spark, sf_dir).toPandas()
    assert len(runs) == 10 and len(template) == models.WINDOW * models.CHANNELS
    # the template is the mean of the windows at its own peaks
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], float)
    g = x.mean(1)
    x = x - x.mean(0) - np.outer(g - g.mean(), ((x - x.mean(0)) * (g - g.mean())[:, None]).mean(0) / g.var())
    w = template.pivot(index="frame", columns="channel", values="value").to_numpy()
    course = plain_course(x, w)
    at = [i for i in range(1, len(course) - 1) if course[i] > 0.2 and course[i] > course[i - 1] and course[i] >= course[i + 1]]
    best = runs.sort_values(["mean_r", "run"], ascending=[False, True]).iloc[0]
    assert not best["converged"] or np.corrcoef(np.mean([x[i : i + models.WINDOW] for i in at], 0).ravel(), w.ravel())[0, 1] > 0.9999
    match = models.template_match(spark, sf_dir).toPandas()
    modes = models.group_modes(spark, sf_dir).toPandas().sort_values(["mode_idx", "channel"])
    for _, m in match.iterrows():
        two = [modes[modes.mode_idx == 2 * m["pair"] - k] for k in (1, 0)]
        t = np.arange(3001)[:, None] * 0.72 / 1.5
        course = sum((np.exp(1j * np.angle(v["lambda_re"].iat[0] + 1j * v["lambda_im"].iat[0]) * t) * (v["re"] + 1j * v["im"]).to_numpy()[None]).real for v in two if len(v))
        r = plain_course(course, w)[: 3000 - models.WINDOW]
        assert m["r"] == pytest.approx(r.max(), abs=1e-8) and r[int(m["frame"])] == pytest.approx(r.max(), abs=1e-8)
