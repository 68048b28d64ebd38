"""Families of linear models and max-T permutations against numpy and SQL."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from undula.functions.dense import student_p
from undula.operators import families, patterns
from undula.plans import models

METRICS = [("size", "a", "m1"), ("turn", "a", "m2"), ("size", "b", "m3"), ("turn", "b", "m4")]
DESIGN, FACTORS = ["one", "age"], ["f1", "f2", "f3"]


@pytest.fixture(scope="module")
def people():
    rng = np.random.default_rng(0)
    n = 90
    x = pd.DataFrame({"id": np.arange(n), "one": 1.0, "age": rng.integers(20, 60, n).astype(float)})
    for c in ("m1", "m2", "m3", "m4"):
        x[c] = rng.standard_normal(n) + 0.02 * x["age"]
    x["f1"] = 1.2 * x["m1"] + rng.standard_normal(n)
    x["f2"], x["f3"] = rng.standard_normal(n), 0.4 * x["m4"] + rng.standard_normal(n)
    return x


@pytest.fixture(scope="module")
def frame(spark, people):
    missing = spark.createDataFrame([(1000, 1.0, None, *[1.0] * 7), (1001, 1.0, 30.0, float("nan"), *[1.0] * 6)], "id long, one double, age double, m1 double, m2 double, m3 double, m4 double, f1 double, f2 double, f3 double")
    return spark.createDataFrame(people).select(missing.columns).unionByName(missing).repartition(3)


def last_t(x, m, y):
    a = np.column_stack([x, m])
    b, _, _, _ = np.linalg.lstsq(a, y, rcond=None)
    rest, df = y - a @ b, len(y) - a.shape[1]
    return b[-1] / np.sqrt(rest @ rest / df * np.linalg.inv(a.T @ a)[-1, -1])


def left(x, y):
    return y - x @ np.linalg.pinv(x) @ y


def test_grid_equals_numpy(frame, people):
    got = families.factor_grid(frame, DESIGN, METRICS, FACTORS).toPandas().set_index(["metric", "mode", "factor"])
    x = people[DESIGN].to_numpy()
    assert len(got) == 12
    for metric, mode, c in METRICS:
        for f in FACTORS:
            row = got.loc[(metric, mode, f)]
            t = last_t(x, left(x, people[c].to_numpy()), people[f].to_numpy())
            assert row["t"] == pytest.approx(t) and row["p"] == pytest.approx(student_p(t, 87)) and (row["n"], row["df"]) == (90, 87)
            assert row["r"] == pytest.approx(np.corrcoef(left(x, people[f].to_numpy()), people[c])[0, 1])
    assert got.loc[("size", "a", "f1")]["p"] < 1e-6


def plain_max_t(people, blocks, n_perm):
    x = people[DESIGN].to_numpy()
    m, f = (np.column_stack([left(x, people[c].to_numpy()) for c in cs]) for cs in ([c for *_, c in METRICS], FACTORS))
    out = []
    for k in range(n_perm):
        top = 0.0
        for i, columns in enumerate(([0, 1], [2, 3])):
            for j in range(3):
                moved = np.empty((len(m), 2))
                for b, rows in enumerate(blocks):
                    moved[rows] = m[rows][families.order_of(1, b, k, 3 * i + j, len(rows))][:, columns]
                top = max(top, *(abs(last_t(x, v, f[:, j])) for v in moved.T))
        out.append(top)
    return np.array(out)


@pytest.mark.parametrize("block", [1 << 16, 40])
def test_max_t_equals_numpy(spark, frame, people, block):
    """Whole and in blocks of subjects; a permutation of a cell is shared by its metrics."""
    got = families.max_t(frame, "id", DESIGN, METRICS, FACTORS, permutations=60, block=block).toPandas().sort_values("permutation")
    n = max(1, -(-90 // block))
    dealt = spark.createDataFrame(people[["id"]]).selectExpr("id", f"pmod(xxhash64(id), {n}) AS b").toPandas().sort_values("id")["b"].to_numpy()
    want = plain_max_t(people, [np.flatnonzero(dealt == b) for b in range(n)], 60)
    assert got["permutation"].tolist() == list(range(60)) and np.allclose(got["max_t"], want)
    tests = families.factor_grid(frame, DESIGN, METRICS, FACTORS)
    p = families.exceedance_p(tests, families.max_t(frame, "id", DESIGN, METRICS, FACTORS, permutations=60, block=block)).toPandas()
    assert np.allclose(p["p_fwe"], [(want > abs(t)).mean() for t in p["t"]]) and len(p) == 12


def test_too_few_rows(spark, frame):
    assert families.factor_grid(frame.limit(2), DESIGN, METRICS, FACTORS).count() == 0
    assert families.factor_grid(frame.where("id < 0"), DESIGN, METRICS, FACTORS).count() == 0
    assert families.max_t(frame.where("id < 0"), "id", DESIGN, METRICS, FACTORS, permutations=5).count() == 0


def test_queries(spark, sf_dir):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    columns = "metric, mode, factor, n, df, r, t"
    want = sorted(con.execute(f"SELECT {columns} FROM ({models.ORACLE['factor_grid']})").fetchall())
    assert sorted(tuple(r) for r in models.factor_grid(spark, sf_dir).select(*columns.split(", ")).collect()) == want
    tests = models.factor_tests(spark, sf_dir).toPandas()
    assert len(tests) == 60 and np.allclose(tests["p"], [student_p(t, want[0][4]) for t in tests["t"]])
    assert np.allclose(tests["q"], patterns.storey_q(tests["p"].to_numpy()))
    assert tests.sort_values("p_fwe")["t"].abs().is_monotonic_decreasing or tests["p_fwe"].nunique() < 60
