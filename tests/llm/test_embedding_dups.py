"""Embedding near-dedup against brute force."""

import math

import numpy as np
import pytest

from undula.llm import embedding_dups as E

VECTORS = "vec_id long, embedding array<double>, label int, n long, node long, component string"


def brute_force(rows, similarity=0.98):
    """{id: (n_links, component_id, kept)} of rows (id, vector, label)."""
    ok = [(i, np.array(v, float), c) for i, v, c in rows if v is not None and c is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    n, root = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, x, c) in enumerate(ok):
        for j, y, e in ok[k + 1 :]:
            if c == e and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= similarity:
                n[i], n[j] = n[i] + 1, n[j] + 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (n[i], find(i), find(i) == i) for i, _, _ in rows}


def got(df):
    return {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


def near(rng, v, cosine):
    z = rng.standard_normal(len(v))
    v = v / np.linalg.norm(v)
    z -= (z @ v) * v
    return cosine * v + math.sqrt(1 - cosine * cosine) * z / np.linalg.norm(z)


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert {r["vec_id"]: tuple(r)[1:] for r in E.op12_embedding_dups(spark, sf_dir).select("vec_id", "n_links", "component_id", "kept").collect()} == brute_force(rows)


@pytest.mark.parametrize("block", [E.BLOCK, 16])
def test_groups_of_copies_and_pairs_about_the_threshold(spark, block, monkeypatch):
    """Copies, scaled copies, near copies about the threshold, and a bucket cut into parts."""
    monkeypatch.setattr(E, "BLOCK", block)  # the driver deals the parts
    rng, rows = np.random.default_rng(0), []
    base = rng.standard_normal(64)
    rows += [(i, base.tolist(), 1) for i in range(30)] + [(30 + i, (base * (2.0**i)).tolist(), 1) for i in range(3)]
    rows += [(100 + i, near(rng, base, 0.99).tolist(), 1) for i in range(60)] + [(200 + i, near(rng, base, 0.9799).tolist(), 1) for i in range(10)] + [(220 + i, near(rng, base, 0.9801).tolist(), 1) for i in range(10)]
    rows += [(300 + i, base.tolist(), 2) for i in range(5)] + [(400 + i, rng.standard_normal(64).tolist(), int(i % 3)) for i in range(80)]
    for i in range(40):
        v = rng.standard_normal(64)
        rows += [(1000 + 2 * i, v.tolist(), 0), (1001 + 2 * i, near(rng, v, 0.981).tolist(), 0)]
    df = spark.createDataFrame([(i, [float(x) for x in v], c, 0, 0, "x") for i, v, c in rows], VECTORS)
    assert got(E.embedding_components(df)) == brute_force(rows)


def test_odd_rows(spark):
    """Nulls, zeros, non-finite components, other lengths, repeated rows and clashing columns."""
    v = [0.5, 0.5, 0.1]
    rows = [(1, v, 1), (2, v, 1), (3, None, 1), (4, [0.0, 0.0, 0.0], 1), (5, [0.5, None, 0.1], 1), (6, [0.5, math.nan, 0.1], 1), (7, [math.inf, 0.5, 0.1], 1), (8, v, None), (9, [0.5, 0.5], 1), (10, [], 1), (11, [0.5], 1), (12, [2.0], 1), (13, [-2.0], 1), (14, [1e300, 1e300, 2e299], 1), (15, [1e-300, 1e-300, 2e-301], 1)]
    df = spark.createDataFrame([(i, x, c, 0, 0, "x") for i, x, c in [*rows, (2, v, 1), (2, None, 1), (None, v, 1)]], VECTORS)
    want = {i: (0, i, True) for i in range(3, 11)} | {None: (0, None, True), 1: (3, 1, True), 2: (3, 1, False), 14: (3, 1, False), 15: (3, 1, False), 11: (1, 11, True), 12: (1, 11, False), 13: (0, 13, True)}
    assert got(E.embedding_components(df)) == want


def test_empty_table(spark):
    assert E.embedding_components(spark.createDataFrame([], VECTORS)).count() == 0


def test_pairs_at_the_threshold_meet():
    rng = np.random.default_rng(5)
    for rotations in (2, 3):
        tables = E.tables_for(64, rotations, 0.98)
        x = rng.standard_normal((5000, 64))
        y = np.stack([near(rng, v, 0.98) for v in x])
        assert E.meet(E.buckets(x, tables, rotations), E.buckets(y, tables, rotations)).any(1).all()
