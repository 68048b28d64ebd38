"""Hard negatives against brute force."""

import collections
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from undula.llm import embedding_dups, hard_negatives

VECTORS = "vec_id long, embedding array<double>, label int, norm double, id string"
COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute_force(rows, relabelled=True):
    """The result's rows for rows (id, vector, label)."""
    held = {i: ((c + 1) % 10 if relabelled and i % 7 == 0 else c, [math.floor(256 * x) for x in v]) for i, v, c in rows if v is not None and c is not None and i is not None and all(x is not None and math.isfinite(x) for x in v)}
    held = {i: (c, v) for i, (c, v) in held.items() if sum(x * x for x in v) <= hard_negatives.LARGEST}
    out = []
    for i, (c, v) in held.items():
        if i % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, e) for j, (e, w) in held.items() if j != i and len(v) == len(w))
        for p, j, _ in [s for s in scored if s[2] == c][:5]:
            hits = [(-s, k) for s, k, e in scored if e != c and 50 * -p <= 100 * -s <= 95 * -p][:3]
            out += [(i, j, rank, k, -p, s) for rank, (s, k) in enumerate(hits, 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def mined(df):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, label)


def test_query_equals_brute_force_and_sql(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = brute_force([(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()])
    assert want and got(hard_negatives.op13_hard_negatives(spark, sf_dir)) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf_dir}/embeddings.parquet')")
    assert sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({hard_negatives.ORACLE['op13_hard_negatives']})").fetchall()) == want
    dups = {r[0]: r for r in con.execute(f"SELECT vec_id, n_links, component_id, kept FROM ({embedding_dups.ORACLE['op12_embedding_dups']})").fetchall()}
    assert dups == {r["vec_id"]: tuple(r[c] for c in ("vec_id", "n_links", "component_id", "kept")) for r in embedding_dups.op12_embedding_dups(spark, sf_dir).collect()}


@pytest.mark.parametrize("block", [64, 8192])
def test_clusters_ties_and_blocks(spark, block, monkeypatch):
    """Clustered vectors of many lengths, copies, ties, in small blocks that bounds exclude and in one."""
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", block // 8)
    rng, rows = np.random.default_rng(0), []
    centres = rng.standard_normal((8, 16))
    for i in range(1200):
        v = centres[i % 8] * rng.choice([0.2, 1, 5]) + 0.1 * rng.standard_normal(16)
        rows.append((i, (centres[3] if 300 < i < 600 else v).tolist(), int(rng.integers(0, 4))))
    df = spark.createDataFrame([(i, [float(x) for x in v], c, 0.0, "x") for i, v, c in rows], VECTORS)
    assert got(mined(df)) == brute_force(rows)


def test_odd_rows(spark):
    """Nulls, non-finite and huge components, zero rows, other lengths, repeated rows, clashing columns."""
    rows = [(i, [1.0, 0.5 * (i % 3), 0.25], i % 2) for i in range(0, 120, 10)]
    rows += [(1, None, 1), (2, [1.0, None, 1.0], 1), (3, [1.0, math.nan, 1.0], 0), (4, [1.0, math.inf, 1.0], 0), (5, [1.0, 1.0, 1.0], None), (6, [0.0, 0.0, 0.0], 1), (8, [1e300, 1.0, 1.0], 1), (9, [-2.0, 0.0, 0.0], 0), (11, [1.0], 1), (12, [], 1), (150, [1.0], 1), (200, [0.0, 0.0, 0.0], 1), (250, [-1.0, -1.0, 0.5], 1), (13, [5e4, 1e5, 0.0], 1)]
    extra = [(10, [1.0, 0.5, 0.25], 9), (None, [1.0, 1.0, 1.0], 1)]
    df = spark.createDataFrame([(i, x, c, 0.0, "x") for i, x, c in [*rows, *extra]], VECTORS)
    want = brute_force(rows)
    assert want and got(mined(df)) == want


def test_empty_table(spark):
    assert mined(spark.createDataFrame([], VECTORS)).count() == 0


def test_windows_hold_every_row_whose_score_counts():
    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.standard_normal((400, 8)) * rng.choice([0.1, 1, 3], (400, 1)))
    refs = hard_negatives.references(x, 4)
    angles, norms = hard_negatives.angles_to(x, refs), np.linalg.norm(x, axis=1)
    order = np.argsort(angles[:, 2])
    beta, held = angles[order, 2], x[order]
    for i in range(50):
        scores = held @ x[i]
        low, high = np.sort(rng.choice(scores, 2))
        first, stop = hard_negatives.windows(beta, norms[order], angles[[i], 2], norms[[i]], np.array([low]), np.array([high]))
        hit = np.flatnonzero((scores >= low) & (scores <= high))
        assert first[0] <= hit.min() and hit.max() < stop[0]
