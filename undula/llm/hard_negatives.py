"""Hard negatives by angular triangle filtering.

Every row stores its angles to a few reference directions. The angle between two rows
lies between the difference and the sum of their angles to one reference, which bounds
their cosine; times their norms it bounds their score. Blocks of rows whose bounds can't
reach what a block of anchors looks for are not sent to it, and within a block only the
window of rows whose bounds overlap an anchor's is scored, in integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from undula.llm.ann import unit_rows
from undula.llm.shared import broadcast_if_small, checkpointed, release_memory, table

#: Reference directions, drawn from at most so many rows, those with the smallest hashes of their ids.
REFERENCES, FIT_ROWS = 32, 2000
#: Rows in a block, and anchors in one, about.
BLOCK, ANCHOR_BLOCK = 8192, 4096
#: Blocks of anchors (2 REFERENCES + 6 numbers each) up to so many are broadcast.
BROADCAST_BLOCKS = 20_000
#: Anchors scored together against the window that covers theirs.
TOGETHER = 32
#: A row takes part up to this square of its norm: products with 100 then fit a long.
LARGEST = 1 << 55
#: Floating error of angles, and of bounds as a share of the product of norms.
ANGLE_ERROR, SHARE_ERROR = 1e-6, 1e-6


def references(sample: np.ndarray, n: int = REFERENCES) -> np.ndarray:
    """At most n unit rows of the sample that lie far apart: each next one is the farthest from those before."""
    if not len(sample):
        return np.zeros((0, 0))
    unit = unit_rows(sample)
    found, near = [0], unit @ unit[0]
    while len(found) < min(n, len(unit)):
        found.append(int(near.argmin()))
        near = np.maximum(near, unit @ unit[found[-1]])
    return unit[found]


def angles_to(x: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Rows by references: angles, those of a zero row being 0 (its scores are 0 at any angle)."""
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.arccos(np.clip((x @ refs.T) / np.maximum(norm, 1e-300), -1, 1)) * (norm > 0)


def rows_taking_part(vectors: DataFrame, is_anchor: Column, label: Column, id_col: str, vector_col: str) -> DataFrame:
    """(id, label, x, norm, asks): one row for each id, x being floor(256 * component) as longs and norm its length."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    # beyond 2^40 a square is too large at once, and a long may not hold the value
    scaled = F.transform(v, lambda c: F.floor(F.greatest(F.least(c * 256.0, F.lit(2.0**40)), F.lit(-(2.0**40)))))
    known = vectors.where(F.col(id_col).isNotNull() & v.isNotNull()).select(F.col(id_col).cast("long").alias("id"), label.alias("label"), scaled.alias("x"), bad.alias("_bad"), F.coalesce(is_anchor, F.lit(False)).alias("asks")).where(F.col("label").isNotNull() & ~F.col("_bad"))
    squares = F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    fits = known.withColumn("_n", squares).where(F.col("_n") <= float(LARGEST))
    first = fits.groupBy("id").agg(F.min(F.struct("label", "x", "_n")).alias("s"), F.max("asks").alias("asks"))
    return first.select("id", "s.label", "s.x", F.sqrt("s._n").alias("norm"), "asks")


def _with_angles(rows: DataFrame, refs: np.ndarray) -> DataFrame:
    """rows with their `size`, `angles` to the references and `cell`, the nearest one; null where they differ in length."""
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in rows.columns) + ", size int, angles array<double>, cell int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(v) for v in batch.column("x")], np.int32)
            at = np.flatnonzero(sizes == refs.shape[1]) if len(refs) else []
            angles, cell = [None] * batch.num_rows, [None] * batch.num_rows
            if len(at):
                x = batch.column("x").take(pa.array(at)).flatten().to_numpy().reshape(len(at), -1)
                found = angles_to(x.astype(float), refs)
                for i, a, c in zip(at.tolist(), found, found.argmin(1).tolist()):
                    angles[i], cell[i] = a, c
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes), pa.array(angles, pa.list_(pa.float64())), pa.array(cell, pa.int32())], names=[*batch.schema.names, "size", "angles", "cell"])

    return rows.mapInArrow(run, schema)


def _in_blocks(rows: DataFrame, most: int, size: int) -> DataFrame:
    """rows with `block`, of about `most` rows of one length, and `ref`, the reference of its first cell.

    Cells of many rows are cut by a hash of the id, those of few lie together. Rows
    without a cell are cut by their lengths alone.
    """
    counts = checkpointed(rows.groupBy("size", "cell").agg(F.count("*").alias("n")))
    plan, block, room, ref = [], -1, 0, None
    for cell, n in counts.where(F.col("cell").isNotNull()).orderBy("cell").select("cell", "n").collect():  # a row for each reference
        parts = max(1, -(-n // most))
        if parts > 1 or n > room:
            block, room, ref = block + 1, most, cell
        plan.append((size, cell, block, parts, ref))
        block, room = block + parts - 1, 0 if parts > 1 else room - n
    planned = rows.sparkSession.createDataFrame(plan, "size int, cell int, _first int, _parts int, ref int")
    others = counts.where(F.col("cell").isNull()).select("size", "cell", F.lit(-1).alias("_first"), F.ceil(F.col("n") / most).cast("int").alias("_parts"), F.lit(None).cast("int").alias("ref"))
    dealt = broadcast_if_small(checkpointed(planned.unionByName(others)), BROADCAST_BLOCKS).withColumnsRenamed({"size": "_size", "cell": "_cell"})
    joined = rows.join(dealt, (F.col("size") == F.col("_size")) & F.col("cell").eqNullSafe(F.col("_cell")))
    part = F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int")
    return joined.withColumn("block", F.xxhash64("size", F.col("_first") + part)).drop("_size", "_cell", "_first", "_parts")


def _extents(rows: DataFrame, block: str, **more: Column) -> DataFrame:
    """(block, size, low, high, least, most, more): a block's ranges of angles to each reference and of norms."""
    of = lambda f: F.array(*[f(F.get("angles", F.lit(i))) for i in range(REFERENCES)])
    return rows.groupBy(block, "size").agg(of(F.min).alias("low"), of(F.max).alias("high"), F.min("norm").alias("least"), F.max("norm").alias("most"), *[c.alias(k) for k, c in more.items()])


def score_bounds(a: str, b: str) -> tuple[Column, Column]:
    """(lowest, highest) score of rows of two blocks, from their extents in the struct columns a and b, rounded outwards.

    References that a block has no angles to bound nothing.
    """
    each = F.zip_with(F.arrays_zip(f"{a}.low", f"{a}.high"), F.arrays_zip(f"{b}.low", f"{b}.high"), lambda x, y: F.struct(x["low"].alias("al"), x["high"].alias("ah"), y["low"].alias("bl"), y["high"].alias("bh")))
    gap = lambda p: F.coalesce(F.greatest(p["al"] - p["bh"], p["bl"] - p["ah"], F.lit(0.0)), F.lit(0.0))
    sums = lambda p: F.when(p["ah"] + p["bh"] <= np.pi, p["ah"] + p["bh"]).when(p["al"] + p["bl"] >= np.pi, 2 * np.pi - p["al"] - p["bl"]).otherwise(F.lit(np.pi))
    closest = F.greatest(F.array_max(F.transform(each, gap)) - 2 * ANGLE_ERROR, F.lit(0.0))
    farthest = F.least(F.array_min(F.transform(each, lambda p: F.coalesce(sums(p), F.lit(np.pi)))) + 2 * ANGLE_ERROR, F.lit(np.pi))
    large, small = F.col(f"{a}.most") * F.col(f"{b}.most"), F.col(f"{a}.least") * F.col(f"{b}.least")
    scaled = lambda cosine, up: F.when((cosine >= 0) == F.lit(up), cosine * large).otherwise(cosine * small)
    slack = large * SHARE_ERROR + 1
    return scaled(F.cos(farthest), False) - slack, scaled(F.cos(closest), True) + slack


def windows(beta: np.ndarray, norms: np.ndarray, alpha: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor (angle alpha, norm size) the range of rows, sorted by their angle beta to the same reference, whose bounds allow a score of low..high."""
    slack = size * norms.max() * SHARE_ERROR + 1
    share = np.clip((low - slack) / np.maximum(size * norms.max(), 1e-300), -1, 1)
    reach = np.where(share > 0, np.arccos(share), np.pi) + ANGLE_ERROR  # a negative score may come from any norm
    nearest = np.clip((high + slack) / np.maximum(size * norms.min(), 1e-300), -1, 1)
    start = np.maximum(alpha - reach, np.where(nearest > 0, np.arccos(nearest) - alpha, 0) - ANGLE_ERROR)
    first, stop = np.searchsorted(beta, start, "left"), np.searchsorted(beta, alpha + reach, "right")
    return first, np.maximum(first, stop)


def _searched(anchors: DataFrame, index: DataFrame, visits: DataFrame, found: Callable, schema: str) -> DataFrame:
    """What `found` gives for each anchor and window of rows, for the visits (ablock, block) of blocks of anchors to blocks of rows.

    anchors: with (ablock, low, high), the scores that they look for. found takes an
    anchor as a dictionary, and the ids, labels and scores of the rows of a window that
    holds its own; it gives tuples of the schema.
    """
    kinds = {"long": pa.int64(), "int": pa.int32()}
    fields = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            rows, asked = right.sort_by("beta").combine_chunks(), left.to_pylist()
            beta, norms, ids, labels = (rows.column(c).to_numpy() for c in ("beta", "norm", "id", "label"))
            x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            y = np.array([a["x"] for a in asked], np.int64).reshape(len(asked), -1)
            size = np.array([a["norm"] for a in asked])
            ref = rows.column("ref")[0].as_py()
            alpha = np.array([a["angles"][ref] if ref is not None else 0.0 for a in asked])
            low, high = (np.array([a[c] for a in asked]) for c in ("low", "high"))
            first, stop = windows(beta, norms, alpha, size, low, high) if ref is not None else (np.zeros(len(asked), int), np.full(len(asked), len(ids)))
            # sums of products below 2^53 are whole in doubles, in any order
            exact = float if size.max() * norms.max() < 2.0**53 else np.int64
            x, y = x.astype(exact), y.astype(exact)
            order = np.lexsort((stop, first))
            for i in range(0, len(order), TOGETHER):
                some = order[i : i + TOGETHER]
                a, b = int(first[some].min()), int(stop[some].max())
                if b > a:
                    scores = (y[some] @ x[a:b].T).astype(np.int64)
                    for j, s in zip(some.tolist(), scores):
                        out += found(asked[j], ids[a:b], labels[a:b], s)
        release_memory()
        return pa.Table.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(fields)], schema=fields)

    group = ["ablock", "block"]
    left = anchors.join(visits, "ablock").select(*group, "id", "label", "x", "norm", "angles", "low", "high", *[c for c in ("positives",) if c in anchors.columns])
    right = index.join(visits, "block").select(*group, "id", "label", "x", "norm", "ref", F.coalesce(F.get("angles", F.col("ref")), F.lit(0.0)).alias("beta"))
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(task, schema)


def _best(scored: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each group, with their `rank`; tasks hand on few for each group."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= most)


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors among the rows.

    A row's components become floor(256 * component), and its score with an anchor is
    their inner product. An anchor's positives are its first other rows of its label, by
    score, then by smaller id. For each positive, the first rows of other labels are
    returned whose score is between 50 and 95 hundredths of the positive's, both ends
    included. is_anchor and label, an integer, are computed from a row of vectors.

    Rows whose id, label or vector is null, or whose vector holds a null or non-finite
    component, take no part, nor do those whose integer vector is longer than the root of
    LARGEST, as scores may not fit a long. Only rows of one length meet. Where rows repeat
    an id, the first by label, then vector counts. Zero rows score 0. An anchor without
    positives, and a positive without negatives, give no rows. An empty table gives none.

    Every anchor meets all rows that the bounds of their blocks don't exclude, so nothing
    is missed; references from a bounded sample only decide how much is excluded.
    """
    rows = checkpointed(rows_taking_part(vectors, is_anchor, label.cast("long"), id_col, vector_col))
    drawn = [np.array(r["x"], float) for r in rows.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("x").collect()]
    sizes = [len(v) for v in drawn if v.any()]
    size = max(set(sizes), key=lambda n: (sizes.count(n), n)) if sizes else 0
    refs = references(np.array([v for v in drawn if len(v) == size and v.any()]))
    placed = checkpointed(_with_angles(rows, refs))
    index = checkpointed(_in_blocks(placed, BLOCK, size))
    anchors = _in_blocks(placed.where("asks"), ANCHOR_BLOCK, size).withColumnRenamed("block", "ablock").drop("ref")
    home = index.where("asks").select("id", "block")
    anchors = checkpointed(anchors.join(home, "id"))
    extents = checkpointed(_extents(index, "block"))
    infinite = float(LARGEST)

    def nearest(anchor: dict, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> list[tuple]:
        at = np.flatnonzero((labels == anchor["label"]) & (ids != anchor["id"]) & (scores >= anchor["low"]))
        if len(at) > positives:
            at = at[scores[at] >= np.partition(scores[at], len(at) - positives)[len(at) - positives]]
        at = at[np.lexsort((ids[at], -scores[at]))][:positives]
        return [(anchor["id"], int(ids[i]), int(scores[i])) for i in at.tolist()]

    def window(anchor: dict, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> list[tuple]:
        at = np.flatnonzero((labels != anchor["label"]) & (scores >= anchor["low"]) & (scores <= anchor["high"]))
        at, out = at[np.lexsort((ids[at], -scores[at]))], []
        for p in anchor["positives"]:
            s = scores[at]
            hit = at[(50 * p["score"] <= 100 * s) & (100 * s <= 95 * p["score"])][:negatives]
            out += [(anchor["id"], p["id"], p["score"], int(ids[i]), int(scores[i])) for i in hit.tolist()]
        return out

    def visiting(wanted: DataFrame) -> DataFrame:
        """(ablock, block): which blocks may hold scores that anchors of a block (low, high) look for."""
        asked = _extents(wanted, "ablock", low_score=F.min("low"), high_score=F.max("high"))
        asked = broadcast_if_small(checkpointed(asked), BROADCAST_BLOCKS).select("ablock", F.col("size").alias("_size"), F.struct("low", "high", "least", "most").alias("a"), "low_score", "high_score")
        pairs = extents.select("block", "size", F.struct("low", "high", "least", "most").alias("b")).join(asked, F.col("size") == F.col("_size"))
        lowest, highest = score_bounds("a", "b")
        return pairs.where((highest >= F.col("low_score")) & (lowest <= F.col("high_score"))).select("ablock", "block")

    order = [F.desc("score"), F.asc("positive_id")]
    hits = "id long, positive_id long, score long"
    # first the blocks that the anchors lie in, which tell how high a score has to be to count elsewhere
    own = checkpointed(anchors.select("ablock", "block").distinct())
    anchors = anchors.drop("block")
    open_ = anchors.withColumn("low", F.lit(-infinite)).withColumn("high", F.lit(infinite))
    seeds = checkpointed(_best(_searched(open_, index, own, nearest, hits), ["id"], order, positives))
    least = seeds.groupBy("id").agg(F.min("score").cast("double").alias("_least"), F.count("*").alias("_n")).where(F.col("_n") == positives).drop("_n")
    raised = checkpointed(open_.join(least, "id", "left").withColumn("low", F.coalesce("_least", "low")).drop("_least"))
    rest = checkpointed(visiting(raised).join(own, ["ablock", "block"], "left_anti"))
    more = _searched(raised, index, rest, nearest, hits)
    best = checkpointed(_best(seeds.drop("rank").unionByName(more), ["id"], order, positives))

    of = best.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.col("positive_id").alias("id"), "score"))).alias("positives"))  # a bounded number
    scores = F.transform("positives", lambda p: p["score"])
    wanted = anchors.join(of, "id").withColumn("low", F.array_min(scores) * 0.5 - 1).withColumn("high", F.array_max(scores) * 0.95 + 1)
    wanted = checkpointed(wanted.where(F.array_max(scores) >= 0))  # below 0 the two limits cross
    met = _searched(wanted, index, checkpointed(visiting(wanted)), window, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    found = _best(met, ["anchor_id", "positive_id"], [F.desc("negative_score"), F.asc("negative_id")], negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


ORACLE = {
    "op13_hard_negatives": """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL),
r AS (SELECT vec_id, label, list_transform(e, lambda x: CAST(floor(256 * x) AS BIGINT)) AS x FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id, CAST(list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * r.x[i])) AS BIGINT) AS score
  FROM r AS a JOIN r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 3""",
}
QUERIES = {"op13_hard_negatives": op13_hard_negatives}
