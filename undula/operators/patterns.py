"""Patterns: clusters, gradients, communities and permutation inference."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from undula.functions.dense import leading_communities
from undula.operators.families import array_moments
from undula.operators.moments import correlation_matrix
from undula.operators.panel import zscored
from undula.operators.statistics import midpoint_percentile
from undula.sources.staging import written


def row_vectors(matrix: DataFrame, value: str = "r") -> DataFrame:
    """(i, row): each channel's row of a full matrix (i, j, value) as a vector in channel order; null as 0."""
    cells = matrix.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", F.coalesce(value, F.lit(0.0)).alias("v")))).alias("c"))
    return cells.select("i", array_to_vector(F.transform("c", lambda x: x["v"])).alias("row"))


def clusters(vectors: DataFrame, k: int, replicates: int = 10, seed: int = 321) -> DataFrame:
    """vectors (id columns, row) with `cluster` from 1: squared Euclidean k-means, the replicate of least cost."""
    vectors = written(vectors)  # read by every fit
    fits = [KMeans(featuresCol="row", predictionCol="cluster", k=k, maxIter=1000, seed=seed + i).fit(vectors) for i in range(replicates)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    return best.transform(vectors).withColumn("cluster", F.col("cluster") + 1)


def gradients(vectors: DataFrame, components: int = 5) -> DataFrame:
    """(id columns, score): principal-component scores of centred rows; a component's largest loading is positive."""
    mean = vectors.select(F.posexplode(vector_to_array("row")).alias("p", "x")).groupBy("p").agg(F.avg("x").alias("m"))
    centre = mean.agg(F.array_sort(F.collect_list(F.struct("p", "m"))).alias("_c"))
    centred = vectors.join(F.broadcast(centre)).withColumn("row", array_to_vector(F.zip_with(vector_to_array("row"), F.transform("_c", lambda x: x["m"]), lambda a, b: a - b))).drop("_c")
    model = PCA(k=components, inputCol="row", outputCol="_s").fit(centred)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(0), np.arange(loadings.shape[1])])
    fixed = F.array(*[F.lit(float(s)) for s in signs])
    return model.transform(centred).withColumn("score", F.zip_with(vector_to_array("_s"), fixed, lambda a, b: a * b)).drop("_s", "row")


#: Nodes of a matrix that the driver solves at most: 128 MB of doubles.
DENSE_NODES = 4096


def communities(matrix: DataFrame, value: str = "r") -> DataFrame:
    """(i, community) by spectral modularity with tuned splits, of a matrix of channels by channels.

    The driver solves it, and refuses more than DENSE_NODES nodes, which are counted first.
    """
    nodes = matrix.select("i").union(matrix.select("j")).distinct().limit(DENSE_NODES + 1).count()
    if nodes > DENSE_NODES:
        raise ValueError(f"communities of more than {DENSE_NODES} nodes are not solved on the driver")
    m = matrix.select("i", "j", value).toPandas()
    wide = m.pivot_table(index="i", columns="j", values=value, fill_value=0.0)
    names = sorted(set(wide.index) | set(wide.columns))
    w = wide.reindex(index=names, columns=names).fillna(0.0).to_numpy(float)
    np.fill_diagonal(w, 0)
    found = leading_communities((w + w.T) / 2)
    return matrix.sparkSession.createDataFrame(pd.DataFrame({"i": names, "community": found}))


#: Nodes of a graph whose edges stay in tasks: the driver holds a vector of them for each step of the eigenvector.
SPREAD_NODES = 1_000_000


def spread_communities(matrix: DataFrame, value: str = "r", steps: int = 30, seed: int = 1) -> DataFrame:
    """(i, community) by spectral modularity, of graphs too large for one machine's matrix.

    matrix: (i, j, value), either or both ways round; null and the diagonal count as 0.
    Every community of a level is split at once: `steps` Lanczos steps for the leading
    eigenvector of each, then changes of side while modularity grows. A step is one job,
    in which tasks multiply their edges by a vector of nodes; no edge leaves its task, and
    the driver holds vectors of at most SPREAD_NODES nodes, which are counted first. A
    split is a local optimum of single changes of side, where `communities` also tries
    sequences of them.
    """
    spark = matrix.sparkSession
    cells = matrix.where(F.col("i") != F.col("j")).select("i", "j", F.col(value).cast("double").alias("w")).where("w <> 0")
    nodes = matrix.select("i").union(matrix.select("j")).where("i is not null").distinct()
    if (size := nodes.count()) > SPREAD_NODES:
        raise ValueError(f"communities of {size} nodes, more than {SPREAD_NODES}")
    names = nodes.orderBy("i").toPandas()["i"]
    kind = dict(nodes.dtypes)["i"]
    if not size:
        return spark.createDataFrame([], f"i {kind}, community int")
    named = spark.createDataFrame(pd.DataFrame({"name": names, "p": np.arange(size, dtype=np.int32)}), f"name {kind}, p int")
    half = cells.join(named.select(F.col("name").alias("i"), F.col("p").alias("a")), "i").join(named.select(F.col("name").alias("j"), F.col("p").alias("b")), "j").select("a", "b", (F.col("w") / 2).alias("w"))
    both = half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.sum("w").alias("w"))
    edges = written(both.repartitionByRange("a", "b").sortWithinPartitions("a", "b"))

    def products(v: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Edges within groups, times v."""
        sent = spark.sparkContext.broadcast((v, group))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v, group = sent.value
            for batch in batches:
                a, b, w = (batch.column(c).to_numpy() for c in "abw")
                inside = group[a] == group[b]
                at, place = np.unique(a[inside], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.bincount(place, w[inside] * v[b[inside]], len(at)))], names=["a", "y"])

        sums = edges.mapInArrow(run, "a int, y double").groupBy("a").agg(F.sum("y").alias("y")).toPandas()  # one for each node
        sent.destroy()
        out = np.zeros(size)
        out[sums["a"]] = sums["y"]
        return out

    group, open_ = np.zeros(size, int), np.ones(1, bool)
    degree = products(np.ones(size), group)
    total, random = degree.sum(), np.random.default_rng(seed)
    while total and open_.any():
        live, count = open_[group], len(open_)
        per_group = lambda x: np.bincount(group, x, count)
        level = np.where(live, group, -1 - np.arange(size))  # closed groups have no edges inside
        rest = products(np.ones(size), level) - degree * per_group(degree * live)[group] / total

        def apply(v: np.ndarray) -> np.ndarray:
            return np.where(live, products(v, level) - degree * per_group(degree * v)[group] / total - rest * v, 0.0)

        s = np.where(_leading(apply, np.where(live, random.standard_normal(size), 0.0), group, count, steps) >= 0, 1.0, -1.0)
        s = _tuned(apply, s, np.where(live, -degree * degree / total - rest, 0.0), group, count, random)
        gained, side = per_group(s * apply(s)), per_group(s > 0)
        splits = open_ & (gained > 1e-10) & (side > 0) & (side < np.bincount(group, minlength=count))
        kept, group = np.unique(2 * group + (splits[group] & (s > 0)), return_inverse=True)
        open_ = splits[kept // 2]
    return spark.createDataFrame(pd.DataFrame({"i": names, "community": (group + 1).astype(np.int32)}), f"i {kind}, community int")


def _leading(apply: Callable[[np.ndarray], np.ndarray], start: np.ndarray, group: np.ndarray, count: int, steps: int) -> np.ndarray:
    """The eigenvector of the largest eigenvalue of each group's block, by Lanczos steps with full orthogonalisation."""
    dot = lambda x, y: np.bincount(group, x * y, count)
    unit = lambda x, n: np.divide(x, n[group], out=np.zeros_like(x), where=n[group] > 0)
    steps = max(1, min(steps, int(np.bincount(group).max())))
    q = unit(start, np.sqrt(dot(start, start)))
    basis, t = [], np.zeros((count, steps, steps))
    for p in range(steps):
        basis.append(q)
        r = apply(q)
        t[:, p, p] = dot(q, r)
        scale = np.sqrt(dot(r, r))
        for _ in range(2):
            for x in basis:
                r = r - dot(x, r)[group] * x
        beta = np.sqrt(dot(r, r))
        beta = np.where(beta > 1e-9 * scale, beta, 0.0)
        if p + 1 == steps or not beta.any():
            break
        t[:, p, p + 1] = t[:, p + 1, p] = beta
        q = unit(np.where(beta[group] > 0, r, 0.0), beta)
    _, vectors = np.linalg.eigh(t)
    return sum(x * vectors[group, p, -1] for p, x in enumerate(basis))


def _tuned(apply: Callable[[np.ndarray], np.ndarray], s: np.ndarray, own: np.ndarray, group: np.ndarray, count: int, random: np.random.Generator) -> np.ndarray:
    """Sides after changes of side while s'Bs grows in every group: a random share of the nodes that gain, halved while that fails, and at last the best one alone."""
    y = apply(s)
    score, share, done = np.bincount(group, s * y, count), np.full(count, 0.5), np.zeros(count, bool)
    while True:
        gain = -4 * s * (y - own * s)
        gains = (gain > 1e-9) & ~done[group]
        if not gains.any():
            return s
        order = np.lexsort((-gain, group))
        best = np.zeros(len(s), bool)
        best[order[np.unique(group[order], return_index=True)[1]]] = True
        alone = share * np.bincount(group, gains, count) < 1
        moved = gains & (best | (~alone[group] & (random.random(len(s)) < share[group])))
        new = np.where(moved, -s, s)
        after = apply(new)
        better = np.bincount(group, new * after, count) > score
        s, y = np.where(better[group], new, s), np.where(better[group], after, y)
        done |= alone & ~better  # rounding: what is left gains nothing
        score, share = np.bincount(group, s * y, count), np.where(better, 0.5, share / 2)


def seed_frames(panel: DataFrame, seeds: list[int], keys: list[str], percent: float = 85, most: int = 200, seed: int = 1) -> DataFrame:
    """(keys, t) of frames whose mean over seed channels is above that percentile of the session; of more than `most`, those with the smallest hashes."""
    signal = panel.where(F.col("channel").isin(*seeds)).groupBy(*keys, "t").agg(F.avg("value").alias("value"))
    above = signal.join(midpoint_percentile(signal, "value", percent, keys), keys).where(F.col("value") > F.col("percentile"))
    order = Window.partitionBy(*keys).orderBy(F.xxhash64(*keys, "t", F.lit(seed)))
    return above.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).select(*keys, "t")


def coactivation_patterns(panel: DataFrame, seeds: list[int], keys: list[str], k: int = 8, replicates: int = 5) -> DataFrame:
    """(cluster, n, pattern): k-means centres, in channel order, of the z-scored frames that seed_frames picks."""
    scored = zscored(panel, keys)
    frames = scored.join(seed_frames(scored, seeds, keys), [*keys, "t"]).groupBy(*keys, "t").agg(F.array_sort(F.collect_list(F.struct("channel", "value"))).alias("c"))
    found = clusters(frames.select(*keys, "t", array_to_vector(F.transform("c", lambda x: x["value"])).alias("row")), k, replicates, seed=684)
    each = found.select("cluster", F.posexplode(vector_to_array("row")).alias("p", "x")).groupBy("cluster", "p").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return each.groupBy("cluster").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda v: v["x"]).alias("pattern"))


def area_gradients(matrix: DataFrame, areas: DataFrame, value: str = "r", components: int = 5) -> DataFrame:
    """(area, i, component, score): gradients of each area by how alike its channels correlate with those outside.

    matrix: full (i, j, value); areas: (area, channel), which may overlap. Rows of an area's
    channels over the channels outside are correlated with each other, and the scores are
    principal components of that matrix, of which a task holds one of an area's size. A
    component's largest loading is positive; channels whose row is constant take no part.
    """
    inside = areas.select("area", F.col("channel").alias("i"))
    rows = matrix.join(inside, "i").join(areas.select("area", F.col("channel").alias("j")), ["area", "j"], "left_anti")
    pairs = correlation_matrix(rows.select("area", F.col("i").alias("channel"), F.col("j").alias("t"), F.col(value).alias("value")), ["area"]).where("r is not null")

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(rows[["i", "j"]].to_numpy())
        s = np.eye(len(names))
        at = [np.searchsorted(names, rows[c]) for c in "ij"]
        s[at[0], at[1]] = s[at[1], at[0]] = rows["r"]
        centred = s - s.mean(0)
        _, _, loadings = np.linalg.svd(centred, full_matrices=False)
        loadings = loadings[:components].T
        loadings = loadings * np.sign(loadings[np.abs(loadings).argmax(0), np.arange(loadings.shape[1])])
        scores = centred @ loadings
        return pd.DataFrame({"area": rows["area"].iat[0], "i": np.repeat(names, scores.shape[1]), "component": np.tile(np.arange(1, scores.shape[1] + 1), len(names)), "score": scores.ravel()})

    kinds = dict(pairs.dtypes)
    return pairs.groupBy("area").applyInPandas(solve, f"area {kinds['area']}, i {kinds['i']}, component int, score double")


def first_components(vectors: DataFrame, variance: float) -> tuple[DataFrame, np.ndarray]:
    """(vectors with `scores`, loadings): principal-component scores of the centred rows, of the first components that hold this share of their variance."""
    rows = vectors.withColumn("_x", vector_to_array("row"))
    size = len(rows.select("_x").first()[0])
    s, n = array_moments(rows.select(F.concat(F.array(F.lit(1.0)), "_x").alias("x")), size + 1)
    mean = s[0, 1:] / n
    values, loadings = np.linalg.eigh(s[1:, 1:] / n - np.outer(mean, mean))
    values, loadings = values[::-1].clip(0), loadings[:, ::-1]
    k = int(np.searchsorted(np.cumsum(values) / values.sum(), variance)) + 1
    loadings = loadings[:, :k] * np.sign(loadings[np.abs(loadings[:, :k]).argmax(0), np.arange(k)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("_x").flatten().to_numpy().reshape(-1, size)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([*((x - mean) @ loadings)], pa.list_(pa.float64()))], names=[*batch.schema.names[:-1], "scores"])

    keys = [c for c in rows.columns if c not in ("row", "_x")]
    kinds = dict(rows.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in keys] + ["scores array<double>"])
    return rows.select(*keys, "_x").mapInArrow(run, schema), loadings


def coactivation_frames(panel: DataFrame, seeds: list[int], keys: list[str], k: int = 8, replicates: int = 5, variance: float = 0.999) -> tuple[DataFrame, np.ndarray]:
    """((keys, t, scores, cluster), loadings): the frames that seed_frames picks, z-scored, reduced to components and clustered by k-means."""
    scored = written(zscored(panel, keys))
    cells = scored.join(seed_frames(scored, seeds, keys), [*keys, "t"]).groupBy(*keys, "t").agg(F.array_sort(F.collect_list(F.struct("channel", "value"))).alias("c"))
    frames = written(cells.select(*keys, "t", F.transform("c", lambda x: x["value"]).alias("_v")))
    reduced, loadings = first_components(frames.select(*keys, "t", array_to_vector("_v").alias("row")), variance)
    found = clusters(reduced.withColumn("row", array_to_vector("scores")), k, replicates, seed=684)
    return found.drop("row"), loadings


def coactivation_profiles(frames: DataFrame, loadings: np.ndarray) -> DataFrame:
    """(cluster, n, pattern): cluster means of scores, brought back to channels without adding the mean of all frames again."""
    each = frames.select("cluster", F.posexplode("scores").alias("p", "x")).groupBy("cluster", "p").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    centres = each.groupBy("cluster").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("p", "x"))).alias("c")).collect()  # one for each cluster
    rows = [(r["cluster"], r["n"], (loadings @ np.array([c["x"] for c in r["c"]])).tolist()) for r in centres]
    return frames.sparkSession.createDataFrame(rows, "cluster int, n long, pattern array<double>")


def storey_q(p: np.ndarray) -> np.ndarray:
    """q-values of a bounded list of p-values; the share of true nulls is the least over the grid 0.05 .. 0.9 of mean(p > l) / (1 - l)."""
    p = np.asarray(p, float)
    grid = np.arange(0.05, 0.91, 0.05)
    nulls = min(1.0, max(min((p > g).mean() / (1 - g) for g in grid), 1 / max(len(p), 1)))
    order = np.argsort(p)
    q = nulls * p[order] * len(p) / np.arange(1, len(p) + 1)
    out = np.empty(len(p))
    out[order] = np.minimum.accumulate(q[::-1])[::-1]
    return np.minimum(out, 1)


def max_t_permutations(spark, x: np.ndarray, y: np.ndarray, n: int = 10_000, seed: int = 1) -> DataFrame:
    """(permutation, max_t): largest |t| over columns of x of its regression on y, y permuted; x, y: subjects by variables, bounded tables."""
    x, y = x - x.mean(0), y - y.mean()

    def run(batches):
        for ids in batches:
            out = []
            for i in ids["id"]:
                p = np.random.default_rng([seed, int(i)]).permutation(y)
                r = x.T @ p / np.sqrt((x * x).sum(0) * (p @ p))
                out.append(float(np.abs(r * np.sqrt((len(y) - 2) / np.maximum(1 - r * r, 1e-300))).max()))
            yield pd.DataFrame({"permutation": ids["id"], "max_t": out})

    return spark.range(n).mapInPandas(run, "permutation long, max_t double")
