"""Near duplicates of embeddings by cross-polytope hashing with multiprobe buckets.

A vector is rotated by sign flips and fast Hadamard transforms, and hashed to the
nearest of the 2 d signed axes, a few rotations making up a table's bucket. It stands in
its own bucket and looks into the next likely ones. Pairs that meet are verified by
their exact cosine, block by block, and counted where they first meet; so what a task
hands on are counts and the links of a forest, never all pairs of a group.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm.ann import unit_rows
from undula.llm.components import connected_components
from undula.llm.shared import broadcast_if_small, checkpointed, release_memory, table, whole_groups

#: Buckets of a vector in a table: its own, and those it looks into.
PROBES = 2
#: The chance at most that a pair at the very threshold meets in no table; it sets the number of tables.
MISSED = 1e-6
#: Vectors of a label that are unlike each other and share a bucket, about, at most: it sets the number of rotations.
SHARED_BUCKET = 64
#: Rows of a bucket compared with one another at a time, and pairs handled at a time.
BLOCK, PAIRS_AT_ONCE = 2048, 1 << 18
#: Tables of buckets up to so many rows are broadcast.
BROADCAST_BUCKETS = 500_000
SEED = 12


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Hadamard transform of rows of a length that is a power of two, by sums and differences alone: equal rows give equal bits."""
    n, half = x.shape[1], 1
    while half < n:
        y = x.reshape(len(x), n // (2 * half), 2, half)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        half *= 2
    return x


def padded(v: np.ndarray) -> np.ndarray:
    """Rows scaled to a largest component of 1, with zeros up to a power of two."""
    n = 1 << max(0, (v.shape[1] - 1).bit_length())
    out = np.zeros((len(v), n))
    out[:, : v.shape[1]] = v / np.abs(v).max(1, keepdims=True)
    return out


def buckets(v: np.ndarray, tables: int, rotations: int, probes: int = PROBES) -> np.ndarray:
    """Rows by tables by probes: the codes of buckets, a row's own first, then those whose axes it is next nearest to."""
    x = padded(v)
    d, deep = x.shape[1], min(probes, x.shape[1])
    choices = np.array(sorted(itertools.product(range(deep), repeat=rotations), key=sum))
    out = np.zeros((len(x), tables, probes), np.int64)
    for t in range(tables):
        axes, loss = [], 0.0
        for r in range(rotations):
            y = x
            for flips in np.random.default_rng([SEED, t, r, d]).choice([-1.0, 1.0], (3, d)):
                y = hadamard(y * flips)
            size = np.abs(y)
            at = np.argsort(-size, axis=1, kind="stable")[:, :deep]
            top = np.take_along_axis(size, at, 1)
            loss = loss + ((top[:, :1] - top) ** 2)[:, choices[:, r]]
            axes.append(2 * at + (np.take_along_axis(y, at, 1) < 0))
        best = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        for r in range(rotations):
            code = np.take_along_axis(axes[r], choices[best][:, :, r], 1)
            out[:, t, : code.shape[1]] = out[:, t, : code.shape[1]] * (2 * d) + code
        out[:, t, best.shape[1] :] = out[:, t, :1]  # fewer axes than probes
    return out


def meet(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether rows of buckets meet, table by table: one's own is among the other's."""
    return (x[..., :1] == y).any(-1) | (y[..., :1] == x).any(-1)


def tables_for(dimensions: int, rotations: int, similarity: float, missed: float = MISSED) -> int:
    """Tables after which at most a share `missed` of pairs of just this similarity has met in none, by drawn pairs."""
    rng, n = np.random.default_rng(SEED), 4000
    x = rng.standard_normal((n, dimensions))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((n, dimensions))
    z -= (z * x).sum(1, keepdims=True) * x
    size = np.linalg.norm(z, axis=1, keepdims=True)
    z = np.divide(z, size, out=np.zeros_like(z), where=size > 1e-9)  # in one dimension there is no other direction
    y = similarity * x + math.sqrt(max(0.0, 1 - similarity * similarity)) * z
    met = meet(buckets(x, 1, rotations), buckets(y, 1, rotations)).mean()
    return max(1, math.ceil(math.log(missed) / math.log(max(1 - met, 1e-9))))


def exact_cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows with rows, each summed in one order, the same either way round."""
    x, y = x / np.abs(x).max(1, keepdims=True), y / np.abs(y).max(1, keepdims=True)
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def _similar_pairs(v: np.ndarray, part: np.ndarray, own: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of similar rows of a bucket, of which one is at home there; rows of two parts are compared across only."""
    u, two = unit_rows(v), part[0] != part[-1]
    first = np.flatnonzero(part == part[0])
    left = first if two else np.arange(len(v))
    right = np.flatnonzero(part != part[0]) if two else left
    found = []
    for i in range(0, len(left), 512):
        rows = left[i : i + 512]
        c = u[rows] @ u[right].T
        a, b = np.nonzero((c >= similarity - 1e-9) & (own[rows][:, None] | own[right][None]))
        near, a, b = c[a, b] < similarity + 1e-9, rows[a], right[b]
        keep = np.ones(len(a), bool) if two else a < b
        edge = np.flatnonzero(keep & near)
        for k in range(0, len(edge), PAIRS_AT_ONCE):
            e = edge[k : k + PAIRS_AT_ONCE]
            keep[e] = exact_cosines(v[a[e]], v[b[e]]) >= similarity
        found.append(np.stack([a[keep], b[keep]]))
    return tuple(np.concatenate(found, 1))


def _first_meeting(codes: np.ndarray, a: np.ndarray, b: np.ndarray, at: np.ndarray, a_home: np.ndarray) -> np.ndarray:
    """Whether pairs of rows (a, b) of codes, met in a bucket of table `at`, meet there first; a_home: the bucket is a's own.

    Of the two buckets of a table in which they can meet, a's own comes first.
    """
    out = np.empty(len(a), bool)
    for i in range(0, len(a), PAIRS_AT_ONCE):
        s = slice(i, i + PAIRS_AT_ONCE)
        x, y, t = codes[a[s]], codes[b[s]], at[s]
        first = meet(x, y).argmax(1) == t
        rows = np.arange(len(t))
        in_a_home = (x[rows, t, :1] == y[rows, t]).any(1)
        out[s] = first & (a_home[s] | ~in_a_home)
    return out


def _stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n rows, the first row that the pairs connect it with."""
    label = np.arange(n)
    while True:
        was = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == was).all():
            return label


def similar_links(nodes: DataFrame, similarity: float, tables: int, rotations: int) -> DataFrame:
    """(node, other, n): for nodes (node, grp, v, weight) of one grp, how much weight is linked to a node, with other null,
    and links that connect what all links connect, with n null. A node's weights come in several rows, to be added.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, grp, size = (batch.column(c).to_numpy() for c in ("node", "grp", "size"))
            vectors = batch.column("v")
            for d in np.unique(size).tolist():
                at = np.flatnonzero(size == d)
                v = vectors.take(pa.array(at)).flatten().to_numpy().reshape(-1, d)
                codes = buckets(v, tables, rotations)
                t = np.broadcast_to(np.arange(tables)[None, :, None], codes.shape)
                mixed = (grp[at][:, None, None].view(np.uint64) ^ (codes * tables + t).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                own = np.broadcast_to(np.arange(PROBES) == 0, codes.shape)
                once = (own | (codes != codes[:, :, :1])).ravel()
                columns = (mixed.view(np.int64).ravel(), np.repeat(node[at], tables * PROBES), t.astype(np.int32).ravel(), own.ravel())
                yield pa.RecordBatch.from_arrays([pa.array(c[once]) for c in columns], names=["key", "node", "tab", "own"])

    keyed = checkpointed(nodes.select("node", "grp", F.size("v").alias("size"), "v").mapInArrow(hashed, "key long, node long, tab int, own boolean"))
    live = keyed.groupBy("key").agg(F.count("*").alias("n"), F.max("own").alias("own")).where("n > 1 and own")
    live = broadcast_if_small(checkpointed(live.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))), BROADCAST_BUCKETS)
    dealt = keyed.join(live, "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("key", F.least("part", "_other").cast("long").alias("x"), F.greatest("part", "_other").cast("long").alias("y"), "part", "node", "tab", "own")
    rows = dealt.join(nodes, "node").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "part", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["key", "x", "y"]):
            key, x, y, part, node, tab, own, grp, weight = (rows.column(c).to_numpy() for c in ("key", "x", "y", "part", "node", "tab", "own", "grp", "weight"))
            vectors = rows.column("v").combine_chunks()
            size, changed = np.diff(vectors.offsets.to_numpy()), (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            starts, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], changed, [True]]))
            for i, j in zip(cuts.tolist(), cuts[1:].tolist()):
                if j - i < 2:
                    continue
                # keys are hashes: what is not of one group meets by chance
                for d, g in dict.fromkeys(zip(size[i:j].tolist(), grp[i:j].tolist())):
                    at = i + np.flatnonzero((size[i:j] == d) & (grp[i:j] == g))
                    if len(at) < 2 or (x[i] != y[i] and part[at[0]] == part[at[-1]]):
                        continue
                    v = np.stack([flat[starts[k] : starts[k] + d] for k in at.tolist()])
                    a, b = _similar_pairs(v, part[at], own[at], similarity)
                    if not len(a):
                        continue
                    a, b = np.where(node[at[a]] < node[at[b]], a, b), np.where(node[at[a]] < node[at[b]], b, a)
                    used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
                    first = _first_meeting(buckets(v[used], tables, rotations), place[: len(a)], place[len(a) :], tab[at[a]], own[at[a]])
                    a, b = a[first], b[first]
                    linked = np.bincount(a, weight[at[b]], len(at)) + np.bincount(b, weight[at[a]], len(at))
                    star = _stars(len(at), a, b)
                    hit, far = np.flatnonzero(linked), np.flatnonzero(star != np.arange(len(at)))
                    of, to = node[at], np.concatenate([np.zeros(len(hit), np.int64), node[at][star[far]]])
                    is_count = np.arange(len(to)) < len(hit)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([of[hit], of[far]])), pa.array(to, mask=is_count), pa.array(np.concatenate([linked[hit].astype(np.int64), np.zeros(len(far), np.int64)]), mask=~is_count)], names=["node", "other", "n"])
        release_memory()

    return checkpointed(rows.mapInArrow(run, "node long, other long, n long"))


def embedding_components(vectors: DataFrame, similarity: float = 0.98, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) for every id of vectors: links are pairs of one label with a cosine of `similarity` or more.

    Needs an id, a label and a vector; other columns are not read. A vector whose label is
    null, or which is null, zero or holds a null or a non-finite component, links with
    nothing, and neither do vectors of different lengths. Where rows repeat an id, the
    first of those that can link counts, by label, then vector. Rows without an id are one
    row of id null that links with nothing. An empty table gives no rows.

    Equal vectors of a label are one node with their count as weight, named by their
    smallest id. The number of tables is such that a pair of just this similarity is
    missed with a chance of MISSED at most, whatever the size of the table; nearer pairs
    are missed less. Links are verified in doubles.
    """
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    usable = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)
    rows = vectors.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(F.when(usable, F.struct(F.col(label_col).alias("label"), v.alias("v")))).alias("s"))
    # copies are told by 128 bits of label and vector
    rows = rows.select("id", F.when(F.col("s").isNotNull(), F.xxhash64("s")).alias("h1"), F.when(F.col("s").isNotNull(), F.xxhash64(F.lit(SEED), "s")).alias("h2"), F.xxhash64("s.label", F.size("s.v")).alias("grp"), F.col("s.v").alias("v"))
    rows = checkpointed(rows)
    nodes = checkpointed(rows.where("h1 is not null").groupBy("h1", "h2").agg(F.min("id").alias("node"), F.count("*").alias("weight"), F.first("grp").alias("grp"), F.first("v").alias("v")))
    largest = nodes.groupBy("grp").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).agg(F.max("n").alias("n"), F.max("d").alias("d"), F.min("d").alias("least")).first()
    d = largest["d"] or 1
    axes = 2 << max(0, (d - 1).bit_length())
    rotations = max(2, math.ceil(math.log(max(largest["n"] or 1, SHARED_BUCKET) / SHARED_BUCKET) / math.log(axes)))
    tables = max(tables_for(size, rotations, similarity) for size in {d, largest["least"] or 1})
    found = similar_links(nodes.select("node", "grp", "v", "weight"), similarity, tables, rotations)
    linked = found.where("other is null").groupBy("node").agg(F.sum("n").alias("n"))
    components = connected_components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = nodes.select("h1", "h2", "node", "weight").join(linked, "node", "left").join(components, "node", "left")
    named = named.select("h1", "h2", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = rows.select("id", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op12_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


ORACLE = {
    "op12_embedding_dups": """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v AS x JOIN v AS y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
reach AS (SELECT vec_id, vec_id AS other FROM v UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.other = links.a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT reach.vec_id, coalesce(max(n.n), 0) AS n_links, min(other) AS component_id, reach.vec_id = min(other) AS kept FROM reach LEFT JOIN n ON n.a = reach.vec_id GROUP BY reach.vec_id""",
}
QUERIES = {"op12_embedding_dups": op12_embedding_dups}
