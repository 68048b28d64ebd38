"""Approximate nearest neighbours by a hash-prefix forest.

Every tree writes a vector as a string of 64 hash bits, the sides of random
hyperplanes, and keeps the strings as a sorted array. A query descends in every tree
to its longest matching prefix; from the longest on all trees then ascend together,
taking in the vectors that share ever shorter prefixes, until there are candidates
enough. The index is cut into cells, each with a forest of its own, that tasks search
by themselves. The first bits of one further tree name a vector's cell, in which it
stands once; a query visits its own cell and those whose bits differ where it is close
to the hyperplane.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from undula.llm.shared import broadcast_if_small, checkpointed, table

#: Vectors in a cell and queries in a block, about: they bound a task's memory.
CELL, QUERY_BLOCK = 8192, 8192
TREES, DEPTH = 48, 64
#: The forest is fitted on at most so many vectors, those with the smallest hashes of their ids, and so many queries among them.
FIT_ROWS, FIT_QUERIES = 2000, 250
#: The share of neighbours that the cells visited, and the candidates taken in a cell, have to hold in the fit, each.
TARGET = 0.97
#: The most bits that name a cell; cells that get too large are searched in parts.
MOST_BITS = 18
#: Tables of cells up to so many rows are broadcast.
BROADCAST_CELLS = 500_000
SEED = 20


def planes(dimensions: int, bits: int, seed: int = SEED) -> np.ndarray:
    """Hyperplanes, alike for every task."""
    return np.random.default_rng(seed).standard_normal((dimensions, bits))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one; the largest component is divided out first, so that lengths neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def hash_strings(unit: np.ndarray, normals: np.ndarray) -> np.ndarray:
    """One 64-bit string for each vector and tree, its first bit the highest."""
    out = np.empty((len(unit), normals.shape[1] // DEPTH), np.uint64)
    for i in range(0, len(unit), 1024):
        sides = (unit[i : i + 1024] @ normals > 0).reshape(-1, out.shape[1], DEPTH)
        out[i : i + 1024] = np.packbits(sides, axis=2).view(">u8")[:, :, 0]
    return out


class Forest:
    """The sorted hash strings of one cell."""

    def __init__(self, strings: np.ndarray):
        self.order = np.argsort(strings, axis=0, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, 0)

    def ranges(self, queries: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query and tree, the places of the strings that share `length` leading bits."""
        n_trees = self.sorted.shape[1]
        rest = np.uint64((1 << (DEPTH - length)) - 1)
        low = np.stack([np.searchsorted(self.sorted[:, t], queries[:, t] & ~rest, "left") for t in range(n_trees)], 1)
        high = np.stack([np.searchsorted(self.sorted[:, t], queries[:, t] | rest, "right") for t in range(n_trees)], 1)
        return low, high

    def longest(self, queries: np.ndarray) -> int:
        """The longest prefix that any query shares with a string of its tree: a neighbour of its place holds it."""
        low, _ = self.ranges(queries, DEPTH)
        trees = np.arange(self.sorted.shape[1])
        apart = [queries ^ self.sorted[np.clip(low + d, 0, len(self.order) - 1), trees] for d in (-1, 0)]
        return DEPTH - int(np.minimum(*apart).min()).bit_length()

    def candidates(self, queries: np.ndarray, wanted: int) -> np.ndarray:
        """For each query, a mask of vectors: those of the longest prefixes that give `wanted` of them, trees ascending together."""
        masks, open_ = np.zeros((len(queries), len(self.order)), bool), np.arange(len(queries))
        trees = np.arange(self.sorted.shape[1])
        low, high = self.ranges(queries, DEPTH)
        high = low.copy()  # nothing is taken in yet
        for length in range(self.longest(queries), -1, -1):
            first, last = self.ranges(queries[open_], length)
            # what the shorter prefixes add on either side of what is in, of all queries and trees at once
            starts, stops = np.stack([first, high[open_]]), np.stack([low[open_], last])
            size = (stops - starts).ravel()
            at = np.repeat(starts.ravel() - (np.cumsum(size) - size), size) + np.arange(size.sum())
            of = np.broadcast_to(open_[None, :, None], starts.shape).ravel()
            tree = np.broadcast_to(trees, starts.shape).ravel()
            masks[np.repeat(of, size), self.order[at, np.repeat(tree, size)]] = True
            low[open_], high[open_] = first, last
            open_ = open_[masks[open_].sum(1) < wanted]
            if not len(open_):
                break
        return masks


def cell_bits(n: int) -> int:
    """Bits that name cells of about CELL of n vectors."""
    return min(MOST_BITS, max(0, math.ceil(math.log2(max(n, 1) / CELL))))


def _patterns(bits: int) -> np.ndarray:
    """All patterns of so many bits, as numbers from 0 on, by bits."""
    return (np.arange(1 << bits)[:, None] >> np.arange(bits) & 1).astype(float)


def cells_of(unit: np.ndarray, bits: int, probes: int = 1) -> np.ndarray:
    """Rows by probes: a vector's own cell, then those that its distances to the hyperplanes make likeliest for a neighbour."""
    sides = unit @ planes(unit.shape[1], bits, SEED + 1)
    own = (sides > 0) @ (1 << np.arange(bits))
    if probes == 1 or not bits:
        return own[:, None].astype(np.int32)
    if probes >= 1 << bits:
        return np.broadcast_to(np.arange(1 << bits, dtype=np.int32), (len(unit), 1 << bits))
    out, step, patterns = np.empty((len(unit), probes), np.int32), max(1, (1 << 22) >> bits), _patterns(bits)
    for i in range(0, len(unit), step):
        cost = sides[i : i + step] ** 2 @ patterns.T
        out[i : i + step] = np.argpartition(cost, probes - 1, 1)[:, :probes] ^ own[i : i + step, None]
    return out


def fit(unit: np.ndarray, k: int, bits: int = 0) -> tuple[float, int]:
    """(share, probes) fitted on a sample of unit vectors: each holds TARGET of the k nearest of a vector.

    share: the least part of a cell that the trees have to take in as candidates. probes:
    the least number of cells to visit, of those that `bits` hyperplanes make.
    """
    n = len(unit)
    if n < 2:
        return 1.0, 1 << bits
    asked = np.arange(0, n, max(1, n // FIT_QUERIES))
    cosine = unit[asked] @ unit.T
    cosine[np.arange(len(asked)), asked] = -2
    near = np.argsort(-cosine, 1, kind="stable")[:, : min(k, n - 1)]
    strings = hash_strings(unit, planes(unit.shape[1], TREES * DEPTH))
    sides = unit @ planes(unit.shape[1], bits, SEED + 1)
    shares, ranks, patterns = [], [], _patterns(bits)
    for q, own in zip(asked.tolist(), near):
        # the smallest difference of a vector's strings tells its longest prefix; a neighbour needs those of longer ones to be too few
        apart = (strings ^ strings[q]).min(1)
        shares += [int((apart < np.uint64((1 << int(d).bit_length()) >> 1)).sum()) + 1 for d in apart[own]]
        cost = patterns @ sides[q] ** 2
        ranks += [int((cost < cost[d]).sum()) + 1 for d in ((sides[own] > 0) ^ (sides[q] > 0)) @ (1 << np.arange(bits))]
    reach = lambda x: np.quantile(x, TARGET, method="higher")
    return float(min(1.0, reach(shares) / n)), int(reach(ranks))


def usable(vectors: DataFrame, is_query: Column, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, q): one row for each id with a vector that is all finite and not zero, as doubles."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(~bad & F.exists("v", lambda x: x != 0))
    return rows.groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q"))


def _placed(rows: DataFrame, bits: int, probes: int) -> DataFrame:
    """rows (size, id, v, ...) with `cells`: a vector's own cell first, then others to visit."""
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in rows.columns) + ", cells array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, cells = batch.column("size").to_numpy(), [None] * batch.num_rows
            for d in np.unique(size).tolist():
                at = np.flatnonzero(size == d)
                found = cells_of(unit_rows(batch.column("v").take(pa.array(at)).flatten().to_numpy().reshape(-1, d)), bits, probes)
                for i, c in zip(at.tolist(), found):
                    cells[i] = c
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

    return rows.mapInArrow(run, schema)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k nearest found for each query row, by cosine.

    is_query selects the queries among the rows; candidates are all rows but those of
    the query's id. Vectors that are null, zero, or hold a null or a non-finite
    component take no part; only vectors of the query's length are compared. Score is
    the cosine of the original vectors in doubles, summed alike for every row; ties go to
    the smaller id. Where rows repeat an id, the first vector in order counts. An empty
    table gives no rows, and a query without candidates none.

    Rows of one vector are one entry of the index with its k + 1 smallest ids, as no query
    needs more. An entry stands in one cell. How much of a cell is taken in, and how many
    cells a query visits, are fitted on the commonest vector length in a bounded sample
    (`fit`). Cells of many vectors are split, and their queries visit each part; so a
    task holds about CELL vectors, and no pair of a query and a candidate leaves its task.
    """
    rows = checkpointed(usable(vectors, is_query, id_col, vector_col).withColumn("size", F.size("v")))
    by_vector = Window.partitionBy("v").orderBy("id")
    smallest = rows.withColumn("_n", F.row_number().over(by_vector)).where(F.col("_n") <= k + 1)
    index = checkpointed(smallest.groupBy("size", "v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("id", F.col("ids")[0]))
    bits = cell_bits(index.count())
    drawn = [np.array(r["v"]) for r in index.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("v").collect()]
    sizes = [len(v) for v in drawn]
    share, probes = fit(unit_rows(np.stack([v for v in drawn if len(v) == max(set(sizes), key=sizes.count)])), k, bits) if drawn else (1.0, 1)

    cell = ["size", "cell"]
    held = checkpointed(_placed(index, bits, 1).select("size", F.col("cells")[0].alias("cell"), "id", "v", "ids"))
    asked = checkpointed(_placed(rows.where("q").select("size", "id", "v"), bits, probes))
    visits = asked.select("size", F.explode("cells").alias("cell"), "id", "v")
    parts = held.groupBy(*cell).agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts"))
    blocks = visits.groupBy(*cell).agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    cells = broadcast_if_small(checkpointed(parts.join(blocks, cell)), BROADCAST_CELLS)
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    place = lambda count, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(count)).cast("int")
    group = [*cell, "part", "block"]
    mine = held.join(cells, cell).withColumn("part", place("parts", 3)).select(*cell, "part", every("blocks").alias("block"), "id", "v", "ids")
    theirs = visits.join(cells, cell).withColumn("block", place("blocks", 2)).select(*cell, every("parts").alias("part"), "block", "id", "v")

    def search(mine: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(mine) and len(queries):
            x, q, ids = unit_rows(np.stack(mine["v"])), unit_rows(np.stack(queries["v"])), mine["ids"].tolist()
            normals = planes(x.shape[1], TREES * DEPTH)
            forest, strings = Forest(hash_strings(x, normals)), hash_strings(q, normals)
            wanted = max(math.ceil(share * len(x)), 2 * k)
            for i in range(0, len(q), 256):
                masks = forest.candidates(strings[i : i + 256], wanted)
                rough = np.where(masks, q[i : i + 256] @ x.T, -2.0)
                for j in range(len(rough)):
                    own = queries["id"].iat[i + j]
                    # the k + 1 best entries hold the k best ids, one entry being the query's own
                    least = np.partition(rough[j], max(0, len(x) - k - 1))[max(0, len(x) - k - 1)]
                    at = np.flatnonzero(masks[j] & (rough[j] >= least - 1e-9))
                    score = _cosines(np.stack(mine["v"].to_numpy()[at]), np.asarray(queries["v"].iat[i + j]))
                    found = sorted((-s, v) for s, a in zip(score.tolist(), at.tolist()) for v in ids[a] if v != own)[:k]
                    out += [(own, v, -s) for s, v in found]
        return pd.DataFrame(out, columns=["query_id", "id", "score"]).astype({"query_id": "int64", "id": "int64", "score": "float64"})

    found = mine.groupBy(*group).cogroup(theirs.groupBy(*group)).applyInPandas(search, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The cosine of every row with q; each row is summed in the same order, so equal rows have equal cosines."""
    x, q = x / np.abs(x).max(1, keepdims=True), q / np.abs(q).max()
    return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum()))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, F.col("vec_id") % 50 == 0).withColumnRenamed("id", "vec_id").select("query_id", "rank", "vec_id", "score")


QUERIES = {"op5_nearest": op5_nearest}
