"""SimHash near-dedup by covering locality-sensitive hashing.

A fingerprint has 64 bits. For a radius r every bit position gets a vector of r + 1
bits, not zero, and each non-zero vector v gives a mask: the positions whose vector
has an odd product with v. The vectors of r positions never span all r + 1
dimensions, so some v is orthogonal to them: two fingerprints that differ in at most
r bits agree on all bits of some mask, and meet in that table. None is missed.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm.components import connected_components
from undula.llm.shared import checkpointed, table, whole_groups

SEED = 42
#: In a table's bucket up to this size all links are returned, in a larger one those of a spanning forest.
ALL_LINKS = 16
#: Fingerprints compared with one another at a time in a large bucket.
BLOCK = 2048


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """The 2^(radius+1) - 1 masks of the covering family."""
    n = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if ((i % n + 1) & v).bit_count() & 1) for v in range(1, n + 1)]


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """The runs of `size` words, joined by blanks; fewer words are one run, none give none."""
    if len(words) <= size:
        return [b" ".join(words)] * bool(words)
    text, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends]
    return [text[a : b - 1] for a, b in zip(starts, ends[size - 1 :])]


def words_of(text: str | None) -> list[bytes]:
    """The words between the ASCII white space, with A-Z in lower case, as UTF-8."""
    return (text or "").encode().lower().split()


def fingerprint(features: list[bytes], seed: int = SEED) -> int:
    """Bit i is set if it is in over half of the features' hashes; 0 for no features."""
    if not features:
        return 0
    h = np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in features), np.uint64, len(features))
    counts, step = np.zeros(64, np.int64), 1 << 14
    for i in range(0, len(h), step):
        counts += np.unpackbits(h[i : i + step].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the signed 64-bit fingerprint of the whole text, each shingle counted as often as it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(shingles(words_of(t.as_py()), shingle)) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _forest(fp: np.ndarray, node: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of one bucket, which connect what all links within the radius connect.

    A bucket agrees on its mask, so few bits vary. Where the patterns of up to `radius` of
    them are fewer than the rows, each is looked up in the sorted bucket; else rows are
    compared block by block, and memory is bounded by BLOCK squared.
    """
    order = np.argsort(fp, kind="stable")
    fp, node, root = fp[order], node[order], np.arange(len(fp)).tolist()

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        varying = int(np.bitwise_or.reduce(fp ^ fp[0]))
        bits = [1 << i for i in range(64) if varying >> i & 1]
        patterns, least = [0], len(fp)
        for n in range(1, radius + 1):
            patterns += map(sum, itertools.islice(itertools.combinations(bits, n), max(0, least - len(patterns))))
        if len(patterns) < least:
            same = np.flatnonzero(fp[1:] == fp[:-1])
            yield same, same + 1
            for p in patterns[1:]:
                wanted = fp ^ np.uint64(p)
                at = np.minimum(np.searchsorted(fp, wanted), len(fp) - 1)
                hit = np.flatnonzero((fp[at] == wanted) & (wanted > fp))
                yield hit, at[hit]
            return
        for i in range(0, len(fp), BLOCK):
            for j in range(i, len(fp), BLOCK):
                x, y = np.nonzero(np.bitwise_count(fp[i : i + BLOCK, None] ^ fp[None, j : j + BLOCK]) <= radius)
                later = x + i < y + j
                yield x[later] + i, y[later] + j

    out = []
    for a, b in pairs():
        for x, y in zip(a.tolist(), b.tolist()):
            if (p := find(x)) != (q := find(y)):
                root[max(p, q)] = min(p, q)
                out.append((node[x], node[y]))
    return out


def bucket_links(rows: DataFrame, radius: int, stars: bool = False) -> DataFrame:
    """(a, b): nodes in one bucket whose fingerprints differ in at most radius bits.

    rows: (key, node, fp). Buckets are sorted together and read as a stream, so a task
    holds the bucket at hand only. A bucket of up to ALL_LINKS rows gives all its
    links, a larger one enough of them to connect what all of them connect. stars: a
    bucket's rows are linked to its first row or, where that is too far, to the row
    before only, which is for candidates that an exact search completes.
    """

    def starred(start: np.ndarray, node: np.ndarray, fp: np.ndarray) -> list[tuple[int, int]]:
        at = np.arange(len(fp))
        near = lambda to: (np.bitwise_count(fp ^ fp[to]) <= radius) & (node != node[to])
        first, before = near(start), np.maximum(at - 1, start)
        to = np.where(first, start, before)
        linked = np.flatnonzero(first | near(before))
        return list(zip(node[linked].tolist(), node[to[linked]].tolist()))

    def links(key: np.ndarray, node: np.ndarray, fp: np.ndarray) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        size = np.diff(cuts)
        if stars:
            return starred(np.repeat(cuts[:-1], size), node, fp)
        for i in np.flatnonzero(size > ALL_LINKS).tolist():
            out += _forest(fp[cuts[i] : cuts[i + 1]], node[cuts[i] : cuts[i + 1]], radius)
        at = np.flatnonzero(np.repeat(size <= ALL_LINKS, size))
        for lag in range(1, ALL_LINKS):
            at = at[at + lag < len(key)]
            at = at[key[at] == key[at + lag]]
            if not len(at):
                break
            near = at[(np.bitwise_count(fp[at] ^ fp[at + lag]) <= radius) & (node[at] != node[at + lag])]
            out += zip(node[near].tolist(), node[near + lag].tolist())
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["key"]):
            key, node, fp = (rows.column(c).to_numpy() for c in ("key", "node", "fp"))
            pairs = links(key, node, fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "a long, b long").distinct()


def near_links(nodes: DataFrame, radius: int, stars: bool = False) -> DataFrame:
    """(a, b) of nodes (node, fp) whose fingerprints differ in at most radius bits.

    Enough links are returned to connect what all of them connect, or with `stars` a few
    for each node, as bucket_links has it.
    """
    tables = [F.xxhash64(F.lit(v), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))) for v, mask in enumerate(covering_masks(radius))]
    return bucket_links(nodes.select(F.explode(F.array(*tables)).alias("key"), "node", "fp"), radius, stars)


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    Needs doc_id and text; other columns are not read. A null, empty or blank text has
    fingerprint zero and is linked like any other. Texts of one fingerprint are one
    node, named by its smallest doc_id, so copies add no links. component_id is the
    smallest doc_id that links reach. Repeated rows are returned each. A row without a
    doc_id names no node: it joins the component of texts with its fingerprint, if any.
    An empty table gives no rows.
    """
    fps = checkpointed(fingerprints(docs, shingle))
    nodes = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("node")))
    linked = connected_components(near_links(nodes.where("node is not null"), radius))
    named = nodes.join(linked, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op1_simhash": op1_simhash}
