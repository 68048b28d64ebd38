"""Packing of token ids into sequences by multiway Karmarkar-Karp differencing.

Every document becomes whole windows and a remainder. The remainders of a block of
windows are packed by largest differencing: partial partitions are merged so that
large sums meet small ones, which leaves near-equal windows; while one exceeds the
capacity, the block gets further windows and is packed again. Documents are cut only
where they are longer than a window, at the border of two blocks, and in the last
block of an input partition.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undula.llm.shared import table
from undula.llm.tokens import WORD_BPE, encoder, slices

CAPACITY = 4096
#: Windows packed together; bounds the memory of a task and the work of a merge.
BLOCK_WINDOWS = 64
#: Ids left free in each window of a block, so that near-equal windows fit in it.
SLACK = 4
PIECE = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids", T.BinaryType()),
    T.StructField("doc_tokens", T.LongType()),
    T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()),
])


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """The indexes of sizes in `windows` near-equal groups, by Karmarkar-Karp largest differencing.

    A partial partition is a list of (sum, members), largest first; empty groups are
    not stored. The two with the largest spread are merged, the largest sums of one
    with the smallest of the other, until one is left. Ties go to the earlier one.
    """
    heap = [(-size if windows > 1 else 0, i, [(size, [i])]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    number = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        # a's group i meets b's group windows - 1 - i; the first ones meet b's empty groups
        alone = windows - len(b)
        met = [(a[i][0] + y, a[i][1] + m) if i < len(a) else (y, m) for i, (y, m) in enumerate(reversed(b), alone)]
        merged = sorted(a[:alone] + met, key=lambda g: -g[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == windows else 0)
        heapq.heappush(heap, (-spread, number, merged))
        number += 1
    return [members for _, members in heap[0][2]] if heap else []


def powers(total: int) -> list[int]:
    """The powers of two that add up to total, largest first."""
    return [1 << i for i in reversed(range(total.bit_length())) if total >> i & 1]


class Packer:
    """Packs the pieces of one task, block by block, and keeps no more than a block.

    A piece is (doc_id, start, ids, doc_tokens); ids are bytes, four to an id.
    """

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.sequence = capacity, first_sequence
        self.full = BLOCK_WINDOWS * (capacity - min(SLACK, capacity // 64))
        self.waiting: list[tuple] = []
        self.total = 0

    def _emit(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, ids, doc_tokens in pieces:
            yield doc_id, start, len(ids) // 4, ids, doc_tokens, self.sequence, offset
            offset += len(ids) // 4
        self.sequence += 1

    @staticmethod
    def _cut(piece: tuple, at: int) -> tuple[tuple, tuple]:
        doc_id, start, ids, doc_tokens = piece
        return (doc_id, start, ids[: 4 * at], doc_tokens), (doc_id, start + at, ids[4 * at :], doc_tokens)

    def add(self, doc_id: int, ids: bytes) -> Iterator[tuple]:
        n, whole = len(ids) // 4, len(ids) // 4 // self.capacity * self.capacity
        for at in range(0, whole, self.capacity):
            yield from self._emit([(doc_id, at, ids[4 * at : 4 * (at + self.capacity)], n)])
        if n == whole:
            return
        rest = (doc_id, whole, ids[4 * whole :], n)
        if self.total + n - whole >= self.full:
            last, rest = self._cut(rest, self.full - self.total)
            self.waiting.append(last)
            yield from self._pack(BLOCK_WINDOWS)
        if rest[2]:
            self.waiting.append(rest)
            self.total += len(rest[2]) // 4

    def _over(self, sizes: list[int], groups: list[list[int]]) -> int:
        return sum(max(0, sum(sizes[i] for i in g) - self.capacity) for g in groups)

    def _pack(self, windows: int) -> Iterator[tuple]:
        """The waiting pieces, whole, in as few windows from `windows` on as differencing fits them into."""
        pieces, self.waiting, self.total = self.waiting, [], 0
        sizes = [len(p[2]) // 4 for p in pieces]
        groups = difference(sizes, windows)
        while over := self._over(sizes, groups):
            windows += -(-over // self.capacity)
            groups = difference(sizes, windows)
        for g in groups:
            yield from self._emit([pieces[i] for i in g])

    def _fill(self, pieces: list[tuple], sizes: list[int]) -> Iterator[tuple]:
        """The pieces in their order in sequences of these sizes, cut where one is full."""
        for size in sizes:
            sequence = []
            while size:
                head, off = self._cut(pieces[0], min(size, len(pieces[0][2]) // 4))
                sequence.append(head)
                size -= len(head[2]) // 4
                pieces[0:1] = [off] * bool(off[2])
            yield from self._emit(sequence)

    def close(self) -> Iterator[tuple]:
        """The last block: windows by differencing as before, of as many pieces as fit, then the rest without padding.

        The rest is cut into full windows and sequences of a power of two.
        """
        windows, pieces, rest = self.total // self.capacity, self.waiting, []
        self.waiting, self.total = [], 0
        sizes = [len(p[2]) // 4 for p in pieces]
        excess = sum(sizes) - windows * (self.capacity - min(SLACK, self.capacity // 64))
        while True:
            while pieces and excess > 0:
                rest.append(pieces.pop())
                excess -= sizes.pop()
            groups = difference(sizes, windows) if pieces else []
            if not (excess := self._over(sizes, groups)):
                break
        for g in groups:
            yield from self._emit([pieces[i] for i in g])
        full, tail = divmod(sum(len(p[2]) // 4 for p in rest), self.capacity)
        yield from self._fill(rest, [self.capacity] * full + powers(tail))


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = WORD_BPE, end_id: int = 2) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ids holds the piece's token ids as little-endian unsigned 32-bit integers; start
    counts the document's ids before it, offset those before it in its sequence, and
    doc_tokens all ids of the document, with end_id after its text. Pieces cover every
    id once. A sequence has at most `capacity` ids and is to be padded to that, except
    where its length is a power of two. Needs doc_id and text; other columns are not
    read. A null or empty text has end_id alone. Repeated rows are packed each. An
    empty table gives no rows.

    Input partitions are packed by themselves, with no shuffle. A task holds one block
    of windows at a time, and a task that is run again gives the same sequences.
    """
    if capacity & (capacity - 1) or capacity < 2:
        raise ValueError("capacity must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        packer = Packer(capacity, TaskContext.get().partitionId() << 33)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=PIECE.names)

        for whole in batches:
            for part in slices(whole):
                ids, ends = enc.encode(part.column("text"), end_id)
                whole_ids, places = ids.astype("<u4", copy=False).tobytes(), [0, *(4 * ends).tolist()]
                rows = [p for d, a, b in zip(part.column("doc_id").to_pylist(), places, places[1:], strict=False) for p in packer.add(d, whole_ids[a:b])]
                if rows:
                    yield batch(rows)
        if rows := list(packer.close()):
            yield batch(rows)
        enc.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE)


TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


QUERIES = {"op3_packing": op3_packing}
