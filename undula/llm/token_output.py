"""Token ids written as ORC in document order, and read back.

ORC keeps integer columns run-length encoded, and indexes of row groups and Bloom
filters on doc_id, so that readers take stripes in parallel and skip by metadata.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from undula.llm.shared import fresh_path, table
from undula.llm.tokens import WORD_BPE, encoder, slices

ORC_OPTIONS = {
    "orc.compress": "zstd",
    "orc.stripe.size": str(32 << 20),
    "orc.row.index.stride": "10000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("part", T.IntegerType()),
    T.StructField("part_start", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids", T.ArrayType(T.IntegerType())),
])


def write_tokens(docs: DataFrame, path: str, tokenizer: str = WORD_BPE, end_id: int = 1) -> None:
    """Write (doc_id, part, part_start, n_tokens, ids) as ORC files in ascending doc_id order.

    Needs doc_id and text; other columns are not read. A null or empty text has end_id
    alone. Each file is one range of doc_id: `part` numbers the ranges in order, and
    part_start counts the ids before a document in its file. Rows with one doc_id stay
    together, ordered by text. An empty table gives a folder without rows.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, start = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole):
                ids, ends = enc.encode(batch.column("text"), end_id)
                sizes = np.diff(ends, prepend=0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.full(len(ends), part, np.int32)), pa.array(start + ends - sizes), pa.array(sizes), lists], names=SCHEMA.names
                )
                start += int(ends[-1])
        enc.forget()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(encode, SCHEMA).write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): what write_tokens wrote, start counting the ids of all documents before.

    Filters on doc_id reach the ORC reader, which skips files, stripes and row groups.
    """
    files = spark.read.schema(SCHEMA).orc(path)
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row for each file written
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return files.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def ids_crc32(rows: DataFrame) -> DataFrame:
    """The rows with `ids` replaced by ids_crc32, over little-endian unsigned 32-bit ids."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            lists = batch.column(at)
            values, offsets = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False), lists.offsets.to_numpy()
            sums = pa.array([zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets, offsets[1:])], pa.int64())
            columns = [sums if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=["ids_crc32" if n == "ids" else n for n in batch.schema.names])

    fields = [T.StructField("ids_crc32", T.LongType()) if f.name == "ids" else f for f in rows.schema]
    return rows.mapInArrow(crc, T.StructType(fields))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return ids_crc32(read_tokens(spark, path))


QUERIES = {"op7_token_output": op7_token_output}
