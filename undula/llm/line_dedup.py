"""Line dedup: drop the lines whose key is found in many documents.

Lines are exploded and hashed, documents are counted per hash, and texts are put
together again from the lines that stay, by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm.shared import ascii_lower, broadcast_if_small, checkpointed, table

SPACE = " \t\n\x0b\x0c\r"
#: A list of frequent keys up to this many rows (16 bytes each) is broadcast; a longer one is joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def line_keys(text: Column) -> Column:
    """The key of every line, in order: white space stripped, A-Z lower-cased."""
    return F.transform(F.split(ascii_lower(text), "\n", -1), lambda line: F.trim(line, F.lit(SPACE)))


def key_hash(key: Column) -> Column:
    """128 bits from two differently seeded hashes, so that chance collisions do not drop lines."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(7), key).alias("b"))


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, a, b), once for each distinct key of a row."""
    keys = F.array_distinct(F.filter(line_keys(F.col("text")), lambda k: F.char_length(k) >= min_chars))
    return docs.select("doc_id", F.explode(F.transform(keys, key_hash)).alias("h")).select("doc_id", "h.a", "h.b")


def frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """(doc_id, a, b) of those keys that at least min_docs documents hold.

    Rows per hash are counted first with map-side sums. Only hashes that reach the
    threshold so can reach it in distinct documents, so that exact count runs over
    few rows even where rows repeat. Both lists of keys are counted before they are
    broadcast, so the documents of a common key stay in the tasks that they are in.
    """
    rows = line_hashes(docs, min_chars)
    often = checkpointed(rows.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("a", "b"))
    held = checkpointed(rows.join(broadcast_if_small(often, BROADCAST_KEYS), ["a", "b"]).distinct())
    enough = checkpointed(held.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("a", "b"))
    return held.join(broadcast_if_small(enough, BROADCAST_KEYS), ["a", "b"])


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """docs with text rebuilt from the lines that stay, plus n_lines and n_dropped.

    Needs doc_id and text; other columns pass through, except that own columns named
    n_lines or n_dropped are replaced. A null text is one empty line and becomes an
    empty text. Empty keys (below min_chars) are never dropped. Rows with one doc_id
    are one document in the count, as are all rows without a doc_id, and each of them is
    returned without its frequent lines. An empty table gives an empty table. A line
    keeps its own spelling: only its key is normalised.
    """
    per_doc = frequent_lines(docs, min_docs, min_chars).groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set(F.struct("a", "b")).alias("_frequent"))
    lines, keys = F.split(F.coalesce("text", F.lit("")), "\n", -1), line_keys(F.col("text"))
    kept = F.transform(
        F.filter(F.arrays_zip(lines.alias("line"), keys.alias("key")), lambda x: ~F.array_contains(F.col("_frequent"), key_hash(x["key"]))),
        lambda x: x["line"],
    )
    clean = docs.drop("n_lines", "n_dropped", "_frequent", "_id")
    clean = clean.join(per_doc, clean["doc_id"].eqNullSafe(per_doc["_id"]), "left").drop("_id")
    touched = F.col("_frequent").isNotNull()
    return (
        clean.withColumn("n_lines", F.size(lines).cast("long"))
        .withColumn("_kept", F.when(touched, kept))
        .withColumn("n_dropped", F.when(touched, F.col("n_lines") - F.size("_kept")).otherwise(F.lit(0)).cast("long"))
        .withColumn("text", F.when(touched, F.array_join("_kept", "\n")).otherwise(F.coalesce("text", F.lit(""))))
        .drop("_kept", "_frequent")
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_frequent_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = {
    "op6_line_dedup": r"""
WITH lines AS (
  SELECT d.doc_id, u.pos, u.line, translate(trim(u.line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM documents d, LATERAL (SELECT unnest(string_split(coalesce(d.text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(d.text, ''), chr(10))))) AS pos) u),
often AS (SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT l.doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(o.key) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN o.key IS NULL THEN l.line END, chr(10) ORDER BY l.pos), '')) AS kept_sha256
FROM lines l LEFT JOIN often o ON l.key = o.key GROUP BY l.doc_id
""",
}
QUERIES = {"op6_line_dedup": op6_line_dedup}
