"""Benchmark decontamination over a distributed positional inverted index.

Postings (term, document, position) of the training texts are stored once; each
benchmark window is looked up from its rarest term, and the offset-adjusted
postings of its other terms are intersected with what the rarest one found.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from undula.llm.shared import ascii_lower, broadcast_if_small, checkpointed, fresh_path, table, write_table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Benchmark vocabulary, windows and candidate documents up to so many rows are broadcast; more are joined by shuffles.
BROADCAST_ROWS = 500_000
#: The term number of the record that holds a document's length.
LENGTH = -1


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def phrase_windows(items: DataFrame, size: int) -> DataFrame:
    """(window, n, words, item_ids): the distinct runs of `size` item words; a shorter item is one window."""
    w = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    runs = w.select("item_id", F.explode(starts).alias("s"), "w").select("item_id", F.slice("w", F.col("s"), size).alias("words"))
    grouped = runs.groupBy("words").agg(F.collect_set("item_id").alias("item_ids"))
    return grouped.select(F.md5(F.array_join("words", " ")).alias("window"), F.size("words").alias("n"), "words", "item_ids")


def build_index(docs: DataFrame, vocabulary: DataFrame, path: str) -> DataFrame:
    """Write the postings (term_id, doc_id, pos) and read them back.

    vocabulary: (term, term_id). Terms outside it can't be asked for and get no
    postings. Each row of docs also gets one record of term_id LENGTH, whose pos is
    its number of words. The index is partitioned by document: writing it needs no
    shuffle, and a lost task writes its files again.
    """
    length = docs.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(LENGTH).cast("long").alias("term_id"))
    vocabulary = checkpointed(vocabulary.unionByName(length))
    placed = docs.select("doc_id", F.posexplode(F.array_append(words(F.col("text")), F.lit(""))).alias("pos", "term"))
    postings = placed.join(broadcast_if_small(vocabulary, BROADCAST_ROWS), "term").select("term_id", "doc_id", "pos")
    write_table(postings, path)
    return docs.sparkSession.read.parquet(path)


def phrase_matches(index: DataFrame, windows: DataFrame, vocabulary: DataFrame, slop: int = 0, min_share: float = 1.0) -> DataFrame:
    """(window, doc_id, start, n_found): places where windows occur.

    slop 0 and min_share 1: exact phrases. Otherwise a window matches near `start`
    if at least min_share of its terms stand within slop positions of their places, one
    of its rarest exactly at its place. Of n terms n - ceil(n * min_share) may be absent,
    so that many and one more, the rarest, are looked up: a match has one of them, also
    where some don't occur in any text. Each start is returned once.
    """
    exact = slop == 0 and min_share >= 1
    terms = checkpointed(windows.select("window", "n", F.posexplode("words").alias("at", "term")).join(vocabulary, "term").drop("term"))
    asked = terms.select("term_id").distinct()
    frequency = checkpointed(index.join(broadcast_if_small(asked, BROADCAST_ROWS), "term_id").groupBy("term_id").agg(F.count("*").alias("df")))
    rarest_first = Window.partitionBy("window").orderBy("df", "at")
    ranked = checkpointed(terms.join(frequency, "term_id", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("rank", F.row_number().over(rarest_first)))
    least = F.ceil(F.col("n") * F.lit(min_share)).cast("int")
    of_rank = lambda rank: broadcast_if_small(ranked.where(rank).select("window", "n", "at", "term_id"), BROADCAST_ROWS)
    at_start = lambda rows: rows.select("window", "n", "doc_id", (F.col("pos") - F.col("at")).cast("int").alias("start"))
    found = at_start(index.join(of_rank(F.col("rank") <= F.col("n") - least + 1), "term_id"))
    if not exact:
        found = found.distinct()
    else:
        # most places of the rarest term lack the second rarest: what its list leaves is short
        second = ranked.where("rank = 2")
        lists = index.join(broadcast_if_small(second.select("term_id").distinct(), BROADCAST_ROWS), "term_id", "left_semi")
        pairs = found.where("n > 1 and start >= 0").join(of_rank(F.col("rank") == 2).drop("n"), "window").withColumn("pos", F.col("start") + F.col("at")).drop("at")
        both = pairs.join(lists, ["doc_id", "term_id", "pos"]).select("window", "n", "doc_id", "start")
        found = both.unionByName(found.where("n = 1"))
    first = checkpointed(found)
    few = broadcast_if_small(checkpointed(first.select("doc_id").distinct()), BROADCAST_ROWS)
    near = index.where(F.col("term_id") != LENGTH).join(few, "doc_id", "left_semi")
    wanted = first.join(broadcast_if_small(terms.drop("n"), BROADCAST_ROWS), "window").withColumn("pos", F.col("start") + F.col("at"))
    if slop:
        wanted = wanted.withColumn("pos", F.explode(F.sequence(F.col("pos") - slop, F.col("pos") + slop)))
    counted = wanted.join(near, ["doc_id", "term_id", "pos"]).groupBy("window", "n", "doc_id", "start").agg(F.count_distinct("at").alias("n_found"))
    return counted.where(F.col("n_found") >= least)


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, item_ids) for every row of docs.

    docs needs doc_id and text, items item_id and text; other columns are not read.
    A null or empty text has no words, and an item without words no window. A word is
    hit if any occurrence of a window covers it, and counts once. Rows with one doc_id
    are taken to be copies of one document: hits are found once for each doc_id and
    returned for each row. A row without a doc_id has no hits. Empty tables give no hits,
    or no rows. Phrases are exact; for near ones call phrase_matches.
    """
    spark = docs.sparkSession
    windows = checkpointed(phrase_windows(items.select("item_id", "text"), window))
    terms = windows.select(F.explode("words").alias("term")).distinct()
    vocabulary = checkpointed(terms.select("term", F.monotonically_increasing_id().alias("term_id")))  # fixed once written
    index = build_index(docs.select("doc_id", "text"), vocabulary, fresh_path(spark, "postings"))
    matches = checkpointed(phrase_matches(index, windows, vocabulary).select("window", "n", "doc_id", "start"))
    covered = matches.select("doc_id", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("pos")).distinct()
    n_hit = covered.groupBy("doc_id").agg(F.count("*").alias("n_hit"))
    named = windows.select("window", F.explode("item_ids").alias("item_id"))
    item_ids = (
        matches.select("window", "doc_id").distinct().join(broadcast_if_small(named, BROADCAST_ROWS), "window")
        .groupBy("doc_id").agg(F.collect_set("item_id").alias("item_ids"))
    )
    hits = checkpointed(n_hit.join(item_ids, "doc_id"))
    rows = index.where(F.col("term_id") == LENGTH).select("doc_id", F.col("pos").cast("long").alias("n_words"))
    none = F.array().cast("array<long>")
    return rows.join(broadcast_if_small(hits, BROADCAST_ROWS, F.size("item_ids")), "doc_id", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids")
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """docs without the documents whose text holds a benchmark window; columns and null texts stay as they are.

    Rows of one doc_id go together, where any of them holds one; rows without a doc_id stay.
    """
    dirty = contamination(docs, items, window).where("n_hit > 0").select("doc_id").distinct()
    return docs.join(dirty, "doc_id", "left_anti").select(docs.columns)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.col("item_ids").cast("array<string>")), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


ORACLE = {
    "op9_decontamination": r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
starts AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM iw WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, s, s + 9), ' ') AS phrase, len(list_slice(w, s, s + 9)) AS n FROM starts),
sizes AS (SELECT DISTINCT n FROM wins),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM dw WHERE len(w) > 0),
grams AS (SELECT p.doc_id, p.s, z.n, array_to_string(list_slice(p.w, p.s, p.s + z.n - 1), ' ') AS phrase FROM pos p JOIN sizes z ON p.s + z.n - 1 <= len(p.w)),
hits AS (SELECT g.doc_id, g.s, g.n, i.item_id FROM grams g JOIN wins i ON g.phrase = i.phrase AND g.n = i.n),
cover AS (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM hits),
nh AS (SELECT doc_id, count(*) AS n_hit FROM cover GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) x GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(nh.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(it.ids, '')) AS items_sha256, coalesce(nh.n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN nh ON dw.doc_id = nh.doc_id LEFT JOIN it ON dw.doc_id = it.doc_id
""",
}
QUERIES = {"op9_decontamination": op9_decontamination}
