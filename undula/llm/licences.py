"""Licence scans by canonical digest lookup.

A text and the known licence texts are brought to one canonical form - case,
punctuation, copyright lines and equivalent spellings do not count - and entire texts
are joined to the known ones by their digests. An entire text is a whole document, or
any run of its lines that is as long, in canonical words, as some known text.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm.licence_texts import KNOWN, KNOWN_DIGESTS, KNOWN_LENGTHS
from undula.llm.shared import broadcast_if_small, checkpointed, table

# Spellings that count as one, after case and punctuation are gone.
EQUIVALENT = {
    "licence": "license",
    "licenced": "licensed",
    "licences": "licenses",
    "licencing": "licensing",
    "sublicence": "sublicense",
    "sub license": "sublicense",
    "sub licence": "sublicense",
    "non commercial": "noncommercial",
    "merchantibility": "merchantability",
    "acknowledgement": "acknowledgment",
    "organisation": "organization",
    "favour": "favor",
    "whilst": "while",
    "wilful": "willful",
    "per cent": "percent",
    "copyright holder": "copyright owner",
    "copyright holders": "copyright owners",
    "https": "http",
}
#: Every known text has one of these, so a text without them is none.
MARKERS = ("licen", "permission", "redistribution", "public domain")


#: Known digests up to so many are broadcast.
BROADCAST_DIGESTS = 100_000
COPYRIGHT_LINE = regex.compile(r"[^\p{L}\n]*(?:copyright\s*(?:\(c\)|©|\d|(?:by|of)\s)|\(c\)|©)|[^\p{L}\n]*all rights reserved\W*$")
WORD = regex.compile(r"[\p{L}\p{N}]+")
#: Equivalent spellings of one word, and of two words that are read as one word or two.
SINGLE = {k: v for k, v in EQUIVALENT.items() if " " not in k}
DOUBLE = {tuple(k.split()): v.split() for k, v in EQUIVALENT.items() if " " in k}


def canonical_lines(text: str) -> list[list[str]]:
    """The canonical words of each line: lower case, no copyright lines, no punctuation, one spelling for equivalents.

    Two words of one equivalent spelling count where they are in the line of the first.
    """
    words = [(n, SINGLE.get(w, w)) for n, line in enumerate(text.lower().split("\n")) if not COPYRIGHT_LINE.match(line) for w in WORD.findall(line)]
    lines: list[list[str]] = [[] for _ in range(text.count("\n") + 1)]
    at = 0
    while at < len(words):
        n, word = words[at]
        pair = DOUBLE.get((word, words[at + 1][1])) if at + 1 < len(words) else None
        lines[n] += pair or [word]
        at += 2 if pair else 1
    return lines


def digest(words: list[str]) -> str:
    return hashlib.sha256(" ".join(words).encode()).hexdigest()


def canonical_digest(text: str) -> tuple[str, int]:
    """The digest of an entire text, and its length in canonical words."""
    words = [w for line in canonical_lines(text) for w in line]
    return digest(words), len(words)


def known_digests(spark: SparkSession, known: dict[str, list[str]] | None = None) -> tuple[DataFrame, list[int]]:
    """(digest, licence) of the known texts, and by default of full licences (KNOWN_DIGESTS); and the lengths that they have."""
    each = [(*canonical_digest(text), name) for name, texts in (KNOWN if known is None else known).items() for text in texts]
    if known is None:
        each += [(x, n, name) for name, digests in KNOWN_DIGESTS.items() for x, n in zip(digests, KNOWN_LENGTHS[name], strict=True)]
    rows = [(d, name) for d, n, name in each if n]
    listed = spark.createDataFrame(rows, "digest string, licence string")
    return listed.groupBy("digest").agg(F.min("licence").alias("licence")), sorted({n for _, n, _ in each if n})


def runs(lines: list[list[str]], lengths: list[int]) -> Iterator[tuple[int, int, str]]:
    """(first line, last line, digest) of the runs of lines that have one of these lengths, without empty ends."""
    words, starts, at = [w for line in lines for w in line], [], 0
    for n, line in enumerate(lines):
        if line:
            starts.append((n, at))
            at += len(line)
    ends = {at + len(lines[n]): n for n, at in starts}
    for n, at in starts:
        for length in lengths:
            if (last := ends.get(at + length)) is not None:
                yield n, last, digest(words[at : at + length])


SCANNED = "row long, doc_id {kind}, runs array<struct<unit:string,first_line:int,last_line:int,digest:string>>"


def scanned(docs: DataFrame, lengths: list[int], known: bool) -> DataFrame:
    """(row, doc_id, runs) for every row of docs, written at once: a number of its own, and its runs of lines as long as a known text.

    known: texts without any of the MARKERS can't hold a known text and are not read.
    """
    has = F.exists(F.array(*[F.lit(m) for m in MARKERS]), lambda m: F.contains(F.lower("text"), m)) if known else F.col("text").isNotNull()
    fields = pa.struct([("unit", pa.string()), ("first_line", pa.int32()), ("last_line", pa.int32()), ("digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = itertools.count(TaskContext.get().partitionId() << 33)
        for batch in batches:
            rows: list[list[tuple]] = []
            for text in batch.column("text"):
                lines = canonical_lines(text.as_py() or "")
                total = sum(map(len, lines))
                rows.append([("whole" if sum(map(len, lines[a : b + 1])) == total else "part", a, b, d) for a, b, d in runs(lines, lengths)])
            held = [[dict(zip(("unit", "first_line", "last_line", "digest"), r)) for r in found] for found in rows]
            yield pa.RecordBatch.from_arrays([pa.array([next(number) for _ in rows], pa.int64()), batch.column("doc_id"), pa.array(held, pa.list_(fields))], names=["row", "doc_id", "runs"])

    return checkpointed(docs.select("doc_id", F.when(has, F.col("text")).alias("text")).mapInArrow(run, SCANNED.format(kind=dict(docs.dtypes)["doc_id"])))


def _matched(rows: DataFrame, digests: DataFrame) -> DataFrame:
    """(row, doc_id, unit, licence, first_line, last_line): the runs that are known texts."""
    each = rows.select("row", "doc_id", F.explode("runs").alias("r")).select("row", "doc_id", "r.*")
    return each.join(broadcast_if_small(checkpointed(digests), BROADCAST_DIGESTS), "digest").select("row", "doc_id", "unit", "licence", "first_line", "last_line").distinct()


def licence_matches(docs: DataFrame, known: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, unit, licence, first_line, last_line): the runs of lines that are entire known texts; unit: whole or part.

    Lines count from 0. A run longer than the known texts, or cut within a line, is none.
    Each row of docs is a document by itself, also where ids repeat or are null.
    """
    digests, lengths = known_digests(docs.sparkSession, known)
    return _matched(scanned(docs, lengths, known is None), digests).drop("row")


def scan_licences(docs: DataFrame, known: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, whole, n_matches, licences) for every row of docs.

    whole: the licence that the whole text is, else null. licences: all found, sorted.
    n_matches counts the places of known texts, each once, also those within another.
    Needs doc_id and text; other columns are not read. A null or empty text matches
    nothing. Each row is a document by itself, also where ids repeat or are null. An
    empty table gives no rows. known: licence names and their texts, in the place of the
    ones that come with this module.
    """
    digests, lengths = known_digests(docs.sparkSession, known)
    rows = scanned(docs, lengths, known is None)
    found = _matched(rows, digests).groupBy("row").agg(
        F.max(F.when(F.col("unit") == "whole", F.col("licence"))).alias("whole"),
        F.count("*").alias("n_matches"),
        F.array_sort(F.collect_set("licence")).alias("licences"),
    )
    return rows.select("row", "doc_id").join(found, "row", "left").select(
        "doc_id", "whole", F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"), F.coalesce("licences", F.array().cast("array<string>")).alias("licences")
    )


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licences(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.coalesce("whole", F.lit("")).alias("whole"), "n_matches", F.array_join("licences", ",").alias("licences"))


QUERIES = {"op8_licences": op8_licences}
