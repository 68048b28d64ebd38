"""Secret scans: fixed patterns, and strings that zstandard can't predict.

Beside the patterns, every long string in a sensitive context is a candidate. Its
novelty is what it adds, in compressed bytes, to its surroundings without its other
occurrences, measured by a compressor primed with an identifier dictionary counted
over the corpus. Names and prose repeat what the dictionary or the surroundings hold
and add little; random strings add about a byte for each character and are reported,
whatever characters they are made of.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undula.llm.shared import table

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile("AKIA[A-Z0-9]{12,}"), re.compile("[0-9a-f]{32,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Words that make what follows within REACH characters sensitive.
SENSITIVE = (*ASSIGN_WORDS, "passphrase", "credential", "private", "bearer", "authorization", "signature", "access key")
REACH, AROUND = 64, 256
#: A candidate has so many characters at least, and what a base span leaves of one too.
SHORTEST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}")
#: Reported from so many marginal bytes a character on, at this level of compression, which codes known words in few bytes.
NOVELTY, LEVEL = 0.7, 19
#: Identifiers in the dictionary at most, most frequent first, and the documents an identifier must be in.
DICTIONARY_WORDS, DICTIONARY_MIN_DOCS = 20_000, 3
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("novelty", T.DoubleType())])
FOUND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("spans", T.ArrayType(SPAN))])


def identifier_dictionary(docs: DataFrame, words: int = DICTIONARY_WORDS) -> bytes:
    """The identifiers found in most of the documents with sensitive words, the commonest last.

    Counts cover all such documents. The dictionary is a model of bounded size, as a
    compressor can't look back further; it only lowers what known words add.
    """
    sensitive = docs.where(F.col("text").rlike("(?i)" + "|".join(SENSITIVE)))
    names = sensitive.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z_]{3,24}"), F.lit(0)))).alias("w"))
    top = names.groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= DICTIONARY_MIN_DOCS).orderBy(F.desc("n"), "w").limit(words)
    return " ".join([r["w"] for r in top.collect()][::-1] + sorted(SENSITIVE)).encode()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, in code points."""
    out, low = [], text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def merged(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the spans cover, in order, overlapping ones together."""
    starts: list[int] = []
    ends: list[int] = []
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def clear_parts(start: int, end: int, starts: list[int], ends: list[int]) -> Iterator[tuple[int, int]]:
    """The parts of a range that what is covered (starts, ends) leaves."""
    i = bisect_right(ends, start)
    while i < len(starts) and starts[i] < end:
        if start < starts[i]:
            yield start, starts[i]
        start = ends[i]
        i += 1
    if start < end:
        yield start, end


def novel_spans(text: str, taken: list[tuple[str, int, int]], compressor: zstandard.ZstdCompressor, least: float) -> list[tuple[str, int, int, float]]:
    """("novel", start, end, novelty) of the parts of candidates that the spans taken leave, as far as they are long enough themselves."""
    low, size, out, end = text.lower(), lambda s: len(compressor.compress(s.encode())), [], 0
    if not any(w in low for w in SENSITIVE):
        return out
    if len(low) != len(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    starts, ends = merged(taken)
    places = sorted(m.end() for w in SENSITIVE if w in low for m in re.finditer(re.escape(w), low))
    for at in places:
        while first := CANDIDATE.search(text, max(at, end), at + REACH + SHORTEST):
            begin, end = CANDIDATE.match(text, first.start()).span()
            for a, b in clear_parts(begin, end, starts, ends):
                if b - a < SHORTEST:
                    continue
                word = text[a:b]
                # its other occurrences are blanked out, also those that the ends of the surroundings cut
                far, blank = AROUND + len(word), " " * len(word)
                before = text[max(0, a - far) : a].replace(word, blank)[-AROUND:]
                after = text[b : b + far].replace(word, blank)[:AROUND]
                novelty = (size(after + before + word) - size(after + before)) / len(word)
                if novelty >= least:
                    out.append(("novel", a, b, novelty))
    return out


def find_secrets(docs: DataFrame, dictionary: bytes | None = None, least: float = NOVELTY) -> DataFrame:
    """(doc_id, spans): for every row, kind, start, end (exclusive, in code points) and novelty.

    Needs doc_id and text; other columns are not read. A null text is an empty one and
    has no spans. Spans of one kind don't overlap, those of different base kinds may; a
    novel span is clear of base spans: of a candidate that one covers in part, what is
    left is measured, if it is long enough. They come by start, then kind. novelty is null for the fixed patterns. Rows are scanned
    one by one: repeated rows give repeated results, an empty table none.
    dictionary: what identifier_dictionary gives, computed from docs where it is None.
    """
    words = identifier_dictionary(docs) if dictionary is None else dictionary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        primed = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=LEVEL)
        compressor = zstandard.ZstdCompressor(dict_data=primed, write_content_size=False)
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                text = value.as_py() or ""
                base = base_spans(text)
                found = [(*s, None) for s in base] + novel_spans(text, base, compressor, least)
                rows.append([dict(zip(SPAN.names, s)) for s in sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, type=SPANS)], names=FOUND.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FOUND)


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64())]))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans")
    )


QUERIES = {"op2_secrets": op2_secrets}
