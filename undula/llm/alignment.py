"""Cross-tokenizer alignment: where the tokens of two tokenizers end together.

A text is encoded by a byte-level tokenizer (A) and by one of pieces (B). Both end a
token at many byte offsets, which cut their tokens into groups. What a byte range of a
text gives is a fragment: an open prefix up to the first common end, closed groups, and
an open suffix behind the last one. Fragments compose associatively, so those of a
very long text come from tasks of their own and are put together by a tree.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm.shared import broadcast_if_small, checkpointed, release_memory, table
from undula.llm.tokens import slices

BYTE_BPE, PIECE_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Texts of more bytes are cut into pieces of about so many characters, which tasks encode one by one.
LONG_BYTES, PIECE_CHARS = 1 << 16, 1 << 14
#: Fragments that a step of the tree composes.
FAN = 16
#: Pairs of ids up to so many are broadcast with their counts, some 40 bytes each.
BROADCAST_PAIRS = 4_000_000
#: A worker keeps what at most so many chunks of up to CACHED_CHARS characters give; results don't depend on it.
CACHED, CACHED_CHARS = 200_000, 40
#: New chunks that are encoded as one text.
TOGETHER = 1000
#: A blank between a character that is none and one that is no white space: both tokenizers start a token there.
#: (The four others are no white space by some tables only, so nothing is cut before them.)
_NO_CUT = "\\s\u180e\u200b\u2060\ufeff"
CUT = re.compile(f"(?<=[^ ]) (?=[^{_NO_CUT}])")
#: Where cutting at each blank would not be the same as CUT.
ODD_BLANK = re.compile(f" (?:[{_NO_CUT}]|$)")


class Fragment(NamedTuple):
    """Tokens of a byte range: ids as decimals joined by commas, groups as `a1,a2|b1` joined by semicolons.

    Without a common end (`cut`) all tokens are in the prefix. With one, the prefix runs
    to the first, `closed` has the groups up to the last, the suffix what is left.
    """

    cut: bool
    prefix_a: str
    prefix_b: str
    closed: str
    suffix_a: str
    suffix_b: str


EMPTY = Fragment(False, "", "", "", "", "")


def _joined(mark: str, *parts: str) -> str:
    return mark.join(p for p in parts if p)


def compose(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges; associative, EMPTY being its unit."""
    a, b = (x.suffix_a, x.suffix_b) if x.cut else (x.prefix_a, x.prefix_b)
    a, b = _joined(",", a, y.prefix_a), _joined(",", b, y.prefix_b)
    if not x.cut:
        return Fragment(y.cut, a, b, y.closed, y.suffix_a, y.suffix_b)
    if not y.cut:
        return x._replace(suffix_a=a, suffix_b=b)
    return Fragment(True, x.prefix_a, x.prefix_b, _joined(";", x.closed, f"{a}|{b}", y.closed), y.suffix_a, y.suffix_b)


def lift(a: Sequence[int], a_ends: np.ndarray, b: Sequence[int], b_ends: np.ndarray, low: int, high: int) -> Fragment:
    """The fragment of the byte range (low, high]: the tokens that end there."""
    ids = []
    for x, ends in ((a, a_ends), (b, b_ends)):
        i, j = np.searchsorted(ends, [low, high], "right")
        ids.append((list(map(str, x[i:j])), ends[i:j]))
    (xa, ea), (xb, eb) = ids
    common = np.intersect1d(ea, eb)
    if not len(common):
        return Fragment(False, ",".join(xa), ",".join(xb), "", "", "")
    at, bt = ([0, *(np.searchsorted(e, common) + 1).tolist()] for e in (ea, eb))
    groups = [f"{','.join(xa[i:j])}|{','.join(xb[k:m])}" for i, j, k, m in zip(at, at[1:], bt, bt[1:])]
    first_a, _, first_b = groups[0].partition("|")
    return Fragment(True, first_a, first_b, ";".join(groups[1:]), ",".join(xa[at[-1] :]), ",".join(xb[bt[-1] :]))


def finished(whole: Fragment) -> str:
    """The groups of a whole text; what no common end closes can only be nothing, as both tokenizers end with the text."""
    return _joined(";", f"{whole.prefix_a}|{whole.prefix_b}" if whole.prefix_a or whole.prefix_b else "", whole.closed)


def chunks_of(spaced: str) -> list[str]:
    """A text that begins with a blank, cut at CUT, each chunk without its first blank."""
    return spaced[1:].split(" ") if not ODD_BLANK.search(spaced) else [c[1:] for c in _cut_before(spaced)]


def _cut_before(spaced: str) -> Iterator[str]:
    start = 0
    for m in CUT.finditer(spaced):
        yield spaced[start : m.start()]
        start = m.start()
    yield spaced[start:]


def pieces_of(text: str, size: int) -> Iterator[str]:
    """The text behind a blank in pieces that begin with a blank, cut at the first CUT after `size` characters; whole if there is none."""
    spaced, start = f" {text}", 0
    while (m := CUT.search(spaced, start + size)) is not None:
        yield spaced[start : m.start()]
        start = m.start()
    yield spaced[start:]


class PairEncoder:
    """Encodes chunks by both tokenizers and keeps what they give: a text's groups are its chunks', one after another."""

    def __init__(self, byte_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        of = byte_values()
        vocabulary = self.a.get_vocab()
        self.a_bytes: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(names)]
        self.a_size, self.b_size = (np.array([len(x) for x in t]) for t in (self.a_bytes, self.b_bytes))
        self.names = [f"{i}{mark}" for i in range(max(len(self.a_bytes), len(self.b_bytes))) for mark in ",|;\n"]
        self.forget()

    def forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.links: list[bytes] = []
        self.sizes = np.zeros((1024, 3), np.int64)  # tokens of A, of B, and whether the bytes are the chunk's

    def ids(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of blank + chunk by A and by B, which puts a blank before a text itself."""
        a = [x.ids for x in self.a.encode_batch_fast([f" {c}" for c in chunks], add_special_tokens=False)]
        return a, self.b.encode(chunks, num_threads=1)

    def _given_back(self, chunks: list[str], a: list[list[int]], b: list[list[int]]) -> list[bool]:
        """For each chunk, whether the bytes of both tokenizers' tokens are those of blank + chunk."""
        raw = [f" {c}".encode() for c in chunks]
        return [b"".join([self.a_bytes[i] for i in x]) == r == b"".join([self.b_bytes[i] for i in y]) for r, x, y in zip(raw, a, b)]

    def _together(self, chunks: list[str], raw: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """(ids, number for each chunk) by A and by B of chunks encoded as one text; None if either doesn't give its bytes back.

        Chunks begin and end with characters that are no blanks, so both tokenizers start a token at each.
        """
        whole, ends = b"".join(raw), np.cumsum([len(r) for r in raw])
        a = self.a.encode_batch_fast([whole.decode()], add_special_tokens=False)[0].ids
        b = self.b.encode(" ".join(chunks))
        if not b"".join([self.a_bytes[i] for i in a]) == whole == b"".join([self.b_bytes[i] for i in b]):
            return None
        found = []
        for ids, size in ((np.array(a, np.int64), self.a_size), (np.array(b, np.int64), self.b_size)):
            last = np.searchsorted(np.cumsum(size[ids]), ends, "right")
            found.append((ids, np.diff(last, prepend=0)))
        return found

    def _encoded(self, chunks: list[str]) -> tuple[list[str], list[str], list[np.ndarray], list[np.ndarray]]:
        """(chunks that are given back, others, ids by A and B, numbers of ids of each chunk by A and B)."""
        plain = [c for c in chunks if c and c[-1] != " " and not ODD_BLANK.match(f" {c[0]}")]
        good, bad, parts, alone = [], [], [], [c for c in chunks if not c or c[-1] == " " or ODD_BLANK.match(f" {c[0]}")]
        for i in range(0, len(plain), TOGETHER):
            block = plain[i : i + TOGETHER]
            if (found := self._together(block, [f" {c}".encode() for c in block])) is None:
                alone += block
            else:
                good += block
                parts.append(found)
        if alone:
            a, b = self.ids(alone)
            same = self._given_back(alone, a, b)
            kept = [i for i, s in enumerate(same) if s]
            good += [alone[i] for i in kept]
            bad = [c for c, s in zip(alone, same) if not s]
            parts.append([(np.fromiter(itertools.chain.from_iterable([x[i] for i in kept]), np.int64), np.array([len(x[i]) for i in kept], np.int64)) for x in (a, b)])
        return good, bad, *([np.concatenate([p[side][k] for p in parts]) for side in (0, 1)] for k in (0, 1))

    def _learn(self, chunks: list[str]) -> None:
        """Keep what new chunks give, all of them worked out together: their byte offsets run on from one to the next."""
        good, bad, flat, n = self._encoded(chunks)
        first = len(self.groups)
        while len(self.sizes) < first + len(chunks):
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.sizes[first : first + len(chunks)] = 0
        self.sizes[first : first + len(good)] = np.stack([*n, np.ones_like(n[0])], 1)
        self.slots.update(zip([*good, *bad], range(first, first + len(chunks))))
        ends = [np.cumsum(size[ids]) for size, ids in zip((self.a_size, self.b_size), flat)]
        common = np.intersect1d(*ends, assume_unique=True)
        at_a, at_b = (np.searchsorted(e, common) + 1 for e in ends)
        from_a, from_b = (np.concatenate([[0], x[:-1]]).astype(np.int64) for x in (at_a, at_b))
        last = np.searchsorted(at_a, np.cumsum(n[0]))  # the last group of each chunk
        links = (flat[0][at_a - 1] << 32 | flat[1][at_b - 1]).tobytes()

        # the ids group by group, those of A before those of B, each with the mark after it
        order = np.empty(sum(map(len, flat)), np.int64)
        group_a, group_b = (np.repeat(np.arange(len(common)), x - y) for x, y in ((at_a, from_a), (at_b, from_b)))
        mark_b = np.full(len(common), 2)
        mark_b[last] = 3
        for ids, to, final, mark in ((flat[0], np.arange(len(flat[0])) + from_b[group_a], at_a, 1), (flat[1], np.arange(len(flat[1])) + at_a[group_b], at_b, mark_b)):
            marks = np.zeros(len(ids), np.int64)
            marks[final - 1] = mark
            order[to] = 4 * ids + marks
        groups = "".join([self.names[i] for i in order.tolist()]).encode().split(b"\n")[: len(good)]
        cuts = [0, *(8 * (last + 1)).tolist()]
        self.groups += groups + [b""] * len(bad)
        self.links += [links[i:j] for i, j in zip(cuts, cuts[1:])] + [b""] * len(bad)

    def align(self, spaced: list[str]) -> Iterator[tuple[bool, int, int, bytes, np.ndarray]]:
        """For each text that begins with a blank: (same bytes, tokens of A, of B, groups, links as A's id * 2^32 + B's)."""
        each = [chunks_of(s) for s in spaced]
        flat = list(itertools.chain.from_iterable(each))
        if len(self.slots) > CACHED:
            self.forget()
        slots = list(map(self.slots.get, flat))
        new = list(dict.fromkeys([c for c, s in zip(flat, slots) if s is None]))
        short, long = [c for c in new if len(c) <= CACHED_CHARS], [c for c in new if len(c) > CACHED_CHARS]
        for some in (short, long):
            if some:
                self._learn(some)
        if new:
            slots = list(map(self.slots.__getitem__, flat))
        at, start = np.array(slots), 0
        for own in each:
            mine, listed = at[start : start + len(own)], slots[start : start + len(own)]
            start += len(own)
            n_a, n_b, same = self.sizes[mine].sum(0).tolist()
            yield same == len(own), n_a, n_b, b";".join([self.groups[i] for i in listed]), np.frombuffer(b"".join([self.links[i] for i in listed]), np.int64)
        if long:  # they came last, and don't stay
            for c in long:
                del self.slots[c]
            del self.groups[-len(long) :], self.links[-len(long) :]


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


_encoders: dict[tuple[str, str], PairEncoder] = {}


def pair_encoder(byte_path: str, piece_path: str) -> PairEncoder:
    """The worker's encoder for these files, kept between tasks."""
    if (byte_path, piece_path) not in _encoders:
        _encoders[byte_path, piece_path] = PairEncoder(byte_path, piece_path)
    return _encoders[byte_path, piece_path]


def _row_numbers() -> Iterator[int]:
    """Numbers that no other task of the stage gives; they are written at once, and then read only."""
    return itertools.count(TaskContext.get().partitionId() << 33)


def _counted(links: list[np.ndarray]) -> list[pa.Array]:
    """Each one's distinct links, and how often it has them."""
    found = [np.unique(x, return_counts=True) for x in links]
    offsets = np.cumsum([0, *(len(x) for x, _ in found)]).astype(np.int32)
    flat = [np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in (0, 1)]
    return [pa.ListArray.from_arrays(offsets, pa.array(flat[0], pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(flat[1].astype(np.int32)))]


WHOLE = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<long>, counts array<int>"
PIECE = "row long, piece int, same boolean, n_a long, n_b long, n_links long, cut boolean, prefix_a string, prefix_b string, closed string, suffix_a string, suffix_b string, links array<long>, counts array<int>"
NO_LINKS = np.empty(0, np.int64)


def _whole_texts(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """A row of WHOLE for each of docs (doc_id, text), its text encoded by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number = pair_encoder(byte_path, piece_path), _row_numbers()
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                found = iter(encoder.align([f" {t}" for t in texts if t]))
                rows, links = [], []
                for text in texts:
                    same, n_a, n_b, groups, own = next(found) if text else (False, 0, 0, b"", NO_LINKS)
                    links.append(own if same else NO_LINKS)
                    rows.append((next(number), n_a, n_b, len(own), hashlib.sha256(groups).hexdigest()) if same else (next(number), 0, 0, 0, ""))
                row, n_a, n_b, n_groups, digest = map(list, zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(row), part.column("doc_id"), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(n_groups, pa.int64()), pa.array(digest), *_counted(links)], names=[c.split()[0] for c in WHOLE.split(", ")])
        encoder.forget()
        release_memory()

    return docs.mapInArrow(run, WHOLE)


def _pieces(docs: DataFrame, size: int) -> DataFrame:
    """(row, doc_id, piece, text) of long texts, in pieces of about `size` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _row_numbers()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                row = next(number)
                for i, piece in enumerate(pieces_of(text.as_py(), size)):
                    yield pa.RecordBatch.from_pylist([{"row": row, "doc_id": doc_id.as_py(), "piece": i, "text": piece}], pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("text", pa.string())]))

    return docs.mapInArrow(run, "row long, doc_id long, piece int, text string")


def _fragments(pieces: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """A row of PIECE for each piece (row, piece, text): its fragment and its links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pair_encoder(byte_path, piece_path)
        for batch in batches:
            for part in slices(batch):
                rows, links = [], []
                for row, piece, (same, n_a, n_b, groups, own) in zip(part.column("row").to_pylist(), part.column("piece").to_pylist(), encoder.align(part.column("text").to_pylist())):
                    first, _, closed = groups.decode().partition(";")
                    a, _, b = first.partition("|")
                    rows.append((row, piece, same, n_a, n_b, len(own), *(Fragment(True, a, b, closed, "", "") if same else EMPTY)))
                    links.append(own if same else NO_LINKS)
                kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
                named = [c.split() for c in PIECE.split(", ")]
                yield pa.RecordBatch.from_arrays([*(pa.array(list(c), kinds[k]) for c, (_, k) in zip(zip(*rows), named)), *_counted(links)], names=[n for n, _ in named])
        encoder.forget()
        release_memory()

    return pieces.select("row", "piece", "text").mapInArrow(run, PIECE)


def composed(fragments: DataFrame) -> DataFrame:
    """(row, fragment columns): the fragments (row, piece, fragment columns) of each row composed in order, FAN at a time."""
    names = list(Fragment._fields)
    schema = "row long, piece int, cut boolean, " + ", ".join(f"{n} string" for n in names[1:])

    def step(rows: pa.Table) -> pa.Table:
        rows, out = rows.sort_by("piece"), EMPTY
        for i in range(rows.num_rows):
            out = compose(out, Fragment(*(rows.column(n)[i].as_py() for n in names)))
        first = {"row": rows.column("row")[0].as_py(), "piece": rows.column("piece")[0].as_py() // FAN}
        return pa.Table.from_pylist([first | out._asdict()], pa.schema([("row", pa.int64()), ("piece", pa.int32()), ("cut", pa.bool_()), *((n, pa.string()) for n in names[1:])]))

    left = fragments.select("row", "piece", *names)
    while (left.agg(F.max("piece")).first()[0] or 0) > 0:
        left = checkpointed(left.groupBy("row", F.floor(F.col("piece") / FAN).alias("_up")).applyInArrow(step, schema))
    return left.select("row", *names)


def align(docs: DataFrame, byte_path: str = BYTE_BPE, piece_path: str = PIECE_BPE, long_bytes: int = LONG_BYTES, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of docs.

    Needs doc_id and text; other columns are not read. A text is encoded as blank + text,
    special tokens' strings being plain text. Texts that are null or empty, or that either
    tokenizer doesn't give back byte for byte, have no tokens: zeros and an empty digest.
    Repeated rows are aligned and counted each, rows without a doc_id too. An empty table
    gives no rows.

    Two tokens that end together are linked. n_best: the links whose pair of ids is the
    commonest of its B id over all rows, ties included; count_sum: over the row's links,
    how often their pairs are linked over all rows.

    A text is cut at blanks where both tokenizers begin a token, which is a common end. So
    chunks are encoded by themselves, and once where they repeat. A text without such
    blanks is one chunk. Texts of more than long_bytes are dealt to tasks by pieces,
    and their fragments are composed by a tree.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    is_long = F.coalesce(F.octet_length("text") > long_bytes, F.lit(False))
    whole = checkpointed(_whole_texts(texts.where(~is_long), byte_path, piece_path))
    pieces = checkpointed(_pieces(texts.where(is_long), piece_chars))
    parts = checkpointed(_fragments(pieces.repartition(spark.sparkContext.defaultParallelism * 4, "row", "piece"), byte_path, piece_path))
    odd = parts.where("not same").select("row").distinct()
    good = checkpointed(parts.join(odd, "row", "left_anti"))
    long_groups = composed(good)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fragments = zip(*(batch.column(n).to_pylist() for n in Fragment._fields))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([hashlib.sha256(finished(Fragment(*f)).encode()).hexdigest() for f in fragments])], names=["row", "groups_sha256"])

    sums = good.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("n_a", "n_b", "n_links")])
    long = pieces.where("piece = 0").select("row", "doc_id").join(sums, "row", "left").join(long_groups.mapInArrow(digest, "row long, groups_sha256 string"), "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    # negative numbers tell long texts from the others; each group of a whole text ends with one link
    mark = lambda df: df.withColumn("row", -F.col("row") - 1)
    long = mark(long).select("row", "doc_id", zero("n_a").alias("n_a"), zero("n_b").alias("n_b"), zero("n_links").alias("n_groups"), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
    rows = whole.drop("links", "counts").unionByName(long)

    each = whole.select("row", "links", "counts").unionByName(mark(good).select("row", "links", "counts"))
    each = each.select("row", F.explode(F.arrays_zip("links", "counts")).alias("x")).select("row", F.col("x.links").alias("pair"), F.col("x.counts").cast("long").alias("n"))
    counts = checkpointed(each.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))  # at most a row for each id of B
    pairs = counts.join(F.broadcast(most), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    scored = each.join(broadcast_if_small(checkpointed(pairs), BROADCAST_PAIRS), "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    out = rows.join(scored, "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), zero("n_best").alias("n_best"), zero("count_sum").alias("count_sum"), "groups_sha256")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))


QUERIES = {"op11_alignment": op11_alignment}
