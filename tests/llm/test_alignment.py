"""Cross-tokenizer alignment against whole texts encoded one by one."""

import collections
import hashlib
import itertools
import random
from functools import reduce

import numpy as np
import pytest

from undula.llm import alignment

DOCS = "doc_id long, text string, row string, links string, n long"
PARTS = ["a", "the", " ", "  ", "\n", "\t", "é", "中", "\U0001f600", "'s", "12", ".", "<s>", "<|endoftext|>", "\u00a0", "\u3000", "\u200b", "-", "ing", " ing", "\r", "\x1c", "\u0085", "ﬁ", "\u2581"]
ODD = [(1, None), (2, ""), (3, "  \t\n"), (4, "the cat's <|endoftext|> sat"), (5, "one\u2581two three"), (6, "the cat sat "), (6, "the cat sat "), (None, "the cat"), (7, "x" * 3000), (8, " \n  lead  and  gaps \n"), (9, "中文" * 400 + " the end " * 200), (10, "one\u2581two " * 300)]


@pytest.fixture(scope="module")
def encoder():
    return alignment.PairEncoder(alignment.BYTE_BPE, alignment.PIECE_BPE)


def plain(encoder, text):
    """(ids of A, ids of B, groups as pairs of lists) of a whole text."""
    a, b = encoder.a.encode(f" {text}", add_special_tokens=False).ids, encoder.b.encode(text or "")
    if not text or not (b"".join(encoder.a_bytes[i] for i in a) == f" {text}".encode() == b"".join(encoder.b_bytes[i] for i in b)):
        return [], [], []
    groups, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        x, y, n, m = [], [], 0, 0
        while not n or n != m:
            if n <= m:
                x.append(a[i])
                n += len(encoder.a_bytes[a[i]])
                i += 1
            else:
                y.append(b[j])
                m += len(encoder.b_bytes[b[j]])
                j += 1
        groups.append((x, y))
    return a, b, groups


def brute_force(encoder, rows):
    found = [(d, *plain(encoder, t)) for d, t in rows]
    count = collections.Counter((x[-1], y[-1]) for *_, groups in found for x, y in groups)
    most = collections.defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for d, a, b, groups in found:
        links = [(x[-1], y[-1]) for x, y in groups]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((d, len(a), len(b), len(groups), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


def rows_of(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark, sf_dir, encoder):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert rows_of(alignment.op11_alignment(spark, sf_dir)) == sorted(brute_force(encoder, rows), key=str)


@pytest.mark.parametrize("long_bytes", [1 << 16, 40])
def test_odd_rows_whole_and_by_pieces(spark, encoder, long_bytes):
    """Nulls, blank and odd texts, repeated rows, clashing columns; the same whole and by pieces of few characters."""
    docs = spark.createDataFrame([(d, t, "clash", "clash", 0) for d, t in ODD], DOCS)
    assert rows_of(alignment.align(docs, long_bytes=long_bytes, piece_chars=10)) == sorted(brute_force(encoder, ODD), key=str)


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], DOCS)).count() == 0


def test_chunks_give_what_whole_texts_give(encoder):
    rng = random.Random(1)
    for _ in range(2000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 25)))
        a, b, groups = plain(encoder, text)
        same, n_a, n_b, got, links = next(encoder.align([f" {text}"]))
        if same or groups:
            assert (n_a, n_b) == (len(a), len(b)) and got.decode() == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
            assert links.tolist() == [x[-1] << 32 | y[-1] for x, y in groups]
        assert "".join(alignment.pieces_of(text, 3)) == f" {text}"


def test_fragments_of_any_byte_ranges_compose_in_any_order(encoder):
    rng = random.Random(2)
    for _ in range(500):
        text = "".join(rng.choice(PARTS[:12]) for _ in range(rng.randint(1, 20)))
        a, b, groups = plain(encoder, text)
        ends_a, ends_b = np.cumsum(encoder.a_size[a]), np.cumsum(encoder.b_size[b])
        n = len(f" {text}".encode())
        cuts = [0, *sorted(rng.sample(range(1, n + 1), min(4, n))), n]
        parts = [alignment.lift(a, ends_a, b, ends_b, i, j) for i, j in itertools.pairwise(cuts)]
        left = reduce(alignment.compose, parts, alignment.EMPTY)
        right = reduce(lambda y, x: alignment.compose(x, y), parts[::-1], alignment.EMPTY)
        assert left == right and alignment.finished(left) == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
