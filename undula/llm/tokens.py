"""Token ids of whole texts, by a public tokenizer whose file is a parameter."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

from undula.llm.shared import release_memory

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
#: A worker keeps the ids of at most so many pieces seen repeatedly, and of as many recent ones; results don't depend on it.
CACHED = 200_000
#: Pieces above this length are not kept.
CACHED_CHARS = 60
#: A word of Latin letters and the marks after it: one piece each, by the pattern of the tokenizer.
WORD_AND_MARKS = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!\"#$%&()*+,\-./:;=?@\[\\\]^_`{}~]*)$"
#: Bytes of text encoded at a time, about; a longer text is encoded by itself.
SLICE_BYTES = 1 << 20
_encoders: dict[str, ChunkEncoder] = {}


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about `most` bytes of text, so that memory doesn't grow with the texts' lengths."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64) + 64
    part = (np.cumsum(sizes) - sizes) // most
    cuts = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


class ChunkEncoder:
    """Encodes texts chunk by chunk, a chunk being what stands between blanks and line feeds.

    For lower-casing tokenizers whose pieces never span white space, which drop it, and
    which mark the last token of each piece: there the ids of a text are those of its
    chunks, one after another, and words encoded together can be told apart.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # for words already in lower case, cut and composed: the same model without the steps that would do that
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.recent: dict[str, bytes] = {}

    def forget(self) -> None:
        """Drop the kept ids, at the end of a task; the tokenizer stays."""
        self.known.clear()
        self.recent.clear()
        release_memory()

    def _each(self, pieces: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(pieces), 2000):
            out += [np.asarray(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(pieces[i : i + 2000], add_special_tokens=False)]
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of words that are one piece each, encoded as one text and cut after last tokens."""
        if not words:
            return []
        ids = np.asarray(self.plain.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts, whole = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()], ids.tobytes()
        return [whole[a:b] for a, b in zip(cuts, cuts[1:])]

    def _ids_of(self, pieces: pa.Array, encode: Callable[[list[str]], list[bytes]]) -> np.ndarray:
        """The ids of each piece, of which distinct ones are looked up and new ones encoded together."""
        coded = pieces.dictionary_encode()
        names, known, recent = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self.known, self.recent
        if len(known) > CACHED:
            known.clear()
        found = list(map(known.get, names))
        new = [x for x, v in zip(names, found) if v is None]
        again = [x for x in new if x in recent]
        known.update([(x, recent.pop(x)) for x in again])
        new = [x for x in new if x not in known] if again else new
        fresh = dict(zip(new, encode(new), strict=True))
        if len(recent) + len(fresh) > CACHED:
            recent.clear()
        if len(fresh) <= CACHED:
            recent.update((x, v) for x, v in fresh.items() if len(x) <= CACHED_CHARS)
        held = np.empty(len(names), object)
        held[:] = [v if v is not None else known[x] if x in known else fresh[x] for x, v in zip(names, found)]
        return held[coded.indices.to_numpy()]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the unsigned 32-bit ids of all texts, end_id after each, and where each text's ids end.

        A null or an empty text has end_id alone. Chunks are told apart and counted
        once by Arrow; what is looked up and encoded are the distinct ones.
        """
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        split = pc.extract_regex(coded.dictionary, WORD_AND_MARKS)
        plain = pc.is_valid(split)
        words, marks = (pc.struct_field(split, i).filter(plain) for i in (0, 1))
        held, rest = np.empty(len(coded.dictionary), object), ~plain.to_numpy(zero_copy_only=False)
        held[~rest] = self._ids_of(pc.utf8_lower(words), self._words) + self._ids_of(marks, self._each)
        held[rest] = self._ids_of(coded.dictionary.filter(pc.invert(plain)), self._each)
        held = held.tolist()
        pool, size = np.frombuffer(b"".join(held), "<u4"), np.fromiter(map(len, held), np.int64, len(held)) // 4
        start, at = np.cumsum(size) - size, coded.indices.to_numpy()
        n = size[at]
        last = np.cumsum(n)
        ids = pool[np.repeat(start[at] - (last - n), n) + np.arange(last[-1] if len(last) else 0)]
        chunks = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = last[np.cumsum(chunks) - 1] if len(last) else np.zeros(len(lists), np.int64)
        return np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)


def encoder(path: str = WORD_BPE) -> ChunkEncoder:
    """The worker's encoder for this file, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]
