"""Problem 6: token ids of whole corpora by a public byte-level BPE, exact for texts of any length."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the vocabulary files lie, and which one is used.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: A longer text is encoded by halves until no part is longer, in characters; an unsplit stretch (one pre-token), in bytes.
LEAF = 4096
#: Tokens on each side of a join that are encoded anew at first.
REACH = 4
#: The parts of a text over so many characters are encoded by several threads of its worker.
THREADED, THREADS = 1_000_000, 4
# Fixed value: how the public tokenizer cuts text before merging bytes.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


class Codec:
    """A vocabulary; ``encode`` gives the ids of a text without special tokens (their strings are ordinary text)."""

    def __init__(self, folder: str, name: str) -> None:
        import regex
        import tiktoken

        lines = (Path(folder) / f"{name}.tiktoken").read_bytes().splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line)}
        self.plain = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.words = regex.compile(PATTERN)
        self.runs = regex.compile(r"\p{L}{%d,}|\p{N}{%d,}|[^\s\p{L}\p{N}]{%d,}|\s{%d,}" % ((LEAF // 4,) * 4))
        self.bytes = {v: k for k, v in ranks.items()}
        # a space before another character always begins a pre-token, whatever stands around it
        self.begins = np.zeros(max(ranks.values(), default=0) + 1, bool)
        for token, rank in ranks.items():
            self.begins[rank] = len(token) > 1 and token[0] == 32 and 33 <= token[1] <= 126
        self._fits: dict[tuple[int, int], bool] = {}

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text without long unsplit stretches, at once."""
        return np.asarray(self.plain.encode_to_numpy(text, allowed_special=set(), disallowed_special=()), np.int32) if text else np.empty(0, np.int32)

    def text(self, text: str | None) -> np.ndarray:
        """Ids of a text of any length, which may be null."""
        if not text:
            return np.empty(0, np.int32)
        # a stretch so long covers a whole block of half its length, without a space or of white space only
        half = LEAF // 8
        if any(text.find(" ", k, k + half) < 0 or text[k : k + half].isspace() for k in range(0, len(text) - half + 1, half)) and self.runs.search(text):
            return self._with_runs(text)
        return self.tree(text)

    def _leaves(self, parts: list[str], whole: int) -> list[np.ndarray]:
        if whole <= THREADED:
            return [self.encode(p) for p in parts]
        return [np.asarray(x, np.int32) for x in self.plain.encode_ordinary_batch(parts, num_threads=THREADS)]

    def tree(self, text: str, leaf: int = LEAF) -> np.ndarray:
        """Ids by tree concatenation: those of equal parts, neighbours joined two by two until one is left."""
        return self._joined(text, leaf, self.concatenated)

    def by_halves(self, piece: str, leaf: int = LEAF // 4) -> np.ndarray:
        """The same for one pre-token, of which every part is one too."""
        return self._joined(piece, leaf, self.join)

    def _joined(self, text: str, leaf: int, join: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        count = 1
        while count * leaf < len(text):
            count *= 2
        if count == 1:
            return self.encode(text)
        at = [len(text) * k // count for k in range(count + 1)]
        level = self._leaves([text[a:b] for a, b in zip(at, at[1:], strict=False)], len(text))
        while len(level) > 1:
            level = [join(level[k], level[k + 1]) for k in range(0, len(level), 2)]
        return level[0]

    def concatenated(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the concatenation of two encoded texts.

        A window around the join is encoded anew.  It grows until it begins and ends where a pre-token surely begins (or
        at an end of a text) and its encoding has the first token there of the left text and the last one of the right:
        what is outside then encodes as it did, since a pre-token depends on what follows its start only.
        """
        reach = REACH
        while True:
            starts = np.flatnonzero(self.begins[left[max(0, len(left) - 8 * reach) : max(0, len(left) - reach)]])
            ends = np.flatnonzero(self.begins[right[reach : 8 * reach]])
            a = int(starts[-1]) + max(0, len(left) - 8 * reach) if len(starts) else 0
            b = int(ends[0]) + reach if len(ends) else len(right)
            far = 8 * reach >= max(len(left), len(right))
            if far or ((len(starts) or a + 8 * reach >= len(left)) and (len(ends) or 8 * reach >= len(right))):
                inner = self.encode(b"".join(self.bytes[int(t)] for t in (*left[a:], *right[:b])).decode())
                if far or ((not a or inner[0] == left[a]) and (b == len(right) or inner[-1] == right[b - 1])):
                    return np.concatenate([left[:a], inner, right[b:]])
            reach *= 2

    def _with_runs(self, text: str) -> np.ndarray:
        """Text that holds a long unsplit stretch: such pre-tokens by halves of their own, what lies between them as texts."""
        parts, done = [], 0
        for m in self.words.finditer(text):
            a, b = m.span()
            if b - a < LEAF // 4:
                continue
            parts += [*(self.tree(x) for x in self.apart(text, done, a)), self.by_halves(text[a:b])]
            done = b
        parts.append(self.tree(text[done:]))
        return np.concatenate(parts)

    def apart(self, text: str, done: int, end: int) -> list[str]:
        """What stands in ``text`` between two pre-tokens' ends ``done`` and ``end``, in pieces that encode independently.

        White space before ``end`` would be taken for the end of the text, so its pre-tokens, as the whole text has them,
        are each a piece.
        """
        last = done + len(text[done:end].rstrip())
        pieces, at = [], done
        for m in self.words.finditer(text, max(done, last - 1)):
            if m.start() >= end:
                break
            if m.start() >= last:
                pieces.append(text[at : m.start()])
                at = m.start()
        return [p for p in (*pieces, text[at:end]) if p]

    def _merge(self, piece: bytes) -> list[int]:
        return self.plain._encode_single_piece(piece)

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the concatenation of two encoded byte strings of one pre-token.

        A window around the join is encoded anew and grows until both its ends agree with what is outside.  A
        sequence of tokens is the encoding of its bytes exactly when each two neighbours are the encoding of theirs,
        so agreement of the two outer pairs proves the whole.
        """
        reach = REACH
        while True:
            a, b = max(0, len(left) - reach), min(len(right), reach)
            inner = np.asarray(self._merge(b"".join(self.bytes[int(t)] for t in (*left[a:], *right[:b]))), np.int32)
            if (a == 0 or self.agree(int(left[a - 1]), int(inner[0]))) and (b == len(right) or self.agree(int(inner[-1]), int(right[b]))):
                return np.concatenate([left[:a], inner, right[b:]])
            reach *= 2

    def agree(self, a: int, b: int) -> bool:
        """Whether tokens a, b stay apart when encoded together."""
        if (known := self._fits.get((a, b))) is None:
            known = self._fits[a, b] = self._merge(self.bytes[a] + self.bytes[b]) == [a, b]
        return known


@lru_cache(maxsize=4)
def codec(folder: str, name: str) -> Codec:
    """The vocabulary, read once in each worker."""
    return Codec(folder, name)


def _lists(found: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(found) + 1, np.int32)
    np.cumsum([len(x) for x in found], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.empty(0, np.int32), pa.int32()))


def _slices(batch: pa.RecordBatch, column: int, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in parts of bounded text, so that a worker's memory is bounded by its longest text."""
    sizes = pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    a, held = 0, 0
    for k, n in enumerate(sizes):
        if held and held + n > chars:
            yield batch.slice(a, k - a)
            a, held = k, 0
        held += n
    yield batch.slice(a)


def _encoded(df: DataFrame, key: str, text: str, folder: str, vocabulary: str, name: str, kind: T.DataType, made: Callable[[list[np.ndarray]], pa.Array]) -> DataFrame:
    """One pass over the rows without a shuffle: the key, and what ``made`` makes of a batch's ids."""
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    schema = T.StructType([T.StructField(key, rows.schema["k"].dataType), T.StructField(name, kind)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(folder, vocabulary)
        for whole in batches:
            for batch in _slices(whole, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0), made([own.text(x) for x in batch.column(1).to_pylist()])], names=[key, name])

    return rows.mapInArrow(work, schema)


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids): each row's token ids, as the public tokenizer gives them for the whole text.

    One pass without a shuffle.  A text over ``LEAF`` characters is encoded in parts, which are joined exactly two by two
    (``Codec.concatenated``), inside an unsplit stretch too (``Codec.join``).  ``folder`` must lie at the same place on
    every executor.  Null and empty text: empty list; repeated rows stay repeated; other columns are not read.
    """
    return _encoded(df, key, text, folder, vocabulary, "ids", T.ArrayType(T.IntegerType()), _lists)


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_token): the number of token ids of each row's text; 0 for null and empty text.  Ids don't leave Python."""
    return _encoded(df, key, text, folder, vocabulary, "n_token", T.LongType(), lambda found: pa.array([len(x) for x in found], pa.int64()))
