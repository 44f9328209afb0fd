"""Byte-level BPE: texts to token ids with character offsets, and back to bytes.

The merges run in the ``tokenizers`` library. Each Arrow batch is cut into pieces by the
pre-tokenizer pattern, the distinct pieces not met before go to the library in one call,
and the ids are put together from the pieces. A piece never depends on its neighbours, so
this gives the ids of a whole-text call at a fraction of its cost on natural word frequencies.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .common import append_columns, texts

RANKS = "byte_bpe_50k.tiktoken"
PATTERN = public_tokenizers.PATTERN


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: bytes
    that print stand for themselves, the others take the characters from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to id, from the lines ``base64 id`` of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class Bpe:
    """One vocabulary in a worker, with the pieces met so far.

    Every split of a token into two tokens is listed as a merge in order of the token's
    rank, since rank files name the result of a merge and not its parts.
    """

    PIECES, CALL = 600_000, 512

    def __init__(self, data: bytes, pattern: str):
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks = read_ranks(data)
        chars = byte_chars()
        spell = {t: "".join(map(chars.__getitem__, t)) for t in ranks}
        merges = [(spell[t[:k]], spell[t[k:]]) for t in sorted(ranks, key=ranks.get) if len(t) > 1
                  for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.library = Tokenizer(models.BPE(vocab={spell[t]: i for t, i in ranks.items()},
                                            merges=merges))
        self.library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False,
                                                              use_regex=False)
        self.split = regex.compile(pattern).findall
        by_id: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            by_id[i] = t
        self.tokens = pa.array(by_id, pa.large_binary())
        self.lengths = np.array([len(t or b"") for t in by_id], np.int64)
        self._forget()

    def _forget(self) -> None:
        self.pieces = _Numbered()
        self.starts, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _learn(self, fresh: list[str]) -> None:
        """Ids of new pieces. Many pieces go to the library as one sequence of words, whose
        tokens come back with the number of their word."""
        ids, counts = [], []
        for k in range(0, len(fresh), self.CALL):
            words = fresh[k:k + self.CALL]
            e = self.library.encode(words, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(e.ids, np.int32))
            counts.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(words)))
        counts = np.concatenate(counts)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, *ids])

    def encode(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids of the batch, where each text's ids begin, with the end)."""
        if len(self.pieces) > self.PIECES:
            self._forget()
        numbers, ends = [np.zeros(0, np.int64)], [0]
        for t in batch:
            pieces = self.split(t)
            numbers.append(np.fromiter(map(self.pieces.__getitem__, pieces), np.int64, len(pieces)))
            ends.append(ends[-1] + len(pieces))
        if self.pieces.fresh:
            self._learn(self.pieces.fresh)
            self.pieces.fresh = []
        at = np.concatenate(numbers)
        counts = self.counts[at]
        begin = np.concatenate([[0], np.cumsum(counts)])
        flat = self.ids[np.repeat(self.starts[at] - begin[:-1], counts) + np.arange(begin[-1])]
        return flat, begin[ends]

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character and end of each token. A token that holds only part of a
        character's bytes gets that whole character."""
        raw = np.frombuffer(text.encode(), np.uint8)
        chars = np.cumsum((raw & 0xC0) != 0x80) - 1       # character of each byte
        ends = np.cumsum(self.lengths[ids])
        return chars[ends - self.lengths[ids]], chars[ends - 1] + 1

    def decode(self, ids: np.ndarray, begin: np.ndarray) -> pa.Array:
        """Bytes of each sequence ``ids[begin[k]:begin[k + 1]]``. The tokens' bytes lie one
        after the other in the taken array, so a sequence is a stretch of its data."""
        if not len(ids):
            return pa.array([b""] * (len(begin) - 1), pa.binary())
        taken = self.tokens.take(pa.array(ids))
        if taken.null_count:
            raise ValueError("an id has no token")
        _, ends, data = taken.buffers()
        ends = np.frombuffer(ends, np.int64)[taken.offset:taken.offset + len(ids) + 1]
        large = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(begin) - 1, [None, pa.py_buffer(ends[begin].copy()), data])
        return large.cast(pa.binary())


class _Numbered(dict):
    """Numbers of pieces in order of appearance; ``fresh`` has those met since it was emptied."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.fresh.append(piece)
        n = self[piece] = len(self)
        return n


def _lists(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(values.astype(np.int32)))


@lru_cache(maxsize=4)
def _loaded(data: bytes, pattern: str) -> Bpe:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"        # Spark's tasks are the parallelism
    return Bpe(data, pattern)


def rank_bytes(path: str | None = None) -> bytes:
    """The rank file, read once on the driver and sent to the tasks."""
    with open(path or public_tokenizers.path(RANKS), "rb") as f:
        return f.read()


def encode(df: DataFrame, col: str = "text", ranks: str | None = None, pattern: str = PATTERN,
           offsets: bool = False) -> DataFrame:
    """``df`` with ``ids`` (array of int) of ``col``; with ``offsets`` also ``starts`` and
    ``ends``, the characters (code points) that each token covers.

    A null or empty text has no tokens. Texts of any length are encoded whole. Columns of
    ``df`` named like a new one are replaced, all others pass through; rows are
    independent, so repeated rows give repeated results and an empty table an empty one.
    """
    data = df.sparkSession.sparkContext.broadcast(rank_bytes(ranks))
    ints = T.ArrayType(T.IntegerType(), False)
    fields = [T.StructField("ids", ints)]
    if offsets:
        fields += [T.StructField("starts", ints), T.StructField("ends", ints)]

    def run(batch: pa.RecordBatch) -> list:
        bpe = _loaded(data.value, pattern)
        given = texts(batch, col)
        ids, begin = bpe.encode(given)
        out = [_lists(ids, begin)]
        if offsets:
            spans = [bpe.offsets(t, ids[i:j]) for t, i, j in zip(given, begin, begin[1:])]
            out += [_lists(np.concatenate([s[k] for s in spans]), begin) for k in (0, 1)]
        return out

    return append_columns(df, run, fields)


def decode(df: DataFrame, col: str = "ids", ranks: str | None = None, as_text: bool = False
           ) -> DataFrame:
    """``df`` with ``decoded`` (the bytes of the tokens) and, with ``as_text``, ``decoded_text``.

    Ids may begin or end inside a character, as a cut sequence does: ``decoded`` has the bytes
    as they are, ``decoded_text`` a replacement character for an unfinished one. Null ids
    decode to nothing; an id outside the vocabulary, or a null one, is an error.
    """
    data = df.sparkSession.sparkContext.broadcast(rank_bytes(ranks))

    def run(batch: pa.RecordBatch) -> list:
        lists = batch.column(batch.schema.get_field_index(col)).fill_null([])
        ids = lists.flatten()
        if ids.null_count:
            raise ValueError("an id is null")
        begin = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
        raw = _loaded(data.value, PATTERN).decode(ids.to_numpy(), begin.astype(np.int64))
        out = [raw]
        if as_text:
            out.append(pa.array([r.decode("utf-8", "replace") for r in raw.to_pylist()], pa.string()))
        return out

    fields = [T.StructField("decoded", T.BinaryType())]
    if as_text:
        fields.append(T.StructField("decoded_text", T.StringType()))
    return append_columns(df, run, fields)
