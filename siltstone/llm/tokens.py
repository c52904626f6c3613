"""Byte-level BPE: exact merges in linear time by backtracking over longest matches, and decoding by offsets."""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.sources.tables import spread

#: Pieces and token pairs that a worker remembers before it starts anew; each entry is some hundred bytes.
REMEMBERED = 200_000
#: Longer pieces are encoded each time, so the memory's size is bounded by its number of entries.
LONGEST_REMEMBERED = 64
#: Ids decoded at a time, and bytes of an array of results.
DECODED, MOST_BYTES = 1 << 20, 1 << 30
#: The file of ranks must be smaller, since every worker gets it.
MAX_FILE_BYTES = 64 << 20
#: Fixed value: how the public byte-level vocabularies split a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def read_ranks(path: str) -> list[bytes]:
    """The tokens in order of their ids from a file of base64 text and rank on each line; ids must be 0, 1, 2, …"""
    with open(path, "rb") as f:
        data = f.read(MAX_FILE_BYTES + 1)
    if len(data) > MAX_FILE_BYTES:
        raise ValueError(f"{path} has more than {MAX_FILE_BYTES} bytes")
    pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, data.splitlines()) if token)
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must be 0, 1, 2, … without gaps")
    return [t for _, t in pairs]


class Tables:
    """What encoding needs, made from the tokens alone.

    ``parts`` has the two tokens whose merge makes a token (a single byte has itself twice); ``merges`` is the way back.
    ``offsets`` and ``blob`` hold all tokens' bytes end to end, for decoding.
    """

    def __init__(self, tokens: list[bytes], parts: list[tuple[int, int]] | None = None):
        self.tokens = tokens
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.parts = [self._last_merge(i, t) for i, t in enumerate(tokens)] if parts is None else parts
        self.merges = {p: i for i, p in enumerate(self.parts) if p[0] != i}
        self.prefix: list[int] = [self._shorter(t) for t in tokens]
        self.matcher = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, t in enumerate(tokens):
            self.matcher.add_word(t.decode("latin-1"), i)
        self.matcher.make_automaton()
        self.lengths = [len(t) for t in tokens]
        self.offsets = np.r_[0, np.cumsum(self.lengths)]
        self.blob = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.pairs: dict[tuple[int, int], bool] = {}

    def _last_merge(self, rank: int, token: bytes) -> tuple[int, int]:
        """Merges the bytes of ``token`` by all smaller ranks; the two pieces that are left make it."""
        pieces = [token[i : i + 1] for i in range(len(token))]
        while len(pieces) > 2:
            best = min(range(len(pieces) - 1), key=lambda i: self._rank(pieces[i] + pieces[i + 1], rank))
            if self._rank(pieces[best] + pieces[best + 1], rank) >= rank:
                raise ValueError(f"token {rank} isn't a merge of earlier tokens")
            pieces[best : best + 2] = [pieces[best] + pieces[best + 1]]
        return (self.ids[pieces[0]], self.ids[pieces[1]]) if len(pieces) == 2 else (rank, rank)

    def _rank(self, piece: bytes, below: int) -> int:
        return self.ids.get(piece, below)

    def _shorter(self, token: bytes) -> int:
        """The longest token that is a proper prefix; -1 for one byte."""
        return next((self.ids[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ids), -1)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two stay apart when their bytes are merged together.

        Going back through the merges on both sides of the border, latest first, any pair that meets there must have a
        merge no earlier than the merge that is taken back.
        """
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            known = self.pairs[left, right] = self._stay_apart(left, right)
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        undone = len(self.tokens)
        while True:
            if self.merges.get((left, right), undone) < undone:
                return False
            (a, b), (c, d) = self.parts[left], self.parts[right]
            if left == a and right == c:
                return True
            # Only the later of the two merges is taken back; of one and the same token, the left one came first.
            if right == c or (left != a and left > right):
                undone, left = left, b
            else:
                undone, right = right + 1, c

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one piece: the only sequence of tokens in which all neighbours are compatible.

        Goes from left to right by the longest token at each place; where none fits, the last token is taken back and a
        shorter one tried. A place once given up is never entered again, so the steps are linear in the bytes.
        """
        whole = self.ids.get(piece)
        if whole is not None:
            return (whole,)
        n = len(piece)
        longest = [-1] * n
        lengths = self.lengths
        for end, token in self.matcher.iter(piece.decode("latin-1")):
            start = end + 1 - lengths[token]
            if longest[start] < 0 or lengths[longest[start]] < lengths[token]:
                longest[start] = token
        open_at = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + lengths[token]
            if open_at[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                if end == n:
                    return tuple(out)
                at, token = end, longest[end]
            elif self.prefix[token] >= 0:
                token = self.prefix[token]
            else:
                open_at[at] = 0
                token = out.pop()
                at -= lengths[token]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, by each token's place in the blob."""
        ids, out = np.asarray(ids, dtype=np.int64), [self.blob[:0]]
        for lo in range(0, len(ids), DECODED):
            own = ids[lo : lo + DECODED]
            begin, size = self.offsets[own], self.offsets[own + 1] - self.offsets[own]
            shift = np.repeat(begin - np.r_[0, np.cumsum(size)[:-1]], size)
            out.append(self.blob[np.arange(int(size.sum())) + shift])
        return np.concatenate(out)

    def decode_lists(self, ids: np.ndarray, ends: np.ndarray) -> Iterator[pa.BinaryArray]:
        """The bytes of lists of ids that lie end to end (list k up to ``ends[k + 1]``), in arrays of a gigabyte at most
        or of one list."""
        at = np.r_[0, np.cumsum(self.offsets[ids + 1] - self.offsets[ids])][ends]
        lo = 0
        while lo + 1 < len(ends):
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + MOST_BYTES, side="right")) - 1)
            data = self.decode(ids[ends[lo] : ends[hi]])
            yield pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((at[lo : hi + 1] - at[lo]).astype(np.int32)), pa.py_buffer(data)])
            lo = hi


class Encoder(dict):
    """Ids of a text; remembers those of short pieces."""

    def __init__(self, tables: Tables):
        super().__init__()
        self.tables = tables
        self.split = regex.compile(PATTERN, regex.V0).findall

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.tables.encode_piece(piece.encode())
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> Iterator[int]:
        """The ids of ``text``, in order."""
        return chain.from_iterable(map(self.__getitem__, self.split(text)))


_MADE: dict[int, Encoder] = {}


def _encoder(vocabulary: Broadcast) -> Encoder:
    """The worker's encoder; made once and kept while the worker is used again."""
    tokens, parts = vocabulary.value
    key = hash(tuple(tokens))
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Encoder(Tables(tokens, parts))
    return _MADE[key]


@lru_cache(maxsize=4)
def _read(path: str, _: tuple[int, int]) -> tuple[list[bytes], list[tuple[int, int]]]:
    tokens = read_ranks(path)
    return tokens, Tables(tokens).parts


def _share(df: DataFrame, vocabulary: str) -> Broadcast:
    """The tokens and the merges that make them, worked out by the driver once for a file, for all workers."""
    stat = os.stat(vocabulary)
    return df.sparkSession.sparkContext.broadcast(_read(vocabulary, (stat.st_mtime_ns, stat.st_size)))


def encode(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key`` and ``ids`` (ARRAY<INT>) of each row: the tokens of ``text``, without special tokens or any cleaning.

    No shuffle where a scan has a task for each core: the rows are encoded where they are read. ``vocabulary`` is read by the driver and sent to the workers; its
    size is checked. Strings that look like special tokens are ordinary text.

    Defined cases: a null or empty text gives an empty list; equal rows give equal rows; texts of any length take time in
    proportion to their length; an empty input gives no rows; other columns play no part, whatever their names.
    """
    shared = _share(df, vocabulary)
    schema = T.StructType([T.StructField(key, df.select(key).schema[0].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            ids, ends = array("i"), array("i", [0])
            for value in batch.column(1).to_pylist():
                if value:
                    ids.extend(encoder.encode(value))
                ends.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, dtype=np.int32)), pa.array(np.frombuffer(ids, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    return spread(df.select(F.col(key), F.col(text))).mapInArrow(run, schema)


def decode(df: DataFrame, key: str, ids: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key`` and ``bytes`` (BINARY) of each row: what the ids stand for; null and empty lists give no bytes."""
    shared = _share(df, vocabulary)
    schema = T.StructType([T.StructField(key, df.select(key).schema[0].dataType), T.StructField("bytes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _encoder(shared).tables
        for batch in batches:
            lists, lo = batch.column(1), 0
            ends = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(), dtype=np.int64)]
            for made in tables.decode_lists(lists.flatten().to_numpy(), ends):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(made)), made], names=[key, "bytes"])
                lo += len(made)

    return df.select(F.col(key), F.col(ids)).mapInArrow(run, schema)
