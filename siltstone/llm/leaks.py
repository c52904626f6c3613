"""Evaluation texts inside training texts: a positional inverted index, sharded by documents."""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from siltstone.llm.runs import decode_runs, encode_runs
from siltstone.llm.words import words
from siltstone.sources.scratch import materialize
from siltstone.sources.tables import spread

#: Consecutive words that make a leak; an item of fewer, but at least SHORTEST, must stand whole.
WINDOW = 12
SHORTEST = 8
#: Words of test items that are sent to the workers at once (some 100 bytes each); more items are searched in blocks.
BLOCK_WORDS = 1_000_000
#: Longer items are cut into overlapping pieces, so that a block's size is what it says.
PIECE_WORDS = 10_000
#: Places looked at together; bounds the memory of a step, not what is found.
STEP = 2_000_000
#: Characters of a shard's documents: one ends with the document that reaches them.
SHARD_CHARS = 4_000_000


def item_pieces(items: DataFrame, key: str, text: str, window: int = WINDOW, shortest: int = SHORTEST) -> DataFrame:
    """``item``, ``piece`` and ``words`` of the items with at least ``shortest`` words; long ones in overlapping pieces."""
    kind = items.select(key).schema[0].dataType
    schema = T.StructType([T.StructField("item", kind), T.StructField("piece", T.IntegerType()), T.StructField("words", T.ArrayType(T.StringType()))])
    step = PIECE_WORDS - window + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, piece, found = [], [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                own = words(value)
                for n, lo in enumerate(range(0, max(1, len(own) - window + 1), step)) if len(own) >= shortest else ():
                    place.append(i)
                    piece.append(n)
                    found.append(own[lo : lo + PIECE_WORDS])
            columns = [batch.column(0).take(pa.array(place, type=pa.int64())), pa.array(piece, type=pa.int32()), pa.array(found, type=pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "piece", "words"])

    return items.select(F.col(key), F.col(text)).mapInArrow(run, schema)


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Phrases:
    """The windows of a block of test items, as numbers of terms: one row a window, padded with -1."""

    def __init__(self, pieces: list[tuple[int, list[str]]], window: int):
        self.terms: dict[str, int] = {}
        rows: dict[tuple[int, ...], set[int]] = {}
        for item, own in pieces:
            numbers = [self.terms.setdefault(w, len(self.terms)) for w in own]
            for lo in range(max(1, len(numbers) - window + 1)):
                rows.setdefault(tuple(numbers[lo : lo + window]), set()).add(item)
        self.sizes = np.array([len(r) for r in rows], dtype=np.int64)
        self.rows = np.full((len(rows), window), -1, dtype=np.int32)
        for i, r in enumerate(rows):
            self.rows[i, : len(r)] = r
        owners = [sorted(x) for x in rows.values()]
        self.owner_ends = np.cumsum([0, *map(len, owners)])
        self.owners = np.array([x for o in owners for x in o], dtype=np.int64)


class Shard:
    """The index of some documents over the terms of the test items: for each term the sorted places where it stands.

    A place counts through all documents of the shard, with a gap between two, so no phrase crosses from one to the next.
    ``at`` is the way back from a place to its term: whether a place is in a term's list is one look.
    """

    def __init__(self, begins: np.ndarray, at: np.ndarray, places: np.ndarray, counts: np.ndarray):
        self.begins, self.at, self.places, self.counts = begins, at, places, counts
        self.first = np.r_[0, np.cumsum(counts)]

    @classmethod
    def of_texts(cls, texts: list[str | None], terms: dict[str, int], shortest: int) -> Shard:
        """From the documents themselves. Places that no phrase of ``shortest`` words can reach aren't kept."""
        get, at, begins = terms.get, [], []
        for text in texts:
            begins.append(len(at))
            at.extend(get(w, -1) for w in words(text))
            at.append(-1)
        whole = np.array(at, dtype=np.int32)
        known = np.flatnonzero(cls._in_runs(whole >= 0, shortest))
        own = whole[known]
        return cls(np.array(begins, dtype=np.int64), whole, known[np.argsort(own, kind="stable")], np.bincount(own, minlength=len(terms)).astype(np.int64))

    @classmethod
    def of_postings(cls, bounds: np.ndarray, ids: np.ndarray, first: np.ndarray, n: np.ndarray, runs: pa.BinaryArray, phrases: Phrases, missing: int) -> Shard:
        """From stored postings, with the numbers of their terms (-1: in no test item). Only lists of terms are decoded that
        some window has whose words are all in the shard but ``missing``; the others are left as they are.

        ``bounds`` are the documents' first places and the end of the last.
        """
        counts = np.zeros(len(phrases.terms) + 1, dtype=np.int64)
        counts[ids] = n
        counts[-1] = 0
        alive = phrases.rows[((phrases.rows >= 0) & (counts[phrases.rows] == 0)).sum(axis=1) <= missing]
        wanted = np.zeros(len(counts), dtype=bool)
        wanted[alive] = True
        wanted[-1] = False
        take = np.flatnonzero(wanted[ids])
        take = take[np.argsort(ids[take], kind="stable")]
        ids, n, own, at = ids[take], n[take], np.zeros(len(phrases.terms), dtype=np.int64), np.full(int(bounds[-1]), -1, dtype=np.int32)
        places = decode_runs(first[take], n, runs.take(pa.array(take)))
        own[ids] = n
        at[places] = np.repeat(ids, n)
        return cls(bounds[:-1], at, places, own)

    @staticmethod
    def _in_runs(known: np.ndarray, shortest: int) -> np.ndarray:
        """Of ``known``, the places in runs of at least ``shortest``: no phrase can reach the others."""
        edge = np.flatnonzero(np.diff(np.r_[False, known, False].astype(np.int8)))
        begin, end = edge[::2], edge[1::2]
        long = end - begin >= shortest
        mark = np.zeros(len(known) + 1, dtype=np.int8)
        mark[begin[long]] += 1
        mark[end[long]] -= 1
        return np.cumsum(mark[:-1]).astype(bool)

    def find(self, phrases: Phrases, missing: int = 0, slop: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Documents (their places in the shard) and windows that match, with at most ``missing`` words elsewhere and the
        others shifted by at most ``slop`` places against each other.

        Lists are taken from the rarest term on, each shifted by the term's offset in the window; a start that isn't in
        the next shifted list is dropped. With words missing, one of the ``missing + 1`` rarest must stand, so the starts
        are the union of their lists, and a start is dropped when it has missed more. With a slop, the next shifted list
        needs a place within the slop of the start, and what is left is aligned word by word.
        """
        counts = np.where(phrases.rows >= 0, self.counts[phrases.rows], np.iinfo(np.int64).max)
        alive = np.flatnonzero((counts == 0).sum(axis=1) <= missing)
        order = np.argsort(counts[alive], axis=1, kind="stable")
        leads = np.take_along_axis(counts[alive], order[:, : missing + 1], axis=1)
        work = np.cumsum(leads.sum(axis=1)) if len(alive) else np.empty(0, dtype=np.int64)
        ends = np.searchsorted(work, np.arange(STEP, int(work[-1]) + STEP, STEP), side="right") if len(alive) else []
        lo = 0
        for hi in sorted({*(max(1, int(e)) for e in ends), len(alive)}):
            if hi > lo:
                yield self._intersect(phrases, alive[lo:hi], order[lo:hi], leads[lo:hi], missing, slop)
                lo = hi

    def _intersect(self, phrases, windows, order, leads, missing, slop) -> tuple[np.ndarray, np.ndarray]:
        starts, which, seeds = [], [], []
        for k in range(missing + 1):
            size = leads[:, k]
            term = phrases.rows[windows, order[:, k]]
            row = np.repeat(np.arange(len(windows)), size)
            within = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            starts.append(self.places[self.first[term][row] + within] - order[row, k])
            which.append(row)
            seeds.append(order[row, k])
        start, row = np.concatenate(starts), np.concatenate(which)
        if slop:
            return self._aligned(phrases, windows, order, start, row, np.concatenate(seeds), missing, slop)
        keep = (start >= 0) & (start + phrases.sizes[windows[row]] <= len(self.at))
        start, row = start[keep], row[keep]
        missed = np.zeros(len(start), dtype=np.int8)
        for k in range(phrases.rows.shape[1]):
            offset = order[row, k]
            term = phrases.rows[windows[row], offset]
            missed += (term >= 0) & (self.at[np.minimum(start + offset, len(self.at) - 1)] != term)
            keep = missed <= missing
            start, row, missed = start[keep], row[keep], missed[keep]
        document = np.searchsorted(self.begins, start, side="right") - 1
        if missing:
            last = np.searchsorted(self.begins, start + phrases.sizes[windows[row]] - 1, side="right") - 1
            document, row = document[document == last], row[document == last]
        return document, windows[row]

    def _aligned(self, phrases, windows, order, start, row, seed, missing, slop) -> tuple[np.ndarray, np.ndarray]:
        """The starts where all but ``missing`` words stand in order, their shifts within ``slop`` of each other.

        A start comes from a word that stands (``seed`` is its offset), so its shift is 0 and the others lie between
        ``-slop`` and ``slop``. First words without a place there are counted, which leaves few starts; for these the
        longest common subsequence is taken in each band of ``slop + 1`` shifts around 0, inside the seed's document.
        """
        missed, last = np.zeros(len(start), dtype=np.int8), len(self.at) - 1
        for k in range(phrases.rows.shape[1]):
            offset = order[row, k]
            term = phrases.rows[windows[row], offset]
            lost = np.flatnonzero(term >= 0)
            for shift in sorted(range(-slop, slop + 1), key=abs):
                lost = lost[self.at[np.clip(start[lost] + offset[lost] + shift, 0, last)] != term[lost]]
            missed[lost] += 1
            keep = missed <= missing
            start, row, seed, missed = start[keep], row[keep], seed[keep], missed[keep]
        document = np.searchsorted(self.begins, start + seed, side="right") - 1
        begin, end = self.begins[document], np.r_[self.begins[1:], len(self.at)][document]
        terms, most = phrases.rows[windows[row]], np.zeros(len(start), dtype=np.int64)
        for low in range(-slop, 1):
            # Of the words up to one, the most that stand up to its place shifted by each shift of the band.
            best = np.zeros((slop + 1, len(start)), dtype=np.int64)
            for offset in range(terms.shape[1]):
                before = best
                best = before.copy()
                best[:-1] = before[1:]
                for i in range(slop + 1):
                    place = start + offset + low + i
                    stands = (terms[:, offset] >= 0) & (place >= begin) & (place < end) & (self.at[np.clip(place, 0, last)] == terms[:, offset])
                    best[i] = np.maximum(best[i], before[i] + stands)
                    if i:
                        best[i] = np.maximum(best[i], best[i - 1])
            most = np.maximum(most, best[-1])
        keep = most >= phrases.sizes[windows[row]] - missing
        return document[keep], windows[row[keep]]


def portions(batch: pa.RecordBatch, chars: int) -> Iterator[tuple[int, list[str | None]]]:
    """The texts of a batch (its second column) in stretches of about so many characters, each with its first row."""
    lo, size, texts = 0, 0, batch.column(1).to_pylist()
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= chars or i + 1 == len(texts):
            yield lo, texts[lo : i + 1]
            lo, size = i + 1, 0


def _blob(values: np.ndarray) -> bytes:
    return values.astype("<i4").tobytes()


def _unblob(value: bytes) -> np.ndarray:
    return np.frombuffer(value, dtype="<i4").astype(np.int64)


def build_index(docs: DataFrame, key: str, text: str, *, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """The positional inverted index of all words of all documents, to be stored and searched any number of times.

    A row is a shard, some documents of about ``shard_chars`` characters: their ``keys``; ``bounds``, the places where each
    begins and where the last ends; its ``terms``, sorted, with blanks between; and for each of these ``n`` places, the
    ``first``, the ``size`` of the code of the others, and in ``runs`` the codes, delta-coded, one after the other. Numbers
    are 32-bit in binary columns, so that neither writer nor reader handles postings one by one. Nothing is shuffled.
    """
    kind = docs.select(key).schema[0].dataType
    blobs = [T.StructField(f, T.StringType() if f == "terms" else T.BinaryType()) for f in ("bounds", "terms", "n", "first", "size", "runs")]
    schema = T.StructType([T.StructField("shard", T.StringType()), T.StructField("keys", T.ArrayType(kind)), *blobs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, texts in portions(batch, shard_chars):
                numbers, flat, bounds = _Numbers(), array("i"), [0]
                for value in texts:
                    flat.extend(map(numbers.__getitem__, words(value)))
                    flat.append(-1)
                    bounds.append(len(flat))
                terms = sorted(numbers)
                rank = np.empty(len(terms) + 1, dtype=np.int32)
                rank[np.fromiter(map(numbers.__getitem__, terms), dtype=np.int64, count=len(terms))] = np.arange(len(terms))
                rank[-1] = -1
                of = rank[np.frombuffer(flat, dtype=np.int32)]
                places = np.argsort(of, kind="stable")[len(texts) :]
                begin = np.flatnonzero(np.diff(of[places], prepend=-1))
                runs = encode_runs(places.astype(np.int64), begin)
                ends = np.frombuffer(runs.buffers()[1], dtype=np.int32) if len(runs) else np.zeros(1, dtype=np.int32)
                data = runs.buffers()[2].to_pybytes() if len(runs) else b""
                row = [_blob(np.array(bounds)), " ".join(terms), _blob(np.diff(np.r_[begin, len(places)])), _blob(places[begin]), _blob(np.diff(ends)), data]
                keys = pa.ListArray.from_arrays(pa.array([0, len(texts)], type=pa.int32()), batch.column(0).slice(lo, len(texts)))
                columns = [pa.array([f"{task}:{number}"]), keys, *(pa.array([v], type=pa.string() if isinstance(v, str) else pa.binary()) for v in row)]
                number += 1
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return spread(docs.select(F.col(key), F.col(text))).mapInArrow(run, schema)


def _pairs(shard: Shard, phrases: Phrases, missing: int, slop: int) -> np.ndarray:
    """The different pairs of a document's place in the shard and an item's number."""
    found = [np.empty((0, 2), dtype=np.int64)]
    for document, row in shard.find(phrases, missing, slop):
        size = phrases.owner_ends[row + 1] - phrases.owner_ends[row]
        own = np.repeat(phrases.owner_ends[row] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        found.append(np.unique(np.c_[np.repeat(document, size), phrases.owners[own]], axis=0))
    return np.unique(np.concatenate(found), axis=0)


def _pieces(items: DataFrame, key: str, text: str, window: int, shortest: int, block_words: int) -> tuple[DataFrame, int]:
    """The pieces of the items and the number of blocks to search them in."""
    pieces = item_pieces(items, key, text, window, shortest)
    return pieces, max(1, math.ceil((pieces.agg(F.sum(F.size("words"))).first()[0] or 0) / block_words))


def _block(pieces: DataFrame, window: int) -> Broadcast:
    """A block's phrases and the keys of its items, sent to the workers."""
    rows = pieces.collect()
    number = {k: i for i, k in enumerate(dict.fromkeys(r["item"] for r in rows))}
    phrases = Phrases([(number[r["item"]], r["words"]) for r in rows], window)
    return pieces.sparkSession.sparkContext.broadcast((phrases, pa.array(list(number), type=to_arrow_type(pieces.schema["item"].dataType))))


def search_index(
    index: DataFrame,
    items: DataFrame,
    *,
    doc_key: str,
    item_key: str,
    item_text: str,
    window: int = WINDOW,
    shortest: int = SHORTEST,
    missing: int = 0,
    slop: int = 0,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The same pairs as ``leaks``, from a stored index instead of the texts.

    A shard is searched by the task that reads it: of its terms those of the test items are looked up, the windows are found
    whose words are all there, and their lists are intersected from the rarest term on. Nothing is shuffled. An item may
    have pieces in several blocks; blocks are searched one after the other, each result stored before the next block is sent,
    and what is found twice is made one by the document's shard and place in it, whatever its key. So the index must be
    stored where there are several blocks: each of them has to read the same shards.
    """
    kinds = index.schema["keys"].dataType.elementType, items.select(item_key).schema[0].dataType
    schema = T.StructType([T.StructField("shard", T.StringType()), T.StructField("place", T.LongType()), T.StructField("doc", kinds[0]), T.StructField("item", kinds[1])])

    def search(shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases, names = shared.value
            for batch in batches:
                for i in range(batch.num_rows):
                    get = lambda c: batch.column(c)[i].as_py()  # noqa: B023, E731
                    keys, terms, size, data = batch.column("keys").slice(i, 1).flatten(), get("terms"), _unblob(get("size")), get("runs")
                    runs = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.py_buffer(data)])
                    ids = np.array([phrases.terms.get(t, -1) for t in terms.split(" ")] if terms else [], dtype=np.int64)
                    shard = Shard.of_postings(_unblob(get("bounds")), ids, _unblob(get("first")), _unblob(get("n")), runs, phrases, missing)
                    if len(pairs := _pairs(shard, phrases, missing, slop)):
                        place, number = pa.array(pairs[:, 0]), pa.array([get("shard")] * len(pairs))
                        yield pa.RecordBatch.from_arrays([number, place, keys.take(place), names.take(pa.array(pairs[:, 1]))], names=schema.names)

        return index.mapInArrow(run, schema)

    pieces, blocks = _pieces(items, item_key, item_text, window, shortest, block_words)
    if blocks == 1:
        found = search(_block(pieces, window))
    else:
        parts = []
        for block in range(blocks):
            shared = _block(pieces.filter(F.pmod(F.xxhash64("item", "piece"), F.lit(blocks)) == block), window)
            parts.append(materialize(search(shared), "leaks"))
            shared.destroy()
        found = reduce(DataFrame.unionByName, parts).dropDuplicates(["shard", "place", "item"])
    return found.select(F.col("doc").alias(doc_key), F.col("item").alias(item_key))


def leaks(
    docs: DataFrame,
    items: DataFrame,
    *,
    doc_key: str,
    doc_text: str,
    item_key: str,
    item_text: str,
    window: int = WINDOW,
    shortest: int = SHORTEST,
    missing: int = 0,
    slop: int = 0,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``doc_key`` and ``item_key`` of each document that holds ``window`` consecutive words of an item.

    Words are those of ``words``. An item of ``shortest`` to ``window - 1`` words must stand whole; a shorter one never
    counts. ``missing`` above 0 finds near matches too: so many words of the passage may be others, in their places.
    ``slop`` above 0 adds proximity: the words that stand need not stand in their places, only in their order, with their
    shifts (place in the document less offset in the passage) at most ``slop`` apart. So other words may lie in between,
    and words that are ``missing`` may be dropped without a word in their place, also where the document begins or ends.

    The documents are never moved: each ``SHARD_CHARS`` of them become one shard of a positional inverted index, held by the
    task that read them, and the test items go to the shards. What is broadcast has a bound however many items there are: when
    they have more than ``block_words`` words, the index is stored once and searched in blocks by ``search_index``.

    Defined cases: null, empty and blank texts have no words and match nothing; rows with equal keys give rows of their own,
    items with equal keys count as one; a null key is kept as it is; empty tables give no rows; other columns play no part,
    whatever their names.
    """
    if not 0 <= missing < shortest <= window or slop < 0 or doc_key == item_key:
        raise ValueError("missing < shortest <= window, no negative slop and different key names are required")
    schema = T.StructType([T.StructField(doc_key, docs.select(doc_key).schema[0].dataType), T.StructField(item_key, items.select(item_key).schema[0].dataType)])

    pieces, blocks = _pieces(items, item_key, item_text, window, shortest, block_words)
    if blocks > 1:
        index = materialize(build_index(docs, doc_key, doc_text), "postings")
        how = {"window": window, "shortest": shortest, "missing": missing, "slop": slop, "block_words": block_words}
        return search_index(index, items, doc_key=doc_key, item_key=item_key, item_text=item_text, **how)
    shared = _block(pieces, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, names = shared.value
        for batch in batches:
            for lo, texts in portions(batch, SHARD_CHARS):
                shard = Shard.of_texts(texts, phrases.terms, 1 if missing or slop else shortest)
                if len(pairs := _pairs(shard, phrases, missing, slop)):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pairs[:, 0] + lo)), names.take(pa.array(pairs[:, 1]))], names=schema.names)

    return spread(docs.select(F.col(doc_key), F.col(doc_text))).mapInArrow(run, schema)
