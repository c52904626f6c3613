"""Repetition inside a document: shares of repeated content, and a cascade that finds the documents where it is large."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.words import words
from siltstone.sources.tables import scan_splits, spread

GRAM = 5
MIN_WORDS = 20
#: Share of repeated runs, in hundredths, from which a document is reported.
MIN_PERCENT = 30
#: Documents on which the rules' costs and rejections are estimated, from so many files spaced evenly over the table. The
#: rules' order follows, never a result.
SAMPLE_ROWS, SAMPLE_FILES = 512, 4
#: From so many words on, runs are numbered by sorting instead of being held as tuples.
MANY_WORDS = 50_000
#: Fixed value: no character becomes more than 18 by compatibility folding.
MOST_FOLDED = 18


class Document:
    """A text with what the rules have worked out so far."""

    __slots__ = ("_words", "text")

    def __init__(self, text: str | None):
        self.text, self._words = text, None

    @property
    def words(self) -> list[str]:
        if self._words is None:
            self._words = words(self.text)
        return self._words

    def repeated(self, length: int, runs: int) -> int:
        """Of the first ``runs`` runs of ``length`` words, those that stand at an earlier position too."""
        own = self.words
        if runs <= 0:
            return 0
        if len(own) < MANY_WORDS:
            return runs - len(set(zip(*(own[i : i + runs] for i in range(length)), strict=True)))
        numbers = {w: i for i, w in enumerate(dict.fromkeys(own))}
        first = np.fromiter((numbers[w] for w in own), dtype=np.int64, count=len(own))
        known = first
        for i in range(1, length):
            known = np.unique(known[:-1] * len(numbers) + first[i:], return_inverse=True)[1].astype(np.int64)
        return runs - len(np.unique(known[:runs]))


@dataclass(frozen=True)
class Rule:
    """``rejects(document)`` proves that the document isn't one to report; ``needs_words`` if it asks for the words."""

    name: str
    rejects: Callable[[Document], bool]
    needs_words: bool = True


def rules(gram: int = GRAM, min_words: int = MIN_WORDS, min_percent: int = MIN_PERCENT) -> list[Rule]:
    """Rules that all must let a document pass; the last two words of each name what is compared.

    A run can only stand at an earlier position if its first words do: so the repeats of shorter runs at the same
    positions are at least as many, and too few of them are proof. The rule over whole runs is exact.
    """

    def too_few(document: Document, length: int) -> bool:
        runs = len(document.words) - gram + 1
        return runs <= 0 or 100 * document.repeated(length, runs) < min_percent * runs

    return [
        Rule("too little text", lambda d: not d.text or len(d.text) * MOST_FOLDED < min_words, needs_words=False),
        Rule("too few words", lambda d: len(d.words) < min_words),
        Rule("too few repeated words", lambda d: too_few(d, 1)),
        Rule("too few repeated pairs", lambda d: too_few(d, 2)),
        Rule("too few repeated runs", lambda d: too_few(d, gram)),
    ]


def best_order(rejected: np.ndarray, cost: np.ndarray, words_cost: np.ndarray, needs_words: list[bool]) -> list[int]:
    """The rules in the order that rejects most per second, from what they did on a sample (one row a document).

    Greedy: each next rule is the one with the most rejections per second among the documents that the rules before it let
    pass. Finding the words is part of the cost of the first rule that needs them. Rules that reject none of the rest come
    last, cheapest first.
    """
    order, rest, alive, known = [], list(range(rejected.shape[1])), np.ones(len(rejected), dtype=bool), False

    def score(i: int) -> tuple[float, float]:
        seconds = cost[alive, i].sum() + (words_cost[alive].sum() if needs_words[i] and not known else 0) + 1e-9
        return rejected[alive, i].sum() / seconds, -seconds

    while rest:
        best = max(rest, key=score)
        rest.remove(best)
        order.append(best)
        known |= needs_words[best]
        alive &= ~rejected[:, best]
    return order


def _tried(made: list[Rule], text: str | None) -> tuple[list[bool], list[float], float]:
    """Whether each rule rejects the document, the seconds each takes once the words are known, and those of the words."""
    document, clock = Document(text), time.perf_counter
    began = clock()
    _ = document.words
    words_cost, verdicts, costs = clock() - began, [], []
    for r in made:
        began = clock()
        verdicts.append(r.rejects(document))
        costs.append(clock() - began)
    return verdicts, costs, words_cost


def measured_order(df: DataFrame, text: str, made: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[int]:
    """The best order of the rules on one sample of at most ``sample_rows`` documents, tried and timed by the workers.

    The sample are the first documents of files spaced evenly over the table, so a table in some order is seen in all its
    parts; of what isn't read from files, the first rows. A task stops with the Arrow batch that ends its share.
    """
    if not sample_rows:
        return list(range(len(made)))
    files = sorted(df.inputFiles())
    picked = [files[i * len(files) // SAMPLE_FILES] for i in range(SAMPLE_FILES)] if len(files) > SAMPLE_FILES else files
    try:
        # Listing and rows spell local paths with one slash and with three; a file counts only if both find it.
        spellings = {p.replace("file:///", "file:/") for p in picked} | set(picked)
        texts = df.filter(F.col("_metadata.file_path").isin(*spellings)).select(F.col(text)) if files else df
        splits = scan_splits(texts)
    except AnalysisException:
        splits = None
    texts, share = (texts, -(-sample_rows // max(1, min(splits, SAMPLE_FILES)))) if splits is not None else (df.select(F.col(text)).limit(sample_rows), sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = share
        for batch in batches:
            seen = [_tried(made, t) for t in batch.column(0).slice(0, left).to_pylist()]
            left -= len(seen)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*seen, strict=True)], names=["rejected", "cost", "words_cost"])
            if not left:
                return

    rows = texts.mapInArrow(run, "rejected array<boolean>, cost array<double>, words_cost double").limit(sample_rows).collect()
    rejected, cost, shared = (np.array([r[c] for r in rows]) for c in ("rejected", "cost", "words_cost"))
    return best_order(rejected, cost, shared, [r.needs_words for r in made]) if rows else list(range(len(made)))


def find_repetitive(
    df: DataFrame, key: str, text: str, *, gram: int = GRAM, min_words: int = MIN_WORDS, min_percent: int = MIN_PERCENT, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """``key`` of each document of at least ``min_words`` words of whose runs of ``gram`` words, counted at every position,
    at least ``min_percent`` hundredths also stand at an earlier position.

    A cascade of ``rules``: their costs and rejections are measured on one sample (``measured_order``), and each document goes
    through them in the best order and is done with at the first that rejects it. The order changes the time, not the
    result. No shuffle; documents stay where they are read.

    Defined cases: null, empty and blank texts have no words and are never reported; rows with equal keys are reported each;
    a null key is kept; texts of any length are taken whole; an empty input gives no rows; other columns play no part,
    whatever their names.
    """
    schema = T.StructType([T.StructField(key, df.select(key).schema[0].dataType)])
    made = rules(gram, min_words, min_percent)
    tests = [made[i].rejects for i in measured_order(df, text, made, sample_rows)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passed = [i for i, d in enumerate(map(Document, batch.column(1).to_pylist())) if not any(t(d) for t in tests)]
            if passed:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(passed, type=pa.int64()))], names=[key])

    return spread(df.select(F.col(key), F.col(text))).mapInArrow(run, schema)


def _repeated_share(parts: list[str]) -> float:
    """Of the characters of the parts, the share in parts that stand earlier too."""
    seen: set[str] = set()
    total = again = 0
    for p in parts:
        total += len(p)
        if p in seen:
            again += len(p)
        seen.add(p)
    return again / total if total else 0.0


def _split(text: str, marks: str) -> list[str]:
    for m in marks[1:]:
        text = text.replace(m, marks[0])
    return [p for p in (x.strip() for x in text.split(marks[0])) if p]


def repetition_shares(df: DataFrame, key: str, text: str, *, gram: int = GRAM) -> DataFrame:
    """One row per document with its measures of repeated content.

    ``n_words``; ``gram_share``, the share of its runs of ``gram`` words that stand at an earlier position too;
    ``line_share``, ``sentence_share`` and ``paragraph_share``, the shares of characters in lines, sentences (ended by
    ``. ! ?`` or their full-width forms) and paragraphs (between blank lines) that stand earlier too, blanks around them not
    counted. A null, empty or blank text has 0 in all of them.
    """
    doubles = [T.StructField(f, T.DoubleType()) for f in ("gram_share", "line_share", "sentence_share", "paragraph_share")]
    schema = T.StructType([T.StructField(key, df.select(key).schema[0].dataType), T.StructField("n_words", T.LongType()), *doubles])

    def measures(value: str | None) -> tuple[int, float, float, float, float]:
        document, value = Document(value), (value or "").replace("\r\n", "\n").replace("\r", "\n")
        n = len(document.words)
        runs = max(0, n - gram + 1)
        paragraphs = [p for p in ("\n".join(x.strip() for x in value.split("\n"))).split("\n\n") if p.strip()]
        shares = (_repeated_share(p) for p in (_split(value, "\n"), _split(value, ".!?。！？"), [p.strip() for p in paragraphs]))
        return (n, document.repeated(gram, runs) / runs if runs else 0.0, *shares)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*map(measures, batch.column(1).to_pylist()), strict=True))
            if columns:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], type=pa.int64()), *(pa.array(c, type=pa.float64()) for c in columns[1:])], names=schema.names)

    return spread(df.select(F.col(key), F.col(text))).mapInArrow(run, schema)
