"""Distinct counts from delta-coded sorted runs of 64-bit hashes, which can be united in any combination."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.instants import utc_day
from siltstone.llm.runs import decode_runs, encode_runs
from siltstone.sources.scratch import materialize

#: Hashes that a slice should hold at most; the slices of a group are united apart from each other.
SLICE_HASHES = 1 << 20
#: Slices are numbered by at most so many bits, enough for 2 ** 50 hashes.
MAX_SLICE_BITS = 30
#: Hashes in a stored run; a longer run goes on in the next row.
RUN_HASHES = 1 << 18
#: Stands for a missing day, in days since 1970; no date reaches so far back.
NO_DAY = -(1 << 31)
_RUN_FIELDS = "day date, event_type string, bits int, slice int, first bigint, n bigint, run binary"
_RUN_NAMES = ["day", "event_type", "bits", "slice", "first", "n", "run"]


def unite(runs: list[np.ndarray]) -> np.ndarray:
    """The k-way union of sorted runs: neighbours are merged two by two until one is left; equal hashes become one."""
    runs = [r for r in runs if len(r)] or [np.empty(0, dtype=np.int64)]
    while len(runs) > 1:
        runs = [_merge(*runs[i : i + 2]) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
    return runs[0]


def _merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return both[np.r_[True, both[1:] != both[:-1]]]


def slice_bits(hashes: int, per_slice: int = SLICE_HASHES) -> int:
    """Leading bits of a hash that number its slice, so that a slice of so many different hashes has ``per_slice``."""
    return min(MAX_SLICE_BITS, max(0, math.ceil(math.log2(max(1, hashes / per_slice)))))


def _at_most_hashes(hashed: DataFrame) -> int:
    """A guess from the planner's size of the hashed rows, without a job; a count where it knows none. It steers how runs
    are cut, which every run says of itself, and never a result."""
    size = int(hashed._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size // 8 if size < 1 << 60 else hashed.count()


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of rows sorted by ``keys``, and where their groups begin; no group is split between two tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        begin = _begins(table, keys)
        if begin[-1] > 0:
            yield table.slice(0, begin[-1]), begin[:-1]
            held = table.slice(begin[-1]).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, _begins(table, keys)


def _begins(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, dtype=bool)
    new[0] = True
    for k in keys:
        c = table.column(k).combine_chunks()
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        new[1:] |= differ | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))
    return np.flatnonzero(new)


def _whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str], size: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows in tables, and where their runs begin: a run is all of a group, or ``size`` rows of a longer one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        while sum(b.num_rows for b in held) >= size:
            table = pa.Table.from_batches(held).combine_chunks()
            begin = _begins(table, keys)
            end = begin[-1] or size
            yield table.slice(0, end), begin[begin < end]
            held = table.slice(end).to_batches()
    if sum(b.num_rows for b in held):
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, _begins(table, keys)


def hash_runs(df: DataFrame, day: Column, event_type: str, identifier: str, *, per_slice: int = SLICE_HASHES, run_hashes: int = RUN_HASHES) -> DataFrame:
    """The mergeable partial results: for each day and type the hashes of its different identifiers, as sorted runs.

    Columns ``day``, ``event_type``, ``bits`` and ``slice`` (so many leading bits of the hashes, and their value), ``first``
    (the run's first hash), ``n`` and ``run`` (the further hashes, delta-coded; at most ``run_hashes`` in all). Slices have
    ranges of hashes of their own, so they are united and counted apart and their counts add up; no task ever holds more
    than one slice of one group, and a group of any size spreads. The runs of different days, types and inputs can be united
    at any later time, whatever the slices of each.
    """
    hashed = df.select(day.alias("day"), F.col(event_type).alias("event_type"), F.xxhash64(F.col(identifier)).alias("h"), F.col(identifier).isNull().alias("none"))
    bits = slice_bits(_at_most_hashes(hashed), per_slice)
    part = F.shiftrightunsigned("h", 64 - bits).cast("int") if bits else F.lit(0)
    different = hashed.filter(~F.col("none")).groupBy("day", "event_type", "h").agg(F.lit(1).alias("x")).select("day", "event_type", part.alias("slice"), "h")
    keys = ["day", "event_type", "slice"]
    ordered = different.repartition(*keys).sortWithinPartitions(*keys, "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begin in _whole_runs(batches, keys, run_hashes):
            h = table.column("h").combine_chunks().to_numpy()
            n, own = np.diff(np.r_[begin, len(h)]), [table.column(k).combine_chunks().take(pa.array(begin)) for k in keys]
            sliced = pa.array(np.full(len(begin), bits, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*own[:2], sliced, own[2], pa.array(h[begin]), pa.array(n), encode_runs(h, begin)], names=_RUN_NAMES)

    return ordered.mapInArrow(run, _RUN_FIELDS)


def resliced(runs: DataFrame, bits: int | None = None, per_slice: int = SLICE_HASHES) -> DataFrame:
    """The same runs, all sliced by ``bits``, which default to what all their hashes together need.

    Finer slices become part of a coarser one by their number alone. A run of coarser slices is decoded and cut where the
    finer ones begin; it has at most the run length's hashes, and only such runs are touched.
    """
    if bits is None:
        bits = slice_bits(runs.agg(F.sum("n")).first()[0] or 0, per_slice)
    own = F.col("bits")
    fine = runs.filter(own >= bits).withColumns({"slice": F.expr(f"shiftright(slice, bits - {bits})"), "bits": F.lit(bits)})
    coarse = runs.filter(own < bits)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            first, n = (batch.column(c).to_numpy().astype(np.int64) for c in ("first", "n"))
            h, of = decode_runs(first, n, batch.column("run")), np.repeat(np.arange(len(n)), n)
            number = (h.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            begin = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (number[1:] != number[:-1])])
            made = {
                "bits": pa.array(np.full(len(begin), bits, dtype=np.int32)),
                "slice": pa.array(number[begin].astype(np.int32)),
                "first": pa.array(h[begin]),
                "n": pa.array(np.diff(np.r_[begin, len(h)])),
                "run": encode_runs(h, begin),
            }
            place = pa.array(of[begin])
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c).take(place) for c in batch.schema.names], names=batch.schema.names)

    return fine.unionByName(coarse.mapInArrow(cut, runs.schema)) if bits else fine


def union_counts(runs: DataFrame, keys: list[str], *, bits: int | None = None) -> DataFrame:
    """``keys`` and ``n_distinct``: the different hashes in the union of each group's runs.

    The runs may come from any number of inputs, sliced alike or not (``resliced``). A slice of a group is one unit of work;
    its runs are decoded and united in one task, and the slices' counts are added. Null keys are groups of their own.
    """
    columns = [*keys, "slice"]
    kinds = {f.name: f.dataType.simpleString() for f in runs.schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in columns) + ", united bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begin in groups(batches, columns):
            first, n = (table.column(c).to_numpy().astype(np.int64) for c in ("first", "n"))
            runs_of = np.split(decode_runs(first, n, table.column("run").combine_chunks()), np.cumsum(n)[:-1])
            end = np.r_[begin[1:], table.num_rows]
            sizes = [len(unite(runs_of[a:b])) for a, b in zip(begin, end, strict=True)]
            own = [table.column(k).combine_chunks().take(pa.array(begin)) for k in columns]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sizes, type=pa.int64())], names=[*columns, "united"])

    united = resliced(runs, bits).select(*columns, "first", "n", "run").repartition(*columns).sortWithinPartitions(*columns, "first").mapInArrow(run, schema)
    return united.groupBy(*keys).agg(F.sum("united").alias("n_distinct"))


def collision_bound(n: Column) -> Column:
    """The birthday bound: at most so many pairs of ``n`` identifiers are expected to share a 64-bit hash.

    It bounds the expected number by which a count is too low, and the probability that it is too low at all.
    """
    n = n.cast("double")
    return n * (n - 1) / F.lit(2.0**65)


def calendar_counts(runs: DataFrame, keys: list[str], window_days: int, *, bits: int | None = None) -> DataFrame:
    """Different hashes of each group of ``keys`` by day, by trailing windows of days, and altogether.

    Columns ``keys``, ``span`` ("day", "window" or "all"), ``day`` (the window's last; null for all), ``n_days`` (1 to
    ``window_days``; null for all) and ``n_distinct``. A window counts for every last day and length for which one of its
    days has a run. The runs of a group and slice meet in one task once; days are united there, a window is the union of the
    next shorter one with one more day, and the whole is that of all days. Runs without day count for the whole only.
    """
    columns = [*keys, "slice"]
    kinds = {f.name: f.dataType.simpleString() for f in runs.schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in columns) + ", span string, day date, n_days int, united bigint"

    def spans(days: np.ndarray, values: list[np.ndarray]) -> Iterator[tuple[str, int | None, int | None, int]]:
        by_day = {d: unite([values[i] for i in np.flatnonzero(days == d)]) for d in np.unique(days)}
        none = by_day.pop(NO_DAY, None)
        for last in sorted({d + i for d in by_day for i in range(window_days)}):
            united = np.empty(0, dtype=np.int64)
            for length in range(1, window_days + 1):
                united = unite([united, by_day.get(last - length + 1, united)])
                if len(united):
                    yield "day" if length == 1 else "window", last, length, len(united)
        yield "all", None, None, len(unite([*by_day.values(), *([] if none is None else [none])]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begin in groups(batches, columns):
            first, n = (table.column(c).to_numpy().astype(np.int64) for c in ("first", "n"))
            values = np.split(decode_runs(first, n, table.column("run").combine_chunks()), np.cumsum(n)[:-1])
            days = table.column("day").combine_chunks().cast(pa.int32()).fill_null(NO_DAY).to_numpy()
            ends = [*begin[1:], table.num_rows]
            out = [(lo, *s) for lo, hi in zip(begin, ends, strict=True) for s in spans(days[lo:hi], values[lo:hi])]
            of, span, day, length, size = zip(*out, strict=True)
            own = [table.column(k).combine_chunks().take(pa.array(of)) for k in columns]
            kind = pa.array([None if d is None else int(d) for d in day], type=pa.int32()).cast(pa.date32())
            yield pa.RecordBatch.from_arrays([*own, pa.array(span), kind, pa.array(length, type=pa.int32()), pa.array(size, type=pa.int64())], names=[*columns, "span", "day", "n_days", "united"])

    read = resliced(runs, bits).select(*columns, "day", "first", "n", "run").repartition(*columns).sortWithinPartitions(*columns, "day", "first")
    return read.mapInArrow(run, schema).groupBy(*keys, "span", "day", "n_days").agg(F.sum("united").alias("n_distinct"))


def distinct_counts(df: DataFrame, instant: Column, event_type: str, identifier: str, *, window_days: int = 7, **how) -> DataFrame:
    """Near-exact numbers of different identifiers for days, types, and combinations of them.

    Columns ``level``, ``day``, ``n_days``, ``event_type`` (null where the level has none), ``n_distinct`` and
    ``collision_bound``. The levels are every UTC day ("day"), every type ("type"), every day and type ("day_type"), every 2
    to ``window_days`` days that end on a day ("window"), these for every type ("window_type"), and all rows ("all"). Hashes
    are exact up to collisions, which only lower a count.

    Each count is that of a union of the stored runs of ``hash_runs``; so is that of any other combination
    (``union_counts`` over a filter of them, or over runs of several inputs).

    Defined cases: rows with a null identifier are ignored; a row without instant has no day and counts for its type and
    for all; a row with a null type counts for its day and for all; repeated rows count once; an empty input has no rows;
    other columns play no part, whatever their names. Days before 1970 are days like others.
    """
    runs = materialize(hash_runs(df, utc_day(instant), event_type, identifier, **how), "hash-runs")
    bits = slice_bits(runs.agg(F.sum("n")).first()[0] or 0, how.get("per_slice", SLICE_HASHES))
    typed = calendar_counts(runs.filter(F.col("event_type").isNotNull()), ["event_type"], window_days, bits=bits)
    level = F.when(F.col("span") == "all", "type").otherwise(F.concat("span", F.lit("_type")))
    whole = calendar_counts(runs, [], window_days, bits=bits).select(F.col("span").alias("level"), "day", "n_days", F.lit(None).cast("string").alias("event_type"), "n_distinct")
    counts = typed.select(level.alias("level"), "day", "n_days", "event_type", "n_distinct").unionByName(whole)
    return counts.withColumn("collision_bound", collision_bound(F.col("n_distinct")))
