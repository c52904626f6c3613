"""Sessions: events of an entity cut at long silences, for any length of silence, from one tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.cartesian import CUT, build
from siltstone.sources.scratch import materialize

#: Events that one step of a task holds at a time; chunks of the tree are at most so long.
SLAB = 500_000
#: A group of the middle step merges the folded ends of ``2 ** FAN_BITS`` neighbouring partitions.
FAN_BITS = 6
#: A chunk's number is its partition's, with so many bits below for the slabs of the partition.
SLAB_BITS = 24
#: By default a tree holds every setting.
FLOOR_MS = 0
CEILING_MS = CUT - 1

_NODE, _ATOM = 0, 1


def _schema(kind: T.DataType) -> T.StructType:
    long = [T.StructField(f, T.LongType()) for f in ("chunk", "seq", "gap", "parent", "start", "end", "n")]
    return T.StructType([T.StructField("kind", T.ByteType()), T.StructField("entity", kind), *long])


def _changes(column: pa.Array) -> np.ndarray:
    if len(column) < 2:
        return np.ones(len(column), dtype=bool)
    return np.r_[True, pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)]


def _slabs(batches: Iterator[pa.RecordBatch], size: int, keep_whole: bool) -> Iterator[pa.Table]:
    """Tables of about ``size`` rows; with ``keep_whole``, no entity (and chunk group) is split between two."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < size:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        if keep_whole:
            begins = np.flatnonzero(_starts(table))
            if begins[-1] == 0:
                continue
            yield table.slice(0, begins[-1])
            held = table.slice(begins[-1]).to_batches()
        else:
            yield table
            held = []
        rows = sum(b.num_rows for b in held)
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _starts(table: pa.Table) -> np.ndarray:
    """Where a new sequence begins: another entity, or another group of chunks."""
    new = _changes(_one(table, "entity"))
    if "group" in table.column_names:
        new |= _changes(_one(table, "group"))
    return new


def _one(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def _grow(floor: int, ceiling: int, ends: str, slab: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of a task. ``ends``: which sequences may continue elsewhere: those at the ends of a slab ("slab"), all
    ("all") or none ("none")."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << SLAB_BITS
        for table in _slabs((b for b in batches if b.num_rows), slab, ends != "slab"):
            entity, begins = _one(table, "entity"), _starts(table)
            get = lambda name: _one(table, name).to_numpy().astype(np.int64)  # noqa: E731, B023
            start = get("start")
            whole = "end" in table.column_names
            end, n, inner = (get(c) for c in ("end", "n", "inner")) if whole else (start, np.ones_like(start), np.zeros_like(start))
            is_open = np.full(int(begins.sum()), ends == "all")
            if ends == "slab":
                is_open[[0, -1]] = True
            nodes, atoms = build(start, end, n, inner, begins, is_open, floor, ceiling)
            group = get("group") if "group" in table.column_names else None
            for kind, (at, *rest) in ((_NODE, nodes), (_ATOM, atoms)):
                gap, parent, s, e, c = rest if kind == _NODE else (rest[3], np.zeros_like(at), *rest[:3])
                for lo in range(0, len(at), 50_000):
                    cut = slice(lo, lo + 50_000)
                    own = np.full(len(at[cut]), chunk, dtype=np.int64) if group is None else group[at[cut]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), kind, dtype=np.int8)), entity.take(pa.array(at[cut])), pa.array(own), pa.array(np.arange(lo, lo + len(own)))]
                        + [pa.array(x[cut]) for x in (gap, parent, s, e, c)],
                        names=["kind", "entity", "chunk", "seq", "gap", "parent", "start", "end", "n"],
                    )
            chunk += 1

    return grow


def session_tree(df: DataFrame, entity: str, instant: Column, *, floor_ms: int = FLOOR_MS, ceiling_ms: int = CEILING_MS, slab: int = SLAB) -> DataFrame:
    """The sessions of every entity for all gap settings from ``floor_ms`` to ``ceiling_ms`` at once.

    Columns ``entity`` (under its own name), ``gap_ms``, ``parent_gap_ms``, ``start_ms``, ``end_ms``, ``n_events``: the
    nodes of the Cartesian tree over the gaps between an entity's consecutive instants. A row is a session for every
    setting ``t`` with ``gap_ms <= t < parent_gap_ms``; so ``cut`` is a filter that reaches the scan of the stored tree.
    By default that is every setting; a tree for fewer of them is smaller. The metadata of ``gap_ms`` has ``floor_ms`` and
    ``ceiling_ms``, which a stored tree keeps too.

    The events are range-partitioned by entity, instant and position in the input, so that an entity with a third of all
    rows spreads over a third of the partitions, however many of its instants are equal. Each slab of a partition grows its
    own tree. Only a slab's first and last entity may continue elsewhere; the spines of their trees, a few atoms each, are
    merged by groups of chunks and then by entity. The chunks' trees are written to the shared folder, since two readers
    must see the same chunks.

    Defined cases: rows with a null entity or without instant are ignored; equal instants are a gap of 0; repeated rows count
    each time; an empty input gives no rows; other columns play no part, whatever their names.
    """
    if not 0 <= floor_ms <= ceiling_ms < CUT:
        raise ValueError("0 <= floor_ms <= ceiling_ms is required")
    schema = _schema(df.select(entity).schema[0].dataType)
    events = (
        df.select(F.col(entity).alias("entity"), instant.alias("start"))
        .filter(F.col("entity").isNotNull() & F.col("start").isNotNull())
        .withColumn("tie", F.monotonically_increasing_id())
        .repartitionByRange("entity", "start", "tie")
        .sortWithinPartitions("entity", "start")
        .select("entity", "start")
    )
    chunks = materialize(events.mapInArrow(_grow(floor_ms, ceiling_ms, "slab", slab), schema), "session-chunks", partition_by=["kind"])

    def merged(atoms: DataFrame, keys: list[str], ends: str) -> DataFrame:
        columns = [*keys, "start", "end", "n", F.col("gap").alias("inner")]
        ordered = atoms.repartition(*keys).sortWithinPartitions(*keys, "chunk", "seq").select(*columns)
        return ordered.mapInArrow(_grow(floor_ms, ceiling_ms, ends, slab), schema)

    ends = chunks.filter(F.col("kind") == _ATOM).withColumn("group", F.shiftright("chunk", SLAB_BITS + FAN_BITS))
    middle = materialize(merged(ends, ["entity", "group"], "all"), "session-spines", partition_by=["kind"])
    last = merged(middle.filter(F.col("kind") == _ATOM), ["entity"], "none")
    nodes = chunks.filter(F.col("kind") == _NODE).unionByName(middle.filter(F.col("kind") == _NODE)).unionByName(last.filter(F.col("kind") == _NODE))
    return nodes.select(
        F.col("entity").alias(entity),
        F.col("gap").alias("gap_ms", metadata={"floor_ms": floor_ms, "ceiling_ms": ceiling_ms}),
        F.col("parent").alias("parent_gap_ms"),
        F.col("start").alias("start_ms"),
        F.col("end").alias("end_ms"),
        F.col("n").alias("n_events"),
    )


def cut(tree: DataFrame, gap_ms: int) -> DataFrame:
    """The sessions for one setting: a new one starts when more than ``gap_ms`` have passed.

    A setting outside the tree's floor and ceiling is an error, and so is a tree that doesn't say them.
    """
    reach = tree.schema["gap_ms"].metadata
    if not {"floor_ms", "ceiling_ms"} <= reach.keys():
        raise ValueError("the metadata of gap_ms doesn't say the tree's floor_ms and ceiling_ms")
    if not reach["floor_ms"] <= gap_ms <= reach["ceiling_ms"]:
        raise ValueError(f"the tree holds settings from {reach['floor_ms']} to {reach['ceiling_ms']} ms, not {gap_ms}")
    nodes = tree.filter((F.col("gap_ms") <= gap_ms) & (F.col("parent_gap_ms") > gap_ms))
    return nodes.drop("gap_ms", "parent_gap_ms").withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))
