"""Value-count rollups: the joint counts of a few categorical paths, instead of the rows.

A rollup answers counts whose filter looks at its paths only, and groups by one of them that are only counted. It holds
exactly what the rows would give, so answers never differ; anything else falls back to the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.paths import Frame, Typed, value_of_key
from siltstone.limits import PROFILE_ROWS, ROLLUP_CARDINALITY
from siltstone.operators.filters import compile_filter, paths_of
from siltstone.operators.pipeline import Accumulator, Stage, group
from siltstone.operators.query import Query


#: Combinations of values that a chosen rollup may have, so that it stays small beside the rows.
MOST_COMBINATIONS = 100_000


@dataclass
class Rollup:
    """The joint counts ``n_rows`` of ``paths`` in one version of the data."""

    df: DataFrame
    paths: list[str]

    @property
    def frame(self) -> Frame:
        return Frame(self.df, None, {p: f"p{i}" for i, p in enumerate(self.paths)})


def build(frame: Frame, paths: list[str], by: list[Column] = (), more: list[Column] = ()) -> Rollup:
    """One aggregation over the columns of ``paths``. Missing, null and values of different types stay apart.

    ``by`` are further columns to count apart by, and ``more`` further aggregates; both are kept beside ``n_rows``.
    """
    fields = [frame.field(p) for p in paths]
    keys = [(f.key if isinstance(f, Typed) else F.coalesce(f.key, F.when(f.present, F.lit("null")))).alias(f"k{i}") for i, f in enumerate(fields)]
    counted = frame.df.groupBy(*keys, *by).agg(F.count(F.lit(1)).alias("n_rows"), *more)
    own = [(F.col(f"k{i}") if isinstance(f, Typed) else value_of_key(F.col(f"k{i}"))).alias(f"p{i}") for i, f in enumerate(fields)]
    return Rollup(counted.select(*own, *counted.columns[len(keys) :]), list(paths))


def covers_count(rollup: Rollup, query: Query) -> bool:
    """Whether the rollup has all that a count-only query looks at."""
    return query.count_only and paths_of(query.filter) <= set(rollup.paths)


def count(rollup: Rollup, query: Query) -> DataFrame:
    """The ``count`` of a covered query."""
    rows = rollup.df.filter(compile_filter(query.filter, rollup.frame))
    return rows.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("count"))


def covers_group(rollup: Rollup, stages: list[Stage]) -> int:
    """How many leading stages the rollup answers: an optional covered $match and a $group of covered paths that only
    counts; 0 if it can't."""
    at = 1 if stages[0].name == "$match" else 0
    if at and not paths_of(stages[0].spec) <= set(rollup.paths) or len(stages) <= at or stages[at].name != "$group":
        return 0
    key, made = stages[at].spec
    paths = [key] if isinstance(key, str) else [p for p in key.values() if isinstance(p, str)] if isinstance(key, dict) else []
    return at + 1 if paths and set(paths) <= set(rollup.paths) and all(a.op == "$count" for a in made.values()) else 0


def group_counts(rollup: Rollup, stages: list[Stage]) -> DataFrame:
    """The rows after the covered stages: counts are sums of the rollup's."""
    frame = rollup.frame
    if stages[0].name == "$match":
        frame = Frame(frame.df.filter(compile_filter(stages[0].spec, frame)), None, frame.bound)
    key, made = stages[-1].spec
    summed = group(frame, key, {n: Accumulator("$sum", "n_rows") for n in made})
    return summed.select("_id", *(F.col(f"`{n}`").cast("bigint").alias(n) for n in made))


def scalar_paths(frame: Frame, rows: int = PROFILE_ROWS) -> list[str]:
    """Paths of single values at the top and one level below, without system fields: of the schema's columns, and of the
    documents that the first ``rows`` rows hold."""

    def members(kind: T.StructType, above: str, levels: int) -> list[str]:
        found = []
        for f in kind:
            if isinstance(f.dataType, T.StructType):
                found += members(f.dataType, f"{above}{f.name}.", levels - 1) if levels else []
            elif isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.VariantType) and "." not in f.name:
                found.append(above + f.name)
        return found

    columns = T.StructType([f for f in frame.df.schema if f.name != frame.root and f.name[:1] not in "_."])
    found = members(columns, "", 1)
    if frame.root:
        said = frame.df.limit(rows).agg(F.schema_of_variant_agg(frame.root)).first()[0]
        inside = T.DataType.fromDDL(said.replace("OBJECT<", "STRUCT<")) if said.startswith("OBJECT<") else T.StructType()
        found += [p for p in members(inside, "", 1) if p[:1] != "_"]
    return found


def choose(counts: dict[str, int], most: int = MOST_COMBINATIONS) -> list[str]:
    """The paths of fewest values whose combinations are at most ``most``."""
    chosen, product = [], 1
    for path, n in sorted(counts.items(), key=lambda x: (x[1], x[0])):
        product *= n + 1
        if product > most:
            break
        chosen.append(path)
    return chosen


def profile(frame: Frame, paths: list[str], rows: int = PROFILE_ROWS, most: int = ROLLUP_CARDINALITY) -> dict[str, int]:
    """Paths with 1 to ``most - 1`` different values among the first ``rows`` rows, and how many: worth a rollup."""
    sample = Frame(frame.df.limit(rows), frame.root, frame.bound)
    counts = sample.df.agg(*(F.count_distinct(sample.field(p).key).alias(f"c{i}") for i, p in enumerate(paths))).first()
    return {p: counts[i] for i, p in enumerate(paths) if 0 < counts[i] < most}
