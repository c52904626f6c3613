"""Different values of a path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.paths import Frame, Schemaless, Typed, check_depth, value_of_key
from siltstone.limits import DISTINCT_LIMIT
from siltstone.operators.filters import compile_filter, parse


def distinct(frame: Frame, path: str, filter_spec: dict | None = None, limit: int = DISTINCT_LIMIT) -> DataFrame:
    """The ``value`` of each different value at ``path``, at most ``limit``, in ascending order.

    Missing values are skipped, an explicit null is one. Only the path and the filter's columns are read; values are made
    different by a hash aggregation in each map task before the shuffle, schemaless ones by their key, from which the value is
    read again.
    """
    check_depth(path)
    df = frame.df if filter_spec is None else frame.df.filter(compile_filter(parse(filter_spec), frame))
    f = Frame(df, frame.root, frame.bound).field(path)
    if isinstance(f, Typed):
        found = df.filter(f.present).select(f.column.alias("value")).distinct()
        return found.orderBy(*Typed(F.col("value"), f.kind).sort_keys).limit(limit)
    keys = df.filter(f.present).select(F.coalesce(f.key, F.lit("null")).alias("k")).distinct()
    found = keys.select(value_of_key(F.col("k")).alias("value"), "k")
    return found.orderBy(*Schemaless(F.col("value")).sort_keys, "k").limit(limit).select("value")
