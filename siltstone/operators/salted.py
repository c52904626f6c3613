"""Per-key aggregation when a few keys hold most rows: salt the heavy keys, aggregate twice."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

SALTS = 32
HEAVY_SHARE = 0.01
SAMPLE_FRACTION = 0.01


@dataclass(frozen=True)
class Measure:
    """One aggregate in two steps: ``partial`` over the rows of a key and salt, ``merge`` over the partial results."""

    partial: dict[str, Column]
    merge: callable


def count() -> Measure:
    """All rows of a key."""
    return Measure({"n": F.count(F.lit(1))}, lambda p: F.sum(p["n"]))


def count_of(value: Column) -> Measure:
    """Rows whose value isn't null; 0 where all are."""
    return Measure({"n": F.count(value)}, lambda p: F.sum(p["n"]))


def total(value: Column) -> Measure:
    """Sum; null where all values are null."""
    return Measure({"s": F.sum(value)}, lambda p: F.sum(p["s"]))


def smallest(value: Column) -> Measure:
    """Minimum; null where all values are null."""
    return Measure({"m": F.min(value)}, lambda p: F.min(p["m"]))


def largest(value: Column) -> Measure:
    """Maximum; null where all values are null."""
    return Measure({"m": F.max(value)}, lambda p: F.max(p["m"]))


def mean(value: Column) -> Measure:
    """Arithmetic mean as DOUBLE; null where all values are null."""
    return Measure({"s": F.sum(value.cast("double")), "n": F.count(value)}, lambda p: F.sum(p["s"]) / F.nullif(F.sum(p["n"]), F.lit(0)))


def approx_distinct(value: Column) -> Measure:
    """Approximate number of different values by mergeable sketches; 0 where all are null."""
    return Measure({"h": F.hll_sketch_agg(value)}, lambda p: F.hll_sketch_estimate(F.hll_union_agg(p["h"])))


def heavy_key_hashes(df: DataFrame, keys: list[str], heavy_share: float = HEAVY_SHARE, fraction: float = SAMPLE_FRACTION) -> list[int]:
    """64-bit hashes of the keys that hold at least ``heavy_share`` of a ``fraction`` sample of the rows.

    At most ``1 / heavy_share`` keys can, so the answer is bounded whatever the data; it steers the salting only and never
    changes a result.
    """
    seen = Observation()
    sample = df.select(F.xxhash64(*keys).alias("h")).sample(fraction, seed=17).observe(seen, F.count(F.lit(1)).alias("rows"))
    top = sample.groupBy("h").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).limit(math.ceil(1 / heavy_share)).collect()
    return [r["h"] for r in top if r["n"] >= heavy_share * seen.get["rows"]]


def salted_aggregate(
    df: DataFrame,
    keys: list[str],
    measures: dict[str, Measure],
    *,
    salts: int = SALTS,
    heavy_share: float = HEAVY_SHARE,
    sample_fraction: float = SAMPLE_FRACTION,
) -> DataFrame:
    """Per-key results of ``measures`` for all keys, without a task that owns a heavy key.

    Two stages: rows of a heavy key get one of ``salts`` salts and are aggregated by key and salt (each map task combines
    before the shuffle); the partial results, at most ``salts`` a key, are merged by key. The salt is a hash of the row's
    position in its input split, hence spread evenly even over equal rows, and the same again when a lost task is repeated.

    Defined cases: a null key is a key of its own, as in GROUP BY; repeated rows count each time; an empty input gives no
    rows; columns of ``df`` other than the keys and those used by the measures play no part, whatever their names. The
    result's columns are the keys and the names of ``measures``, which must differ.
    """
    if not keys or not measures or len({*keys, *measures}) < len(keys) + len(measures):
        raise ValueError("keys and measures must be given, under different names")
    heavy = heavy_key_hashes(df, keys, heavy_share, sample_fraction)
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int")
    salt = F.when(F.xxhash64(*keys).isin(heavy), salt).otherwise(0) if heavy else F.lit(0)
    names = [f"k{i}" for i in range(len(keys))]
    partial = {f"p{i}_{part}": c for i, m in enumerate(measures.values()) for part, c in m.partial.items()}
    first = df.groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), salt.alias("salt")).agg(*(c.alias(n) for n, c in partial.items()))
    merged = (m.merge({part: F.col(f"p{i}_{part}") for part in m.partial}).alias(f"m{i}") for i, m in enumerate(measures.values()))
    final = first.groupBy(*names).agg(*merged)
    return final.select(*(F.col(n).alias(k) for k, n in zip(keys, names, strict=True)), *(F.col(f"m{i}").alias(o) for i, o in enumerate(measures)))


def keys_holding(df: DataFrame, keys: list[str], one_in: int, **how) -> DataFrame:
    """The keys without nulls that hold at least one in ``one_in`` of all rows of ``df``, with their exact ``n_rows``.

    Rows with null keys count in the total. No rows for an empty input. Whole numbers are compared, so a key that holds
    exactly its share is never lost by rounding.
    """
    counts = salted_aggregate(df, keys, {"n_rows": count()}, **how)
    for k in keys:
        counts = counts.filter(F.col(k).isNotNull())
    rows = df.select(F.count(F.lit(1))).scalar()
    return counts.filter(F.col("n_rows") * one_in >= rows)
