"""The most frequent values of a column among billions, exactly, by an aggregation that can spill."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOP = 100


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """``item`` and ``n`` of every non-null value: combined in each map task, hash-partitioned, spilling to disk when a
    partition's values outgrow its memory. A value with a third of all rows arrives as one row from each map task."""
    return df.select(F.col(column).alias("item")).filter(F.col("item").isNotNull()).groupBy("item").agg(F.count(F.lit(1)).alias("n"))


def most_frequent(df: DataFrame, column: str, k: int = TOP) -> DataFrame:
    """``item`` and ``n`` of the ``k`` most frequent non-null values of ``column``; the counts are exact.

    Every partition of the spillable aggregation keeps its own ``k`` best, and one final ordered limit merges these, so
    the last step sees ``k`` rows a partition. Ties go to the smaller value, so the answer is always the same.

    Defined cases: nulls aren't values; an empty string is; values count exactly as stored; repeated rows count each time;
    fewer than ``k`` values give them all, an empty input none; other columns play no part, whatever their names.
    """
    return value_counts(df, column).orderBy(F.desc("n"), F.asc("item")).limit(k)


def holding_share(df: DataFrame, column: str, one_in: int) -> DataFrame:
    """``item`` and ``n`` of the values that hold at least one in ``one_in`` of the rows where ``column`` isn't null.

    At most ``one_in`` values can, so they are among the ``one_in`` most frequent.
    """
    rows = df.select(F.count(F.col(column))).scalar()
    return most_frequent(df, column, one_in).filter(F.col("n") * one_in >= rows)
