"""One row per entity with counts, recency and totals for each of a fixed list of event types."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TYPES = 4096
#: Types of a block: conditional counts and maxima that a row of partial results has.
WIDTH = 8


def type_list(df: DataFrame, event_type: str, instant: Column, max_types: int = MAX_TYPES) -> tuple[list[str], int | None]:
    """The different non-null types in order of their bytes, and the latest instant of all rows.

    One pass over two columns, combined before the shuffle. More than ``max_types`` types is an error: the row of an entity
    has a place for each, so the list must be known to be short.
    """
    seen = df.groupBy(F.col(event_type).alias("t")).agg(F.max(instant).alias("last")).limit(max_types + 2).collect()
    types = sorted((r["t"] for r in seen if r["t"] is not None), key=lambda t: t.encode())
    if len(types) > max_types:
        raise ValueError(f"more than {max_types} different values of {event_type}")
    return types, max((r["last"] for r in seen if r["last"] is not None), default=None)


def feature_table(
    df: DataFrame,
    entity: str,
    event_type: str,
    instant: Column,
    *,
    types: list[str] | None = None,
    as_of_ms: int | None = None,
    max_types: int = MAX_TYPES,
    width: int = WIDTH,
    unseen: int | None = None,
) -> DataFrame:
    """One row per non-null entity.

    Columns: ``entity`` (under its own name); ``n_events`` and ``since_ms``, totals over all types; ``n_types``, the number
    of listed types seen; ``n_other``, events whose type is null or not listed; ``counts`` and ``since``, arrays with one
    place for each listed type in the list's order: its events (0 if none), and the milliseconds from its last instant to
    ``as_of_ms`` (``unseen`` if it has none). ``types`` defaults to all types of ``df`` and ``as_of_ms`` to its latest instant.

    One pass with conditional counts and maxima, combined in each map task before the shuffle. The list is cut into blocks
    of ``width`` types and an entity has a row of conditional results only for the blocks that it has events in: most
    entities have few of several hundred types, and a row over the whole list would be thousands of zeros for each entity
    in each map task. An entity with a third of all rows still sends at most one row per block from each map task. Its
    blocks are then laid out over the fixed list in one task.

    Defined cases: rows with a null entity are ignored (for ``as_of_ms``'s default they count, as rows of the table); an
    event without instant counts, but has no recency; instants after ``as_of_ms`` give a negative recency; repeated rows
    count each time; an empty input gives no rows; other columns play no part, whatever their names.
    """
    if types is None or as_of_ms is None:
        seen, latest = type_list(df, event_type, instant, max_types)
        types = seen if types is None else types
        as_of_ms = latest if as_of_ms is None else as_of_ms
    if len(types) > max_types or len(set(types)) < len(types):
        raise ValueError(f"types must be at most {max_types} different values")
    places = df.sparkSession.createDataFrame(list(enumerate(types)), "place int, t string")
    events = df.select(F.col(entity).alias("e"), F.col(event_type).alias("t"), instant.alias("ms")).filter(F.col("e").isNotNull())
    placed = events.join(F.broadcast(places), "t", "left")
    here = [F.col("place") % width == j for j in range(width)]
    blocks = placed.groupBy("e", F.floor(F.col("place") / width).cast("int").alias("block")).agg(
        F.count(F.lit(1)).alias("n"),
        F.max("ms").alias("last"),
        *(F.count_if(h).alias(f"n{j}") for j, h in enumerate(here)),
        *(F.max(F.when(h, F.col("ms"))).alias(f"last{j}") for j, h in enumerate(here)),
    )
    end, never, own = F.lit(as_of_ms).cast("bigint"), F.lit(unseen).cast("bigint"), range(width)
    laid = F.struct("block", F.array(*(f"n{j}" for j in own)).alias("n"), F.array(*(F.coalesce(end - F.col(f"last{j}"), never) for j in own)).alias("since"))
    rows = blocks.groupBy("e").agg(
        F.sum("n").alias("n_events"),
        (end - F.max("last")).alias("since_ms"),
        F.sum(sum((F.when(F.col(f"n{j}") > 0, 1).otherwise(0) for j in own), F.lit(0))).alias("n_types"),
        F.coalesce(F.sum(F.when(F.col("block").isNull(), F.col("n"))), F.lit(0)).alias("n_other"),
        F.array_sort(F.collect_list(F.when(F.col("block").isNotNull(), laid))).alias("blocks"),
    )
    return rows.select(
        F.col("e").alias(entity),
        "n_events",
        "since_ms",
        "n_types",
        "n_other",
        _laid_out(len(types), width, "n", 0).alias("counts"),
        _laid_out(len(types), width, "since", unseen).alias("since"),
    )


def _laid_out(places: int, width: int, member: str, filler: int | None) -> Column:
    """A member of ``blocks``, in the blocks' order, as an array of all places, with filler for the blocks that lack.

    Works through the blocks that exist and fills the stretches between them at once, instead of asking at each place.
    """

    def fill(n: Column) -> Column:
        return F.array_repeat(F.lit(filler).cast("bigint"), n * width)

    def block_at(i: Column) -> Column:
        return F.coalesce(F.get("blocks", i)["block"], F.lit(-1))

    pieces = F.transform("blocks", lambda b, i: F.concat(fill(b["block"] - block_at(i - 1) - 1), b[member]))
    rest = fill(F.lit(-(-places // width) - 1) - block_at(F.size("blocks") - 1))
    return F.slice(F.flatten(F.concat(pieces, F.array(rest))), 1, places)


def widen(features: DataFrame, types: list[str], names: list[str] | None = None) -> DataFrame:
    """The arrays of ``feature_table`` as two columns for each type, ``n_<name>`` and ``since_<name>``.

    ``names`` default to the places 1, 2, …, since types may be any text and differ only by case.
    """
    names = names or [str(i + 1) for i in range(len(types))]
    wide = [c for i, n in enumerate(names) for c in (F.col("counts")[i].alias(f"n_{n}"), F.col("since")[i].alias(f"since_{n}"))]
    return features.select(*(c for c in features.columns if c not in ("counts", "since")), *wide)
