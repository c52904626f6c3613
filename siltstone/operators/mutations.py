"""What deletes and updates by query, and retention, do to rows; without a place where rows are kept."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone import messages as M
from siltstone.errors import InvalidQuery
from siltstone.functions.paths import Frame
from siltstone.operators.filters import Test, compile_filter, parse


def hit(frame: Frame, node) -> Column:
    """True or false, never NULL: whether a row matches."""
    return F.coalesce(compile_filter(node, frame), F.lit(False))


def survivors(frame: Frame, filter_spec: dict) -> DataFrame:
    """The rows that a delete by query leaves."""
    return frame.df.filter(~hit(frame, parse(filter_spec)))


def parse_set(update: object) -> dict:
    """The paths and values of ``{"$set": {…}}``; raises InvalidQuery. Setting ``_id`` is refused."""
    if not isinstance(update, dict) or not isinstance(update.get("$set"), dict):
        raise InvalidQuery(M.UPDATE_FORM)
    if "_id" in update["$set"]:
        raise InvalidQuery("$set can't change _id")
    return update["$set"]


def updated(frame: Frame, filter_spec: dict, update: dict) -> DataFrame:
    """All rows of a typed table after an update by query: ``$set`` of columns and struct members, by dotted paths.

    Values are cast to the column's type; a path that the schema lacks is an error. Where the table has ``_rev``, it goes up
    by one in matching rows.
    """
    match, changed = hit(frame, parse(filter_spec)), {}
    for path, v in parse_set(update).items():
        first, *rest = path.split(".")
        if first not in frame.df.columns:
            raise InvalidQuery(f"Unknown column: {first}")
        whole = changed.get(first, frame.df[first])
        kind = frame.df.schema[first].dataType
        for name in rest:
            if not isinstance(kind, T.StructType) or name not in kind.names:
                raise InvalidQuery(f"Unknown path: {path}")
            kind = kind[name].dataType
        changed[first] = _set(whole, frame.df.schema[first].dataType, rest, F.lit(v).cast(kind))
    if "_rev" in frame.df.columns and "_rev" not in changed:
        changed["_rev"] = F.col("_rev") + 1
    return frame.df.select(*(F.when(match, changed[c]).otherwise(frame.df[c]).alias(c) if c in changed else frame.df[c] for c in frame.df.columns))


def _set(column: Column, kind: T.DataType, rest: list[str], value: Column) -> Column:
    """``column`` with the member at ``rest`` replaced; a missing struct on the way becomes one without other members."""
    if not rest:
        return value
    members = (_set(column[f.name], f.dataType, rest[1:], value) if f.name == rest[0] else column[f.name] for f in kind)
    return F.struct(*(m.alias(f.name) for m, f in zip(members, kind, strict=True)))


def cutoff(days: int, now: datetime.datetime) -> str:
    """The instant before which rows of a retention of ``days`` expire, as text."""
    return (now - datetime.timedelta(days=days)).isoformat()


def retained(frame: Frame, path: str, before: str) -> DataFrame:
    """The rows that retention leaves: those whose ``path`` isn't before ``before``. Text is compared as text, typed
    instants as instants; rows without a value stay."""
    return frame.df.filter(~hit(frame, Test(path, "$lt", before)))
