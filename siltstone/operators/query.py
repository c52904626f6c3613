"""Queries: filter, sort, offset, limit and projection, or a count."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from siltstone.errors import InvalidQuery
from siltstone.functions.paths import Frame
from siltstone.limits import DEFAULT_QUERY_LIMIT, MAX_QUERY_LIMIT
from siltstone.operators.filters import All, compile_filter, parse
from siltstone.operators.ordering import Sort, order_columns, parse_query_sort


@dataclass(frozen=True)
class Query:
    """A validated request."""

    filter: object
    sort: Sort
    limit: int
    offset: int
    fields: list[str] | None
    count_only: bool


def _whole(request: dict, name: str, default: int) -> int:
    v = request.get(name)
    if v is None:
        return default
    if not isinstance(v, int) or isinstance(v, bool) or v < 0:
        raise InvalidQuery(f"{name} must be a non-negative integer")
    return v


def parse_query(request: dict) -> Query:
    """The request ``{filter, sort, limit, offset, fields, count_only}``, all optional; raises InvalidQuery.

    The limit is 100 by default and silently at most 10,000.
    """
    fields, sort = request.get("fields"), request.get("sort")
    if fields is not None and not (isinstance(fields, list) and all(isinstance(f, str) for f in fields)):
        raise InvalidQuery("fields must be an array of strings")
    if sort is not None and not isinstance(sort, list):
        raise InvalidQuery("sort must be an array")
    return Query(
        filter=All(()) if request.get("filter") is None else parse(request["filter"]),
        sort=parse_query_sort(sort),
        limit=min(_whole(request, "limit", DEFAULT_QUERY_LIMIT), MAX_QUERY_LIMIT),
        offset=_whole(request, "offset", 0),
        fields=fields,
        count_only=bool(request.get("count_only")),
    )


def matching(frame: Frame, query: Query) -> Frame:
    """The rows that match the query's filter."""
    return frame if query.filter == All(()) else Frame(frame.df.filter(compile_filter(query.filter, frame)), frame.root, frame.bound)


def count(frame: Frame, query: Query) -> DataFrame:
    """One row with the ``count`` of all matches, whatever the limit; only the filter's columns are read."""
    return matching(frame, query).df.agg(F.count(F.lit(1)).alias("count"))


def id_range(frame: Frame) -> DataFrame:
    """The smallest and largest ``_id`` and the number of rows; collections keep these in their manifests."""
    return frame.df.agg(F.min("_id").alias("oldest"), F.max("_id").alias("newest"), F.count(F.lit(1)).alias("n"))


def page(frame: Frame, query: Query, row_order: list[str], seen: Observation | None = None) -> DataFrame:
    """The page of the query: a bounded top-k where an order is given, no full sort.

    ``row_order`` are the columns of the implicit row order: it breaks ties, and orders rows where no sort is asked for. An
    empty one leaves such rows in no order. ``seen`` learns the ``total`` of all matches when the page is run; for that an
    order is needed, since a page without one doesn't look at all of them.
    """
    found = matching(frame, query)
    if seen is not None:
        found = Frame(found.df.observe(seen, F.count(F.lit(1)).alias("total")), frame.root, frame.bound)
    order = order_columns(found, query.sort, row_order)
    df = found.df.orderBy(*order) if order else found.df
    df = df.offset(query.offset) if query.offset else df
    return project(Frame(df.limit(query.limit), frame.root, frame.bound), query.fields)


def project(frame: Frame, fields: list[str] | None) -> DataFrame:
    """``_id`` first, if there is one, then each path as a column named by its dotted text; all columns without ``fields``."""
    if fields is None:
        return frame.df
    wanted = dict.fromkeys([*(["_id"] if "_id" in frame.df.columns else []), *fields])
    return frame.df.select(*(frame.field(f).value.alias(f) for f in wanted))


def run(frame: Frame, request: dict, row_order: list[str] = ()) -> DataFrame:
    """The request's page or count, lazily."""
    query = parse_query(request)
    return count(frame, query) if query.count_only else page(frame, query, list(row_order))
