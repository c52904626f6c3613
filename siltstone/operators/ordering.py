"""Sort specifications and the total order.

missing < null < bool < number < string < array and object; descending is the exact reverse. Within typed columns this is
Spark's own order with NULL (missing) first when ascending. Ties go by the implicit row order, ascending.
"""

from __future__ import annotations

from pyspark.sql import Column

from siltstone import messages as M
from siltstone.errors import InvalidPipeline
from siltstone.functions.paths import Frame

Sort = list[tuple[str, bool]]


def parse_query_sort(spec: list | None) -> Sort:
    """``[{path: direction}, …]``: anything but ``"desc"`` is ascending; entries that aren't objects are ignored.

    Several keys of one object rank in alphabetical order.
    """
    return [(path, way != "desc") for item in spec or [] if isinstance(item, dict) for path, way in sorted(item.items())]


def parse_stage_sort(spec: object, at: int) -> Sort:
    """``{path: "asc" | "desc" | 1 | -1}`` of a pipeline stage, keys in alphabetical order."""
    if not isinstance(spec, dict):
        raise InvalidPipeline(M.SORT_FORM.format(at))
    return [(path, not (way == "desc" or (type(way) is int and way == -1))) for path, way in sorted(spec.items())]


def order_columns(frame: Frame, sort: Sort, tie: list[str] = ()) -> list[Column]:
    """The columns to order by: every key of ``sort``, then the columns ``tie`` ascending."""
    keys = [k.asc_nulls_first() if up else k.desc_nulls_last() for path, up in sort for k in frame.field(path).sort_keys]
    return [*keys, *(frame.df[t].asc() for t in tie)]
