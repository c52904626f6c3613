"""The filter language: parsed once, compiled to one Column.

Evaluation is two-valued: an operator on a missing field is false, except ``$exists``. Spark's logic has three values, but
a filter takes NULL for false and AND and OR keep that, so only the operand of a negation needs ``coalesce``; positive
predicates stay as they are and can be pushed to the scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone import messages as M
from siltstone.errors import InvalidQuery
from siltstone.functions.dialect import translate
from siltstone.functions.paths import Field, Frame, Typed, check_depth
from siltstone.limits import MAX_FILTER_BRANCHES, MAX_FILTER_DEPTH

FIELD_OPERATORS = ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$exists", "$regex", "$contains")


@dataclass(frozen=True)
class Test:
    """An operator on a field."""

    path: str
    op: str
    operand: object


@dataclass(frozen=True)
class All:
    """True if all parts are; true without parts."""

    parts: tuple


@dataclass(frozen=True)
class Any:
    """True if one part is; false without parts."""

    parts: tuple


@dataclass(frozen=True)
class Not:
    """The complement."""

    part: object


def parse(spec: object, depth: int = 0):
    """The filter as a tree; raises InvalidQuery for anything that isn't one."""
    if depth > MAX_FILTER_DEPTH:
        raise InvalidQuery(M.FILTER_DEPTH.format(MAX_FILTER_DEPTH))
    if not isinstance(spec, dict):
        raise InvalidQuery(M.FILTER_FORM)
    parts: list = []
    for key, value in spec.items():
        if key in ("$and", "$or"):
            if not isinstance(value, list):
                raise InvalidQuery(M.MUST_BE_ARRAY.format(key))
            if len(value) > MAX_FILTER_BRANCHES:
                raise InvalidQuery(M.FILTER_BRANCHES.format(MAX_FILTER_BRANCHES))
            parts.append((All if key == "$and" else Any)(tuple(parse(v, depth + 1) for v in value)))
        elif key == "$not":
            parts.append(Not(parse(value, depth + 1)))
        else:
            check_depth(key)
            parts.extend(_tests(key, value))
    return parts[0] if len(parts) == 1 else All(tuple(parts))


def _tests(path: str, value: object) -> list[Test]:
    if not isinstance(value, dict):
        return [Test(path, "$eq", value)]
    for op, operand in value.items():
        if op not in FIELD_OPERATORS:
            raise InvalidQuery(M.UNKNOWN_OPERATOR.format(op))
        if op == "$regex" and isinstance(operand, str):
            translate(operand)
    return [Test(path, op, operand) for op, operand in value.items()]


def paths_of(node) -> set[str]:
    """The paths that a filter looks at."""
    if isinstance(node, Test):
        return {node.path}
    if isinstance(node, Not):
        return paths_of(node.part)
    return set().union(*map(paths_of, node.parts))


def compile_filter(node, frame: Frame) -> Column:
    """The Column that is true for the matching rows, and false or NULL for the others."""
    if isinstance(node, Test):
        return _compile_test(frame.field(node.path), node.op, node.operand)
    if isinstance(node, Not):
        return ~_known(compile_filter(node.part, frame))
    columns = [compile_filter(p, frame) for p in node.parts]
    if isinstance(node, All):
        return reduce(lambda a, b: a & b, columns) if columns else F.lit(True)
    return reduce(lambda a, b: a | b, columns) if columns else F.lit(False)


def _known(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _compile_test(field: Field, op: str, operand: object) -> Column:
    if op == "$exists":
        return ~field.present if operand is False else field.present
    if op == "$eq":
        return field.equals(operand)
    if op == "$ne":
        return field.present & ~_known(field.equals(operand))
    if op == "$in":
        return _among(field, operand) if isinstance(operand, list) else F.lit(False)
    if op == "$nin":
        return field.present & ~_known(_among(field, operand)) if isinstance(operand, list) else field.present
    if op == "$regex":
        return field.matches(operand) if isinstance(operand, str) else F.lit(False)
    if op == "$contains":
        return field.contains(operand)
    return field.compare(op, operand)


def _among(field: Field, operands: list) -> Column:
    """Equality with one of the operands; strings of a typed column as one IN that can be pushed to the scan."""
    texts = [v for v in operands if isinstance(v, str)]
    if isinstance(field, Typed) and isinstance(field.kind, T.StringType):
        return field.column.isin(texts) if texts else F.lit(False)
    return reduce(lambda a, b: a | b, (field.equals(v) for v in operands)) if operands else F.lit(False)
