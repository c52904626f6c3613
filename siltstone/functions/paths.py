"""Dotted paths over typed columns and schemaless documents: what a path means in a DataFrame.

A path is bound by the schema. Struct members and map keys are followed as columns, so pruning and pushdown reach the
scan. A VARIANT column, or a STRING column that holds JSON, is followed inside the value; there, a missing field and an
explicit null differ. In typed columns NULL means missing. No path goes through an array.
"""

from __future__ import annotations

import datetime
import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone import messages as M
from siltstone.errors import InvalidQuery
from siltstone.functions.dialect import translate
from siltstone.limits import MAX_PATH_SEGMENTS

#: Numbers closer than this are equal, as 64-bit floats are compared by the language.
EPSILON = 2.0**-52
#: Below this, whole numbers are exact as 64-bit floats.
EXACT = 2**53

_WHOLE, _FLOAT = ("BIGINT", "INT", "SMALLINT", "TINYINT"), ("DOUBLE", "FLOAT")
_OPERATORS = {"$gt": "__gt__", "$gte": "__ge__", "$lt": "__lt__", "$lte": "__le__"}


def check_depth(path: str) -> None:
    """Raises InvalidQuery for a path of too many segments."""
    if path.count(".") >= MAX_PATH_SEGMENTS:
        raise InvalidQuery(M.PATH_DEPTH.format(MAX_PATH_SEGMENTS))


def is_number(v) -> bool:
    """Whether a Python value is a JSON number."""
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def _same_number(column: Column, v: float, whole: bool) -> Column:
    """Equality with the language's tolerance, in a form whose bounds can be pushed to the scan."""
    if isinstance(v, int) and abs(v) < EXACT and whole:
        return column == F.lit(v)
    if abs(v) >= 2:
        return column.cast("double") == F.lit(float(v))
    return column.between(F.lit(v - 2 * EPSILON), F.lit(v + 2 * EPSILON)) & (F.abs(column - F.lit(float(v))) < F.lit(EPSILON))


class Field:
    """What a path yields; this one: nothing, ever."""

    present = property(lambda self: F.lit(False))
    value = property(lambda self: F.lit(None).cast("string"))
    number = property(lambda self: F.lit(None).cast("double"))
    #: Orderable columns whose equality is the language's identity of values; NULL for missing and null.
    key = property(lambda self: F.lit(None).cast("string"))
    sort_keys = property(lambda self: [F.lit(0)])
    #: The value for minimum and maximum, NULL where it doesn't take part, and the order of such values.
    ranked = property(lambda self: (self.value, self.value))

    def equals(self, v) -> Column:
        """True where the value is equal to the literal ``v``; else false or NULL."""
        return F.lit(False)

    def compare(self, op: str, v) -> Column:
        """True where the value stands in the order ``op`` to the literal; else false or NULL."""
        return F.lit(False)

    def matches(self, pattern: str) -> Column:
        """True where the value is a string in which ``pattern`` is found; else false or NULL."""
        return F.lit(False)

    def contains(self, v) -> Column:
        """True where the value is an array with an element equal to ``v``; else false or NULL."""
        return F.lit(False)


@dataclass
class Typed(Field):
    """A typed column or a member of one."""

    column: Column
    kind: T.DataType

    @property
    def present(self) -> Column:
        return self.column.isNotNull()

    @property
    def value(self) -> Column:
        return self.column

    @property
    def key(self) -> Column:
        return self.column

    @property
    def number(self) -> Column:
        return self.column.cast("double") if isinstance(self.kind, T.NumericType) else F.lit(None).cast("double")

    @property
    def sort_keys(self) -> list[Column]:
        return [F.to_json(self.column) if isinstance(self.kind, (T.MapType, T.VariantType)) else self.column]

    @property
    def ranked(self) -> tuple[Column, Column]:
        return self.column, self.sort_keys[0]

    def _literal(self, v) -> Column | None:
        """``v`` as a literal of the column's class; None if it is of another."""
        kind = self.kind
        if isinstance(kind, T.NumericType):
            return F.lit(v) if is_number(v) else None
        if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
            return F.lit(v) if isinstance(v, str) else None
        if isinstance(kind, T.BooleanType):
            return F.lit(v) if isinstance(v, bool) else None
        if isinstance(kind, T.DatetimeType) and isinstance(v, (str, datetime.date)):
            return F.lit(v).try_cast(kind.simpleString())
        return None

    def equals(self, v) -> Column:
        if isinstance(self.kind, T.NumericType) and is_number(v):
            return _same_number(self.column, v, isinstance(self.kind, T.IntegralType))
        if isinstance(self.kind, T.ArrayType) and isinstance(v, list):
            each = [Typed(F.get(self.column, i), self.kind.elementType) for i in range(len(v))]
            same = (e.equals(x) if x is not None else e.column.isNull() for e, x in zip(each, v, strict=True))
            return reduce(lambda a, b: a & b, same, F.size(self.column) == len(v))
        if isinstance(self.kind, T.StructType) and isinstance(v, dict):
            members = {f.name: Typed(self.column[f.name], f.dataType) for f in self.kind}
            if not v.keys() <= members.keys():
                return F.lit(False)
            same = (m.equals(v[n]) if v.get(n) is not None else m.column.isNull() for n, m in members.items())
            return reduce(lambda a, b: a & b, same, self.present)
        literal = self._literal(v)
        return F.lit(False) if literal is None else self.column == literal

    def compare(self, op: str, v) -> Column:
        literal = self._literal(v)
        if literal is None:
            return F.lit(False)
        exact = not is_number(v) or (isinstance(v, int) and abs(v) < EXACT) or not isinstance(self.kind, T.IntegralType)
        column = self.column if exact else self.column.cast("double")
        return getattr(column, _OPERATORS[op])(literal if exact else F.lit(float(v)))

    def matches(self, pattern: str) -> Column:
        return self.column.rlike(translate(pattern)) if isinstance(self.kind, T.StringType) else F.lit(False)

    def contains(self, v) -> Column:
        if not isinstance(self.kind, T.ArrayType):
            return F.lit(False)
        element = self.kind.elementType
        return F.exists(self.column, lambda e: F.coalesce(e.isNull() if v is None else Typed(e, element).equals(v), F.lit(False)))


@dataclass
class Schemaless(Field):
    """A place inside a VARIANT; ``base`` may be NULL for a document that is none."""

    base: Column
    path: str = "$"

    def _get(self, kind: str) -> Column:
        return F.try_variant_get(self.base, self.path, kind)

    @property
    def value(self) -> Column:
        return self._get("variant")

    @property
    def kind(self) -> Column:
        """The value's type; NULL if missing, VOID for an explicit null. Of decimals, arrays and objects with what is inside."""
        return F.schema_of_variant(self.value)

    @property
    def present(self) -> Column:
        return self.value.isNotNull()

    @property
    def _is_float(self) -> Column:
        return self.kind.isin(*_FLOAT) | self.kind.startswith("DECIMAL")

    @property
    def _is_number(self) -> Column:
        return self.kind.isin(*_WHOLE) | self._is_float

    @property
    def _is_compound(self) -> Column:
        return self.kind.startswith("ARRAY<") | self.kind.startswith("OBJECT<")

    @property
    def number(self) -> Column:
        return F.when(self._is_number, self._get("double"))

    @property
    def string(self) -> Column:
        """The value if it is a string."""
        return F.when(self.kind == "STRING", self._get("string"))

    @property
    def key(self) -> Column:
        return F.when(self._is_float, F.concat(F.lit("~"), self._get("double").cast("string"))).when(self.kind != "VOID", F.to_json(self.value))

    @property
    def rank(self) -> Column:
        """Place of the value's type in the total order; 0 if missing."""
        kind = self.kind
        other = F.when(kind == "VOID", 1).when(kind == "BOOLEAN", 2).when(self._is_number, 3).when(kind == "STRING", 4).otherwise(5)
        return F.when(self.present, other).otherwise(0)

    @property
    def _within(self) -> list[Column]:
        kind = self.kind
        number = F.when(kind == "BOOLEAN", self._get("boolean").cast("double")).otherwise(self.number)
        text = F.when(kind == "STRING", self._get("string")).when(~(kind.isin("VOID", "BOOLEAN") | self._is_number), F.to_json(self.value))
        return [number, text]

    @property
    def sort_keys(self) -> list[Column]:
        return [self.rank, *self._within]

    @property
    def ranked(self) -> tuple[Column, Column]:
        rank = self.rank
        number, text = self._within
        order = F.struct(rank.alias("r"), number.alias("n"), text.alias("t"))
        return self.value, F.when(rank > 1, order)

    def equals(self, v) -> Column:
        if v is None:
            return self.kind == "VOID"
        if isinstance(v, bool):
            return (self.kind == "BOOLEAN") & (self._get("boolean") == F.lit(v))
        if is_number(v):
            return self._is_number & _same_number(self._get("double"), float(v), False)
        if isinstance(v, str):
            return (self.kind == "STRING") & (self._get("string") == F.lit(v))
        literal = F.parse_json(F.lit(json.dumps(v, ensure_ascii=False)))
        return self._is_compound & (F.to_json(self.value) == F.to_json(literal)) & (F.schema_of_variant(self.value) == F.schema_of_variant(literal))

    def compare(self, op: str, v) -> Column:
        order = lambda kind, literal: getattr(self._get(kind), _OPERATORS[op])(F.lit(literal))
        if isinstance(v, bool):
            return (self.kind == "BOOLEAN") & order("boolean", v)
        if is_number(v):
            return self._is_number & order("double", float(v))
        if isinstance(v, str):
            return (self.kind == "STRING") & order("string", v)
        return F.lit(False)

    def matches(self, pattern: str) -> Column:
        return (self.kind == "STRING") & self._get("string").rlike(translate(pattern))

    def contains(self, v) -> Column:
        return self.kind.startswith("ARRAY<") & F.exists(self._get("array<variant>"), lambda e: F.coalesce(Schemaless(e).equals(v), F.lit(False)))


def value_of_key(key: Column) -> Column:
    """The VARIANT whose ``key`` this is; of an explicit null, the text ``null``."""
    return F.parse_json(F.regexp_replace(key, r"\A~", ""))


def _inside(segments: list[str]) -> str:
    """The path of VARIANT functions for the segments."""
    return "$" + "".join("[" + json.dumps(s, ensure_ascii=False) + "]" for s in segments)


@dataclass
class Frame:
    """A DataFrame and how paths are bound in it.

    ``root`` names a VARIANT column that holds the rest of each document: a path whose first segment is no other column is
    looked up there. ``bound`` maps whole paths to columns and goes before (rollups have one column for a path).
    """

    df: DataFrame
    root: str | None = None
    bound: dict[str, str] | None = None

    def field(self, path: str) -> Field:
        """The field at a dotted path; a path that the schema lacks is missing in every row."""
        if self.bound and path in self.bound:
            name = self.bound[path]
            return self._follow(F.col(f"`{name}`"), self.df.schema[name].dataType, [])
        first, *rest = path.split(".")
        if 1 + len(rest) > MAX_PATH_SEGMENTS:
            return Field()
        if first in self.df.columns and first != self.root:
            return self._follow(F.col("`" + first.replace("`", "``") + "`"), self.df.schema[first].dataType, rest)
        if self.root is None:
            return Field()
        return Schemaless(F.col(self.root), _inside([first, *rest])) if _sayable([first, *rest]) else Field()

    def _follow(self, column: Column, kind: T.DataType, rest: list[str]) -> Field:
        while rest:
            if isinstance(kind, T.VariantType):
                return Schemaless(column, _inside(rest)) if _sayable(rest) else Field()
            if isinstance(kind, T.StringType):
                return Schemaless(F.try_parse_json(column), _inside(rest)) if _sayable(rest) else Field()
            if isinstance(kind, T.StructType) and rest[0] in kind.names:
                column, kind = column.getField(rest[0]), kind[rest[0]].dataType
            elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
                column, kind = F.try_element_at(column, F.lit(rest[0])), kind.valueType
            else:
                return Field()
            rest = rest[1:]
        return Schemaless(column) if isinstance(kind, T.VariantType) else Typed(column, kind)


def _sayable(segments: list[str]) -> bool:
    """Whether the path language of VARIANT functions can name all segments."""
    return all(s and '"' not in s and "\\" not in s for s in segments)
