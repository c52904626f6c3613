"""Aggregation pipelines: $match, $group, $sort, $limit and $skip folded into one DataFrame."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone import messages as M
from siltstone.errors import InvalidPipeline
from siltstone.functions.paths import Field, Frame, Schemaless, Typed, value_of_key
from siltstone.limits import COLLECT_CAP, MAX_PIPELINE_STAGES
from siltstone.operators.filters import compile_filter, parse
from siltstone.operators.ordering import order_columns, parse_stage_sort

ACCUMULATORS = ("$count", "$sum", "$avg", "$min", "$max", "$collect")


@dataclass(frozen=True)
class Accumulator:
    """One output of a $group: operator and path."""

    op: str
    path: str | None


@dataclass(frozen=True)
class Stage:
    """A validated stage; ``spec`` is the parsed operand."""

    name: str
    spec: object


@dataclass
class Outcome:
    """A pipeline's rows and what is known of them."""

    df: DataFrame
    groups: DataFrame | None = None
    collected: list[str] = field(default_factory=list)


def parse_pipeline(stages: object) -> list[Stage]:
    """All stages, validated before any job starts; raises InvalidPipeline or InvalidQuery."""
    if not isinstance(stages, list) or not stages:
        raise InvalidPipeline(M.NO_STAGES)
    if len(stages) > MAX_PIPELINE_STAGES:
        raise InvalidPipeline(M.STAGES.format(MAX_PIPELINE_STAGES))
    return [_parse_stage(s, i) for i, s in enumerate(stages)]


def _parse_stage(stage: object, at: int) -> Stage:
    if not isinstance(stage, dict):
        raise InvalidPipeline(M.STAGE_FORM.format(at))
    if len(stage) != 1:
        raise InvalidPipeline(M.STAGE_KEYS.format(at))
    (name, spec), readers = next(iter(stage.items())), {"$match": lambda s, _: parse(s), "$group": _parse_group, "$sort": parse_stage_sort}
    if name in readers:
        return Stage(name, readers[name](spec, at))
    if name in ("$limit", "$skip"):
        if not isinstance(spec, int) or isinstance(spec, bool) or spec < 0:
            raise InvalidPipeline(M.STAGE_NUMBER.format(at, name))
        return Stage(name, spec)
    raise InvalidPipeline(M.STAGE_NAME.format(at, name))


def _parse_group(spec: object, at: int) -> tuple[object, dict[str, Accumulator]]:
    if not isinstance(spec, dict):
        raise InvalidPipeline(M.GROUP_FORM.format(at))
    if "_id" not in spec:
        raise InvalidPipeline(M.GROUP_KEY.format(at))
    made = {}
    for name, value in sorted(spec.items()):
        if name == "_id":
            continue
        if not isinstance(value, dict):
            raise InvalidPipeline(M.ACCUMULATOR_FORM.format(at, name))
        if len(value) != 1:
            raise InvalidPipeline(M.ACCUMULATOR_KEYS.format(at, name))
        op, path = next(iter(value.items()))
        if op not in ACCUMULATORS:
            raise InvalidPipeline(M.ACCUMULATOR_NAME.format(at, op))
        if op != "$count" and not isinstance(path, str):
            raise InvalidPipeline(M.ACCUMULATOR_PATH.format(at, op))
        made[name] = Accumulator(op, None if op == "$count" else path)
    return spec["_id"], made


def run(frame: Frame, stages: object, row_order: list[str] = (), mark_truncated: bool = False) -> DataFrame:
    """The pipeline's rows, lazily."""
    return outcome(frame, parse_pipeline(stages), list(row_order), mark_truncated).df


def outcome(frame: Frame, stages: list[Stage], row_order: list[str], mark_truncated: bool = False) -> Outcome:
    """The stages applied in order.

    ``row_order`` breaks ties and orders rows as long as no $group has made new ones, whose order is by ``_id`` only where
    asked for. ``$sort`` followed by ``$skip`` and ``$limit`` is one bounded top-k. With ``mark_truncated`` every $collect
    has a companion column ``_truncated_<name>``; without it, a $collect of more values than the cap fails when it is run.
    """
    done = Outcome(frame.df)
    order: list[Column] | None = None
    for i, stage in enumerate(stages):
        if stage.name == "$match":
            frame = Frame(frame.df.filter(compile_filter(stage.spec, frame)), frame.root, frame.bound)
        elif stage.name == "$group":
            key, made = stage.spec
            frame, row_order, order = Frame(group(frame, key, made, mark_truncated)), [], None
            done.groups = frame.df
            done.collected = [n for n, a in made.items() if a.op == "$collect"]
        elif stage.name == "$sort":
            order = order_columns(frame, stage.spec, row_order)
            frame = Frame(frame.df.orderBy(*order) if order else frame.df, frame.root, frame.bound)
        else:
            if order is None and row_order:
                order = order_columns(frame, [], row_order)
                frame = Frame(frame.df.orderBy(*order), frame.root, frame.bound)
            cut = frame.df.limit(stage.spec) if stage.name == "$limit" else frame.df.offset(stage.spec)
            later = any(s.name in ("$limit", "$skip") for s in stages[i + 1 :])
            frame = Frame(cut.orderBy(*order) if order and later and stage.name == "$limit" else cut, frame.root, frame.bound)
    done.df = frame.df
    return done


@dataclass(frozen=True)
class _Key:
    """A part of a group key: what to group by, and how the value is found again from it."""

    column: Column
    recover: Callable[[Column], Column] = lambda c: c


def _key_part(f: Field) -> _Key:
    """Typed values are grouped as they are; schemaless ones by their canonical text."""
    return _Key(f.column) if isinstance(f, Typed) else _Key(f.key, value_of_key)


def _constant(v: object) -> _Key:
    """A literal in the place of a path: one group, under this value."""
    literal = F.lit(v) if v is None or isinstance(v, (str, int, float, bool)) else F.parse_json(F.lit(json.dumps(v)))
    return _Key(F.lit(0), lambda _: literal)


def group(frame: Frame, key: object, made: dict[str, Accumulator], mark_truncated: bool = False) -> DataFrame:
    """``_id`` and the accumulators of each group; partial results are combined before the shuffle.

    ``_id``: null (one group of all rows, none if there are no rows), a path, an object of aliases and paths (or literals),
    or a literal. Missing and null are one group.
    """
    compound = isinstance(key, dict)
    if compound:
        parts = {a: _key_part(frame.field(p)) if isinstance(p, str) else _constant(p) for a, p in sorted(key.items())}
    else:
        parts = {"_id": _key_part(frame.field(key)) if isinstance(key, str) else _constant(key)}
    keys = {f"k{i}": p.column for i, p in enumerate(parts.values())} or {"k0": F.lit(0)}
    plain = {n: a for n, a in made.items() if a.op != "$collect"}
    columns = [_accumulate(frame, a).alias(f"a{i}") for i, a in enumerate(plain.values())]
    grouped = frame.df.groupBy(*(c.alias(n) for n, c in keys.items())).agg(*(columns or [F.count(F.lit(1)).alias("rows")]))
    out = {n: F.col(f"a{i}") for i, n in enumerate(plain)}
    flags, collects = {}, {n: a for n, a in made.items() if a.op == "$collect"}
    if collects:
        lists = _collected(frame, keys, [frame.field(a.path) for a in collects.values()])
        grouped = grouped.join(lists, [F.col(n).eqNullSafe(F.col(f"j{n}")) for n in keys], "left")
    for i, name in enumerate(collects):
        cut = F.coalesce(F.col(f"n{i}") > COLLECT_CAP, F.lit(False))
        kept = F.coalesce(F.col(f"c{i}"), F.array())
        refused = F.raise_error(F.lit(f"$collect of {name!r} has more than {COLLECT_CAP} values in a group; mark_truncated keeps the smallest and marks the cut"))
        out[name] = kept if mark_truncated else F.when(cut, refused).otherwise(kept)
        flags[f"_truncated_{name}"] = cut
    if compound:
        ids = F.struct(*(p.recover(F.col(n)).alias(a) for n, (a, p) in zip(keys, parts.items(), strict=False)))
    else:
        ids = parts["_id"].recover(F.col("k0"))
    wanted = {n: out[n] for n in made} | (flags if mark_truncated else {})
    return grouped.select(ids.alias("_id"), *(c.alias(n) for n, c in wanted.items()))


def _accumulate(frame: Frame, a: Accumulator) -> Column:
    if a.op == "$count":
        return F.count(F.lit(1))
    f = frame.field(a.path)
    if a.op == "$sum":
        return _finite(F.coalesce(F.sum(f.number), F.lit(0.0)))
    if a.op == "$avg":
        return _finite(F.avg(f.number))
    value, order = f.ranked
    if isinstance(f, Typed) and order is value:
        return F.min(value) if a.op == "$min" else F.max(value)
    return (F.min_by if a.op == "$min" else F.max_by)(value, order)


def _finite(c: Column) -> Column:
    """Null instead of an infinite or undefined number, which JSON can't say."""
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def _collected(frame: Frame, keys: dict[str, Column], fields: list[Field]) -> DataFrame:
    """For each group and field, ``c<i>``: its different values, sorted, at most COLLECT_CAP; and ``n<i>``: how many there are.

    All fields are read in one scan. Values are made different by a hash aggregation that combines in the map tasks, can
    spill and spreads the values of a group over all tasks. Each of these keeps only its share's smallest of a group (the
    window's group limit), so the task of a group gets at most COLLECT_CAP values from each, however many the group has.
    """
    typed = [isinstance(f, Typed) for f in fields]
    values = [f.column if t else F.coalesce(f.key, F.when(f.present, F.lit("null"))) for f, t in zip(fields, typed, strict=True)]
    own, which = [f"j{n}" for n in keys], [f"v{i}" for i in range(len(fields))]
    df = frame.df.select(*(c.alias(f"j{n}") for n, c in keys.items()), *(v.alias(n) for v, n in zip(values, which, strict=True)))
    if len(fields) == 1:
        rows, sets = df.filter(F.col("v0").isNotNull()).select(*own, F.lit(0).alias("of"), "v0"), own
    else:
        none = {n: F.lit(None).cast(df.schema[n].dataType) for n in which}
        each = [F.when(F.col(n).isNotNull(), F.struct(F.lit(i).alias("of"), *((F.col(n) if m == n else none[m]).alias(m) for m in which))) for i, n in enumerate(which)]
        rows, sets = df.select(*own, F.inline(F.array_compact(F.array(*each)))), [*own, "of"]
    different = rows.distinct()
    order = [k for n, t, f in zip(which, typed, fields, strict=True) for k in (Typed(F.col(n), f.kind).sort_keys if t else Schemaless(value_of_key(F.col(n))).sort_keys)]
    nth = F.row_number().over(Window.partitionBy(*sets).orderBy(*order, *(F.col(n) for n, t in zip(which, typed, strict=True) if not t)))
    few = different.withColumn("nth", nth).filter(F.col("nth") <= COLLECT_CAP)
    lists = few.groupBy(*own).agg(*(F.array_sort(F.collect_list(F.when(F.col("of") == i, F.struct("nth", n)))).alias(f"c{i}") for i, n in enumerate(which)))
    back = [_members(f"c{i}", n, t).alias(f"c{i}") for i, (n, t) in enumerate(zip(which, typed, strict=True))]
    counts = different.groupBy(*(F.col(n).alias(f"{n}_") for n in own)).agg(*(F.count_if(F.col("of") == i).alias(f"n{i}") for i in range(len(fields))))
    return lists.select(*own, *back).join(counts, [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in own]).drop(*(f"{n}_" for n in own))


def _members(array: str, name: str, typed: bool) -> Column:
    """A member of each struct of an array; as the value whose key it is, if it isn't ``typed``."""
    return F.transform(array, lambda x: x[name] if typed else value_of_key(x[name]))
