"""The filter language in plain Python over JSON documents: the meaning that the compiled one must have."""

from __future__ import annotations

import re

EPSILON = 2.0**-52
MISSING = object()


def at(document, path):
    for name in path.split("."):
        if not isinstance(document, dict) or name not in document:
            return MISSING
        document = document[name]
    return document


def kind(v):
    if v is None:
        return "null"
    return {bool: "bool", int: "number", float: "number", str: "string", list: "array", dict: "object"}[type(v)]


def deep(a, b):
    if type(a) is not type(b):
        return False
    if isinstance(a, list):
        return len(a) == len(b) and all(map(deep, a, b))
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(deep(a[k], b[k]) for k in a)
    return a == b


def equal(a, b):
    if kind(a) == kind(b) == "number":
        return abs(float(a) - float(b)) < EPSILON
    return deep(a, b)


def ordered(op, a, b):
    if kind(a) != kind(b) or kind(a) not in ("number", "string", "bool"):
        return False
    a, b = (x.encode() if isinstance(x, str) else x for x in (a, b))
    return {"$gt": a > b, "$gte": a >= b, "$lt": a < b, "$lte": a <= b}[op]


def test(v, op, operand):
    if op == "$exists":
        return (v is not MISSING) == (operand is not False)
    if v is MISSING:
        return False
    if op == "$eq":
        return equal(v, operand)
    if op == "$ne":
        return not equal(v, operand)
    if op == "$in":
        return isinstance(operand, list) and any(equal(v, x) for x in operand)
    if op == "$nin":
        return not isinstance(operand, list) or not any(equal(v, x) for x in operand)
    if op == "$regex":
        return isinstance(v, str) and isinstance(operand, str) and re.search(operand, v) is not None
    if op == "$contains":
        return isinstance(v, list) and any(equal(x, operand) for x in v)
    return ordered(op, v, operand)


def matches(spec, document):
    def part(key, value):
        if key == "$and":
            return all(matches(x, document) for x in value)
        if key == "$or":
            return any(matches(x, document) for x in value)
        if key == "$not":
            return not matches(value, document)
        tests = value.items() if isinstance(value, dict) else [("$eq", value)]
        return all(test(at(document, key), op, operand) for op, operand in tests)

    return all(part(k, v) for k, v in spec.items())
