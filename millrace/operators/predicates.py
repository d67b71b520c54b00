"""Query documents ($match, find) compiled to one boolean Column.

Under a negation every predicate is two-valued: null never escapes, so negations
keep rows with missing fields as the language asks. Elsewhere (``positive``) a
plain comparison stays bare, since a filter drops null anyway and only bare
comparisons are pushed down to the scan. Comparisons are type-bracketed; on arrays
they hold if any element satisfies them.
"""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import CODES, Compiler, ExpressionError, literal, pattern_of, type_name
from ..functions.paths import DATES, FLOATING, NUMERIC, column_at, step_into, type_at
from . import jsonschema, search


def sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _bracket(value, kind: T.DataType | None) -> bool:
    """Whether a constant and a column are of one comparison bracket."""
    if kind is None:
        return False
    if isinstance(value, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return isinstance(kind, NUMERIC)
    if isinstance(value, str):
        return isinstance(kind, T.StringType)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return isinstance(kind, DATES)
    if isinstance(value, (list, tuple)):
        return isinstance(kind, T.ArrayType)
    if isinstance(value, dict):
        return isinstance(kind, T.StructType)
    return isinstance(value, (bytes, bytearray)) and isinstance(kind, T.BinaryType)


def _any(c: Column, kind: T.DataType | None, test, positive: bool = False) -> Column:
    """``test`` on the value, or on any element of an array (one level)."""
    if isinstance(kind, T.ArrayType):
        return sure(F.exists(c, lambda x: sure(test(x, kind.elementType))))
    return test(c, kind) if positive else sure(test(c, kind))


def _equal(c: Column, kind: T.DataType | None, value, positive: bool = False) -> Column:
    if value is None:
        here = c.isNull()
        return here | sure(F.exists(c, lambda x: x.isNull())) if isinstance(kind, T.ArrayType) else here
    if isinstance(value, re.Pattern):
        return _matches(c, kind, pattern_of(value))
    whole = sure(c == literal(value)) if isinstance(value, (list, tuple)) and isinstance(kind, T.ArrayType) and value else F.lit(False)
    return whole | _any(c, kind, lambda x, t: x == literal(value) if _bracket(value, t) else F.lit(False), positive)


def _matches(c: Column, kind, pattern: str) -> Column:
    return _any(c, kind, lambda x, t: F.regexp_like(x, F.lit(pattern)) if isinstance(t, T.StringType) else F.lit(False))


def _range(op: str, value):
    def test(x: Column, t):
        if value is None:
            return x.isNull() if "=" in op else F.lit(False)
        if not _bracket(value, t):
            return F.lit(False)
        v = literal(value)
        out = {">": x > v, ">=": x >= v, "<": x < v, "<=": x <= v}[op]
        return out & ~F.isnan(x) if isinstance(t, FLOATING) else out  # NaN is in no range

    return test


_RANGES = {"$gt": ">", "$gte": ">=", "$lt": "<", "$lte": "<="}


def _mask(value) -> int:
    if isinstance(value, (list, tuple)):
        return sum(1 << p for p in set(value))
    if isinstance(value, (bytes, bytearray)):
        return int.from_bytes(value, "little")
    return int(value)


def _bits(op: str, value):
    m = _mask(value)

    def test(x: Column, t):
        if not isinstance(t, NUMERIC):
            return F.lit(False)
        got = x.cast("long").bitwiseAND(F.lit(m))
        out = {"$bitsAllSet": got == m, "$bitsAllClear": got == 0, "$bitsAnySet": got != 0, "$bitsAnyClear": got != m}[op]
        return out & (x.cast("long") == x)

    return test


def _type_test(value):
    names = {CODES.get(v, v) for v in (value if isinstance(value, (list, tuple)) else [value])}
    if "number" in names:
        names |= {"int", "long", "double", "decimal"}

    def test(x: Column, t):
        name = type_name(t)
        return x.isNotNull() if name in names or (name == "binData" and "objectId" in names) else x.isNull() if "null" in names else F.lit(False)

    return names, test


def operator_test(df: DataFrame, c: Column, kind: T.DataType | None, op: str, value, around: dict, positive: bool = False) -> Column:
    """One operator on one value."""
    if op == "$eq":
        return _equal(c, kind, value, positive)
    if op == "$ne":
        return ~_equal(c, kind, value)
    if op in _RANGES:
        whole = _range(_RANGES[op], value)
        return sure(whole(c, kind)) if isinstance(value, (list, tuple)) else _any(c, kind, whole, positive)
    if op in ("$ngt", "$ngte", "$nlt", "$nlte"):
        return ~operator_test(df, c, kind, "$" + op[2:], value, around)
    if op == "$in":
        out = F.lit(False)
        plain = [v for v in value if v is not None and not isinstance(v, (re.Pattern, list, tuple, dict))]
        own = kind.elementType if isinstance(kind, T.ArrayType) else kind
        same = [v for v in plain if _bracket(v, own)]
        if same:  # one IN, which reaches the scan
            out = sure(F.exists(c, lambda x: x.isin(same))) if isinstance(kind, T.ArrayType) else c.isin(same) if positive else sure(c.isin(same))
        for v in value:
            if v is None or isinstance(v, (re.Pattern, list, tuple, dict)):
                out = out | _equal(c, kind, v)
        return out
    if op == "$nin":
        return ~operator_test(df, c, kind, "$in", value, around)
    if op == "$not":
        if isinstance(value, re.Pattern):
            return ~_equal(c, kind, value)
        return ~field_test(df, c, kind, value)
    if op == "$regex":
        return _matches(c, kind, pattern_of(value, around.get("$options")))
    if op in ("$options", "$comment", "$maxDistance", "$minDistance"):
        return F.lit(True)
    if op == "$exists":
        return c.isNotNull() if bool(value) else c.isNull()
    if op == "$type":
        names, test = _type_test(value)
        whole = c.isNotNull() if isinstance(kind, T.ArrayType) and "array" in names else F.lit(False)
        return whole | _any(c, kind, test)
    if op == "$size":
        return sure(F.size(c) == value) if isinstance(kind, T.ArrayType) else F.lit(False)
    if op == "$all":
        if not value:
            return F.lit(False)
        out = F.lit(True)
        for v in value:
            out = out & (operator_test(df, c, kind, "$elemMatch", v["$elemMatch"], {}) if isinstance(v, dict) and "$elemMatch" in v else _equal(c, kind, v))
        return out
    if op == "$elemMatch":
        if not isinstance(kind, T.ArrayType):
            return F.lit(False)
        return sure(F.exists(c, lambda x: element_test(df, x, kind.elementType, value)))
    if op == "$mod":
        d, r = value
        return _any(c, kind, lambda x, t: (x.cast("long") % d == r) if isinstance(t, NUMERIC) else F.lit(False))
    if op.startswith("$bits"):
        return _any(c, kind, _bits(op, value))
    if op in ("$geoWithin", "$within"):
        return search.within(c, kind, value)
    if op == "$geoIntersects":
        return search.intersects(c, kind, value)
    if op in ("$near", "$nearSphere", "$geoNear"):
        return search.near_filter(c, kind, op, value, around)
    raise ExpressionError(f"unknown query operator {op}")


def element_test(df: DataFrame, x: Column, kind: T.DataType, query: dict) -> Column:
    """A query on an array's element: operators on it, or fields of a document."""
    if all(k.startswith("$") and k not in ("$and", "$or", "$nor") for k in query):
        return field_test(df, x, kind, query)
    out = F.lit(True)
    for path, v in query.items():
        if path in ("$and", "$or", "$nor"):
            out = out & _joined(path, [element_test(df, x, kind, q) for q in v])
            continue
        found = type_at(kind, path.split("."))
        c = step_into(x, kind, path.split(".")) if found is not None else F.lit(None)
        out = out & field_test(df, c, found, v)
    return out


def field_test(df: DataFrame, c: Column, kind: T.DataType | None, value, positive: bool = False) -> Column:
    if isinstance(value, dict) and value and all(k.startswith("$") for k in value):
        out = F.lit(True)
        for op, v in value.items():
            out = out & operator_test(df, c, kind, op, v, value, positive)
        return out
    return _equal(c, kind, value, positive)


def _joined(op: str, tests: list[Column]) -> Column:
    if not tests:
        raise ExpressionError(f"{op} needs a condition")
    out = tests[0]
    for t in tests[1:]:
        out = out & t if op == "$and" else out | t
    return ~out if op == "$nor" else out


def compile_query(df: DataFrame, query: dict, variables: dict | None = None, positive: bool = False) -> Column:
    """A whole query document as a Column; ``positive`` if it goes into a filter as it is."""
    out = None
    for key, value in query.items():
        if key in ("$and", "$or", "$nor"):
            test = _joined(key, [compile_query(df, q, variables, positive and key != "$nor") for q in value])
        elif key == "$expr":
            test = Compiler(df, variables).truth(value)
        elif key == "$alwaysTrue":
            test = F.lit(True)
        elif key == "$alwaysFalse":
            test = F.lit(False)
        elif key == "$sampleRate":
            test = F.rand() < float(value)
        elif key == "$jsonSchema":
            test = jsonschema.valid(df, value)
        elif key == "$text":
            test = search.text_filter(df, value)
        elif key == "$comment":
            continue
        elif key.startswith("$"):
            raise ExpressionError(f"unknown query operator {key}")
        else:
            c, kind = column_at(df, key)
            if kind is not None and "." in key and isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType):
                c, kind = F.flatten(c), kind.elementType
            test = field_test(df, c, kind, value, positive)
        out = test if out is None else out & test
    return F.lit(True) if out is None else out
