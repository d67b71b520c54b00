"""Aggregation expressions compiled to Columns.

``Compiler(df).column(spec)`` turns an expression in its usual dictionary form
into one Column, so that Catalyst sees the whole of it. Operators are methods
of one registry, by name. ``Compiler.kind(spec)`` tells an expression's type
by analysis alone (no job runs); inside lambdas it probes with a typed null.
"""

from __future__ import annotations

import datetime
import decimal
import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .paths import DATES, FLOATING, NUMERIC, column_at, step_into, type_at

OPERATORS: dict[str, Callable] = {}
#: Marks a field that an assignment removes.
REMOVE = object()


class ExpressionError(ValueError):
    """An expression that the language doesn't allow."""


def operator(*names: str):
    def keep(f):
        for n in names:
            OPERATORS[n] = f
        return f

    return keep


def literal(value) -> Column:
    """A constant as a Column: documents become structs, lists arrays."""
    if isinstance(value, dict):
        return F.struct(*(literal(v).alias(k) for k, v in value.items())) if value else F.struct()
    if isinstance(value, (list, tuple)):
        return F.array(*map(literal, value))
    if isinstance(value, re.Pattern):
        return F.lit(value.pattern)
    return F.lit(value)


class Compiler:
    """Compiles expressions against the columns of one DataFrame."""

    def __init__(self, df: DataFrame, variables: dict[str, tuple[Column, T.DataType | None]] | None = None, probe: bool = False):
        self.df, self.variables, self.probe = df, variables or {}, probe

    def bind(self, **variables: tuple[Column, T.DataType | None]) -> Compiler:
        return Compiler(self.df, self.variables | variables, self.probe)

    def kind(self, spec) -> T.DataType:
        """The type of an expression."""
        typed = {k: (F.lit(None).cast(t) if t is not None else F.lit(None), t) for k, (_, t) in self.variables.items()}
        return self.df.select(Compiler(self.df, typed, True).column(spec).alias("x")).schema["x"].dataType

    def column(self, spec) -> Column:
        if isinstance(spec, Column):
            return spec
        if isinstance(spec, str) and spec.startswith("$$"):
            return self._variable(spec[2:])
        if isinstance(spec, str) and spec.startswith("$"):
            return column_at(self.df, spec[1:])[0]
        if isinstance(spec, (list, tuple)):
            return F.array(*map(self.column, spec))
        if isinstance(spec, dict):
            ops = [k for k in spec if k.startswith("$")]
            if not ops:
                return F.struct(*(self.column(v).alias(k) for k, v in spec.items() if v != "$$REMOVE"))
            if len(spec) != 1:
                raise ExpressionError(f"an expression has one operator: {list(spec)}")
            if ops[0] not in OPERATORS:
                raise ExpressionError(f"unknown expression operator {ops[0]}")
            return OPERATORS[ops[0]](self, spec[ops[0]])
        return literal(spec)

    def _variable(self, name: str) -> Column:
        head, _, rest = name.partition(".")
        if head in ("ROOT", "CURRENT"):
            return column_at(self.df, rest)[0] if rest else F.struct(*(F.col(f"`{c}`") for c in self.df.columns))
        if head in ("NOW", "CLUSTER_TIME"):
            return F.current_timestamp()
        if head == "REMOVE":
            return F.lit(None)
        if head in ("KEEP", "PRUNE", "DESCEND"):
            return F.lit(f"$${head}")
        if head == "USER_ROLES":
            return F.array().cast("array<string>")
        if head == "SEARCH_META":
            return F.struct(F.lit(None).cast("long").alias("count"))
        if head not in self.variables:
            raise ExpressionError(f"undefined variable {head}")
        c, kind = self.variables[head]
        if not rest:
            return c
        if kind is None or type_at(kind, rest.split(".")) is None:
            return F.lit(None)
        return step_into(c, kind, rest.split("."))

    def args(self, spec, low: int = 1, high: int | None = None) -> list[Column]:
        return [self.column(x) for x in self.specs(spec, low, high)]

    def specs(self, spec, low: int = 1, high: int | None = None) -> list:
        out = list(spec) if isinstance(spec, (list, tuple)) else [spec]
        if len(out) < low or (high is not None and len(out) > high):
            raise ExpressionError(f"{low} to {high or 'any number of'} arguments expected, not {len(out)}")
        return out

    def truth(self, spec) -> Column:
        """Null and zero are false, everything else is true."""
        c, kind = self.column(spec), self.kind(spec)
        if isinstance(kind, T.BooleanType):
            return F.coalesce(c, F.lit(False))
        if isinstance(kind, NUMERIC):
            return F.coalesce(c != 0, F.lit(False))
        return c.isNotNull()

    def element_kind(self, spec) -> T.DataType | None:
        kind = self.kind(spec)
        return kind.elementType if isinstance(kind, T.ArrayType) else None


def fail(message: str, kind: str = "string") -> Column:
    return F.raise_error(F.lit(message)).cast(kind)


# arithmetic


def millis(c: Column) -> Column:
    """Milliseconds of any date, with or without a time zone."""
    return F.unix_millis(c.cast("timestamp"))


@operator("$add")
def _add(k: Compiler, spec) -> Column:
    specs = k.specs(spec, 0)
    dated = [s for s in specs if isinstance(k.kind(s), DATES)]
    if len(dated) > 1:
        raise ExpressionError("$add takes one date at most")
    if dated:
        total = sum((k.column(s) for s in specs if s is not dated[0]), F.lit(0))
        return F.timestamp_millis((millis(k.column(dated[0])) + total).cast("long"))
    cols = [k.column(s) for s in specs]
    return sum(cols[1:], cols[0]) if cols else F.lit(0)


@operator("$subtract")
def _subtract(k: Compiler, spec) -> Column:
    a, b = k.specs(spec, 2, 2)
    ca, cb = k.column(a), k.column(b)
    if isinstance(k.kind(a), DATES):
        if isinstance(k.kind(b), DATES):
            return millis(ca) - millis(cb)
        return F.timestamp_millis((millis(ca) - cb).cast("long"))
    return ca - cb


@operator("$multiply")
def _multiply(k: Compiler, spec) -> Column:
    cols = k.args(spec, 0)
    out = cols[0] if cols else F.lit(1)
    for c in cols[1:]:
        out = out * c
    return out


@operator("$divide")
def _divide(k: Compiler, spec) -> Column:
    a, b = k.args(spec, 2, 2)
    return F.when(b == 0, fail("can't $divide by zero", "double")).otherwise(a.cast("double") / b.cast("double"))


@operator("$mod")
def _mod(k: Compiler, spec) -> Column:
    a, b = k.args(spec, 2, 2)
    return F.when(b == 0, fail("can't $mod by zero", "double")).otherwise(a % b)


@operator("$pow")
def _pow(k: Compiler, spec) -> Column:
    a, b = k.specs(spec, 2, 2)
    out = F.pow(k.column(a), k.column(b))
    whole = (T.IntegerType, T.LongType)
    return out.cast("long") if isinstance(k.kind(a), whole) and isinstance(k.kind(b), whole) and isinstance(b, int) and b >= 0 else out


@operator("$round")
def _round(k: Compiler, spec) -> Column:
    specs = k.specs(spec, 1, 2)
    place = specs[1] if len(specs) > 1 else 0
    if not isinstance(place, int):
        raise ExpressionError("$round takes a constant place")
    return F.bround(k.column(specs[0]), place)


@operator("$trunc")
def _trunc(k: Compiler, spec) -> Column:
    specs = k.specs(spec, 1, 2)
    scale = F.pow(F.lit(10.0), k.column(specs[1]) if len(specs) > 1 else F.lit(0))
    c, kind = k.column(specs[0]), k.kind(specs[0])
    out = F.when(c >= 0, F.floor(c * scale)).otherwise(F.ceil(c * scale)) / scale
    return out.cast(kind) if isinstance(kind, NUMERIC) else out


@operator("$log")
def _log(k: Compiler, spec) -> Column:
    a, b = k.args(spec, 2, 2)
    return F.ln(a) / F.ln(b)


def _plain(name: str, f: Callable[[Column], Column], domain: Callable[[Column], Column] | None = None) -> None:
    def run(k: Compiler, spec) -> Column:
        (c,) = k.args(spec, 1, 1)
        return f(c) if domain is None else F.when(domain(c), f(c)).when(c.isNotNull(), fail(f"{name}: argument out of range", "double"))

    OPERATORS[name] = run


for _name, _f in {"$abs": F.abs, "$ceil": F.ceil, "$floor": F.floor, "$exp": F.exp, "$sin": F.sin, "$cos": F.cos, "$tan": F.tan, "$sinh": F.sinh, "$cosh": F.cosh, "$tanh": F.tanh, "$atan": F.atan, "$asinh": F.asinh, "$degreesToRadians": F.radians, "$radiansToDegrees": F.degrees}.items():
    _plain(_name, _f)
for _name, _f, _d in (
    ("$sqrt", F.sqrt, lambda c: c >= 0),
    ("$ln", F.ln, lambda c: c > 0),
    ("$log10", F.log10, lambda c: c > 0),
    ("$asin", F.asin, lambda c: c.between(-1, 1)),
    ("$acos", F.acos, lambda c: c.between(-1, 1)),
    ("$acosh", F.acosh, lambda c: c >= 1),
    ("$atanh", F.atanh, lambda c: c.between(-1, 1)),
):
    _plain(_name, _f, _d)


@operator("$atan2")
def _atan2(k: Compiler, spec) -> Column:
    return F.atan2(*k.args(spec, 2, 2))


def _numbers(k: Compiler, spec) -> Column:
    """The numeric values of an array expression or of several arguments, as doubles or longs."""
    specs = k.specs(spec)
    if len(specs) == 1 and isinstance(k.kind(specs[0]), T.ArrayType):
        values = k.column(specs[0]) if isinstance(k.element_kind(specs[0]), NUMERIC) else F.array().cast("array<double>")
    else:
        values = F.array(*(k.column(s) for s in specs if isinstance(k.kind(s), NUMERIC)))
    return F.filter(values, lambda x: x.isNotNull())


def _folded(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


@operator("$sum")
def _sum(k: Compiler, spec) -> Column:
    v, specs = _numbers(k, spec), k.specs(spec)
    kinds = [k.element_kind(specs[0])] if len(specs) == 1 and isinstance(k.kind(specs[0]), T.ArrayType) else [k.kind(s) for s in specs]
    kinds = [t for t in kinds if isinstance(t, NUMERIC)]
    if kinds and all(isinstance(t, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)) for t in kinds):
        return F.aggregate(v, F.lit(0).cast("long"), lambda s, x: s + x)
    return _folded(v)


@operator("$avg")
def _avg(k: Compiler, spec) -> Column:
    v = _numbers(k, spec)
    return F.when(F.size(v) > 0, _folded(v) / F.size(v))


def _deviation(v: Column, less: int) -> Column:
    mean = _folded(v) / F.size(v)
    return F.when(F.size(v) > less, F.sqrt(F.aggregate(F.transform(v, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda s, x: s + x) / (F.size(v) - less)))


@operator("$stdDevPop")
def _std_pop(k: Compiler, spec) -> Column:
    return _deviation(_numbers(k, spec), 0)


@operator("$stdDevSamp")
def _std_samp(k: Compiler, spec) -> Column:
    return _deviation(_numbers(k, spec), 1)


def _values(k: Compiler, spec) -> Column:
    specs = k.specs(spec)
    if len(specs) == 1 and isinstance(k.kind(specs[0]), T.ArrayType):
        return k.column(specs[0])
    return F.array(*map(k.column, specs))


@operator("$max")
def _max(k: Compiler, spec) -> Column:
    return F.array_max(_values(k, spec))


@operator("$min")
def _min(k: Compiler, spec) -> Column:
    return F.array_min(_values(k, spec))


@operator("$median")
def _median(k: Compiler, spec) -> Column:
    return _percentiles(k, {"input": spec["input"], "p": [0.5]})[0]


@operator("$percentile")
def _percentiles(k: Compiler, spec) -> Column:
    """Observed values at ranks ceil(p * n), as the digest returns them for few values."""
    v = F.array_sort(_numbers(k, spec["input"]).cast("array<double>"))
    return F.array(*(F.get(v, F.greatest(F.ceil(F.lit(float(p)) * F.size(v)) - 1, F.lit(0)).cast("int")) for p in spec["p"]))


# bits


def _bits(name: str, f: Callable[[Column, Column], Column], start: int) -> None:
    def run(k: Compiler, spec) -> Column:
        specs = k.specs(spec, 0)
        for s in specs:
            if not isinstance(k.kind(s), (T.IntegerType, T.LongType, T.NullType)):
                raise ExpressionError(f"{name} takes int and long only")
        out = F.lit(start) if not specs else k.column(specs[0])
        for s in specs[1:]:
            out = f(out, k.column(s))
        return out

    OPERATORS[name] = run


_bits("$bitAnd", lambda a, b: a.bitwiseAND(b), -1)
_bits("$bitOr", lambda a, b: a.bitwiseOR(b), 0)
_bits("$bitXor", lambda a, b: a.bitwiseXOR(b), 0)


@operator("$bitNot")
def _bit_not(k: Compiler, spec) -> Column:
    return F.bitwise_not(k.args(spec, 1, 1)[0])


# strings


@operator("$concat")
def _concat(k: Compiler, spec) -> Column:
    return F.concat(*k.args(spec, 0))


def _index(of: Callable[[Column], Column]):
    def run(k: Compiler, spec) -> Column:
        cols = k.args(spec, 2, 4)
        s, part = cols[0], cols[1]
        start = cols[2] if len(cols) > 2 else F.lit(0)
        cut = F.substring(s, F.lit(1), cols[3].cast("int")) if len(cols) > 3 else s
        if len(cols) > 2:
            rest = F.substring(cut, (start + 1).cast("int"), F.length(cut))
            hit = F.position(part, rest)
            at = F.when(hit > 0, hit + start).otherwise(F.lit(0))
        else:
            at = F.position(part, cut)
        return F.when(s.isNotNull(), F.when(at > 0, of(F.substring(cut, F.lit(1), (at - 1).cast("int")))).otherwise(F.lit(-1)))

    return run


OPERATORS["$indexOfCP"] = _index(F.length)
OPERATORS["$indexOfBytes"] = _index(F.octet_length)


def _trims(name: str, f) -> None:
    def run(k: Compiler, spec) -> Column:
        c = k.column(spec["input"])
        chars = k.column(spec["chars"]) if "chars" in spec else F.lit(" \t\n\x0b\x0c\r\x00\xa0            ")
        return f(c, chars)

    OPERATORS[name] = run


_trims("$trim", F.btrim)
_trims("$ltrim", F.ltrim)
_trims("$rtrim", F.rtrim)


def pattern_of(regex, options: str | None = None) -> str:
    """A regular expression and its options as one inline-flagged pattern."""
    if isinstance(regex, re.Pattern):
        options = (options or "") + "".join(c for c, f in (("i", re.I), ("m", re.M), ("s", re.S), ("x", re.X)) if regex.flags & f)
        regex = regex.pattern
    flags = "".join(sorted(set(options or "") & set("imsx")))
    return f"(?{flags}){regex}" if flags else regex


def _regex(k: Compiler, spec) -> tuple[Column, str]:
    if not isinstance(spec["regex"], (str, re.Pattern)):
        raise ExpressionError("a regular expression is constant")
    return k.column(spec["input"]), pattern_of(spec["regex"], spec.get("options"))


@operator("$regexMatch")
def _regex_match(k: Compiler, spec) -> Column:
    c, p = _regex(k, spec)
    return F.coalesce(F.regexp_like(c, F.lit(p)), F.lit(False))


def _found(c: Column, p: str, match: Column, start: Column) -> Column:
    groups = re.compile(p).groups
    captures = F.array(*(F.nullif(F.regexp_extract(match, p, i), F.lit("")) for i in range(1, groups + 1))) if groups else F.array().cast("array<string>")
    return F.struct(match.alias("match"), start.cast("int").alias("idx"), captures.alias("captures"))


@operator("$regexFind")
def _regex_find(k: Compiler, spec) -> Column:
    c, p = _regex(k, spec)
    match = F.regexp_substr(c, F.lit(p))
    return F.when(match.isNotNull(), _found(c, p, match, F.length(F.get(F.split(c, p, 2), F.lit(0)))))


@operator("$regexFindAll")
def _regex_find_all(k: Compiler, spec) -> Column:
    c, p = _regex(k, spec)
    gaps, hits = F.split(c, p, -1), F.regexp_extract_all(c, F.lit(p), F.lit(0))
    length = lambda xs, upto: F.aggregate(F.slice(xs, F.lit(1), upto), F.lit(0), lambda s, x: s + F.length(x))
    return F.transform(hits, lambda m, i: _found(c, p, m, length(gaps, i + 1) + length(hits, i)))


@operator("$replaceAll")
def _replace_all(k: Compiler, spec) -> Column:
    return F.replace(k.column(spec["input"]), k.column(spec["find"]), k.column(spec["replacement"]))


@operator("$replaceOne")
def _replace_one(k: Compiler, spec) -> Column:
    c, find, by = (k.column(spec[x]) for x in ("input", "find", "replacement"))
    at = F.position(find, c)
    return F.when(at > 0, F.overlay(c, by, at, F.length(find))).otherwise(c)


@operator("$split")
def _split(k: Compiler, spec) -> Column:
    a, b = k.specs(spec, 2, 2)
    if isinstance(b, str) and not b.startswith("$"):
        return F.split(k.column(a), re.escape(b), -1)
    return F.split(k.column(a), F.concat(F.lit("\\Q"), k.column(b), F.lit("\\E")), -1)


@operator("$strcasecmp")
def _strcasecmp(k: Compiler, spec) -> Column:
    a, b = (F.upper(F.coalesce(c, F.lit(""))) for c in k.args(spec, 2, 2))
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


@operator("$strLenCP")
def _strlen(k: Compiler, spec) -> Column:
    return F.length(k.args(spec, 1, 1)[0])


@operator("$strLenBytes")
def _strlen_bytes(k: Compiler, spec) -> Column:
    return F.octet_length(k.args(spec, 1, 1)[0])


@operator("$substrCP")
def _substr(k: Compiler, spec) -> Column:
    s, a, n = k.args(spec, 3, 3)
    return F.coalesce(F.substring(s, (a + 1).cast("int"), n.cast("int")), F.lit(""))


@operator("$substrBytes", "$substr")
def _substr_bytes(k: Compiler, spec) -> Column:
    s, a, n = k.args(spec, 3, 3)
    raw = F.encode(s, "UTF-8")
    n = F.when(n < 0, F.octet_length(s)).otherwise(n)
    return F.coalesce(F.decode(F.substring(raw, (a + 1).cast("int"), n.cast("int")), "UTF-8"), F.lit(""))


@operator("$toLower")
def _lower(k: Compiler, spec) -> Column:
    return F.coalesce(F.lower(k.args(spec, 1, 1)[0].cast("string")), F.lit(""))


@operator("$toUpper")
def _upper(k: Compiler, spec) -> Column:
    return F.coalesce(F.upper(k.args(spec, 1, 1)[0].cast("string")), F.lit(""))


# dates

UNITS = ("year", "quarter", "month", "week", "day", "hour", "minute", "second", "millisecond")


def _zoned(k: Compiler, c: Column, zone) -> Column:
    return c if zone is None else F.from_utc_timestamp(c, k.column(zone) if isinstance(zone, str) and zone.startswith("$") else F.lit(_zone(zone)))


def _zone(zone: str) -> str:
    return re.sub(r"^([+-]\d\d):?(\d\d)?$", lambda m: f"{m[1]}:{m[2] or '00'}", zone)


def _part(name: str, f: Callable[[Column], Column]) -> None:
    def run(k: Compiler, spec) -> Column:
        zone = None
        if isinstance(spec, dict) and "date" in spec:
            spec, zone = spec["date"], spec.get("timezone")
        (spec,) = k.specs(spec, 1, 1)
        return f(_zoned(k, k.column(spec), zone))

    OPERATORS[name] = run


def _week(c: Column) -> Column:
    """Sunday-first week of the year; days before the first Sunday are week 0."""
    return F.floor((F.dayofyear(c) + 7 - F.dayofweek(c)) / 7).cast("int")


def _iso_year(c: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), c)


PARTS = {
    "$year": F.year, "$month": F.month, "$dayOfMonth": F.dayofmonth, "$dayOfWeek": F.dayofweek, "$dayOfYear": F.dayofyear, "$hour": F.hour, "$minute": F.minute,
    "$second": lambda c: F.second(c), "$millisecond": lambda c: (F.unix_millis(c.cast("timestamp")) % 1000).cast("int"), "$isoWeek": F.weekofyear, "$isoWeekYear": _iso_year, "$isoDayOfWeek": lambda c: F.weekday(c) + 1, "$week": _week,
}
for _name, _f in PARTS.items():
    _part(_name, _f)


def _shifted(c: Column, unit: str, amount: Column) -> Column:
    n = amount.cast("int")
    months = {"year": 12, "quarter": 3, "month": 1}.get(unit)
    if months:
        return c + F.make_interval(months=n * months)
    millis = {"week": 604_800_000, "day": 86_400_000, "hour": 3_600_000, "minute": 60_000, "second": 1000, "millisecond": 1}[unit]
    return F.timestamp_micros(F.unix_micros(c) + amount.cast("long") * millis * 1000)


def _unit(spec: dict) -> str:
    if spec.get("unit") not in UNITS:
        raise ExpressionError(f"unknown date unit {spec.get('unit')}")
    return spec["unit"]


@operator("$dateAdd")
def _date_add(k: Compiler, spec) -> Column:
    return _shifted(k.column(spec["startDate"]).cast("timestamp"), _unit(spec), k.column(spec["amount"]))


@operator("$dateSubtract")
def _date_subtract(k: Compiler, spec) -> Column:
    return _shifted(k.column(spec["startDate"]).cast("timestamp"), _unit(spec), -k.column(spec["amount"]))


_DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def _floor(c: Column, unit: str, first_day: str | None = None) -> Column:
    if unit == "week":
        first = [d[:3] for d in _DAYS].index((first_day or "sunday").lower()[:3])
        day = F.date_trunc("day", c)
        return _shifted(day, "day", -((F.weekday(day) - first + 7) % 7))
    return F.date_trunc(unit, c)


@operator("$dateTrunc")
def _date_trunc(k: Compiler, spec) -> Column:
    unit, zone = _unit(spec), spec.get("timezone")
    c = _zoned(k, k.column(spec["date"]).cast("timestamp"), zone)
    size = spec.get("binSize", 1)
    if size == 1:
        out = _floor(c, unit, spec.get("startOfWeek"))
    elif unit in ("year", "quarter", "month"):
        months = {"year": 12, "quarter": 3, "month": 1}[unit] * size
        since = (F.year(c) - 2000) * 12 + F.month(c) - 1
        out = F.to_timestamp(F.lit("2000-01-01")) + F.make_interval(months=(F.floor(since / months) * months).cast("int"))
    else:
        millis = {"week": 604_800_000, "day": 86_400_000, "hour": 3_600_000, "minute": 60_000, "second": 1000, "millisecond": 1}[unit] * size
        origin = _floor(F.to_timestamp(F.lit("2000-01-01")), unit, spec.get("startOfWeek"))
        since = F.unix_millis(c) - F.unix_millis(origin)
        out = F.timestamp_millis(F.unix_millis(origin) + F.floor(since / millis) * millis)
    return out if zone is None else F.to_utc_timestamp(out, F.lit(_zone(zone)))


@operator("$dateDiff")
def _date_diff(k: Compiler, spec) -> Column:
    """Unit boundaries crossed: both ends are floored to the unit first."""
    unit = _unit(spec)
    a, b = (_floor(_zoned(k, k.column(spec[x]).cast("timestamp"), spec.get("timezone")), unit, spec.get("startOfWeek")) for x in ("startDate", "endDate"))
    months = {"year": 12, "quarter": 3, "month": 1}.get(unit)
    if months:
        return F.floor(((F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)) / months).cast("long")
    millis = {"week": 604_800_000, "day": 86_400_000, "hour": 3_600_000, "minute": 60_000, "second": 1000, "millisecond": 1}[unit]
    return F.round((F.unix_millis(b) - F.unix_millis(a)) / millis).cast("long")


@operator("$dateFromParts")
def _from_parts(k: Compiler, spec) -> Column:
    part = lambda name, default: k.column(spec.get(name, default)).cast("int")
    if "isoWeekYear" in spec:
        year = part("isoWeekYear", 1)
        fourth = F.make_date(year, F.lit(1), F.lit(4))
        monday = F.date_sub(fourth, F.weekday(fourth))
        start = F.date_add(monday, (part("isoWeek", 1) - 1) * 7 + part("isoDayOfWeek", 1) - 1).cast("timestamp")
    else:
        start = F.add_months(F.make_date(part("year", 1), F.lit(1), F.lit(1)), part("month", 1) - 1)
        start = F.date_add(start, part("day", 1) - 1).cast("timestamp")
    millis = part("hour", 0).cast("long") * 3_600_000 + part("minute", 0).cast("long") * 60_000 + part("second", 0).cast("long") * 1000 + part("millisecond", 0)
    out = F.timestamp_millis(F.unix_millis(start) + millis)
    return F.to_utc_timestamp(out, F.lit(_zone(spec["timezone"]))) if "timezone" in spec else out


@operator("$dateToParts")
def _to_parts(k: Compiler, spec) -> Column:
    c = _zoned(k, k.column(spec["date"]).cast("timestamp"), spec.get("timezone"))
    head = {"isoWeekYear": _iso_year(c), "isoWeek": F.weekofyear(c), "isoDayOfWeek": F.weekday(c) + 1} if spec.get("iso8601") else {"year": F.year(c), "month": F.month(c), "day": F.dayofmonth(c)}
    parts = head | {"hour": F.hour(c), "minute": F.minute(c), "second": F.second(c), "millisecond": PARTS["$millisecond"](c)}
    return F.when(c.isNotNull(), F.struct(*(v.cast("int").alias(n) for n, v in parts.items())))


#: Format specifiers of date strings: the Spark pattern for each.
_FORMAT = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "L": "SSS", "j": "DDD", "z": "xx", "b": "MMM", "B": "MMMM", "Z": "xx"}
DEFAULT_FORMAT = "%Y-%m-%dT%H:%M:%S.%LZ"


@operator("$dateToString")
def _to_string(k: Compiler, spec) -> Column:
    c = _zoned(k, k.column(spec["date"]).cast("timestamp"), spec.get("timezone"))
    computed = {"u": F.weekday(c) + 1, "w": F.dayofweek(c), "V": F.lpad(F.weekofyear(c).cast("string"), 2, "0"), "G": F.lpad(_iso_year(c).cast("string"), 4, "0"), "U": F.lpad(_week(c).cast("string"), 2, "0"), "%": F.lit("%")}
    pieces = []
    for m in re.finditer(r"%(.)|([^%]+)", spec.get("format", DEFAULT_FORMAT)):
        if m[2]:
            pieces.append(F.lit(m[2]))
        elif m[1] in _FORMAT:
            pieces.append(F.date_format(c, _FORMAT[m[1]]))
        elif m[1] in computed:
            pieces.append(computed[m[1]].cast("string"))
        else:
            raise ExpressionError(f"unknown date format %{m[1]}")
    out = F.concat(*pieces)
    return F.coalesce(out, k.column(spec["onNull"]).cast("string")) if "onNull" in spec else out


@operator("$dateFromString")
def _from_string(k: Compiler, spec) -> Column:
    s = k.column(spec["dateString"])
    if "format" in spec:
        fmt = "".join(_FORMAT[m[1]] if m[1] else f"'{m[2]}'" for m in re.finditer(r"%(.)|([^%]+)", spec["format"]))
        out = F.try_to_timestamp(s, F.lit(fmt))
    else:
        out = F.try_to_timestamp(s)
    if "timezone" in spec:
        out = F.to_utc_timestamp(out, F.lit(_zone(spec["timezone"])))
    wrong = k.column(spec["onError"]).cast("timestamp") if "onError" in spec else fail("a string is no date", "timestamp")
    return F.when(s.isNull(), k.column(spec["onNull"]).cast("timestamp") if "onNull" in spec else F.lit(None).cast("timestamp")).otherwise(F.coalesce(out, wrong))


@operator("$tsSecond")
def _ts_second(k: Compiler, spec) -> Column:
    return k.args(spec, 1, 1)[0].getField("t")


@operator("$tsIncrement")
def _ts_increment(k: Compiler, spec) -> Column:
    return k.args(spec, 1, 1)[0].getField("i")


# arrays


@operator("$arrayElemAt")
def _elem_at(k: Compiler, spec) -> Column:
    a, i = k.args(spec, 2, 2)
    return F.get(a, F.when(i < 0, F.size(a) + i).otherwise(i).cast("int"))


@operator("$arrayToObject")
def _array_to_object(k: Compiler, spec) -> Column:
    (spec,) = k.specs(spec, 1, 1) if not isinstance(spec, list) or len(spec) == 1 else (spec,)
    c, kind = k.column(spec), k.element_kind(spec)
    if isinstance(kind, T.StructType):
        return F.map_from_entries(F.transform(c, lambda x: F.struct(x["k"], x["v"])))
    return F.map_from_entries(F.transform(c, lambda x: F.struct(F.get(x, F.lit(0)), F.get(x, F.lit(1)))))


@operator("$objectToArray")
def _object_to_array(k: Compiler, spec) -> Column:
    (spec,) = k.specs(spec, 1, 1)
    c, kind = k.column(spec), k.kind(spec)
    if isinstance(kind, T.MapType):
        return F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
    same = len({f.dataType.simpleString() for f in kind.fields}) == 1
    return F.when(c.isNotNull(), F.array(*(F.struct(F.lit(f.name).alias("k"), (c[f.name] if same else c[f.name].cast("string")).alias("v")) for f in kind.fields)))


@operator("$concatArrays")
def _concat_arrays(k: Compiler, spec) -> Column:
    return F.concat(*k.args(spec))


@operator("$filter")
def _filter(k: Compiler, spec) -> Column:
    kind, name = k.element_kind(spec["input"]), spec.get("as", "this")
    out = F.filter(k.column(spec["input"]), lambda x: k.bind(**{name: (x, kind)}).truth(spec["cond"]))
    return F.slice(out, F.lit(1), k.column(spec["limit"]).cast("int")) if "limit" in spec else out


@operator("$map")
def _map(k: Compiler, spec) -> Column:
    kind, name = k.element_kind(spec["input"]), spec.get("as", "this")
    return F.transform(k.column(spec["input"]), lambda x: k.bind(**{name: (x, kind)}).column(spec["in"]))


def _mentions(spec, name: str) -> bool:
    """Whether an expression may read the variable ``name``."""
    if isinstance(spec, dict):
        return any(_mentions(x, name) for x in spec.values())
    if isinstance(spec, (list, tuple)):
        return any(_mentions(x, name) for x in spec)
    return isinstance(spec, str) and (spec == name or spec.startswith(name + "."))


def _appended(body) -> list | None:
    """What the body of a $reduce appends to a text, if that is all it does."""
    if not isinstance(body, dict) or list(body) != ["$concat"] or not isinstance(body["$concat"], (list, tuple)):
        return None
    head, *rest = body["$concat"] or [None]
    return rest if head == "$$value" and rest and not _mentions(rest, "$$value") else None


@operator("$reduce")
def _reduce(k: Compiler, spec) -> Column:
    kind, start = k.element_kind(spec["input"]), spec["initialValue"]
    first = k.kind(start)
    grown = k.bind(value=(F.lit(None), first), this=(F.lit(None), kind)).kind(spec["in"])  # the accumulator has the body's type
    rest = _appended(spec["in"])
    if rest and isinstance(first, T.StringType) and isinstance(grown, T.StringType):
        # text that grows by a piece an element is joined once: a fold would copy it for each element
        parts = F.transform(k.column(spec["input"]), lambda x: k.bind(value=(F.lit(None), first), this=(x, kind)).column({"$concat": rest}).cast(grown))
        return F.when(~F.exists(parts, lambda x: x.isNull()), F.concat(k.column(start), F.array_join(parts, "")))
    return F.aggregate(k.column(spec["input"]), k.column(start).cast(grown), lambda v, x: k.bind(value=(v, grown), this=(x, kind)).column(spec["in"]).cast(grown))


@operator("$first")
def _first(k: Compiler, spec) -> Column:
    return F.get(k.args(spec, 1, 1)[0], F.lit(0))


@operator("$last")
def _last(k: Compiler, spec) -> Column:
    c = k.args(spec, 1, 1)[0]
    return F.get(c, F.size(c) - 1)


@operator("$firstN")
def _first_n(k: Compiler, spec) -> Column:
    return F.slice(k.column(spec["input"]), F.lit(1), k.column(spec["n"]).cast("int"))


@operator("$lastN")
def _last_n(k: Compiler, spec) -> Column:
    c, n = k.column(spec["input"]), k.column(spec["n"]).cast("int")
    return F.slice(c, F.greatest(F.size(c) - n + 1, F.lit(1)), n)


@operator("$maxN")
def _max_n(k: Compiler, spec) -> Column:
    return F.slice(F.sort_array(F.array_compact(k.column(spec["input"])), asc=False), F.lit(1), k.column(spec["n"]).cast("int"))


@operator("$minN")
def _min_n(k: Compiler, spec) -> Column:
    return F.slice(F.array_sort(F.array_compact(k.column(spec["input"]))), F.lit(1), k.column(spec["n"]).cast("int"))


@operator("$in")
def _in(k: Compiler, spec) -> Column:
    e, a = k.args(spec, 2, 2)
    return F.exists(a, lambda x: x.eqNullSafe(e))


@operator("$indexOfArray")
def _index_of(k: Compiler, spec) -> Column:
    cols = k.args(spec, 2, 4)
    a, e = cols[0], cols[1]
    low = cols[2] if len(cols) > 2 else F.lit(0)
    high = cols[3] if len(cols) > 3 else F.size(a)
    hits = F.filter(F.transform(a, lambda x, i: F.when(x.eqNullSafe(e) & (i >= low) & (i < high), i)), lambda i: i.isNotNull())
    return F.when(a.isNotNull(), F.coalesce(F.get(hits, F.lit(0)), F.lit(-1)))


@operator("$isArray")
def _is_array(k: Compiler, spec) -> Column:
    (spec,) = spec if isinstance(spec, (list, tuple)) and len(spec) == 1 else (spec,)
    return F.coalesce(k.column(spec).isNotNull() & F.lit(isinstance(k.kind(spec), T.ArrayType)), F.lit(False))


@operator("$range")
def _range(k: Compiler, spec) -> Column:
    cols = [c.cast("int") for c in k.args(spec, 2, 3)]
    a, b, step = cols[0], cols[1], cols[2] if len(cols) > 2 else F.lit(1)
    some = F.when(step > 0, a < b).otherwise(a > b)
    return F.when(some, F.sequence(a, b - F.signum(step.cast("double")).cast("int"), step)).otherwise(F.array().cast("array<int>"))


@operator("$reverseArray")
def _reverse(k: Compiler, spec) -> Column:
    return F.reverse(k.args(spec, 1, 1)[0])


@operator("$size")
def _size(k: Compiler, spec) -> Column:
    c = k.args(spec, 1, 1)[0]
    return F.when(c.isNull(), fail("$size takes an array", "int")).otherwise(F.size(c))


def slice_of(c: Column, skip: Column | None, n: Column) -> Column:
    if skip is None:
        return F.when(n >= 0, F.slice(c, F.lit(1), F.abs(n))).otherwise(F.slice(c, F.greatest(F.size(c) + n + 1, F.lit(1)), F.abs(n)))
    at = F.when(skip < 0, F.greatest(F.size(c) + skip, F.lit(0))).otherwise(skip)
    return F.slice(c, at + 1, n)


@operator("$slice")
def _slice(k: Compiler, spec) -> Column:
    cols = k.args(spec, 2, 3)
    ints = [c.cast("int") for c in cols[1:]]
    return slice_of(cols[0], ints[0] if len(ints) == 2 else None, ints[-1])


def sort_elements(c: Column, kind: T.DataType | None, by) -> Column:
    """An array sorted by its elements (1, -1) or by fields of its documents."""
    if isinstance(by, int):
        return F.sort_array(c, asc=by > 0)

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for path, way in reversed(list(by.items())):
            x, y = (step_into(e, kind, path.split(".")) for e in (a, b))
            less = F.coalesce(x < y, x.isNull() & y.isNotNull())
            more = F.coalesce(x > y, x.isNotNull() & y.isNull())
            out = F.when(less, -way).when(more, way).otherwise(out)
        return out

    return F.array_sort(c, compare)


@operator("$sortArray")
def _sort_array(k: Compiler, spec) -> Column:
    return sort_elements(k.column(spec["input"]), k.element_kind(spec["input"]), spec["sortBy"])


@operator("$zip")
def _zip(k: Compiler, spec) -> Column:
    cols = [k.column(c) for c in spec["inputs"]]
    sizes = [F.size(c) for c in cols]
    n = (F.greatest if spec.get("useLongestLength") else F.least)(*sizes) if len(cols) > 1 else sizes[0]
    defaults = [k.column(d) for d in spec.get("defaults", [None] * len(cols))]
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array(*(F.when(i < s, F.get(c, i)).otherwise(d) for c, s, d in zip(cols, sizes, defaults, strict=True))))).otherwise(F.transform(F.slice(cols[0], F.lit(1), F.lit(0)), lambda x: F.array(x)))


@operator("$makeArray")
def _make_array(k: Compiler, spec) -> Column:
    return F.array(*k.args(spec, 0))


# sets: results are sorted, so that equal sets are equal arrays


@operator("$setUnion")
def _set_union(k: Compiler, spec) -> Column:
    cols = k.args(spec)
    out = F.array_distinct(cols[0])
    for c in cols[1:]:
        out = F.array_union(out, c)
    return F.array_sort(out)


@operator("$setIntersection")
def _set_intersection(k: Compiler, spec) -> Column:
    cols = k.args(spec)
    out = F.array_distinct(cols[0])
    for c in cols[1:]:
        out = F.array_intersect(out, c)
    return F.array_sort(out)


@operator("$setDifference")
def _set_difference(k: Compiler, spec) -> Column:
    return F.array_except(*k.args(spec, 2, 2))


@operator("$setEquals")
def _set_equals(k: Compiler, spec) -> Column:
    cols = [F.array_sort(F.array_distinct(c)) for c in k.args(spec, 2)]
    out = F.lit(True)
    for c in cols[1:]:
        out = out & (c == cols[0])
    return F.when(sum((c.isNull().cast("int") for c in cols), F.lit(0)) > 0, fail("$setEquals takes arrays", "boolean")).otherwise(out)


@operator("$setIsSubset")
def _set_subset(k: Compiler, spec) -> Column:
    a, b = k.args(spec, 2, 2)
    return F.size(F.array_except(a, b)) == 0


def _element_truth(k: Compiler, spec) -> tuple[Column, Callable[[Column], Column]]:
    (spec,) = spec if isinstance(spec, (list, tuple)) and len(spec) == 1 else (spec,)
    kind = k.element_kind(spec)
    return k.column(spec), lambda x: k.bind(element=(x, kind)).truth("$$element")


@operator("$anyElementTrue")
def _any_true(k: Compiler, spec) -> Column:
    return F.exists(*_element_truth(k, spec))


@operator("$allElementsTrue")
def _all_true(k: Compiler, spec) -> Column:
    return F.forall(*_element_truth(k, spec))


# comparison, boolean, conditional


def _less(a: Column, b: Column, floating: bool) -> Column:
    """Total order: null before everything, NaN before numbers."""
    if floating:
        a, b = (F.when(c.isNotNull(), F.struct(~F.isnan(c), c)) for c in (a, b))
    return F.coalesce(a < b, a.isNull() & b.isNotNull())


def _pair(k: Compiler, spec) -> tuple[Column, Column, bool]:
    a, b = k.specs(spec, 2, 2)
    floating = isinstance(k.kind(a), FLOATING) or isinstance(k.kind(b), FLOATING)
    ca, cb = k.column(a), k.column(b)
    return (ca.cast("double"), cb.cast("double"), True) if floating else (ca, cb, False)


def _comparison(name: str, f: Callable[[Column, Column, bool], Column]) -> None:
    OPERATORS[name] = lambda k, spec: f(*_pair(k, spec))


_comparison("$eq", lambda a, b, n: a.eqNullSafe(b))
_comparison("$ne", lambda a, b, n: ~a.eqNullSafe(b))
_comparison("$lt", _less)
_comparison("$gt", lambda a, b, n: _less(b, a, n))
_comparison("$lte", lambda a, b, n: ~_less(b, a, n))
_comparison("$gte", lambda a, b, n: ~_less(a, b, n))
_comparison("$cmp", lambda a, b, n: F.when(_less(a, b, n), -1).when(_less(b, a, n), 1).otherwise(0))


@operator("$and")
def _and(k: Compiler, spec) -> Column:
    out = F.lit(True)
    for s in k.specs(spec, 0):
        out = out & k.truth(s)
    return out


@operator("$or")
def _or(k: Compiler, spec) -> Column:
    out = F.lit(False)
    for s in k.specs(spec, 0):
        out = out | k.truth(s)
    return out


@operator("$not")
def _not(k: Compiler, spec) -> Column:
    (spec,) = k.specs(spec, 1, 1)
    return ~k.truth(spec)


@operator("$cond")
def _cond(k: Compiler, spec) -> Column:
    a, b, c = (spec["if"], spec["then"], spec["else"]) if isinstance(spec, dict) else k.specs(spec, 3, 3)
    return F.when(k.truth(a), k.column(b)).otherwise(k.column(c))


@operator("$ifNull")
def _if_null(k: Compiler, spec) -> Column:
    return F.coalesce(*k.args(spec, 2))


@operator("$switch")
def _switch(k: Compiler, spec) -> Column:
    if not spec.get("branches"):
        raise ExpressionError("$switch needs a branch")
    out = None
    for b in spec["branches"]:
        out = (F if out is None else out).when(k.truth(b["case"]), k.column(b["then"]))
    if "default" in spec:
        return out.otherwise(k.column(spec["default"]))
    kind = k.kind(spec["branches"][0]["then"])
    return out.otherwise(F.raise_error(F.lit("$switch: no branch matches and there is no default")).cast(kind))


# documents, variables, literals


@operator("$getField")
def _get_field(k: Compiler, spec) -> Column:
    name, source = (spec["field"], spec.get("input", "$$CURRENT")) if isinstance(spec, dict) and "field" in spec else (spec, "$$CURRENT")
    name = name["$literal"] if isinstance(name, dict) else name
    kind = k.kind(source)
    if isinstance(kind, T.MapType):
        return F.try_element_at(k.column(source), F.lit(name))
    return k.column(source).getField(name) if isinstance(kind, T.StructType) and name in kind.names else F.lit(None)


@operator("$setField")
def _set_field(k: Compiler, spec) -> Column:
    if not isinstance(spec["field"], str):
        raise ExpressionError("$setField takes a constant field")
    c, kind = k.column(spec["input"]), k.kind(spec["input"])
    fields = {f.name: c[f.name] for f in kind.fields}
    if spec["value"] == "$$REMOVE":
        fields.pop(spec["field"], None)
    else:
        fields[spec["field"]] = k.column(spec["value"])
    return F.struct(*(v.alias(n) for n, v in fields.items()))


@operator("$unsetField")
def _unset_field(k: Compiler, spec) -> Column:
    return _set_field(k, spec | {"value": "$$REMOVE"})


@operator("$mergeObjects")
def _merge_objects(k: Compiler, spec) -> Column:
    """Later documents win where they have the field; a field that is null counts as absent."""
    fields: dict[str, Column] = {}
    for s in k.specs(spec):
        kind, c = k.kind(s), k.column(s)
        if isinstance(kind, T.NullType):
            continue
        if not isinstance(kind, T.StructType):
            raise ExpressionError("$mergeObjects takes documents")
        for f in kind.fields:
            fields[f.name] = F.coalesce(c[f.name], fields[f.name]) if f.name in fields else c[f.name]
    return F.struct(*(v.alias(n) for n, v in fields.items()))


@operator("$let")
def _let(k: Compiler, spec) -> Column:
    return k.bind(**{n: (k.column(v), k.kind(v)) for n, v in spec["vars"].items()}).column(spec["in"])


@operator("$literal", "$const")
def _literal(k: Compiler, spec) -> Column:
    return literal(spec)


@operator("$rand")
def _rand(k: Compiler, spec) -> Column:
    return F.rand()


@operator("$meta")
def _meta(k: Compiler, spec) -> Column:
    name = {"textScore": "__text_score", "searchScore": "__search_score", "vectorSearchScore": "__search_score", "geoNearDistance": "__distance"}.get(spec)
    return F.col(name) if name in k.df.columns else F.lit(None).cast("double")


@operator("$bsonSize")
def _bson_size(k: Compiler, spec) -> Column:
    """Bytes of the document as JSON text; stored sizes don't exist here."""
    return F.octet_length(F.to_json(k.args(spec, 1, 1)[0]))


@operator("$binarySize")
def _binary_size(k: Compiler, spec) -> Column:
    return F.octet_length(k.args(spec, 1, 1)[0])


@operator("$function", "$accumulator")
def _javascript(k: Compiler, spec) -> Column:
    """``body`` is a Python callable over pandas Series here: (body, args, returns a Spark type)."""
    body = spec.get("body")
    if not callable(body):
        raise ExpressionError("a function's body is a Python callable over pandas Series; JavaScript isn't run")
    return F.pandas_udf(body, returnType=spec.get("returns", "double"))(*[k.column(a) for a in spec.get("args", [])])


# types

#: Type names and codes of conversions, with the Spark type of each.
TYPES = {"double": "double", "string": "string", "bool": "boolean", "date": "timestamp", "int": "int", "long": "long", "decimal": "decimal(38,10)", "objectId": "binary", "binData": "binary"}
CODES = {1: "double", 2: "string", 5: "binData", 7: "objectId", 8: "bool", 9: "date", 16: "int", 18: "long", 19: "decimal"}


#: What every text that reads as a number matches. A failing cast raises and catches an error inside, which costs far more than the pattern.
MAY_READ = {"int": r"^[^A-Za-z0-9]*+[0-9][^A-Za-z]*+$", "long": r"^[^A-Za-z0-9]*+[0-9][^A-Za-z]*+$", "double": "[0-9nN]", "decimal": r"\p{Nd}"}


def type_name(kind: T.DataType | None) -> str:
    for t, name in ((T.DoubleType, "double"), (T.FloatType, "double"), (T.StringType, "string"), (T.StructType, "object"), (T.MapType, "object"), (T.ArrayType, "array"), (T.BinaryType, "binData"), (T.BooleanType, "bool"), (T.LongType, "long"), (T.DecimalType, "decimal"), ((T.IntegerType, T.ShortType, T.ByteType), "int"), (DATES, "date"), (T.NullType, "null")):
        if isinstance(kind, t):
            return name
    return "missing"


def _converted(k: Compiler, spec, to: str) -> Column:
    """The value as ``to``; null where it can't be."""
    c, kind = k.column(spec), k.kind(spec)
    if to == "bool":
        return F.when(c.isNotNull(), k.truth(spec) if isinstance(kind, (*NUMERIC, T.BooleanType)) else F.lit(True))
    if to == "date":
        if isinstance(kind, NUMERIC):
            return F.timestamp_millis(c.cast("long"))
        if isinstance(kind, T.BinaryType):
            return F.timestamp_seconds(F.conv(F.hex(F.substring(c, 1, 4)), 16, 10).cast("long"))
        return F.try_to_timestamp(c) if isinstance(kind, T.StringType) else c.cast("timestamp")
    if to in ("int", "long") and isinstance(kind, DATES):
        return millis(c)
    if to in ("int", "long") and isinstance(kind, (*FLOATING, T.DecimalType)):
        low, high = (-(2**31), 2**31 - 1) if to == "int" else (-(2**63), 2**63 - 1)
        return F.when(c.between(low, high), c.cast(to))
    if to == "objectId":
        return F.when(F.regexp_like(c, F.lit("^[0-9a-fA-F]{24}$")), F.unhex(c))
    if to == "string":
        if isinstance(kind, DATES):
            return _to_string(k, {"date": spec})
        if isinstance(kind, T.BooleanType):
            return F.when(c, F.lit("true")).when(~c, F.lit("false"))
        return F.lower(F.hex(c)) if isinstance(kind, T.BinaryType) else c.cast("string")
    if to in MAY_READ and kind == T.StringType():
        return F.when(c.rlike(MAY_READ[to]), c.try_cast(TYPES[to]))
    return c.try_cast(TYPES[to])


def _to(name: str, to: str) -> None:
    def run(k: Compiler, spec) -> Column:
        (spec,) = k.specs(spec, 1, 1)
        c, out = k.column(spec), _converted(k, spec, to)
        # the conversion stands here once: nested ones would double in size at each level and leave compiled code too large to be optimized
        return F.coalesce(out, F.when(c.isNotNull(), fail(f"{name}: the value can't be converted", TYPES[to])))

    OPERATORS[name] = run


for _name, _t in {"$toBool": "bool", "$toDate": "date", "$toDecimal": "decimal", "$toDouble": "double", "$toInt": "int", "$toLong": "long", "$toObjectId": "objectId", "$toString": "string"}.items():
    _to(_name, _t)


@operator("$convert")
def _convert(k: Compiler, spec) -> Column:
    to = spec["to"]["type"] if isinstance(spec["to"], dict) else spec["to"]
    to = CODES.get(to, to)
    if to not in TYPES:
        raise ExpressionError(f"unknown type {to}")
    c, out = k.column(spec["input"]), _converted(k, spec["input"], to)
    wrong = k.column(spec["onError"]) if "onError" in spec else fail("$convert: the value can't be converted", TYPES[to])
    empty = k.column(spec["onNull"]) if "onNull" in spec else F.lit(None)
    return F.coalesce(out, F.when(c.isNull(), empty).otherwise(wrong))


@operator("$isNumber")
def _is_number(k: Compiler, spec) -> Column:
    (spec,) = k.specs(spec, 1, 1)
    return F.coalesce(k.column(spec).isNotNull() & F.lit(isinstance(k.kind(spec), NUMERIC)), F.lit(False))


@operator("$toUUID")
def _to_uuid(k: Compiler, spec) -> Column:
    return F.unhex(F.replace(k.args(spec, 1, 1)[0], F.lit("-"), F.lit("")))


@operator("$toHashedIndexKey")
def _hashed(k: Compiler, spec) -> Column:
    return F.xxhash64(k.args(spec, 1, 1)[0])


@operator("$type")
def _type(k: Compiler, spec) -> Column:
    (spec,) = k.specs(spec, 1, 1)
    kind = k.kind(spec)
    if isinstance(kind, T.NullType):
        return F.lit("missing")
    return F.when(k.column(spec).isNull(), F.lit("null")).otherwise(F.lit(type_name(kind)))


@operator("$_bucketInternal")
def _bucket(k: Compiler, spec) -> Column:
    """The lower boundary of a value's bucket, else the default, else an error."""
    bounds = spec["boundaries"]
    if len(bounds) < 2 or list(bounds) != sorted(set(bounds)):
        raise ExpressionError("boundaries are two or more ascending constants")
    c, out = k.column(spec["groupBy"]), None
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        out = (F if out is None else out).when((c >= literal(lo)) & (c < literal(hi)), literal(lo))
    if "default" in spec:
        d = spec["default"]
        if type(d) is type(bounds[0]) and bounds[0] <= d < bounds[-1]:
            raise ExpressionError("the default lies within the boundaries")
        same = isinstance(d, type(bounds[0])) or (isinstance(d, (int, float)) and isinstance(bounds[0], (int, float)))
        return out.otherwise(literal(d)) if same else F.coalesce(out.cast("string"), literal(d).cast("string"))
    return out.otherwise(F.raise_error(F.lit("$bucket: a value has no bucket and there is no default")).cast(k.kind({"$literal": bounds[0]})))


__all__ = ["OPERATORS", "Compiler", "ExpressionError", "datetime", "decimal", "literal", "math", "operator", "pattern_of", "slice_of", "sort_elements", "type_name"]
