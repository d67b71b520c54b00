"""Group accumulators as Spark aggregates.

Ordered accumulators ($first, $push and the like) see rows in the order of the
preceding $sort: its keys travel with the value and the gathered array is
sorted by them, since a shuffle keeps no order. $first, $last, $top and $bottom
stay bounded: they are ``min_by``/``max_by`` and never gather a group; the N
forms keep whole arrays only where the language returns them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .expressions import Compiler, ExpressionError, sort_elements
from .paths import NUMERIC, column_at

Sort = list[tuple[Column, int]]


def _reverse(c: Column, kind: T.DataType | None) -> Column | None:
    """A key that orders the other way, for types that have one."""
    if isinstance(kind, NUMERIC):
        return -c
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return -F.unix_micros(c.cast("timestamp"))
    if isinstance(kind, T.DateType):
        return -F.unix_date(c)
    if isinstance(kind, T.BooleanType):
        return ~c
    return None


def keys_of(k: Compiler, sort: dict) -> tuple[Column | None, list[tuple[str, int]]]:
    """One comparable struct for a sort document; None when a descending key has no reverse."""
    parts, ways = [], []
    for i, (path, way) in enumerate(sort.items()):
        c, kind = column_at(k.df, path)
        if kind is None:
            continue
        if way < 0:
            flipped = _reverse(c, kind)
            if flipped is None:
                return None, []
            parts += [c.isNull().alias(f"n{i}"), flipped.alias(f"k{i}")]
        else:
            parts += [c.isNotNull().alias(f"n{i}"), c.alias(f"k{i}")]
        ways.append((path, way))
    return F.struct(*parts) if parts else F.lit(0), ways


def _ordered(kind: T.DataType) -> bool:
    """Whether Spark can sort values of the type."""
    if isinstance(kind, T.ArrayType):
        return _ordered(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_ordered(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType, T.CalendarIntervalType))


def _gathered(k: Compiler, value: Column, sort: dict | None) -> Column:
    """All values of a group (nulls kept) in sorted order."""
    if not sort:
        return F.transform(F.collect_list(F.struct(value.alias("v"))), lambda x: x["v"])
    key, _ = keys_of(k, sort)
    if key is not None and _ordered(k.df.select(value.alias("v")).schema["v"].dataType):
        # ties keep their places; generated code compares keys, which a comparator given as an expression would do row by row
        rows = F.collect_list(F.struct(key.alias("o"), F.struct(value.alias("v")).alias("w")))
        return F.transform(F.sort_array(F.transform(rows, lambda x, i: F.struct(x["o"].alias("o"), i.alias("i"), x["w"].alias("w")))), lambda x: x["w"]["v"])
    if key is not None:
        return F.transform(F.array_sort(F.collect_list(F.struct(key.alias("o"), F.struct(value.alias("v")).alias("w"))), lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)), lambda x: x["w"]["v"])
    named = {f"k{i}": p for i, p in enumerate(sort)}
    rows = F.collect_list(F.struct(*(column_at(k.df, p)[0].alias(n) for n, p in named.items()), value.alias("v")))
    kind = T.StructType([T.StructField(n, column_at(k.df, p)[1]) for n, p in named.items()])
    return F.transform(sort_elements(rows, kind, {n: sort[p] for n, p in named.items()}), lambda x: x["v"])


def _one(k: Compiler, value: Column, sort: dict | None, last: bool) -> Column:
    if not sort:
        return F.last(value) if last else F.first(value)
    key, _ = keys_of(k, sort)
    if key is None:
        v = _gathered(k, value, sort)
        return F.get(v, F.size(v) - 1 if last else F.lit(0))
    wrapped = F.struct(value.alias("v"))
    return (F.max_by if last else F.min_by)(wrapped, key)["v"]


def _several(v: Column, n, last: bool) -> Column:
    n = F.lit(n)
    return F.slice(v, F.greatest(F.size(v) - n + 1, F.lit(1)), n) if last else F.slice(v, F.lit(1), n)


def at_ranks(value: Column, ps: list[float]) -> Column:
    """The values at ranks ceil(p * n) of one task's rows.

    At this accuracy the sketch merges no values. Each p is taken one step lower, so that a
    product just above a whole number isn't rounded up to the next rank.
    """
    return F.percentile_approx(value, [math.nextafter(p, 0.0) for p in ps], 2**31 - 1)


def percents(name: str, arg: dict) -> list[float]:
    """The percentiles that ``$percentile`` or ``$median`` asks for."""
    if arg.get("method", "approximate") != "approximate":
        raise ExpressionError("the method is approximate")
    ps = arg["p"] if name == "$percentile" else [0.5]
    if not all(0 <= p <= 1 for p in ps):
        raise ExpressionError("p lies between 0 and 1")
    return [float(p) for p in ps]


def accumulate(k: Compiler, spec: dict, sort: dict | None = None) -> Column:
    """The aggregate Column of ``{"$name": argument}``."""
    if len(spec) != 1:
        raise ExpressionError("an accumulator has one operator")
    ((name, arg),) = spec.items()
    numeric = lambda s: isinstance(k.kind(s), NUMERIC)
    if name == "$sum":
        if isinstance(arg, (int, float)):
            return F.count(F.lit(1)) * F.lit(arg) if arg != 1 else F.count(F.lit(1))
        return F.coalesce(F.sum(k.column(arg)), F.lit(0)) if numeric(arg) else F.sum(F.lit(0))
    if name in ("$avg", "$stdDevPop", "$stdDevSamp"):
        f = {"$avg": F.avg, "$stdDevPop": F.stddev_pop, "$stdDevSamp": F.stddev_samp}[name]
        return f(k.column(arg)) if numeric(arg) else F.first(F.lit(None).cast("double"))
    if name == "$min":
        return F.min(k.column(arg))
    if name == "$max":
        return F.max(k.column(arg))
    if name == "$count":
        return F.count(F.lit(1))
    if name in ("$first", "$last"):
        return _one(k, k.column(arg), sort, name == "$last")
    if name in ("$firstN", "$lastN"):
        return _several(_gathered(k, k.column(arg["input"]), sort), arg["n"], name == "$lastN")
    if name in ("$top", "$bottom", "$topN", "$bottomN"):
        if "output" not in arg or "sortBy" not in arg or ("n" in arg) != name.endswith("N"):
            raise ExpressionError(f"{name} takes output and sortBy, the N forms n too")
        value = k.column(arg["output"])
        if name in ("$top", "$bottom"):
            return _one(k, value, arg["sortBy"], name == "$bottom")
        return _several(_gathered(k, value, arg["sortBy"]), arg["n"], name == "$bottomN")
    if name in ("$maxN", "$minN"):
        v = F.sort_array(F.collect_list(k.column(arg["input"])), asc=name == "$minN")
        return F.slice(v, F.lit(1), F.lit(arg["n"]))
    if name == "$push":
        return _gathered(k, k.column(arg), sort)
    if name == "$addToSet":
        return F.array_sort(F.collect_set(k.column(arg)))
    if name == "$concatArrays":
        return F.flatten(F.array_compact(_gathered(k, k.column(arg), sort)))
    if name == "$mergeObjects":
        kind = k.kind(arg)
        docs = _gathered(k, k.column(arg), sort)
        if isinstance(kind, T.MapType):
            return F.aggregate(docs, F.create_map().cast(kind), lambda m, d: F.when(d.isNull(), m).otherwise(F.map_concat(F.map_filter(m, lambda key, _: ~F.map_contains_key(d, key)), d)))
        last = lambda f: F.element_at(F.filter(F.transform(docs, lambda d: d[f]), lambda x: x.isNotNull()), -1)
        some = lambda f: F.size(F.filter(docs, lambda d: d[f].isNotNull())) > 0
        return F.struct(*(F.when(some(f.name), last(f.name)).alias(f.name) for f in kind.fields))
    if name in ("$percentile", "$median"):
        got = at_ranks(k.column(arg["input"]).cast("double") if numeric(arg["input"]) else F.lit(None).cast("double"), percents(name, arg))
        return got if name == "$percentile" else got[0]
    if name == "$accumulator":
        body = arg.get("body")
        if not callable(body):
            raise ExpressionError("an accumulator's body is a Python callable over pandas Series; JavaScript isn't run")
        return F.pandas_udf(body, returnType=arg.get("returns", "double"), functionType=F.PandasUDFType.GROUPED_AGG)(*[k.column(a) for a in arg.get("args", [])])
    raise ExpressionError(f"unknown accumulator {name}")
