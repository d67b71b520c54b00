"""$setWindowFields functions as Spark window expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .accumulators import accumulate, at_ranks, percents
from .expressions import Compiler, ExpressionError
from .paths import DATES, column_at

MILLIS = {"week": 604_800_000, "day": 86_400_000, "hour": 3_600_000, "minute": 60_000, "second": 1000, "millisecond": 1}


def order_columns(k: Compiler, sort: dict) -> list[Column]:
    return [c.asc_nulls_first() if way > 0 else c.desc_nulls_last() for c, way in ((column_at(k.df, p)[0], w) for p, w in sort.items())]


def _bound(v, current: int, low: bool):
    return {"unbounded": Window.unboundedPreceding if low else Window.unboundedFollowing, "current": current}.get(v, v)


def _single(k: Compiler, sort: dict, name: str) -> tuple[Column, bool]:
    """The one sort key of a function that measures distances, in milliseconds for dates."""
    if len(sort) != 1:
        raise ExpressionError(f"{name} needs one sort key")
    c, kind = column_at(k.df, next(iter(sort)))
    return (F.unix_millis(c.cast("timestamp")), True) if isinstance(kind, DATES) else (c, False)


def window_column(k: Compiler, partition: list[Column], sort: dict, spec: dict) -> Column:
    """One output of $setWindowFields."""
    spec = dict(spec)
    frame = spec.pop("window", None)
    ((name, arg),) = spec.items()
    base = Window.partitionBy(*partition)
    ordered = base.orderBy(*order_columns(k, sort)) if sort else base
    if name in ("$rank", "$denseRank", "$documentNumber"):
        return {"$rank": F.rank, "$denseRank": F.dense_rank, "$documentNumber": F.row_number}[name]().over(ordered)
    if name == "$shift":
        return F.lag(k.column(arg["output"]), -arg["by"], arg.get("default")).over(ordered)
    if name == "$locf":
        return F.last(k.column(arg), ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    if name == "$linearFill":
        return linear_fill(k.column(arg), _single(k, sort, name)[0], ordered)
    if name == "$expMovingAvg":
        return _moving_average(k, arg, ordered)
    if frame is None:
        w = base.orderBy(*order_columns(k, sort)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing) if sort else base
    elif "documents" in frame:
        lo, hi = frame["documents"]
        w = ordered.rowsBetween(_bound(lo, 0, True), _bound(hi, 0, False))
    else:
        key, dated = _single(k, sort, "a range")
        scale = MILLIS[frame["unit"]] if frame.get("unit") else 1
        if dated and "unit" not in frame:
            raise ExpressionError("a range over dates has a unit")
        lo, hi = (v if isinstance(v, str) else v * scale for v in frame["range"])
        w = base.orderBy(key.asc()).rangeBetween(_bound(lo, 0, True), _bound(hi, 0, False))
    if name in ("$derivative", "$integral"):
        return _calculus(k, name, arg, sort, w)
    if name in ("$covariancePop", "$covarianceSamp"):
        x, y = (k.column(a).cast("double") for a in arg)
        return (F.covar_pop if name == "$covariancePop" else F.covar_samp)(x, y).over(w)
    return _over(k, name, arg, sort, w)


def _over(k: Compiler, name: str, arg, sort: dict, w) -> Column:
    """Accumulators over a frame. Frames deliver rows in order, so gathering ones need no sort."""
    if name in ("$sum", "$avg", "$stdDevPop", "$stdDevSamp", "$min", "$max", "$count"):
        c = {"$count": F.count(F.lit(1))}.get(name)
        if c is not None:
            return c.over(w)
        v = F.lit(arg) if isinstance(arg, (int, float)) else k.column(arg)
        out = {"$sum": F.sum, "$avg": F.avg, "$stdDevPop": F.stddev_pop, "$stdDevSamp": F.stddev_samp, "$min": F.min, "$max": F.max}[name](v).over(w)
        return F.coalesce(out, F.lit(0)) if name == "$sum" else out
    if name in ("$first", "$last"):
        return (F.first if name == "$first" else F.last)(k.column(arg)).over(w)
    gather = lambda v: F.transform(F.collect_list(F.struct(v.alias("v"))).over(w), lambda x: x["v"])
    if name == "$push":
        return gather(k.column(arg))
    if name == "$addToSet":
        return F.array_sort(F.collect_set(k.column(arg)).over(w))
    if name == "$concatArrays":
        return F.flatten(F.array_compact(gather(k.column(arg))))
    if name in ("$firstN", "$lastN"):
        v = gather(k.column(arg["input"]))
        return F.slice(v, F.lit(1), F.lit(arg["n"])) if name == "$firstN" else F.slice(v, F.greatest(F.size(v) - arg["n"] + 1, F.lit(1)), F.lit(arg["n"]))
    if name in ("$maxN", "$minN"):
        return F.slice(F.sort_array(F.collect_list(k.column(arg["input"])).over(w), asc=name == "$minN"), F.lit(1), F.lit(arg["n"]))
    if name in ("$top", "$bottom", "$topN", "$bottomN"):
        from .accumulators import keys_of

        key, _ = keys_of(k, arg["sortBy"])
        if key is None:
            raise ExpressionError("a descending key of this type has no order within frames")
        rows = F.array_sort(F.collect_list(F.struct(key.alias("o"), F.struct(k.column(arg["output"]).alias("v")).alias("w"))).over(w), lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0))
        v = F.transform(rows, lambda x: x["w"]["v"])
        if name in ("$top", "$bottom"):
            return F.get(v, F.lit(0) if name == "$top" else F.size(v) - 1)
        return F.slice(v, F.lit(1), F.lit(arg["n"])) if name == "$topN" else F.slice(v, F.greatest(F.size(v) - arg["n"] + 1, F.lit(1)), F.lit(arg["n"]))
    if name in ("$percentile", "$median"):
        got = at_ranks(k.column(arg["input"]).cast("double"), percents(name, arg)).over(w)
        return got if name == "$percentile" else got[0]
    return accumulate(k, {name: arg}, sort).over(w)


def linear_fill(c: Column, x: Column, ordered) -> Column:
    """Nulls between two values on the line between them, as doubles."""
    y, before, after = c.cast("double"), ordered.rowsBetween(Window.unboundedPreceding, 0), ordered.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(c.isNotNull(), x)
    x0, y0 = F.last(at, ignorenulls=True).over(before), F.last(y, ignorenulls=True).over(before)
    x1, y1 = F.first(at, ignorenulls=True).over(after), F.first(y, ignorenulls=True).over(after)
    return F.coalesce(y, F.when(x0.isNotNull() & x1.isNotNull(), y0 + (y1 - y0) * (x - x0) / (x1 - x0)))


def _moving_average(k: Compiler, arg: dict, ordered) -> Column:
    """Exponential moving average: a fold over the frame so far."""
    if ("N" in arg) == ("alpha" in arg):
        raise ExpressionError("$expMovingAvg takes N or alpha")
    alpha = 2 / (arg["N"] + 1) if "N" in arg else arg["alpha"]
    if not 0 < alpha < 1 and "alpha" in arg:
        raise ExpressionError("alpha lies between 0 and 1")
    seen = F.collect_list(k.column(arg["input"]).cast("double")).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    return F.aggregate(F.slice(seen, F.lit(2), F.greatest(F.size(seen), F.lit(1))), F.get(seen, F.lit(0)), lambda s, x: F.lit(alpha) * x + F.lit(1 - alpha) * s)


def _calculus(k: Compiler, name: str, arg: dict, sort: dict, w) -> Column:
    x, dated = _single(k, sort, name)
    # distances are taken before they are scaled: scaled dates would lose their last digits
    unit = float(MILLIS[arg.get("unit", "millisecond")] if dated else 1)
    y = k.column(arg["input"]).cast("double")
    if name == "$derivative":
        dx = (F.last(x).over(w) - F.first(x).over(w)) / F.lit(unit)
        return F.when(dx != 0, (F.last(y).over(w) - F.first(y).over(w)) / dx)
    rows = F.collect_list(F.struct(x.alias("x"), y.alias("y"))).over(w)
    areas = F.zip_with(F.slice(rows, F.lit(1), F.greatest(F.size(rows) - 1, F.lit(0))), F.slice(rows, F.lit(2), F.greatest(F.size(rows), F.lit(1))), lambda a, b: (b["x"] - a["x"]) / F.lit(unit) * (a["y"] + b["y"]) / 2)
    return F.aggregate(areas, F.lit(0.0), lambda s, v: s + v)


__all__ = ["T", "linear_fill", "order_columns", "window_column"]
