"""Update documents and update pipelines as column rewrites.

``apply(df, update, query)`` gives the updated rows; the catalog decides which
rows it is applied to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import ExpressionError, literal, slice_of, sort_elements
from ..functions.paths import column_at, with_path, without_path
from .predicates import element_test
from .stages import add_fields, project, replace_root


def _typed(value, kind: T.DataType | None) -> Column:
    c = literal(value)
    return c if kind is None else c.cast(kind)


def _array(c: Column, kind, value) -> Column:
    return F.coalesce(c, F.array().cast(kind)) if kind is not None else F.array().cast(T.ArrayType(_kind(value)))


def _kind(value) -> T.DataType:
    return {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}.get(type(value), T.StringType())


def _each(value) -> tuple[list, dict]:
    if isinstance(value, dict) and "$each" in value:
        return value["$each"], value
    return [value], {}


def _set(c, kind, v):
    return literal(v) if kind is None or isinstance(kind, (T.StructType, T.ArrayType)) else _typed(v, kind)


def _inc(c, kind, v):
    return F.coalesce(c, F.lit(0)) + literal(v)


def _mul(c, kind, v):
    return F.coalesce(c, F.lit(0)) * literal(v)


def _min(c, kind, v):
    return F.least(c, _typed(v, kind))


def _max(c, kind, v):
    return F.greatest(c, _typed(v, kind))


def _bit(c, kind, v):
    ((op, m),) = v.items()
    base = F.coalesce(c, F.lit(0))
    return {"and": base.bitwiseAND, "or": base.bitwiseOR, "xor": base.bitwiseXOR}[op](F.lit(m))


def _current_date(c, kind, v):
    return F.current_timestamp()


def _push(c, kind, v):
    items, how = _each(v)
    element = kind.elementType if kind is not None else None
    base = _array(c, kind, items[0] if items else None)
    new = F.array(*(_typed(x, element) for x in items)) if items else F.slice(base, F.lit(1), F.lit(0))
    at = how.get("$position")
    if at is None:
        out = F.concat(base, new)
    else:
        n = F.lit(at) if at >= 0 else F.greatest(F.size(base) + at, F.lit(0))
        out = F.concat(F.slice(base, F.lit(1), n), new, F.slice(base, n + 1, F.greatest(F.size(base), F.lit(1))))
    if "$sort" in how:
        out = sort_elements(out, element, how["$sort"])
    return slice_of(out, None, F.lit(how["$slice"])) if "$slice" in how else out


def _add_to_set(c, kind, v):
    items, _ = _each(v)
    element = kind.elementType if kind is not None else None
    base = _array(c, kind, items[0] if items else None)
    out = base
    for x in items:
        e = _typed(x, element)
        out = F.when(_holds(out, e), out).otherwise(F.concat(out, F.array(e)))
    return out


def _holds(array: Column, e: Column) -> Column:
    return F.exists(array, lambda y: y.eqNullSafe(e))


def _pop(c, kind, v):
    if v not in (1, -1):
        raise ExpressionError("$pop takes 1 or -1")
    n = F.greatest(F.size(c) - 1, F.lit(0))
    return F.slice(c, F.lit(1 if v == 1 else 2), n) if v == 1 else F.slice(c, F.lit(2), n)


def _pull(c, kind, v, df):
    if kind is None:
        return c
    query = v if isinstance(v, dict) else {"$eq": v}
    return F.filter(c, lambda x: ~element_test(df, x, kind.elementType, query))


def _pull_all(c, kind, v):
    return F.filter(c, lambda x: ~F.coalesce(x.isin([y for y in v if y is not None]), F.lit(None in v)))


SIMPLE = {"$set": _set, "$inc": _inc, "$mul": _mul, "$min": _min, "$max": _max, "$bit": _bit, "$currentDate": _current_date, "$push": _push, "$addToSet": _add_to_set, "$pop": _pop, "$pullAll": _pull_all}
PIPELINE = {"$project": project, "$addFields": add_fields, "$set": add_fields, "$replaceWith": replace_root, "$replaceRoot": lambda df, s, *a: replace_root(df, s["newRoot"], *a)}


def _unset_all(df: DataFrame, paths) -> DataFrame:
    for p in [paths] if isinstance(paths, str) else paths:
        df = without_path(df, p)
    return df


def _changed(op: str, c: Column, kind: T.DataType | None, v, df: DataFrame) -> Column:
    """One operator on one value."""
    if op == "$unset":
        return F.lit(None).cast(kind)
    if op == "$pull":
        return _pull(c, kind, v, df)
    if op not in SIMPLE:
        raise ExpressionError(f"{op} takes no positional path")
    out = SIMPLE[op](c, kind, v)
    return out if kind is None else out.cast(kind)


def _positional(part: str) -> bool:
    return part == "$" or (part.startswith("$[") and part.endswith("]"))


def _array_filter(df: DataFrame, name: str, filters: list[dict], x: Column, kind: T.DataType) -> Column:
    """The test of ``$[name]``: filters name the element itself or fields of it."""

    def own(query: dict) -> dict:
        out = {}
        for key, v in query.items():
            if key in ("$and", "$or", "$nor"):
                out[key] = [own(q) for q in v]
            elif key == name:
                out |= v if isinstance(v, dict) and all(o.startswith("$") for o in v) else {"$eq": v}
            elif key.startswith(name + "."):
                out[key[len(name) + 1 :]] = v
            else:
                raise ExpressionError(f"no array filter for {key}")
        return out

    named = lambda q: any(k.split(".")[0] == name or (k in ("$and", "$or", "$nor") and all(named(y) for y in v)) for k, v in q.items())
    found = [f for f in filters if named(f)]
    if len(found) != 1:
        raise ExpressionError(f"$[{name}] needs one array filter")
    return element_test(df, x, kind, own(found[0]))


def _first_hit(df: DataFrame, c: Column, kind: T.ArrayType, base: str, query: dict) -> Column:
    """The index of the first element that the query's condition on the array matches."""
    tests = []
    for path, v in (query or {}).items():
        if path == base:
            cond = v.get("$elemMatch", v) if isinstance(v, dict) else {"$eq": v}
            tests.append(lambda x, q=cond: element_test(df, x, kind.elementType, q))
        elif path.startswith(base + "."):
            tests.append(lambda x, q={path[len(base) + 1 :]: v}: element_test(df, x, kind.elementType, q))
    if not tests:
        raise ExpressionError("the positional operator needs the array in the query")
    return F.array_position(F.transform(c, lambda x: tests[0](x)), F.lit(True)) - 1


def _in_place(df: DataFrame, c: Column, kind: T.DataType | None, parts: list[str], base: str, op: str, v, filters: list[dict], query: dict) -> Column:
    """``c`` with the operator applied at ``parts`` under it, array positions included."""
    if not parts:
        return _changed(op, c, kind, v, df)
    head, rest = parts[0], parts[1:]
    if isinstance(kind, T.ArrayType):
        element = kind.elementType
        inner = lambda x: _in_place(df, x, element, rest, f"{base}.{head}", op, v, filters, query)
        if head == "$[]":
            return F.transform(c, inner)
        if head == "$":
            hit = _first_hit(df, c, kind, base, query)
            return F.transform(c, lambda x, i: F.when(i == hit, inner(x)).otherwise(x))
        if head.startswith("$["):
            return F.transform(c, lambda x: F.when(F.coalesce(_array_filter(df, head[2:-1], filters, x, element), F.lit(False)), inner(x)).otherwise(x))
        if head.isdigit():
            return F.transform(c, lambda x, i: F.when(i == int(head), inner(x)).otherwise(x))
    if not isinstance(kind, T.StructType):
        raise ExpressionError(f"{base} isn't an array or document")
    own = kind[head].dataType if head in kind.names else None
    changed = _in_place(df, c[head] if own is not None else F.lit(None), own, rest, f"{base}.{head}", op, v, filters, query)
    return F.when(c.isNotNull(), F.struct(*((changed if f.name == head else c[f.name]).alias(f.name) for f in kind.fields), *([changed.alias(head)] if own is None else [])))


def apply(df: DataFrame, update: dict | list, inserting: bool = False, array_filters: list[dict] | None = None, query: dict | None = None) -> DataFrame:
    """The rows of ``df`` after the update; a plain document replaces all but _id.

    Paths may hold ``$[]``, ``$[name]`` (with ``array_filters``), ``$`` (the
    first element that ``query`` matched) and positions.
    """
    if isinstance(update, list):
        for s in update:
            ((op, spec),) = s.items()
            if op == "$unset":
                df = _unset_all(df, spec)
            elif op in PIPELINE:
                df = PIPELINE[op](df, spec)
            else:
                raise ExpressionError(f"{op} isn't a stage of update pipelines")
        return df
    if not any(k.startswith("$") for k in update):
        keep = [F.col("_id")] if "_id" in df.columns and "_id" not in update else []
        return df.select(*keep, *(literal(v).alias(k) for k, v in update.items()))
    for op, spec in update.items():
        for path, v in spec.items():
            head, *parts = path.split(".")
            if head in df.columns and path not in df.columns and any(_positional(x) or x.isdigit() for x in parts):
                whole = df.schema[head].dataType
                df = df.withColumn(head, _in_place(df, F.col(head), whole, parts, head, op, v, array_filters or [], query or {}))
                continue
            c, kind = column_at(df, path)
            if op == "$unset":
                # the column stays for the rows that aren't updated
                df = with_path(df, path, F.lit(None).cast(kind)) if kind is not None else df
            elif op == "$rename":
                if kind is not None:
                    df = without_path(with_path(df, v, c), path)
            elif op == "$setOnInsert":
                df = with_path(df, path, literal(v)) if inserting else df
            elif op == "$pull":
                df = with_path(df, path, _pull(c, kind, v, df))
            elif op in SIMPLE:
                df = with_path(df, path, SIMPLE[op](c, kind, v))
            else:
                raise ExpressionError(f"unknown update operator {op}")
    return df
