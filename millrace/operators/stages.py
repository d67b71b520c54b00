"""Aggregation stages: each maps a DataFrame and a specification to a DataFrame.

A stage gets (engine, df, spec, state). ``state`` carries what later stages
need to know of earlier ones, as the order of a preceding $sort.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.accumulators import accumulate, percents
from ..functions.expressions import Compiler, ExpressionError, literal
from ..functions.paths import DATES, NUMERIC, column_at, quoted, with_path, without_path
from ..functions.windows import MILLIS, linear_fill, order_columns, window_column
from ..shared import checkpointed
from . import search
from .predicates import compile_query, element_test
from .ranks import percentiles

STAGES: dict[str, Callable] = {}


@dataclass
class State:
    """What one pipeline run knows."""

    sort: dict | None = None
    variables: dict = field(default_factory=dict)


def stage(*names: str):
    def keep(f):
        for n in names:
            STAGES[n] = f
        return f

    return keep


def match(df: DataFrame, query: dict, variables: dict | None = None) -> DataFrame:
    if "$text" in query:
        df = df.withColumn("__text_score", search.text_score(df, query["$text"]))
    return df.where(compile_query(df, query, variables, positive=True)) if query else df


@stage("$match")
def _match(engine, df, spec, state):
    return match(df, spec, state.variables)


# shaping


def _flat(spec: dict, prefix: str = "") -> list[tuple[str, object]]:
    """Nested projections as (path, value)."""
    out = []
    for key, v in spec.items():
        path = prefix + key
        nested = isinstance(v, dict) and v and not any(x.startswith("$") for x in v)
        out += _flat(v, path + ".") if nested else [(path, v)]
    return out


def is_inclusion(spec: dict) -> bool:
    return any(v not in (0, False) for k, v in _flat(spec) if k != "_id") or all(k == "_id" for k in spec) and spec.get("_id") not in (0, False)


def project(df: DataFrame, spec: dict, variables: dict | None = None) -> DataFrame:
    flat = _flat(spec)
    if not is_inclusion(spec):
        for path, _ in flat:
            df = without_path(df, path)
        return df
    k = Compiler(df, variables)
    tree: dict = {}
    if spec.get("_id", 1) not in (0, False) and "_id" in df.columns and "_id" not in spec:
        tree["_id"] = F.col("_id")
    for path, v in flat:
        if v in (0, False) and not isinstance(v, str):
            continue
        if isinstance(v, (bool, int, float)) and not isinstance(v, str):
            c, kind = column_at(df, path)
            if kind is None:
                continue
            _included(tree, df, path)
            continue
        at = tree
        *parents, last = path.split(".")
        for p in parents:
            at = at.setdefault(p, {})
        at[last] = k.column(v)
    return df.select(*(_built(v).alias(n) for n, v in tree.items())) if tree else df.select(F.lit(1).alias("__none")).drop("__none")


def _included(tree: dict, df: DataFrame, path: str) -> None:
    head, _, rest = path.partition(".")
    if not rest or path in df.columns:
        tree[path] = F.col(quoted(path))
        return
    kept = tree.setdefault(head, _Kept(df, head))
    if isinstance(kept, _Kept):
        kept.paths.append(rest.split("."))


class _Kept:
    """Some fields of one nested column."""

    def __init__(self, df: DataFrame, name: str):
        self.kind, self.column, self.paths = df.schema[name].dataType, F.col(quoted(name)), []

    def build(self) -> Column:
        return _picked(self.column, self.kind, self.paths)


def _picked(c: Column, kind: T.DataType, paths: list[list[str]]) -> Column:
    if any(not p for p in paths) or not isinstance(kind, (T.StructType, T.ArrayType)):
        return c
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _picked(x, kind.elementType, paths))
    heads = dict.fromkeys(p[0] for p in paths if p[0] in kind.names)
    return F.when(c.isNotNull(), F.struct(*(_picked(c[h], kind[h].dataType, [p[1:] for p in paths if p[0] == h]).alias(h) for h in heads)))


def _built(v) -> Column:
    if isinstance(v, _Kept):
        return v.build()
    if isinstance(v, dict):
        return F.struct(*(_built(x).alias(n) for n, x in v.items()))
    return v


@stage("$project")
def _project(engine, df, spec, state):
    return project(df, spec, state.variables)


def add_fields(df: DataFrame, spec: dict, variables: dict | None = None) -> DataFrame:
    k = Compiler(df, variables)
    values = [(p, v, None if v == "$$REMOVE" else k.column(v)) for p, v in _flat(spec)]
    plain = {p: c for p, _, c in values if c is not None and "." not in p}
    out = df.withColumns(plain) if plain else df
    for p, _, c in values:
        if c is None:
            out = without_path(out, p)
        elif "." in p:
            out = with_path(out, p, c)
    return out


@stage("$addFields", "$set")
def _add_fields(engine, df, spec, state):
    return add_fields(df, spec, state.variables)


@stage("$unset")
def _unset(engine, df, spec, state):
    for p in [spec] if isinstance(spec, str) else spec:
        df = without_path(df, p)
    return df


def replace_root(df: DataFrame, spec, variables: dict | None = None) -> DataFrame:
    k = Compiler(df, variables)
    kind = k.kind(spec)
    if not isinstance(kind, T.StructType):
        raise ExpressionError("the new root is a document")
    return df.select(k.column(spec).alias("__root")).select("__root.*")


@stage("$replaceRoot")
def _replace_root(engine, df, spec, state):
    return replace_root(df, spec["newRoot"], state.variables)


@stage("$replaceWith")
def _replace_with(engine, df, spec, state):
    return replace_root(df, spec, state.variables)


@stage("$redact")
def _redact(engine, df, spec, state):
    """Keeps, prunes or descends; types bound the depth of the descent."""

    def verdict(fields: dict[str, tuple[Column, T.DataType]]) -> Column:
        shown = df.sparkSession.createDataFrame([], T.StructType([T.StructField(n, t) for n, (_, t) in fields.items()]))
        k = _Level(shown, fields, state.variables)
        return k.column(spec)

    def descend(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            return F.filter(F.transform(c, lambda x: level(x, kind.elementType)), lambda x: x.isNotNull())
        return level(c, kind) if isinstance(kind, T.StructType) else c

    def level(c: Column, kind: T.StructType) -> Column:
        fields = {f.name: (c[f.name], f.dataType) for f in kind.fields}
        v = verdict(fields)
        down = F.struct(*(descend(x, t).alias(n) for n, (x, t) in fields.items()))
        return F.when(v == "$$KEEP", c).when((v == "$$DESCEND") & c.isNotNull(), down)

    top = {f.name: (F.col(quoted(f.name)), f.dataType) for f in df.schema.fields}
    v = verdict(top)
    kept = df.where(F.coalesce(v != "$$PRUNE", F.lit(True)))
    return kept.select(*(F.when(v == "$$KEEP", c).otherwise(descend(c, t)).alias(n) for n, (c, t) in top.items()))


class _Level(Compiler):
    """Paths of one nesting level, as columns of it."""

    def __init__(self, df, fields, variables, probe=False):
        super().__init__(df, variables, probe)
        self.fields = fields

    def bind(self, **variables):
        return _Level(self.df, self.fields, self.variables | variables)

    def column(self, spec):
        if isinstance(spec, str) and spec.startswith("$") and not spec.startswith("$$"):
            from ..functions.paths import step_into, type_at

            head, *rest = spec[1:].split(".")
            if head not in self.fields or type_at(self.fields[head][1], rest) is None:
                return F.lit(None)
            return step_into(*self.fields[head], rest)
        return super().column(spec)


# groups


def _best_rows(k: Compiler, name: str, arg: dict, sort: dict | None) -> tuple[Column, list[Column], int] | None:
    """(value, order, n) of an N form whose rows have an order: its n first rows are what it keeps."""
    if name in ("$maxN", "$minN"):
        v = k.column(arg["input"])
        return v, [v.asc() if name == "$minN" else v.desc()], arg["n"]
    by = sort if name in ("$firstN", "$lastN") else arg.get("sortBy")
    if not by or "n" not in arg:
        return None
    forward = name in ("$firstN", "$topN")
    return k.column(arg["input" if name in ("$firstN", "$lastN") else "output"]), order_columns(k, by if forward else {p: -w for p, w in by.items()}), arg["n"]


_N_FORMS = ("$maxN", "$minN", "$firstN", "$lastN", "$topN", "$bottomN")


def group(df: DataFrame, spec: dict, sort: dict | None = None, variables: dict | None = None) -> DataFrame:
    """N forms are group limits: each task keeps n rows of a group, so no group is gathered.

    Percentiles are exact, from counts of distinct values.
    """
    k = Compiler(df, variables)
    key = k.column(spec["_id"])
    plain, bounded, ranked = {}, {}, {}
    for n, a in spec.items():
        if n != "_id":
            op = next(iter(a), None)
            best = _best_rows(k, op, a[op], sort) if op in _N_FORMS and len(a) == 1 and isinstance(a[op], dict) else None
            if best is not None and isinstance(best[2], int):
                bounded[n] = (op, *best)
            elif op in ("$percentile", "$median") and len(a) == 1 and isinstance(k.kind(a[op]["input"]), NUMERIC) and a[op].get("p", [0.5]) and not df.isStreaming:
                ranked.setdefault(json.dumps(a[op]["input"], default=str), (a[op]["input"], {}))[1][n] = (op, percents(op, a[op]))
            else:
                plain[n] = a
    aggs = [accumulate(k, a, sort).alias(n) for n, a in plain.items()]
    alone = spec["_id"] is None or (not isinstance(spec["_id"], (dict, list)) and not str(spec["_id"]).startswith("$"))
    if alone:
        out = df.agg(F.count(F.lit(1)).alias("__n"), *aggs).where("__n > 0").drop("__n").select(key.alias("_id"), "*")
    else:
        keyed = df.groupBy(key.alias("_id"))
        out = keyed.agg(*aggs) if aggs else df.select(key.alias("_id")).distinct()
    for n, (op, value, order, most) in bounded.items():
        rows = df if op not in ("$maxN", "$minN") else df.where(value.isNotNull())
        if alone:
            best = rows.orderBy(*order).limit(most).select(F.lit(0).alias("__key"), F.row_number().over(Window.orderBy(*order)).alias("__r"), F.struct(value.alias("v")).alias("__v"))
        else:
            best = rows.select(key.alias("__key"), F.struct(value.alias("v")).alias("__v"), F.row_number().over(Window.partitionBy(key).orderBy(*order)).alias("__r")).where(F.col("__r") <= most)
        back = op in ("$lastN", "$bottomN")
        got = best.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct((-F.col("__r") if back else F.col("__r")).alias("__r"), "__v"))).alias("__got"))
        item = F.transform("__got", lambda x: x["__v"]["v"])
        out = out.crossJoin(got) if alone and op not in ("$maxN", "$minN") else out.join(got, F.lit(True) if alone else out["_id"].eqNullSafe(got["__key"]), "left")  # alone: one row on either side
        out = out.withColumn(n, F.coalesce(item, F.array().cast(T.ArrayType(got.schema["__got"].dataType.elementType["__v"].dataType["v"].dataType)))).drop("__key", "__got")
    for value, wanted in ranked.values():
        got = percentiles(df, F.lit(0) if alone else key, k.column(value).cast("double"), {n: ps for n, (_, ps) in wanted.items()})
        out = out.join(got, F.lit(True) if alone else out["_id"].eqNullSafe(got["__key"]), "left").drop("__key")
        out = out.withColumns({n: F.get(F.col(quoted(n)), F.lit(0)) for n, (op, _) in wanted.items() if op == "$median"})
    return out.select("_id", *(F.col(quoted(n)) for n in spec if n != "_id")) if bounded or ranked else out


@stage("$group")
def _group(engine, df, spec, state):
    return group(df, spec, state.sort, state.variables)


@stage("$bucket")
def _bucket(engine, df, spec, state):
    key = {"$_bucketInternal": {x: spec[x] for x in ("groupBy", "boundaries", "default") if x in spec}}
    return group(df, {"_id": key} | spec.get("output", {"count": {"$sum": 1}}), state.sort, state.variables).orderBy("_id")


@stage("$bucketAuto")
def _bucket_auto(engine, df, spec, state):
    from .buckets import bucket_auto

    return bucket_auto(df, spec, state)


@stage("$sortByCount")
def _sort_by_count(engine, df, spec, state):
    return group(df, {"_id": spec, "count": {"$sum": 1}}, None, state.variables).orderBy(F.desc("count"))


@stage("$count")
def _count(engine, df, spec, state):
    return df.agg(F.count(F.lit(1)).alias(spec)).where(F.col(spec) > 0)


# order


def sort(df: DataFrame, spec: dict) -> DataFrame:
    cols = []
    for path, way in spec.items():
        if isinstance(way, dict):
            cols.append(Compiler(df).column(way).desc_nulls_last())
            continue
        c, kind = column_at(df, path)
        if kind is None:
            continue
        if isinstance(kind, T.ArrayType):
            c = F.array_min(c) if way > 0 else F.array_max(c)
            kind = kind.elementType
        if isinstance(kind, (T.DoubleType, T.FloatType)):  # NaN comes before numbers here
            c = F.when(c.isNotNull(), F.struct(~F.isnan(c), c))
        cols.append(c.asc_nulls_first() if way > 0 else c.desc_nulls_last())
    return df.orderBy(*cols) if cols else df


@stage("$sort")
def _sort(engine, df, spec, state):
    state.sort = {p: w for p, w in spec.items() if isinstance(w, int)}
    return sort(df, spec)


@stage("$limit")
def _limit(engine, df, spec, state):
    if not isinstance(spec, int) or spec <= 0:
        raise ExpressionError("$limit is positive")
    return df.limit(spec)


@stage("$skip")
def _skip(engine, df, spec, state):
    if not isinstance(spec, int) or spec < 0:
        raise ExpressionError("$skip isn't negative")
    return df.offset(spec)


@stage("$sample")
def _sample(engine, df, spec, state):
    """A uniform sample: a bounded heap of random keys in each task, merged."""
    return df.orderBy(F.rand()).limit(spec["size"])


# arrays and joins


@stage("$unwind")
def _unwind(engine, df, spec, state):
    spec = {"path": spec} if isinstance(spec, str) else spec
    path, keep, index = spec["path"].lstrip("$"), spec.get("preserveNullAndEmptyArrays", False), spec.get("includeArrayIndex")
    c, kind = column_at(df, path)
    if kind is None:
        return df if keep else df.limit(0)
    if not isinstance(kind, T.ArrayType):
        out = df if keep else df.where(c.isNotNull())
        return out.withColumn(index, F.lit(None).cast("long")) if index else out
    if index:
        rows = df.select("*", (F.posexplode_outer if keep else F.posexplode)(c).alias("__at", "__item"))
        return with_path(rows.withColumn(index, F.col("__at").cast("long")), path, F.col("__item")).drop("__at", "__item")
    return with_path(df.select("*", (F.explode_outer if keep else F.explode)(c).alias("__item")), path, F.col("__item")).drop("__item")


def _foreign_row(right: DataFrame) -> Column:
    return F.struct(*(F.col(quoted(c)) for c in right.columns))


@stage("$lookup")
def _lookup(engine, df, spec, state):
    """Matches gather before the join, so each key's array is built once."""
    right, name = engine.collection(spec["from"]) if "from" in spec else None, spec["as"]
    if "localField" in spec:
        c, kind = column_at(df, spec["localField"])
        if spec.get("pipeline") and not spec.get("let"):
            right = engine.run(right, spec["pipeline"])
        f, fkind = column_at(right, spec["foreignField"])
        rows = right.select(f.alias("__k"), _foreign_row(right).alias("__row"))
        if isinstance(fkind, T.ArrayType):
            rows = rows.select(F.explode_outer(F.array_distinct("__k")).alias("__k"), "__row")
        item = T.ArrayType(rows.schema["__row"].dataType)
        none = F.array().cast(item)
        if isinstance(kind, T.ArrayType):
            # what a row gets depends on its array alone: each different array asks once, each foreign row answers once
            arrays = df.select(c.alias("__a")).where("__a is not null").distinct()
            asked = arrays.select("__a", F.explode(F.array_distinct("__a")).alias("__k"))
            if isinstance(fkind, T.ArrayType):
                # a foreign row that several keys reach: equal rows travel as one with their number
                kinds = right.groupBy(f.alias("__k"), _foreign_row(right).alias("__row")).agg(F.count(F.lit(1)).cast("int").alias("__n"))
                kinds = kinds.select(F.explode(F.array_distinct("__k")).alias("__k"), "__row", "__n")
                met = asked.join(kinds, "__k").select("__a", "__row", "__n").distinct().select("__a", F.explode(F.array_repeat("__row", F.col("__n"))).alias("__row"))
            else:
                met = asked.join(rows, "__k")
            got = met.groupBy("__a").agg(F.collect_list("__row").alias("__rows"))
            left = df.drop(name).withColumn("__l", c)
            return left.join(got, left["__l"].eqNullSafe(got["__a"]), "left").withColumn(name, F.coalesce("__rows", none)).drop("__l", "__a", "__rows")
        gathered = rows.groupBy("__k").agg(F.collect_list("__row").alias("__rows"))
        left = df.drop(name).withColumn("__l", c)
        out = left.join(gathered, left["__l"].eqNullSafe(gathered["__k"]), "left")
        return out.withColumn(name, F.coalesce("__rows", none)).drop("__l", "__k", "__rows")
    return _correlated(engine, df, spec, right, state)


def _equalities(df: DataFrame, right: DataFrame, spec: dict) -> tuple[list, list]:
    """Splits a leading $match over $expr equalities between let variables and foreign fields from the rest."""
    pipeline, lets = list(spec.get("pipeline", [])), spec.get("let", {})
    pairs, rest = [], []
    if pipeline and set(pipeline[0]) == {"$match"} and set(pipeline[0]["$match"]) == {"$expr"}:
        expr = pipeline[0]["$match"]["$expr"]
        for e in expr["$and"] if isinstance(expr, dict) and "$and" in expr else [expr]:
            sides = e.get("$eq") if isinstance(e, dict) else None
            names = [s[2:] for s in sides if isinstance(s, str) and s.startswith("$$")] if sides else []
            fields = [s[1:] for s in sides if isinstance(s, str) and s.startswith("$") and not s.startswith("$$")] if sides else []
            if len(names) == len(fields) == 1 and names[0] in lets:
                pairs.append((names[0], fields[0]))
            else:
                rest.append(e)
        if pairs:
            pipeline = ([{"$match": {"$expr": {"$and": rest}}}] if rest else []) + pipeline[1:]
    return pairs, pipeline


#: Stages that treat each foreign row alone, so that they may run before the join.
_ROW_STAGES = ("$match", "$project", "$addFields", "$set", "$unset", "$unwind")


def _correlated(engine, df: DataFrame, spec: dict, right: DataFrame | None, state) -> DataFrame:
    """$lookup with let and pipeline: an equality becomes a hash join, what is left its condition."""
    name, lets = spec["as"], spec.get("let", {})
    if right is None:
        right = engine.run(None, spec["pipeline"][:1])
        spec = spec | {"pipeline": spec["pipeline"][1:]}
    k = Compiler(df, state.variables)
    left = df.drop(name)
    bound = {v: (f"__v_{v}", k.kind(e)) for v, e in lets.items()}
    left = left.withColumns({bound[v][0]: k.column(e) for v, e in lets.items()}) if lets else left
    pairs, pipeline = _equalities(df, right, spec)
    uses = "$$" in repr(pipeline) and any("$$" + v in repr(pipeline) for v in lets)
    inner = None
    if not uses and (not pairs or all(next(iter(s)) in _ROW_STAGES for s in pipeline)):
        inner = engine.run(right, pipeline)
        if pairs and not all(f in inner.columns for _, f in pairs):
            inner = None
    if inner is not None:
        # the pipeline doesn't look at the row: it runs once
        if pairs:
            rows = inner.select(*(F.col(quoted(f)).alias(f"__k_{i}") for i, (_, f) in enumerate(pairs)), _foreign_row(inner).alias("__row"))
            gathered = rows.groupBy(*(f"__k_{i}" for i in range(len(pairs)))).agg(F.collect_list("__row").alias("__rows"))
            on = [left[bound[v][0]].eqNullSafe(gathered[f"__k_{i}"]) for i, (v, _) in enumerate(pairs)]
            out = left.join(gathered, on, "left")
        else:
            gathered = inner.agg(F.collect_list(_foreign_row(inner)).alias("__rows"))
            out = left.crossJoin(gathered)  # one row
        none = F.array().cast(out.schema["__rows"].dataType)
        return out.withColumn(name, F.coalesce("__rows", none)).select(*df.drop(name).columns, name)
    # the rest of the pipeline sees let variables as columns beside the foreign row;
    # rows of equal variables get the same, so the variables are the key
    left = left.withColumn("__id", F.struct(*(c for c, _ in bound.values())))
    keys = left.select("__id", *(c for c, _ in bound.values())).distinct()
    if pairs:
        joined = keys.join(right, [keys[bound[v][0]].eqNullSafe(right[f]) for v, f in pairs])
    else:
        joined = keys.join(right, F.lit(True))
    variables = {v: (F.col(c), t) for v, (c, t) in bound.items()}
    own = State(variables=state.variables | variables)
    hidden = ["__id", *(c for c, _ in bound.values())]
    for s in pipeline:
        ((op, body),) = s.items()
        if op == "$match":
            joined = match(joined, body, own.variables)
        elif op in ("$project", "$addFields", "$set"):
            shaped = body | ({c: 1 for c in hidden} if op == "$project" and is_inclusion(body) else {})
            joined = STAGES[op](engine, joined, shaped, own)
        elif op in ("$sort", "$limit"):
            own.sort = body if op == "$sort" else own.sort
            w = Window.partitionBy("__id").orderBy(*(order_columns(Compiler(joined), own.sort) if own.sort else [F.monotonically_increasing_id()]))
            joined = joined.withColumn("__o", F.row_number().over(w))
            joined = joined.where(F.col("__o") <= body) if op == "$limit" else joined
            joined = joined.drop("__o") if op == "$limit" else joined.withColumnRenamed("__o", "__order")
        elif op == "$group":
            keyed = group(joined, body | {"_id": {"__id": "$__id", "k": body["_id"]}}, own.sort, own.variables)
            joined = keyed.withColumn("__id", F.col("_id.__id")).withColumn("_id", F.col("_id.k"))
            hidden = ["__id"]
        elif op == "$count":
            joined = joined.groupBy("__id").agg(F.count(F.lit(1)).alias(body))
            hidden = ["__id"]
        elif op in ("$unwind", "$unset", "$replaceRoot", "$replaceWith", "$lookup"):
            joined = STAGES[op](engine, joined, body, own)
        else:
            raise ExpressionError(f"{op} in a correlated pipeline")
    shown = [c for c in joined.columns if c not in hidden and c != "__order"]
    row = F.struct(*(F.col(quoted(c)) for c in shown))
    if "__order" in joined.columns:
        rows = F.transform(F.array_sort(F.collect_list(F.struct("__order", row.alias("row")))), lambda x: x["row"])
    else:
        rows = F.collect_list(row)
    got = joined.groupBy(F.col("__id").alias("__own")).agg(rows.alias(name))
    out = left.join(got, left["__id"].eqNullSafe(got["__own"]), "left")
    return out.withColumn(name, F.coalesce(F.col(quoted(name)), F.array().cast(got.schema[name].dataType))).select(*df.drop(name).columns, name)


@stage("$lookupUnwind")
def _lookup_unwind(engine, df, spec, state):
    """$lookup and $unwind of its result, fused: a flat join, no arrays."""
    right, name = engine.collection(spec["from"]), spec["as"]
    c, kind = column_at(df, spec["localField"])
    f, fkind = column_at(right, spec["foreignField"])
    rows = right.select(f.alias("__k"), _foreign_row(right).alias(name))
    left = df.drop(name).withColumn("__l", c)
    out = left.join(rows, left["__l"].eqNullSafe(rows["__k"]), "left" if spec.get("preserve") else "inner")
    return out.drop("__l", "__k")


@stage("$graphLookup")
def _graph_lookup(engine, df, spec, state):
    """Breadth-first search for all starts at once, over values alone: each level is one join on the frontier.

    Visited (start, value) pairs are removed by an anti join, so cycles end.
    Each level is cut by a reliable checkpoint. Rows join once, at the end; one
    that several values reach counts at its least depth, equal rows each.
    """
    right = engine.collection(spec["from"])
    if spec.get("restrictSearchWithMatch"):
        right = match(right, spec["restrictSearchWithMatch"])
    k, name = Compiler(df, state.variables), spec["as"]
    (source, skind), (to, tkind) = column_at(right, spec["connectFromField"]), column_at(right, spec["connectToField"])
    opened = lambda c, kind: F.explode(F.array_distinct(c)) if isinstance(kind, T.ArrayType) else c
    values = right.select(to.alias("__t"), opened(source, skind).alias("__from"))
    edges = values.select(opened(F.col("__t"), tkind).alias("__to"), "__from").where("__to is not null and __from is not null").distinct()
    start, kind = k.column(spec["startWith"]), k.kind(spec["startWith"])
    left = df.drop(name).withColumn("__s", start)
    front = left.select("__s").distinct().select("__s", opened(F.col("__s"), kind).alias("__k")).where("__k is not null").distinct()
    deepest, depth, seen = spec.get("maxDepth"), 0, None
    while True:
        if seen is not None:
            front = front.join(seen.select("__s", "__k"), ["__s", "__k"], "left_anti")
        level = checkpointed(front.withColumn("__d", F.lit(depth).cast("long")))
        seen = level if seen is None else seen.unionByName(level)
        if level.isEmpty() or (deepest is not None and depth >= deepest):
            break
        front = level.join(edges, level["__k"] == edges["__to"]).select("__s", F.col("__from").alias("__k")).distinct()
        depth += 1
    nodes = right.groupBy(to.alias("__t"), _foreign_row(right).alias("__row")).agg(F.count(F.lit(1)).cast("int").alias("__n"))
    nodes = nodes.select(opened(F.col("__t"), tkind).alias("__to"), "__row", "__n")
    met = seen.join(nodes, seen["__k"] == nodes["__to"]).groupBy("__s", "__row").agg(F.min("__d").alias("__d"), F.first("__n").alias("__n"))
    row = F.col("__row")
    if spec.get("depthField"):
        row = F.struct(*(F.col(f"__row.{quoted(c)}").alias(c) for c in right.columns), F.col("__d").alias(spec["depthField"]))
    met = met.select("__s", "__d", F.explode(F.array_repeat(row, F.col("__n"))).alias("row"))
    got = met.groupBy(F.col("__s").alias("__of")).agg(F.transform(F.array_sort(F.collect_list(F.struct("__d", "row"))), lambda x: x["row"]).alias(name))
    out = left.join(got, left["__s"].eqNullSafe(got["__of"]), "left")
    return out.withColumn(name, F.coalesce(F.col(quoted(name)), F.array().cast(got.schema[name].dataType))).drop("__s", "__of")


@stage("$unionWith")
def _union_with(engine, df, spec, state):
    spec = {"coll": spec} if isinstance(spec, str) else spec
    other = engine.collection(spec["coll"]) if "coll" in spec else None
    if spec.get("pipeline"):
        other = engine.run(other, spec["pipeline"])
    return df.unionByName(other, allowMissingColumns=True)


@stage("$facet")
def _facet(engine, df, spec, state):
    """One row of arrays: each branch is one aggregate, their one-row results are joined."""
    out = None
    for name, pipeline in spec.items():
        branch = engine.run(df, pipeline)
        one = branch.agg(F.collect_list(_foreign_row(branch)).alias(name))
        out = one if out is None else out.crossJoin(one)
    return out


# windows


def _partition(k: Compiler, spec) -> list[Column]:
    return [] if spec is None else [k.column(spec)]


@stage("$setWindowFields")
def _set_window_fields(engine, df, spec, state):
    k, order = Compiler(df, state.variables), spec.get("sortBy", {})
    by = _partition(k, spec.get("partitionBy"))
    out = {name: window_column(k, by, order, f) for name, f in spec["output"].items()}
    plain = {n: c for n, c in out.items() if "." not in n}
    df = df.withColumns(plain) if plain else df
    for n, c in out.items():
        if "." in n:
            df = with_path(df, n, c)
    return df


@stage("$fill")
def _fill(engine, df, spec, state):
    k, order = Compiler(df, state.variables), spec.get("sortBy", {})
    by = [column_at(df, f)[0] for f in spec["partitionByFields"]] if "partitionByFields" in spec else _partition(k, spec.get("partitionBy"))
    w = Window.partitionBy(*by)
    ordered = w.orderBy(*order_columns(k, order)) if order else w
    new = {}
    for path, how in spec["output"].items():
        c, kind = column_at(df, path)
        if "value" in how:
            new[path] = F.coalesce(c, k.column(how["value"]))
        elif how["method"] == "locf":
            new[path] = F.last(c, ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
        elif how["method"] == "linear":
            x, xkind = column_at(df, next(iter(order)))
            new[path] = linear_fill(c, F.unix_millis(x.cast("timestamp")) if isinstance(xkind, DATES) else x, ordered)
        else:
            raise ExpressionError("the method is locf or linear")
    for path, c in new.items():
        df = with_path(df, path, c)
    return df


@stage("$densify")
def _densify(engine, df, spec, state):
    """Generated rows come from one ``sequence`` per partition and an anti join with what is there."""
    fld, parts, rng = spec["field"], spec.get("partitionByFields", []), spec["range"]
    c, kind = column_at(df, fld)
    step, bounds, unit = rng["step"], rng["bounds"], rng.get("unit")
    dated = isinstance(kind, DATES)
    if dated != bool(unit):
        raise ExpressionError("a unit goes with dates and only with them")
    if dated and unit in ("year", "quarter", "month"):
        by = F.make_interval(months=F.lit(step * {"year": 12, "quarter": 3, "month": 1}[unit]))
    elif dated:
        by = F.expr(f"interval {step * MILLIS[unit]} milliseconds")
    else:
        by = F.lit(step).cast(kind)
    keys = [column_at(df, p)[0].alias(p) for p in parts]
    if bounds == "partition":
        spans = df.where(c.isNotNull()).groupBy(*keys).agg(F.min(c).alias("__lo"), F.max(c).alias("__hi"))
        full = F.sequence("__lo", "__hi", by)
    elif bounds == "full":
        ends = df.agg(F.min(c).alias("__lo"), F.max(c).alias("__hi")).where("__lo is not null")
        spans = df.select(*keys).distinct().crossJoin(ends) if keys else ends  # one row of ends
        full = F.sequence("__lo", "__hi", by)
    else:
        lo, hi = (literal(b).cast(kind) for b in bounds)
        ends = df.sparkSession.range(1).select(lo.alias("__lo"), hi.alias("__hi"))
        spans = df.select(*keys).distinct().crossJoin(ends) if keys else ends
        full = F.filter(F.sequence("__lo", "__hi", by), lambda x: x < F.col("__hi"))
    most = engine.settings["densify_cap"]
    made = spans.select(*(quoted(p) for p in parts), F.explode(F.when(F.size(full) <= most, full).otherwise(F.raise_error(F.lit(f"$densify would make more than {most} rows")).cast(T.ArrayType(kind)))).alias(fld))
    there = df.select(*keys, c.alias(fld)).distinct()
    on = made[quoted(fld)] == there[quoted(fld)]
    for p in parts:
        on = on & made[quoted(p)].eqNullSafe(there[quoted(p)])
    return df.unionByName(made.join(there, on, "left_anti"), allowMissingColumns=True)


# sources, sinks, search


@stage("$documents")
def _documents(engine, df, spec, state):
    return engine.documents(spec)


@stage("$out")
def _out(engine, df, spec, state):
    name = spec if isinstance(spec, str) else spec["coll"]
    engine.catalog.replace(name, df)
    return df.limit(0)


@stage("$merge")
def _merge(engine, df, spec, state):
    engine.catalog.merge(df, {"into": spec} if isinstance(spec, str) else spec)
    return df.limit(0)


@stage("$geoNear")
def _geo_near(engine, df, spec, state):
    return search.geo_near(df, spec, match)


@stage("$vectorSearch")
def _vector_search(engine, df, spec, state):
    df = match(df, spec["filter"]) if spec.get("filter") else df
    return search.vector_search(df, spec["path"], spec["queryVector"], spec["limit"], spec.get("metric", "cosine"))


def _listed(v) -> list:
    return v if isinstance(v, list) else [v]


def _text_query(words: list[str], paths, phrase: bool = False) -> dict:
    return {"$search": " ".join(f'"{w}"' if phrase else w for w in words), "$fields": _listed(paths)}


def _query_string(df: DataFrame, text: str, default: str) -> Column:
    """``a AND b``, ``OR``, ``NOT``, parentheses, ``field:word`` and quoted phrases."""
    tokens, at = re.findall(r'\(|\)|\bAND\b|\bOR\b|\bNOT\b|(?:[\w.]+:)?(?:"[^"]*"|[^\s()]+)', text), 0

    def term() -> Column:
        nonlocal at
        token, at = tokens[at], at + 1
        if token == "NOT":
            return ~term()
        if token == "(":
            out = either()
            at += 1
            return out
        field, _, word = token.rpartition(":") if re.match(r"[\w.]+:", token) else (default, "", token)
        return search.text_filter(df, {"$search": word, "$fields": [field]})

    def both() -> Column:
        nonlocal at
        out = term()
        while at < len(tokens) and tokens[at] not in ("OR", ")"):
            at += tokens[at] == "AND"
            out = out & term()
        return out

    def either() -> Column:
        nonlocal at
        out = both()
        while at < len(tokens) and tokens[at] == "OR":
            at += 1
            out = out | both()
        return out

    return either()


def _clause(df: DataFrame, spec: dict) -> tuple[Column, Column]:
    """(filter, score) of one search operator; operators without a score of their own count 1."""
    ((op, s),) = ((k, v) for k, v in spec.items() if k not in ("index", "count", "facet", "highlight"))
    one = F.lit(1.0)
    if op in ("text", "phrase"):
        q = _text_query(_listed(s["query"]), s["path"], op == "phrase")
        return search.text_filter(df, q), search.text_score(df, q)
    if op == "moreLikeThis":
        likes = [v for d in _listed(s["like"]) for v in d.values() if isinstance(v, str)]
        paths = list(dict.fromkeys(f for d in _listed(s["like"]) for f, v in d.items() if isinstance(v, str)))
        words = sorted({w.lower() for x in likes for w in re.findall(r"\w+", x) if len(w) > 2})
        q = _text_query(words, paths)
        return search.text_filter(df, q), search.text_score(df, q)
    if op == "queryString":
        return _query_string(df, s["query"], s["defaultPath"]), one
    if op == "near":
        c, kind = column_at(df, s["path"])
        away = F.abs((F.unix_millis(c.cast("timestamp")) - F.unix_millis(literal(s["origin"]).cast("timestamp"))) if isinstance(kind, DATES) else c - literal(s["origin"])).cast("double")
        return c.isNotNull(), s["pivot"] / (s["pivot"] + away)
    if op in ("geoWithin", "geoShape"):
        c, kind = column_at(df, s["path"])
        if "circle" in s:
            x, y = search.point(c, kind)
            return F.coalesce(search.spherical(x, y, s["circle"]["center"]["coordinates"]) <= s["circle"]["radius"], F.lit(False)), one
        if "box" in s:
            return search.within(c, kind, {"$box": [s["box"]["bottomLeft"]["coordinates"], s["box"]["topRight"]["coordinates"]]}), one
        inside = search.within if op == "geoWithin" or s.get("relation") == "within" else search.intersects
        hit = inside(c, kind, {"$geometry": s["geometry"]})
        return (~hit if s.get("relation") == "disjoint" else hit), one
    if op == "embeddedDocument":
        c, kind = column_at(df, s["path"])
        inner = s["operator"]
        cut = lambda q: {k: (v[len(s["path"]) + 1 :] if k == "path" else v) for k, v in q.items()}
        ((iop, body),) = inner.items()
        query = _PLAIN[iop](cut(body))
        return F.exists(c, lambda x: element_test(df, x, kind.elementType, query)), one
    if op == "compound":
        must, no, some = [_clause(df, c) for c in s.get("must", [])], [_clause(df, c) for c in s.get("mustNot", [])], [_clause(df, c) for c in s.get("should", [])]
        hit, score = F.lit(True), F.lit(0.0)
        for f, points in must:
            hit, score = hit & f, score + points
        for f, _ in [_clause(df, c) for c in s.get("filter", [])]:
            hit = hit & f
        for f, _ in no:
            hit = hit & ~F.coalesce(f, F.lit(False))
        if some:
            met = [F.coalesce(f, F.lit(False)) for f, _ in some]
            least = s.get("minimumShouldMatch", 0 if s.get("must") or s.get("filter") else 1)
            hit = hit & (sum((m.cast("int") for m in met), F.lit(0)) >= least)
            for m, (_, points) in zip(met, some, strict=True):
                score = score + F.when(m, points).otherwise(0.0)
        return hit, score
    if op in _PLAIN:
        return compile_query(df, _PLAIN[op](s)), one
    raise ExpressionError(f"unknown search operator {op}")


_PLAIN = {
    "equals": lambda s: {s["path"]: s["value"]},
    "exists": lambda s: {s["path"]: {"$exists": True}},
    "in": lambda s: {s["path"]: {"$in": s["value"]}},
    "range": lambda s: {s["path"]: {f"${x}": s[x] for x in ("gt", "gte", "lt", "lte") if x in s}},
    "regex": lambda s: {s["path"]: {"$regex": s["query"]}},
    "wildcard": lambda s: {s["path"]: {"$regex": "^" + s["query"].replace("*", ".*").replace("?", ".") + "$"}},
    "autocomplete": lambda s: {s["path"]: {"$regex": rf"(?i)\b{s['query']}"}},
}


@stage("$search")
def _search(engine, df, spec, state):
    if "cosmosSearch" in spec or "knnBeta" in spec:
        s = spec.get("cosmosSearch") or spec["knnBeta"]
        df = match(df, s["filter"]) if s.get("filter") else df
        return search.vector_search(df, s["path"], s["vector"], s.get("k", 10), s.get("metric", "cosine"))
    hit, score = _clause(df, spec)
    out = df.where(hit).withColumn("__search_score", score)
    scored = {"text", "phrase", "near", "moreLikeThis", "compound"} & set(spec)
    return out.orderBy(F.desc("__search_score")) if scored else out


@stage("$searchMeta")
def _search_meta(engine, df, spec, state):
    """One row: the number of matches, and with ``facet`` the counts of each facet's values or ranges."""
    plain = spec["facet"].get("operator") if "facet" in spec else spec
    hit = df.where(_clause(df, plain)[0]) if plain else df
    out = hit.agg(F.struct(F.count(F.lit(1)).alias("total")).alias("count"))
    for name, f in spec.get("facet", {}).get("facets", {}).items():
        c, _ = column_at(hit, f["path"])
        if f["type"] == "string":
            top = hit.where(c.isNotNull()).groupBy(c.alias("_id")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "_id").limit(f.get("numBuckets", 10))
        else:
            key = {"$_bucketInternal": {"groupBy": "$" + f["path"], "boundaries": f["boundaries"]} | ({"default": f["default"]} if "default" in f else {})}
            inside = (c >= literal(f["boundaries"][0])) & (c < literal(f["boundaries"][-1]))
            top = group(hit.where(c.isNotNull() if "default" in f else inside), {"_id": key, "count": {"$sum": 1}})
        rows = top.agg(F.sort_array(F.collect_list(F.struct("_id", "count"))).alias(name))
        out = out.crossJoin(rows)  # one row on either side
    names = list(spec.get("facet", {}).get("facets", {}))
    return out.select("count", F.struct(*names).alias("facet")) if names else out


@stage("$inverseMatch")
def _inverse_match(engine, df, spec, state):
    """Rows whose stored query (JSON text at ``path``) matches ``input``.

    Stored queries are data, so each distinct one is evaluated in a worker.
    """
    import json

    given = spec["input"] if isinstance(spec["input"], list) else [spec["input"]]
    default = bool(spec.get("defaultResult", False))

    def run(queries: pd.Series) -> pd.Series:
        from .inverse import matches

        known: dict = {}
        for q in queries.dropna().unique():
            known[q] = any(matches(json.loads(q), d) for d in given)
        return queries.map(lambda q: known.get(q, default))

    c, kind = column_at(df, spec["path"])
    text = c if isinstance(kind, T.StringType) else F.to_json(c)
    return df.where(F.pandas_udf(run, "boolean")(text))


@stage("$collStats")
def _coll_stats(engine, df, spec, state):
    return df.agg(F.count(F.lit(1)).alias("count"), F.coalesce(F.sum(F.octet_length(F.to_json(_foreign_row(df)))), F.lit(0)).alias("size"))


@stage("$indexStats", "$listSearchIndexes")
def _index_stats(engine, df, spec, state):
    return engine.catalog.index_frame()


@stage("$currentOp", "$listSessions", "$listLocalSessions")
def _current_op(engine, df, spec, state):
    tracker = engine.spark.sparkContext.statusTracker()
    rows = [(int(j), "active") for j in tracker.getActiveJobsIds()]
    return engine.spark.createDataFrame(rows, "opid long, state string")


@stage("$changeStream")
def _change_stream(engine, df, spec, state):
    raise ExpressionError("$changeStream is a streaming source: see streaming.changes")


@stage("$_internalInhibitOptimization")
def _fence(engine, df, spec, state):
    return df


__all__ = ["NUMERIC", "STAGES", "State", "add_fields", "group", "match", "project", "replace_root", "sort", "stage"]
