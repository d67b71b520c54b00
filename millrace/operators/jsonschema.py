"""$jsonSchema as a boolean Column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import ExpressionError, literal, type_name
from ..functions.paths import NUMERIC

REJECTED = ("$ref", "$schema", "default", "definitions", "format", "id")
_JSON_TYPES = {"number": {"int", "long", "double", "decimal"}, "boolean": {"bool"}, "integer": {"int", "long"}}


def _names(value) -> set[str]:
    out: set[str] = set()
    for v in value if isinstance(value, list) else [value]:
        out |= _JSON_TYPES.get(v, {v})
    return out


def check(c: Column, kind: T.DataType | None, schema: dict) -> Column:
    """Whether a present value obeys ``schema``; keywords of other types don't bind it."""
    for k in schema:
        if k in REJECTED:
            raise ExpressionError(f"$jsonSchema keyword {k} isn't supported")
    out = F.lit(True)
    name = type_name(kind)
    for k in ("bsonType", "type"):
        if k in schema:
            out = out & F.lit(name in _names(schema[k]))
    if "enum" in schema:
        same = [v for v in schema["enum"] if v is not None and not isinstance(v, (dict, list)) and isinstance(v, str) == isinstance(kind, T.StringType)]
        out = out & (c.isin(same) if same else F.lit(False))
    for k, join in (("allOf", lambda xs: sum(xs, F.lit(0)) == len(xs)), ("anyOf", lambda xs: sum(xs, F.lit(0)) > 0), ("oneOf", lambda xs: sum(xs, F.lit(0)) == 1)):
        if k in schema:
            out = out & join([F.coalesce(check(c, kind, s), F.lit(False)).cast("int") for s in schema[k]])
    if "not" in schema:
        out = out & ~F.coalesce(check(c, kind, schema["not"]), F.lit(False))
    if isinstance(kind, NUMERIC):
        if "multipleOf" in schema:
            out = out & (c % literal(schema["multipleOf"]) == 0)
        if "maximum" in schema:
            out = out & (c < literal(schema["maximum"]) if schema.get("exclusiveMaximum") else c <= literal(schema["maximum"]))
        if "minimum" in schema:
            out = out & (c > literal(schema["minimum"]) if schema.get("exclusiveMinimum") else c >= literal(schema["minimum"]))
    if isinstance(kind, T.StringType):
        if "maxLength" in schema:
            out = out & (F.length(c) <= schema["maxLength"])
        if "minLength" in schema:
            out = out & (F.length(c) >= schema["minLength"])
        if "pattern" in schema:
            out = out & F.regexp_like(c, F.lit(schema["pattern"]))
    if isinstance(kind, T.ArrayType):
        if "maxItems" in schema:
            out = out & (F.size(c) <= schema["maxItems"])
        if "minItems" in schema:
            out = out & (F.size(c) >= schema["minItems"])
        if schema.get("uniqueItems"):
            out = out & (F.size(F.array_distinct(c)) == F.size(c))
        items, element = schema.get("items"), kind.elementType
        if isinstance(items, dict):
            out = out & F.forall(c, lambda x: x.isNull() | check(x, element, items))
        elif isinstance(items, list):
            for i, s in enumerate(items):
                out = out & ((F.size(c) <= i) | check(F.get(c, F.lit(i)), element, s))
            rest = schema.get("additionalItems", True)
            if rest is False:
                out = out & (F.size(c) <= len(items))
            elif isinstance(rest, dict):
                out = out & F.forall(F.slice(c, F.lit(len(items) + 1), F.greatest(F.size(c), F.lit(1))), lambda x: check(x, element, rest))
    if isinstance(kind, T.StructType):
        out = out & _object({f.name: (c[f.name], f.dataType) for f in kind.fields}, schema)
    return out


def _object(fields: dict, schema: dict) -> Column:
    out = F.lit(True)
    for name in schema.get("required", []):
        out = out & (fields[name][0].isNotNull() if name in fields else F.lit(False))
    for name, sub in schema.get("properties", {}).items():
        if name in fields:
            c, kind = fields[name]
            out = out & (c.isNull() | check(c, kind, sub))
    if schema.get("additionalProperties") is False:
        for name in set(fields) - set(schema.get("properties", {})):
            out = out & fields[name][0].isNull()
    if "minProperties" in schema or "maxProperties" in schema:
        n = sum((c.isNotNull().cast("int") for c, _ in fields.values()), F.lit(0))
        out = out & (n >= schema.get("minProperties", 0)) & (n <= schema.get("maxProperties", len(fields)))
    for name, needs in schema.get("dependencies", {}).items():
        if name in fields and isinstance(needs, list):
            for other in needs:
                out = out & (fields[name][0].isNull() | (fields[other][0].isNotNull() if other in fields else F.lit(False)))
    return out


def valid(df: DataFrame, schema: dict) -> Column:
    """Whether a row obeys a schema for documents."""
    own = {k: v for k, v in schema.items() if k not in ("bsonType", "type")}
    if "object" not in _names(schema.get("bsonType", schema.get("type", "object"))):
        return F.lit(False)
    nested = [k for k in ("allOf", "anyOf", "oneOf", "not") if k in own]
    out = _object({f.name: (F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields}, own)
    for k in nested:
        parts = [F.coalesce(valid(df, s), F.lit(False)).cast("int") for s in (own[k] if k != "not" else [own[k]])]
        total = sum(parts, F.lit(0))
        out = out & {"allOf": total == len(parts), "anyOf": total > 0, "oneOf": total == 1, "not": total == 0}[k]
    return F.coalesce(out, F.lit(False))
