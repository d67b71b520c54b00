"""Field paths and type questions shared by the compilers.

Documents are rows of typed columns. A path that a schema doesn't have is a
missing field: null. A path through an array of documents gives the array of
that field, as in the document model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
FLOATING = (T.FloatType, T.DoubleType)
DATES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def type_at(kind: T.DataType, parts: list[str]) -> T.DataType | None:
    """The type of a path under ``kind``; None when it is missing."""
    for i, p in enumerate(parts):
        if isinstance(kind, T.ArrayType):
            if p.isdigit():
                kind = kind.elementType
                continue
            inner = type_at(kind.elementType, parts[i:])
            return None if inner is None else T.ArrayType(inner)
        if isinstance(kind, T.MapType):
            kind = kind.valueType
            continue
        if not isinstance(kind, T.StructType) or p not in kind.names:
            return None
        kind = kind[p].dataType
    return kind


def step_into(c: Column, kind: T.DataType, parts: list[str]) -> Column:
    """The value at a path under ``c``, whose type is ``kind`` and has that path."""
    for i, p in enumerate(parts):
        if isinstance(kind, T.ArrayType):
            if p.isdigit():
                c, kind = F.get(c, F.lit(int(p))), kind.elementType
                continue
            element, rest = kind.elementType, parts[i:]
            return F.transform(c, lambda x: step_into(x, element, rest))  # noqa: B023  it returns at once
        if isinstance(kind, T.MapType):
            c, kind = F.try_element_at(c, F.lit(p)), kind.valueType
            continue
        c, kind = c.getField(p), kind[p].dataType
    return c


def column_at(df: DataFrame, path: str) -> tuple[Column, T.DataType | None]:
    """(column, type) of a path; a null column and None when it is missing."""
    if path in df.columns:
        return F.col(quoted(path)), df.schema[path].dataType
    parts = path.split(".")
    if parts[0] not in df.columns:
        return F.lit(None), None
    kind = df.schema[parts[0]].dataType
    found = type_at(kind, parts[1:])
    if found is None:
        return F.lit(None), None
    return step_into(F.col(quoted(parts[0])), kind, parts[1:]), found


def with_path(df: DataFrame, path: str, value: Column) -> DataFrame:
    """``df`` with the field at ``path`` set; parents are made where missing."""
    head, _, rest = path.partition(".")
    if not rest:
        return df.withColumn(head, value)
    kind = df.schema[head].dataType if head in df.columns else None
    return df.withColumn(head, _set_in(F.col(quoted(head)) if kind is not None else F.lit(None), kind, rest.split("."), value))


def _set_in(c: Column, kind: T.DataType | None, parts: list[str], value: Column) -> Column:
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return F.transform(c, lambda x: _set_in(x, kind.elementType, parts, value))
    if not isinstance(kind, T.StructType):
        inner = value if len(parts) == 1 else _set_in(F.lit(None), None, parts[1:], value)
        return F.struct(inner.alias(parts[0]))
    own = {f.name: c.getField(f.name) for f in kind.fields}
    sub = kind[parts[0]].dataType if parts[0] in kind.names else None
    own[parts[0]] = value if len(parts) == 1 else _set_in(own.get(parts[0], F.lit(None)), sub, parts[1:], value)
    return F.struct(*(v.alias(k) for k, v in own.items()))


def without_path(df: DataFrame, path: str) -> DataFrame:
    """``df`` without the field at ``path``; absent fields are no error."""
    head, _, rest = path.partition(".")
    if head not in df.columns:
        return df
    if not rest:
        return df.drop(F.col(quoted(head)))
    kind = df.schema[head].dataType
    if type_at(kind, rest.split(".")) is None:
        return df
    return df.withColumn(head, _drop_in(F.col(quoted(head)), kind, rest.split(".")))


def _drop_in(c: Column, kind: T.DataType, parts: list[str]) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _drop_in(x, kind.elementType, parts))
    if len(parts) == 1:
        if len(kind.names) == 1:
            return F.lit(None)
        return c.dropFields(quoted(parts[0]))
    sub = _drop_in(c.getField(parts[0]), kind[parts[0]].dataType, parts[1:])
    return c.withField(quoted(parts[0]), sub)


def order_key(c: Column, kind: T.DataType | None) -> Column:
    """A sort key in document order: null, NaN, then values; arrays by their least element."""
    if isinstance(kind, T.ArrayType):
        c, kind = F.array_min(c), kind.elementType
    if isinstance(kind, FLOATING):
        return F.when(c.isNotNull(), F.struct((~F.isnan(c)).alias("number"), c.alias("value")))
    return c
