"""Readers and writers beside Parquet: JSON, extended JSON with type tags, BSON dumps and hex text.

Type tags are taken off the text by patterns before ``from_json`` reads it. A
tag's opening brace is followed by a bare quote, which inside a string would end
the string, so tags are never found inside of strings. Empty files give no rows,
malformed lines a row of nulls.
"""

from __future__ import annotations

import base64
import json
import struct
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json(spark: SparkSession, path: str, schema=None, array: bool = False) -> DataFrame:
    """JSON lines, or one JSON array in a file (gzip by suffix)."""
    r = spark.read.option("multiLine", str(array).lower())
    return (r.schema(schema) if schema else r).json(path)


def read_variant(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of mixed types as one VARIANT column ``doc``."""
    return spark.read.text(path).select(F.parse_json("value").alias("doc"))


def variant_field(doc, path: str, kind: str):
    """A typed field of a VARIANT document; null when missing or of another type."""
    return F.try_variant_get(doc, "$." + path, kind)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def _tag(name: str, value: str) -> str:
    return rf'\{{\s*"\${name}"\s*:\s*{value}\s*\}}'


_NUMBER = r'"(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)"'
_STRING = r'("[^"\\]*")'

#: Fixed values of the format: each tag's pattern and what stays of it, inner tags first.
TAGS = (
    (_tag("number(?:Int|Long|Double|Decimal)", _NUMBER), "$1"),
    (_tag("number(?:Double|Decimal)", r'("(?:NaN|-?Infinity)")'), "$1"),
    (_tag("date", r"(-?[0-9]+)"), '"$1"'),
    (_tag("(?:date|oid|uuid|symbol)", _STRING), "$1"),
    (_tag("binary", rf'\{{\s*"base64"\s*:\s*{_STRING}\s*,\s*"subType"\s*:\s*"[0-9a-fA-F]*"\s*\}}'), "$1"),
    (_tag("timestamp", r"(\{[^{}]*\})"), "$1"),
    (_tag("undefined", "true"), "null"),
)


def without_tags(text: Column) -> Column:
    """Extended JSON as plain JSON: numbers bare, ids and binaries as strings, dates as ISO text or milliseconds."""
    for pattern, rest in TAGS:
        text = F.regexp_replace(text, pattern, rest)
    return text


_EPOCH = "timestamp_ntz'1970-01-01'"


def _dates_as_text(t: T.DataType) -> T.DataType:
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return T.StringType()
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _dates_as_text(f.dataType)) for f in t])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_dates_as_text(t.elementType))
    if isinstance(t, T.MapType):
        return T.MapType(t.keyType, _dates_as_text(t.valueType))
    return t


def _with_dates(c: Column, t: T.DataType) -> Column:
    """The inverse, of values: ISO text or milliseconds become timestamps."""
    if isinstance(t, T.TimestampType):
        return F.coalesce(F.timestamp_millis(c.try_cast("long")), c.try_cast("timestamp"))
    if isinstance(t, T.TimestampNTZType):  # in UTC
        return F.coalesce(F.timestamp_add("MILLISECOND", c.try_cast("long"), F.expr(_EPOCH)), c.try_cast("timestamp_ntz"))
    if isinstance(t, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(_with_dates(c[f.name], f.dataType).alias(f.name) for f in t)))
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: _with_dates(x, t.elementType))
    if isinstance(t, T.MapType):
        return F.transform_values(c, lambda _, x: _with_dates(x, t.valueType))
    return c


def _schema(schema) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def from_extended_json(text: Column, schema) -> Column:
    """A struct of ``schema`` from extended JSON, canonical or relaxed."""
    t = _schema(schema)
    return _with_dates(F.from_json(without_tags(text), _dates_as_text(t)), t)


def read_extended_json(spark: SparkSession, path: str, schema, array: bool = False) -> DataFrame:
    """Extended JSON lines, or one array a file (gzip by suffix), read as ``schema``."""
    lines = spark.read.text(path, wholetext=array)
    t = _schema(schema)
    if array:
        docs = lines.select(F.explode(F.from_json(without_tags(F.col("value")), T.ArrayType(_dates_as_text(t)))).alias("doc"))
        return docs.select(_with_dates(F.col("doc"), t).alias("doc")).select("doc.*")
    return lines.select(from_extended_json(F.col("value"), t).alias("doc")).select("doc.*")


def _tagged(c: Column, t: T.DataType) -> Column:
    def tag(name: str, value: Column) -> Column:
        return F.when(c.isNotNull(), F.struct(value.alias(name)))

    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
        return tag("$numberInt", c.cast("string"))
    if isinstance(t, T.LongType):
        return tag("$numberLong", c.cast("string"))
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return tag("$numberDouble", c.cast("string"))
    if isinstance(t, T.DecimalType):
        return tag("$numberDecimal", c.cast("string"))
    if isinstance(t, T.TimestampType):
        return tag("$date", F.struct(F.unix_millis(c).cast("string").alias("$numberLong")))
    if isinstance(t, T.TimestampNTZType):
        return tag("$date", F.struct(F.timestamp_diff("MILLISECOND", F.expr(_EPOCH), c).cast("string").alias("$numberLong")))
    if isinstance(t, T.BinaryType):
        return tag("$binary", F.struct(F.base64(c).alias("base64"), F.lit("00").alias("subType")))
    if isinstance(t, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(_tagged(c[f.name], f.dataType).alias(f.name) for f in t)))
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: _tagged(x, t.elementType))
    if isinstance(t, T.MapType):
        return F.transform_values(c, lambda _, x: _tagged(x, t.valueType))
    return c


def to_extended_json(df: DataFrame) -> DataFrame:
    """Each row as canonical extended JSON in ``value``; null fields go, dates keep milliseconds."""
    return df.select(F.to_json(F.struct(*(_tagged(df[f"`{f.name}`"], f.dataType).alias(f.name) for f in df.schema))).alias("value"))


def write_extended_json(df: DataFrame, path: str, **options) -> None:
    to_extended_json(df).write.mode("overwrite").options(**options).text(path)


def decimal128(raw: bytes, at: int) -> str:
    """The text of a 128-bit decimal in the binary integer encoding."""
    low, high = struct.unpack_from("<QQ", raw, at)
    sign, top = high >> 63, high >> 58 & 31
    if top == 31:
        return "NaN"
    if top == 30:
        return "-Infinity" if sign else "Infinity"
    if top >> 3 == 3:  # a coefficient beyond 34 digits stands for zero
        exponent, digits = high >> 47 & 0x3FFF, 0
    else:
        exponent, digits = high >> 49 & 0x3FFF, (high & (1 << 49) - 1) << 64 | low
    return str(Decimal((sign, tuple(map(int, str(digits))), exponent - 6176)))


def bson_value(kind: int, raw: bytes, at: int):
    """(value, next position) of one BSON value."""
    if kind == 1:
        return struct.unpack_from("<d", raw, at)[0], at + 8
    if kind in (2, 13, 14):
        n = struct.unpack_from("<i", raw, at)[0]
        return raw[at + 4 : at + 3 + n].decode(), at + 4 + n
    if kind in (3, 4):
        n = struct.unpack_from("<i", raw, at)[0]
        d = bson_document(raw[at : at + n])
        return (list(d.values()) if kind == 4 else d), at + n
    if kind == 5:
        n = struct.unpack_from("<i", raw, at)[0]
        return {"$binary": {"base64": base64.b64encode(raw[at + 5 : at + 5 + n]).decode(), "subType": f"{raw[at + 4]:02x}"}}, at + 5 + n
    if kind == 7:
        return raw[at : at + 12].hex(), at + 12
    if kind == 8:
        return bool(raw[at]), at + 1
    if kind == 9:
        return {"$date": struct.unpack_from("<q", raw, at)[0]}, at + 8
    if kind in (6, 10, 127, 255):
        return None, at
    if kind == 11:
        mid = raw.index(0, at)
        end = raw.index(0, mid + 1)
        return {"pattern": raw[at:mid].decode(), "options": raw[mid + 1 : end].decode()}, end + 1
    if kind == 19:
        return {"$numberDecimal": decimal128(raw, at)}, at + 16
    if kind == 16:
        return struct.unpack_from("<i", raw, at)[0], at + 4
    if kind in (17, 18):
        return struct.unpack_from("<q", raw, at)[0], at + 8
    raise ValueError(f"BSON type {kind}")


def bson_document(raw: bytes) -> dict:
    out, at = {}, 4
    while raw[at]:
        kind, end = raw[at], raw.index(0, at + 1)
        name = raw[at + 1 : end].decode()
        out[name], at = bson_value(kind, raw, end + 1)
    return out


def _documents(contents: DataFrame, schema) -> DataFrame:
    """Documents of a binary column ``content`` that holds them one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for content in b[0]:
                raw, at = content.as_py() or b"", 0
                while at < len(raw):
                    n = struct.unpack_from("<i", raw, at)[0]
                    if n < 5 or at + n > len(raw):
                        raise ValueError(f"a BSON document of {n} bytes at {at} of {len(raw)}")
                    out.append(json.dumps(bson_document(raw[at : at + n])))
                    at += n
                    if len(out) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["json"])
                        out = []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["json"])

    return contents.select("content").mapInArrow(run, "json string").select(from_extended_json(F.col("json"), schema).alias("doc")).select("doc.*")


def read_bson(spark: SparkSession, path: str, schema) -> DataFrame:
    """Dump files (documents one after another), a file per task, parsed with ``schema``."""
    return _documents(spark.read.format("binaryFile").load(path), schema)


def read_bson_hex(spark: SparkSession, path: str, schema, prefix: str = "BSONHEX") -> DataFrame:
    """A document a line as hex digits, after ``prefix`` or without it; lines that aren't hex give no row."""
    digits = F.regexp_replace(F.trim("value"), "^" + prefix, "")
    return _documents(spark.read.text(path).select(F.unhex(digits).alias("content")), schema)


def encoded_decimal128(text: str) -> bytes:
    """The inverse of ``decimal128`` for up to 34 digits."""
    d = Decimal(text)
    sign, digits, exponent = d.as_tuple()
    if not d.is_finite():
        return struct.pack("<QQ", 0, (31 if d.is_nan() else 30) << 58 | sign << 63)
    if len(digits) > 34 or not -6176 <= exponent <= 6111:
        raise ValueError(f"{text} is beyond 34 digits or the exponents of a 128-bit decimal")
    n = int("".join(map(str, digits)))
    return struct.pack("<QQ", n & (1 << 64) - 1, sign << 63 | exponent + 6176 << 49 | n >> 64)


def encoded_value(v) -> tuple[int, bytes]:
    """(BSON type, bytes) of a value of parsed canonical extended JSON."""
    if v is None:
        return 10, b""
    if isinstance(v, bool):
        return 8, bytes([v])
    if isinstance(v, str):
        raw = v.encode()
        return 2, struct.pack("<i", len(raw) + 1) + raw + b"\0"
    if isinstance(v, list):
        return 4, encoded_document({str(i): x for i, x in enumerate(v)})
    if isinstance(v, dict) and len(v) == 1:
        name, x = next(iter(v.items()))
        if name == "$numberInt":
            return 16, struct.pack("<i", int(x))
        if name == "$numberLong":
            return 18, struct.pack("<q", int(x))
        if name == "$numberDouble":
            return 1, struct.pack("<d", float(x))
        if name == "$numberDecimal":
            return 19, encoded_decimal128(x)
        if name == "$date":
            return 9, struct.pack("<q", int(x["$numberLong"]))
        if name == "$oid":
            return 7, bytes.fromhex(x)
        if name == "$binary":
            raw = base64.b64decode(x["base64"])
            return 5, struct.pack("<i", len(raw)) + bytes.fromhex(x["subType"]) + raw
    if isinstance(v, dict):
        return 3, encoded_document(v)
    raise ValueError(f"{type(v).__name__} isn't canonical extended JSON")


def encoded_document(d: dict) -> bytes:
    parts = []
    for name, v in d.items():
        kind, raw = encoded_value(v)
        parts.append(bytes([kind]) + name.encode() + b"\0" + raw)
    body = b"".join(parts)
    return struct.pack("<i", len(body) + 5) + body + b"\0"


def to_bson(df: DataFrame) -> DataFrame:
    """Each row as one BSON document in ``content``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([encoded_document(json.loads(x.as_py())) for x in b[0]], pa.binary())], names=["content"])

    return to_extended_json(df).mapInArrow(run, "content binary")


def from_bson(contents: DataFrame, schema) -> DataFrame:
    """The rows of ``schema`` in a column ``content`` of BSON documents."""
    return _documents(contents, schema)
