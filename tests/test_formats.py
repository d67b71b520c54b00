import datetime
import gzip
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrace.sources import formats

UTC = datetime.timezone.utc


def parsed(spark, text, schema):
    return spark.createDataFrame([(text,)], "j string").select(formats.from_extended_json(F.col("j"), schema).alias("d")).select("d.*").first()


def test_tags_of_both_modes(spark):
    text = '{"_id": {"$oid": "0123456789abcdef01234567"}, "n": {"$numberLong": "-5"}, "i": {"$numberInt":"7"}, "d": {"$numberDecimal": "1.50"}, "f": {"$numberDouble": "-Infinity"}, "at": {"$date": {"$numberLong": "1500"}}, "iso": {"$date": "1970-01-01T00:00:02.5Z"}, "b": {"$binary": {"base64": "aGk=", "subType": "00"}}, "u": {"$undefined": true}, "l": [{"$numberInt": "1"}, 2]}'
    row = parsed(spark, text, "_id string, n long, i int, d decimal(10,2), f double, at timestamp_ntz, iso timestamp_ntz, b binary, u int, l array<int>")
    assert row._id == "0123456789abcdef01234567" and (row.n, row.i, row.d, row.f) == (-5, 7, Decimal("1.50"), float("-inf"))
    assert row["at"] == datetime.datetime(1970, 1, 1, 0, 0, 1, 500000) and row.iso == datetime.datetime(1970, 1, 1, 0, 0, 2, 500000)
    assert bytes(row.b) == b"hi" and row.u is None and row.l == [1, 2]


def test_tags_in_strings_stay(spark):
    text = '{"s": "{\\"$numberInt\\": \\"7\\"} {", "t": "{"}'
    row = parsed(spark, text, "s string, t string")
    assert row.s == '{"$numberInt": "7"} {' and row.t == "{"


def test_arrays_lines_and_broken_rows(spark, tmp_path):
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        f.write('[{"a": {"$numberInt": "1"}},\n {"a": 2}]')
    assert sorted(r.a for r in formats.read_extended_json(spark, f"file://{tmp_path}/a.json.gz", "a int", array=True).collect()) == [1, 2]
    (tmp_path / "l.json").write_text('{"a": {"$numberInt": "1"}}\nbroken\n')
    assert sorted((r.a for r in formats.read_extended_json(spark, f"file://{tmp_path}/l.json", "a int").collect()), key=str) == [1, None]
    (tmp_path / "e.json").write_text("")
    assert formats.read_extended_json(spark, f"file://{tmp_path}/e.json", "a int").count() == 0


@pytest.mark.parametrize("form", ["json", "bson"])
def test_round_trip_of_types(spark, form):
    schema = "i int, l long, f double, d decimal(38,10), s string, b binary, t boolean, at timestamp, n timestamp_ntz, a array<struct<x:long,y:timestamp>>, o struct<`p.q`:int>, m map<string,long>"
    rows = [
        (1, 2**60, 1.5, Decimal("-12345678901234567890.0000000001"), 'q"\\{é', b"\x00\xff", True, datetime.datetime(2020, 2, 29, 1, 2, 3, 4000), datetime.datetime(1901, 1, 1), [(1, datetime.datetime(2000, 1, 1)), (None, None)], (5,), {"k": 9}),
        (None,) * 12,
        (-1, -1, float("inf"), Decimal(0), "", b"", False, datetime.datetime(1969, 12, 31), datetime.datetime(9999, 12, 31), [], (None,), {}),
    ]
    df = spark.createDataFrame(rows, schema)
    back = formats.from_bson(formats.to_bson(df), df.schema) if form == "bson" else formats.to_extended_json(df).select(formats.from_extended_json(F.col("value"), df.schema).alias("d")).select("d.*")
    got, want = ([tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in x.collect()] for x in (back, df))
    assert got == want
    assert back.schema.simpleString() == df.schema.simpleString()


def test_bson_hex_and_decimals(spark, tmp_path):
    raw = formats.encoded_document({"a": {"$numberDecimal": "1.20E+3"}, "b": {"$numberInt": "3"}})
    (tmp_path / "h.txt").write_text(f"BSONHEX{raw.hex()}\n{raw.hex().upper()}\n\nzz\n")
    assert [tuple(r) for r in formats.read_bson_hex(spark, f"file://{tmp_path}/h.txt", "a decimal(10,1), b int").collect()] == [(Decimal("1200.0"), 3)] * 2
    for text in ("0", "-1", "1.20E+3", "9999999999999999999999999999999999", "-1E-6176", "1E+6111", "NaN", "Infinity", "-Infinity"):
        assert formats.decimal128(formats.encoded_decimal128(text), 0) == text
    # 1 in the binary integer encoding
    assert formats.encoded_decimal128("1").hex() == "01000000000000000000000000004030"
    with pytest.raises(ValueError):
        formats.encoded_decimal128("1" * 35)
