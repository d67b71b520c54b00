"""Shared plumbing: table access, shared scratch space, Arrow row mapping."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir, ship

#: ASCII white space, the word separator of every operator here.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

#: Rows handed to a Python worker at once. Texts may hold a hundred thousand
#: characters, so the batch is kept small enough for a worker's memory.
BATCH_ROWS = 400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later steps then depend on committed files and not on any executor. The
    files go when ``discard`` is called or the driver ends.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path, compression="zstd")
    until_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def until_exit(spark: SparkSession, path: str) -> None:
    """Have a folder deleted when the driver's JVM ends; it is made if it isn't there."""
    fs, p = _path(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``cut`` returned and nothing reads any more."""
    for t in tables:
        fs, p = _path(t.sparkSession, t._cut_path)
        fs.delete(p, True)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows of an Arrow batch unless the session already set a bound."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def map_rows(df: DataFrame, row: Callable, schema: pa.Schema, ddl: str, state: Callable | None = None) -> DataFrame:
    """``mapInArrow`` with one output tuple for each input row.

    ``row(*values)`` gets the values of the input columns; with ``state`` it
    gets ``state()``, made once in each task, ahead of them.
    """
    small_batches(df.sparkSession)
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = (state(),) if state else ()
        for batch in batches:
            if batch.num_rows:
                out = [row(*made, *values) for values in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return df.mapInArrow(run, ddl)


def words(text):
    """Words of a text as a Column: runs without ASCII white space."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def bit_filter(value: Column, df: DataFrame, bits: int) -> np.ndarray:
    """Which of ``bits`` (a power of two) values ``value`` takes, as packed bits, least first.

    Built by Spark's bitmap aggregates: bits / 32768 rows of 4 KB come to the driver.
    """
    at = F.pmod(value, F.lit(bits)) + 1
    rows = df.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[(r["part"] - 1) * 4096 : r["part"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def bits_set(filter_: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each of the values ``at`` is in a filter made by ``bit_filter``."""
    return ((filter_[at >> 3] >> (at & 7).astype(np.uint8)) & 1) != 0
