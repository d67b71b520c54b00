"""Ranks of values in groups of any size, and the exact percentiles that they give.

Rows are counted by distinct value first. The histogram is dealt by ranges of
its values, so a large group lies in many tasks; sums of whole ranges tell how
many rows of the group come before each range.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import checkpointed


def dealt(hist: DataFrame, *by: str) -> DataFrame:
    """``hist`` in ranges of ``by``, with the number ``__p`` of each row's range, nulls first.

    It is cut from its lineage: ranges come from samples, and must not change
    between the two times that they are read.
    """
    return checkpointed(hist.repartitionByRange(*(F.asc_nulls_first(b) for b in by)).withColumn("__p", F.spark_partition_id()))


def percentiles(df: DataFrame, key: Column, value: Column, wanted: dict[str, list[float]]) -> DataFrame:
    """``__key`` and, for each name, the observed values at ranks ceil(p * n) of the group's n values.

    Groups without any value have no row.
    """
    hist = df.where(value.isNotNull()).groupBy(key.alias("__key"), value.alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    rows = dealt(hist, "__key", "__v")
    ranges = Window.partitionBy("__key").orderBy("__p")
    sums = rows.groupBy("__key", "__p").agg(F.sum("__n").alias("__s"))
    sums = sums.select("__key", "__p", (F.sum("__s").over(ranges.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__s")).alias("__before"), F.sum("__s").over(Window.partitionBy("__key")).alias("__all"), F.col("__s"))
    sums = sums.select(F.col("__key").alias("__k"), F.col("__p").alias("__q"), "__before", "__all", "__s")
    ps = sorted({p for v in wanted.values() for p in v})
    rank = {p: F.greatest(F.ceil(F.lit(Decimal(repr(p))) * F.col("__all")).cast("long"), F.lit(1)) for p in ps}
    within = lambda p, low, n: (F.col(low) < rank[p]) & (rank[p] <= F.col(low) + F.col(n))
    any_of = within(ps[0], "__before", "__s")
    for p in ps[1:]:
        any_of = any_of | within(p, "__before", "__s")
    rows = rows.join(sums.where(any_of), (F.col("__p") == F.col("__q")) & F.col("__key").eqNullSafe(F.col("__k")))  # ranges that hold a wanted rank
    upto = F.sum("__n").over(Window.partitionBy("__p", "__key").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__low", F.col("__before") + upto - F.col("__n"))
    found = rows.groupBy("__key").agg(*(F.max(F.when(within(p, "__low", "__n"), F.col("__v"))).alias(f"__{i}") for i, p in enumerate(ps)))
    return found.select("__key", *(F.array(*(F.col(f"__{ps.index(p)}") for p in v)).alias(n) for n, v in wanted.items()))
