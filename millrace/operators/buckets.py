"""$bucketAuto: buckets of about equal size that never split a value.

Rows are first counted by distinct key, and the histogram is dealt by ranges of
its keys. The fold over (key, count) passes from range to range in tasks, and
ranges that lie within a bucket are passed over by their sums; only the fold's
state and the bounds reach the driver. Rows then find their bucket by comparing
with the bounds.
"""

from __future__ import annotations

import math
import pickle

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.accumulators import accumulate
from ..functions.expressions import Compiler, ExpressionError
from ..functions.paths import NUMERIC
from ..shared import ship
from .ranks import dealt

#: Preferred numbers of each series within a decade (fixed values of the standards).
SERIES = {
    "R5": (10, 16, 25, 40, 63),
    "R10": (100, 125, 160, 200, 250, 315, 400, 500, 630, 800),
    "R20": (100, 112, 125, 140, 160, 180, 200, 224, 250, 280, 315, 355, 400, 450, 500, 560, 630, 710, 800, 900),
    "R40": (100, 106, 112, 118, 125, 132, 140, 150, 160, 170, 180, 190, 200, 212, 224, 236, 250, 265, 280, 300, 315, 335, 355, 375, 400, 425, 450, 475, 500, 530, 560, 600, 630, 670, 710, 750, 800, 850, 900, 950),
    "R80": (100, 103, 106, 109, 112, 115, 118, 122, 126, 129, 132, 136, 140, 144, 148, 152, 156, 160, 165, 169, 174, 178, 183, 188, 193, 198, 203, 209, 214, 220, 226, 232, 238, 244, 250, 256, 263, 270, 277, 284, 291, 299, 306, 314, 322, 330, 338, 346, 355, 363, 372, 381, 390, 400, 409, 419, 429, 439, 449, 460, 471, 482, 493, 504, 516, 528, 540, 552, 565, 578, 591, 603, 617, 630, 644, 658, 672, 686, 701, 716, 732, 747, 762, 778, 794, 800, 817, 834, 851, 868, 886, 904, 922, 941, 960, 979),
    "1-2-5": (10, 20, 50),
    "E6": (10, 15, 22, 33, 47, 68),
    "E12": (10, 12, 15, 18, 22, 27, 33, 39, 47, 56, 68, 82),
    "E24": (10, 11, 12, 13, 15, 16, 18, 20, 22, 24, 27, 30, 33, 36, 39, 43, 47, 51, 56, 62, 68, 75, 82, 91),
}


def round_up(v: float, series: str) -> float:
    """The least preferred number above ``v``."""
    if series == "POWERSOF2":
        return 2.0 ** (math.floor(math.log2(v)) + 1) if v > 0 else 0.0
    if v <= 0:
        return 0.0
    base = SERIES.get(series)
    if base is None:
        if series not in ("E48", "E96", "E192"):
            raise ExpressionError(f"unknown granularity {series}")
        n = int(series[1:])
        # by rule, but for the one number that the standard rounds up
        base = tuple(920 if (n, i) == (192, 185) else round(10 ** (i / n) * 100) for i in range(n))
    decade = 10 ** math.floor(math.log10(v)) / base[0]
    for scale in (decade, decade * 10):
        for b in base:
            if b * scale > v * (1 + 1e-12):
                return b * scale
    raise AssertionError


class Fold:
    """The fold over (key, count) in key order; it keeps the bounds alone."""

    def __init__(self, total: int, buckets: int, granularity: str | None = None):
        self.buckets, self.granularity = min(buckets, total), granularity
        self.size, self.extra = divmod(total, self.buckets) if self.buckets else (0, 0)
        self.out: list[list] = []
        self.got = self.want = 0
        self.open = False

    def add(self, key, n: int) -> None:
        if self.open and self.got >= self.want and len(self.out) < self.buckets:
            self.close()
        if not self.open and self.granularity and self.out and (len(self.out) == self.buckets or key < self.out[-1][2]):
            return  # under the bound that was rounded up
        if not self.open:
            self.want = self.size + (self.extra > 0)
            self.extra -= self.extra > 0
            self.got, self.open = 0, True
            self.out.append([key, key, key])
        _checked(key, self.granularity)
        self.out[-1][2] = key
        self.got += n

    def room(self) -> float:
        """How many rows may still come before the open bucket is full; none where no bucket is open."""
        if not self.open:
            return 0
        return math.inf if len(self.out) == self.buckets else self.want - self.got

    def skip(self, top, n: int) -> None:
        """Adds a range of keys that ends in the open bucket."""
        self.out[-1][2] = top
        self.got += n

    def close(self) -> None:
        self.extra = max(0, self.extra - max(0, self.got - self.want))
        if self.granularity:
            self.out[-1][2] = round_up(float(self.out[-1][2]), self.granularity)
        self.open = False

    def bounds(self) -> list[tuple]:
        """[(first key, min, max)] of the buckets."""
        if self.open:
            self.close()
        out = [list(b) for b in self.out]
        for a, b in zip(out, out[1:], strict=False):
            if self.granularity:
                b[1] = a[2]
            else:
                a[2] = b[1]
        return [tuple(b) for b in out]


def plan(counts, total: int, buckets: int, granularity: str | None = None) -> list[tuple]:
    """[(first key, min, max)] of the buckets over (key, count) in key order, read once, a key at a time."""
    fold = Fold(total, buckets, granularity)
    for key, n in counts:
        fold.add(key, n)
    return fold.bounds()


def dealt_plan(counts: DataFrame, buckets: int, granularity: str | None = None) -> list[tuple]:
    """``plan`` over a frame of ``__key`` and ``count``: at most one job for each range that a bucket ends in."""
    ship(counts.sparkSession)
    rows = dealt(counts, "__key")
    wrong = F.lit(False)
    if granularity:
        key, kind = F.col("__key"), counts.schema["__key"].dataType
        wrong = key.isNull() | (F.isnan(key) | (key < 0) if isinstance(kind, NUMERIC) else F.lit(True))
    ranges = rows.groupBy("__p").agg(F.sum("count").alias("n"), F.max("__key").alias("top"), F.max(wrong).alias("wrong")).orderBy("__p").collect()
    fold, pairs = Fold(sum(r["n"] for r in ranges), buckets, granularity), rows.select("__key", "count").sortWithinPartitions(F.asc_nulls_first("__key")).rdd
    for r in ranges:
        if r["n"] <= fold.room() and not r["wrong"]:
            fold.skip(r["top"], r["n"])
            continue
        fold = _folded(pairs, r["__p"], r["n"], fold)
    return fold.bounds()


def _folded(pairs, part: int, n: int, fold: Fold) -> Fold:
    """The state after the pairs of one range, which are folded in its task."""

    def run(rows):
        now, seen = pickle.loads(state), 0
        try:
            for key, count in rows:
                now.add(key, count)
                seen += count
        except ExpressionError as e:
            return [(pickle.dumps(e), seen)]
        return [(pickle.dumps(now), seen)]

    state = pickle.dumps(fold)
    ((got, seen),) = pairs.context.runJob(pairs, run, [part])
    got = pickle.loads(got)
    if isinstance(got, ExpressionError):
        raise got
    if seen != n:
        raise AssertionError(f"range {part} has {seen} rows, not {n}")
    return got


def _checked(v, granularity: str | None) -> None:
    if granularity and (v is None or isinstance(v, str) or v != v or v < 0):
        raise ExpressionError("a granularity needs numbers that aren't negative")


def bucket_auto(df: DataFrame, spec: dict, state) -> DataFrame:
    k = Compiler(df, state.variables)
    key, n = k.column(spec["groupBy"]), spec["buckets"]
    if not isinstance(n, int) or n <= 0:
        raise ExpressionError("buckets is a positive integer")
    keyed = df.withColumn("__key", key)
    bounds = dealt_plan(keyed.groupBy("__key").count(), n, spec.get("granularity"))
    if not bounds:
        return df.sparkSession.createDataFrame([], "_id struct<min:string,max:string>, count long")
    kind = "double" if spec.get("granularity") else keyed.schema["__key"].dataType
    number = F.lit(0)
    for i, (first, _, _) in enumerate(bounds[1:], 1):
        number = F.when(F.col("__key") >= F.lit(first), F.lit(i)).otherwise(number)
    own = Compiler(keyed, state.variables)
    aggs = [accumulate(own, a, state.sort).alias(name) for name, a in spec.get("output", {"count": {"$sum": 1}}).items()]
    names = F.array(*(F.struct(F.lit(lo).cast(kind).alias("min"), F.lit(hi).cast(kind).alias("max")) for _, lo, hi in bounds))
    grouped = keyed.groupBy(number.alias("__b")).agg(*aggs)
    return grouped.orderBy("__b").select(F.get(names, F.col("__b")).alias("_id"), *(c for c in grouped.columns if c != "__b"))
