"""Variable-capacity best-fit packing of token sequences.

Every document's tokens go, in order and whole, into training sequences of a
few permitted lengths. A document longer than the largest length is cut into
full pieces and a rest. Pieces are placed longest first; each goes to the open
bin that it leaves fullest (best fit), and where none has room a bin is
opened. The lengths are chosen jointly: the whole plan is made once for every
set of lengths that bins may be opened with, and for either way of choosing
one in it (least cost a token, or the largest), and the plan of least total
cost is kept. At the end each bin shrinks to the smallest permitted length
that holds its contents.

Placement depends on lengths alone, so it is planned over the histogram of
piece lengths, bounded by the largest length whatever the number of
documents: bins in the same state form one class, and a class is placed into
as a whole. The plan gives each length's pieces by rank to ranges of bins;
ranks come from counts for each (length, salt). A length has a salt for each
``SALT_ROWS`` of its pieces, so that one shared by very many pieces is ranked
in as many tasks.

Tokens are words unless a length column is given: op5's counts cost more CPU
than this operator's whole budget. Null and empty texts have no tokens: one
row with piece 0, no bin and no tokens. Equal lengths are ranked by salt,
document and piece; repeated rows take the ranks one after another. An empty
table gives no rows.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, ship

#: Permitted sequence lengths, in tokens.
CAPACITIES = (512, 1024, 2048, 4096)
#: Cost of a sequence of length c: c * (1 + c / QUADRATIC) + FIXED.
QUADRATIC, FIXED = 16384, 16
#: Pieces of one length that a salt stands for.
SALT_ROWS = 200_000


def cost(c: int) -> float:
    return c * (1 + c / QUADRATIC) + FIXED


def best_opening(length: int, capacities: tuple[int, ...]) -> int:
    """The permitted length that holds pieces of ``length`` at least cost a token."""
    return min((c for c in capacities if c >= length), key=lambda c: (cost(c) / (c // length * length), c))


def largest_opening(length: int, capacities: tuple[int, ...]) -> int:
    return max(capacities)


def total_cost(ranges: np.ndarray) -> float:
    return float(sum(k * cost(s) for _, k, s, _ in ranges.tolist()))


def best_plan(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES):
    """The plan of least cost over all sets of lengths to open and both ways to open; the largest length is in every set."""
    caps = tuple(sorted(capacities))
    tried = []
    for n in range(len(caps)):
        for some in combinations(caps[:-1], n):
            for opening in (best_opening, largest_opening) if not some else (best_opening,):
                tried.append(plan(histogram, caps, (*some, caps[-1]), opening))
    return min(tried, key=lambda t: total_cost(t[1]))


def plan(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, openings: tuple[int, ...] | None = None, opening: Callable = best_opening):
    """Place ``histogram`` (length to number of pieces) by best fit, longest first.

    ``openings`` are the lengths that bins may begin with (all, if not given).
    Returns placements and bins as integer arrays. A placement (length, rank,
    count, bin, each, offset) puts pieces ``rank`` to ``rank + count`` of that
    length into bins from ``bin`` on, ``each`` in one, from ``offset`` on. A
    bin range (first, count, size, used) gives the final length.
    """
    caps = tuple(sorted(capacities))
    open_: dict[int, list[list[int]]] = {}  # room: classes of [first, count, used, capacity]
    rooms: list[int] = []
    placed: list[tuple[int, int, int, int, int, int]] = []
    bins = 0

    def put(room: int, first: int, count: int, used: int, cap: int) -> None:
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append([first, count, used, cap])

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):  # no open bin has room
                cap = opening(length, openings or caps)
                count = -(-left // (cap // length))
                put(cap, bins, count, 0, cap)
                bins += count
                continue
            room = rooms[at]
            classes = open_[room]
            first, count, used, cap = classes.pop()
            if not classes:
                del open_[room], rooms[at]
            # best fit fills one bin before the next: as many as it holds
            each = room // length
            full = min(count, left // each)
            if full:
                placed.append((length, rank, full * each, first, each, used))
                rank, left = rank + full * each, left - full * each
                put(room - each * length, first, full, used + each * length, cap)
                first, count = first + full, count - full
            if count and left and left < each:
                placed.append((length, rank, left, first, left, used))
                put(room - left * length, first, 1, used + left * length, cap)
                rank, left, first, count = rank + left, 0, first + 1, count - 1
            if count:
                put(room, first, count, used, cap)
    ranges = sorted((first, count, next(c for c in caps if c >= used), used) for cs in open_.values() for first, count, used, _ in cs if used)
    return np.array(placed, np.int64).reshape(-1, 6), np.array(ranges, np.int64).reshape(-1, 4)


def n_words(text: Column) -> Column:
    """Tokens of a text where no other count is given: its words."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD))


_OUT = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int32()), ("bin_id", pa.int64()), ("bin_size", pa.int32()), ("bin_used", pa.int32()), ("offset", pa.int32())])
_OUT_DDL = "doc_id long, piece int, start long, n_tokens int, bin_id long, bin_size int, bin_used int, offset int"


def pack(docs: DataFrame, length: Column | None = None, capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """One row per piece: its tokens [start, start + n_tokens) of doc_id lie in bin_id at offset."""
    spark, top = docs.sparkSession, max(capacities)
    ship(spark)
    n = (n_words(docs["text"]) if length is None else F.coalesce(length, F.lit(0))).cast("long")
    # the counts are read twice, so they are written once
    sized = cut(docs.select(docs["doc_id"].cast("long").alias("doc_id"), n.alias("n")), "lengths")
    pieces = F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / top) - 1, F.lit(0)).cast("int")), lambda i: F.struct(i.alias("piece"), (i.cast("long") * top).alias("start"), F.least(F.lit(top).cast("long"), F.col("n") - i.cast("long") * top).cast("int").alias("len"))))
    p = sized.select("doc_id", pieces.alias("p")).select("doc_id", "p.*")
    sizes = {r["len"]: r["k"] for r in p.groupBy("len").agg(F.count("*").alias("k")).collect()}  # at most top + 1 rows
    many = {n: -(-k // SALT_ROWS) for n, k in sizes.items() if k > SALT_ROWS}
    salts = F.lit(1)
    if many:
        salts = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in many.items() for x in kv]), F.col("len")), F.lit(1))
    p = p.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), salts).cast("int"))
    histogram: dict[int, int] = {}
    before: dict[tuple[int, int], int] = {}
    if many:
        counts = p.groupBy("len", "salt").agg(F.count("*").alias("k")).orderBy("len", "salt").collect()  # a row for each length and SALT_ROWS pieces
        for r in counts:
            before[r["len"], r["salt"]] = histogram.get(r["len"], 0)
            histogram[r["len"]] = histogram.get(r["len"], 0) + r["k"]
    else:
        histogram = dict(sizes)
    empty = histogram.pop(0, 0)
    placed, ranges = best_plan(histogram, capacities)
    order = np.lexsort((placed[:, 1], placed[:, 0]))
    placed = placed[order]
    # where each length's salts begin in one flat array of the pieces before each (length, salt)
    first = np.cumsum([0] + [many.get(n, 1) for n in range(top + 1)])
    base = np.zeros(first[-1], np.int64)
    for (n, salt), v in before.items():
        base[first[n] + salt] = v
    plan_ = spark.sparkContext.broadcast((placed, ranges, first, base))

    w = Window.partitionBy("len", "salt").orderBy("doc_id", "piece")
    ranked = p.where("len > 0").withColumn("rank", F.row_number().over(w) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        placed, ranges, first, base = plan_.value
        key = placed[:, 0] << 44 | placed[:, 1]
        for b in batches:
            doc, piece, start, size, salt, rank = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            rank = base[first[size] + salt] + rank
            at = np.searchsorted(key, size.astype(np.int64) << 44 | rank, side="right") - 1
            inside = rank - placed[at, 1]
            bin_ = placed[at, 3] + inside // placed[at, 4]
            offset = placed[at, 5] + inside % placed[at, 4] * size
            r = np.searchsorted(ranges[:, 0], bin_, side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip((b[0], piece, start, size, bin_, ranges[r, 2], ranges[r, 3], offset), _OUT, strict=True)], schema=_OUT)

    out = ranked.select("doc_id", "piece", "start", "len", "salt", "rank").mapInArrow(run, _OUT_DDL)
    if empty:
        out = out.unionByName(p.where("len = 0").select("doc_id", "piece", "start", F.col("len").alias("n_tokens"), F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("int").alias("bin_size"), F.lit(None).cast("int").alias("bin_used"), F.lit(None).cast("int").alias("offset")))
    return out


def sequences(packed: DataFrame, tokens: DataFrame) -> DataFrame:
    """The packed sequences: (bin_id, bin_size, doc_ids, tokens), from (doc_id, tokens array).

    A bin is bounded by the largest permitted length, so its gathering is too.
    """
    parts = packed.where("bin_id is not null").join(tokens.select(F.col("doc_id"), F.col("tokens")), "doc_id").select("bin_id", "bin_size", F.struct("offset", "doc_id", F.slice("tokens", F.col("start").cast("int") + 1, F.col("n_tokens")).alias("t")).alias("x"))
    return parts.groupBy("bin_id", "bin_size").agg(F.sort_array(F.collect_list("x")).alias("x")).select("bin_id", "bin_size", F.col("x.doc_id").alias("doc_ids"), F.flatten(F.col("x.t")).alias("tokens"))
