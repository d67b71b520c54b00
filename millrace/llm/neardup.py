"""Near-duplicates by MinHash bands, odd sketches and exact confirmation.

A document's set is its distinct word shingles (lower case A-Z, words between
ASCII white space); fewer words than a shingle make one shingle; no words or
no text make the empty set, linked with nothing. Documents whose sets have a
Jaccard similarity of at least ``similarity`` percent are linked.

1. One pass hashes the shingles, takes ``BANDS * ROWS`` MinHash samples, and
   folds them into an *odd sketch*: each sample toggles one of 1,024 bits.
   Equal sets share a fingerprint, which is the node of all later steps; that
   no two sets share one is checked, and a new seed taken if two do.
2. Samples in bands give buckets. A pair at the threshold misses every
   bucket with probability below one in a million.
3. Each node is paired with the least node of each of its buckets (no pairs
   within a bucket are emitted), pairs whose sizes exclude the similarity go,
   the XOR population count of the odd sketches excludes pairs more than five
   standard deviations below the threshold, and the rest are confirmed on the
   full sets. Stars give components.
4. Buckets that still hold several components are compared in full, but only
   across components: blocks of bounded size first name the nodes of which some
   pair passes the size and sketch tests, then blocks of bounded bytes compare
   the full sets of those and emit only the links that join components, never
   the pairs of a bucket.

Repeated rows share a fingerprint and a component. Several texts under one id
are as many nodes, and so are texts without an id: links go by fingerprints, so
none is lost or invented. A null id never becomes a component's id unless it
has no other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, bits_set, cut, discard, ship, small_batches
from .graph import components

SHINGLE, SIMILARITY = 5, 80
BANDS, ROWS = 28, 4
SKETCH_BITS = 1024
#: Standard deviations below the threshold at which a sketch rules a pair out.
MARGIN = 5.0
#: Members of a bucket that one task compares with as many others, by sketches and then (in bytes) by sets.
BLOCK, BLOCK_BYTES = 1024, 1 << 24
#: Bits of the filter that picks the texts to shingle again: eight a text, but no more than 32 MB in all.
LEAST_FILTER, MOST_FILTER = 1 << 20, 1 << 28
_WORDS_KEPT = 300_000
_rng = np.random.default_rng(8)
_A = (_rng.integers(0, 2**32, BANDS * ROWS, np.uint32) | np.uint32(1))[:, None]
_B = _rng.integers(0, 2**32, BANDS * ROWS, np.uint32)[:, None]
_C = _rng.integers(0, 2**64, BANDS * ROWS, np.uint64, endpoint=False) | np.uint64(1)
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_known: dict[bytes, int] = {}


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    if not words:
        return np.empty(0, np.uint64)
    known = _known
    if len(known) > _WORDS_KEPT:
        known.clear()
    h = []
    for w in words:
        v = known.get(w)
        if v is None:
            v = known[w] = xxhash.xxh3_64_intdigest(w)
        h.append(v)
    a = np.array(h, np.uint64)
    n = min(size, len(words))
    with np.errstate(over="ignore"):
        s = a[: len(a) - n + 1] + np.uint64(n)
        for i in range(1, n):
            s = s * _M1 + a[i : len(a) - n + 1 + i]
        s = (s ^ (s >> np.uint64(30))) * _M2
        s = (s ^ (s >> np.uint64(27))) * _M3
        s ^= s >> np.uint64(31)
    return np.unique(s)


def min_hashes(u: np.ndarray) -> np.ndarray:
    x = (u >> np.uint64(32)).astype(np.uint32)
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 1024):
        out = np.minimum(out, (x[None, lo : lo + 1024] * _A + _B).min(1))
    return out


def band_keys(mh: np.ndarray) -> list[int]:
    return [xxhash.xxh3_64_intdigest(mh[i * ROWS : (i + 1) * ROWS].tobytes(), i) - (1 << 63) for i in range(BANDS)]


def odd_sketch(mh: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples as 16 words of 64 bits."""
    with np.errstate(over="ignore"):
        at = ((mh.astype(np.uint64) + np.uint64(1)) * _C) >> np.uint64(54)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=SKETCH_BITS).astype(np.uint8) & 1).view(np.int64)


def most_odd_bits(similarity: int) -> int:
    """The largest XOR population count that a pair at ``similarity`` may show."""
    k, j = BANDS * ROWS, similarity / 100
    d = 2 * k * (1 - (j - MARGIN * math.sqrt(j * (1 - j) / k)))  # toggles left at the margin
    z = SKETCH_BITS * (1 - (1 - 2 / SKETCH_BITS) ** d) / 2
    return math.ceil(z + MARGIN * math.sqrt(z) / 2)


_SKETCH = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("check", pa.int64()), ("bands", pa.list_(pa.int64())), ("odd", pa.list_(pa.int64()))])


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row): ``row`` is a hash of both, so that a text can be told from others of its id and from rows without one."""
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return d.withColumn("row", F.xxhash64("doc_id", "text"))


def fingerprint(u: np.ndarray, seed: int) -> tuple[int, int]:
    """The node of a set of shingles, and a check of it."""
    d = xxhash.xxh3_128_intdigest(u.tobytes(), seed)
    return (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)


def sketches(docs: DataFrame, size: int, seed: int) -> DataFrame:
    small_batches(docs.sparkSession)
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rows = []
            for doc, text, row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                u = shingle_hashes(text, size)
                if not len(u):
                    rows.append((doc, row, 0, None, None, [], []))
                    continue
                mh = min_hashes(u)
                rows.append((doc, row, len(u), *fingerprint(u, seed), band_keys(mh), odd_sketch(mh)))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), _SKETCH, strict=True)], schema=_SKETCH)

    return _keyed(docs).mapInArrow(run, "doc_id long, row long, n_shingles long, node long, `check` long, bands array<long>, odd array<long>")


def _odd_bits(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))


def _may_be_linked(similarity: int) -> Column:
    least, most = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    return (least * 100 >= most * similarity) & (_odd_bits("odd_a", "odd_b") <= most_odd_bits(similarity))


def full_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, size: int, seed: int) -> DataFrame:
    """(node, set) of the nodes in ``wanted``: each one's sorted shingle hashes.

    Of each node one row's text is shingled again, and it is the fingerprint of
    what comes out that the set is joined by.
    """
    spark = docs.sparkSession
    first = cut(wanted.select("node").distinct().join(nodes.select("node", "row"), "node"), "wanted")
    most = min(MOST_FILTER, max(LEAST_FILTER, 1 << (8 * first.count()).bit_length()))
    bits = spark.sparkContext.broadcast(bit_filter(F.col("row"), first, most))

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = np.flatnonzero(bits_set(bits.value, b[1].to_numpy() & np.int64(most - 1)))
            if len(hit):
                sets = [u for t in b[0].take(pa.array(hit)).to_pylist() if len(u := shingle_hashes(t, size))]
                yield pa.RecordBatch.from_arrays([pa.array([fingerprint(u, seed)[0] for u in sets], pa.int64()), pa.array([u.tobytes() for u in sets], pa.binary())], names=["node", "set"])

    made = _keyed(docs).select("text", "row").mapInArrow(shingle, "node long, `set` binary")
    out = cut(made.join(first.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")
    discard(first)
    return out


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def confirm(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are similar enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b[2].to_pylist(), b[3].to_pylist(), strict=True):
                x, y = _unpacked(x), _unpacked(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= similarity * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.select("a", "b").join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b").select("a", "b", "set_a", "set_b")
    return joined.mapInArrow(compare, "a long, b long")


def _blocks(members: DataFrame, weight: Column, most: int) -> DataFrame:
    """Deals each key's members (key, node, part, ...) to pairs (i, j) of blocks of about ``most``; a member's own block is ``own``.

    The heaviest part of a key is never compared within itself, so its blocks
    (below 0) only meet those of the rest (0 and above): a large component with
    few strangers in its bucket is dealt once, and the strangers to every block.
    """
    parts = members.groupBy("key", "part").agg(F.sum(weight).alias("w"))
    sizes = parts.groupBy("key").agg(F.max(F.struct("w", "part")).alias("big"), F.sum("w").alias("all")).where(F.col("all") > F.col("big.w"))
    small = F.col("all") <= most  # one block for all
    sizes = sizes.select("key", F.when(~small, F.col("big.part")).alias("big"), F.ceil(F.col("big.w") / most).cast("int").alias("bigs"), F.when(small, 1).otherwise(F.ceil((F.col("all") - F.col("big.w")) / most)).cast("int").alias("rests"))
    at, is_big = F.xxhash64("node", "key"), F.col("part").eqNullSafe(F.col("big"))
    d = members.join(sizes, "key").withColumn("own", F.when(is_big, -1 - F.pmod(at, "bigs")).otherwise(F.pmod(at, "rests")).cast("int"))
    rest = F.sequence(F.lit(0), F.col("rests") - 1)
    d = d.withColumn("with", F.explode(F.when(is_big, rest).otherwise(F.concat(rest, F.when(F.col("big").isNull(), F.array().cast("array<int>")).otherwise(F.sequence(-F.col("bigs"), F.lit(-1)))))))
    return d.withColumn("i", F.greatest("own", "with")).withColumn("j", F.least("own", "with")).drop("with", "big", "bigs", "rests")


def _grouped(dealt: DataFrame):
    """By blocks; a number of parts is given, since few bytes here are much work and mustn't be merged into few tasks."""
    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "key", "i", "j").groupBy("key", "i", "j")


def _cross(t: pa.Table, similarity: int, most: int):
    """For each member of block i, the members of block j of another part that size and sketch allow."""
    part, n, own = (t[c].to_numpy() for c in ("part", "n", "own"))
    i, j = t["i"][0].as_py(), t["j"][0].as_py()
    odd = np.array(t["odd"].to_pylist(), np.int64).reshape(len(part), -1).view(np.uint64)
    rows, cols = np.flatnonzero(own == i), np.flatnonzero(own == j)
    for r in rows.tolist():
        c = cols[(part[cols] != part[r]) & (np.minimum(n[cols], n[r]) * 100 >= np.maximum(n[cols], n[r]) * similarity)]
        if i == j:
            c = c[c > r]
        if len(c):
            c = c[np.bitwise_count(odd[c] ^ odd[r]).sum(1) <= most]
            if len(c):
                yield r, c


def across(placed: DataFrame, size_and_odd: DataFrame, similarity: int) -> DataFrame:
    """(key, node, part, n, odd): members of buckets with a possible link to another part."""
    mixed = placed.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x != y").select("key")
    dealt = _blocks(placed.join(mixed, "key"), F.lit(1), BLOCK).join(size_and_odd, "node").select("key", "i", "j", "own", "node", "part", "n", "odd")
    most = most_odd_bits(similarity)

    def possible(t: pa.Table) -> pa.Table:
        hit = np.zeros(len(t), bool)
        for r, c in _cross(t, similarity, most):
            hit[r] = True
            hit[c] = True
        return t.select(["key", "node", "part", "n", "odd"]).filter(pa.array(hit))

    named = _grouped(dealt).applyInArrow(possible, "key long, node long, part long, n long, odd array<long>")
    return named.dropDuplicates(["key", "node"])


def linked_across(possible: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """(a, b): links between different parts, as many as join the parts of a block."""
    dealt = _blocks(possible, F.col("n") * 8, BLOCK_BYTES).join(sets, "node").select("key", "i", "j", "own", "node", "part", "n", "odd", "set")
    most = most_odd_bits(similarity)

    def link(t: pa.Table) -> pa.Table:
        sets = [_unpacked(x) for x in t["set"].to_pylist()]
        sizes = np.array([len(x) for x in sets])
        begins = np.cumsum(sizes) - sizes
        kinds, ids = np.unique(np.concatenate(sets), return_inverse=True)
        node, up, out = t["node"].to_numpy(), {}, []

        def find(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        part = t["part"].to_pylist()
        mask = np.zeros(len(kinds), bool)
        for r, c in _cross(t, similarity, most):
            own = ids[begins[r] : begins[r] + sizes[r]]
            mask[own] = True
            at = np.repeat(begins[c] - (np.cumsum(sizes[c]) - sizes[c]), sizes[c]) + np.arange(int(sizes[c].sum()))
            both = np.add.reduceat(mask[ids[at]].astype(np.int64), np.cumsum(sizes[c]) - sizes[c])
            mask[own] = False
            for k in c[100 * both >= similarity * (sizes[c] + sizes[r] - both)].tolist():
                x, y = find(part[r]), find(part[k])
                if x != y:
                    up[x] = y
                    out.append((int(node[r]), int(node[k])))
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return _grouped(dealt).applyInArrow(link, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per input row."""
    spark, seed = docs.sparkSession, 0
    while True:
        sk = cut(sketches(docs, size, seed), "sketches")
        nodes = cut(sk.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("row").alias("row"), F.min("n_shingles").alias("n"), F.first("odd").alias("odd"), F.min("check").alias("low"), F.max("check").alias("high")), "nodes")
        if nodes.where("low != high").isEmpty():
            break
        seed += 1
    banded = sk.where("n_shingles > 0").select("node", F.explode("bands").alias("key"))
    # equal sets fall together in the partial aggregation; only buckets of several nodes go on
    buckets = banded.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("other")).where("leader != other").select("key", "leader")
    members = cut(sk.where("n_shingles > 0").select("node", "bands").dropDuplicates(["node"]).select("node", F.explode("bands").alias("key")).join(buckets, "key").select("key", "node", "leader"), "members")

    size_and_odd = nodes.select("node", "n", "odd")
    near = members.where("node != leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    near = near.join(size_and_odd.toDF("a", "n_a", "odd_a"), "a").join(size_and_odd.toDF("b", "n_b", "odd_b"), "b").where(_may_be_linked(similarity)).select("a", "b")
    tried = cut(near, "tried")
    ends = tried.select(F.col("a").alias("node")).union(tried.select("b"))
    sets = full_sets(docs, nodes, ends, size, seed)
    links = cut(confirm(tried, sets, similarity), "links")
    discard(tried, sets)
    parts = cut(components(links), "parts")

    # buckets whose members aren't all in one component yet
    placed = cut(members.join(parts, "node", "left").select("key", "node", F.coalesce("component", "node").alias("part")), "placed")
    possible = cut(across(placed, size_and_odd, similarity), "possible")
    discard(members, placed)
    if not possible.isEmpty():
        sets = full_sets(docs, nodes, possible, size, seed)
        more = cut(linked_across(possible, sets, similarity), "more")
        discard(possible, sets)
        if not more.isEmpty():
            parts = cut(components(links.union(more)), "parts")

    named = nodes.select("node", "first_id").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    ids = named.join(least, "component").select("node", "component_id")
    out = sk.select("doc_id", "n_shingles", "node").join(ids, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, size: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that are no near-duplicate of another, and one row of each group.

    A group keeps its document of least doc_id. Rows that repeat a doc_id are
    one document and stay or go together. Rows without a doc_id can't be named
    and stay; so do rows without words, which are linked with nothing.
    """
    found = near_duplicates(docs, size, similarity)
    # a component's other ids go; most ids stay, so the lesser set is joined
    gone = found.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull() & ~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")
