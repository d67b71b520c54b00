import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import graph, neardup
from millrace.llm.common import table

from .fixtures import DOCS, awkward, empty, with_clashes


def sets_of(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, size, similarity=80):
    """Components over all pairs of rows that share a shingle."""
    sets, by, parent = [sets_of(t, size) for _, t in rows], defaultdict(list), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for g in s:
            for j in by[g]:
                shared[j] += 1
            by[g].append(i)
        for j, both in shared.items():
            if 100 * both >= similarity * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def got(docs, size):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, size).collect()), key=str)


def test_against_all_pairs(spark, sf01):
    docs = table(spark, sf01, "documents")
    assert got(docs, 4) == brute([(r.doc_id, r.text) for r in docs.collect()], 4)


def test_edges(spark):
    for docs in (awkward(spark), with_clashes(awkward(spark)), empty(spark)):
        assert got(docs, 5) == brute([(r.doc_id, r.text) for r in docs.collect()], 5)


def test_chains_and_big_buckets(spark):
    """Chains link documents whose ends differ; variants around one text fill common buckets."""
    r = random.Random(2)
    base = [f"w{r.randint(0, 5000)}" for _ in range(120)]
    rows, now = [], list(base)
    for i in range(120):
        rows.append((i, " ".join(now)))
        at = r.randrange(len(now))
        now[at : at + 2] = [f"n{i}", f"m{i}"]
    for i in range(200, 700):
        v = list(base)
        for _ in range(r.randint(0, 4)):
            v[r.randrange(len(v))] = f"q{r.randint(0, 10**6)}"
        rows.append((i, " ".join(v)))
    r.shuffle(rows)
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    assert got(docs, 5) == brute(rows, 5)


def test_keep_one(spark, sf):
    docs = with_clashes(table(spark, sf, "documents").withColumn("doc_id", F.col("doc_id") + 100).unionByName(awkward(spark)))
    out = neardup.keep_one(docs)
    assert out.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = {d for d, n, c in brute(rows, neardup.SHINGLE) if d is not None and d == c}
    assert {r.doc_id for r in out.collect() if r.doc_id is not None} == want


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, i) for i in range(1001, 1300)] + [(r.randint(2000, 2400), r.randint(2000, 2400)) for _ in range(250)]
    r.shuffle(edges)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    rows = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in rows} == want and len(rows) == len(want)


def test_odd_sketch_estimates(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    for j in (0.8, 0.9, 0.95):
        n = 2000
        both = round(2 * n * j / (1 + j))
        pool = rng.integers(0, 2**63, 3 * n).astype(np.uint64)
        a, b = pool[:n], np.concatenate([pool[:both], pool[n : 2 * n - both]])
        x = neardup.odd_sketch(neardup.min_hashes(a)).view(np.uint64) ^ neardup.odd_sketch(neardup.min_hashes(b)).view(np.uint64)
        assert int(np.bitwise_count(x).sum()) <= neardup.most_odd_bits(80)
    assert neardup.most_odd_bits(80) < neardup.SKETCH_BITS / 2
    with pytest.raises(ValueError):
        neardup.most_odd_bits(-1)


def variants(seed, n, changes, words=120):
    r = random.Random(seed)
    base, out = [f"s{seed}w{k}" for k in range(words)], []
    for _ in range(n):
        v = list(base)
        for _ in range(changes):
            v[r.randrange(words)] = f"q{r.randint(0, 10**9)}"
        out.append(" ".join(v))
    return out


def test_rows_without_an_id_link_others(spark):
    """1 - null - 2: only the text without an id is near both."""
    base = [f"w{k}" for k in range(200)]
    mid, left, right = list(base), list(base), list(base)
    left[20:28] = [f"l{k}" for k in range(8)]
    right[120:128] = [f"r{k}" for k in range(8)]
    rows = [(1, " ".join(left)), (None, " ".join(mid)), (2, " ".join(right)), (None, "alone " + " ".join(f"z{k}" for k in range(50)))]
    rows += [(None, t) for t in variants(3, 4, 1)] + [(9, variants(3, 1, 1)[0])]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    want = brute(rows, 5)
    assert got(docs, 5) == want and (2, 196, 1) in want


def test_several_texts_under_one_id_keep_their_links(spark):
    a, b = variants(1, 2, 1), variants(2, 2, 1)
    rows = [(1, a[0]), (3, a[1]), (3, b[1]), (2, b[0])]
    for order in (rows, rows[::-1], [rows[2], rows[0], rows[3], rows[1]]):
        docs = spark.createDataFrame([(i, t, None, None, None) for i, t in order], DOCS)
        assert got(docs, 5) == brute(order, 5)
    assert {c for d, _, c in brute(rows, 5)} == {1, 2}


def test_small_blocks_find_the_same(spark, monkeypatch):
    """Many blocks to a bucket: a large component with strangers in its buckets, and many parts."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 1 << 13)
    r = random.Random(21)
    base, rows = [f"w{k}" for k in range(60)], []
    for i in range(260):
        v = list(base)
        for _ in range(r.choice((0, 1, 2, 4, 5))):
            v[r.randrange(60)] = f"q{r.randint(0, 10**9)}"
        rows.append((i, " ".join(v)))
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    assert got(docs, 5) == brute(rows, 5)
