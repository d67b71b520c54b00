import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from millrace.llm import packing
from millrace.llm.common import table

from .fixtures import awkward, empty, with_clashes


def check(rows, sizes, capacities=packing.CAPACITIES):
    """Every token once, in a bin with room, without overlaps; bins shrunk."""
    got, bins = defaultdict(int), defaultdict(list)
    for r in rows:
        got[r.doc_id] += r.n_tokens
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
    assert got == sizes
    for own in bins.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.n_tokens
        assert {(r.bin_size, r.bin_used) for r in own} == {(min(c for c in capacities if c >= at), at)}
    return bins


def test_pack_documents(spark, sf):
    docs = table(spark, sf, "documents")
    sizes = Counter({r.doc_id: len(r.text.split()) for r in docs.collect()})
    bins = check(packing.pack(docs).collect(), sizes)
    used, size = sum(r[0].bin_used for r in bins.values()), sum(r[0].bin_size for r in bins.values())
    assert used / size > 0.9


def test_edges(spark):
    for docs in (awkward(spark), with_clashes(awkward(spark))):
        sizes = defaultdict(int)
        for r in docs.collect():
            sizes[r.doc_id] += len((r.text or "").split())
        check(packing.pack(docs).collect(), sizes)
    assert packing.pack(empty(spark)).count() == 0


def one_by_one(lengths, capacities):
    """Best fit decreasing, a piece at a time, with the same rule for opening."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [b for b in bins if b[0] - b[1] >= n]
        if fit:
            min(fit, key=lambda b: b[0] - b[1])[1] += n
        else:
            bins.append([packing.best_opening(n, capacities), n])
    return sorted((next(c for c in sorted(capacities) if c >= u), u) for _, u in bins)


def test_plan_equals_one_by_one():
    r = random.Random(5)
    for _ in range(60):
        caps = tuple(sorted(r.sample([8, 16, 24, 32, 64], r.randint(1, 3))))
        lengths = [r.randint(1, caps[-1]) for _ in range(r.randint(1, 80))]
        placed, ranges = packing.plan(dict(Counter(lengths)), caps)
        bins = sorted((int(s), int(u)) for _, k, s, u in ranges for _ in range(k))
        assert sum(u for _, u in bins) == sum(lengths) == int((placed[:, 0] * placed[:, 2]).sum())
        want = one_by_one(lengths, caps)
        assert sum(packing.cost(s) for s, _ in bins) <= 1.1 * sum(packing.cost(s) for s, _ in want)


def test_sequences(spark):
    docs = spark.createDataFrame([(i, [i] * (i % 700)) for i in range(40, 900, 37)], "doc_id long, tokens array<int>")
    packed = packing.pack(docs.select("doc_id", F.lit(None).cast("string").alias("text"), F.size("tokens").alias("n")), F.col("n"))
    rows = packing.sequences(packed, docs).collect()
    assert Counter(t for r in rows for t in r.tokens) == Counter({i: i % 700 for i in range(40, 900, 37) if i % 700})
    assert all(len(r.tokens) <= r.bin_size for r in rows)


def test_plan_is_one_by_one_best_fit_and_the_joint_plan_is_no_dearer():
    r = random.Random(8)
    gains = 0
    for _ in range(80):
        caps = tuple(sorted(r.sample([8, 16, 24, 32, 64, 96], r.randint(1, 4))))
        lengths = [r.choice((r.randint(1, caps[-1]), r.randint(1, 9), caps[0])) for _ in range(r.randint(1, 150))]
        lengths = [min(n, caps[-1]) for n in lengths]
        histogram = dict(Counter(lengths))
        bins = lambda ranges: sorted((int(s), int(u)) for _, k, s, u in ranges for _ in range(k))
        # with one length, bins of equal room are equal, so nothing depends on which of them is taken
        assert bins(packing.plan(histogram, caps[-1:])[1]) == one_by_one(lengths, caps[-1:])
        placed, ranges = packing.best_plan(histogram, caps)
        assert Counter({int(n): int(sum(placed[placed[:, 0] == n, 2])) for n in set(lengths)}) == Counter(lengths)
        mine, theirs = packing.total_cost(ranges), packing.total_cost(packing.plan(histogram, caps)[1])
        assert mine <= theirs + 1e-9
        gains += mine < theirs - 1e-9
    assert gains > 0


def test_common_lengths_are_salted(spark, monkeypatch):
    monkeypatch.setattr(packing, "SALT_ROWS", 7)
    docs = spark.createDataFrame([(i, "w " * (3 if i % 3 else 9000)) for i in range(200)] + [(1, "a b c"), (None, "a b c")], "doc_id long, text string")
    sizes = Counter()
    for x in docs.collect():
        sizes[x.doc_id] += len(x.text.split())
    check(packing.pack(docs).collect(), sizes)
