import pytest
from pyspark.sql import functions as F

from millrace import Database
from millrace.functions.expressions import ExpressionError


def exact(ps, n, of=lambda r: float(r)):
    """The values of ranks ceil(p * n) among 0 to n - 1, p in percent."""
    return [of(max(-(-p * n // 100), 1) - 1) for p in ps]


def test_percentiles_of_large_groups_are_exact(spark):
    n = 300_000
    db = Database(spark)
    db.catalog.register("t", spark.range(3 * n).select((F.col("id") % 3).alias("g"), F.floor(F.col("id") / 3).cast("double").alias("v")))
    ask = {"p": {"$percentile": {"input": "$v", "p": [0.9, 0.0, 0.07, 0.25, 1.0], "method": "approximate"}}, "m": {"$median": {"input": "$v", "method": "approximate"}}}
    want = exact([90, 0, 7, 25, 100], n)
    got = db.aggregate("t", [{"$group": {"_id": "$g", **ask, "n": {"$sum": 1}}}]).collect()
    assert {r._id: (r.p, r.m, r.n) for r in got} == {g: (want, exact([50], n)[0], n) for g in range(3)}
    (r,) = db.aggregate("t", [{"$match": {"g": 1}}, {"$group": {"_id": None, **ask}}]).collect()
    assert (r.p, r.m) == (want, exact([50], n)[0])
    (r,) = db.aggregate("t", [{"$match": {"g": 2, "v": {"$lt": 50_000}}}, {"$setWindowFields": {"partitionBy": "$g", "output": ask}}, {"$limit": 1}]).collect()
    assert (r.p, r.m) == (exact([90, 0, 7, 25, 100], 50_000), exact([50], 50_000)[0])


def test_percentiles_of_null_keys_and_empty_groups(spark):
    db = Database(spark)
    db.catalog.register("t", spark.createDataFrame([(None, 3.0), (None, 1.0), ("a", None), ("b", 2.0)], "k string, v double"))
    got = db.aggregate("t", [{"$group": {"_id": {"k": "$k"}, "m": {"$median": {"input": "$v", "method": "approximate"}}, "p": {"$percentile": {"input": "$v", "p": [0.9], "method": "approximate"}}}}]).collect()
    assert {r._id.k: (r.m, r.p) for r in got} == {None: (1.0, [3.0]), "a": (None, None), "b": (2.0, [2.0])}
    assert db.aggregate("t", [{"$match": {"v": {"$gt": 9}}}, {"$group": {"_id": None, "m": {"$median": {"input": "$v", "method": "approximate"}}}}]).collect() == []


def test_reduce_to_text_is_joined_once(spark):
    db = Database(spark)
    db.catalog.register("t", spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, ["a", None]), (4, None)], "_id int, s array<string>"))
    join = {"$reduce": {"input": "$s", "initialValue": {"$toString": "$_id"}, "in": {"$concat": ["$$value", "|", "$$this", {"$toString": "$_id"}]}}}
    back = {"$reduce": {"input": "$s", "initialValue": "", "in": {"$concat": ["$$this", "$$value"]}}}
    twice = {"$reduce": {"input": "$s", "initialValue": "x", "in": {"$concat": ["$$value", "$$this", "$$value"]}}}
    df = db.aggregate("t", [{"$project": {"j": join, "b": back, "t": twice}}])
    assert sorted((r._id, r.j, r.b, r.t) for r in df.collect()) == [(1, "1|a1|b1", "ba", "xaxbxax"), (2, "2", "", "x"), (3, None, None, None), (4, None, None, None)]
    plan = db.aggregate("t", [{"$project": {"j": join}}])._jdf.queryExecution().executedPlan().toString()
    assert "array_join" in plan and "aggregate(" not in plan


def test_pushed_values_are_sorted_by_their_keys(spark):
    db = Database(spark)
    rows = [(i, i % 2 if i % 5 else None, {"k": 9 - i}) for i in range(10)]
    db.catalog.register("t", spark.createDataFrame(rows, "i int, s int, m map<string,int>").coalesce(1))
    for way in (1, -1):
        (r,) = db.aggregate("t", [{"$sort": {"s": way, "i": 1}}, {"$group": {"_id": None, "a": {"$push": {"$subtract": [0, "$i"]}}, "m": {"$push": "$m"}}}]).collect()
        want = sorted(rows, key=lambda x: way * (-1 if x[1] is None else x[1]))
        assert (r.a, [x["k"] for x in r.m]) == ([-x[0] for x in want], [9 - x[0] for x in want])


def test_bucket_auto_keeps_keys_off_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    from millrace.operators.buckets import dealt_plan, plan

    def never(self, *a, **b):
        raise AssertionError("the histogram streams through the driver")

    monkeypatch.setattr(DataFrame, "toLocalIterator", never)
    db = Database(spark)
    keys = [k * k % 701 for k in range(3000)] + [5] * 900 + [None] * 40
    db.catalog.register("t", spark.createDataFrame([(k,) for k in keys], "k int"))
    counts = sorted(((k, keys.count(k)) for k in set(keys)), key=lambda x: (x[0] is not None, x[0] or 0))
    hist = spark.createDataFrame(counts, "__key int, count long").repartition(8)
    for n in (1, 7, 5000):
        assert dealt_plan(hist, n) == plan(counts, len(keys), n)
    for n, series in ((3, "R20"), (40, "POWERSOF2")):
        assert dealt_plan(hist.where("__key > 0"), n, series) == plan([c for c in counts if c[0]], sum(c[1] for c in counts if c[0]), n, series)
    got = db.aggregate("t", [{"$bucketAuto": {"groupBy": "$k", "buckets": 4}}]).collect()
    assert [(r._id.min, r._id.max) for r in got] == [b[1:] for b in plan(counts, len(keys), 4)] and sum(r["count"] for r in got) == len(keys)
    with pytest.raises(ExpressionError):
        db.aggregate("t", [{"$bucketAuto": {"groupBy": "$k", "buckets": 4, "granularity": "R5"}}])
    assert db.aggregate("t", [{"$match": {"k": -1}}, {"$bucketAuto": {"groupBy": "$k", "buckets": 4}}]).collect() == []


def test_conversions_of_text_that_is_no_number(spark):
    db = Database(spark)
    texts = ["N", "", " 7 ", "+7", "-8\t", "1.5", "1e3", "0x10", "7a", "a7", "NaN", "-Infinity", "inf", ".5", "5.", "\x007\x7f", "99999999999", "1 2", "--1", "٧", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "_id int, s string")
    db.catalog.register("t", df)
    kinds = {"int": "int", "long": "bigint", "double": "double", "decimal": "decimal(38,10)"}
    got = db.aggregate("t", [{"$project": {t: {"$convert": {"input": "$s", "to": t, "onError": -3, "onNull": -4}} for t in kinds}}])
    want = df.select("_id", *(F.when(F.col("s").isNull(), -4).otherwise(F.coalesce(F.col("s").try_cast(c), F.lit(-3))).alias(t) for t, c in kinds.items()))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = db.aggregate("t", [{"$project": {"x": {"$convert": {"input": "$s", "to": "int", "onError": -3}}}}])._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan and plan.count("try_cast") == 1
    with pytest.raises(Exception, match="converted"):
        db.aggregate("t", [{"$project": {"x": {"$toInt": "$s"}}}]).collect()
