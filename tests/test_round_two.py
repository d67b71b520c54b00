import pytest

from millrace import Database
from millrace.functions.expressions import ExpressionError
from millrace.operators.buckets import round_up
from millrace.shared import shared_dir


def test_series_numbers():
    assert [round_up(x, "R80") for x in (115, 118, 126, 790)] == [118, 122, 129, 794]
    assert round_up(910, "E192") == 920 and round_up(9.21, "E192") == pytest.approx(9.31) and round_up(101, "E96") == 102


def test_n_forms_gather_no_group(spark, sf):
    from millrace.plans.queries import database

    plan = database(spark, sf).aggregate("orders", [{"$group": {"_id": "$o_orderstatus", "m": {"$maxN": {"input": "$o_orderkey", "n": 3}}}}])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_n_forms_of_null_keys_and_empty_groups(spark):
    db = Database(spark)
    db.catalog.register("t", spark.createDataFrame([(None, 3), (None, 1), ("a", None), ("b", 2)], "k string, v int"))
    got = {r._id: (r.hi, r.n) for r in db.aggregate("t", [{"$group": {"_id": "$k", "hi": {"$maxN": {"input": "$v", "n": 2}}, "n": {"$sum": 1}}}]).collect()}
    assert got == {None: ([3, 1], 2), "a": ([], 1), "b": ([2], 1)}
    assert db.aggregate("t", [{"$match": {"v": {"$gt": 9}}}, {"$group": {"_id": None, "hi": {"$maxN": {"input": "$v", "n": 2}}}}]).collect() == []


def test_correlated_equality_limits_each_row(spark):
    db = Database(spark)
    db.catalog.register("l", spark.createDataFrame([(1,), (2,), (2,)], "k int"))
    db.catalog.register("r", spark.createDataFrame([(1, 1), (1, 2), (2, 3), (2, 4)], "k int, v int"))
    out = db.aggregate("l", [{"$lookup": {"from": "r", "let": {"x": "$k"}, "pipeline": [{"$match": {"$expr": {"$eq": ["$k", "$$x"]}}}, {"$sort": {"v": -1}}, {"$limit": 1}], "as": "m"}}]).collect()
    assert sorted((r.k, [x.v for x in r.m]) for r in out) == [(1, [2]), (2, [4]), (2, [4])]


def test_graph_search_counts_equal_nodes(spark):
    db = Database(spark)
    db.catalog.register("g", spark.createDataFrame([(1, 2), (2, 3), (2, 3), (3, 1)], "id int, to int"))
    got = db.aggregate("g", [{"$match": {"id": 1}}, {"$graphLookup": {"from": "g", "startWith": "$to", "connectFromField": "to", "connectToField": "id", "as": "all", "depthField": "d"}}]).first()
    assert [(x.id, x.d) for x in got["all"]] == [(2, 0), (2, 0), (3, 1), (1, 2)]


def test_array_filters_are_checked(spark):
    db = Database(spark)
    db.catalog.register("t", spark.createDataFrame([(1, [1, 2])], "_id int, a array<int>"))
    with pytest.raises(ExpressionError):
        db.catalog.update("t", {}, {"$set": {"a.$[x]": 1}})
    with pytest.raises(ExpressionError):
        db.catalog.update("t", {}, {"$set": {"a.$": 1}})


def test_collations(spark):
    db = Database(spark)
    db.catalog.register("c", spark.createDataFrame([(1, "Élan"), (2, "elan"), (3, "ELAN")], "_id int, s string"))
    ids = lambda n: {r._id for r in db.find("c", {"s": "elan"}, collation={"locale": "en", "strength": n}).collect()}
    assert (ids(1), ids(2), ids(3)) == ({1, 2, 3}, {2, 3}, {2})
    assert db.find("c", collation={"locale": "fr", "strength": 1}).schema == db.find("c").schema
    with pytest.raises(ExpressionError):
        db.find("c", collation={"locale": "en", "numericOrdering": True})


def test_resume_after_a_token(spark, tmp_path):
    from millrace.streaming.changes import ChangeLog

    log = ChangeLog(spark, f"file://{tmp_path}/log", "_id int, v int")
    for v in range(4):
        log.record("insert", spark.createDataFrame([(v, v)], "_id int, v int"))
    tokens = sorted(r.token for r in spark.read.parquet(f"{tmp_path}/log").collect())
    assert len(set(tokens)) == 4
    q = log.watch(resume_after=tokens[1]).writeStream.format("memory").queryName("resumed").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.fullDocument.v for r in spark.table("resumed").collect()) == [2, 3]


def test_shared_folder(spark):
    assert shared_dir(spark) == shared_dir(spark)
