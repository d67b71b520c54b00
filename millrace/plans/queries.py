"""Registered queries of the engine, each with the SQL that gives the same rows."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Database

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings", "documents", "conversations", "pages", "labels", "benchmark")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class _Tables(Database):
    """Tables of a folder, read when a pipeline names them."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark)
        self.folder = folder.rstrip("/")

    def collection(self, name: str) -> DataFrame:
        if name in TABLES and name not in self.catalog.frames:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return super().collection(name)


def database(spark: SparkSession, folder: str) -> Database:
    return _Tables(spark, folder)


def pipeline(name: str, table: str | None, stages: list[dict], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: database(spark, sf_dir).aggregate(table, stages)
    if sql:
        ORACLES[name] = sql


def find(name: str, table: str, sql: str, **kwargs) -> None:
    QUERIES[name] = lambda spark, sf_dir: database(spark, sf_dir).find(table, **kwargs)
    ORACLES[name] = sql


def day(y: int, m: int, d: int) -> datetime.datetime:
    return datetime.datetime(y, m, d)


R = lambda e, n=2: {"$round": [e, n]}

# groups

pipeline(
    "group_pricing_summary",
    "lineitem",
    [
        {"$match": {"l_shipdate": {"$lte": day(1998, 9, 2)}}},
        {"$group": {"_id": {"flag": "$l_returnflag", "status": "$l_linestatus"}, "sum_qty": {"$sum": "$l_quantity"}, "sum_price": {"$sum": {"$multiply": ["$l_extendedprice", {"$subtract": [1, "$l_discount"]}]}}, "avg_qty": {"$avg": "$l_quantity"}, "n": {"$sum": 1}}},
        {"$project": {"_id": 0, "flag": "$_id.flag", "status": "$_id.status", "sum_qty": 1, "sum_price": R("$sum_price"), "avg_qty": R("$avg_qty", 4), "n": 1}},
        {"$sort": {"flag": 1, "status": 1}},
    ],
    "SELECT l_returnflag AS flag, l_linestatus AS status, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_price, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
)
pipeline(
    "group_accumulators",
    "orders",
    [
        {"$group": {"_id": "$o_orderpriority", "lo": {"$min": "$o_totalprice"}, "hi": {"$max": "$o_totalprice"}, "pop": {"$stdDevPop": "$o_totalprice"}, "samp": {"$stdDevSamp": "$o_totalprice"}, "n": {"$count": {}}}},
        {"$project": {"lo": 1, "hi": 1, "pop": R("$pop"), "samp": R("$samp"), "n": 1}},
    ],
    'SELECT o_orderpriority AS "_id", min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(stddev_pop(o_totalprice), 2) AS pop, round(stddev_samp(o_totalprice), 2) AS samp, count(*) AS n FROM orders GROUP BY 1',
)
pipeline(
    "group_first_last_top_bottom",
    "orders",
    [
        {"$sort": {"o_orderdate": 1, "o_orderkey": 1}},
        {"$group": {"_id": "$o_orderstatus", "first": {"$first": "$o_orderkey"}, "last": {"$last": "$o_orderkey"}, "top": {"$top": {"output": "$o_orderkey", "sortBy": {"o_totalprice": -1, "o_orderkey": 1}}}, "bottom": {"$bottom": {"output": "$o_orderkey", "sortBy": {"o_totalprice": -1, "o_orderkey": 1}}}}},
    ],
    'SELECT o_orderstatus AS "_id", first(o_orderkey ORDER BY o_orderdate, o_orderkey) AS "first", last(o_orderkey ORDER BY o_orderdate, o_orderkey) AS "last", first(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS top, last(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS bottom FROM orders GROUP BY 1',
)
pipeline(
    "group_n_forms",
    "orders",
    [
        {"$group": {"_id": "$o_orderstatus", "max3": {"$maxN": {"input": "$o_orderkey", "n": 3}}, "min3": {"$minN": {"input": "$o_orderkey", "n": 3}}, "top2": {"$topN": {"output": "$o_orderkey", "sortBy": {"o_orderkey": -1}, "n": 2}}, "bottom2": {"$bottomN": {"output": "$o_orderkey", "sortBy": {"o_orderkey": -1}, "n": 2}}}},
        {"$project": {"max3": {"$sum": "$max3"}, "min3": {"$sum": "$min3"}, "top2": {"$first": "$top2"}, "bottom2": {"$last": "$bottom2"}}},
    ],
    'SELECT o_orderstatus AS "_id", CAST(list_sum(max(o_orderkey, 3)) AS BIGINT) AS max3, CAST(list_sum(min(o_orderkey, 3)) AS BIGINT) AS min3, max(o_orderkey) AS top2, min(o_orderkey) AS bottom2 FROM orders GROUP BY 1',
)
pipeline(
    "group_push_addtoset",
    "nation",
    [{"$sort": {"n_name": -1}}, {"$group": {"_id": "$n_regionkey", "names": {"$push": "$n_name"}, "set": {"$addToSet": "$n_regionkey"}}}, {"$project": {"names": {"$reduce": {"input": "$names", "initialValue": "", "in": {"$concat": ["$$value", "|", "$$this"]}}}, "kinds": {"$size": "$set"}}}],
    "SELECT n_regionkey AS \"_id\", '|' || string_agg(n_name, '|' ORDER BY n_name DESC) AS names, 1 AS kinds FROM nation GROUP BY 1",
)
pipeline(
    "group_merge_objects",
    "supplier",
    [{"$sort": {"s_suppkey": 1}}, {"$group": {"_id": "$s_nationkey", "m": {"$mergeObjects": {"k": "$s_suppkey", "name": "$s_name"}}}}, {"$project": {"k": "$m.k", "name": "$m.name"}}],
    'SELECT s_nationkey AS "_id", max(s_suppkey) AS k, arg_max(s_name, s_suppkey) AS name FROM supplier GROUP BY 1',
)
pipeline(
    "group_percentile_median",
    "lineitem",
    [{"$group": {"_id": "$l_returnflag", "p": {"$percentile": {"input": "$l_quantity", "p": [0.25, 0.9], "method": "approximate"}}, "m": {"$median": {"input": "$l_quantity", "method": "approximate"}}}}, {"$project": {"p25": {"$arrayElemAt": ["$p", 0]}, "p90": {"$arrayElemAt": ["$p", 1]}, "m": 1}}],
    'SELECT l_returnflag AS "_id", quantile_disc(l_quantity, 0.25) AS p25, quantile_disc(l_quantity, 0.9) AS p90, quantile_disc(l_quantity, 0.5) AS m FROM lineitem GROUP BY 1',
)
pipeline("group_count_distinct", "lineitem", [{"$group": {"_id": {"f": "$l_returnflag", "s": "$l_suppkey"}}}, {"$group": {"_id": "$_id.f", "suppliers": {"$sum": 1}}}], 'SELECT l_returnflag AS "_id", count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1')
pipeline("sort_by_count", "events", [{"$sortByCount": "$event_type"}], 'SELECT event_type AS "_id", count(*) AS count FROM events GROUP BY 1')
pipeline("count_stage", "orders", [{"$match": {"o_orderstatus": "F"}}, {"$count": "n"}], "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
pipeline(
    "bucket",
    "part",
    [{"$bucket": {"groupBy": "$p_retailprice", "boundaries": [0, 1000, 1200, 1500], "default": 9999, "output": {"n": {"$sum": 1}, "size": {"$sum": "$p_size"}}}}],
    'SELECT CASE WHEN p_retailprice >= 0 AND p_retailprice < 1000 THEN 0 WHEN p_retailprice >= 1000 AND p_retailprice < 1200 THEN 1000 WHEN p_retailprice >= 1200 AND p_retailprice < 1500 THEN 1200 ELSE 9999 END AS "_id", count(*) AS n, CAST(sum(p_size) AS BIGINT) AS size FROM part GROUP BY 1',
)
pipeline(
    "bucket_auto",
    "orders",
    [{"$bucketAuto": {"groupBy": "$o_orderkey", "buckets": 4}}, {"$project": {"_id": 0, "lo": "$_id.min", "hi": "$_id.max", "count": 1}}],
    "WITH b AS (SELECT o_orderkey, ntile(4) OVER (ORDER BY o_orderkey) AS t FROM orders), g AS (SELECT t, min(o_orderkey) AS lo, max(o_orderkey) AS top, count(*) AS count FROM b GROUP BY t) SELECT lo, coalesce(lead(lo) OVER (ORDER BY t), top) AS hi, count FROM g",
)

# filters

find("find_ranges", "lineitem", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_discount > 0.05 AND l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-12-31'", query={"l_quantity": {"$gte": 45}, "l_discount": {"$gt": 0.05}, "l_shipdate": {"$gte": day(1995, 1, 1), "$lte": day(1995, 12, 31)}}, projection={"l_orderkey": 1, "l_linenumber": 1, "l_quantity": 1})
find("find_in_or_not", "part", "SELECT p_partkey, p_brand, p_size FROM part WHERE (p_size IN (1, 2, 3) OR p_retailprice < 950) AND NOT (p_brand = 'Brand#11') AND p_partkey % 7 = 3", query={"$or": [{"p_size": {"$in": [1, 2, 3]}}, {"p_retailprice": {"$lt": 950}}], "p_brand": {"$not": {"$eq": "Brand#11"}}, "p_partkey": {"$mod": [7, 3]}}, projection={"p_partkey": 1, "p_brand": 1, "p_size": 1})
find("find_regex_nor_exists", "customer", "SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '7$') AND NOT (c_acctbal < 0 OR c_mktsegment = 'BUILDING') AND c_nationkey IS NOT NULL", query={"c_name": {"$regex": "7$"}, "$nor": [{"c_acctbal": {"$lt": 0}}, {"c_mktsegment": "BUILDING"}], "c_nationkey": {"$exists": True}, "nowhere": {"$exists": False}}, projection={"c_custkey": 1, "c_name": 1})
find("find_bits_type", "orders", "SELECT o_orderkey FROM orders WHERE o_orderkey & 5 = 5 AND o_orderkey & 2 = 0 AND o_orderkey & 24 <> 0 AND o_orderkey & 96 <> 96", query={"o_orderkey": {"$bitsAllSet": 5, "$bitsAllClear": [1], "$bitsAnySet": 24, "$bitsAnyClear": 96, "$type": "long"}}, projection={"o_orderkey": 1})
find("find_expr", "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice / l_quantity > 1800 AND l_tax > l_discount", query={"$expr": {"$and": [{"$gt": [{"$divide": ["$l_extendedprice", "$l_quantity"]}, 1800]}, {"$gt": ["$l_tax", "$l_discount"]}]}}, projection={"l_orderkey": 1, "l_linenumber": 1})
find("find_top_k", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10", sort_by={"o_totalprice": -1, "o_orderkey": 1}, skip=10, limit=20, projection={"o_orderkey": 1, "o_totalprice": 1})
find("find_text", "documents", r"SELECT doc_id FROM documents WHERE regexp_matches(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '(^|[^\p{L}\p{N}_])(secret|token)([^\p{L}\p{N}_]|$)')", query={"$text": {"$search": "secret token", "$fields": ["text"]}}, projection={"doc_id": 1})
find("find_json_schema", "customer", "SELECT c_custkey FROM customer WHERE c_acctbal >= 0 AND c_acctbal < 5000 AND length(c_mktsegment) <= 8", query={"$jsonSchema": {"required": ["c_custkey"], "properties": {"c_acctbal": {"bsonType": "double", "minimum": 0, "maximum": 5000, "exclusiveMaximum": True}, "c_mktsegment": {"bsonType": "string", "maxLength": 8}}}}, projection={"c_custkey": 1})

# arrays of documents: orders with their lines

ORDERS = [
    {"$sort": {"l_linenumber": 1, "l_partkey": 1, "l_quantity": 1}},
    {"$group": {"_id": "$l_orderkey", "lines": {"$push": {"n": "$l_linenumber", "qty": "$l_quantity", "part": "$l_partkey", "flag": "$l_returnflag"}}}},
]
pipeline("unwind_index", "lineitem", [*ORDERS, {"$unwind": {"path": "$lines", "includeArrayIndex": "at"}}, {"$match": {"at": 2}}, {"$project": {"qty": "$lines.qty", "at": 1}}], 'SELECT "_id", qty, 2 AS at FROM (SELECT l_orderkey AS "_id", l_quantity AS qty, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS r FROM lineitem) WHERE r = 3')
pipeline("array_elem_match", "lineitem", [*ORDERS, {"$match": {"lines": {"$elemMatch": {"qty": {"$gte": 45}, "flag": "R"}}, "lines.part": {"$gt": 10}}}, {"$project": {"n": {"$size": "$lines"}}}], "SELECT l_orderkey AS \"_id\", count(*) AS n FROM lineitem GROUP BY 1 HAVING bool_or(l_quantity >= 45 AND l_returnflag = 'R') AND bool_or(l_partkey > 10)")
pipeline("array_size_all", "lineitem", [*ORDERS, {"$match": {"lines": {"$size": 4}, "lines.flag": {"$all": ["R", "N"]}}}, {"$project": {"_id": 1}}], "SELECT l_orderkey AS \"_id\" FROM lineitem GROUP BY 1 HAVING count(*) = 4 AND bool_or(l_returnflag = 'R') AND bool_or(l_returnflag = 'N')")
pipeline(
    "array_filter_map_reduce",
    "lineitem",
    [*ORDERS, {"$project": {"big": {"$size": {"$filter": {"input": "$lines", "as": "x", "cond": {"$gt": ["$$x.qty", 25]}}}}, "total": {"$reduce": {"input": "$lines", "initialValue": 0.0, "in": {"$add": ["$$value", "$$this.qty"]}}}, "double": {"$sum": {"$map": {"input": "$lines", "as": "x", "in": {"$multiply": ["$$x.qty", 2]}}}}, "first": {"$first": "$lines.n"}}}],
    'SELECT l_orderkey AS "_id", CAST(count(*) FILTER (l_quantity > 25) AS INT) AS big, sum(l_quantity) AS total, 2 * sum(l_quantity) AS double, min(l_linenumber) AS "first" FROM lineitem GROUP BY 1',
)
pipeline(
    "array_functions",
    "lineitem",
    [
        {"$sort": {"l_linenumber": 1, "l_partkey": 1, "l_quantity": 1}},
        {"$group": {"_id": "$l_orderkey", "q": {"$push": "$l_quantity"}}},
        {"$project": {"last": {"$last": "$q"}, "third": {"$arrayElemAt": ["$q", 2]}, "has": {"$in": [10.0, "$q"]}, "at": {"$indexOfArray": ["$q", 10.0]}, "two": {"$sum": {"$slice": ["$q", 2]}}, "rev": {"$first": {"$reverseArray": "$q"}}, "low": {"$first": {"$sortArray": {"input": "$q", "sortBy": 1}}}, "kinds": {"$size": {"$setUnion": ["$q", []]}}, "avg": R({"$avg": "$q"}, 4)}},
    ],
    'WITH g AS (SELECT l_orderkey AS "_id", list(l_quantity ORDER BY l_linenumber, l_partkey, l_quantity) AS q FROM lineitem GROUP BY 1) SELECT "_id", q[len(q)] AS "last", q[3] AS third, list_contains(q, 10.0) AS has, coalesce(list_position(q, 10.0), 0) - 1 AS at, list_sum(q[1:2]) AS two, q[len(q)] AS rev, list_min(q) AS low, CAST(len(list_distinct(q)) AS INT) AS kinds, round(list_avg(q), 4) AS avg FROM g',
)

# joins

pipeline("lookup", "customer", [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "o"}}, {"$project": {"c_custkey": 1, "n": {"$size": "$o"}, "total": R({"$sum": "$o.o_totalprice"})}}], "SELECT c_custkey, CAST(count(o_orderkey) AS INT) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
pipeline("lookup_unwind", "nation", [{"$lookup": {"from": "supplier", "localField": "n_nationkey", "foreignField": "s_nationkey", "as": "s"}}, {"$unwind": {"path": "$s", "preserveNullAndEmptyArrays": True}}, {"$project": {"n_name": 1, "s_name": "$s.s_name"}}], "SELECT n_name, s_name FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey")
pipeline(
    "lookup_correlated",
    "customer",
    [
        {"$lookup": {"from": "orders", "let": {"k": "$c_custkey", "b": "$c_acctbal"}, "pipeline": [{"$match": {"$expr": {"$and": [{"$eq": ["$o_custkey", "$$k"]}, {"$gt": ["$o_totalprice", {"$multiply": ["$$b", 20]}]}]}}}, {"$project": {"o_orderkey": 1}}], "as": "big"}},
        {"$project": {"c_custkey": 1, "n": {"$size": "$big"}, "top": {"$max": "$big.o_orderkey"}}},
    ],
    "SELECT c_custkey, CAST(count(o_orderkey) AS INT) AS n, max(o_orderkey) AS top FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 20 GROUP BY 1",
)
pipeline(
    "lookup_chain_revenue",
    "orders",
    [
        {"$lookup": {"from": "customer", "localField": "o_custkey", "foreignField": "c_custkey", "as": "c"}},
        {"$unwind": "$c"},
        {"$lookup": {"from": "nation", "localField": "c.c_nationkey", "foreignField": "n_nationkey", "as": "n"}},
        {"$unwind": "$n"},
        {"$group": {"_id": "$n.n_name", "revenue": {"$sum": "$o_totalprice"}, "orders": {"$sum": 1}}},
        {"$project": {"revenue": R("$revenue"), "orders": 1}},
    ],
    'SELECT n_name AS "_id", round(sum(o_totalprice), 2) AS revenue, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1',
)
pipeline("union_with", "customer", [{"$project": {"k": "$c_custkey", "name": "$c_name"}}, {"$unionWith": {"coll": "supplier", "pipeline": [{"$project": {"k": "$s_suppkey", "name": "$s_name"}}]}}, {"$match": {"k": {"$lte": 5}}}], "SELECT * FROM (SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier) WHERE k <= 5")
pipeline("union_with_whole", "customer", [{"$project": {"k": "$c_custkey", "name": "$c_name"}}, {"$unionWith": {"coll": "supplier", "pipeline": [{"$project": {"k": "$s_suppkey", "name": "$s_name"}}]}}], "SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
pipeline("facet", "part", [{"$facet": {"brands": [{"$sortByCount": "$p_brand"}, {"$count": "n"}], "large": [{"$match": {"p_size": {"$gt": 40}}}, {"$count": "n"}]}}, {"$project": {"brands": {"$first": "$brands.n"}, "large": {"$first": "$large.n"}}}], "SELECT count(DISTINCT p_brand) AS brands, count(*) FILTER (p_size > 40) AS large FROM part")


def graph_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains part key -> half of it, for every part."""
    db = database(spark, sf_dir)
    db.catalog.register("chain", db.collection("part").select("p_partkey", F.floor(F.col("p_partkey") / 2).alias("up")))
    return db.aggregate("chain", [{"$match": {"p_partkey": {"$gte": 100}}}, {"$graphLookup": {"from": "chain", "startWith": "$up", "connectFromField": "up", "connectToField": "p_partkey", "as": "all", "maxDepth": 3, "depthField": "d"}}, {"$project": {"p_partkey": 1, "n": {"$size": "$all"}, "deep": {"$max": "$all.d"}, "total": {"$sum": "$all.p_partkey"}}}])


QUERIES["graph_lookup"] = graph_lookup
ORACLES["graph_lookup"] = """
WITH RECURSIVE c AS (SELECT p_partkey, p_partkey // 2 AS up FROM part),
w AS (
  SELECT a.p_partkey AS s, b.p_partkey AS k, b.up, 0 AS d FROM c a JOIN c b ON a.up = b.p_partkey WHERE a.p_partkey >= 100
  UNION SELECT s, b.p_partkey, b.up, d + 1 FROM w JOIN c b ON w.up = b.p_partkey WHERE d < 3
)
SELECT c.p_partkey, CAST(count(k) AS INT) AS n, max(d) AS deep, CAST(coalesce(sum(k), 0) AS BIGINT) AS total FROM c LEFT JOIN w ON c.p_partkey = s WHERE c.p_partkey >= 100 GROUP BY 1
"""

# windows

pipeline(
    "window_ranks",
    "customer",
    [{"$setWindowFields": {"partitionBy": "$c_nationkey", "sortBy": {"c_acctbal": -1}, "output": {"rank": {"$rank": {}}, "dense": {"$denseRank": {}}, "next": {"$shift": {"output": "$c_acctbal", "by": 1}}}}}, {"$match": {"rank": {"$lte": 3}}}, {"$project": {"c_custkey": 1, "rank": 1, "dense": 1, "next": 1}}],
    'SELECT c_custkey, rank, dense, next FROM (SELECT c_custkey, rank() OVER w AS rank, dense_rank() OVER w AS dense, lead(c_acctbal) OVER w AS next FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC)) WHERE rank <= 3',
)
pipeline(
    "window_frames",
    "events",
    [
        {"$setWindowFields": {"partitionBy": "$user_id", "sortBy": {"event_id": 1}, "output": {"n": {"$documentNumber": {}}, "run": {"$sum": "$value", "window": {"documents": ["unbounded", "current"]}}, "near": {"$avg": "$value", "window": {"documents": [-1, 1]}}, "top": {"$max": "$value", "window": {"documents": [-2, 0]}}, "c": {"$count": {}, "window": {"range": [-1000, 0]}}}}},
        {"$project": {"event_id": 1, "n": 1, "run": R("$run", 4), "near": R("$near", 4), "top": 1, "c": 1}},
    ],
    "SELECT event_id, row_number() OVER w AS n, round(sum(value) OVER (w ROWS UNBOUNDED PRECEDING), 4) AS run, round(avg(value) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS near, max(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS top, count(*) OVER (w RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW) AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
)
pipeline(
    "window_time_range",
    "events",
    [{"$setWindowFields": {"partitionBy": "$event_type", "sortBy": {"ts": 1}, "output": {"hour": {"$sum": "$value", "window": {"range": [-1, 0], "unit": "hour"}}}}}, {"$project": {"event_id": 1, "hour": R("$hour", 3)}}],
    "SELECT event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY epoch_ms(ts) RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW), 3) AS hour FROM events",
)
pipeline(
    "fill_locf_linear",
    "events",
    [
        {"$project": {"event_id": 1, "user_id": 1, "v": {"$cond": [{"$eq": [{"$mod": ["$event_id", 3]}, 0]}, "$value", None]}}},
        {"$addFields": {"w": "$v", "z": "$v"}},
        {"$fill": {"partitionBy": "$user_id", "sortBy": {"event_id": 1}, "output": {"v": {"method": "locf"}, "w": {"method": "linear"}, "z": {"value": -1}}}},
        {"$project": {"event_id": 1, "v": 1, "w": 1, "z": 1}},
    ],
    """
WITH a AS (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events),
b AS (SELECT *, last_value(v IGNORE NULLS) OVER p AS y0, last_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER p AS x0,
  first_value(v IGNORE NULLS) OVER f AS y1, first_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER f AS x1 FROM a
  WINDOW p AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, y0 AS v, coalesce(v, CASE WHEN x0 IS NOT NULL AND x1 IS NOT NULL THEN y0 + (y1 - y0) * (event_id - x0) / (x1 - x0) END) AS w, coalesce(v, -1) AS z FROM b
""",
)
pipeline(
    "densify",
    "events",
    [
        {"$group": {"_id": {"u": "$user_id", "d": {"$dateTrunc": {"date": "$ts", "unit": "day"}}}, "n": {"$sum": 1}}},
        {"$project": {"_id": 0, "u": "$_id.u", "d": "$_id.d", "n": 1}},
        {"$match": {"u": {"$lte": 20}}},
        {"$densify": {"field": "d", "partitionByFields": ["u"], "range": {"step": 1, "unit": "day", "bounds": "partition"}}},
        {"$group": {"_id": "$u", "days": {"$sum": 1}, "events": {"$sum": "$n"}}},
    ],
    "SELECT user_id AS \"_id\", date_diff('day', min(date_trunc('day', ts)), max(date_trunc('day', ts))) + 1 AS days, count(*) AS events FROM events WHERE user_id <= 20 GROUP BY 1",
)
pipeline(
    "densify_whole",
    "events",
    [
        {"$group": {"_id": {"u": "$user_id", "d": {"$dateTrunc": {"date": "$ts", "unit": "day"}}}, "n": {"$sum": 1}}},
        {"$project": {"_id": 0, "u": "$_id.u", "d": "$_id.d", "n": 1}},
        {"$densify": {"field": "d", "partitionByFields": ["u"], "range": {"step": 1, "unit": "day", "bounds": "partition"}}},
        {"$group": {"_id": "$u", "days": {"$sum": 1}, "events": {"$sum": "$n"}}},
    ],
    "SELECT user_id AS \"_id\", date_diff('day', min(date_trunc('day', ts)), max(date_trunc('day', ts))) + 1 AS days, count(*) AS events FROM events GROUP BY 1",
)
pipeline(
    "window_calculus",
    "orders",
    [
        {"$setWindowFields": {"partitionBy": "$o_custkey", "sortBy": {"o_orderkey": 1}, "output": {"slope": {"$derivative": {"input": "$o_totalprice"}, "window": {"documents": [-1, 0]}}, "area": {"$integral": {"input": "$o_totalprice"}, "window": {"documents": [-1, 0]}}, "ema": {"$expMovingAvg": {"input": "$o_totalprice", "alpha": 0.5}}, "cov": {"$covariancePop": ["$o_orderkey", "$o_totalprice"], "window": {"documents": [-2, 0]}}}}},
        {"$project": {"o_orderkey": 1, "slope": 1, "area": 1, "up": {"$gt": ["$cov", 0.5]}, "first": {"$eq": ["$ema", "$o_totalprice"]}}},
    ],
    """
SELECT o_orderkey, (o_totalprice - lag(o_totalprice) OVER w) / (o_orderkey - lag(o_orderkey) OVER w) AS slope,
  coalesce((o_orderkey - lag(o_orderkey) OVER w) * (lag(o_totalprice) OVER w + o_totalprice) / 2, 0) AS area,
  covar_pop(o_orderkey, o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) > 0.5 AS up, row_number() OVER w = 1 AS "first"
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)
""",
)

# expressions

pipeline(
    "expr_math",
    "part",
    [{"$project": {"p_partkey": 1, "a": {"$abs": {"$subtract": ["$p_size", 25]}}, "m": {"$mod": ["$p_partkey", 7]}, "c": {"$ceil": "$p_retailprice"}, "f": {"$floor": "$p_retailprice"}, "s": R({"$sqrt": "$p_retailprice"}, 4), "l": R({"$ln": "$p_retailprice"}, 4), "p": {"$pow": ["$p_size", 2]}, "t": {"$trunc": ["$p_retailprice"]}, "x": R({"$sin": "$p_size"}, 4), "b": {"$bitXor": ["$p_size", 5]}}}],
    "SELECT p_partkey, abs(p_size - 25) AS a, p_partkey % 7 AS m, CAST(ceil(p_retailprice) AS BIGINT) AS c, CAST(floor(p_retailprice) AS BIGINT) AS f, round(sqrt(p_retailprice), 4) AS s, round(ln(p_retailprice), 4) AS l, p_size * p_size AS p, trunc(p_retailprice) AS t, round(sin(p_size), 4) AS x, xor(p_size, 5) AS b FROM part",
)
pipeline(
    "expr_strings",
    "customer",
    [{"$project": {"c_custkey": 1, "low": {"$toLower": "$c_mktsegment"}, "both": {"$concat": ["$c_name", "/", "$c_mktsegment"]}, "sub": {"$substrCP": ["$c_name", 9, 4]}, "n": {"$strLenCP": "$c_name"}, "at": {"$indexOfCP": ["$c_name", "#"]}, "cmp": {"$strcasecmp": ["$c_mktsegment", "furniture"]}, "parts": {"$size": {"$split": ["$c_name", "#"]}}, "one": {"$replaceOne": {"input": "$c_name", "find": "0", "replacement": "x"}}, "all": {"$replaceAll": {"input": "$c_name", "find": "0", "replacement": "x"}}, "hit": {"$regexMatch": {"input": "$c_name", "regex": "1[0-4]$"}}, "trim": {"$ltrim": {"input": "$c_name", "chars": "Cust"}}}}],
    "SELECT c_custkey, lower(c_mktsegment) AS low, c_name || '/' || c_mktsegment AS both, substr(c_name, 10, 4) AS sub, CAST(length(c_name) AS INT) AS n, CAST(strpos(c_name, '#') - 1 AS INT) AS at, CASE WHEN upper(c_mktsegment) < 'FURNITURE' THEN -1 WHEN upper(c_mktsegment) > 'FURNITURE' THEN 1 ELSE 0 END AS cmp, CAST(len(string_split(c_name, '#')) AS INT) AS parts, regexp_replace(c_name, '0', 'x') AS one, replace(c_name, '0', 'x') AS all, regexp_matches(c_name, '1[0-4]$') AS hit, ltrim(c_name, 'Cust') AS trim FROM customer",
)
pipeline(
    "expr_dates",
    "orders",
    [{"$project": {"o_orderkey": 1, "y": {"$year": "$o_orderdate"}, "m": {"$month": "$o_orderdate"}, "d": {"$dayOfMonth": "$o_orderdate"}, "w": {"$isoWeek": "$o_orderdate"}, "dow": {"$dayOfWeek": "$o_orderdate"}, "q": {"$dateTrunc": {"date": "$o_orderdate", "unit": "quarter"}}, "diff": {"$dateDiff": {"startDate": "$o_orderdate", "endDate": {"$literal": day(1999, 1, 1)}, "unit": "month"}}, "next": {"$dateAdd": {"startDate": "$o_orderdate", "unit": "day", "amount": 30}}, "s": {"$dateToString": {"date": "$o_orderdate", "format": "%Y/%m/%d"}}}}],
    "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d, CAST(week(o_orderdate) AS INT) AS w, CAST(dayofweek(o_orderdate) + 1 AS INT) AS dow, CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP) AS q, date_diff('month', o_orderdate, TIMESTAMP '1999-01-01') AS diff, o_orderdate + INTERVAL 30 DAY AS next, strftime(o_orderdate, '%Y/%m/%d') AS s FROM orders",
)
pipeline(
    "expr_conditions",
    "lineitem",
    [{"$project": {"l_orderkey": 1, "l_linenumber": 1, "band": {"$switch": {"branches": [{"case": {"$lt": ["$l_quantity", 10]}, "then": "small"}, {"case": {"$lt": ["$l_quantity", 30]}, "then": "medium"}], "default": "large"}}, "c": {"$cmp": ["$l_tax", "$l_discount"]}, "ret": {"$cond": {"if": {"$eq": ["$l_returnflag", "R"]}, "then": 1, "else": 0}}, "n": {"$ifNull": ["$missing", "none"]}, "t": {"$type": "$l_quantity"}, "i": {"$toInt": "$l_quantity"}, "s": {"$toString": "$l_linenumber"}}}],
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END AS band, CASE WHEN l_tax < l_discount THEN -1 WHEN l_tax > l_discount THEN 1 ELSE 0 END AS c, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS ret, 'none' AS n, 'double' AS t, CAST(l_quantity AS INT) AS i, CAST(l_linenumber AS VARCHAR) AS s FROM lineitem",
)
pipeline(
    "expr_objects",
    "supplier",
    [{"$project": {"o": {"$mergeObjects": [{"k": "$s_suppkey", "b": 1}, {"b": "$s_nationkey"}]}, "s_suppkey": 1}}, {"$addFields": {"o.c": {"$getField": {"field": "b", "input": "$o"}}}}, {"$replaceRoot": {"newRoot": "$o"}}, {"$project": {"k": 1, "b": 1, "c": 1}}],
    "SELECT s_suppkey AS k, s_nationkey AS b, s_nationkey AS c FROM supplier",
)
pipeline(
    "redact",
    "nation",
    [{"$project": {"n_name": 1, "level": "$n_regionkey", "more": {"level": {"$mod": ["$n_nationkey", 3]}, "key": "$n_nationkey"}}}, {"$redact": {"$cond": [{"$lte": ["$level", 1]}, "$$DESCEND", "$$PRUNE"]}}, {"$project": {"n_name": 1, "level": 1, "key": "$more.key"}}],
    "SELECT n_name, n_regionkey AS level, CASE WHEN n_nationkey % 3 <= 1 THEN n_nationkey END AS key FROM nation WHERE n_regionkey <= 1",
)

# search


def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact nearest neighbours (squared euclidean order) of a fixed vector."""
    db = database(spark, sf_dir)
    n = len(db.collection("embeddings").select("embedding").first()[0])
    return db.aggregate("embeddings", [{"$search": {"cosmosSearch": {"vector": [((i * 7) % 11 - 5) / 5 for i in range(n)], "path": "embedding", "k": 10, "metric": "euclidean"}}}, {"$project": {"vec_id": 1, "label": 1}}])


QUERIES["vector_search"] = vector_search
ORACLES["vector_search"] = "SELECT vec_id, label FROM embeddings ORDER BY list_sum(list_transform(embedding, lambda x, i: (x - ((((i - 1) * 7) % 11) - 5) / 5.0) ** 2)) LIMIT 10"


def geo_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir)
    db.catalog.register("places", db.collection("customer").select("c_custkey", F.array((F.col("c_custkey") % 360 - 180).cast("double"), (F.col("c_custkey") % 90).cast("double")).alias("at")))
    return db.aggregate("places", [{"$geoNear": {"near": [10.0, 20.0], "key": "at", "distanceField": "d", "maxDistance": 30}}, {"$match": {"at": {"$geoWithin": {"$box": [[-10, 0], [40, 45]]}}}}, {"$project": {"c_custkey": 1, "d": R("$d", 4)}}])


QUERIES["geo_near"] = geo_near
ORACLES["geo_near"] = "SELECT c_custkey, round(d, 4) AS d FROM (SELECT c_custkey, x, y, sqrt((x - 10) ** 2 + (y - 20) ** 2) AS d FROM (SELECT c_custkey, CAST(c_custkey % 360 - 180 AS DOUBLE) AS x, CAST(c_custkey % 90 AS DOUBLE) AS y FROM customer)) WHERE d <= 30 AND x BETWEEN -10 AND 40 AND y BETWEEN 0 AND 45"


# writes


def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir)
    nation = db.collection("nation").select(F.col("n_nationkey").alias("_id"), F.col("n_name").alias("name"), F.lit(0).alias("v"))
    db.catalog.register("target", nation.where("_id < 15"))
    db.catalog.register("source", nation.where("_id >= 10").withColumn("v", F.col("_id") * 2))
    db.aggregate("source", [{"$merge": {"into": "target", "on": "_id", "whenMatched": "merge", "whenNotMatched": "insert"}}])
    return db.find("target")


QUERIES["merge_upsert"] = merge_upsert
ORACLES["merge_upsert"] = 'SELECT n_nationkey AS "_id", n_name AS name, CASE WHEN n_nationkey >= 10 THEN n_nationkey * 2 ELSE 0 END AS v FROM nation'


def update_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir)
    db.catalog.register("t", db.collection("customer").select(F.col("c_custkey").alias("_id"), "c_acctbal", "c_mktsegment"))
    db.catalog.update("t", {"c_acctbal": {"$lt": 0}}, {"$set": {"c_mktsegment": "DEBT"}, "$mul": {"c_acctbal": -1.0}, "$max": {"c_acctbal": 100.0}}, multi=True)
    db.catalog.delete("t", {"c_mktsegment": "MACHINERY"})
    return db.find("t")


QUERIES["update_delete"] = update_delete
ORACLES["update_delete"] = "SELECT c_custkey AS \"_id\", CASE WHEN c_acctbal < 0 THEN greatest(-c_acctbal, 100.0) ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_acctbal < 0 OR c_mktsegment <> 'MACHINERY'"
QUERIES["distinct_values"] = lambda spark, sf_dir: database(spark, sf_dir).distinct("part", "p_brand", {"p_size": {"$gte": 10}})
ORACLES["distinct_values"] = "SELECT DISTINCT p_brand AS value FROM part WHERE p_size >= 10"


def variant_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dynamic mode: ``events.props`` as VARIANT, one field read with its type."""
    from ..sources.formats import variant_field

    e = database(spark, sf_dir).collection("events")
    return e.select("event_id", F.try_parse_json("props").alias("doc")).select("event_id", F.schema_of_variant("doc").startswith("OBJECT").alias("is_object"), variant_field(F.col("doc"), "k", "long").alias("k"))


QUERIES["variant_props"] = variant_props
ORACLES["variant_props"] = "SELECT event_id, json_type(props) = 'OBJECT' AS is_object, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["group_pricing_summary"](spark, sf_dir)


from . import families  # noqa: E402,F401  registers further queries
