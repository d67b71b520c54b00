"""Registered queries by family of operators, each with the SQL that gives the same rows.

Arrays come out as text, their elements joined by bars, so that both sides
compare element for element.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .queries import ORACLES, QUERIES, R, database, day, pipeline


def joined(array) -> dict:
    """Elements as text, each after a bar."""
    return {"$reduce": {"input": array, "initialValue": "", "in": {"$concat": ["$$value", "|", {"$toString": "$$this"}]}}}


def bars(array: str) -> str:
    """The same in SQL."""
    return f"coalesce('|' || nullif(array_to_string({array}, '|'), ''), '')"


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


def off_ties(e) -> dict:
    """Rounded to five places after a shift that leaves no exact halves, which both sides round their own way."""
    return R({"$add": [e, 0.00000037]}, 5)


def whole(e) -> dict:
    return {"$toInt": e}


def answers(name: str, table, key: str, cases: list[tuple[dict, str]], source: str) -> None:
    """One row (query number, key) for each row that each of several queries finds."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = database(spark, sf_dir)
        df = table(db)
        db.catalog.register("t", df)
        return reduce(DataFrame.unionByName, [db.find("t", q, {key: 1}).select(F.lit(i).alias("i"), key) for i, (q, _) in enumerate(cases)])

    QUERIES[name] = run
    ORACLES[name] = f"WITH t AS ({source}) " + " UNION ALL ".join(f"SELECT {i} AS i, {key} FROM t WHERE {w}" for i, (_, w) in enumerate(cases))


# expressions

X = {"$divide": ["$p_size", 60]}
TRIG = {
    "sin": (X, "sin(x)"), "cos": (X, "cos(x)"), "tan": (X, "tan(x)"), "asin": (X, "asin(x)"), "acos": (X, "acos(x)"), "atan": (X, "atan(x)"), "sinh": (X, "sinh(x)"), "cosh": (X, "cosh(x)"), "tanh": (X, "tanh(x)"), "asinh": (X, "asinh(x)"), "acosh": ({"$add": [X, 1]}, "acosh(x + 1)"), "atanh": (X, "atanh(x)"),
    "atan2": ([X, 2], "atan2(x, 2)"), "degreesToRadians": ("$p_size", "radians(p_size)"), "radiansToDegrees": (X, "degrees(x)"),
}
pipeline("expr_trigonometry", "part", [{"$project": {"p_partkey": 1} | {k: R({"$" + k: a}, 6) for k, (a, _) in TRIG.items()}}], "SELECT p_partkey, " + ", ".join(f"round({s}, 6) AS {k}" for k, (_, s) in TRIG.items()) + " FROM (SELECT *, p_size / 60.0 AS x FROM part)")

NUMBERS = ["$p_size", 10, 40]
pipeline(
    "expr_numbers",
    "part",
    [
        {
            "$project": {
                "p_partkey": 1, "e": R({"$exp": X}, 6), "lg": R({"$log": ["$p_retailprice", 7]}, 6), "l10": R({"$log10": "$p_retailprice"}, 6), "lo": {"$min": NUMBERS}, "hi": {"$max": NUMBERS}, "s": {"$sum": NUMBERS}, "m": R({"$avg": NUMBERS}, 6), "sp": R({"$stdDevPop": NUMBERS}, 6), "ss": R({"$stdDevSamp": NUMBERS}, 6),
                "md": {"$median": {"input": NUMBERS, "method": "approximate"}}, "pc": {"$arrayElemAt": [{"$percentile": {"input": NUMBERS, "p": [0.1, 0.9], "method": "approximate"}}, 1]}, "ba": {"$bitAnd": ["$p_size", 21]}, "bo": {"$bitOr": ["$p_size", 8]}, "bn": {"$bitNot": "$p_size"}, "r": {"$round": ["$p_size", -1]}, "t": R({"$trunc": ["$p_retailprice", 1]}, 1), "ad": {"$add": ["$p_size", 1, 2]}, "su": {"$subtract": ["$p_size", "$p_partkey"]}, "mu": {"$multiply": ["$p_size", 3]},
            }
        }
    ],
    "SELECT p_partkey, round(exp(p_size / 60.0), 6) AS e, round(ln(p_retailprice) / ln(7), 6) AS lg, round(log10(p_retailprice), 6) AS l10, least(p_size, 10, 40) AS lo, greatest(p_size, 10, 40) AS hi, p_size + 50 AS s, round((p_size + 50) / 3.0, 6) AS m, round(list_aggregate([p_size, 10, 40], 'stddev_pop'), 6) AS sp, round(list_aggregate([p_size, 10, 40], 'stddev_samp'), 6) AS ss, list_sort([p_size, 10, 40])[2] AS md, greatest(p_size, 10, 40) AS pc, p_size & 21 AS ba, p_size | 8 AS bo, -1 - p_size AS bn, CASE p_size % 10 WHEN 5 THEN (p_size - 5) // 10 % 2 * 10 + p_size - 5 ELSE CAST(round(p_size / 10.0) * 10 AS INT) END AS r, round(trunc(p_retailprice * 10) / 10, 1) AS t, p_size + 3 AS ad, p_size - p_partkey AS su, p_size * 3 AS mu FROM part",
)

A, B = [whole({"$mod": ["$p_size", n]}) for n in (5, 3, 7)], [1, 2, whole({"$mod": ["$p_size", 4]})]
pipeline(
    "expr_sets",
    "part",
    [{"$project": {"p_partkey": 1, "u": joined({"$setUnion": [A, B]}), "i": joined({"$setIntersection": [A, B]}), "d": joined({"$sortArray": {"input": {"$setDifference": [A, B]}, "sortBy": 1}}), "eq": {"$setEquals": [A, B]}, "sub": {"$setIsSubset": [A, [0, 1, 2, 3]]}, "some": {"$anyElementTrue": [A]}, "all": {"$allElementsTrue": [A]}}}],
    f"SELECT p_partkey, {bars('list_sort(list_distinct(list_concat(a, b)))')} AS u, {bars('list_sort(list_distinct(list_filter(a, lambda x: list_contains(b, x))))')} AS i, {bars('list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x))))')} AS d, list_sort(list_distinct(a)) = list_sort(list_distinct(b)) AS eq, len(list_filter(a, lambda x: x > 3)) = 0 AS sub, list_max(a) > 0 AS some, list_min(a) > 0 AS all FROM (SELECT p_partkey, [p_size % 5, p_size % 3, p_size % 7] AS a, [1, 2, p_size % 4] AS b FROM part)",
)

PARTS = {"$dateToParts": {"date": "$ts"}}
pipeline(
    "expr_date_parts",
    "events",
    [
        {
            "$project": {
                "event_id": 1, "h": {"$hour": "$ts"}, "mi": {"$minute": "$ts"}, "s": {"$second": "$ts"}, "ms": {"$millisecond": "$ts"}, "doy": {"$dayOfYear": "$ts"}, "idow": {"$isoDayOfWeek": "$ts"}, "iy": {"$isoWeekYear": "$ts"}, "w": {"$week": "$ts"}, "hz": {"$hour": {"date": "$ts", "timezone": "+05:30"}}, "less": {"$dateSubtract": {"startDate": "$ts", "unit": "hour", "amount": 5}},
                "made": {"$dateFromParts": {"year": {"$year": "$ts"}, "month": 3, "day": {"$dayOfMonth": "$ts"}, "hour": 7}}, "iso": {"$dateFromParts": {"isoWeekYear": {"$isoWeekYear": "$ts"}, "isoWeek": {"$isoWeek": "$ts"}, "isoDayOfWeek": {"$isoDayOfWeek": "$ts"}}}, "read": {"$dateFromString": {"dateString": {"$dateToString": {"date": "$ts", "format": "%Y-%m-%d"}}, "format": "%Y-%m-%d"}}, "pd": {"$getField": {"field": "day", "input": PARTS}}, "ph": {"$getField": {"field": "hour", "input": PARTS}}, "bin": {"$dateTrunc": {"date": "$ts", "unit": "hour", "binSize": 6}}, "wk": {"$dateTrunc": {"date": "$ts", "unit": "week", "startOfWeek": "monday"}}, "dh": {"$dateDiff": {"startDate": "$ts", "endDate": {"$literal": day(2030, 1, 1)}, "unit": "hour"}}, "dq": {"$dateDiff": {"startDate": "$ts", "endDate": {"$literal": day(2030, 1, 1)}, "unit": "quarter"}}, "txt": {"$dateToString": {"date": "$ts", "format": "%j %H:%M %u %G-%V"}},
            }
        }
    ],
    "SELECT event_id, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s, millisecond(ts) % 1000 AS ms, dayofyear(ts) AS doy, isodow(ts) AS idow, isoyear(ts) AS iy, CAST(strftime(ts, '%U') AS INT) AS w, hour(ts + INTERVAL 330 MINUTE) AS hz, ts - INTERVAL 5 HOUR AS less, make_timestamp(year(ts), 3, day(ts), 7, 0, 0) AS made, CAST(date_trunc('day', ts) AS TIMESTAMP) AS iso, CAST(date_trunc('day', ts) AS TIMESTAMP) AS read, day(ts) AS pd, hour(ts) AS ph, CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL (hour(ts) // 6 * 6) HOUR AS bin, CAST(date_trunc('week', ts) AS TIMESTAMP) AS wk, date_diff('hour', ts, TIMESTAMP '2030-01-01') AS dh, date_diff('quarter', ts, TIMESTAMP '2030-01-01') AS dq, strftime(ts, '%j %H:%M %u %G-%V') AS txt FROM events",
)

FOUND = {"$regexFind": {"input": "$c_name", "regex": "(0+)([1-9][0-9]*)"}}
pipeline(
    "expr_regex_trim",
    "customer",
    [
        {"$addFields": {"f": FOUND, "all": {"$regexFindAll": {"input": "$c_name", "regex": "[1-9]"}}}},
        {
            "$project": {
                "c_custkey": 1, "match": "$f.match", "at": "$f.idx", "zeros": {"$first": "$f.captures"}, "n": {"$size": "$all"}, "places": joined("$all.idx"), "t": {"$trim": {"input": {"$concat": ["  ", "$c_mktsegment", " \t"]}}}, "rt": {"$rtrim": {"input": "$c_mktsegment", "chars": "EY"}}, "up": {"$toUpper": "$c_name"}, "sb": {"$substrBytes": ["$c_name", 2, 5]}, "ss": {"$substr": ["$c_name", 9, -1]}, "nb": {"$strLenBytes": "$c_name"},
            }
        },
    ],
    r"SELECT c_custkey, nullif(regexp_extract(c_name, '(0+)([1-9][0-9]*)', 0), '') AS match, CASE WHEN regexp_matches(c_name, '(0+)([1-9][0-9]*)') THEN strpos(c_name, regexp_extract(c_name, '(0+)([1-9][0-9]*)', 0)) - 1 END AS at, nullif(regexp_extract(c_name, '(0+)([1-9][0-9]*)', 1), '') AS zeros, len(regexp_extract_all(c_name, '[1-9]')) AS n, "
    + bars("list_filter(list_transform(range(length(c_name)), lambda i: CASE WHEN regexp_matches(substr(c_name, i + 1, 1), '[1-9]') THEN i END), lambda i: i IS NOT NULL)")
    + r" AS places, c_mktsegment AS t, rtrim(c_mktsegment, 'EY') AS rt, upper(c_name) AS up, substr(c_name, 3, 5) AS sb, substr(c_name, 10) AS ss, strlen(c_name) AS nb FROM customer",
)
pipeline(
    "expr_bytes",
    "documents",
    [{"$project": {"doc_id": 1, "b": {"$strLenBytes": "$text"}, "c": {"$strLenCP": "$text"}, "ab": {"$indexOfBytes": ["$text", "é"]}, "ac": {"$indexOfCP": ["$text", "é"]}, "bin": {"$binarySize": "$text"}}}],
    "SELECT doc_id, strlen(text) AS b, length(text) AS c, CASE WHEN strpos(text, 'é') = 0 THEN -1 ELSE strlen(left(text, strpos(text, 'é') - 1)) END AS ab, strpos(text, 'é') - 1 AS ac, strlen(text) AS bin FROM documents",
)

BY_CUSTOMER = [{"$sort": {"o_orderkey": 1}}, {"$group": {"_id": "$o_custkey", "k": {"$push": "$o_orderkey"}}}]
pipeline(
    "expr_arrays",
    "orders",
    [
        *BY_CUSTOMER,
        {
            "$project": {
                "f": joined({"$firstN": {"input": "$k", "n": 2}}), "l": joined({"$lastN": {"input": "$k", "n": 2}}), "hi": joined({"$maxN": {"input": "$k", "n": 2}}), "lo": joined({"$minN": {"input": "$k", "n": 3}}), "is": {"$isArray": "$k"}, "no": {"$isArray": "$_id"}, "cat": joined({"$concatArrays": ["$k", [0], "$k"]}), "r": joined({"$range": [0, {"$size": "$k"}, 2]}), "z": joined({"$map": {"input": {"$zip": {"inputs": ["$k", {"$reverseArray": "$k"}]}}, "in": {"$sum": "$$this"}}}), "o": {"$getField": {"field": "a", "input": {"$arrayToObject": [[{"k": "a", "v": {"$first": "$k"}}, {"k": "b", "v": 1}]]}}},
                "e": joined({"$map": {"input": {"$objectToArray": {"$literal": {"p": 1, "q": 2}}}, "in": {"$concat": ["$$this.k", {"$toString": "$$this.v"}]}}}), "mk": joined({"$makeArray": ["$_id", 5]}), "s": joined({"$slice": ["$k", -2]}), "so": joined({"$sortArray": {"input": "$k", "sortBy": -1}}), "at": {"$indexOfArray": ["$k", {"$last": "$k"}]},
            }
        },
    ],
    f"""WITH g AS (SELECT o_custkey AS "_id", list(o_orderkey ORDER BY o_orderkey) AS k FROM orders GROUP BY 1)
SELECT "_id", {bars('k[1:2]')} AS f, {bars('k[greatest(len(k) - 1, 1):]')} AS l, {bars('list_reverse(k)[1:2]')} AS hi, {bars('k[1:3]')} AS lo, true AS "is", false AS "no", {bars('list_concat(list_concat(k, [0]), k)')} AS cat, {bars('range(0, len(k), 2)')} AS r, {bars('list_transform(k, lambda x, i: x + k[len(k) + 1 - i])')} AS z, k[1] AS o, '|p1|q2' AS e, '|' || "_id" || '|5' AS mk, {bars('k[greatest(len(k) - 1, 1):]')} AS s, {bars('list_reverse(k)')} AS so, len(k) - 1 AS at FROM g""",
)

pipeline(
    "expr_conversions",
    "lineitem",
    [
        {
            "$project": {
                "l_orderkey": 1, "l_linenumber": 1, "c": {"$convert": {"input": "$l_returnflag", "to": "int", "onError": -1}}, "n": {"$convert": {"input": None, "to": "int", "onNull": 4}}, "isn": {"$isNumber": "$l_tax"}, "iss": {"$isNumber": "$l_returnflag"}, "b": {"$toBool": "$l_discount"}, "d": {"$toDate": {"$multiply": [{"$toLong": "$l_orderkey"}, 1000]}}, "f": {"$toDouble": {"$toString": "$l_linenumber"}}, "l": {"$toLong": "$l_quantity"}, "dec": {"$toDouble": {"$toDecimal": {"$toString": "$l_linenumber"}}},
                "oid": {"$toString": {"$toObjectId": {"$literal": "0123456789abcdef01234567"}}}, "uuid": {"$binarySize": {"$toUUID": {"$literal": "01234567-89ab-cdef-0123-456789abcdef"}}}, "ms": {"$toLong": "$l_shipdate"}, "ty": {"$concat": [{"$type": "$l_orderkey"}, {"$type": "$l_shipdate"}, {"$type": "$nowhere"}, {"$type": ["$l_tax"]}]}, "y": {"$toString": {"$eq": ["$l_returnflag", "R"]}},
            }
        }
    ],
    "SELECT l_orderkey, l_linenumber, -1 AS c, 4 AS n, true AS isn, false AS iss, l_discount <> 0 AS b, make_timestamp(l_orderkey * 1000000) AS d, CAST(l_linenumber AS DOUBLE) AS f, CAST(trunc(l_quantity) AS BIGINT) AS l, CAST(l_linenumber AS DOUBLE) AS dec, '0123456789abcdef01234567' AS oid, 16 AS uuid, epoch_ms(l_shipdate) AS ms, 'longdatemissingdouble' AS ty, CAST(l_returnflag = 'R' AS VARCHAR) AS y FROM lineitem",
)

OBJ = {"a": "$s_suppkey", "b": "$s_name"}
pipeline(
    "expr_variables_fields",
    "supplier",
    [
        {"$addFields": {"o": OBJ}},
        {
            "$project": {
                "s_suppkey": 1, "let": {"$let": {"vars": {"y": {"$add": ["$s_suppkey", 1]}}, "in": {"$multiply": ["$$y", 2]}}}, "set": {"$getField": {"field": "c", "input": {"$setField": {"field": "c", "input": "$o", "value": {"$add": ["$o.a", 5]}}}}}, "un": {"$size": {"$objectToArray": {"$unsetField": {"field": "a", "input": "$o"}}}}, "lit": {"$literal": "$x"}, "con": {"$const": 3}, "or": {"$or": [{"$gt": ["$s_acctbal", 5000]}, {"$eq": ["$s_nationkey", 1]}]}, "not": {"$not": [{"$lte": ["$s_acctbal", 0]}]}, "ne": {"$ne": ["$s_nationkey", 3]}, "ge": {"$gte": ["$s_acctbal", 0]}, "root": "$$ROOT.o.a", "cur": "$$CURRENT.s_nationkey", "gf": {"$getField": "s_nationkey"}, "ts": {"$add": [{"$tsSecond": {"t": "$s_suppkey", "i": 2}}, {"$tsIncrement": {"t": 1, "i": "$s_nationkey"}}]},
            }
        },
    ],
    "SELECT s_suppkey, (s_suppkey + 1) * 2 AS let, s_suppkey + 5 AS set, 1 AS un, '$x' AS lit, 3 AS con, s_acctbal > 5000 OR s_nationkey = 1 AS \"or\", NOT (s_acctbal <= 0) AS \"not\", s_nationkey <> 3 AS ne, s_acctbal >= 0 AS ge, s_suppkey AS root, s_nationkey AS cur, s_nationkey AS gf, s_suppkey + s_nationkey AS ts FROM supplier",
)

# groups and windows

N_FORMS = {
    "fn": {"$firstN": {"input": "$o_orderkey", "n": 3}}, "ln": {"$lastN": {"input": "$o_orderkey", "n": 3}}, "tn": {"$topN": {"output": "$o_orderkey", "sortBy": {"o_totalprice": -1, "o_orderkey": 1}, "n": 2}}, "bn": {"$bottomN": {"output": "$o_orderkey", "sortBy": {"o_totalprice": -1, "o_orderkey": 1}, "n": 2}}, "xn": {"$maxN": {"input": "$o_orderkey", "n": 3}}, "mn": {"$minN": {"input": "$o_orderkey", "n": 3}},
}
N_SQL = ", ".join(
    f"{bars(s)} AS {n}"
    for n, s in {
        "fn": "list(o_orderkey ORDER BY o_orderdate, o_orderkey)[1:3]", "ln": "list_reverse(list(o_orderkey ORDER BY o_orderdate DESC, o_orderkey DESC)[1:3])", "tn": "list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey)[1:2]", "bn": "list_reverse(list(o_orderkey ORDER BY o_totalprice, o_orderkey DESC)[1:2])", "xn": "list(o_orderkey ORDER BY o_orderkey DESC)[1:3]", "mn": "list(o_orderkey ORDER BY o_orderkey)[1:3]",
    }.items()
)
pipeline(
    "group_n_values",
    "orders",
    [{"$sort": {"o_orderdate": 1, "o_orderkey": 1}}, {"$group": {"_id": "$o_orderpriority", "n": {"$sum": 1}, "set": {"$addToSet": "$o_orderstatus"}, **N_FORMS}}, {"$project": {"n": 1, "set": joined("$set")} | {k: joined("$" + k) for k in N_FORMS}}],
    f'SELECT o_orderpriority AS "_id", count(*) AS n, {bars("list_sort(list(DISTINCT o_orderstatus))")} AS set, {N_SQL} FROM orders GROUP BY 1',
)
pipeline("group_n_values_alone", "orders", [{"$sort": {"o_orderdate": 1, "o_orderkey": 1}}, {"$group": {"_id": None, **N_FORMS}}, {"$project": {"_id": 0} | {k: joined("$" + k) for k in N_FORMS}}], f"SELECT {N_SQL} FROM orders")
pipeline(
    "group_arrays",
    "orders",
    [*BY_CUSTOMER, {"$addFields": {"r": whole({"$mod": ["$_id", 7]}), "k": {"$slice": ["$k", 2]}}}, {"$sort": {"_id": 1}}, {"$group": {"_id": "$r", "all": {"$concatArrays": "$k"}, "lists": {"$push": {"$size": "$k"}}}}, {"$project": {"all": joined("$all"), "lists": joined("$lists")}}],
    f'WITH g AS (SELECT o_custkey AS c, list(o_orderkey ORDER BY o_orderkey)[1:2] AS k FROM orders GROUP BY 1) SELECT c % 7 AS "_id", {bars("flatten(list(k ORDER BY c))")} AS all, {bars("list(len(k) ORDER BY c)")} AS lists FROM g GROUP BY 1',
)
FRAME = {"window": {"documents": [-2, 0]}}
GATHER = {
    "push": {"$push": "$event_id"}, "sets": {"$addToSet": "$event_id"}, "cat": {"$concatArrays": ["$event_id", "$user_id"]}, "fn": {"$firstN": {"input": "$event_id", "n": 2}}, "ln": {"$lastN": {"input": "$event_id", "n": 2}}, "tn": {"$topN": {"output": "$event_id", "sortBy": {"event_id": -1}, "n": 2}}, "bn": {"$bottomN": {"output": "$event_id", "sortBy": {"event_id": -1}, "n": 2}}, "xn": {"$maxN": {"input": "$event_id", "n": 2}}, "mn": {"$minN": {"input": "$event_id", "n": 2}},
}
ONE = {"first": {"$first": "$event_id"}, "last": {"$last": "$event_id"}, "top": {"$top": {"output": "$event_id", "sortBy": {"event_id": -1}}}, "bottom": {"$bottom": {"output": "$event_id", "sortBy": {"event_id": -1}}}, "low": {"$min": "$event_id"}}
pipeline(
    "window_gathered",
    "events",
    [{"$setWindowFields": {"partitionBy": "$user_id", "sortBy": {"event_id": 1}, "output": {k: v | FRAME for k, v in (GATHER | ONE).items()}}}, {"$project": {"event_id": 1} | {k: joined("$" + k) for k in GATHER} | {k: 1 for k in ONE}}],
    "SELECT event_id, "
    + ", ".join(f"{bars(s)} AS {k}" for k, s in {"push": "l", "sets": "l", "cat": "flatten(list_transform(l, lambda x: [x, user_id]))", "fn": "l[1:2]", "ln": "l[greatest(len(l) - 1, 1):]", "tn": "list_reverse(l)[1:2]", "bn": "list_reverse(l[1:2])", "xn": "list_reverse(l)[1:2]", "mn": "l[1:2]"}.items())
    + ', l[1] AS "first", l[len(l)] AS "last", l[len(l)] AS top, l[1] AS bottom, l[1] AS low FROM (SELECT event_id, user_id, list(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS l FROM events)',
)
pipeline(
    "window_statistics",
    "events",
    [
        {"$setWindowFields": {"partitionBy": "$user_id", "sortBy": {"event_id": 1}, "output": {"ema": {"$expMovingAvg": {"input": "$value", "alpha": 0.5}}, "emn": {"$expMovingAvg": {"input": "$value", "N": 4}}, "sp": {"$stdDevPop": "$value"}, "ss": {"$stdDevSamp": "$value"}, "cp": {"$covariancePop": ["$value", "$event_id"]}, "cs": {"$covarianceSamp": ["$value", "$event_id"]}, "md": {"$median": {"input": "$value", "method": "approximate"}}, "pc": {"$percentile": {"input": "$value", "p": [0.25], "method": "approximate"}}}}},
        {"$project": {"event_id": 1, "ema": off_ties("$ema"), "emn": off_ties("$emn"), "sp": R("$sp", 6), "ss": R("$ss", 6), "cp": R("$cp", 3), "cs": R("$cs", 3), "md": 1, "pc": {"$first": "$pc"}}},
    ],
    "SELECT event_id, round(list_reduce(l, lambda a, b: b * 0.5 + a * 0.5) + 0.00000037, 5) AS ema, round(list_reduce(l, lambda a, b: b * 0.4 + a * 0.6) + 0.00000037, 5) AS emn, round(stddev_pop(value) OVER p, 6) AS sp, round(stddev_samp(value) OVER p, 6) AS ss, round(covar_pop(value, event_id) OVER p, 3) AS cp, round(covar_samp(value, event_id) OVER p, 3) AS cs, quantile_disc(value, 0.5) OVER p AS md, quantile_disc(value, 0.25) OVER p AS pc FROM (SELECT *, list(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS l FROM events) WINDOW p AS (PARTITION BY user_id)",
)
pipeline(
    "window_calculus_by_time",
    "events",
    [
        {"$setWindowFields": {"partitionBy": "$user_id", "sortBy": {"ts": 1}, "output": {"slope": {"$derivative": {"input": "$value", "unit": "hour"}, "window": {"documents": [-1, 0]}}, "area": {"$integral": {"input": "$value", "unit": "hour"}, "window": {"documents": [-1, 0]}}}}},
        {"$project": {"event_id": 1, "slope": off_ties("$slope"), "area": off_ties("$area")}},
    ],
    "SELECT event_id, round((value - lag(value) OVER w) / (nullif(epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER w, 0) / 3600000) + 0.00000037, 5) AS slope, round(coalesce((epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER w) / 3600000 * (value + lag(value) OVER w) / 2, 0) + 0.00000037, 5) AS area FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)",
)
pipeline(
    "window_fills",
    "events",
    [
        {"$project": {"event_id": 1, "user_id": 1, "v": {"$cond": [{"$eq": [{"$mod": ["$event_id", 4]}, 1]}, "$value", None]}}},
        {"$setWindowFields": {"partitionBy": "$user_id", "sortBy": {"event_id": 1}, "output": {"held": {"$locf": "$v"}, "line": {"$linearFill": "$v"}}}},
        {"$fill": {"partitionByFields": ["user_id"], "sortBy": {"event_id": 1}, "output": {"v": {"method": "locf"}}}},
        {"$project": {"event_id": 1, "held": 1, "line": off_ties("$line"), "v": 1}},
    ],
    """
WITH a AS (SELECT event_id, user_id, CASE WHEN event_id % 4 = 1 THEN value END AS v FROM events),
b AS (SELECT *, last_value(v IGNORE NULLS) OVER p AS y0, last_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER p AS x0,
  first_value(v IGNORE NULLS) OVER f AS y1, first_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER f AS x1 FROM a
  WINDOW p AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, y0 AS held, round(coalesce(v, CASE WHEN x0 IS NOT NULL AND x1 IS NOT NULL THEN y0 + (y1 - y0) * (event_id - x0) / (x1 - x0) END) + 0.00000037, 5) AS line, y0 AS v FROM b
""",
)

# filters

answers(
    "find_operators",
    lambda db: db.collection("orders"),
    "o_orderkey",
    [
        ({"o_orderstatus": {"$ne": "F"}}, "o_orderstatus <> 'F'"), ({"o_orderpriority": {"$nin": ["1-URGENT", "5-LOW"]}}, "o_orderpriority NOT IN ('1-URGENT', '5-LOW')"), ({"o_totalprice": {"$ngt": 100000}}, "NOT o_totalprice > 100000"), ({"o_totalprice": {"$ngte": 100000}}, "NOT o_totalprice >= 100000"), ({"o_totalprice": {"$nlt": 100000}}, "NOT o_totalprice < 100000"), ({"o_totalprice": {"$nlte": 100000}}, "NOT o_totalprice <= 100000"),
        ({"$and": [{"o_orderstatus": {"$eq": "O"}}, {"o_totalprice": {"$lte": 5000}}]}, "o_orderstatus = 'O' AND o_totalprice <= 5000"), ({"$alwaysTrue": 1, "o_orderkey": {"$mod": [10, 3]}}, "o_orderkey % 10 = 3"), ({"$alwaysFalse": 1}, "false"), ({"o_orderstatus": "P", "$comment": "by state"}, "o_orderstatus = 'P'"), ({"o_orderpriority": {"$regex": "urgent$", "$options": "i"}}, "o_orderpriority ILIKE '%urgent'"), ({"o_orderdate": {"$not": {"$gte": day(1996, 1, 1)}}}, "o_orderdate < TIMESTAMP '1996-01-01'"), ({"$nor": [{"o_orderstatus": "F"}, {"o_totalprice": {"$gt": 20000}}]}, "NOT (o_orderstatus = 'F' OR o_totalprice > 20000)"), ({"o_orderkey": {"$bitsAnySet": [0, 4]}}, "o_orderkey & 17 <> 0"),
    ],
    "SELECT * FROM orders",
)

SQUARE = {"type": "Polygon", "coordinates": [[[0, 0], [40, 0], [40, 30], [0, 30], [0, 0]]]}
SPHERE = "2 * asin(least(sqrt(pow(sin((radians(y) - radians(20)) / 2), 2) + cos(radians(y)) * cos(radians(20)) * pow(sin((radians(x) - radians(10)) / 2), 2)), 1))"
answers(
    "geo_operators",
    lambda db: db.collection("customer").select("c_custkey", F.array((F.col("c_custkey") % 360 - 180).cast("double"), (F.col("c_custkey") % 90).cast("double")).alias("at")),
    "c_custkey",
    [
        ({"at": {"$geoWithin": {"$geometry": SQUARE}}}, "x BETWEEN 0 AND 40 AND y BETWEEN 0 AND 30"), ({"at": {"$geoIntersects": {"$geometry": SQUARE}}}, "x BETWEEN 0 AND 40 AND y BETWEEN 0 AND 30"), ({"at": {"$geoIntersects": {"$geometry": {"type": "Point", "coordinates": [10, 10]}}}}, "x = 10 AND y = 10"), ({"at": {"$geoIntersects": {"$geometry": {"type": "LineString", "coordinates": [[0, 0], [50, 50]]}}}}, "x = y AND x BETWEEN 0 AND 50"), ({"at": {"$within": {"$center": [[10, 20], 15]}}}, "(x - 10) ** 2 + (y - 20) ** 2 <= 225"), ({"at": {"$geoWithin": {"$centerSphere": [[10, 20], 0.3]}}}, f"{SPHERE} <= 0.3"),
        ({"at": {"$geoWithin": {"$polygon": [[0, 0], [20, 0], [20, 10], [0, 10]]}}}, "x BETWEEN 0 AND 20 AND y BETWEEN 0 AND 10"), ({"at": {"$near": [10, 20], "$maxDistance": 12}}, "(x - 10) ** 2 + (y - 20) ** 2 <= 144"), ({"at": {"$nearSphere": {"$geometry": {"type": "Point", "coordinates": [10, 20]}, "$maxDistance": 2000000, "$minDistance": 100000}}}, f"{SPHERE} * 6378100 BETWEEN 100000 AND 2000000"), ({"at": {"$geoWithin": {"$geometry": {"type": "MultiPolygon", "coordinates": [SQUARE["coordinates"], [[[50, 50], [60, 50], [60, 60], [50, 60], [50, 50]]]]}}}}, "(x BETWEEN 0 AND 40 AND y BETWEEN 0 AND 30) OR (x BETWEEN 50 AND 60 AND y BETWEEN 50 AND 60)"),
    ],
    "SELECT c_custkey, CAST(c_custkey % 360 - 180 AS DOUBLE) AS x, CAST(c_custkey % 90 AS DOUBLE) AS y FROM customer",
)
GEO_STAGES = [{"$geoNear": {"near": {"type": "Point", "coordinates": [10, 20]}, "key": "at", "distanceField": "d", "distanceMultiplier": 0.001, "maxDistance": 3000000, "query": {"c_custkey": {"$gt": 10}}, "includeLocs": "where"}}, {"$project": {"c_custkey": 1, "d": R("$d", 3), "x": {"$first": "$where"}}}]


@query("geo_near_sphere", f"SELECT c_custkey, round({SPHERE} * 6378.1, 3) AS d, x FROM (SELECT c_custkey, CAST(c_custkey % 360 - 180 AS DOUBLE) AS x, CAST(c_custkey % 90 AS DOUBLE) AS y FROM customer) WHERE c_custkey > 10 AND {SPHERE} * 6378100 <= 3000000")
def geo_near_sphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir)
    db.catalog.register("places", db.collection("customer").select("c_custkey", F.array((F.col("c_custkey") % 360 - 180).cast("double"), (F.col("c_custkey") % 90).cast("double")).alias("at")))
    return db.aggregate("places", GEO_STAGES)


def _by_customer(db) -> DataFrame:
    return db.aggregate("orders", [*BY_CUSTOMER, {"$project": {"c": "$_id", "k": 1, "n": {"$size": "$k"}, "s": {"$concat": ["c", {"$toString": "$_id"}]}, "half": {"$divide": ["$_id", 2]}}}])


SCHEMA_ROWS = "SELECT o_custkey AS c, list(o_orderkey ORDER BY o_orderkey) AS k, count(*) AS n, 'c' || o_custkey AS s, o_custkey / 2.0 AS half FROM orders GROUP BY 1"
answers(
    "json_schema_keywords",
    _by_customer,
    "c",
    [
        ({"$jsonSchema": {"properties": {name: rule}}}, where)
        for name, rule, where in (
            ("c", {"type": "number"}, "true"), ("s", {"type": "number"}, "false"), ("s", {"enum": ["c1", "c4", "x"]}, "s IN ('c1', 'c4', 'x')"), ("c", {"multipleOf": 3}, "c % 3 = 0"), ("n", {"minimum": 12}, "n >= 12"), ("n", {"minimum": 12, "exclusiveMinimum": True}, "n > 12"), ("n", {"maximum": 8, "exclusiveMaximum": True}, "n < 8"), ("s", {"minLength": 4}, "length(s) >= 4"), ("s", {"maxLength": 3}, "length(s) <= 3"), ("s", {"pattern": "7$"}, "s LIKE '%7'"),
            ("k", {"maxItems": 9}, "n <= 9"), ("k", {"minItems": 11}, "n >= 11"), ("k", {"uniqueItems": True}, "true"), ("k", {"items": {"minimum": 100}}, "k[1] >= 100"), ("n", {"oneOf": [{"minimum": 10}, {"maximum": 12}]}, "(n >= 10) <> (n <= 12)"), ("n", {"anyOf": [{"minimum": 14}, {"maximum": 5}]}, "n >= 14 OR n <= 5"), ("n", {"allOf": [{"minimum": 9}, {"maximum": 10}]}, "n BETWEEN 9 AND 10"), ("n", {"not": {"minimum": 9}}, "n < 9"), ("half", {"bsonType": "double", "title": "half", "description": "of the key"}, "true"),
        )
    ]
    + [({"$jsonSchema": {"required": ["c", "nowhere"]}}, "false"), ({"$jsonSchema": {"required": ["c", "k"]}}, "true")],
    SCHEMA_ROWS,
)


@query("projection_arrays", f"""WITH g AS ({SCHEMA_ROWS}) SELECT c, {bars('k[1:2]')} AS head, {bars('k[greatest(len(k) - 1, 1):]')} AS tail, {bars('k[2:3]')} AS mid, {bars('list_filter(k, lambda x: x > 300)[1:1]')} AS pos, {bars('list_filter(k, lambda x: x > 200 AND x % 2 = 0)[1:1]')} AS el FROM g WHERE list_max(k) > 300""")
def projection_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Array projections of find: $slice in its forms, positional, $elemMatch."""
    db = database(spark, sf_dir)
    db.catalog.register("t", _by_customer(db))
    out = None
    for name, projection in {"head": {"c": 1, "k": {"$slice": 2}}, "tail": {"c": 1, "k": {"$slice": -2}}, "mid": {"c": 1, "k": {"$slice": [1, 2]}}, "pos": {"c": 1, "k.$": 1}, "el": {"c": 1, "k": {"$elemMatch": {"$gt": 200, "$mod": [2, 0]}}}}.items():
        one = db.run(db.find("t", {"k": {"$gt": 300}}, projection), [{"$project": {"_id": 0, "c": 1, name: joined({"$ifNull": ["$k", []]})}}])
        out = one if out is None else out.join(one, "c")
    return out


# updates


@query(
    "update_operators",
    f"""WITH g AS ({SCHEMA_ROWS}) SELECT c AS "_id", n + 5 AS i, n * 3 AS m, least(n, 10) AS lo, greatest(n, 10) AS hi, xor(n | 1, 6) AS bits, CASE WHEN c % 2 = 0 THEN NULL ELSE s END AS s, s AS renamed, {bars('list_concat(k[1:1], [7, 8])')} AS pushed, {bars('list_concat(k[1:1], CASE WHEN k[1] = 3 THEN [] ELSE [3] END)')} AS kept, {bars('k[2:]')} AS popped, {bars('list_filter(k, lambda x: x <= 500)')} AS pulled, {bars('list_filter(k, lambda x: x NOT IN (1, 2, 3))')} AS gone, {bars('list_sort(list_concat(k, [0]))[1:3]')} AS best, true AS stamped, 'here' AS deep FROM g
UNION ALL SELECT -1, 1, NULL, NULL, NULL, NULL, 'new', NULL, '', '', '', '', '', '', false, NULL""",
)
def update_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir)
    rows = _by_customer(db).select(F.col("c").cast("long").alias("_id"), *(F.col("n").cast("long").alias(x) for x in ("i", "m", "lo", "hi", "bits")), "s", F.col("s").alias("was"), *(F.slice("k", 1, 1).alias(x) for x in ("pushed", "kept")), *(F.col("k").alias(x) for x in ("popped", "pulled", "gone", "best")), F.lit(None).cast("timestamp").alias("at"), F.struct(F.lit(1).alias("a"), F.lit("x").alias("b")).alias("o"))
    db.catalog.register("t", rows)
    change = {"$inc": {"i": 5}, "$mul": {"m": 3}, "$min": {"lo": 10}, "$max": {"hi": 10}, "$bit": {"bits": {"or": 1}}, "$rename": {"was": "renamed"}, "$push": {"pushed": {"$each": [7, 8]}, "best": {"$each": [0], "$sort": 1, "$slice": 3}}, "$addToSet": {"kept": {"$each": [3]}}, "$pop": {"popped": -1}, "$pull": {"pulled": {"$gt": 500}}, "$pullAll": {"gone": [1, 2, 3]}, "$currentDate": {"at": True}, "$set": {"o.b": "here"}}
    db.catalog.update("t", {}, change, multi=True)
    db.catalog.update("t", {}, {"$bit": {"bits": {"xor": 6}}}, multi=True)
    db.catalog.update("t", {"_id": {"$mod": [2, 0]}}, {"$unset": {"s": ""}}, multi=True)
    db.catalog.update("t", {"_id": -1}, {"$set": {"i": 1}, "$setOnInsert": {"s": "new"}}, upsert=True)
    texts = {x: joined({"$ifNull": ["$" + x, []]}) for x in ("pushed", "kept", "popped", "pulled", "gone", "best")}
    return db.aggregate("t", [{"$project": {x: 1 for x in ("i", "m", "lo", "hi", "bits", "s", "renamed")} | texts | {"stamped": {"$ne": ["$at", None]}, "deep": "$o.b"}}])


@query(
    "update_positions",
    f"""WITH g AS ({SCHEMA_ROWS}), u AS (SELECT c, list_transform(k, lambda x: CASE WHEN x + 1 >= 400 THEN 0 ELSE x + 1 END) AS a, k FROM g)
SELECT c AS "_id", {bars('list_transform(a, lambda x, i: CASE WHEN i = 1 THEN x * 2 ELSE x END)')} AS a, {bars('list_transform(k, lambda x, i: CASE WHEN i = list_position(list_transform(k, lambda y: y > 200), true) THEN -1 ELSE x END)')} AS f, {bars("list_transform(k, lambda x: CASE WHEN x % 2 = 0 THEN x || 'even' ELSE x || 'odd' END)")} AS d FROM u""",
)
def update_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``$[]``, ``$[name]``, ``$`` and positions in paths."""
    db = database(spark, sf_dir)
    rows = _by_customer(db).select(F.col("c").alias("_id"), F.col("k").alias("a"), F.col("k").alias("f"), F.transform("k", lambda x: F.struct(x.alias("v"), F.lit("odd").alias("t"))).alias("d"))
    db.catalog.register("t", rows)
    db.catalog.update("t", {}, {"$inc": {"a.$[]": 1}}, multi=True)
    db.catalog.update("t", {}, {"$set": {"a.$[big]": 0, "d.$[e].t": "even"}}, multi=True, array_filters=[{"big": {"$gte": 400}}, {"e.v": {"$mod": [2, 0]}}])
    db.catalog.update("t", {"f": {"$gt": 200}}, {"$set": {"f.$": -1}}, multi=True)
    db.catalog.update("t", {}, {"$mul": {"a.0": 2}}, multi=True)
    return db.aggregate("t", [{"$project": {"a": joined("$a"), "f": joined("$f"), "d": joined({"$map": {"input": "$d", "in": {"$concat": [{"$toString": "$$this.v"}, "$$this.t"]}}})}}])


@query(
    "writes_and_views",
    "SELECT n_nationkey AS \"_id\", CASE WHEN n_nationkey = 7 THEN 'seven' WHEN n_nationkey >= 100 THEN 'made' ELSE n_name END AS name FROM (SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey + 100, n_name FROM nation) WHERE n_nationkey NOT IN (3, 4) AND n_nationkey <> 101",
)
def writes_and_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """insert, bulk writes, find-and-modify, $out and a view over the result."""
    db = database(spark, sf_dir)
    nation = db.collection("nation").select(F.col("n_nationkey").alias("_id"), F.col("n_name").alias("name"))
    db.catalog.create_collection("t", nation.schema)
    db.catalog.insert("t", nation)
    db.catalog.bulk_write([("insert", "t", nation.select((F.col("_id") + 100).alias("_id"), F.lit("made").alias("name"))), ("delete", "t", {"_id": {"$in": [3, 4]}}), ("nothing", "t"), ("update", "t", {"_id": 7}, {"$set": {"name": "six"}})], ordered=False)
    before = db.catalog.find_and_modify("t", {"_id": 7}, {"$set": {"name": "seven"}})
    assert before["name"] == "six"
    assert db.catalog.find_and_modify("t", {"_id": 101}, remove=True)["name"] == "made"
    db.aggregate("t", [{"$match": {"_id": {"$exists": True}}}, {"$out": "o"}])
    db.catalog.rename("o", "p")
    db.catalog.create_view("v", "p", [{"$match": {"_id": {"$gte": 0}}}])
    return db.find("v")


# stages

pipeline(
    "stages_shape",
    "part",
    [{"$unset": ["p_type", "p_brand"]}, {"$sort": {"p_retailprice": -1, "p_partkey": 1}}, {"$skip": 5}, {"$limit": 40}, {"$replaceWith": {"k": "$p_partkey", "o": {"n": "$p_name", "s": "$p_size"}}}, {"$set": {"o.z": 1}}, {"$unset": "o.s"}, {"$project": {"k": 1, "n": "$o.n", "z": "$o.z", "gone": {"$type": "$o.s"}}}, {"$_internalInhibitOptimization": {}}],
    "SELECT p_partkey AS k, p_name AS n, 1 AS z, 'missing' AS gone FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 40 OFFSET 5",
)
pipeline("stages_documents", None, [{"$documents": [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}, {"a": 2, "b": "z"}]}, {"$group": {"_id": "$a", "n": {"$count": {}}, "last": {"$max": "$b"}}}], 'SELECT * FROM (VALUES (1, 1, \'x\'), (2, 2, \'z\')) AS t("_id", n, "last")')
pipeline("sort_nulls_first", "customer", [{"$project": {"c_custkey": 1, "v": {"$cond": [{"$gt": ["$c_acctbal", 0]}, None, "$c_acctbal"]}}}, {"$sort": {"v": 1, "c_custkey": -1}}, {"$limit": 25}], "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN NULL ELSE c_acctbal END AS v FROM customer ORDER BY v ASC NULLS FIRST, c_custkey DESC LIMIT 25")
pipeline(
    "lookup_arrays",
    "nation",
    [
        {"$project": {"n_nationkey": 1, "wanted": [whole({"$mod": ["$n_nationkey", 5]}), whole({"$mod": ["$n_nationkey", 3]}), 0]}},
        {"$lookup": {"from": "supplier", "localField": "wanted", "foreignField": "s_nationkey", "as": "s"}},
        {"$lookup": {"from": "supplier", "let": {"k": "$n_nationkey"}, "pipeline": [{"$match": {"$expr": {"$eq": ["$s_nationkey", "$$k"]}}}, {"$group": {"_id": None, "most": {"$max": "$s_acctbal"}}}], "as": "m"}},
        {"$project": {"n_nationkey": 1, "n": {"$size": "$s"}, "sum": {"$sum": "$s.s_suppkey"}, "most": {"$first": "$m.most"}}},
    ],
    "SELECT n_nationkey, (SELECT count(*) FROM supplier WHERE s_nationkey IN (n_nationkey % 5, n_nationkey % 3, 0)) AS n, coalesce((SELECT sum(s_suppkey) FROM supplier WHERE s_nationkey IN (n_nationkey % 5, n_nationkey % 3, 0)), 0) AS sum, (SELECT max(s_acctbal) FROM supplier WHERE s_nationkey = n_nationkey) AS most FROM nation",
)


@query(
    "lookup_repeated_rows",
    "WITH f AS (SELECT n_regionkey AS k FROM nation UNION ALL SELECT 2), g AS (SELECT n_regionkey AS r, [n_regionkey, 2] AS ks FROM nation) SELECT r_regionkey, (SELECT count(*) FROM f WHERE k IN (r_regionkey, 1)) AS one, (SELECT count(*) FROM g WHERE list_has_any(ks, [r_regionkey, 1])) AS many FROM region",
)
def lookup_repeated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal foreign rows each count, and a row that several keys reach counts once."""
    db = database(spark, sf_dir)
    nation = db.collection("nation")
    db.catalog.register("f", nation.select(F.col("n_regionkey").alias("k")).unionByName(spark.range(1).select(F.lit(2).alias("k"))))
    db.catalog.register("g", nation.select(F.array("n_regionkey", F.lit(2)).alias("ks")))
    return db.aggregate("region", [{"$project": {"r_regionkey": 1, "w": ["$r_regionkey", 1]}}, {"$lookup": {"from": "f", "localField": "w", "foreignField": "k", "as": "a"}}, {"$lookup": {"from": "g", "localField": "w", "foreignField": "ks", "as": "b"}}, {"$project": {"r_regionkey": 1, "one": {"$size": "$a"}, "many": {"$size": "$b"}}}])


@query(
    "graph_lookup_arrays",
    """WITH RECURSIVE e AS (SELECT p_partkey AS f, unnest([p_partkey // 2, p_partkey // 3]) AS t FROM part WHERE p_partkey < 200),
w AS (SELECT p_partkey AS s, p_partkey AS k, 0 AS d FROM part WHERE p_partkey < 200 UNION SELECT s, t, d + 1 FROM w JOIN e ON f = k WHERE d < 12), b AS (SELECT s, k, min(d) AS d FROM w JOIN part ON p_partkey = k GROUP BY 1, 2)
SELECT s AS p_partkey, count(*) AS n, sum(k) AS total, max(d) AS deep FROM b GROUP BY 1""",
)
def graph_lookup_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several edges a node, cycles through 0 excluded by what is visited; nodes count at their least depth."""
    db = database(spark, sf_dir)
    db.catalog.register("g", db.collection("part").where("p_partkey < 200").select("p_partkey", F.array(F.floor(F.col("p_partkey") / 2), F.floor(F.col("p_partkey") / 3)).alias("to")))
    return db.aggregate("g", [{"$graphLookup": {"from": "g", "startWith": "$p_partkey", "connectFromField": "to", "connectToField": "p_partkey", "as": "all", "depthField": "d"}}, {"$project": {"p_partkey": 1, "n": {"$size": "$all"}, "total": {"$sum": "$all.p_partkey"}, "deep": {"$max": "$all.d"}}}])


@query("collation_groups", "SELECT lower(s) AS low, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE lower(c_mktsegment) END AS s FROM customer) WHERE lower(s) <> 'building' GROUP BY 1")
def collation_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter and group without regard to case."""
    db = database(spark, sf_dir)
    db.catalog.register("t", db.collection("customer").select(F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(F.lower("c_mktsegment")).alias("s")))
    out = db.aggregate("t", [{"$match": {"s": {"$ne": "Building"}}}, {"$group": {"_id": "$s", "n": {"$sum": 1}}}], collation={"locale": "en", "strength": 2})
    return out.select(F.lower("_id").alias("low"), "n")


@query("inverse_match", "SELECT p_partkey FROM part WHERE 25 > p_size AND p_partkey % 3 <> 0")
def inverse_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored queries that a given document matches."""
    db = database(spark, sf_dir)
    rule = F.when(F.col("p_partkey") % 3 == 0, F.lit('{"size": {"$lt": 0}}')).otherwise(F.concat(F.lit('{"size": {"$gt": '), F.col("p_size").cast("string"), F.lit('}, "kind": "a"}')))
    db.catalog.register("rules", db.collection("part").select("p_partkey", rule.alias("rule")))
    return db.aggregate("rules", [{"$inverseMatch": {"path": "rule", "input": {"size": 25, "kind": "a"}}}, {"$project": {"p_partkey": 1}}])


# search


def _vector(db) -> list[float]:
    n = len(db.collection("embeddings").select("embedding").first()[0])
    return [((i * 7) % 11 - 5) / 5 for i in range(n)]


Q = "((((i - 1) * 7) % 11) - 5) / 5.0"


@query(
    "vector_metrics",
    f"""WITH s AS (SELECT vec_id, label, list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * ({Q}))) AS ip, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n, sqrt(list_sum(list_transform(embedding, lambda x, i: (x::DOUBLE - ({Q})) ** 2))) AS l2 FROM embeddings)
(SELECT 'ip' AS metric, vec_id FROM s ORDER BY ip DESC LIMIT 15) UNION ALL (SELECT 'cos', vec_id FROM s ORDER BY ip / n DESC LIMIT 15) UNION ALL (SELECT 'l2', vec_id FROM s WHERE label > 2 ORDER BY l2 LIMIT 15) UNION ALL (SELECT 'vs', vec_id FROM s WHERE label = 1 ORDER BY ip / n DESC LIMIT 5)""",
)
def vector_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner product, cosine and euclidean, with filters before the search."""
    db = database(spark, sf_dir)
    v = _vector(db)
    find = lambda name, stage: db.aggregate("embeddings", [stage, {"$project": {"metric": {"$literal": name}, "vec_id": 1}}])
    base = {"vector": v, "path": "embedding", "k": 15}
    return find("ip", {"$search": {"cosmosSearch": base | {"metric": "dotProduct"}}}).unionByName(find("cos", {"$search": {"knnBeta": base}})).unionByName(find("l2", {"$search": {"cosmosSearch": base | {"metric": "euclidean", "filter": {"label": {"$gt": 2}}}}})).unionByName(find("vs", {"$vectorSearch": {"path": "embedding", "queryVector": v, "limit": 5, "filter": {"label": 1}}}))


def searches(name: str, cases: list[tuple[dict, str]]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = database(spark, sf_dir)
        return reduce(DataFrame.unionByName, [db.aggregate("customer", [{"$search": q}, {"$project": {"i": {"$literal": i}, "c_custkey": 1}}]) for i, (q, _) in enumerate(cases)])

    QUERIES[name] = run
    ORACLES[name] = " UNION ALL ".join(f"SELECT {i} AS i, c_custkey FROM customer WHERE {w}" for i, (_, w) in enumerate(cases))


TEXT = lambda w: {"text": {"query": w, "path": "c_mktsegment"}}
searches(
    "search_operators",
    [
        (TEXT("building machinery"), "c_mktsegment IN ('BUILDING', 'MACHINERY')"), ({"phrase": {"query": "furniture", "path": "c_mktsegment"}}, "c_mktsegment = 'FURNITURE'"), ({"equals": {"path": "c_nationkey", "value": 4}}, "c_nationkey = 4"), ({"exists": {"path": "c_name"}}, "c_name IS NOT NULL"), ({"in": {"path": "c_nationkey", "value": [1, 2]}}, "c_nationkey IN (1, 2)"), ({"range": {"path": "c_acctbal", "gt": 9000, "lte": 9500}}, "c_acctbal > 9000 AND c_acctbal <= 9500"), ({"regex": {"path": "c_name", "query": "99$"}}, "c_name LIKE '%99'"), ({"wildcard": {"path": "c_mktsegment", "query": "*IN?RY"}}, "c_mktsegment LIKE '%IN_RY'"), ({"autocomplete": {"path": "c_mktsegment", "query": "mach"}}, "c_mktsegment = 'MACHINERY'"),
        ({"compound": {"should": [TEXT("building"), {"equals": {"path": "c_nationkey", "value": 4}}]}}, "c_mktsegment = 'BUILDING' OR c_nationkey = 4"), ({"compound": {"must": [TEXT("building")], "mustNot": [{"range": {"path": "c_acctbal", "lt": 0}}], "filter": [{"range": {"path": "c_nationkey", "gte": 20}}], "should": [TEXT("x")]}}, "c_mktsegment = 'BUILDING' AND NOT c_acctbal < 0 AND c_nationkey >= 20"), ({"compound": {"should": [TEXT("building"), {"range": {"path": "c_acctbal", "lt": 0}}, {"equals": {"path": "c_nationkey", "value": 4}}], "minimumShouldMatch": 2}}, "(c_mktsegment = 'BUILDING')::INT + (c_acctbal < 0)::INT + (c_nationkey = 4)::INT >= 2"), ({"queryString": {"defaultPath": "c_mktsegment", "query": "(building OR machinery) AND NOT building"}}, "c_mktsegment = 'MACHINERY'"), ({"moreLikeThis": {"like": {"c_mktsegment": "Household, furniture!"}}}, "c_mktsegment IN ('HOUSEHOLD', 'FURNITURE')"), ({"near": {"path": "c_acctbal", "origin": 5000, "pivot": 100}}, "c_acctbal IS NOT NULL"),
    ],
)


@query("search_meta", "SELECT count(*) AS total, count(*) FILTER (c_mktsegment = 'BUILDING') AS building, count(*) FILTER (c_nationkey BETWEEN 10 AND 19) AS tens FROM customer WHERE c_acctbal > 0")
def search_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda facet, key: {"$sum": {"$map": {"input": {"$filter": {"input": f"$facet.{facet}", "cond": {"$eq": ["$$this._id", key]}}}, "in": "$$this.count"}}}
    return database(spark, sf_dir).aggregate("customer", [{"$searchMeta": {"facet": {"operator": {"range": {"path": "c_acctbal", "gt": 0}}, "facets": {"segment": {"type": "string", "path": "c_mktsegment"}, "nation": {"type": "number", "path": "c_nationkey", "boundaries": [0, 10, 20, 30]}}}}}, {"$project": {"total": "$count.total", "building": one("segment", "BUILDING"), "tens": one("nation", 10)}}])


# streams


@query("change_stream", "SELECT n_nationkey AS k, 'insert' AS op, n_name AS name, NULL AS was FROM nation UNION ALL SELECT n_nationkey, 'update', 'changed', n_name FROM nation WHERE n_regionkey = 1 UNION ALL SELECT n_nationkey, 'delete', NULL, NULL FROM nation WHERE n_regionkey = 2")
def change_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts, updates with images before and after, and deletes, read as one stream."""
    import uuid

    from ..shared import shared_dir
    from ..streaming.changes import ChangeLog

    db = database(spark, sf_dir)
    nation = db.collection("nation").select(F.col("n_nationkey").alias("_id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("r"))
    where = f"{shared_dir(spark)}/changes-{uuid.uuid4().hex}"
    log = ChangeLog(spark, f"{where}/log", nation.schema.simpleString()[7:-1].replace(":", " "))
    log.record("insert", nation)
    log.record("update", nation.where("r = 1").withColumn("name", F.lit("changed")), before=nation)
    log.record("delete", nation.where("r = 2"))
    stream = log.watch([{"$project": {"k": {"$toInt": "$documentKey"}, "op": "$operationType", "name": "$fullDocument.name", "was": "$fullDocumentBeforeChange.name"}}])
    stream.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{where}/out").select("k", "op", "name", "was")


# formats

EVENTS = "SELECT event_id, date_trunc('milliseconds', ts) AS ts, user_id, event_type, value, CAST(value AS DECIMAL(20, 4)) AS exact, props FROM events"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database(spark, sf_dir).collection("events").select("event_id", F.date_trunc("millisecond", "ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", F.col("value").cast("decimal(20,4)").alias("exact"), "props")


@query("extended_json_round_trip", EVENTS)
def extended_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as canonical extended JSON, read back by its types."""
    from ..sources.formats import from_extended_json, to_extended_json

    df = _events(spark, sf_dir)
    return to_extended_json(df).select(from_extended_json(F.col("value"), df.schema).alias("doc")).select("doc.*")


@query("bson_round_trip", EVENTS)
def bson_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a BSON document, read back by its types."""
    from ..sources.formats import from_bson, to_bson

    df = _events(spark, sf_dir)
    return from_bson(to_bson(df), df.schema)
