"""The public interface: a database of collections, ``find`` and ``aggregate``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.expressions import Compiler, ExpressionError, slice_of
from .functions.paths import column_at, quoted, with_path
from .operators import search
from .operators.predicates import compile_query, element_test
from .operators.stages import STAGES, State, match, project, sort
from .plans.rewrite import rewrite
from .sources.catalog import Catalog

#: Stages that keep the order of a preceding $sort.
_KEEP_ORDER = {"$match", "$project", "$addFields", "$set", "$unset", "$limit", "$skip", "$unwind", "$sort", "$replaceRoot", "$replaceWith"}


def _first_match(df: DataFrame, c, kind, query: dict):
    """The first element of an array that a query matches, as an array."""
    return F.slice(F.filter(c, lambda x: element_test(df, x, kind.elementType, query)), F.lit(1), F.lit(1))


def _collation(spec: dict) -> str:
    """The session collation that a language, a strength and case sensitivity stand for.

    Strength 1 compares base letters, 2 accents too, 3 and above also case.
    """
    if spec.get("numericOrdering"):
        raise ExpressionError("numericOrdering isn't supported")
    locale, strength = spec.get("locale", "simple"), spec.get("strength", 3)
    if locale == "simple":
        return "UTF8_BINARY"
    case = strength >= 3 or spec.get("caseLevel", False)
    name = "UNICODE" if locale in ("en", "en_US", "root", "und") else locale
    return name + ("" if case else "_CI") + ("_AI" if strength == 1 else "")


def collated(df: DataFrame, spec: dict) -> DataFrame:
    """``df`` with its strings under a collation: comparisons, sorts and groups follow it."""
    name = _collation(spec)
    return df.select(*(F.collate(F.col(quoted(f.name)), name).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(quoted(f.name)) for f in df.schema.fields))


def plain(df: DataFrame) -> DataFrame:
    """``df`` with plain strings."""
    return df.select(*(F.collate(F.col(quoted(f.name)), "UTF8_BINARY").alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(quoted(f.name)) for f in df.schema.fields))


class Database:
    """Collections over one session.

    >>> db = Database(spark)
    >>> db.catalog.register_parquet("orders", "/data/orders.parquet")
    >>> db.aggregate("orders", [{"$group": {"_id": "$status", "n": {"$sum": 1}}}])
    """

    def __init__(self, spark: SparkSession, root: str | None = None, **settings):
        self.spark, self.catalog = spark, Catalog(spark, root)
        self.settings = {"densify_cap": 500_000, "max_stages": 1000, "first_page": 101} | settings

    def collection(self, name: str) -> DataFrame:
        if name in self.catalog.views:
            on, pipeline = self.catalog.views[name]
            return self.run(self.collection(on), pipeline)
        return self.catalog.get(name)

    def documents(self, rows: list[dict]) -> DataFrame:
        if not rows:
            return self.spark.createDataFrame([], "_id long")
        return self.spark.createDataFrame([Row(**r) for r in rows])

    def aggregate(self, name: str | None, pipeline: list[dict], let: dict | None = None, collation: dict | None = None) -> DataFrame:
        """The rows of a pipeline over a collection (None: it begins with its own source)."""
        df = self.collection(name) if name is not None else None
        if collation and df is not None:
            return plain(self.run(collated(df, collation), pipeline, let))
        return self.run(df, pipeline, let)

    def run(self, df: DataFrame | None, pipeline: list[dict], let: dict | None = None) -> DataFrame:
        if len(pipeline) > self.settings["max_stages"]:
            raise ExpressionError("too many stages")
        state = State()
        if let and df is not None:
            k = Compiler(df)
            state.variables = {v: (k.column(e), k.kind(e)) for v, e in let.items()}
        for s in rewrite(pipeline):
            if len(s) != 1:
                raise ExpressionError("a stage has one operator")
            ((op, spec),) = s.items()
            if op not in STAGES:
                raise ExpressionError(f"unknown stage {op}")
            df = STAGES[op](self, df, spec, state)
            if op not in _KEEP_ORDER:
                state.sort = None
        return df.drop(*(c for c in df.columns if c in ("__text_score", "__search_score", "__distance")))

    def find(self, name: str, query: dict | None = None, projection: dict | None = None, sort_by: dict | None = None, skip: int = 0, limit: int = 0, collation: dict | None = None) -> DataFrame:
        query = query or {}
        df = self.collection(name)
        if collation:
            df = collated(df, collation)
        df = match(df, query)
        near = next(((f, o, v[o], v) for f, v in query.items() if isinstance(v, dict) for o in ("$near", "$nearSphere", "$geoNear") if o in v), None)
        if near and not sort_by:
            c, kind = column_at(df, near[0])
            df = df.withColumn("__distance", search.near_distance(c, kind, near[1], near[2], near[3])).orderBy("__distance")
        if sort_by:
            df = sort(df, sort_by)
        if skip:
            df = df.offset(skip)
        if limit:
            df = df.limit(abs(limit))
        if projection:
            df = self._projected(df, projection, query)
        if collation:
            df = plain(df)
        return df.drop(*(c for c in df.columns if c in ("__text_score", "__search_score", "__distance")))

    def _projected(self, df: DataFrame, projection: dict, query: dict) -> DataFrame:
        """$slice, $elemMatch and positional paths first, then the rest."""
        plain = {}
        for path, v in projection.items():
            if path.endswith(".$"):
                base = path[:-2]
                c, kind = column_at(df, base)
                cond = query.get(base, {})
                cond = cond.get("$elemMatch", cond) if isinstance(cond, dict) else {"$eq": cond}
                df = with_path(df, base, _first_match(df, c, kind, cond))
                plain[base] = 1
            elif isinstance(v, dict) and "$slice" in v:
                c, _ = column_at(df, path)
                n = v["$slice"]
                df = with_path(df, path, slice_of(c, F.lit(n[0]), F.lit(n[1])) if isinstance(n, list) else slice_of(c, None, F.lit(n)))
                if any(x not in (0, False) and not (isinstance(x, dict) and "$slice" in x) for k, x in projection.items() if k != "_id"):
                    plain[path] = 1
            elif isinstance(v, dict) and "$elemMatch" in v:
                c, kind = column_at(df, path)
                first = _first_match(df, c, kind, v["$elemMatch"])
                df = with_path(df, path, F.when(F.size(first) > 0, first))
                plain[path] = 1
            else:
                plain[path] = v
        return project(df, plain) if plain else df

    def count(self, name: str, query: dict | None = None, skip: int = 0, limit: int = 0) -> int:
        return self.find(name, query, skip=skip, limit=limit).count()

    def distinct(self, name: str, key: str, query: dict | None = None, collation: dict | None = None) -> DataFrame:
        """The set of a field's values; arrays are opened."""
        df = self.collection(name)
        df = match(collated(df, collation) if collation else df, query or {})
        c, kind = column_at(df, key)
        if isinstance(kind, T.ArrayType):
            c = F.explode(F.flatten(c) if isinstance(kind.elementType, T.ArrayType) else c)
        out = df.select(c.alias("value")).where("value is not null").distinct()
        return plain(out) if collation else out

    def pages(self, df: DataFrame, size: int | None = None) -> Iterator[list[Row]]:
        """A cursor: rows in batches, a partition at a time."""
        page = []
        for row in df.toLocalIterator():
            page.append(row)
            if len(page) == (size or self.settings["first_page"]):
                yield page
                page = []
        if page:
            yield page

    def explain(self, name: str, pipeline: list[dict]) -> str:
        df = self.aggregate(name, pipeline)
        return df._jdf.queryExecution().toString()

    @staticmethod
    def register_stage(name: str, f: Callable[[Database, DataFrame, dict, State], DataFrame]) -> None:
        """Adds a stage of one's own."""
        if name in STAGES:
            raise ExpressionError(f"{name} exists")
        STAGES[name] = f


__all__ = ["Database", "compile_query"]
