"""Collections: names for DataFrames, Parquet folders, views and their writes.

A stored collection is a folder of Parquet files under ``root``. Writes make a
new version folder and switch the catalog's pointer afterwards, so readers of
the old version and failed jobs never see half a write.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import ExpressionError, literal
from ..operators import jsonschema, updates
from ..operators.predicates import compile_query
from ..shared import shared_dir


class Catalog:
    """Names of one database."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or f"{shared_dir(spark)}/db-{uuid.uuid4().hex}"
        self.frames: dict[str, DataFrame] = {}
        self.views: dict[str, tuple[str, list]] = {}
        self.validators: dict[str, dict] = {}
        self.indexes: list[tuple[str, str, str]] = []

    # names

    def register(self, name: str, df: DataFrame) -> None:
        self.frames[name] = df

    def register_parquet(self, name: str, path: str) -> None:
        self.frames[name] = self.spark.read.parquet(path)

    def create_view(self, name: str, on: str, pipeline: list) -> None:
        self.views[name] = (on, pipeline)

    def create_collection(self, name: str, schema, validator: dict | None = None) -> None:
        self.frames.setdefault(name, self.spark.createDataFrame([], schema))
        if validator:
            self.validators[name] = validator.get("$jsonSchema", validator)

    def drop(self, name: str) -> bool:
        return self.frames.pop(name, None) is not None or self.views.pop(name, None) is not None

    def rename(self, name: str, to: str) -> None:
        self.frames[to] = self.frames.pop(name)

    def list_collections(self) -> DataFrame:
        rows = [(n, "collection") for n in self.frames] + [(n, "view") for n in self.views]
        return self.spark.createDataFrame(sorted(rows), "name string, type string")

    def create_index(self, name: str, keys: dict, kind: str = "btree") -> str:
        """Recorded only: scans prune by Parquet statistics; there are no secondary indexes."""
        made = "_".join(f"{k}_{v}" for k, v in keys.items())
        self.indexes.append((name, made, kind))
        return made

    def index_frame(self) -> DataFrame:
        return self.spark.createDataFrame(self.indexes, "collection string, name string, kind string")

    def get(self, name: str) -> DataFrame:
        """A missing collection is an empty one."""
        if name in self.frames:
            return self.frames[name]
        return self.spark.createDataFrame([], "_id long")

    # writes

    def replace(self, name: str, df: DataFrame) -> None:
        path = f"{self.root}/{name}/v-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.frames[name] = self.spark.read.parquet(path)

    def _checked(self, name: str, df: DataFrame) -> DataFrame:
        if name in self.validators:
            bad = df.where(~jsonschema.valid(df, self.validators[name]))
            if not bad.isEmpty():
                raise ExpressionError(f"documents fail the validator of {name}")
        return df

    def insert(self, name: str, docs) -> int:
        """Appends documents (a DataFrame or a list of dictionaries)."""
        new = docs if isinstance(docs, DataFrame) else self.spark.createDataFrame(docs)
        self._checked(name, new)
        count = new.count()
        old = self.frames.get(name)
        self.replace(name, new if old is None else old.unionByName(new, allowMissingColumns=True))
        return count

    def _hit(self, df: DataFrame, query: dict, multi: bool):
        """``df`` with a flag for the rows that a write touches; one row alone is the least by _id."""
        test = compile_query(df, query) if query else F.lit(True)
        marked = df.withColumn("__hit", test)
        if multi:
            return marked
        key = F.col("_id") if "_id" in df.columns else F.xxhash64(F.struct("*"))
        least = marked.where("__hit").agg(F.min(key)).first()[0]
        return marked.withColumn("__hit", F.col("__hit") & key.eqNullSafe(F.lit(least)))

    def update(self, name: str, query: dict, update: dict | list, multi: bool = False, upsert: bool = False, array_filters: list[dict] | None = None) -> dict:
        df = self.get(name)
        marked = self._hit(df, query, multi)
        hit = marked.where("__hit").drop("__hit")
        n = hit.count()
        if not n:
            if not upsert:
                return {"matched": 0, "upserted": 0}
            plain = {k: v for k, v in query.items() if not k.startswith("$") and not isinstance(v, dict)}
            seed = self.spark.range(1).select(*(literal(v).alias(k) for k, v in plain.items())) if plain else self.spark.range(1).select(F.lit(None).cast("long").alias("_id"))
            self.insert(name, updates.apply(seed, update, inserting=True))
            return {"matched": 0, "upserted": 1}
        changed = updates.apply(hit, update, array_filters=array_filters, query=query)
        self.replace(name, self._checked(name, marked.where("not __hit").drop("__hit").unionByName(changed, allowMissingColumns=True)))
        return {"matched": n, "upserted": 0}

    def delete(self, name: str, query: dict, multi: bool = True) -> int:
        marked = self._hit(self.get(name), query, multi)
        n = marked.where("__hit").count()
        if n:
            self.replace(name, marked.where("not __hit").drop("__hit"))
        return n

    def find_and_modify(self, name: str, query: dict, update: dict | list | None = None, remove: bool = False, new: bool = False):
        """The touched row before (or after) the change, as a Row or None."""
        df = self.get(name)
        hit = self._hit(df, query, False).where("__hit").drop("__hit")
        before = hit.first()
        if before is None:
            return None
        after = updates.apply(hit, update, query=query).first() if update is not None and not remove else None
        if remove:
            self.delete(name, query, multi=False)
        else:
            self.update(name, query, update)
        return after if new else before

    def bulk_write(self, operations: list[tuple], ordered: bool = True) -> list:
        """(method, arguments...) in order, over any collections.

        Ordered writes end at the first that fails, which raises. Unordered ones
        go on, and a failed one's exception stands in its place.
        """
        out = []
        for op, *args in operations:
            try:
                out.append(getattr(self, op)(*args))
            except Exception as e:
                if ordered:
                    raise
                out.append(e)
        return out

    def merge(self, df: DataFrame, spec: dict) -> None:
        """$merge: one full outer join on the ``on`` fields."""
        name = spec["into"]["coll"] if isinstance(spec["into"], dict) else spec["into"]
        on = spec.get("on", "_id")
        on = [on] if isinstance(on, str) else list(on)
        matched, unmatched = spec.get("whenMatched", "merge"), spec.get("whenNotMatched", "insert")
        if name not in self.frames:
            if unmatched == "insert":
                self.replace(name, df)
            return
        old = self.frames[name]
        cols = list(dict.fromkeys([*old.columns, *df.columns]))
        a = old.select(F.struct("*").alias("o"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(on)))
        b = df.select(F.struct("*").alias("n"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(on)))
        j = a.join(b, [f"k{i}" for i in range(len(on))], "full_outer")
        if matched == "fail" and not j.where("o is not null and n is not null").isEmpty():
            raise ExpressionError("$merge found a matching document")
        if unmatched == "fail" and not j.where("o is null").isEmpty():
            raise ExpressionError("$merge found no matching document")
        if unmatched == "discard":
            j = j.where("o is not null")
        both = F.col("o").isNotNull() & F.col("n").isNotNull()

        def value(c: str):
            was = F.col(f"o.{c}") if c in old.columns else F.lit(None)
            now = F.col(f"n.{c}") if c in df.columns else F.lit(None)
            if matched == "keepExisting":
                return F.when(F.col("o").isNotNull(), was).otherwise(now)
            if matched == "replace":
                return F.when(F.col("n").isNotNull(), now).otherwise(was)
            return F.when(both, F.coalesce(now, was)).when(F.col("n").isNotNull(), now).otherwise(was)

        if isinstance(matched, list):
            plain = j.where(~both).select(*(F.when(F.col("n").isNotNull(), F.col(f"n.{c}") if c in df.columns else F.lit(None)).otherwise(F.col(f"o.{c}") if c in old.columns else F.lit(None)).alias(c) for c in cols))
            hit = j.where(both).select("o.*", F.col("n").alias("new"))
            rewritten = [{k: _new(v) for k, v in s.items()} for s in matched]
            self.replace(name, plain.unionByName(updates.apply(hit, rewritten).drop("new"), allowMissingColumns=True))
            return
        self.replace(name, j.select(*(value(c).alias(c) for c in cols)))


def _new(v):
    """``$$new`` in a whenMatched pipeline is a column beside the old fields."""
    if isinstance(v, str) and (v == "$$new" or v.startswith("$$new.")):
        return "$" + v[2:]
    if isinstance(v, dict):
        return {k: _new(x) for k, x in v.items()}
    return [_new(x) for x in v] if isinstance(v, list) else v
