"""Change streams and per-row pipelines over Structured Streaming.

A watched collection is a folder of change files; ``ChangeLog`` appends one
file batch per write and ``watch`` reads them as a stream, in order, with the
file source's own offsets as resume tokens.
"""

from __future__ import annotations

import itertools
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Database
from ..functions.expressions import ExpressionError

#: Stages that look at one row at a time.
PER_ROW = ("$match", "$project", "$addFields", "$set", "$unset", "$replaceRoot", "$replaceWith", "$unwind", "$redact")


class ChangeLog:
    """Records writes of one collection under ``path``."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema
        self._writes = itertools.count()

    def record(self, operation: str, docs: DataFrame, before: DataFrame | None = None) -> None:
        """Appends insert, update, replace or delete events of ``docs`` (with pre-images, if given)."""
        body, now = F.struct("*"), int(time.time() * 1000)
        full = F.to_json(body) if operation != "delete" else F.lit(None).cast("string")
        events = docs.select(F.lit(operation).alias("operationType"), F.lit(now).alias("clusterTime"), full.alias("fullDocument"), (F.col("_id").cast("string") if "_id" in docs.columns else F.lit(None).cast("string")).alias("documentKey"))
        if before is not None and "_id" in before.columns:
            old = before.select(F.col("_id").cast("string").alias("documentKey"), F.to_json(body).alias("fullDocumentBeforeChange"))
            events = events.join(old, "documentKey", "left")
        else:
            events = events.withColumn("fullDocumentBeforeChange", F.lit(None).cast("string"))
        # writes of one millisecond differ by their number, rows of one write by their key
        events = events.withColumn("token", F.concat(F.lit(f"{now:015d}-{next(self._writes):06d}-"), F.coalesce("documentKey", F.lit(""))))
        events.select("token", "operationType", "clusterTime", "documentKey", "fullDocument", "fullDocumentBeforeChange").write.mode("append").parquet(self.path)

    def watch(self, pipeline: list[dict] | None = None, since: int | None = None, resume_after: str | None = None) -> DataFrame:
        """A streaming DataFrame of events, documents parsed, after per-row stages.

        ``since`` is a time in milliseconds, ``resume_after`` the token of the last event seen.
        """
        events = self.spark.readStream.schema("token string, operationType string, clusterTime long, documentKey string, fullDocument string, fullDocumentBeforeChange string").parquet(self.path)
        if since is not None:
            events = events.where(F.col("clusterTime") >= since)
        if resume_after is not None:
            events = events.where(F.col("token") > resume_after)
        for c in ("fullDocument", "fullDocumentBeforeChange"):
            events = events.withColumn(c, F.from_json(c, self.schema))
        return apply_stream(Database(self.spark), events, pipeline or [])


def apply_stream(db: Database, stream: DataFrame, pipeline: list[dict], time_field: str | None = None, late: str = "10 minutes") -> DataFrame:
    """A pipeline over a stream: per-row stages, then at most one $group with a watermark."""
    for i, s in enumerate(pipeline):
        (op,) = s
        if op in PER_ROW:
            stream = db.run(stream, [s])
        elif op == "$group" and i == len(pipeline) - 1:
            if time_field:
                stream = stream.withWatermark(time_field, late)
            stream = db.run(stream, [s])
        else:
            raise ExpressionError(f"{op} isn't a streaming stage")
    return stream


def windowed_counts(stream: DataFrame, time_field: str, keys: list[str], size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window and keys, with late rows dropped past the watermark."""
    return stream.withWatermark(time_field, late).groupBy(F.window(time_field, size, slide or size), *keys).agg(F.count(F.lit(1)).alias("count"))


def expire(db: Database, name: str, field: str, seconds: int, now) -> int:
    """TTL: removes documents whose date is older than ``seconds``."""
    import datetime

    return db.catalog.delete(name, {field: {"$lt": now - datetime.timedelta(seconds=seconds)}})
