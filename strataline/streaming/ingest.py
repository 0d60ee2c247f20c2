"""Keeping an index current from a directory of deliveries, as a structured stream.

An extension: the index is otherwise built in batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.session import _file_system, remove
from strataline.sources.tables import SCHEMAS


def changes_stream(spark: SparkSession, drop_dir: str, store: str, checkpoint: str, name: str = "symbols", key: str = "id"):
    """Start a query that upserts each delivery of table name from drop_dir into versioned folders under store, on any file system Spark writes to.

    Every batch writes a complete new version; a version counts once its write is finished, so a lost executor or a repeated batch leaves the store whole. The last two
    versions stay. Of several rows of a key in one delivery the greatest holds.
    """
    rows = spark.readStream.schema(SCHEMAS[name]).parquet(drop_dir)

    def upsert(batch: DataFrame, n: int) -> None:
        fresh = batch.groupBy(key).agg(F.max(F.struct(*[c for c in batch.columns if c != key])).alias("r")).select(key, "r.*")
        before = [v for v in _versions(spark, store) if v < n]
        old = spark.read.schema(SCHEMAS[name]).parquet(f"{store}/v{before[-1]}") if before else None
        out = fresh if old is None else old.join(fresh, key, "left_anti").unionByName(fresh)
        out.write.mode("overwrite").parquet(f"{store}/v{n}")
        remove(spark, [f"{store}/v{v}" for v in before[:-1]])

    return rows.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, store: str) -> list[int]:
    """The finished versions of a store, oldest first."""
    hp, fs = _file_system(spark, store)
    names = [x.getPath().getName() for x in fs.listStatus(hp)] if fs.exists(hp) else []
    return sorted(int(x[1:]) for x in names if x[:1] == "v" and x[1:].isdigit() and fs.exists(_file_system(spark, f"{store}/{x}/_SUCCESS")[0]))


def current(spark: SparkSession, store: str, name: str = "symbols") -> DataFrame | None:
    """The newest finished version of the store, or None before the first."""
    found = _versions(spark, store)
    return spark.read.schema(SCHEMAS[name]).parquet(f"{store}/v{found[-1]}") if found else None


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, event_type, n, value): tumbling windows over event time with a watermark; works on streams and tables alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("value")).select(F.col("w.start").alias("window_start"), "event_type", "n", "value")
