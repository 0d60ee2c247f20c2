"""The index as partitioned Parquet: build, snapshots by version, catalog, readers that prune."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_snapshot(df: DataFrame, path: str) -> None:
    """Append versions (repo_id, version_id, ...); a version already there is replaced whole, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id", "version_id").parquet(path)


def _open(spark: SparkSession, path: str) -> DataFrame:
    """The store with its partition columns as strings, whatever their values look like."""
    found = spark.read.parquet(path).schema
    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name in ("repo_id", "version_id") else f for f in found])
    return spark.read.schema(schema).parquet(path)


def read_snapshot(spark: SparkSession, path: str, repo_id: str, version_id: str) -> DataFrame:
    """One version: other partitions aren't read. A missing store gives no rows but raises for a wrong path."""
    return _open(spark, path).where((F.col("repo_id") == repo_id) & (F.col("version_id") == version_id))


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """(repo_id, version_id), sorted; from partition names alone."""
    return _open(spark, path).select("repo_id", "version_id").distinct().orderBy("repo_id", "version_id")


def drop_old(spark: SparkSession, path: str, most: int = 2) -> list[str]:
    """Delete all but the newest most versions of each repository; returns what went."""
    from strataline.operators.incremental import keep_versions
    from strataline.session import remove

    gone = [f"{path}/repo_id={r.repo_id}/version_id={r.version_id}" for r in keep_versions(catalog(spark, path), most).where("not kept").collect()]
    remove(spark, gone)
    return gone
