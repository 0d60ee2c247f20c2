"""Keeping the index current by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def diff_manifest(current: DataFrame, previous: DataFrame, force: bool = False) -> DataFrame:
    """(repo_id, path, status): changed, added, unchanged or deleted of two states (repo_id, path, hash), one row a file. force treats every file as added."""
    prev = previous.limit(0) if force else previous
    c = current.select("repo_id", "path", F.col("hash").alias("new"), F.lit(True).alias("is_new"))
    p = prev.select("repo_id", "path", F.col("hash").alias("old"), F.lit(True).alias("is_old"))
    j = c.join(p, ["repo_id", "path"], "full_outer")
    return j.select("repo_id", "path", F.when(F.col("is_old").isNull(), "added").when(F.col("is_new").isNull(), "deleted").when(F.col("new").eqNullSafe(F.col("old")), "unchanged").otherwise("changed").alias("status"))


def build_stats(diff: DataFrame) -> DataFrame:
    """Counts of each status per repository."""
    s = F.col("status")
    return diff.groupBy("repo_id").agg(F.count_if(s != "deleted").alias("n_total"), *[F.count_if(s == x).alias(f"n_{x}") for x in ("changed", "added", "unchanged", "deleted")])


def keep_versions(versions: DataFrame, most: int = 2) -> DataFrame:
    """(repo_id, version_id, kept): the newest most builds of a repository stay."""
    return versions.select("repo_id", "version_id", (F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("version_id"))) <= most).alias("kept"))


def unique_version_ids(builds: DataFrame) -> DataFrame:
    """builds (repo_id, version_id, built_at) with -2, -3 ... added to ids that collide within a repository, in order of built_at."""
    n = F.row_number().over(Window.partitionBy("repo_id", "version_id").orderBy("built_at"))
    return builds.withColumn("n", n).withColumn("version_id", F.when(F.col("n") > 1, F.concat("version_id", F.lit("-"), F.col("n").cast("string"))).otherwise(F.col("version_id"))).drop("n")


def upsert(stored: DataFrame, fresh: DataFrame, replaced: DataFrame, key: str) -> DataFrame:
    """stored without the rows of replaced keys, and fresh: delete with cascade and insert as one anti-join and one union."""
    return stored.join(replaced.select(key).distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def cascade(files: DataFrame, symbols: DataFrame, **dependents: tuple[DataFrame, str]) -> dict[str, DataFrame]:
    """Tables without the rows whose file or symbol is gone. dependents: name=(table, column that holds a symbol id)."""
    s = symbols.join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi")
    ids = s.select(F.col("id").alias("sid"))
    return {"symbols": s} | {k: t.join(ids, t[c] == ids["sid"], "left_semi") for k, (t, c) in dependents.items()}


def prune(catalog: DataFrame, live: DataFrame) -> DataFrame:
    """Catalog rows of repositories that still exist."""
    return catalog.join(live.select("repo_id").distinct(), "repo_id", "left_semi")
