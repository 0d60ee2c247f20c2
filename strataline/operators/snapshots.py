"""What changed between consecutive full snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.session import materialize


def clean_path(c: Column) -> Column:
    """Single forward slashes, no leading ./ ."""
    return F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "/+", "/"), r"^(\./)+", "")


def latest(listing: DataFrame) -> DataFrame:
    """(repo_id, version_id, path, hash), one row a file and build.

    Paths are cleaned, hashes lower-cased; of several rows the one with the greatest mtime holds (null least, ties: the greatest hash). Rows
    without repo_id, version_id or path are left out; a null hash counts as a content of its own.
    """
    rows = listing.where("repo_id is not null and version_id is not null and path is not null").select(
        "repo_id", "version_id", clean_path(F.col("path")).alias("path"), F.struct(F.coalesce("mtime", F.lit(float("-inf"))).alias("m"), F.lower("hash").alias("h")).alias("s")
    )
    return rows.groupBy("repo_id", "version_id", "path").agg(F.max("s").alias("s")).select("repo_id", "version_id", "path", F.col("s.h").alias("hash"))


def changes(listing: DataFrame) -> DataFrame:
    """(repo_id, version_id, path, change): added, removed or changed against the repository's build before.

    The state of each build is made once and written, as several steps read it. Identical rows are taken out by EXCEPT ALL in both directions; only what remains is full-joined by key. All keys hold the path, so a
    repository with a third of all rows is spread over all tasks. Repeated rows and late builds make no difference; a repository with one build,
    or an empty listing, gives no row.
    """
    state, _ = materialize(latest(listing), "state")
    builds = state.select("repo_id", "version_id").distinct()
    w = Window.partitionBy("repo_id").orderBy("version_id")  # builds of one repository: a handful of rows
    pairs = builds.withColumn("next_id", F.lead("version_id").over(w)).withColumn("prior_id", F.lag("version_id").over(w))
    j = state.join(pairs, ["repo_id", "version_id"])
    new = j.where("prior_id is not null").select("repo_id", "version_id", "path", "hash")
    old = j.where("next_id is not null").select("repo_id", F.col("next_id").alias("version_id"), "path", "hash")
    came = new.exceptAll(old).withColumnRenamed("hash", "new_hash").withColumn("is_new", F.lit(True))
    went = old.exceptAll(new).withColumnRenamed("hash", "old_hash").withColumn("is_old", F.lit(True))
    both = came.join(went, ["repo_id", "version_id", "path"], "full_outer")
    return both.select("repo_id", "version_id", "path", F.when(F.col("is_old").isNull(), "added").when(F.col("is_new").isNull(), "removed").otherwise("changed").alias("change"))
