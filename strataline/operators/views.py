"""What the pages over a graph show: sizes, heights, buckets, filters, closures and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataline.operators.analytics import lower_nearest
from strataline.session import materialize


def block_heights(symbols: DataFrame, p: float = 0.98) -> DataFrame:
    """(id, height): 0.25 + min(1.6, sqrt(lines / p98)) * 7, times 3.5 for files; p98 over all symbols, at least 1."""
    s = symbols.select("id", "kind", F.greatest(F.lit(1), F.col("end_line") - F.col("start_line") + 1).cast("double").alias("raw")).withColumn("one", F.lit(1))
    top = lower_nearest(s, "one", "raw", p).select(F.greatest(F.col("raw"), F.lit(1.0)).alias("p98"))
    return s.crossJoin(F.broadcast(top)).select("id", F.round(0.25 + F.least(F.lit(1.6), F.sqrt(F.col("raw") / F.col("p98"))) * F.when(F.col("kind") == "file", 3.5).otherwise(7.0), 6).alias("height"))  # p98 is one row


def degree_rings(degrees: DataFrame, rings: int = 5) -> DataFrame:
    """(id, ring, percent): share of the greatest degree, in rings 0..5 and in percent."""
    top = degrees.agg(F.greatest(F.max("degree"), F.lit(1)).alias("top"))
    d = degrees.crossJoin(F.broadcast(top))  # one row
    return d.select("id", F.floor(F.col("degree") / F.col("top") * rings + 0.5).alias("ring"), F.floor(F.col("degree") / F.col("top") * 100 + 0.5).alias("percent"))


def top_degrees(degrees: DataFrame, most: int = 12) -> DataFrame:
    """The most linked symbols to start from (a top-k report)."""
    return degrees.orderBy(F.desc("degree"), "id").limit(most)


def closed_neighborhood(roots: DataFrame, links: DataFrame, hops: int = 2) -> DataFrame:
    """(root, node, hop): everything within hops steps in either direction, the root at 0."""
    both = links.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(links.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()
    level = roots.select("root", F.col("root").alias("node"))
    seen = level.withColumn("hop", F.lit(0))
    for h in range(1, hops + 1):
        new = level.join(both, level["node"] == both["a"]).select("root", F.col("b").alias("node")).distinct().join(seen.select("root", "node"), ["root", "node"], "left_anti")
        level, _ = materialize(new, "near")
        seen = seen.unionByName(level.withColumn("hop", F.lit(h)))
    return seen


def highlight(matches: DataFrame, containers: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes (id), edges (src, dst)): matches (id), what contains them, their links and the other ends of these."""
    hit = matches.select("id").distinct()
    up = containers.where("class_id is not null").join(hit, containers["symbol_id"] == hit["id"], "left_semi").select(F.col("class_id").alias("id"))
    e = links.join(hit.toDF("src"), "src", "left_semi").unionByName(links.join(hit.toDF("dst"), "dst", "left_semi").select(links.columns)).select("src", "dst").distinct()
    return hit.unionByName(up).unionByName(e.select(F.col("src").alias("id"))).unionByName(e.select(F.col("dst").alias("id"))).distinct(), e


def lookup(queries: DataFrame, symbols: DataFrame, files: DataFrame, most: int = 30) -> DataFrame:
    """(query_id, id): the first most symbols (by id) whose name, kind or path holds the question's text, without case."""
    q = queries.select("query_id", F.lower("q").alias("q")).where("q != ''")
    s = symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id", "left").select("id", F.lower(F.concat_ws("\n", "name", "kind", "path")).alias("t"))
    hit = q.join(s, F.col("t").contains(F.col("q")))  # a stated set of questions against all rows
    return hit.withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy("id"))).where(F.col("rn") <= most).select("query_id", "id")


def inspector(links: DataFrame, fans: DataFrame, most: int = 40) -> DataFrame:
    """(id, direction, other, strength, place): the strongest links of each symbol first, at most forty a direction (the list's length)."""
    e = links.select(F.col("src").alias("id"), F.lit("out").alias("direction"), F.col("dst").alias("other"), "strength").unionByName(links.select(F.col("dst").alias("id"), F.lit("in").alias("direction"), F.col("src").alias("other"), "strength"))
    e = e.join(fans.select(F.col("id").alias("other"), "fan_in"), "other", "left")
    return e.withColumn("place", F.row_number().over(Window.partitionBy("id", "direction").orderBy(F.desc("strength"), F.desc(F.coalesce("fan_in", F.lit(0.0))), "other"))).where(F.col("place") <= most).select("id", "direction", "other", "strength", "place")


def repositories(manifest: DataFrame) -> DataFrame:
    """(repo_id, n_versions, newest, n_files): what is indexed; n_files of the newest build, paths cleaned."""
    from strataline.operators.snapshots import latest

    s = latest(manifest).groupBy("repo_id", "version_id").agg(F.count("*").alias("n"))
    return s.groupBy("repo_id").agg(F.count("*").alias("n_versions"), F.max("version_id").alias("newest"), F.max_by("n", "version_id").alias("n_files"))
