"""Queries of the general data operators, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.operators.hierarchy import descendants, hierarchy
from strataline.operators.snapshots import changes
from strataline.sources.tables import table


def _contains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "edges").where("kind = 'contains' and dst_symbol_id is not null").select("src_symbol_id", "dst_symbol_id")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    t = hierarchy(_contains(spark, d), "src_symbol_id", "dst_symbol_id")
    return t.select(F.col("node").alias("symbol_id"), F.col("root").alias("root_symbol_id"), "depth")


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    t = hierarchy(_contains(spark, d), "src_symbol_id", "dst_symbol_id", paths=True, sizes=True)
    return t.select(F.col("node").alias("symbol_id"), F.concat_ws("/", F.col("path").cast("array<string>")).alias("path"), "depth", "root", (F.when(F.col("size") > 0, F.col("size") - 1).otherwise(F.lit(-1))).alias("n_descendants"))


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    t = hierarchy(_contains(spark, d), "src_symbol_id", "dst_symbol_id", paths=True)
    return descendants(t).select(F.col("ancestor").alias("symbol_id"), F.col("descendant").alias("descendant_id"), "distance")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return changes(table(spark, d, "manifest"))


QUERIES = {"p1_found": p1_found, "p1_paths": p1_paths, "p1_descendants": p1_descendants, "p2_found": p2_found}

_TREE = """WITH RECURSIVE c AS (SELECT DISTINCT src_symbol_id s, dst_symbol_id d FROM edges WHERE kind = 'contains' AND dst_symbol_id IS NOT NULL),
par AS (SELECT d, CASE WHEN max(CASE WHEN s = d THEN 1 ELSE 0 END) = 1 THEN d ELSE min(s) END p FROM c GROUP BY d),
nodes AS (SELECT s n FROM c WHERE s IS NOT NULL UNION SELECT d FROM c),
t AS (SELECT n, n AS root, 0 AS depth, CAST(n AS VARCHAR) AS path FROM nodes WHERE n NOT IN (SELECT d FROM par WHERE p IS NOT NULL)
  UNION ALL SELECT par.d, t.root, t.depth + 1, t.path || '/' || par.d FROM t JOIN par ON par.p = t.n)"""

SQL = {
    "p1_found": _TREE + " SELECT n AS symbol_id, coalesce(t.root, -1) AS root_symbol_id, CAST(coalesce(t.depth, -1) AS INTEGER) AS depth FROM nodes LEFT JOIN t USING (n)",
    "p1_paths": _TREE
    + """, u AS (SELECT n, unnest(string_split(path, '/')) a FROM t), z AS (SELECT CAST(a AS BIGINT) n, count(*) - 1 k FROM u GROUP BY a)
SELECT n AS symbol_id, coalesce(t.path, '') AS path, CAST(coalesce(t.depth, -1) AS INTEGER) AS depth, coalesce(t.root, -1) AS root, coalesce(z.k, -1) AS n_descendants FROM nodes LEFT JOIN t USING (n) LEFT JOIN z USING (n)""",
    "p1_descendants": _TREE + ", u AS (SELECT n, depth, string_split(path, '/') q, unnest(range(0, depth)) i FROM t) SELECT CAST(q[i + 1] AS BIGINT) AS symbol_id, n AS descendant_id, CAST(depth - i AS INTEGER) AS distance FROM u",
    "p2_found": """WITH c AS (SELECT repo_id, version_id, regexp_replace(regexp_replace(replace(path, '\\', '/'), '/+', '/', 'g'), '^(\\./)+', '') AS path, lower(hash) h, coalesce(mtime, -1e300) m FROM manifest WHERE repo_id IS NOT NULL AND version_id IS NOT NULL AND path IS NOT NULL),
s AS (SELECT repo_id, version_id, path, h FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, version_id, path ORDER BY m DESC, h DESC) r FROM c) WHERE r = 1),
b AS (SELECT repo_id, version_id, lag(version_id) OVER (PARTITION BY repo_id ORDER BY version_id) p FROM (SELECT DISTINCT repo_id, version_id FROM s)),
n AS (SELECT s.repo_id, s.version_id, s.path, s.h FROM s JOIN b USING (repo_id, version_id) WHERE b.p IS NOT NULL),
o AS (SELECT b.repo_id, b.version_id, s.path, s.h FROM b JOIN s ON s.repo_id = b.repo_id AND s.version_id = b.p)
SELECT repo_id, version_id, path, CASE WHEN o.repo_id IS NULL THEN 'added' WHEN n.repo_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM (SELECT *, 1 AS k FROM n) n FULL JOIN (SELECT *, 1 AS k FROM o) o USING (repo_id, version_id, path) WHERE n.k IS NULL OR o.k IS NULL OR n.h IS DISTINCT FROM o.h""".replace("o.repo_id IS NULL", "o.k IS NULL").replace("n.repo_id IS NULL", "n.k IS NULL"),
}
