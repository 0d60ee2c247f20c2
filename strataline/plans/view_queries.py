"""Queries of the views, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataline.operators import analytics as A
from strataline.operators import relations as R
from strataline.operators import views as V
from strataline.plans.analytics_queries import _FANS
from strataline.plans.graph_queries import _MODEL, MEMBER
from strataline.plans.text_queries import U_EDGES, U_FILES, U_SYM
from strataline.sources.tables import table, unique


def _m(spark, d):
    e, s = unique(spark, d, "edges"), unique(spark, d, "symbols")
    return e, s, R.model_edges(e, s)


def block_heights(spark, d):
    return V.block_heights(unique(spark, d, "symbols", "kind", "start_line", "end_line"))


def degree_rings(spark, d):
    return V.degree_rings(A.degrees(unique(spark, d, "edges")))


def top_degrees(spark, d):
    return V.top_degrees(A.degrees(unique(spark, d, "edges")))


def closed_neighborhood(spark, d):
    _, s, m = _m(spark, d)
    return V.closed_neighborhood(s.where("id % 100 = 0").select(F.col("id").alias("root")), m).withColumn("hop", F.col("hop").cast("long"))


def highlighted_nodes(spark, d):
    _, s, m = _m(spark, d)
    return V.highlight(s.where("id % 100 = 0").select("id"), R.containers(s), m)[0]


def highlighted_edges(spark, d):
    _, s, m = _m(spark, d)
    return V.highlight(s.where("id % 100 = 0").select("id"), R.containers(s), m)[1]


def lookup(spark, d):
    s, f = unique(spark, d, "symbols", "file_id", "name", "kind"), unique(spark, d, "files", "path")
    return V.lookup(s.where("id % 100 = 0 and name is not null").select(F.col("id").alias("query_id"), F.col("name").alias("q")), s, f)


def inspector(spark, d):
    _, _, m = _m(spark, d)
    return V.inspector(m, R.fan_counts(m)).select("id", "direction", "other", F.round("strength", 6).alias("strength"), F.col("place").cast("long").alias("place"))


def cross_file_edges(spark, d):
    _, s, m = _m(spark, d)
    return A.cross_file(m, s).select("src", "dst", "src_file", "dst_file")


def repositories(spark, d):
    return V.repositories(table(spark, d, "manifest"))


def full_graph(spark, d):
    """All resolved edges, whatever their kind."""
    return unique(spark, d, "edges").where("dst_symbol_id is not null").select("id", "src_symbol_id", "dst_symbol_id", "kind", F.coalesce("resolution", F.lit("heuristic")).alias("resolution"))


def edge_kinds(spark, d):
    """Distinct kinds of edges with their counts, and how many are unresolved."""
    return unique(spark, d, "edges").groupBy("kind", "resolution").agg(F.count("*").alias("n"), F.count_if(F.col("dst_symbol_id").isNull()).alias("n_unresolved"))


QUERIES = {f.__name__: f for f in (block_heights, degree_rings, top_degrees, closed_neighborhood, highlighted_nodes, highlighted_edges, lookup, inspector, cross_file_edges, repositories, full_graph, edge_kinds)}

_DEG = f"e AS (SELECT * FROM {U_EDGES} WHERE kind = 'calls' AND src_symbol_id IS NOT NULL AND dst_symbol_id IS NOT NULL), dg AS (SELECT id, count(*) AS degree, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT src_symbol_id id, 0 i, 1 o FROM e UNION ALL SELECT dst_symbol_id, 1, 0 FROM e) GROUP BY id)"
_HE = f"{_MODEL}, h AS (SELECT id FROM s WHERE id % 100 = 0), he AS (SELECT DISTINCT src, dst FROM m WHERE src IN (SELECT id FROM h) OR dst IN (SELECT id FROM h))"
SQL = {
    "block_heights": f"WITH l AS (SELECT id, kind, greatest(1, end_line - start_line + 1)::DOUBLE v FROM {U_SYM}), r AS (SELECT v, row_number() OVER (ORDER BY v) r, count(*) OVER () n FROM l WHERE v IS NOT NULL), p AS (SELECT greatest(1.0, v) p FROM r WHERE r = floor(0.98 * (n - 1)) + 1) SELECT id, round(0.25 + least(1.6, sqrt(v / p)) * CASE WHEN kind = 'file' THEN 3.5 ELSE 7.0 END, 6) AS height FROM l, p",
    "degree_rings": f"WITH {_DEG}, t AS (SELECT max(degree) top FROM dg) SELECT id, floor(degree / top * 5 + 0.5)::BIGINT AS ring, floor(degree / top * 100 + 0.5)::BIGINT AS percent FROM dg, t",
    "top_degrees": f"WITH {_DEG} SELECT id, degree, in_degree, out_degree FROM dg ORDER BY degree DESC, id LIMIT 12",
    "closed_neighborhood": f"WITH {_MODEL}, b AS (SELECT src a, dst b FROM m UNION SELECT dst, src FROM m), l0 AS (SELECT id root, id node FROM s WHERE id % 100 = 0), l1 AS (SELECT DISTINCT root, b.b node FROM l0 JOIN b ON b.a = node EXCEPT SELECT * FROM l0), l2 AS ((SELECT DISTINCT root, b.b node FROM l1 JOIN b ON b.a = node EXCEPT SELECT * FROM l0) EXCEPT SELECT * FROM l1) SELECT root, node, 0 AS hop FROM l0 UNION ALL SELECT root, node, 1 FROM l1 UNION ALL SELECT root, node, 2 FROM l2",
    "highlighted_nodes": f"WITH {_HE}, c AS (SELECT m.id, c.id c FROM s m JOIN s c ON c.kind = 'class' AND m.file_id = c.file_id AND m.start_byte >= c.start_byte AND m.end_byte <= c.end_byte WHERE m.kind IN {MEMBER} QUALIFY row_number() OVER (PARTITION BY m.id ORDER BY c.end_byte - c.start_byte, c.id) = 1) SELECT id FROM h UNION SELECT c FROM c WHERE id IN (SELECT id FROM h) UNION SELECT src FROM he UNION SELECT dst FROM he",
    "highlighted_edges": f"WITH {_HE} SELECT src, dst FROM he",
    "lookup": f"WITH s AS (SELECT s.id, s.name, lower(concat_ws(chr(10), s.name, s.kind, f.path)) t FROM {U_SYM} s LEFT JOIN {U_FILES} f ON f.id = s.file_id), q AS (SELECT id query_id, lower(name) q FROM s WHERE id % 100 = 0 AND name IS NOT NULL AND name <> '') SELECT query_id, id FROM q JOIN s ON contains(t, q) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY id) <= 30",
    "inspector": f"WITH {_FANS}, l AS (SELECT src id, 'out' direction, dst other, strength FROM m UNION ALL SELECT dst, 'in', src, strength FROM m) SELECT l.id, direction, other, round(strength, 6) AS strength, row_number() OVER (PARTITION BY l.id, direction ORDER BY strength DESC, coalesce(fan_in, 0) DESC, other) AS place FROM l LEFT JOIN fans ON fans.id = other QUALIFY place <= 40",
    "cross_file_edges": f"WITH {_MODEL} SELECT src, dst, a.file_id AS src_file, b.file_id AS dst_file FROM m JOIN s a ON a.id = src JOIN s b ON b.id = dst WHERE a.file_id <> b.file_id",
    "repositories": "WITH s AS (SELECT DISTINCT repo_id, version_id, regexp_replace(regexp_replace(replace(path, '\\', '/'), '/+', '/', 'g'), '^(\\./)+', '') p FROM manifest), c AS (SELECT repo_id, version_id, count(*) n FROM s GROUP BY ALL) SELECT repo_id, count(*) AS n_versions, max(version_id) AS newest, max_by(n, version_id) AS n_files FROM c GROUP BY repo_id",
    "full_graph": f"SELECT id, src_symbol_id, dst_symbol_id, kind, coalesce(resolution, 'heuristic') AS resolution FROM {U_EDGES} WHERE dst_symbol_id IS NOT NULL",
    "edge_kinds": f"SELECT kind, resolution, count(*) AS n, count(*) FILTER (dst_symbol_id IS NULL) AS n_unresolved FROM {U_EDGES} GROUP BY ALL",
}
