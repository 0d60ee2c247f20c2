"""Queries of the page models, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataline.operators import analytics as A
from strataline.operators import pages as P
from strataline.operators import relations as R
from strataline.plans.analytics_queries import _FANS
from strataline.plans.graph_queries import _MODEL, MEMBER
from strataline.plans.text_queries import U_EDGES, U_FILES, U_SYM
from strataline.sources.tables import unique


def _t(spark, d):
    return unique(spark, d, "edges"), unique(spark, d, "symbols"), unique(spark, d, "files")


def _shown(s):
    return s.where("kind in ('function', 'method', 'class')").select("id")


def line_members(spark, d):
    return P.line_members(unique(spark, d, "symbols", "file_id", "kind", "start_line", "end_line"))


def metric_callers(spark, d):
    e, s, _ = _t(spark, d)
    return P.metric(s, R.fan_counts(R.model_edges(e, s)), "callers")


def metric_callees(spark, d):
    e, s, _ = _t(spark, d)
    return P.metric(s, R.fan_counts(R.model_edges(e, s)), "callees")


def flat_nodes(spark, d):
    _, s, f = _t(spark, d)
    return P.flat_nodes(s, f)


def flat_edges(spark, d):
    return P.flat_edges(unique(spark, d, "edges"))


def radial_nodes(spark, d):
    e, s, f = _t(spark, d)
    return P.radial_nodes(s, f, e)


def radial_edges(spark, d):
    e, s, _ = _t(spark, d)
    return P.radial_edges(e, s)


def explored_links(spark, d):
    """Every edge touched within two steps of each symbol whose id is divisible by 100, with the number of times it is listed."""
    e, s, _ = _t(spark, d)
    links = P.explore(s.where("id % 100 = 0").select(F.col("id").alias("root")), e)[1]
    return links.groupBy("root", "edge_id").agg(F.count("*").alias("n"))


def explored_nodes(spark, d):
    e, s, _ = _t(spark, d)
    return P.explore(s.where("id % 100 = 0").select(F.col("id").alias("root")), e)[0].withColumn("hop", F.col("hop").cast("long"))


def clusters(spark, d):
    _, s, f = _t(spark, d)
    return P.clusters(s, f)


def overview_links(spark, d):
    """The strongest links between functions, methods and classes, as shown where nothing is selected."""
    e, s, _ = _t(spark, d)
    m = R.model_edges(e, s)
    return P.current_links(m, s, R.fan_counts(m), _shown(s)).select("src", "dst", "strength")


def selected_links(spark, d):
    """The links around each symbol whose id is divisible by 100."""
    e, s, _ = _t(spark, d)
    m = R.model_edges(e, s)
    return P.current_links(m, s, R.fan_counts(m), _shown(s), s.where("id % 100 = 0").select(F.col("id").alias("root")))


def visible_counts(spark, d):
    _, s, f = _t(spark, d)
    return P.visible_counts(s, f, _shown(s))


def by_edge_kind(spark, d):
    return P.by_edge_kind(unique(spark, d, "edges")).withColumn("place", F.col("place").cast("long"))


def value_lists(spark, d):
    e, s, f = _t(spark, d)
    return P.value_lists(s, f, e)


def city_weights(spark, d):
    """Entries of directories with their symbols, chains of directories joined."""
    _, s, f = _t(spark, d)
    return P.city_tree(s, f).where("file_id is not null").groupBy("repo_id").agg(F.count("*").alias("n_files"), F.sum("weight").alias("n_symbols"))


def city_blocks(spark, d):
    _, s, f = _t(spark, d)
    return P.city_blocks(s, P.city_plots(s, f)).select("id", *[F.round(c, 4).alias(c) for c in ("x", "y", "size")])


QUERIES = {
    f.__name__: f
    for f in (line_members, metric_callers, metric_callees, flat_nodes, flat_edges, radial_nodes, radial_edges, explored_links, explored_nodes, clusters, overview_links, selected_links, visible_counts, by_edge_kind, value_lists, city_weights, city_blocks)
}

_WALK = f"""e AS (SELECT id, src_symbol_id s, dst_symbol_id t FROM {U_EDGES} WHERE dst_symbol_id IS NOT NULL AND src_symbol_id IS NOT NULL), b AS (SELECT id, s a, t o FROM e UNION ALL SELECT id, t, s FROM e),
r AS (SELECT id root FROM {U_SYM} WHERE id % 100 = 0), l1 AS (SELECT root, b.id, o FROM r JOIN b ON a = root), n1 AS (SELECT DISTINCT root, o FROM l1 WHERE o <> root), l2 AS (SELECT root, b.id, b.o FROM n1 JOIN b ON a = n1.o)"""
_METRIC = "WITH {f}, y AS (SELECT {end} id, round(sum(strength), 6) v FROM m GROUP BY 1) SELECT s.id, coalesce(v, 0.0)::DOUBLE AS value FROM s LEFT JOIN y ON y.id = s.id"
SQL = {
    "line_members": f"SELECT c.id AS class_id, m.id AS member_id FROM {U_SYM} c JOIN {U_SYM} m ON m.file_id = c.file_id AND m.start_line >= c.start_line AND m.end_line <= c.end_line WHERE c.kind = 'class' AND m.kind IN {MEMBER}",
    "metric_callers": _METRIC.format(f=_MODEL, end="dst"),
    "metric_callees": _METRIC.format(f=_MODEL, end="src"),
    "flat_nodes": f"SELECT s.id, s.name AS label, s.kind, f.path, s.start_line, s.end_line FROM {U_SYM} s LEFT JOIN {U_FILES} f ON f.id = s.file_id",
    "flat_edges": f"SELECT id, src_symbol_id AS source, dst_symbol_id AS target, kind FROM {U_EDGES} WHERE dst_symbol_id IS NOT NULL",
    "radial_nodes": f"""WITH e AS (SELECT * FROM {U_EDGES} WHERE kind = 'calls' AND dst_symbol_id IS NOT NULL AND src_symbol_id IS NOT NULL), x AS (SELECT src_symbol_id id, 0 i, 1 o FROM e UNION ALL SELECT dst_symbol_id, 1, 0 FROM e), g AS (SELECT id, count(*) n, sum(i)::BIGINT i, sum(o)::BIGINT o FROM x GROUP BY 1),
c AS (SELECT m.id, k.name FROM {U_SYM} m JOIN {U_SYM} k ON k.file_id = m.file_id AND k.kind = 'class' AND k.start_line <= m.start_line AND k.end_line >= m.end_line WHERE m.kind = 'method' QUALIFY row_number() OVER (PARTITION BY m.id ORDER BY k.end_line - k.start_line, k.id) = 1)
SELECT s.id, s.name AS label, s.kind, f.path, s.file_id, c.name AS class_name, coalesce(g.n, 0) AS degree, coalesce(g.i, 0) AS in_degree, coalesce(g.o, 0) AS out_degree FROM {U_SYM} s JOIN {U_FILES} f ON f.id = s.file_id LEFT JOIN c ON c.id = s.id LEFT JOIN g ON g.id = s.id""",
    "radial_edges": f"SELECT e.id, e.src_symbol_id AS source, e.dst_symbol_id AS target, e.kind, a.file_id IS DISTINCT FROM b.file_id AS cross_file FROM {U_EDGES} e LEFT JOIN {U_SYM} a ON a.id = e.src_symbol_id LEFT JOIN {U_SYM} b ON b.id = e.dst_symbol_id WHERE e.dst_symbol_id IS NOT NULL",
    "explored_links": f"WITH {_WALK} SELECT root, id AS edge_id, count(*) AS n FROM (SELECT root, id FROM l1 UNION ALL SELECT root, id FROM l2) GROUP BY ALL",
    "explored_nodes": f"WITH {_WALK} SELECT root, node, min(h)::BIGINT AS hop FROM (SELECT root, root node, 0 h FROM r UNION ALL SELECT root, o, 1 FROM n1 UNION ALL SELECT root, o, 2 FROM l2) GROUP BY ALL",
    "clusters": f"""WITH n AS (SELECT s.id, f.id fid, coalesce(f.repo_id, '') r, f.path FROM {U_SYM} s JOIN {U_FILES} f ON f.id = s.file_id), p AS (SELECT r, fid, path, count(*) k FROM n GROUP BY ALL), q AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY path, fid) - 1 i, count(*) OVER (PARTITION BY r) nf, sum(k) OVER (PARTITION BY r) tot FROM p),
a AS (SELECT fid, (340 + sqrt(tot) * 90) * sqrt(CASE WHEN nf > 1 THEN i / (nf - 1) ELSE 0.0 END) rad, i * (pi() * (3 - sqrt(5))) th FROM q), z AS (SELECT id, fid, row_number() OVER (PARTITION BY fid ORDER BY id) - 1 j FROM n)
SELECT id, round(rad * cos(th) + 30.0 * sqrt(j + 1) * cos(j * (pi() * (3 - sqrt(5)))), 4) AS x, round(rad * sin(th) + 30.0 * sqrt(j + 1) * sin(j * (pi() * (3 - sqrt(5)))), 4) AS y FROM z JOIN a USING (fid)""",
    "overview_links": f"WITH {_FANS}, t AS (SELECT m.src, m.dst, round(m.strength, 6) AS strength, a.kind ka, b.kind kb FROM m JOIN s a ON a.id = m.src JOIN s b ON b.id = m.dst JOIN fans ON fans.id = m.dst WHERE a.file_id <> b.file_id AND m.strength >= 0.3 ORDER BY 3 DESC, fan_in DESC, 1, 2 LIMIT 200) SELECT src, dst, strength FROM t WHERE ka IN ('function', 'method', 'class') AND kb IN ('function', 'method', 'class')",
    "visible_counts": f"SELECT repo_id, count(*) AS n_nodes, count(*) FILTER (kind IN ('function', 'method', 'class')) AS n_visible, count(*) FILTER (kind NOT IN ('function', 'method', 'class')) AS n_filtered FROM {U_SYM} s JOIN {U_FILES} f ON f.id = s.file_id GROUP BY repo_id",
    "by_edge_kind": f"WITH e AS (SELECT * FROM {U_EDGES} WHERE dst_symbol_id IS NOT NULL AND src_symbol_id IS NOT NULL), x AS (SELECT id eid, src_symbol_id id, kind, 'out' direction, dst_symbol_id other FROM e UNION ALL SELECT id, dst_symbol_id, kind, 'in', src_symbol_id FROM e) SELECT id, kind, direction, other, row_number() OVER (PARTITION BY id, kind, direction ORDER BY eid) AS place FROM x",
    "value_lists": "SELECT 'symbol kind' AS list, kind AS value FROM symbols WHERE kind IS NOT NULL UNION SELECT 'extension', ext FROM files WHERE ext IS NOT NULL UNION SELECT 'edge kind', kind FROM edges WHERE kind IS NOT NULL",
    "city_weights": f"SELECT coalesce(repo_id, '') AS repo_id, count(DISTINCT f.id) AS n_files, count(*) AS n_symbols FROM {U_SYM} s JOIN {U_FILES} f ON f.id = s.file_id GROUP BY 1",
}
