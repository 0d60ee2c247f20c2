"""Queries of relations and of the call graph. Roots are the symbols whose id is divisible by 100; they walk the whole graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.operators import graph as G
from strataline.operators import relations as R
from strataline.plans.text_queries import U_EDGES, U_FILES, U_LIT, U_SYM
from strataline.sources.tables import unique


def _t(spark: SparkSession, d: str):
    return (unique(spark, d, "edges"), unique(spark, d, "symbols"), unique(spark, d, "files"), unique(spark, d, "string_literals"))


def _roots(symbols: DataFrame) -> DataFrame:
    return symbols.where("id % 100 = 0").select(F.col("id").alias("root"))


def name_fanout(spark, d):
    return R.name_fanout(unique(spark, d, "symbols", "name"))


def resolved_calls(spark, d):
    e, s, _, _ = _t(spark, d)
    calls = e.where("kind = 'calls' and dst_name is not null").select("src_symbol_id", "dst_name").join(s.select(F.col("id").alias("src_symbol_id"), "file_id", "name"), "src_symbol_id").select("file_id", F.col("name").alias("caller_name"), F.col("dst_name").alias("callee_name")).distinct()
    return R.resolve_calls(calls, s)


def class_members(spark, d):
    return R.class_members(unique(spark, d, "symbols")).select("class_id", "member_id", "name", "kind", F.col("pos").cast("long").alias("pos"))


def containers(spark, d):
    return R.containers(unique(spark, d, "symbols"))


def literal_lines(spark, d):
    """Each storage literal with the first symbol whose lines hold it."""
    _, s, _, lit = _t(spark, d)
    return R.at_line(lit.select(F.col("id").alias("loc_id"), "file_id", "line"), s)


def key_peers(spark, d):
    _, s, _, lit = _t(spark, d)
    roots = lit.where("symbol_id % 20 = 0").select(F.col("symbol_id").alias("root")).distinct()
    return R.key_peers(lit, roots.select("root", F.col("root").alias("node"))).select("root", "peer", "key").distinct()


def model_edges(spark, d):
    e, s, _, _ = _t(spark, d)
    return R.model_edges(e, s).withColumn("strength", F.round("strength", 6))


def fan_counts(spark, d):
    e, s, _, _ = _t(spark, d)
    return R.fan_counts(R.model_edges(e, s))


def callers(spark, d):
    e, s, _, lit = _t(spark, d)
    return G.callers(_roots(s), e, s, lit).select("root", "node", F.col("hops").cast("long").alias("hops"), "resolution", "relation", "confidence")


def callers_ranked(spark, d):
    e, s, f, lit = _t(spark, d)
    r = G.ranked(G.callers(_roots(s), e, s, lit))
    j = r.join(s.select(F.col("id").alias("node"), "name", "kind", "file_id", "start_line", "end_line"), "node").join(f.select(F.col("id").alias("file_id"), "path"), "file_id", "left")
    return j.select("root", "node", "name", "kind", "path", "start_line", "end_line", "relation", "hops", "resolution", "member", "confidence", "shared_key", "rank")


def callers_omitted(spark, d):
    e, s, _, lit = _t(spark, d)
    return G.omitted(G.callers(_roots(s), e, s, lit))


def tests_for_symbol(spark, d):
    e, s, f, _ = _t(spark, d)
    return G.tests_of(_roots(s), e, s, f).select("root", "node", F.col("hops").cast("long").alias("hops"), "confidence")


def expand(spark, d):
    e, s, _, lit = _t(spark, d)
    return G.expand(_roots(s), e, s, lit).select("root", "node", "relation", "via", "shared_key")


def expand_2_hops(spark, d):
    e, s, _, lit = _t(spark, d)
    return G.expand(_roots(s), e, s, lit, hops=2).select("root", "node", "relation", F.col("hops").cast("long").alias("hops"))


def check(spark, d):
    e, s, f, lit = _t(spark, d)
    return G.check(_roots(s), e, s, f, lit)


def neighborhood(spark, d):
    e, s, _, _ = _t(spark, d)
    m = R.model_edges(e, s)
    both = G.neighborhood(_roots(s), m, s).withColumn("direction", F.lit("callees")).unionByName(G.neighborhood(_roots(s), m, s, forward=False).withColumn("direction", F.lit("callers")))
    return both.withColumn("strength", F.round("strength", 6))


QUERIES = {f.__name__: f for f in (name_fanout, resolved_calls, class_members, containers, literal_lines, key_peers, model_edges, fan_counts, callers, callers_ranked, callers_omitted, tests_for_symbol, expand, expand_2_hops, check, neighborhood)}

MEMBER = "('method','function','hook')"
_BASE = f"""s AS (SELECT * FROM {U_SYM}), f AS (SELECT * FROM {U_FILES}), lit AS (SELECT * FROM {U_LIT}),
e AS (SELECT id, src_symbol_id src, dst_symbol_id dst, dst_name, resolution FROM {U_EDGES} WHERE kind = 'calls' AND src_symbol_id IN (SELECT id FROM s) AND dst_symbol_id IN (SELECT id FROM s)),
fan AS (SELECT name, count(*) n FROM s WHERE name IS NOT NULL GROUP BY name),
seeds AS (SELECT id root, id node, [0::BIGINT] k FROM s WHERE id % 100 = 0 UNION ALL SELECT c.id, m.id, [row_number() OVER (PARTITION BY c.id ORDER BY m.start_byte, m.id)] FROM s c JOIN s m ON m.file_id = c.file_id AND m.id <> c.id AND m.kind IN {MEMBER} AND m.start_byte >= c.start_byte AND m.end_byte <= c.end_byte WHERE c.kind = 'class' AND c.id % 100 = 0)"""


def _walk(hops: int, both: bool = False, stop: bool = False) -> str:
    steps = "SELECT dst a, src b, 1::BIGINT way, id, dst_name, resolution FROM e" + (" UNION ALL SELECT src, dst, 0::BIGINT, id, dst_name, resolution FROM e" if both else "")
    out = f", st AS ({steps}), w0 AS (SELECT root, node, k, 0 h, NULL::BIGINT via, 0::BIGINT way, NULL::VARCHAR dst_name, NULL::VARCHAR resolution FROM seeds), s0 AS (SELECT root, node FROM w0)"
    for h in range(1, hops + 1):
        ahead = f"w{h - 1}" if not stop or h == 1 else f"(SELECT * FROM w{h - 1} WHERE node NOT IN (SELECT s.id FROM s JOIN f ON f.id = s.file_id WHERE f.is_test))"
        out += f""", w{h} AS (SELECT root, node, x.k k, {h} h, x.via via, x.way way, x.dst_name dst_name, x.resolution resolution FROM (SELECT w.root, st.b node, min({{'k': list_concat(w.k, [st.way, st.id]), 'via': w.node, 'way': st.way, 'dst_name': st.dst_name, 'resolution': st.resolution}}) x FROM {ahead} w JOIN st ON st.a = w.node
 WHERE NOT EXISTS (SELECT 1 FROM s{h - 1} z WHERE z.root = w.root AND z.node = st.b) GROUP BY w.root, st.b)), s{h} AS (SELECT * FROM s{h - 1} UNION ALL SELECT root, node FROM w{h})"""
    return out + ", walked AS (" + " UNION ALL ".join(f"SELECT * FROM w{h}" for h in range(1, hops + 1)) + ")"


_CONF = ", conf AS (SELECT w.root, w.node, w.h hops, w.k, coalesce(w.resolution, 'heuristic') resolution, round(CASE WHEN w.resolution = 'lsp' THEN 1.0::DOUBLE ELSE 0.75::DOUBLE * CASE WHEN fan.n > 1 THEN 1 / sqrt(fan.n) ELSE 1.0::DOUBLE END END * pow(0.55::DOUBLE, w.h - 1), 3) confidence FROM walked w LEFT JOIN fan ON fan.name = w.dst_name)"
_PEERS = ", peers AS (SELECT DISTINCT d.root, l2.symbol_id node FROM seeds d JOIN lit l1 ON l1.symbol_id = d.node JOIN lit l2 ON l2.key = l1.key AND l2.symbol_id <> d.node WHERE l2.symbol_id IN (SELECT id FROM s) AND NOT EXISTS (SELECT 1 FROM seeds z WHERE z.root = d.root AND z.node = l2.symbol_id) AND NOT EXISTS (SELECT 1 FROM walked z WHERE z.root = d.root AND z.node = l2.symbol_id))"
_ALL = ", al AS (SELECT root, node, hops, resolution, 'caller' relation, confidence FROM conf UNION ALL SELECT root, node, 0, 'literal', 'shares-storage-key', 0.6::DOUBLE FROM peers)"
_MODEL = f"""s AS (SELECT * FROM {U_SYM}), fan AS (SELECT name, count(*) n FROM s WHERE name IS NOT NULL GROUP BY name),
m AS (SELECT p.src, p.dst, CASE WHEN p.lsp THEN 1.0::DOUBLE ELSE 0.75::DOUBLE / sqrt(greatest(1, coalesce(fan.n, 1))) END strength, p.lsp FROM (SELECT src_symbol_id src, dst_symbol_id dst, max(coalesce(resolution = 'lsp', false)) lsp FROM {U_EDGES} WHERE kind = 'calls' AND dst_symbol_id IS NOT NULL AND src_symbol_id <> dst_symbol_id GROUP BY ALL) p JOIN s a ON a.id = p.src JOIN s b ON b.id = p.dst LEFT JOIN fan ON fan.name = b.name)"""

SQL = {
    "name_fanout": f"SELECT name, count(*) AS n FROM {U_SYM} WHERE name IS NOT NULL GROUP BY name",
    "resolved_calls": f"""WITH s AS (SELECT * FROM {U_SYM}), c AS (SELECT DISTINCT s.file_id, s.name caller, e.dst_name callee FROM {U_EDGES} e JOIN s ON s.id = e.src_symbol_id WHERE e.kind = 'calls' AND e.dst_name IS NOT NULL),
f AS (SELECT file_id, name, min(id) id FROM s WHERE name IS NOT NULL GROUP BY ALL), t AS (SELECT id, name FROM s WHERE name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY id) <= 5)
SELECT f.id AS src_symbol_id, t.id AS dst_symbol_id, c.callee AS dst_name FROM c JOIN f ON f.file_id = c.file_id AND f.name = c.caller LEFT JOIN t ON t.name = c.callee""",
    "class_members": f"SELECT c.id AS class_id, m.id AS member_id, m.name, m.kind, row_number() OVER (PARTITION BY c.id ORDER BY m.start_byte, m.id) AS pos FROM {U_SYM} c JOIN {U_SYM} m ON m.file_id = c.file_id AND m.id <> c.id AND m.start_byte >= c.start_byte AND m.end_byte <= c.end_byte WHERE c.kind = 'class' AND m.kind IN {MEMBER}",
    "containers": f"SELECT m.id AS symbol_id, c.id AS class_id, coalesce(c.id, -m.file_id) AS container_id FROM {U_SYM} m LEFT JOIN {U_SYM} c ON c.kind = 'class' AND m.file_id = c.file_id AND m.start_byte >= c.start_byte AND m.end_byte <= c.end_byte WHERE m.kind IN {MEMBER} QUALIFY row_number() OVER (PARTITION BY m.id ORDER BY c.end_byte - c.start_byte, c.id) = 1",
    "literal_lines": f"SELECT l.id AS loc_id, min(s.id) AS symbol_id FROM {U_LIT} l JOIN {U_SYM} s ON s.file_id = l.file_id AND l.line BETWEEN s.start_line AND s.end_line GROUP BY l.id",
    "key_peers": f"SELECT DISTINCT a.symbol_id AS root, b.symbol_id AS peer, a.key FROM {U_LIT} a JOIN {U_LIT} b ON b.key = a.key AND b.symbol_id <> a.symbol_id WHERE a.symbol_id % 20 = 0",
    "model_edges": f"WITH {_MODEL} SELECT src, dst, round(strength, 6) AS strength, lsp FROM m",
    "fan_counts": f"WITH {_MODEL}, x AS (SELECT dst id, strength i, 0.0::DOUBLE o, 1 ri, 0 ro FROM m UNION ALL SELECT src, 0.0, strength, 0, 1 FROM m) SELECT id, round(sum(i), 6) AS fan_in, round(sum(o), 6) AS fan_out, sum(ri)::BIGINT AS raw_in, sum(ro)::BIGINT AS raw_out FROM x GROUP BY id",
    "callers": f"WITH {_BASE}{_walk(3)}{_CONF}{_PEERS}{_ALL} SELECT root, node, hops, resolution, relation, confidence FROM al",
    "callers_omitted": f"WITH {_BASE}{_walk(3)}{_CONF}{_PEERS}{_ALL} SELECT root, count(*) FILTER (confidence < 0.05) AS below_threshold, greatest(count(*) FILTER (confidence >= 0.05) - 25, 0) AS over_limit FROM al GROUP BY root",
    "tests_for_symbol": f"WITH {_BASE}{_walk(6, stop=True)}{_CONF} SELECT c.root, c.node, c.hops, c.confidence FROM conf c JOIN s ON s.id = c.node JOIN f ON f.id = s.file_id WHERE f.is_test",
    "expand_2_hops": f"WITH {_BASE}{_walk(2, both=True)}{_PEERS} SELECT root, node, CASE WHEN way = 0 THEN 'callee' ELSE 'caller' END AS relation, h AS hops FROM walked UNION ALL SELECT root, node, 'shares-storage-key', 0 FROM peers",
    "check": f"""WITH {_BASE}{_walk(3)}{_CONF}{_PEERS}{_ALL}, nc AS (SELECT root, least(25, count(*)) n FROM al WHERE confidence >= 0.05 GROUP BY root),
ts AS (WITH RECURSIVE one AS (SELECT 1) SELECT * FROM (WITH {_BASE}{_walk(6, stop=True)}{_CONF} SELECT c.root, least(25, count(*)) n, max(c.confidence) best FROM conf c JOIN s ON s.id = c.node JOIN f ON f.id = s.file_id WHERE f.is_test AND c.confidence >= 0.05 GROUP BY c.root)),
mb AS (SELECT root, count(*) - 1 n FROM seeds GROUP BY root)
SELECT r.id AS root, coalesce(nc.n, 0) AS n_callers, coalesce(ts.n, 0) AS n_tests, coalesce(ts.best, 0) AS best_test, CASE WHEN coalesce(ts.best, 0) >= 0.2 THEN 'covered' WHEN coalesce(ts.n, 0) > 0 THEN 'weakly-covered' ELSE 'untested' END AS risk, mb.n AS n_members FROM s r LEFT JOIN nc ON nc.root = r.id LEFT JOIN ts ON ts.root = r.id LEFT JOIN mb ON mb.root = r.id WHERE r.id % 100 = 0""",
    "expand": f"""WITH {_BASE}{_walk(1, both=True)}, p AS (SELECT d.root, l2.symbol_id node, min({{'k': d.k, 'key': l1.key, 'via': d.node}}) x FROM seeds d JOIN lit l1 ON l1.symbol_id = d.node JOIN lit l2 ON l2.key = l1.key AND l2.symbol_id <> d.node WHERE l2.symbol_id IN (SELECT id FROM s) AND NOT EXISTS (SELECT 1 FROM s1 z WHERE z.root = d.root AND z.node = l2.symbol_id) GROUP BY ALL)
SELECT root, node, CASE WHEN way = 0 THEN 'callee' ELSE 'caller' END AS relation, via, NULL AS shared_key FROM walked UNION ALL SELECT root, node, 'shares-storage-key', x.via, x.key FROM p""",
}


def _near(forward: bool) -> str:
    a, b = ("src", "dst") if forward else ("dst", "src")
    tag = "c" if forward else "i"
    return f""", {tag}1 AS (SELECT root, node, -x.n strength, x.src src, x.dst dst FROM (SELECT d.root, m.{b} node, min({{'n': -m.strength, 'src': m.src, 'dst': m.dst}}) x FROM seeds d JOIN m ON m.{a} = d.node AND m.strength >= 0.2 WHERE NOT EXISTS (SELECT 1 FROM seeds z WHERE z.root = d.root AND z.node = m.{b}) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY root ORDER BY x) <= 120),
{tag}2 AS (SELECT q.root, q.node, -q.x.n strength, q.x.src src, q.x.dst dst FROM (SELECT d.root, m.{b} node, min({{'n': -m.strength, 'src': m.src, 'dst': m.dst}}) x FROM {tag}1 d JOIN m ON m.{a} = d.node AND m.strength >= 0.2 WHERE NOT EXISTS (SELECT 1 FROM seeds z WHERE z.root = d.root AND z.node = m.{b}) AND NOT EXISTS (SELECT 1 FROM {tag}1 z WHERE z.root = d.root AND z.node = m.{b}) GROUP BY ALL) q QUALIFY row_number() OVER (PARTITION BY q.root ORDER BY q.x) + (SELECT count(*) FROM {tag}1 z WHERE z.root = q.root) <= 120)"""


_SEEDS = _BASE[_BASE.index("seeds AS") :]
SQL["neighborhood"] = f"WITH {_MODEL}, {_SEEDS}{_near(True)}{_near(False)} " + " UNION ALL ".join(f"SELECT root, node, {h} AS hop, src, dst, round(strength, 6) AS strength, '{w}' AS direction FROM {t}{h}" for t, w in (("c", "callees"), ("i", "callers")) for h in (1, 2))
