"""Queries of measures, layouts, versions and maintenance, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from strataline.operators import analytics as A
from strataline.operators import relations as R
from strataline.operators import snapshots as S
from strataline.operators.incremental import build_stats, diff_manifest, keep_versions, upsert
from strataline.plans.graph_queries import _MODEL, MEMBER
from strataline.plans.text_queries import U_CHUNKS, U_EDGES, U_FILES, U_SYM
from strataline.sources.tables import table, unique


def _m(spark, d):
    e, s = unique(spark, d, "edges"), unique(spark, d, "symbols")
    return e, s, unique(spark, d, "files"), R.model_edges(e, s)


def landmarks(spark, d):
    _, s, f, m = _m(spark, d)
    return A.landmarks(R.fan_counts(m), s, f).withColumn("rank", F.col("rank").cast("long"))


def strongest_links(spark, d):
    _, s, _, m = _m(spark, d)
    return A.strongest_links(m, R.fan_counts(m), s)


def degrees(spark, d):
    return A.degrees(unique(spark, d, "edges"))


def rolled_counts(spark, d):
    _, s, _, m = _m(spark, d)
    return A.rolled_counts(m, s)


def directory_weights(spark, d):
    return A.directory_weights(unique(spark, d, "symbols", "file_id"), unique(spark, d, "files", "path", "repo_id"))


def line_percentiles(spark, d):
    s = unique(spark, d, "symbols", "kind", "start_line", "end_line").select("kind", F.greatest(F.lit(1), F.col("end_line") - F.col("start_line") + 1).cast("long").alias("lines"))
    return A.lower_nearest(s, "kind", "lines", 0.98).withColumnRenamed("lines", "p98")


def viewer_search(spark, d):
    _, s, f, m = _m(spark, d)
    q = s.where("id % 100 = 0 and name is not null").select(F.col("id").alias("query_id"), F.col("name").alias("q"))
    return A.viewer_search(q, s, f, R.fan_counts(m)).withColumn("rank", F.col("rank").cast("long"))


def occurrence_keys(spark, d):
    return A.symbol_keys(unique(spark, d, "symbols", "file_id", "kind", "name"), unique(spark, d, "files", "repo_id", "path")).withColumn("nth", F.col("nth").cast("long"))


def version_diff(spark, d):
    """Symbols of the current index against one without the files whose id is divisible by ten."""
    s, f = unique(spark, d, "symbols", "file_id", "kind", "name"), unique(spark, d, "files", "repo_id", "path")
    return A.diff_versions(A.symbol_keys(s, f), A.symbol_keys(s.where("file_id % 10 != 0"), f)).withColumn("nth", F.col("nth").cast("long"))


def dense_index(spark, d):
    return A.dense_index(unique(spark, d, "symbols", "id"))


def graph_snapshot(spark, d):
    return A.snapshot(unique(spark, d, "edges"), unique(spark, d, "symbols", "id"))


def snapshot_counts(spark, d):
    f = unique(spark, d, "files", "repo_id").groupBy("repo_id").agg(F.count("*").alias("n_files"))
    s = unique(spark, d, "symbols", "file_id").join(unique(spark, d, "files", "repo_id").withColumnRenamed("id", "file_id"), "file_id").groupBy("repo_id").agg(F.count("*").alias("n_symbols"))
    return f.join(s, "repo_id", "left").select("repo_id", "n_files", F.coalesce("n_symbols", F.lit(0)).alias("n_symbols"))


def directory_treemap(spark, d):
    """Top-level directories of each repository as rectangles."""
    w = A.directory_weights(unique(spark, d, "symbols", "file_id"), unique(spark, d, "files", "path", "repo_id")).where("dir != '' and dir not like '%/%'")
    return A.treemap(w.select(F.coalesce("repo_id", F.lit("")).alias("parent"), F.col("dir").alias("id"), F.col("n_symbols").alias("weight"))).select("parent", "id", *[F.round(c, 4).alias(c) for c in "xywh"])


def treemap_areas(spark, d):
    t = directory_treemap(spark, d)
    return t.groupBy("parent").agg(F.round(F.sum(F.col("w") * F.col("h")), 0).alias("area"), F.count("*").alias("n"))


def galaxy(spark, d):
    """Files of each repository on a spiral in order of id."""
    f = unique(spark, d, "files", "repo_id").withColumn("rank", F.row_number().over(Window.partitionBy("repo_id").orderBy("id")) - 1)
    return A.sunflower(f.select("id", "rank"))


def nested_containers(spark, d):
    return A.nested(unique(spark, d, "symbols"), unique(spark, d, "files")).withColumn("depth", F.col("depth").cast("long"))


def symbol_slices(spark, d):
    """The lines of each symbol read from its file's text; null where the symbol ends beyond the text that is stored of the file."""
    s = unique(spark, d, "symbols", "file_id", "kind", "start_line", "end_line")
    whole = s.where("kind = 'file'").select("file_id", F.col("id").alias("symbol_id")).join(unique(spark, d, "chunks", "code"), "symbol_id").select("file_id", F.col("code").alias("text"))
    j = s.join(whole, "file_id").withColumn("text", F.when((F.length("text") < 20_000) | (F.size(F.split("text", "\n")) > F.col("end_line")), F.col("text")))
    return A.read_lines(j.select("id", "text", F.col("start_line").alias("start"), F.col("end_line").alias("end"))).select("id", F.length("slice").cast("long").alias("n"), F.md5("slice").alias("md5"))


def context_bundles(spark, d):
    """Each class as the one hit of its task: itself, its members, what they call and who calls them, filled into the budget."""
    from strataline.operators import context as C

    e, s, f, _ = _m(spark, d)
    hits = s.where("kind = 'class'").select(F.col("id").alias("task_id"), F.col("id").alias("symbol_id"), F.lit(1.0).alias("score"), F.lit(1).alias("place"))
    items, _ = C.assemble(hits, s, f, unique(spark, d, "chunks", "code"), e, unique(spark, d, "string_literals"))
    return items.select("task_id", F.col("place").cast("long").alias("place"), "tier", "symbol_id", (F.col("code").isNotNull()).alias("with_code"), F.col("signature").isNotNull().alias("with_signature"), "relation", "via")


def manifest_diff(spark, d):
    """What a build has to do against the one before: every file of the newest build of each repository."""
    m = S.latest(table(spark, d, "manifest"))
    last = m.groupBy("repo_id").agg(F.max("version_id").alias("version_id"))
    cur = m.join(last, ["repo_id", "version_id"], "left_semi")
    prev_id = m.join(last.withColumnRenamed("version_id", "last"), "repo_id").where("version_id < last").groupBy("repo_id").agg(F.max("version_id").alias("version_id"))
    return diff_manifest(cur, m.join(prev_id, ["repo_id", "version_id"], "left_semi"))


def manifest_stats(spark, d):
    return build_stats(manifest_diff(spark, d))


def kept_versions(spark, d):
    return keep_versions(table(spark, d, "manifest").select("repo_id", "version_id").distinct())


def upserted_symbols(spark, d):
    """Symbols after the files with even id are replaced by versions without their tests: cascade and upsert in one step."""
    s = unique(spark, d, "symbols", "file_id", "kind", "name")
    return upsert(s, s.where("file_id % 2 = 0 and kind not in ('test', 'suite')"), s.where("file_id % 2 = 0").select("file_id").distinct(), "file_id").select("id", "file_id", "kind", "name")


def neighbour_kinds(spark, d):
    """Distinct neighbours of each symbol by kind and direction."""
    _, s, _, m = _m(spark, d)
    ends = m.select(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit("out").alias("direction")).unionByName(m.select(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit("in").alias("direction")))
    return ends.join(s.select(F.col("id").alias("other"), "kind"), "other").groupBy("id", "direction", "kind").agg(F.count("*").alias("n"))


def visible_graph(spark, d):
    """Edges both of whose ends are shown: functions and methods with two links or more."""
    _, s, _, m = _m(spark, d)
    deg = R.fan_counts(m).where("raw_in + raw_out >= 2").join(s.where("kind in ('function', 'method')").select("id"), "id", "left_semi").select("id")
    return m.join(deg.toDF("src"), "src", "left_semi").join(deg.toDF("dst"), "dst", "left_semi").select("src", "dst", F.round("strength", 6).alias("strength"))


QUERIES = {
    f.__name__: f
    for f in (landmarks, strongest_links, degrees, rolled_counts, directory_weights, line_percentiles, viewer_search, occurrence_keys, version_diff, dense_index, graph_snapshot, snapshot_counts, directory_treemap, treemap_areas, galaxy, nested_containers, symbol_slices, context_bundles, manifest_diff, manifest_stats, kept_versions, upserted_symbols, neighbour_kinds, visible_graph)
}

_FANS = f"{_MODEL}, x AS (SELECT dst id, strength i, 1 r FROM m UNION ALL SELECT src, 0.0, 1 FROM m), fans AS (SELECT id, round(sum(i), 6) fan_in, sum(r) deg FROM x GROUP BY id)"
_CLEAN = "regexp_replace(regexp_replace(replace(path, '\\', '/'), '/+', '/', 'g'), '^(\\./)+', '')"
_KEYS = "SELECT s.id, f.repo_id, f.path, s.kind, s.name, row_number() OVER (PARTITION BY f.repo_id, f.path, s.kind, s.name ORDER BY s.id) AS nth FROM {s} s JOIN {f} f ON f.id = s.file_id"
_LATEST = f"s AS (SELECT repo_id, version_id, path, h FROM (SELECT repo_id, version_id, {_CLEAN} path, lower(hash) h, coalesce(mtime, -1e300) m FROM manifest) QUALIFY row_number() OVER (PARTITION BY repo_id, version_id, path ORDER BY m DESC, h DESC) = 1)"
_MDIFF = f"""{_LATEST}, l AS (SELECT repo_id, max(version_id) v FROM s GROUP BY 1), p AS (SELECT s.repo_id, max(version_id) v FROM s JOIN l USING (repo_id) WHERE version_id < l.v GROUP BY 1),
c AS (SELECT s.repo_id, path, h, 1 k FROM s JOIN l ON l.repo_id = s.repo_id AND l.v = version_id), o AS (SELECT s.repo_id, path, h, 1 k FROM s JOIN p ON p.repo_id = s.repo_id AND p.v = version_id),
dm AS (SELECT repo_id, path, CASE WHEN o.k IS NULL THEN 'added' WHEN c.k IS NULL THEN 'deleted' WHEN c.h IS NOT DISTINCT FROM o.h THEN 'unchanged' ELSE 'changed' END status FROM c FULL JOIN o USING (repo_id, path))"""
SQL = {
    "landmarks": f"WITH {_FANS}, r AS (SELECT fans.id, s.name, fan_in FROM fans JOIN s ON s.id = fans.id JOIN {U_FILES} f ON f.id = s.file_id WHERE fan_in > 0 AND NOT f.is_test QUALIFY row_number() OVER (PARTITION BY s.name ORDER BY fan_in DESC, fans.id) = 1) SELECT *, row_number() OVER (ORDER BY fan_in DESC, id) AS rank FROM r QUALIFY rank <= 20",
    "strongest_links": f"WITH {_FANS} SELECT m.src, m.dst, round(m.strength, 6) AS strength, fan_in FROM m JOIN s a ON a.id = m.src JOIN s b ON b.id = m.dst JOIN fans ON fans.id = m.dst WHERE a.file_id <> b.file_id AND m.strength >= 0.3 ORDER BY 3 DESC, 4 DESC, 1, 2 LIMIT 200",
    "degrees": f"WITH e AS (SELECT * FROM {U_EDGES} WHERE kind = 'calls' AND src_symbol_id IS NOT NULL AND dst_symbol_id IS NOT NULL), x AS (SELECT src_symbol_id id, 0 i, 1 o FROM e UNION ALL SELECT dst_symbol_id, 1, 0 FROM e) SELECT id, count(*) AS degree, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM x GROUP BY id",
    "rolled_counts": f"WITH {_MODEL}, own AS (SELECT id c, id node FROM s WHERE kind = 'class' UNION SELECT c.id, m.id FROM s c JOIN s m ON m.file_id = c.file_id AND m.id <> c.id AND m.kind IN {MEMBER} AND m.start_byte >= c.start_byte AND m.end_byte <= c.end_byte WHERE c.kind = 'class'), x AS (SELECT c, m.src o, 1 i FROM own JOIN m ON m.dst = node UNION SELECT c, m.dst, 0 FROM own JOIN m ON m.src = node), y AS (SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.c = x.c AND own.node = x.o)) SELECT s.id AS class_id, count(*) FILTER (i = 1) AS callers, count(*) FILTER (i = 0) AS calls FROM s LEFT JOIN y ON y.c = s.id WHERE s.kind = 'class' GROUP BY s.id",
    "directory_weights": f"WITH p AS (SELECT repo_id, string_split({_CLEAN}, '/') q, n FROM {U_FILES} f JOIN (SELECT file_id, count(*) n FROM {U_SYM} GROUP BY 1) c ON c.file_id = f.id), x AS (SELECT repo_id, n, q, unnest(range(0, len(q))) i FROM p) SELECT repo_id, CASE WHEN i > 0 THEN array_to_string(q[1:i], '/') ELSE '' END AS dir, sum(n)::BIGINT AS n_symbols FROM x GROUP BY ALL",
    "line_percentiles": f"WITH l AS (SELECT kind, greatest(1, end_line - start_line + 1)::BIGINT v, row_number() OVER (PARTITION BY kind ORDER BY greatest(1, end_line - start_line + 1)) r, count(*) OVER (PARTITION BY kind) n FROM {U_SYM} WHERE end_line IS NOT NULL AND start_line IS NOT NULL) SELECT kind, v AS p98 FROM l WHERE r = floor(0.98 * (n - 1)) + 1",
    "viewer_search": f"""WITH {_FANS}, qw AS (SELECT id query_id, unnest(string_split_regex(lower(name), '\\s+')) q FROM s WHERE id % 100 = 0 AND name IS NOT NULL), q AS (SELECT query_id, q, count(*) times FROM qw WHERE q <> '' GROUP BY ALL), nq AS (SELECT query_id, count(*) nw FROM q GROUP BY 1),
w AS (SELECT s.id, lower(s.name) n, length(s.name) len, lower(f.path) p, string_split_regex(lower(regexp_replace(regexp_replace(s.name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^a-z0-9]+') ws FROM s LEFT JOIN {U_FILES} f ON f.id = s.file_id),
u AS (SELECT DISTINCT q FROM q), j AS (SELECT q, w.id, len, CASE WHEN n = q THEN 100 WHEN starts_with(n, q) THEN 80 WHEN len(list_filter(ws, lambda z: starts_with(z, q))) > 0 THEN 60 WHEN contains(n, q) THEN 40 WHEN contains(p, q) THEN 15 ELSE 0 END sc FROM u, w),
a AS (SELECT query_id, id, len, sum(sc * times) sc FROM q JOIN j USING (q) JOIN nq USING (query_id) WHERE sc > 0 GROUP BY query_id, id, len, nw HAVING count(*) = nw), k AS (SELECT a.*, round(sc + ln(1 + coalesce(fan_in, 0)), 6) score FROM a LEFT JOIN fans ON fans.id = a.id)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, len, id) AS rank FROM k QUALIFY rank <= 30""",
    "occurrence_keys": _KEYS.format(s=U_SYM, f=U_FILES),
    "version_diff": f"WITH c AS ({_KEYS.format(s=U_SYM, f=U_FILES)}), p AS ({_KEYS.format(s='(SELECT * FROM ' + U_SYM + ' WHERE file_id % 10 <> 0)', f=U_FILES)}) SELECT c.repo_id, c.path, c.kind, c.name, c.nth, 'added' AS change FROM c ANTI JOIN p ON c.repo_id = p.repo_id AND c.path = p.path AND c.kind = p.kind AND c.name = p.name AND c.nth = p.nth UNION ALL SELECT p.repo_id, p.path, p.kind, p.name, p.nth, 'removed' FROM p ANTI JOIN c ON c.repo_id = p.repo_id AND c.path = p.path AND c.kind = p.kind AND c.name = p.name AND c.nth = p.nth",
    "dense_index": f"SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM {U_SYM}",
    "graph_snapshot": f"WITH i AS (SELECT id, row_number() OVER (ORDER BY id) - 1 idx FROM {U_SYM}) SELECT e.id, a.idx AS src_idx, b.idx AS dst_idx, CASE WHEN resolution = 'lsp' THEN 1 ELSE 0 END AS res FROM {U_EDGES} e JOIN i a ON a.id = src_symbol_id JOIN i b ON b.id = dst_symbol_id WHERE kind = 'calls'",
    "snapshot_counts": f"SELECT repo_id, count(DISTINCT f.id) AS n_files, count(s.id) AS n_symbols FROM {U_FILES} f LEFT JOIN {U_SYM} s ON s.file_id = f.id GROUP BY repo_id",
    "treemap_areas": f"WITH p AS (SELECT DISTINCT repo_id, string_split({_CLEAN}, '/')[1] d FROM {U_FILES} f WHERE contains({_CLEAN}, '/') AND EXISTS (SELECT 1 FROM symbols s WHERE s.file_id = f.id)) SELECT repo_id AS parent, 10000.0::DOUBLE AS area, count(*) AS n FROM p GROUP BY 1",
    "galaxy": f"WITH r AS (SELECT id, row_number() OVER (PARTITION BY repo_id ORDER BY id) - 1 k FROM {U_FILES}) SELECT id, round(10.0 * sqrt(k) * cos(k * (pi() * (3 - sqrt(5)))), 6) AS x, round(10.0 * sqrt(k) * sin(k * (pi() * (3 - sqrt(5)))), 6) AS y FROM r",
    "nested_containers": f"SELECT m.id AS symbol_id, c.id AS class_id, m.file_id, f.path, CASE WHEN c.id IS NULL THEN 1 ELSE 2 END AS depth FROM {U_SYM} m LEFT JOIN {U_SYM} c ON c.kind = 'class' AND m.file_id = c.file_id AND m.start_byte >= c.start_byte AND m.end_byte <= c.end_byte LEFT JOIN {U_FILES} f ON f.id = m.file_id WHERE m.kind IN {MEMBER} QUALIFY row_number() OVER (PARTITION BY m.id ORDER BY c.end_byte - c.start_byte, c.id) = 1",
    "symbol_slices": f"WITH w AS (SELECT s.file_id, c.code FROM {U_SYM} s JOIN {U_CHUNKS} c ON c.symbol_id = s.id WHERE s.kind = 'file'), x AS (SELECT s.id, CASE WHEN s.end_line >= greatest(s.start_line, 1) AND (length(w.code) < 20000 OR len(string_split(w.code, chr(10))) > s.end_line) THEN array_to_string(string_split(w.code, chr(10))[greatest(s.start_line, 1):s.end_line], chr(10)) END t FROM {U_SYM} s JOIN w USING (file_id)) SELECT id, length(t) AS n, md5(t) AS md5 FROM x",
    "manifest_diff": f"WITH {_MDIFF} SELECT repo_id, path, status FROM dm",
    "manifest_stats": f"WITH {_MDIFF} SELECT repo_id, count(*) FILTER (status <> 'deleted') AS n_total, count(*) FILTER (status = 'changed') AS n_changed, count(*) FILTER (status = 'added') AS n_added, count(*) FILTER (status = 'unchanged') AS n_unchanged, count(*) FILTER (status = 'deleted') AS n_deleted FROM dm GROUP BY repo_id",
    "kept_versions": "SELECT repo_id, version_id, row_number() OVER (PARTITION BY repo_id ORDER BY version_id DESC) <= 2 AS kept FROM (SELECT DISTINCT repo_id, version_id FROM manifest)",
    "upserted_symbols": f"SELECT id, file_id, kind, name FROM {U_SYM} WHERE file_id % 2 <> 0 OR kind NOT IN ('test', 'suite')",
    "neighbour_kinds": f"WITH {_MODEL}, x AS (SELECT src id, dst o, 'out' d FROM m UNION ALL SELECT dst, src, 'in' FROM m) SELECT x.id, d AS direction, s.kind, count(*) AS n FROM x JOIN s ON s.id = x.o GROUP BY ALL",
    "visible_graph": f"WITH {_FANS}, v AS (SELECT fans.id FROM fans JOIN s ON s.id = fans.id WHERE deg >= 2 AND kind IN ('function', 'method')) SELECT src, dst, round(strength, 6) AS strength FROM m WHERE src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v)",
}
