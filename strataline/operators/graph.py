"""Breadth-first walks of the call graph for many roots at once.

All roots walk in the same rounds: a round is one join of the frontier with the edges, one aggregation that keeps, per root and new node, the edge that
reaches it first, and one anti-join against what is known. Order is a key that grows with the path (parent's key, direction, edge id), compared as an
array, so that no window and no group of a root's whole frontier is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataline.functions.text import ambiguity
from strataline.operators.relations import class_members, key_peers, name_fanout
from strataline.session import materialize

HOP_DECAY, HEURISTIC, PEER = 0.55, 0.75, 0.6
MIN_CONFIDENCE, MOST = 0.05, 25


def seeds(roots: DataFrame, symbols: DataFrame) -> DataFrame:
    """(root, node, member, key): each root itself, and for a class its members too."""
    r = symbols.join(roots.select(F.col("root").alias("id")).distinct(), "id", "left_semi")
    own = r.select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(None).cast("string").alias("member"), F.array(F.lit(0).cast("long")).alias("key"))
    m = class_members(symbols, r).select(F.col("class_id").alias("root"), F.col("member_id").alias("node"), F.col("name").alias("member"), F.array(F.col("pos").cast("long")).alias("key"))
    return own.unionByName(m)


def walk(start: DataFrame, edges: DataFrame, symbols: DataFrame, hops: int, both: bool = False, stop: DataFrame | None = None) -> DataFrame:
    """(root, node, hops, key, via, member, relation, edge_dst_name, resolution) of every node reached from start, the first edge that reaches it deciding.

    both: callees before callers at each node, else callers only. stop: (node) that are reported but not walked through. Edges without an end, edges to symbols that don't
    exist and repeated edges make no difference; a root without edges reaches nothing.
    """
    e = edges.where("kind = 'calls' and src_symbol_id is not null and dst_symbol_id is not null").select("id", F.col("src_symbol_id").alias("src"), F.col("dst_symbol_id").alias("dst"), "dst_name", "resolution").dropDuplicates(["id"])
    known = symbols.select(F.col("id").alias("to"))
    e = e.join(known.withColumnRenamed("to", "src"), "src", "left_semi").join(known.withColumnRenamed("to", "dst"), "dst", "left_semi")
    steps = e.select(F.col("dst").alias("at"), F.col("src").alias("to"), F.lit(1).cast("long").alias("way"), "id", "dst_name", "resolution")
    if both:
        steps = steps.unionByName(e.select(F.col("src").alias("at"), F.col("dst").alias("to"), F.lit(0).cast("long").alias("way"), "id", "dst_name", "resolution"))
    steps, _ = materialize(steps, "steps")
    start, _ = materialize(start, "walk")
    frontier, seen, levels = start.select("root", "node", "member", "key"), start.select("root", "node"), []
    for h in range(1, hops + 1):
        c = frontier.join(steps, frontier["node"] == steps["at"]).select("root", F.col("to").alias("new"), F.struct(F.concat("key", F.array("way", "id")).alias("key"), F.col("node").alias("via"), "member", "way", "dst_name", "resolution").alias("x"))
        c = c.join(seen.withColumnRenamed("node", "new"), ["root", "new"], "left_anti").groupBy("root", "new").agg(F.min("x").alias("x"))
        level, _ = materialize(c.select("root", F.col("new").alias("node"), F.lit(h).alias("hops"), "x.key", "x.via", "x.member", F.when(F.col("x.way") == 0, "callee").otherwise("caller").alias("relation"), "x.dst_name", "x.resolution"), "walk")
        levels.append(level)
        if level.isEmpty():
            break
        seen = seen.unionByName(level.select("root", "node"))
        frontier = level.select("root", "node", "member", "key")
        if stop is not None:
            frontier = frontier.join(stop, "node", "left_anti")
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def confidence(walked: DataFrame, symbols: DataFrame) -> DataFrame:
    """walked with confidence: what a link is worth, less with each hop and for names that many symbols share."""
    fan = name_fanout(symbols).withColumnRenamed("name", "dst_name")
    j = walked.join(fan, "dst_name", "left")
    lsp = F.coalesce(F.col("resolution") == "lsp", F.lit(False))
    base = F.when(lsp, 1.0).otherwise(HEURISTIC)
    return j.withColumn("resolution", F.coalesce("resolution", F.lit("heuristic"))).withColumn("confidence", F.round(base * F.pow(F.lit(HOP_DECAY), F.col("hops") - 1) * F.when(lsp, 1.0).otherwise(ambiguity(F.coalesce("n", F.lit(1)))), 3)).drop("n")


def ranked(rows: DataFrame, most: int = MOST, least: float = MIN_CONFIDENCE) -> DataFrame:
    """The best most rows of each root (the limit is the feature; 0 means all), with rank."""
    out = rows.where(F.col("confidence") >= least).withColumn("rank", F.row_number().over(Window.partitionBy("root").orderBy(F.desc("confidence"), "hops", "key", "node")))
    return out.where(F.col("rank") <= most) if most > 0 else out


def omitted(rows: DataFrame, most: int = MOST, least: float = MIN_CONFIDENCE) -> DataFrame:
    """(root, below_threshold, over_limit)."""
    k = F.count_if(F.col("confidence") >= least)
    return rows.groupBy("root").agg(F.count_if(F.col("confidence") < least).alias("below_threshold"), F.greatest(k - most if most > 0 else F.lit(0), F.lit(0)).cast("long").alias("over_limit"))


def with_peers(walked: DataFrame, start: DataFrame, literals: DataFrame, symbols: DataFrame) -> DataFrame:
    """walked rows (with confidence) and the symbols that share a storage key with a seed, flat at hop 0, where they weren't reached by calls."""
    p = key_peers(literals, start.select("root", "node")).join(symbols.select(F.col("id").alias("peer")), "peer", "left_semi")
    p = p.join(start.select("root", "node", "member", "key").withColumnRenamed("key", "seed_key"), ["root", "node"]).groupBy("root", "peer").agg(F.min(F.struct("seed_key", "key", "node", "member")).alias("x"))
    p = p.join(walked.select("root", F.col("node").alias("peer")).unionByName(start.select("root", F.col("node").alias("peer"))), ["root", "peer"], "left_anti")
    p = p.select("root", F.col("peer").alias("node"), F.lit(0).alias("hops"), F.concat(F.array(F.lit(2**62)), "x.seed_key").alias("key"), F.col("x.node").alias("via"), F.col("x.member").alias("member"), F.lit("shares-storage-key").alias("relation"), F.lit(None).cast("string").alias("dst_name"), F.lit("literal").alias("resolution"), F.lit(PEER).alias("confidence"), F.col("x.key").alias("shared_key"))
    return walked.withColumn("shared_key", F.lit(None).cast("string")).unionByName(p)


def callers(roots: DataFrame, edges: DataFrame, symbols: DataFrame, literals: DataFrame, hops: int = 3) -> DataFrame:
    start = seeds(roots, symbols)
    return with_peers(confidence(walk(start, edges, symbols, hops), symbols), start, literals, symbols)


def tests_of(roots: DataFrame, edges: DataFrame, symbols: DataFrame, files: DataFrame, hops: int = 6) -> DataFrame:
    """Callers in test files; a test found is not walked through."""
    in_test = symbols.join(files.where("is_test").select(F.col("id").alias("file_id")), "file_id", "left_semi").select(F.col("id").alias("node"))
    w = walk(seeds(roots, symbols), edges, symbols, hops, stop=in_test)
    return confidence(w.join(in_test, "node", "left_semi"), symbols)


def expand(roots: DataFrame, edges: DataFrame, symbols: DataFrame, literals: DataFrame, hops: int = 1) -> DataFrame:
    """Callees, callers and storage-key peers around each root; roots that don't exist give no row."""
    start, _ = materialize(seeds(roots, symbols), "walk")  # the walk and the peers read it
    w = walk(start, edges, symbols, hops, both=True).withColumn("confidence", F.lit(0.0))
    return with_peers(w, start, literals, symbols).drop("confidence")


def check(roots: DataFrame, edges: DataFrame, symbols: DataFrame, files: DataFrame, literals: DataFrame, hops: int = 3, test_hops: int = 6) -> DataFrame:
    """(root, n_callers, n_tests, best_test, risk, n_members) of each root that exists: covered from 0.2 on, weakly-covered below, else untested."""
    r = symbols.join(roots.select(F.col("root").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("root"))
    c = ranked(callers(roots, edges, symbols, literals, hops)).groupBy("root").agg(F.count("*").alias("n_callers"))
    t = ranked(tests_of(roots, edges, symbols, files, test_hops)).groupBy("root").agg(F.count("*").alias("n_tests"), F.max("confidence").alias("best"))
    m = seeds(roots, symbols).groupBy("root").agg((F.count("*") - 1).alias("n_members"))
    j = r.join(c, "root", "left").join(t, "root", "left").join(m, "root", "left")
    best = F.coalesce("best", F.lit(0.0))
    return j.select("root", F.coalesce("n_callers", F.lit(0)).alias("n_callers"), F.coalesce("n_tests", F.lit(0)).alias("n_tests"), best.alias("best_test"), F.when(best >= 0.2, "covered").when(F.coalesce("n_tests", F.lit(0)) > 0, "weakly-covered").otherwise("untested").alias("risk"), "n_members")


def neighborhood(roots: DataFrame, model: DataFrame, symbols: DataFrame, hops: int = 2, least: float = 0.2, most: int = 120, forward: bool = True) -> DataFrame:
    """(root, node, hop, src, dst, strength): the strongest links first on each level, at most most links a root and direction over all levels.

    Between equally strong links the smaller (src, dst) comes first. The limit is the feature and keeps each root's frontier bounded.
    """
    start = seeds(roots, symbols).select("root", "node")
    m = model.where(F.col("strength") >= least)
    step = m.select(F.col("src" if forward else "dst").alias("at"), F.col("dst" if forward else "src").alias("to"), "src", "dst", "strength")
    seen, frontier, used, out = start, start, None, None
    for h in range(1, hops + 1):
        c = frontier.join(step, frontier["node"] == step["at"]).select("root", F.col("to").alias("node"), "src", "dst", "strength").join(seen, ["root", "node"], "left_anti")
        c = c.groupBy("root", "node").agg(F.min(F.struct((-F.col("strength")).alias("n"), "src", "dst")).alias("x"))
        c = c.withColumn("rn", F.row_number().over(Window.partitionBy("root").orderBy("x"))).where(F.col("rn") <= most)
        if used is not None:
            c = c.join(used, "root", "left").where(F.col("rn") + F.coalesce("used", F.lit(0)) <= most)
        level, _ = materialize(c.select("root", "node", F.lit(h).alias("hop"), "x.src", "x.dst", (-F.col("x.n")).alias("strength")), "near")
        out = level if out is None else out.unionByName(level)
        used = out.groupBy("root").agg(F.count("*").alias("used"))
        seen = seen.unionByName(level.select("root", "node"))
        frontier = level.select("root", "node")
    return out
