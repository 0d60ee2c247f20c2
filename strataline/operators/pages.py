"""Models and layouts behind the pages over a graph: nodes and links as they are drawn, walks by hand, the city of directories, files and symbols."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataline.operators.analytics import degrees, strongest_links
from strataline.operators.graph import neighborhood
from strataline.operators.relations import MEMBER_KINDS
from strataline.operators.snapshots import clean_path
from strataline.session import materialize

GOLDEN = math.pi * (3 - math.sqrt(5))


def line_members(symbols: DataFrame) -> DataFrame:
    """(class_id, member_id): methods, functions and hooks within a class by lines of its file. Null lines hold nothing and are held by nothing."""
    c = symbols.where("kind = 'class'").select(F.col("id").alias("class_id"), "file_id", F.col("start_line").alias("a"), F.col("end_line").alias("b"))
    m = symbols.where(F.col("kind").isin(MEMBER_KINDS)).select(F.col("id").alias("member_id"), "file_id", "start_line", "end_line")
    return c.join(m, "file_id").where("start_line >= a and end_line <= b").select("class_id", "member_id")


def metric(symbols: DataFrame, fans: DataFrame, mode: str = "lines") -> DataFrame:
    """(id, value): what a block's height stands for: lines (at least 1), callers (weighted fan-in) or callees (weighted fan-out)."""
    if mode not in ("lines", "callers", "callees"):
        raise ValueError(f"unknown mode {mode}")
    if mode == "lines":
        return symbols.select("id", F.greatest(F.lit(1), F.col("end_line") - F.col("start_line") + 1).cast("double").alias("value"))
    f = fans.select("id", F.col("fan_in" if mode == "callers" else "fan_out").alias("value"))
    return symbols.select("id").join(f, "id", "left").select("id", F.coalesce("value", F.lit(0.0)).alias("value"))


def flat_nodes(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(id, label, kind, path, start_line, end_line) of every symbol; path is null where its file is unknown."""
    f = files.select(F.col("id").alias("file_id"), "path")
    return symbols.join(f, "file_id", "left").select("id", F.col("name").alias("label"), "kind", "path", "start_line", "end_line")


def flat_edges(edges: DataFrame) -> DataFrame:
    """(id, source, target, kind) of resolved edges."""
    return edges.where("dst_symbol_id is not null").select("id", F.col("src_symbol_id").alias("source"), F.col("dst_symbol_id").alias("target"), "kind")


def radial_nodes(symbols: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label, kind, path, file_id, class_name, degree, in_degree, out_degree) of symbols of known files; the class of a method is the smallest that holds its lines, the first of equals."""
    c = symbols.where("kind = 'class'").select(F.col("file_id"), F.col("id").alias("c_id"), F.col("name").alias("c_name"), F.col("start_line").alias("a"), F.col("end_line").alias("b"))
    m = symbols.where("kind = 'method'").select("id", "file_id", "start_line", "end_line")
    own = m.join(c, "file_id").where("a <= start_line and b >= end_line and c_id != id").groupBy("id").agg(F.min(F.struct(F.col("b") - F.col("a"), "c_id", "c_name")).alias("c")).select("id", F.col("c.c_name").alias("class_name"))
    n = symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").join(own, "id", "left").join(degrees(edges), "id", "left")
    return n.select("id", F.col("name").alias("label"), "kind", "path", "file_id", "class_name", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("degree", "in_degree", "out_degree")])


def radial_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, source, target, kind, cross_file) of resolved edges; an end without a file counts as elsewhere, two such ends as the same."""
    s = symbols.select("id", "file_id")
    e = flat_edges(edges).join(s.toDF("source", "fa"), "source", "left").join(s.toDF("target", "fb"), "target", "left")
    return e.select("id", "source", "target", "kind", (~F.col("fa").eqNullSafe(F.col("fb"))).alias("cross_file"))


def explore(roots: DataFrame, edges: DataFrame, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes (root, node, hop), links (root, edge_id, at, hop)): the walk in both directions with every edge it touches; an edge is listed once for each end it is touched from."""
    e = edges.where("dst_symbol_id is not null and src_symbol_id is not null")
    both = e.select(F.col("id").alias("edge_id"), F.col("src_symbol_id").alias("at"), F.col("dst_symbol_id").alias("to")).unionByName(e.select(F.col("id").alias("edge_id"), F.col("dst_symbol_id").alias("at"), F.col("src_symbol_id").alias("to")))
    level = roots.select("root", F.col("root").alias("node")).distinct()
    seen, links = level.withColumn("hop", F.lit(0)), None
    for h in range(1, hops + 1):
        step, _ = materialize(level.join(both, level["node"] == both["at"]).select("root", "edge_id", "at", "to"), "explore")
        now = step.select("root", "edge_id", "at", F.lit(h).alias("hop"))
        links = now if links is None else links.unionByName(now)
        level, _ = materialize(step.select("root", F.col("to").alias("node")).distinct().join(seen.select("root", "node"), ["root", "node"], "left_anti"), "explore")
        seen = seen.unionByName(level.withColumn("hop", F.lit(h)))
    return seen, links if links is not None else seen.select("root", F.col("node").alias("edge_id"), F.col("node").alias("at"), "hop").limit(0)


def clusters(symbols: DataFrame, files: DataFrame, gap: float = 30.0) -> DataFrame:
    """(id, x, y): symbols on a sunflower around their file, the files of a repository on a spiral that fills a disc grown with the number of its symbols; files in order of path, symbols of id."""
    n = symbols.join(files.select(F.col("id").alias("file_id"), "repo_id", "path"), "file_id").select("id", "file_id", F.coalesce("repo_id", F.lit("")).alias("repo_id"), "path")
    per = n.groupBy("repo_id", "file_id", "path").agg(F.count("*").alias("k"))
    w = Window.partitionBy("repo_id")
    f = per.withColumn("i", F.row_number().over(w.orderBy("path", "file_id")) - 1).withColumn("n_files", F.count("*").over(w)).withColumn("total", F.sum("k").over(w))
    t = F.when(F.col("n_files") > 1, F.col("i") / (F.col("n_files") - 1)).otherwise(0.0)
    r = (340 + F.sqrt("total") * 90) * F.sqrt(t)
    f = f.select("file_id", (r * F.cos(F.col("i") * GOLDEN)).alias("ax"), (r * F.sin(F.col("i") * GOLDEN)).alias("ay"))
    s = n.withColumn("j", F.row_number().over(Window.partitionBy("file_id").orderBy("id")) - 1).join(f, "file_id")
    rr = gap * F.sqrt(F.col("j") + 1)
    return s.select("id", F.round(F.col("ax") + rr * F.cos(F.col("j") * GOLDEN), 4).alias("x"), F.round(F.col("ay") + rr * F.sin(F.col("j") * GOLDEN), 4).alias("y"))


def current_links(model: DataFrame, symbols: DataFrame, fans: DataFrame, visible: DataFrame, selected: DataFrame | None = None, hops: int = 2, least: float = 0.2, top: int = 200) -> DataFrame:
    """(root, src, dst, strength, hop, type): around the selected symbols (root) their links in and out, without a selection the strongest links of all; both ends must be visible (id)."""
    if selected is not None:
        parts = [neighborhood(selected, model, symbols, hops, least, forward=f).select("root", "src", "dst", "strength", "hop", F.lit("out" if f else "in").alias("type")) for f in (True, False)]
        links = parts[0].unionByName(parts[1])
    else:
        links = strongest_links(model, fans, symbols, top, max(least, 0.3)).select(F.lit(None).cast("long").alias("root"), "src", "dst", "strength", F.lit(1).alias("hop"), F.lit("top").alias("type"))
    v = visible.select("id").distinct()
    return links.join(v.toDF("src"), "src", "left_semi").join(v.toDF("dst"), "dst", "left_semi").select("root", "src", "dst", "strength", "hop", "type")


def visible_counts(symbols: DataFrame, files: DataFrame, visible: DataFrame) -> DataFrame:
    """(repo_id, n_nodes, n_visible, n_filtered): what a filter leaves of each repository."""
    n = symbols.join(files.select(F.col("id").alias("file_id"), "repo_id"), "file_id").join(visible.select("id").distinct().withColumn("v", F.lit(True)), "id", "left")
    return n.groupBy("repo_id").agg(F.count("*").alias("n_nodes"), F.count("v").alias("n_visible"), (F.count("*") - F.count("v")).alias("n_filtered"))


def by_edge_kind(edges: DataFrame) -> DataFrame:
    """(id, kind, direction, other, place): each symbol's resolved edges by kind and direction in order of edge id; rows instead of lists, as one symbol may hold any number."""
    e = edges.where("dst_symbol_id is not null and src_symbol_id is not null")
    x = e.select("id", F.col("src_symbol_id").alias("sym"), "kind", F.lit("out").alias("direction"), F.col("dst_symbol_id").alias("other")).unionByName(e.select("id", F.col("dst_symbol_id").alias("sym"), "kind", F.lit("in").alias("direction"), F.col("src_symbol_id").alias("other")))
    return x.select(F.col("sym").alias("id"), "kind", "direction", "other", F.row_number().over(Window.partitionBy("sym", "kind", "direction").orderBy("id")).alias("place"))


def value_lists(symbols: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """(list, value): the distinct symbol kinds, file extensions and edge kinds to choose from, nulls left out."""
    parts = [(symbols, "kind", "symbol kind"), (files, "ext", "extension"), (edges, "kind", "edge kind")]
    out = [t.where(F.col(c).isNotNull()).select(F.lit(n).alias("list"), F.col(c).alias("value")) for t, c, n in parts]
    return out[0].unionByName(out[1]).unionByName(out[2]).distinct()


def removed_symbols(diff: DataFrame, most: int = 30) -> DataFrame:
    """diff_versions rows that went, the first most of each repository by path, kind, name (the list's length)."""
    gone = diff.where("change = 'removed'")
    return gone.withColumn("place", F.row_number().over(Window.partitionBy("repo_id").orderBy("path", "kind", "name", "nth"))).where(F.col("place") <= most).drop("change")


def squarify(weights: list[float], x: float, y: float, w: float, h: float) -> list[tuple[float, float, float, float]]:
    """Rectangles (x, y, w, h) with areas in proportion to weights, which come greatest first, as near to squares as a row at a time allows."""
    total = sum(weights)
    areas = [a * w * h / total for a in weights] if total else []
    out: list[tuple[float, float, float, float]] = []
    i = 0
    while i < len(areas):
        side = max(min(w, h), 1e-12)
        s, low, high, worst, j = 0.0, math.inf, 0.0, math.inf, i
        while j < len(areas):
            s2, low2, high2 = s + areas[j], min(low, areas[j]), max(high, areas[j])
            ratio = max(side * side * high2 / (s2 * s2), s2 * s2 / (side * side * max(low2, 1e-300)))
            if ratio > worst:
                break
            s, low, high, worst, j = s2, low2, high2, ratio, j + 1
        thick, at = s / side, 0.0
        for a in areas[i:j]:
            length = a / thick if thick else 0.0
            out.append((x, y + at, thick, length) if w >= h else (x + at, y, length, thick))
            at += length
        x, y, w, h = (x + thick, y, w - thick, h) if w >= h else (x, y + thick, w, h - thick)
        i = j
    return out


def city_tree(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, parent, name, dir, file_id, weight): the entries of each directory with their number of symbols.

    A directory whose only entry is one directory is joined with it (a/b/c). parent and dir are paths, '' the root; dir is null for a file, file_id for a directory.
    """
    per = symbols.groupBy("file_id").agg(F.count("*").alias("weight"))
    parts = F.filter(F.split(clean_path(F.col("path")), "/"), lambda p: p != "")
    f = files.join(per, files["id"] == per["file_id"]).select(F.coalesce("repo_id", F.lit("")).alias("repo_id"), "file_id", parts.alias("p"), "weight")

    def up(n):
        return F.array_join(F.slice("p", F.lit(1), n), "/")

    dirs = f.select("repo_id", "weight", "p", F.explode(F.when(F.size("p") > 1, F.sequence(F.lit(1), F.size("p") - 1)).otherwise(F.array().cast("array<int>"))).alias("n")).select("repo_id", up(F.col("n")).alias("dir"), up(F.col("n") - 1).alias("parent"), "weight")
    dirs = dirs.groupBy("repo_id", "dir", "parent").agg(F.sum("weight").alias("weight"))
    own = f.select("repo_id", up(F.greatest(F.lit(0), F.size("p") - 1)).alias("parent"), F.element_at("p", -1).alias("name"), "file_id", "weight")
    # a directory below the root that holds one directory and no file vanishes into it
    inside = dirs.select("repo_id", "parent", F.lit(1).alias("d"), F.lit(0).alias("f")).unionByName(own.select("repo_id", "parent", F.lit(0).alias("d"), F.lit(1).alias("f"))).groupBy("repo_id", "parent").agg(F.sum("d").alias("d"), F.sum("f").alias("f"))
    thin = inside.where("parent != '' and d = 1 and f = 0").select("repo_id", F.col("parent").alias("dir"))
    kept = dirs.join(thin, ["repo_id", "dir"], "left_anti").select("repo_id", "dir", "weight")
    # the parent of what is kept is its longest kept prefix
    names = kept.select("repo_id", "dir", "weight", F.split("dir", "/").alias("q"))
    pre = names.select("repo_id", "dir", "weight", F.explode(F.sequence(F.lit(0), F.size("q") - 1)).alias("n"), "q").select("repo_id", "dir", "weight", F.array_join(F.slice("q", F.lit(1), F.col("n")), "/").alias("parent"))
    known = kept.select("repo_id", F.col("dir").alias("parent")).unionByName(kept.select("repo_id", F.lit("").alias("parent"))).distinct()
    best = pre.join(known, ["repo_id", "parent"]).groupBy("repo_id", "dir", "weight").agg(F.max_by("parent", F.length("parent")).alias("parent"))
    d = best.select("repo_id", "parent", F.expr("if(parent = '', dir, substring(dir, length(parent) + 2))").alias("name"), "dir", F.lit(None).cast("long").alias("file_id"), "weight")
    return d.unionByName(own.select("repo_id", "parent", "name", F.lit(None).cast("string").alias("dir"), "file_id", "weight"))


PLOTS = "repo_id string, parent string, name string, dir string, file_id long, weight long, x double, y double, w double, h double, depth int"


def city_plots(symbols: DataFrame, files: DataFrame, cell: float = 1.0) -> DataFrame:
    """city_tree rows with their rectangle (x, y, w, h) and depth, each repository centred on 0, 0, its area in proportion to its symbols, 3 wide to 2 deep.

    Directories are laid out level by level, each within its parent's rectangle less a margin; a directory's entries are one group, so no more than the entries of
    one directory meet in a task.
    """
    tree, _ = materialize(city_tree(symbols, files), "city")
    pad = cell * 0.45
    area = F.sum("weight") * (cell * cell * 1.7)
    rect = tree.where("parent = ''").groupBy("repo_id").agg(F.sqrt(area * 1.5).alias("W"), area.alias("area")).select("repo_id", F.lit("").alias("parent"), (-F.col("W") / 2).alias("px"), (-F.col("area") / F.col("W") / 2).alias("py"), F.col("W").alias("pw"), (F.col("area") / F.col("W")).alias("ph"))
    out, depth = None, 0

    def lay(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["weight", "name"], ascending=[False, True])
        r = t.iloc[0]
        boxes = squarify([float(v) for v in t["weight"]], r.px + pad, r.py + pad, max(r.pw - 2 * pad, 0.01), max(r.ph - 2 * pad, 0.01))
        t[["x", "y", "w", "h"]] = boxes
        return t[[c.split(" ")[0] for c in PLOTS.split(", ")]]

    while depth == 0 or not rect.isEmpty():
        depth += 1
        level = tree.join(rect, ["repo_id", "parent"]).withColumn("depth", F.lit(depth)).groupBy("repo_id", "parent").applyInPandas(lay, PLOTS)
        level, _ = materialize(level, "city")
        out = level if out is None else out.unionByName(level)
        rect = level.where("dir is not null").select("repo_id", F.col("dir").alias("parent"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("w").alias("pw"), F.col("h").alias("ph"))
    return out


def city_blocks(symbols: DataFrame, plots: DataFrame, cell: float = 1.0) -> DataFrame:
    """(id, x, y, size): each symbol's block in the grid of its file's plot, in order of line; expressions only, whatever the number of a file's symbols."""
    p = plots.where("file_id is not null").select("file_id", "x", "y", "w", "h", F.col("weight").alias("n"))
    gap = F.least(F.lit(cell * 0.225), F.col("w") * 0.12, F.col("h") * 0.12)
    p = p.select("file_id", "n", (F.col("x") + gap).alias("x"), (F.col("y") + gap).alias("y"), F.greatest(F.col("w") - gap * 2, F.lit(cell * 0.2)).alias("w"), F.greatest(F.col("h") - gap * 2, F.lit(cell * 0.2)).alias("h"))
    p = p.withColumn("cols", F.greatest(F.lit(1), F.least(F.col("n"), F.floor(F.sqrt(F.col("n") * F.col("w") / F.col("h")) + 0.5))))
    p = p.withColumn("rows", F.ceil(F.col("n") / F.col("cols"))).withColumn("cs", F.least(F.col("w") / F.col("cols"), F.col("h") / F.col("rows")))
    s = symbols.select("id", "file_id", "start_line").withColumn("k", F.row_number().over(Window.partitionBy("file_id").orderBy("start_line", "id")) - 1).join(p, "file_id")
    x = F.col("x") + (F.col("w") - F.col("cs") * F.col("cols")) / 2 + (F.col("k") % F.col("cols") + 0.5) * F.col("cs")
    y = F.col("y") + (F.col("h") - F.col("cs") * F.col("rows")) / 2 + (F.floor(F.col("k") / F.col("cols")) + 0.5) * F.col("cs")
    return s.select("id", x.alias("x"), y.alias("y"), (F.col("cs") * 0.74).alias("size"))
