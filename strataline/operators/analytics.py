"""Measures over the graph model, layouts, version differences, snapshots and context bundles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataline.operators.relations import class_members, containers
from strataline.operators.snapshots import clean_path


def landmarks(fans: DataFrame, symbols: DataFrame, files: DataFrame, most: int = 20) -> DataFrame:
    """(id, name, fan_in, rank): the most depended-on symbols outside tests, each name once (a top-k report)."""
    j = fans.where("fan_in > 0").join(symbols.select("id", "name", "file_id"), "id").join(files.where("not is_test").select(F.col("id").alias("file_id")), "file_id", "left_semi")
    one = j.groupBy("name").agg(F.min(F.struct((-F.col("fan_in")).alias("n"), "id")).alias("x"))
    top = one.orderBy("x").limit(most)
    return top.select(F.col("x.id").alias("id"), "name", (-F.col("x.n")).alias("fan_in"), F.row_number().over(Window.orderBy("x")).alias("rank"))


def cross_file(model: DataFrame, symbols: DataFrame) -> DataFrame:
    """model edges whose ends lie in different files."""
    s = symbols.select("id", "file_id")
    return model.join(s.toDF("src", "src_file"), "src").join(s.toDF("dst", "dst_file"), "dst").where("src_file != dst_file")


def strongest_links(model: DataFrame, fans: DataFrame, symbols: DataFrame, most: int = 200, least: float = 0.3) -> DataFrame:
    """(src, dst, strength, fan_in): the strongest links between files (a top-k report)."""
    j = cross_file(model.where(F.col("strength") >= least), symbols).join(fans.select(F.col("id").alias("dst"), "fan_in"), "dst")
    return j.select("src", "dst", F.round("strength", 6).alias("strength"), "fan_in").orderBy(F.desc("strength"), F.desc("fan_in"), "src", "dst").limit(most)


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree, in_degree, out_degree) over all resolved calls, repeats of a link included."""
    e = edges.where("kind = 'calls' and src_symbol_id is not null and dst_symbol_id is not null")
    x = e.select(F.explode(F.array(F.struct(F.col("src_symbol_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst_symbol_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x")).select("x.*")
    return x.groupBy("id").agg(F.count("*").alias("degree"), F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def rolled_counts(model: DataFrame, symbols: DataFrame) -> DataFrame:
    """(class_id, callers, calls): distinct symbols outside a class that call into it or are called from it, members counted as the class."""
    own = symbols.where("kind = 'class'").select(F.col("id").alias("class_id"), F.col("id").alias("node")).unionByName(class_members(symbols).select("class_id", F.col("member_id").alias("node"))).distinct()
    ends = model.select(F.explode(F.array(F.struct(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit(True).alias("inward")), F.struct(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(False).alias("inward")))).alias("x")).select("x.*")
    j = own.join(ends, "node").join(own.select("class_id", F.col("node").alias("other")), ["class_id", "other"], "left_anti").select("class_id", "other", "inward").distinct()
    c = j.groupBy("class_id").agg(F.count_if("inward").alias("callers"), F.count_if(~F.col("inward")).alias("calls"))
    return symbols.where("kind = 'class'").select(F.col("id").alias("class_id")).join(c, "class_id", "left").na.fill(0, ["callers", "calls"])


def directory_weights(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, dir, n_symbols): symbols in each directory's subtree, the root directory as ''."""
    per = symbols.groupBy("file_id").agg(F.count("*").alias("n"))
    parts = F.split(clean_path(F.col("path")), "/")
    p = files.join(per, files["id"] == per["file_id"]).select("repo_id", "n", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i > 0, F.array_join(F.slice(parts, F.lit(1), i), "/")).otherwise(""))).alias("dir"))
    return p.groupBy("repo_id", "dir").agg(F.sum("n").alias("n_symbols"))


def lower_nearest(df: DataFrame, group: str, value: str, p: float) -> DataFrame:
    """(group, value): the sorted value at floor(p * (n - 1)), from counts of distinct values so that no group is sorted as a whole."""
    c = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(group).orderBy(value)
    n = F.sum("c").over(Window.partitionBy(group))
    return c.withColumn("upto", F.sum("c").over(w)).withColumn("at", F.floor(F.lit(p) * (n - 1)) + 1).where("upto >= at").groupBy(group).agg(F.min(value).alias(value))


def viewer_search(queries: DataFrame, symbols: DataFrame, files: DataFrame, fans: DataFrame, most: int = 30) -> DataFrame:
    """(query_id, id, score, rank) for questions (query_id, q): each word between blanks must match, exact, prefix, word start, in the name, in the path, and their scores add up
    (a repeated word counts again); popular symbols first among equals.

    The distinct words meet the distinct lower-case names and paths in blocks (a stated set of questions against all rows).
    """
    from strataline.functions.text import word_start

    q = queries.select("query_id", F.explode(F.split(F.lower("q"), r"\s+")).alias("q")).where("q != ''").groupBy("query_id", "q").agg(F.count("*").alias("times"))
    q = q.withColumn("n_words", F.count("*").over(Window.partitionBy("query_id")))
    words = q.select("q").distinct()
    names = symbols.select("name").distinct()
    n, t = F.lower("name"), F.col("q")
    score = F.when(n == t, 100).when(n.startswith(t), 80).when(word_start(F.col("name"), t), 60).when(n.contains(t), 40).otherwise(0)
    hit_name = words.join(names, n.contains(t)).select("q", "name", score.alias("s"))
    hit_path = words.join(files.select("id", F.lower("path").alias("p")), F.col("p").contains(t)).select("q", F.col("id").alias("file_id"))
    a = hit_name.join(symbols.select("id", "name"), "name").select("q", "id", "s")
    b = hit_path.join(symbols.select("id", "file_id"), "file_id").select("q", "id", F.lit(15).alias("s"))
    best = a.unionByName(b).groupBy("q", "id").agg(F.max("s").alias("s"))
    each = q.join(best, "q").groupBy("query_id", "n_words", "id").agg(F.sum(F.col("s") * F.col("times")).alias("s"), F.count("*").alias("matched")).where("matched = n_words")
    j = each.join(fans.select("id", "fan_in"), "id", "left").join(symbols.select("id", F.length("name").alias("len")), "id")
    j = j.withColumn("score", F.round(F.col("s") + F.log(1 + F.coalesce("fan_in", F.lit(0.0))), 6))
    return j.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "len", "id"))).where(F.col("rank") <= most).select("query_id", "id", "score", "rank")


def symbol_keys(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(id, repo_id, path, kind, name, nth): what identifies a symbol across builds; nth tells equal ones apart by order of id."""
    j = symbols.join(files.select(F.col("id").alias("file_id"), "repo_id", "path"), "file_id")
    return j.select("id", "repo_id", "path", "kind", "name", F.row_number().over(Window.partitionBy("repo_id", "path", "kind", "name").orderBy("id")).alias("nth"))


def diff_versions(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(repo_id, path, kind, name, nth, change) of two symbol_keys tables: added or removed."""
    key = ["repo_id", "path", "kind", "name", "nth"]
    return current.join(previous, key, "left_anti").select(*key, F.lit("added").alias("change")).unionByName(previous.join(current, key, "left_anti").select(*key, F.lit("removed").alias("change")))


def dense_index(symbols: DataFrame, parts: int = 64) -> DataFrame:
    """(id, idx): 0, 1, 2 ... in order of id without one global sort task: ranges are counted, then numbered within."""
    r = symbols.select("id").distinct().repartitionByRange(parts, "id").withColumn("part", F.spark_partition_id())
    base = r.groupBy("part").agg(F.count("*").alias("c"))
    base = base.withColumn("base", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # parts rows
    return r.join(F.broadcast(base), "part").select("id", (F.col("base") + F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1).alias("idx"))


def snapshot(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src_idx, dst_idx, res): resolved calls as dense indexes, 1 for precise edges."""
    i = dense_index(symbols)
    e = edges.where("kind = 'calls' and dst_symbol_id is not null").select("id", "src_symbol_id", "dst_symbol_id", F.when(F.col("resolution") == "lsp", 1).otherwise(0).alias("res"))
    return e.join(i.toDF("src_symbol_id", "src_idx"), "src_symbol_id").join(i.toDF("dst_symbol_id", "dst_idx"), "dst_symbol_id").select("id", "src_idx", "dst_idx", "res")


def treemap(items: DataFrame, width: float = 100.0, height: float = 100.0) -> DataFrame:
    """(parent, id, x, y, w, h): squarified rectangles of the children (parent, id, weight > 0) of each parent, areas in proportion.

    The layout is sequential within a parent, so a parent's children are one pandas group; its size is the number of entries of one directory.
    """

    def lay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["weight"] > 0].sort_values(["weight", "id"], ascending=[False, True])
        ids, total = pdf["id"].tolist(), float(pdf["weight"].sum())
        areas = [w * width * height / total for w in pdf["weight"]] if total else []
        out, x, y, w, h, i = [], 0.0, 0.0, width, height, 0
        while i < len(areas):
            side, row, worst = min(w, h), [areas[i]], math.inf
            j = i
            while True:
                s = sum(row)
                ratio = max(max(side * side * a / (s * s), s * s / (side * side * a)) for a in row) if side > 0 else math.inf
                if ratio > worst:
                    row.pop()
                    break
                worst, j = ratio, j + 1
                if j >= len(areas):
                    break
                row.append(areas[j])
            s = sum(row)
            thick = s / side if side else 0.0
            at = 0.0
            for k, a in enumerate(row):
                length = a / thick if thick else 0.0
                out.append((pdf["parent"].iat[0], ids[i + k], *((x, y + at, thick, length) if w >= h else (x + at, y, length, thick))))
                at += length
            x, y, w, h = (x + thick, y, w - thick, h) if w >= h else (x, y + thick, w, h - thick)
            i += len(row)
        return pd.DataFrame(out, columns=["parent", "id", "x", "y", "w", "h"])

    return items.groupBy("parent").applyInPandas(lay, "parent string, id string, x double, y double, w double, h double")


def sunflower(nodes: DataFrame, spacing: float = 10.0) -> DataFrame:
    """(id, x, y): (id, ring rank from 0) on a sunflower spiral."""
    a = F.col("rank") * (math.pi * (3 - math.sqrt(5)))
    r = spacing * F.sqrt(F.col("rank").cast("double"))
    return nodes.select("id", F.round(r * F.cos(a), 6).alias("x"), F.round(r * F.sin(a), 6).alias("y"))


def nested(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(symbol_id, class_id, file_id, path, depth): file, class and symbol containers; depth 2 within a class, else 1."""
    c = containers(symbols).join(symbols.select(F.col("id").alias("symbol_id"), "file_id"), "symbol_id").join(files.select(F.col("id").alias("file_id"), "path"), "file_id", "left")
    return c.select("symbol_id", "class_id", "file_id", "path", F.when(F.col("class_id").isNotNull(), 2).otherwise(1).alias("depth"))


def read_lines(items: DataFrame) -> DataFrame:
    """(id, slice): lines start..end of text, from 1; start below 1 counts as 1; null where end lies before start. items: (id, text, start, end)."""
    a = F.greatest(F.col("start"), F.lit(1))
    return items.select("id", F.when(F.col("end") >= a, F.array_join(F.slice(F.split("text", "\n"), a, F.col("end") - a + 1), "\n")).alias("slice"))


MAX_ITEMS, BUDGET = 60, 24_000


def bundle(items: DataFrame, budget: int = BUDGET, max_items: int = MAX_ITEMS) -> DataFrame:
    """(task_id, item_id, tier, place, with_code, with_signature, used): a greedy fill of each task's budget.

    items: (task_id, item_id, tier primary|hop1|hop2plus, pos, code_cost, meta_cost[, bare_cost: meta_cost without the signature]). The first max_items by tier and pos are considered (the cap is the feature, so each task's
    group is bounded). Code goes in while it fits, never for hop2plus; what comes too late or has none loses its code, once anything is cut neighbours lose their signature, once the budget is
    spent neighbours are dropped.
    """
    order = F.when(F.col("tier") == "primary", 0).when(F.col("tier") == "hop1", 1).otherwise(2)
    if "bare_cost" not in items.columns:
        items = items.withColumn("bare_cost", F.col("meta_cost"))
    top = items.withColumn("place", F.row_number().over(Window.partitionBy("task_id").orderBy(order, "pos", "item_id"))).where(F.col("place") <= max_items)
    arr = F.array_sort(F.collect_list(F.struct("place", "item_id", "tier", "code_cost", "meta_cost", "bare_cost")))
    g = top.groupBy("task_id").agg(arr.alias("items"))
    zero = F.expr("named_struct('used', 0L, 'cut', false, 'out', cast(array() as array<struct<place:int,item_id:bigint,tier:string,with_code:boolean,with_signature:boolean,used:bigint>>))")

    def step(a, x):
        primary = x["tier"] == "primary"
        drop = ~primary & (a["used"] >= budget)
        wants = x["tier"] != "hop2plus"
        fits = wants & x["code_cost"].isNotNull() & (a["used"] < budget) & (a["used"] + x["code_cost"] <= budget)
        code = F.coalesce(fits, F.lit(False))
        cut = a["cut"] | drop | (wants & ~code)
        signed = primary | ~cut
        used = F.when(drop, a["used"]).otherwise(a["used"] + F.when(code, x["code_cost"]).otherwise(0) + F.when(signed, x["meta_cost"]).otherwise(x["bare_cost"])).cast("long")
        row = F.struct(x["place"].alias("place"), x["item_id"].alias("item_id"), x["tier"].alias("tier"), code.alias("with_code"), signed.alias("with_signature"), used.alias("used"))
        return F.struct(used.alias("used"), cut.alias("cut"), F.when(drop, a["out"]).otherwise(F.concat(a["out"], F.array(row))).alias("out"))

    return g.select("task_id", F.explode(F.aggregate("items", zero, step)["out"]).alias("o")).select("task_id", "o.*")


def fold(items: list[tuple], budget: int = BUDGET) -> Iterator[tuple]:
    """The same fill for one task on the driver; items (tier, code_cost, meta_cost[, bare_cost]) in order, gives (index, with_code, with_signature, used). For tests."""
    used, cut = 0, False
    for i, (tier, code, meta, *bare) in enumerate(items):
        if tier != "primary" and used >= budget:
            cut = True
            continue
        wants = tier != "hop2plus"
        fits = wants and code is not None and used < budget and used + code <= budget
        cut = cut or (wants and not fits)
        signed = tier == "primary" or not cut
        used += (code if fits else 0) + (meta if signed or not bare else bare[0])
        yield i, fits, signed, used


def not_shown(items: DataFrame, shown: DataFrame) -> DataFrame:
    """items (path, start, end, ...) with seen: whether a range already shown (path, s, e) holds theirs whole."""
    hit = items.join(shown, "path").where("start >= s and end <= e").select("path", "start", "end").distinct().withColumn("seen", F.lit(True))
    return items.join(hit, ["path", "start", "end"], "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
