"""Context bundles for many tasks at once: search hits re-ranked, their neighbours, a budget spent in order, notes.

Everything per task is bounded by the number of its hits and by max_items; symbols' texts are joined only for what has come through that cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.functions.text import context_weight
from strataline.operators.analytics import BUDGET, MAX_ITEMS, bundle
from strataline.operators.graph import expand
from strataline.session import materialize

# What a bundle says about what it left out.
OMITTED, DROPPED = " lower-priority neighbors omitted (item cap reached)", " lower-priority neighbors dropped (char budget exhausted)"


def json_cost(c: Column) -> Column:
    """The number of characters of a text once it is a JSON string; null stays null."""
    return F.when(c.isNotNull(), F.length(F.to_json(F.struct(c.alias("t")))) - len('{"t":}'))


def reranked(hits: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(task_id, symbol_id, score, pos): hits (task_id, symbol_id, score, place) by score times what their kind and file are worth in a bundle, equals in the order of place."""
    f = symbols.select(F.col("id").alias("symbol_id"), "kind", "file_id").join(files.select(F.col("id").alias("file_id"), "path"), "file_id", "left")
    j = hits.join(f, "symbol_id").withColumn("w", F.round(F.col("score") * context_weight(F.col("kind"), F.col("path")), 9))
    return j.select("task_id", "symbol_id", "score", (F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("w"), "place", "symbol_id")) - 1).alias("pos"))


def candidates(primary: DataFrame, edges: DataFrame, symbols: DataFrame, literals: DataFrame, hops: int = 1) -> DataFrame:
    """(task_id, item_id, tier, pos, score, relation, via): reranked hits and each other symbol around them once, with the first hit that reaches it.

    Neighbours of the best hit are hop1, those of the others hop2plus. Each distinct hit is expanded once, whatever the number of tasks it belongs to.
    """
    near = expand(primary.select(F.col("symbol_id").alias("root")).distinct(), edges, symbols, literals, hops)
    n = primary.select("task_id", F.col("symbol_id").alias("root"), F.col("pos").alias("rank")).join(near.select("root", "node", "hops", "key", "relation"), "root")
    n = n.join(primary.select("task_id", F.col("symbol_id").alias("node")), ["task_id", "node"], "left_anti")
    # peers by a shared key (hop 0) come after those reached by calls
    n = n.groupBy("task_id", "node").agg(F.min(F.struct("rank", F.when(F.col("hops") > 0, F.col("hops")).otherwise(F.lit(1 << 30)).alias("h"), "key", "root", "relation")).alias("x"))
    n = n.withColumn("pos", F.row_number().over(Window.partitionBy("task_id").orderBy("x", "node")))
    n = n.select("task_id", F.col("node").alias("item_id"), F.when(F.col("x.rank") == 0, "hop1").otherwise("hop2plus").alias("tier"), F.col("pos").cast("long"), F.lit(None).cast("double").alias("score"), F.col("x.relation").alias("relation"), F.col("x.root").alias("via"))
    p = primary.select("task_id", F.col("symbol_id").alias("item_id"), F.lit("primary").alias("tier"), F.col("pos").cast("long"), F.col("score").cast("double"), F.lit(None).cast("string").alias("relation"), F.lit(None).cast("long").alias("via"))
    return p.unionByName(n)


def assemble(hits: DataFrame, symbols: DataFrame, files: DataFrame, chunks: DataFrame, edges: DataFrame, literals: DataFrame, hops: int = 1, budget: int = BUDGET, max_items: int = MAX_ITEMS) -> tuple[DataFrame, DataFrame]:
    """(items, summaries) of the bundles of all tasks. hits: (task_id, symbol_id, score, place), for instance of fusion.search.

    items: (task_id, place, tier, symbol_id, name, kind, path, start_line, end_line, signature, code, score, relation, via), signature and code null where the budget left
    them out; repeats of a chunk make no difference. summaries: (task_id, limit_chars, used_chars, truncated, files_touched, notes); used_chars counts the bundle's items as JSON. The texts are the symbols' own
    chunks. Hits of unknown symbols are left out; a task without hits gives no row.
    """
    order = F.when(F.col("tier") == "primary", 0).when(F.col("tier") == "hop1", 1).otherwise(2)
    # hits are a search's plan that several steps would run again; a few rows a task
    primary, _ = materialize(reranked(hits, symbols, files), "context")
    every, _ = materialize(candidates(primary, edges, symbols, literals, hops), "context")
    first = every.withColumn("n", F.row_number().over(Window.partitionBy("task_id").orderBy(order, "pos", "item_id"))).where(F.col("n") <= max_items).drop("n")
    facts = symbols.select(F.col("id").alias("item_id"), "name", "kind", "file_id", "start_line", "end_line", "signature").join(files.select(F.col("id").alias("file_id"), "path"), "file_id", "left")
    costs = chunks.select(F.col("symbol_id").alias("item_id"), json_cost(F.col("code")).cast("long").alias("code_cost")).dropDuplicates(["item_id"])
    j = first.join(facts, "item_id").join(costs, "item_id", "left").withColumn("code_cost", F.when(F.col("path").isNotNull(), F.col("code_cost")))
    common = [F.col("item_id").alias("symbolId"), "name", "kind", "path", F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine")]

    def cost(signature: Column) -> Column:
        tail = [F.lit(None).cast("string").alias("code")]
        with_score = F.struct(*common, signature.alias("signature"), *tail, "score")
        with_via = F.struct(*common, signature.alias("signature"), *tail, "relation", "via")
        keep = {"ignoreNullFields": "false"}
        return F.when(F.col("tier") == "primary", F.length(F.to_json(with_score, keep))).otherwise(F.length(F.to_json(with_via, keep))).cast("long")

    j = j.withColumn("meta_cost", cost(F.col("signature"))).withColumn("bare_cost", cost(F.lit(None).cast("string")))
    j, _ = materialize(j, "context")  # tasks x max_items rows
    filled = bundle(j.select("task_id", "item_id", "tier", "pos", "code_cost", "meta_cost", "bare_cost"), budget, max_items)
    out = filled.select("task_id", "item_id", "place", "with_code", "with_signature", "used").join(j, ["task_id", "item_id"])
    items = out.select("task_id", F.col("place").cast("int").alias("place"), "tier", F.col("item_id").alias("symbol_id"), "name", "kind", "path", "start_line", "end_line", F.when(F.col("with_signature"), F.col("signature")).alias("signature"), "with_code", "score", "relation", "via", "used")
    items, _ = materialize(items, "context")
    n_all = every.groupBy("task_id").agg(F.count("*").alias("n_all"))
    n_cut = j.groupBy("task_id").agg(F.count("*").alias("n_cut"), F.count_if((F.col("tier") != "hop2plus")).alias("n_wanting"))
    touched = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("path").isNotNull(), F.struct("place", "path")))), lambda x: x["path"]))
    shown = items.groupBy("task_id").agg(F.max("used").alias("used_chars"), F.count("*").alias("n_shown"), F.count_if("with_code").alias("n_code"), touched.alias("files_touched"))
    s = n_all.join(n_cut, "task_id").join(shown, "task_id")
    over, dropped = F.col("n_all") - F.col("n_cut"), F.col("n_cut") - F.col("n_shown")
    notes = F.filter(F.array(F.when(over > 0, F.concat(over.cast("string"), F.lit(OMITTED))), F.when(dropped > 0, F.concat(dropped.cast("string"), F.lit(DROPPED)))), lambda x: x.isNotNull())
    summaries = s.select("task_id", F.lit(budget).alias("limit_chars"), "used_chars", ((dropped > 0) | (F.col("n_code") < F.col("n_wanting"))).alias("truncated"), "files_touched", notes.alias("notes"))
    text = chunks.select("symbol_id", "code").dropDuplicates(["symbol_id"])  # read only where the items are
    full = items.join(text, "symbol_id", "left").select("task_id", "place", "tier", "symbol_id", "name", "kind", "path", "start_line", "end_line", "signature", F.when(F.col("with_code"), F.col("code")).alias("code"), "score", "relation", "via")
    return full, summaries


def answer(items: DataFrame, summaries: DataFrame, tasks: DataFrame) -> DataFrame:
    """(task_id, bundle): one JSON text a task: task, budget, primary, neighbors, filesTouched, notes. tasks: (task_id, text). A bundle is bounded by its budget and its items."""
    own = [F.col("symbol_id").alias("symbolId"), "name", "kind", "path", F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine"), "signature", "code"]
    at = items.groupBy("task_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("tier") == "primary", F.struct("place", F.struct(*own, "score").alias("x"))))), lambda v: v["x"]).alias("primary"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("tier") != "primary", F.struct("place", F.struct(*own, "relation", "via").alias("x"))))), lambda v: v["x"]).alias("neighbors"),
    )
    j = tasks.join(at, "task_id").join(summaries, "task_id")
    body = F.struct(F.col("text").alias("task"), F.struct(F.col("limit_chars").alias("limitChars"), F.col("used_chars").alias("usedChars"), "truncated").alias("budget"), "primary", "neighbors", F.col("files_touched").alias("filesTouched"), "notes")
    return j.select("task_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("bundle"))
