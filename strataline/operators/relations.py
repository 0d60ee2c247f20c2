"""Joins that resolve calls, containment, locations and shared keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MEMBER_KINDS = ["method", "function", "hook"]


def name_fanout(symbols: DataFrame) -> DataFrame:
    """(name, n): how many symbols share a name; null names have none."""
    return symbols.where("name is not null").groupBy("name").agg(F.count("*").alias("n"))


def resolve_calls(calls: DataFrame, symbols: DataFrame, most: int = 5) -> DataFrame:
    """Call edges: the caller is the first symbol of that name in the file, callees are the first most symbols of the called name anywhere.

    calls: (file_id, caller_name, callee_name). Calls of unknown callers are dropped, unknown callees give one row with null dst_symbol_id.
    The limit is the feature: a very common name would otherwise link everything with everything. It is found by a bounded aggregate, so a hot name is no hot
    task, and the callees of a name are one row when the calls meet them.
    """
    s = symbols.where("name is not null").select("id", "file_id", "name")
    first = s.groupBy("file_id", "name").agg(F.min("id").alias("src_symbol_id"))
    w = Window.partitionBy("name").orderBy("id")
    top = s.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).groupBy("name").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    c = calls.select("file_id", F.col("caller_name").alias("name"), "callee_name").join(first, ["file_id", "name"])
    j = c.join(top.withColumnRenamed("name", "callee_name"), "callee_name", "left")
    return j.select("src_symbol_id", F.explode_outer("ids").alias("dst_symbol_id"), F.col("callee_name").alias("dst_name"))


def class_members(symbols: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(class_id, member_id, name, kind, pos): methods, functions and hooks within a class by bytes, in order of start."""
    c = (classes if classes is not None else symbols).where("kind = 'class'").select(F.col("id").alias("class_id"), "file_id", F.col("start_byte").alias("cs"), F.col("end_byte").alias("ce"))
    m = symbols.where(F.col("kind").isin(MEMBER_KINDS)).select(F.col("id").alias("member_id"), "file_id", "name", "kind", "start_byte", "end_byte")
    j = c.join(m, "file_id").where("member_id != class_id and start_byte >= cs and end_byte <= ce")
    return j.select("class_id", "member_id", "name", "kind", F.row_number().over(Window.partitionBy("class_id").orderBy("start_byte", "member_id")).alias("pos"))


def containers(symbols: DataFrame) -> DataFrame:
    """(symbol_id, class_id, container_id): the smallest enclosing class by bytes, the first of equals; without one the file holds the symbol."""
    m = symbols.where(F.col("kind").isin(MEMBER_KINDS)).select(F.col("id").alias("symbol_id"), "file_id", F.col("start_byte").alias("s"), F.col("end_byte").alias("e"))
    c = symbols.where("kind = 'class'").select(F.col("file_id").alias("cf"), F.col("id").alias("class_id"), F.col("start_byte").alias("cs"), F.col("end_byte").alias("ce"))
    j = m.join(c, (F.col("file_id") == F.col("cf")) & (F.col("s") >= F.col("cs")) & (F.col("e") <= F.col("ce")), "left")
    best = j.groupBy("symbol_id", "file_id").agg(F.min(F.when(F.col("class_id").isNotNull(), F.struct(F.col("ce") - F.col("cs"), "class_id"))).alias("b"))
    return best.select("symbol_id", F.col("b.class_id").alias("class_id"), F.coalesce("b.class_id", -F.col("file_id")).alias("container_id"))


def at_line(locations: DataFrame, symbols: DataFrame) -> DataFrame:
    """(loc_id, symbol_id): the first symbol of the file whose lines hold the location; locations outside all symbols are dropped."""
    s = symbols.select(F.col("file_id"), F.col("id").alias("symbol_id"), "start_line", "end_line")
    j = locations.select("loc_id", "file_id", "line").join(s, "file_id").where("line >= start_line and line <= end_line")
    return j.groupBy("loc_id").agg(F.min("symbol_id").alias("symbol_id"))


def key_peers(literals: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, peer, key): other symbols that use a storage key of a root. roots: (root, node). Only roots' keys are joined, never all pairs of a frequent key."""
    own = roots.join(literals.select(F.col("symbol_id").alias("node"), "key").distinct(), "node").select("root", "node", "key").distinct()
    j = own.join(literals.select(F.col("symbol_id").alias("peer"), "key").distinct(), "key").where("peer != node")
    return j.select("root", "node", "peer", "key").distinct()


def model_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst, strength, lsp): one edge a pair, the strongest, self-calls and edges to unknown symbols dropped."""
    fan = name_fanout(symbols)
    s = symbols.select("id", "name")
    e = edges.where("kind = 'calls' and dst_symbol_id is not null and src_symbol_id != dst_symbol_id").select(F.col("src_symbol_id").alias("src"), F.col("dst_symbol_id").alias("dst"), (F.col("resolution") == "lsp").alias("lsp"))
    e = e.groupBy("src", "dst").agg(F.max(F.coalesce("lsp", F.lit(False))).alias("lsp"))
    e = e.join(s.select(F.col("id").alias("src")), "src", "left_semi").join(s.select(F.col("id").alias("dst"), "name"), "dst").join(fan, "name", "left")
    return e.select("src", "dst", F.when(F.col("lsp"), 1.0).otherwise(0.75 / F.sqrt(F.greatest(F.lit(1), F.coalesce("n", F.lit(1))).cast("double"))).alias("strength"), "lsp")


def fan_counts(model: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out, raw_in, raw_out) of symbols with an edge."""
    ends = model.select(F.explode(F.array(F.struct(F.col("dst").alias("id"), F.col("strength").alias("i"), F.lit(0.0).alias("o"), F.lit(1).alias("ri"), F.lit(0).alias("ro")), F.struct(F.col("src").alias("id"), F.lit(0.0).alias("i"), F.col("strength").alias("o"), F.lit(0).alias("ri"), F.lit(1).alias("ro")))).alias("x")).select("x.*")
    return ends.groupBy("id").agg(F.round(F.sum("i"), 6).alias("fan_in"), F.round(F.sum("o"), 6).alias("fan_out"), F.sum("ri").alias("raw_in"), F.sum("ro").alias("raw_out"))


def bind_literals(literals: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol_id, file_id, key, store, action, line): storage literals (file_id, scope, key, store, action, line) bound to the last symbol of that name in their file; others are dropped."""
    last = symbols.where("name is not null").groupBy("file_id", F.col("name").alias("scope")).agg(F.max_by("id", F.struct(F.coalesce("start_byte", F.lit(-1)), "id")).alias("symbol_id"))
    return literals.join(last, ["file_id", "scope"]).select("symbol_id", "file_id", "key", "store", "action", "line")


def precise_edges(resolved: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(src_symbol_id, dst_symbol_id, dst_name, kind, resolution) of what a language server resolved.

    resolved: (file_id, caller_name, callee_name, target_path, target_line), paths relative as in files (see relative_path). The caller is the first symbol of that name in its
    file, the target the first symbol of the target file whose lines hold the line; rows that lack either, or a known file, are dropped.
    """
    first = symbols.where("name is not null").groupBy("file_id", F.col("name").alias("caller_name")).agg(F.min("id").alias("src_symbol_id"))
    at = files.select(F.col("path").alias("target_path"), F.col("id").alias("t_file"))
    r = resolved.join(first, ["file_id", "caller_name"]).join(at, "target_path").select("src_symbol_id", F.col("callee_name").alias("dst_name"), "t_file", "target_line")
    places = r.select("t_file", "target_line").distinct()
    s = symbols.select(F.col("file_id").alias("t_file"), "id", "start_line", "end_line")
    hit = places.join(s, "t_file").where("start_line <= target_line and end_line >= target_line").groupBy("t_file", "target_line").agg(F.min("id").alias("dst_symbol_id"))
    return r.join(hit, ["t_file", "target_line"]).select("src_symbol_id", "dst_symbol_id", "dst_name", F.lit("calls").alias("kind"), F.lit("lsp").alias("resolution"))


def relative_path(uri, root):
    """The path of a file: URI below root, with forward slashes; null outside it and for anything else. Both are columns."""
    base = F.concat(F.regexp_replace(F.replace(root, F.lit("\\"), F.lit("/")), "/+$", ""), F.lit("/"))
    full = F.url_decode(F.replace(F.regexp_replace(uri, "^file://(?:localhost)?", ""), F.lit("+"), F.lit("%2B")))
    return F.when(uri.startswith("file://") & full.startswith(base) & ~full.contains("/../"), F.substring(full, F.length(base) + 1, F.length(full)))
