"""Parent-child links to full hierarchies by leaf peeling, with chains contracted so that depth doesn't set the number of rounds.

Each round works on the nodes that are left:

* rake: a node without children left is peeled and hands its subtree size to its parent;
* compress: a node with exactly one child left and a parent is spliced out (an independent set is
  chosen by a hash coin), its child then hangs on the grandparent and remembers the nodes between.

Both shrink any forest geometrically, so a chain of a million nodes takes some dozens of rounds, not a
million. A cycle shrinks to a self-link; what hangs on it is peeled as usual. Reading the rounds backwards, each
node's parent at its removal is already placed, which gives root, depth and path; nodes placed under a
self-link are on or below a cycle.

Every round is one aggregation and two equi-joins on node ids, written twice. No group is ever gathered: a parent with a third of all
rows as children only receives map-side combined counts. The rounds are the same at every size; only the last sixteenth of the nodes, and never more than
``REST``, is peeled by one task, which saves the rounds that have next to nothing left to do.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from strataline.session import materialize, remove

PART, REST = 16, 4_096


def parents(links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, par): every id in src or dst once, with its parent or null for a root.

    A self-link wins (such a node is a cycle); of several parents the smallest id holds. Rows without dst are left
    out, rows without src make dst a root; repeated rows count once.
    """
    has = links.where(F.col(dst).isNotNull())
    both = has.select(
        F.explode(
            F.array(
                F.struct(F.col(dst).cast("long").alias("node"), F.col(src).cast("long").alias("par")),
                F.struct(F.col(src).cast("long").alias("node"), F.lit(None).cast("long").alias("par")),
            )
        ).alias("e")
    ).select("e.*")
    g = both.where("node is not null").groupBy("node").agg(F.min("par").alias("p"), F.max(F.coalesce(F.col("par") == F.col("node"), F.lit(False))).alias("own"))
    return g.select("node", F.when(F.col("own"), F.col("node")).otherwise(F.col("p")).alias("par"))


def _coin(c: Column, k: int) -> Column:
    return F.xxhash64(c, F.lit(k)) % 2 == 0


def _peel_here(paths: bool):
    """The same peeling in memory over the few nodes left."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        if not rows:
            return
        t = pd.concat(rows, ignore_index=True)
        node = t["node"].tolist()
        par = [None if pd.isna(p) else int(p) for p in t["par"]]
        at = {n: i for i, n in enumerate(node)}
        hops, acc, extra = t["hops"].tolist(), t["acc"].tolist(), t["extra"].tolist()
        up = [-1 if p is None else at[p] for p in par]
        kids = [0] * len(node)
        for i, u in enumerate(up):
            if u >= 0 and u != i:
                kids[u] += 1
        order, todo = [], [i for i, k in enumerate(kids) if not k and up[i] != i]
        while todo:
            i = todo.pop()
            order.append(i)
            u = up[i]
            if u >= 0:
                acc[u] += acc[i] + extra[i]
                kids[u] -= 1
                if not kids[u] and up[u] != u:
                    todo.append(u)
        root, depth, path = [-1] * len(node), [-1] * len(node), [None] * len(node)
        for i in reversed(order):
            u = up[i]
            if u < 0:
                root[i], depth[i], path[i] = node[i], 0, [node[i]]
            elif depth[u] >= 0:
                root[i], depth[i] = root[u], depth[u] + hops[i]
                if paths:
                    path[i] = path[u] + list(t["seg"].iat[i])
        out = pd.DataFrame({"node": node, "root": root, "depth": depth, "size": [a if d >= 0 else -1 for a, d in zip(acc, depth)]})
        if paths:
            out["path"] = path
        yield out

    return run


def _label(active: DataFrame, k: int) -> DataFrame:
    """active (with n_kids) and what becomes of each node in round k: leaf, root, cycle, splice or stay."""
    own = F.coalesce(F.col("par") == F.col("node"), F.lit(False))
    splice = (F.col("n_kids") == 1) & F.col("par").isNotNull() & ~own & _coin(F.col("node"), k) & ~_coin(F.col("par"), k)
    return active.withColumn("what", F.when(splice, "splice").when(F.col("n_kids") == 0, F.when(own, "cycle").when(F.col("par").isNull(), "root").otherwise("leaf")).otherwise("stay"))


def _move(lab: DataFrame, seg: list[str]) -> DataFrame:
    """Nodes whose parent is spliced out hang on the grandparent; above is the parent they had, above_own what it and the nodes between hold themselves."""
    cut = lab.where("what = 'splice'").select(
        F.col("node").alias("v"), F.col("par").alias("v_par"), F.col("hops").alias("v_hops"), (F.col("acc") + F.col("extra")).alias("v_send"), F.col("acc").alias("v_acc"), *[F.col(x).alias("v_" + x) for x in seg]
    )
    hit = F.col("v").isNotNull()
    return lab.join(cut, lab["par"] == cut["v"], "left").select(
        "node", "what", "acc",
        F.when(hit, F.col("v_par")).otherwise(F.col("par")).alias("par"),
        F.when(hit, F.col("hops") + F.col("v_hops")).otherwise(F.col("hops")).alias("hops"),
        F.when(hit, F.col("extra") + F.col("v_send")).otherwise(F.col("extra")).alias("extra"),
        *[F.when(hit, F.concat("v_" + x, x)).otherwise(F.col(x)).alias(x) for x in seg],
        F.col("v").alias("above"), (F.col("v_acc") + F.col("extra")).alias("above_own"),
    )


def _left(moved: DataFrame, seg: list[str]) -> DataFrame:
    """The nodes that stay, with what their leaves have sent and the number of children left: one combined aggregation on the parent."""
    up = moved.where("par is not null and par != node and what in ('leaf', 'stay')").groupBy(F.col("par").alias("sp"))
    got = up.agg(F.sum(F.when(F.col("what") == "leaf", F.col("acc") + F.col("extra"))).alias("sent"), F.count(F.when(F.col("what") == "stay", 1)).alias("k"))
    stay = moved.where("what = 'stay'").select("node", "par", "hops", "acc", "extra", *seg)
    return stay.join(got, stay["node"] == got["sp"], "left").select(
        "node", "par", "hops", (F.col("acc") + F.coalesce("sent", F.lit(0))).alias("acc"), "extra", *seg, F.coalesce("k", F.lit(0)).alias("n_kids")
    )


def hierarchy(links: DataFrame, src: str = "src", dst: str = "dst", paths: bool = False, sizes: bool = False, local_rows: int | None = None) -> DataFrame:
    """(node, root, depth[, size][, path]) of every node of the forest that links describe.

    links: rows (src is the parent of dst); other columns are ignored, whatever their names. root, depth: a root has itself
    and 0; a node on or below a cycle has -1 in both (size -1, path null). size: nodes in its subtree, itself included. path: ids
    from the root to the node. Nulls and repeats as in parents(); without rows the result has none. local_rows: how many nodes one task may peel at the
    end, by default a sixteenth of them and REST at most.
    """
    seg = ["seg"] if paths else []
    spark = links.sparkSession
    start = parents(links, src, dst).select("node", "par", F.lit(1).alias("hops"), F.lit(1).cast("long").alias("acc"), F.lit(0).cast("long").alias("extra"), *([F.array("node").alias("seg")] if paths else []), F.lit("stay").alias("what"))
    seen = Observation()
    last, last_at = materialize(start.observe(seen, F.count("*").alias("n")), "peel")
    left = seen.get["n"]
    bound = min(REST, left // PART) if local_rows is None else local_rows
    rounds: list[tuple[DataFrame, str]] = []
    first_at = last_at
    while left > bound:
        lab, lab_at = materialize(_label(_left(last, seg), len(rounds) + 1), "peel")
        seen = Observation()
        last, last_at = materialize(_move(lab, seg).observe(seen, F.count(F.when(F.col("what") == "stay", 1)).alias("n")), "peel")
        left = seen.get["n"]
        remove(spark, [lab_at])
        rounds.append((last, last_at))
    active = _left(last, seg).drop("n_kids")
    schema = "node long, root long, depth int, size long" + (", path array<long>" if paths else "")
    first = active.repartition(1).mapInPandas(_peel_here(paths), schema) if left else spark.createDataFrame([], schema)
    placed, placed_at = materialize(first, "placed")
    gone, tables = [first_at], [placed_at]
    for moved, done_at in reversed(rounds):
        done = moved.where("what != 'stay'").select("node", "par", "hops", "acc", "what", *seg)
        if sizes:
            below = moved.where("above is not null").select(F.col("above").alias("node"), F.col("node").alias("kid"), F.col("above_own").alias("own"))
            done = done.join(below, "node", "left")
        up = placed.select(F.col("node").alias("u"), F.col("root").alias("u_root"), F.col("depth").alias("u_depth"), *([F.col("path").alias("u_path")] if paths else []))
        j = done.join(up, (done["par"] == up["u"]) & done["what"].isin("leaf", "splice"), "left")
        is_root, ok = F.col("what") == "root", F.col("u_depth") >= 0
        add = j.select(
            "node",
            F.when(is_root, F.col("node")).when(ok, F.col("u_root")).otherwise(F.lit(-1)).cast("long").alias("root"),
            F.when(is_root, F.lit(0)).when(ok, F.col("u_depth") + F.col("hops")).otherwise(F.lit(-1)).cast("int").alias("depth"),
            F.when(is_root | ok, F.col("acc")).otherwise(F.lit(-1)).cast("long").alias("size"),
            *([F.when(is_root, F.array("node")).when(ok, F.concat("u_path", "seg")).alias("path")] if paths else []),
            *(["what", "kid", "own"] if sizes else []),
        )
        if sizes:
            add, add_at = materialize(add, "placed")
            known = placed.select(F.col("node").alias("kid"), F.col("size").alias("kid_size")).unionByName(add.where("what != 'splice'").select(F.col("node").alias("kid"), F.col("size").alias("kid_size")))
            add = add.join(known, "kid", "left").withColumn("size", F.when((F.col("what") == "splice") & (F.col("depth") >= 0), F.col("own") + F.col("kid_size")).otherwise(F.col("size"))).select(*placed.columns)
            gone.append(add_at)
        _, add_at = materialize(add, "placed")
        tables.append(add_at)
        placed = spark.read.schema(placed.schema).parquet(*tables)
        gone.append(done_at)
    remove(spark, gone)
    return placed.select("node", "root", "depth", *(["size"] if sizes else []), *(["path"] if paths else []))


def descendants(placed: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) rows, the node itself left out, from hierarchy(paths=True).

    Rows instead of a list per node: the list of a root with a third of all nodes would be one huge value.
    """
    return placed.where("path is not null").select(F.posexplode("path").alias("i", "ancestor"), F.col("node").alias("descendant"), (F.col("depth") - F.col("i")).alias("distance")).where("distance > 0").select("ancestor", "descendant", "distance")
