"""Mixing sources to target weights by a low-discrepancy schedule.

1. Sizes in tokens per source; target sizes by water filling: a source can't give more than its size times its repeats, what it lacks is shared among
   the others in proportion to their targets.
2. Each source's records, shuffled by a hash, are cut into blocks of equal tokens. Running sums are taken in hash buckets first, then within a bucket, so
   no source is ever one group.
3. Each source is due its number of slots. Slot i of the schedule falls to the source in whose share of the unit interval the point i * golden ratio (mod 1) lies. A source's slots, ranked, take its
   blocks one after another, pass after pass, so that every prefix of the schedule keeps the shares.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataline.session import materialize

SLOTS, MOST_SLOTS, BLOCK = 20_000, 2_000_000, 100_000  # blocks of the whole mixture: one for BLOCK tokens, within these bounds, as ranks are taken of each source's slots
MAX_SOURCES = 10_000
GOLDEN = (math.sqrt(5) - 1) / 2


def fill(sizes: dict[str, int], targets: dict[str, float], repeats: dict[str, int], total: float) -> dict[str, float]:
    """Target tokens of each source: shares of total as near to the targets as the capacities size * repeats allow."""
    cap = {s: float(sizes.get(s, 0)) * max(0, repeats.get(s) or 0) for s in targets}
    out = {s: 0.0 for s in targets}
    open_, left = {s for s in targets if targets[s] > 0 and cap[s] > 0}, float(total)
    while open_:
        weight = sum(targets[s] for s in open_)
        full = {s for s in open_ if left * targets[s] / weight >= cap[s]}
        if not full:
            return out | {s: left * targets[s] / weight for s in open_}
        for s in full:
            out[s] = cap[s]
        left -= sum(cap[s] for s in full)
        open_ -= full
    return out


def key_of(source):
    return F.lower(F.trim(source))


def mixture(tokens: DataFrame, targets: DataFrame, slots: int | None = None, bucket_rows: int = 20_000, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(records, report).

    tokens: (doc_id, source, n_tokens), a row a record. targets: (source, target_share, max_repeats); rows with null source or share count for
    nothing, of several rows of a source the greatest share holds. Sources are compared without case and outer blanks; records of null or other sources, and empty
    records, are not drawn.
    records: (slot, source, doc_id, repeat_no, n_tokens), each record at most max_repeats times. report: a row for each source of the targets with target_share,
    max_repeats, size_tokens (of the source), drawn_tokens, drawn_records, repeats (drawn by size), share.
    """
    spark = tokens.sparkSession
    want = targets.where("source is not null and target_share is not null").groupBy(key_of(F.col("source")).alias("source")).agg(F.max("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("max_repeats"))
    rows = want.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    targets_of, repeats_of = {r.source: r.target_share for r in rows}, {r.source: r.max_repeats for r in rows}
    order = F.xxhash64("doc_id", F.lit(seed))
    docs = tokens.select("doc_id", key_of(F.col("source")).alias("source"), F.col("n_tokens").cast("long").alias("n")).withColumn("h", order)
    docs, _ = materialize(docs, "mix")
    total, n_docs = docs.agg(F.sum("n"), F.count("*")).head()
    total = total or 0
    # buckets grow with the corpus, so that each holds some bucket_rows records of a source at most
    docs = docs.withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 20), F.lit(max(64, n_docs // bucket_rows))))
    use = docs.where((F.col("n") > 0) & F.col("source").isin(list(targets_of))) if targets_of else docs.limit(0)
    # one row a source and bucket: a few numbers for every bucket_rows records
    sums = use.groupBy("source", "bucket").agg(F.sum("n").alias("s"))
    base = sums.withColumn("base", F.coalesce(F.sum("s").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    slots = slots or min(MOST_SLOTS, max(SLOTS, total // BLOCK))
    sizes = {r.source: r.s for r in sums.groupBy("source").agg(F.sum("s").alias("s")).collect()}
    goal = fill(sizes, targets_of, repeats_of, total)
    drawn = sum(goal.values())
    step = max(1.0, drawn / slots)  # tokens of a block
    # (source, blocks, max_repeats, size, slots): blocks of one source are of equal size, near step
    plan = [(s, k, int(repeats_of[s]), sizes[s], max(1, round(goal[s] * k / sizes[s]))) for s in sorted(goal) if goal[s] > 0 for k in [max(1, round(sizes[s] / step))]]
    n_slots = sum(p[4] for p in plan)
    plan_df = spark.createDataFrame(plan, "source string, n_blocks long, max_repeats int, size long, n_slots long")
    edges, bounds = 0, []
    for i, p in enumerate(plan):
        edges += p[4]
        bounds.append(F.struct(F.lit(p[0]).alias("source"), F.lit(edges / n_slots if i < len(plan) - 1 else 2.0).alias("hi")))
    if plan:
        x = F.col("slot").cast("double") * GOLDEN
        point = spark.range(n_slots).select(F.col("id").alias("slot")).withColumn("x", x - F.floor(x))
        point = point.select("slot", F.element_at(F.filter(F.array(*bounds), lambda b: F.col("x") < b["hi"]), 1)["source"].alias("source"))
        point = point.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy("slot")) - 1)  # MOST_SLOTS rows at most
        # the points hit each source to within a slot or two; what a source still lacks comes at the end
        due = plan_df.select("source", "n_blocks", F.explode(F.sequence(F.lit(0), (F.col("n_slots") - 1).cast("int"))).alias("r"))
        sched = due.join(point, ["source", "r"], "left").select(
            F.coalesce("slot", n_slots + F.col("r")).alias("slot"), "source", F.floor(F.col("r") / F.col("n_blocks")).cast("int").alias("repeat_no"), (F.col("r") % F.col("n_blocks")).alias("block")
        )
    else:
        sched = spark.createDataFrame([], "slot long, source string, repeat_no int, block long")
    w = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    at = use.join(base.select("source", "bucket", "base"), ["source", "bucket"]).withColumn("start", F.col("base") + F.coalesce(F.sum("n").over(w), F.lit(0)))
    at = at.join(F.broadcast(plan_df.select("source", "n_blocks", "size")), "source")
    # the block that holds the record's middle token
    blocks = at.withColumn("block", F.least(F.col("n_blocks") - 1, F.floor((F.col("start") + F.col("n") / 2) * F.col("n_blocks") / F.col("size"))).cast("long"))
    records = sched.join(blocks.select("source", "block", "doc_id", "n"), ["source", "block"]).select("slot", "source", "doc_id", "repeat_no", F.col("n").alias("n_tokens"))
    by = records.groupBy("source").agg(F.sum("n_tokens").alias("drawn_tokens"), F.count("*").alias("drawn_records"))
    info = spark.createDataFrame([(s, float(targets_of[s]), int(repeats_of[s]), int(sizes.get(s, 0))) for s in sorted(targets_of)], "source string, target_share double, max_repeats int, size_tokens long")
    report = info.join(by, "source", "left").select(
        "source", "target_share", "max_repeats", "size_tokens", F.coalesce("drawn_tokens", F.lit(0)).alias("drawn_tokens"), F.coalesce("drawn_records", F.lit(0)).alias("drawn_records"),
        F.when(F.col("size_tokens") > 0, F.round(F.coalesce("drawn_tokens", F.lit(0)) / F.col("size_tokens"), 6)).otherwise(F.lit(0.0)).alias("repeats"),
        F.round(F.coalesce("drawn_tokens", F.lit(0)) / F.greatest(F.lit(1), F.sum("drawn_tokens").over(Window.partitionBy(F.lit(1)))), 6).alias("share"),
    )
    return records, report
