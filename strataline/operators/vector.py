"""Cosine search over stored vectors, many questions at once, and a hashing embedder for text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataline.operators.lexical import tokens
from strataline.session import materialize

MAX_QUERY_MB = 64
VECTORS = 1_000  # multiplied at a time
MAX_KEPT = 1_000_000  # best vectors of all its questions that a task keeps


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, weights: DataFrame | None = None, block: int = 2_000, max_query_mb: int = MAX_QUERY_MB) -> DataFrame:
    """(query_id, vec_id, score, rank): the k most similar vectors of each question by dot product, ties by vec_id; k <= 0 gives none.

    vectors: (vec_id, embedding), queries: (query_id, embedding). The questions go to all workers in portions of some MAX_QUERY_MB and MAX_KEPT answers, each against all vectors, as matrix
    products per block of questions; a task keeps its own k best, so that k rows a question and task are shuffled. weights: (vec_id, weight) multiply positive
    scores. Null vectors are left out, and a question meets the vectors of its own length.
    """
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score double"
    if k <= 0:
        return spark.createDataFrame([], schema + ", rank int")
    q = queries.where("embedding is not null").select("query_id", "embedding")
    v = vectors.where("embedding is not null").select("vec_id", "embedding")
    if weights is not None:
        v = v.join(weights.select("vec_id", "weight"), "vec_id", "left").select("vec_id", "embedding", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    else:
        v = v.withColumn("weight", F.lit(1.0))
    part = None
    sizes = q.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy("dim").collect()  # a row for each length of question
    many = [max(-(-r.n * r.dim * 8 // (max_query_mb << 20)), -(-r.n * k // MAX_KEPT)) if r.dim else 0 for r in sizes]
    if max(many, default=0) > 1:  # both are read again by each portion
        q, v = materialize(q, "vectors")[0], materialize(v, "vectors")[0]
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")  # else a union of single partitions is one task
    for r, portions in zip(sizes, many):
        for p in range(portions):
            own = q.where((F.size("embedding") == r.dim) & (F.pmod(F.xxhash64("query_id"), F.lit(portions)) == p))
            scored = _scored(v.where(F.size("embedding") == r.dim), own.orderBy("query_id").toArrow(), r.dim, k, block, schema, portions)
            part = scored if part is None else part.unionByName(scored)
    if part is None:
        return spark.createDataFrame([], schema + ", rank int")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _scored(v: DataFrame, rows: pa.Table | list, dim: int, k: int, block: int, schema: str, portions: int = 1) -> DataFrame:
    """Each task's k best vectors of each question. Products in single precision, with their error allowed for, only say which pairs are worked out."""
    if isinstance(rows, list):
        rows = pa.table({"query_id": pa.array([r.query_id for r in rows], pa.int64()), "embedding": pa.array([r.embedding for r in rows], pa.list_(pa.float64()))})
    ids = rows["query_id"].to_numpy().astype(np.int64)
    mat = rows["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), dim)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edge, norm = np.full(len(ids), -np.inf), np.sqrt((mat * mat).sum(axis=1))
        with np.errstate(over="ignore"):
            rough = mat.astype(np.float32)
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n_kept = 0

        def cut() -> None:
            q, vec, s = (np.concatenate(x) for x in zip(*kept))
            o = np.lexsort((vec, -s, q))
            q, vec, s = q[o], vec[o], s[o]
            first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
            rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
            edge[q[rank == k - 1]] = s[rank == k - 1]
            kept[:] = [(q[rank < k], vec[rank < k], s[rank < k])]

        for t in batches:
            if not len(t) or not len(ids):
                continue
            for b in range(0, len(t), VECTORS):
                part = t.iloc[b : b + VECTORS]
                own, e, w = part["vec_id"].to_numpy(), np.stack(part["embedding"].to_numpy()).astype(np.float64), part["weight"].to_numpy()
                far, most = np.sqrt((e * e).sum(axis=1)).max(), max(1.0, np.abs(w).max())
                kind = np.float32 if norm.max() * far * most < 1e30 else np.float64  # beyond that single precision has no number
                fine, q32, thin = bool((w == 1).all()), rough if kind is np.float32 else mat, e.astype(kind).T
                for a in range(0, len(ids), block):
                    s = q32[a : a + block] @ thin
                    if not fine:
                        s = np.where(s > 0, s * w.astype(kind), s)
                    # twice the error of a product of this length, and what rounding can add
                    slack = (2 * (dim + 4) * 6e-8 * norm[a : a + block] * far + 1e-6) * 2 * most
                    least = edge[a : a + block]
                    if len(own) > k and not np.isfinite(least).all():
                        least = np.maximum(least, -np.partition(-s, k - 1, axis=1)[:, k - 1] - slack)
                    qi, vi = np.nonzero(s >= (least - slack).astype(kind)[:, None])
                    x = np.round(np.einsum("ij,ij->i", mat[a + qi], e[vi]), 6)
                    x = np.where(x > 0, np.round(x * w[vi], 6), x)
                    ok = x >= edge[a + qi]
                    kept.append((a + qi[ok], own[vi[ok]], x[ok]))
                    n_kept += int(ok.sum())
                if n_kept > max(2 * k * len(ids), 10_000):
                    cut()
                    n_kept = len(kept[0][0])
        if kept:
            cut()
            q, vec, s = kept[0]
            for a in range(0, len(q), 100_000):
                yield pd.DataFrame({"query_id": ids[q[a : a + 100_000]], "vec_id": vec[a : a + 100_000], "score": s[a : a + 100_000]})

    return v.coalesce(max(1, 2 * v.sparkSession.sparkContext.defaultParallelism // portions)).mapInPandas(run, schema)


def hashed(docs: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """(key, embedding): term counts hashed into dim signed cells and set to length one; texts without words give zeros, repeats of a key one row. Words are hashed in the JVM and
    counted where the text is; only the counts are shuffled, to remove repeats. A stand-in where no model is at hand."""
    cell = F.transform(tokens(F.col(text)), lambda w: (F.pmod(F.xxhash64(w), F.lit(dim)) * 2 + F.when(F.xxhash64(w, F.lit(1)) % 2 == 0, 1).otherwise(0)).cast("int"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, n = b.column(1).flatten().to_numpy(), b.num_rows
            at = np.repeat(np.arange(n), pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)) * dim + (c >> 1)
            sums = np.bincount(at, np.where(c & 1, 1.0, -1.0), n * dim).astype(np.int32).reshape(n, dim)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in sums], pa.binary())], names=["k", "sums"])

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int32).reshape(-1, dim).astype(np.float64)
            e = s / np.maximum(np.sqrt((s * s).sum(axis=1)), 1e-12)[:, None]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, e.size + 1, dim), pa.int32()), pa.array(e.ravel()))], names=[key, "embedding"])

    kind = docs.select(key).dtypes[0][1]
    sums = docs.select(F.col(key).alias("k"), cell.alias("c")).mapInArrow(count, f"k {kind}, sums binary").dropDuplicates(["k"])
    return sums.mapInArrow(scale, f"`{key}` {kind}, embedding array<double>")


WARN_ROWS = 150_000  # fixed value: from here on a store asks for attention


def put(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """(vec_id, embedding): stored with fresh vectors added or put in the place of those with their ids; of repeated fresh ids the greatest vector stays."""
    new = fresh.groupBy("vec_id").agg(F.max("embedding").alias("embedding"))
    return stored.select("vec_id", "embedding").join(new.select("vec_id"), "vec_id", "left_anti").unionByName(new)


def without(stored: DataFrame, gone: DataFrame) -> DataFrame:
    """stored less the ids of gone (vec_id); unknown ids make no difference."""
    return stored.join(gone.select("vec_id").distinct(), "vec_id", "left_anti")


def size_warning(n: int, most: int = WARN_ROWS) -> str | None:
    """A sentence if more vectors are stored than every question should be compared with one by one."""
    return f"{n} vectors, more than {most}: exact search reads all of them for every batch of questions" if n > most else None
