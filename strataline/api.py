"""The engine's surface: build, search, expand, check, context, read and list over a store, for one question or many."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline import build as B
from strataline.operators import analytics, context, fusion, graph, vector


class Index:
    """A store opened for questions, of one repository or of all. Unknown symbols, files and repositories give no rows."""

    def __init__(self, spark: SparkSession, store: str, repo_id: str | None = None) -> None:
        self.spark, self.store, self.repo_id = spark, store, repo_id

    def table(self, name: str) -> DataFrame:
        return B.read(self.spark, self.store, name, self.repo_id)

    def _ids(self, ids: list[int], name: str) -> DataFrame:
        return self.spark.createDataFrame([(int(i),) for i in ids], f"{name} long")

    def lookup(self, table: str, column: str, values: list) -> DataFrame:
        """Rows of a table by key: files by path or id, symbols by id or name, chunks by symbol_id."""
        return self.table(table).where(F.col(column).isin(values))

    def search(self, texts: list[str], k: int = 10, kind: str | None = None, ext: str | None = None) -> DataFrame:
        """fusion.search over names, texts, paths and the stored vectors; query_id is the question's place in texts."""
        q = self.spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
        near = vector.top_k(self.table("vectors"), vector.hashed(q, "query_id", "text"), max(4 * k, 40))
        semantic = near.where("score > 0").select("query_id", F.col("vec_id").alias("symbol_id"), (F.col("rank") - 1).alias("pos"))
        return fusion.search(q, self.table("symbols"), self.table("files"), self.table("chunks"), semantic, k, kind, ext)

    def decorated(self, rows: DataFrame, column: str) -> DataFrame:
        """rows with name, kind, path and lines of the symbol in column."""
        f = self.table("files").select(F.col("id").alias("file_id"), "path")
        s = self.table("symbols").select(F.col("id").alias(column), "file_id", "name", "kind", "start_line", "end_line").join(f, "file_id", "left").drop("file_id")
        return rows.join(s, column)

    def expand(self, ids: list[int], hops: int = 1) -> DataFrame:
        """(root, node, relation, hops, via, member, shared_key, name, kind, path, start_line, end_line); an id that doesn't exist gives one row with null node, one without neighbours none."""
        roots = self._ids(ids, "root")
        e = graph.expand(roots, self.table("edges"), self.table("symbols"), self.table("string_literals"), hops)
        out = self.decorated(e.select("root", "node", "relation", "hops", "via", "member", "shared_key"), "node")
        missing = roots.join(self.table("symbols").select(F.col("id").alias("root")), "root", "left_anti")
        return out.unionByName(missing, allowMissingColumns=True)

    def check(self, ids: list[int], hops: int = 3) -> DataFrame:
        """graph.check of symbols: callers, tests that reach them, risk."""
        return graph.check(self._ids(ids, "root"), self.table("edges"), self.table("symbols"), self.table("files"), self.table("string_literals"), hops)

    def callers(self, ids: list[int], hops: int = 3) -> DataFrame:
        t = graph.callers(self._ids(ids, "root"), self.table("edges"), self.table("symbols"), self.table("string_literals"), hops)
        return self.decorated(graph.ranked(t), "node")

    def context(self, texts: list[str], k: int = 8, hops: int = 1, budget: int = analytics.BUDGET, max_items: int = analytics.MAX_ITEMS) -> DataFrame:
        """(task_id, bundle): one JSON text a task."""
        tasks = self.spark.createDataFrame(list(enumerate(texts)), "task_id long, text string")
        hits = self.search(texts, k).select(F.col("query_id").alias("task_id"), "symbol_id", "score", "place")
        items, summaries = context.assemble(hits, self.table("symbols"), self.table("files"), self.table("chunks"), self.table("edges"), self.table("string_literals"), hops, budget, max_items)
        return context.answer(items, summaries, tasks)

    def read(self, spans: list[tuple[str, int, int]]) -> DataFrame:
        """(path, start, end, slice) of stored files: lines from 1; paths that aren't stored, or lead out of the repository, give null."""
        q = self.spark.createDataFrame(list(enumerate(spans)), "id long, s struct<path:string,start:int,end:int>").select("id", "s.*")
        f = self.table("files").select("path", F.col("id").alias("file_id"))
        whole = self.table("symbols").where("kind = 'file'").select("file_id", F.col("id").alias("symbol_id")).join(self.table("chunks").select("symbol_id", F.col("code").alias("text")), "symbol_id").drop("symbol_id")
        j = q.where("path not like '%..%' and path not like '/%'").join(f, "path").join(whole, "file_id")
        return q.join(analytics.read_lines(j.select("id", "text", "start", "end")), "id", "left").select("path", "start", "end", "slice")

    def list(self) -> DataFrame:
        return B.repositories(self.spark, self.store)
