from strataline.operators import pages as P
from strataline.operators import vector
from strataline.operators.relations import bind_literals, precise_edges, relative_path
from strataline.sources.tables import conform, exists, newest
from pyspark.sql import functions as F

SYM = "id long, file_id long, name string, kind string, start_line int, end_line int"


def test_city(spark):
    files = spark.createDataFrame([(1, "r", "a/b/c/x.py"), (2, "r", "a/b/c/y.py"), (3, "r", "top.py"), (4, "r", "d/z.py"), (5, "q", "one.py")], "id long, repo_id string, path string")
    per = {1: 6, 2: 3, 3: 2, 4: 1, 5: 4}
    symbols = spark.createDataFrame([(f * 100 + i, f, "s", "function", i + 1, i + 1) for f, n in per.items() for i in range(n)], SYM)
    tree = {(r.parent, r.name, r.dir, r.file_id, r.weight) for r in P.city_tree(symbols, files).where("repo_id = 'r'").collect()}
    assert tree == {("", "a/b/c", "a/b/c", None, 9), ("a/b/c", "x.py", None, 1, 6), ("a/b/c", "y.py", None, 2, 3), ("", "top.py", None, 3, 2), ("", "d", "d", None, 1), ("d", "z.py", None, 4, 1)}
    plots = P.city_plots(symbols, files)
    rows = plots.collect()
    top = {r.name: r for r in rows if r.repo_id == "r" and r.depth == 1}
    assert abs(top["a/b/c"].w * top["a/b/c"].h / (top["top.py"].w * top["top.py"].h) - 4.5) < 1e-6
    inside = next(r for r in rows if r.file_id == 1)
    box = top["a/b/c"]
    assert box.x < inside.x and inside.x + inside.w < box.x + box.w and box.y < inside.y and inside.y + inside.h < box.y + box.h
    blocks = P.city_blocks(symbols, plots).collect()
    assert len(blocks) == 16 and len({(round(b.x, 6), round(b.y, 6)) for b in blocks}) == 16
    at = {r.file_id: r for r in rows if r.file_id}
    assert all(at[b.id // 100].x < b.x < at[b.id // 100].x + at[b.id // 100].w for b in blocks)
    assert P.city_plots(symbols.limit(0), files).collect() == []


def test_squarify_fills_the_rectangle():
    boxes = P.squarify([6.0, 6.0, 4.0, 3.0, 2.0, 2.0, 1.0], 0, 0, 6, 4)
    assert abs(sum(w * h for *_, w, h in boxes) - 24) < 1e-9 and [round(w * h, 6) for *_, w, h in boxes] == [6, 6, 4, 3, 2, 2, 1]
    assert P.squarify([], 0, 0, 1, 1) == []


def test_precise_edges_and_paths(spark):
    symbols = spark.createDataFrame([(1, 1, "f", "function", 1, 9), (2, 2, "g", "function", 3, 5), (3, 2, "h", "function", 4, 4)], SYM)
    files = spark.createDataFrame([(1, "a.py"), (2, "b/c d.py")], "id long, path string")
    uris = spark.createDataFrame([("file:///root/r/b/c%20d.py", "/root/r"), ("file:///else/x.py", "/root/r"), ("http://a/b", "/root/r"), (None, "/root/r"), ("file:///root/r/a+b.py", "/root/r/")], "u string, root string")
    assert [r.p for r in uris.select(relative_path(F.col("u"), F.col("root")).alias("p")).collect()] == ["b/c d.py", None, None, None, "a+b.py"]
    calls = spark.createDataFrame([(1, "f", "g", "b/c d.py", 4), (1, "nobody", "g", "b/c d.py", 4), (1, "f", "g", "b/c d.py", 99), (1, "f", "g", "none.py", 4)], "file_id long, caller_name string, callee_name string, target_path string, target_line int")
    assert [tuple(r) for r in precise_edges(calls, symbols, files).collect()] == [(1, 2, "g", "calls", "lsp")]


def test_literals_bind_to_the_last_of_a_name(spark):
    symbols = spark.createDataFrame([(1, 1, "f", 0), (2, 1, "f", 50), (3, 2, "f", 90)], "id long, file_id long, name string, start_byte int")
    lits = spark.createDataFrame([(1, "f", "k", "localStorage", "read", 3), (1, "x", "k", "localStorage", "read", 3)], "file_id long, scope string, key string, store string, action string, line int")
    assert [r.symbol_id for r in bind_literals(lits, symbols).collect()] == [2]


def test_vector_store_and_tables(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    new = spark.createDataFrame([(2, [0.5, 0.5]), (3, [1.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.embedding for r in vector.put(v, new).collect()}
    assert got == {1: [1.0, 0.0], 2: [0.5, 0.5], 3: [1.0, 1.0]}
    assert [r.vec_id for r in vector.without(v, new).collect()] == [1]
    assert vector.size_warning(10) is None and "200000" in vector.size_warning(200_000)
    old = spark.createDataFrame([(1, "src/a.test.js", "h", "x")], "id int, path string, hash string, extra string")
    assert conform(old, "files").columns == ["id", "path", "hash", "mtime", "ext", "is_test", "repo_id"] and conform(old, "files").first().is_test is True
    c = conform(spark.createDataFrame([(1, "getDomainToken()", None)], "symbol_id long, code string, summary string"), "chunks").first()
    assert c.parts == "get domain token"
    assert exists(old) and not exists(old.limit(0))
    cand = spark.createDataFrame([("r", "a", "2024-01-01"), ("r", "b", "2024-02-01"), ("r", "z", None)], "repo string, dir string, t string").withColumn("t", F.col("t").cast("timestamp"))
    assert [tuple(r) for r in newest(cand, "repo", "dir", "t").collect()] == [("r", "b")]


def test_questions_go_in_portions_and_by_length(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)] + [(99, [1.0, 2.0, 3.0]), (98, None)], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0, 1.0]), (4, None), (5, [1.0] * 7)], "query_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in vector.top_k(v, q, 2).collect())
    assert got == [(1, 1, 49), (1, 2, 48), (2, 1, 0), (2, 2, 1), (3, 1, 99)]
    big = spark.createDataFrame([(i, [float(i % 7)] * 20_000) for i in range(20)], "query_id long, embedding array<double>")
    long = spark.createDataFrame([(i, [float(i)] * 20_000) for i in range(3)], "vec_id long, embedding array<double>")
    assert vector.top_k(long, big, 1, max_query_mb=1).where("query_id % 7 != 0 and vec_id = 2").count() == 17
