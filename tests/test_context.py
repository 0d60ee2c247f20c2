import json

from strataline.operators import analytics as A
from strataline.operators import context as C

SYM = "id long, file_id long, name string, kind string, start_line int, end_line int, start_byte int, end_byte int, signature string"


def world(spark):
    names = ["alpha", "beta", "gamma", "delta", "eps", "style"]
    symbols = spark.createDataFrame([(i, i if i < 6 else 9, n, "file" if n == "style" else "function", 1, 3, 0, 30, f"{n}()") for i, n in enumerate(names, 1)], SYM)
    files = spark.createDataFrame([(i, f"src/{n}.{'scss' if n == 'style' else 'ts'}", False) for i, n in [*enumerate(names[:5], 1), (9, "style")]], "id long, path string, is_test boolean")
    chunks = spark.createDataFrame([(i, f'{n} "quoted"\n' * 3) for i, n in enumerate(names, 1)], "symbol_id long, code string")
    edges = spark.createDataFrame([(1, 1, 3, "gamma", "calls", "heuristic"), (2, 2, 3, "gamma", "calls", "heuristic"), (3, 2, 4, "delta", "calls", "heuristic"), (4, 5, 1, "alpha", "calls", "heuristic"), (5, 1, 2, "beta", "calls", "lsp")], "id long, src_symbol_id long, dst_symbol_id long, dst_name string, kind string, resolution string")
    literals = spark.createDataFrame([], "symbol_id long, key string")
    hits = spark.createDataFrame([(7, 6, 9.0, 1), (7, 1, 3.0, 2), (7, 2, 1.0, 3), (7, 99, 8.0, 4)], "task_id long, symbol_id long, score double, place int")
    return hits, symbols, files, chunks, edges, literals


def test_order_tiers_and_first_seen(spark):
    items, summary = C.assemble(*world(spark))
    got = [(r.tier, r.name, r.via) for r in items.orderBy("place").collect()]
    # presentation files fall behind; gamma belongs to the best hit that reaches it
    assert got == [("primary", "alpha", None), ("primary", "beta", None), ("primary", "style", None), ("hop1", "gamma", 1), ("hop1", "eps", 1), ("hop2plus", "delta", 2)]
    s = summary.first()
    assert s.files_touched == ["src/alpha.ts", "src/beta.ts", "src/style.scss", "src/gamma.ts", "src/eps.ts", "src/delta.ts"] and s.notes == [] and not s.truncated
    b = json.loads(C.answer(items, summary, spark.createDataFrame([(7, "do it")], "task_id long, text string")).first().bundle)
    assert [x["name"] for x in b["primary"]] == ["alpha", "beta", "style"] and b["neighbors"][2]["code"] is None and b["task"] == "do it"


def test_costs_are_those_of_json(spark):
    t = ['a "b" \\ \n', "", "größe", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(t)], "i int, t string").select("i", C.json_cost(A.F.col("t")).alias("n")).orderBy("i").collect()
    assert [r.n for r in df] == [None if x is None else len(json.dumps(x, ensure_ascii=False)) for x in t]


def test_budget_drops_neighbours_and_says_so(spark):
    items, summary = C.assemble(*world(spark), budget=100)
    rows = items.orderBy("place").collect()
    assert [r.name for r in rows] == ["alpha", "beta", "style"] and [r.code is not None for r in rows] == [True, False, False]
    s = summary.first()
    assert s.truncated and s.notes == ["3" + C.DROPPED]
    items, summary = C.assemble(*world(spark), max_items=4)
    assert items.count() == 4 and summary.first().notes == ["2" + C.OMITTED]


def test_no_hits(spark):
    hits, *rest = world(spark)
    items, summary = C.assemble(hits.limit(0), *rest)
    assert items.collect() == [] and summary.collect() == []


def test_repeated_chunks(spark):
    hits, symbols, files, chunks, edges, literals = world(spark)
    want = sorted(C.assemble(hits, symbols, files, chunks, edges, literals)[0].collect())
    assert sorted(C.assemble(hits, symbols, files, chunks.unionByName(chunks), edges, literals)[0].collect()) == want and len(want) == 6


def test_every_symbol_is_a_task(spark, tmp_path):
    from strataline.plans.search_queries import contexts

    _, symbols, files, chunks, edges, _ = world(spark)
    # 7 is named like 1, 100 is the only one whose number ends so
    symbols = symbols.unionByName(spark.createDataFrame([(7, 1, "alpha", "function", 5, 6, 0, 9, "alpha(x)"), (8, 1, None, "function", 7, 8, 0, 9, None), (100, 2, "omega", "function", 5, 6, 0, 9, "omega()")], SYM))
    chunks = chunks.unionByName(spark.createDataFrame([(7, "alpha x"), (100, "omega")], chunks.schema)).withColumn("parts", A.F.lit(""))
    literals = spark.createDataFrame([], "id long, symbol_id long, key string")
    for name, df in {"symbols": symbols, "files": files, "chunks": chunks, "edges": edges, "string_literals": literals}.items():
        df.unionByName(df).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.task_id: tuple(r)[1:] for r in contexts(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, 100} and got[1] == got[7] and got[1] != got[100]
