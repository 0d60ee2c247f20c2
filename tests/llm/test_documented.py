import pytest

from strataline.llm.documented import documented, telling


@pytest.mark.parametrize(
    "doc,name,sig,want",
    [
        ("Reads the index once and keeps it until the caller closes it.", "loadIndex", "loadIndex(path)", True),
        ("/** Reads hits lazily, errors surface when the caller iterates. */", "readHits", "readHits()", True),
        ("Null when the score is stale.", "seedCrate", "seedCrate(lock)", True),
        ("Returns the best label of the rank or throws if it is closed. @returns label", "pickLabel", "pickLabel(rank)", True),
        ("如果文件没有变化，就不需要重新解析。", "f", "f()", True),
        ("This method watches the eager branch.", "watchEagerBranch", "watchEagerBranch(worker)", False),
        ("The warm vector session.", "fetchWarmVectorSession", "fetchWarmVectorSession(task)", False),
        ("TODO: add description", "f", "f()", False),
        ("see above", "f", "f()", False),
        ("@param a the a\n@return void", "f", "f(a)", False),
        ("{@inheritDoc}", "f", "f()", False),
        ("eslint-disable-next-line no-unused-vars", "f", "f()", False),
        ("Copyright (c) the project contributors. Licensed under the MIT License.", "f", "f()", False),
        ("const x = registry.find(y);", "find", "find(y)", False),
        ("mapDigest(rank, slot, graph)", "mapDigest", None, False),
        ("------------", "f", "f()", False),
        (None, None, None, False),
        ("  \n", "f", "f()", False),
        ("x" * 200_000, "f", "f()", False),
        ("Closes the socket.", "close", "close()", True),
        ("Add a comment to the issue and notify its watchers.", "f", "f()", True),
        ("Add comment.", "f", "f()", False),
        ("Registers the warranty of a sold device.", "f", "f()", True),
        ("Licensed under the MIT License, without warranty.", "f", "f()", False),
    ],
)
def test_telling(doc, name, sig, want):
    assert (telling(doc, name, sig) is not None) == want


S = "id long, file_id long, name string, kind string, start_byte int, end_byte int, signature string, code string"
C = "symbol_id long, code string, summary string, name string"
GOOD = "Reads the index once and keeps it until somebody closes it."


def test_pairs(spark):
    files = spark.createDataFrame([(1, "r"), (2, "r"), (3, "other")], "id long, repo_id string")
    sym = [(i, 1, f"f{i}", "function", 0, 9, f"f{i}(a)", "x") for i in range(1, 9)] + [(1, 1, "f1", "function", 0, 9, "f1(a)", "x"), (20, 1, "K", "class", 0, 100, None, "x"), (9, 1, None, "method", None, None, None, "x")]
    # a declaration in one file, its definition in another; an overload and another repository get nothing
    sym += [(30, 2, "I", "class", 0, 100, None, "x"), (31, 2, "run", "method", 5, 50, "int run(String a, int b);", "x"), (40, 1, "I", "class", 200, 400, None, "x"), (41, 1, "run", "method", 210, 300, "public int run(final String a, int b) {", "x"), (42, 1, "run", "method", 310, 390, "int run(String a) {", "x"), (50, 3, "I", "class", 0, 99, None, "x"), (51, 3, "run", "method", 1, 90, "int run(String a, int b) {", "x")]
    ch = [
        (1, "function f1(a) {}", GOOD, "n"), (1, "function f1(a) {}", GOOD, "n"), (2, f"/**\n * {GOOD}\n */\nfunction f2(a) {{}}", None, "n"), (3, f'def f3(a: Dict[str, int] = (1, 2)) -> int:\n    """{GOOD}\n    """\n    return 1', " ", "n"),
        (4, None, GOOD, "n"), (5, f"function f5(a) {{\n  // {GOOD}\n}}", "", "n"), (6, "", "F6.", "n"), (7, "function f7(a) {}" + " " * 100_000, "TODO", "n"), (8, f"// {GOOD}\nfunction f8(a) {{}}", "TODO", "n"), (9, "x {", GOOD, "n"), (20, "class K {}", GOOD, "n"),
        (31, "int run(String a, int b);", GOOD, "n"), (41, "public int run(final String a, int b) { }", None, "n"), (42, "int run(String a) { }", None, "n"), (51, "int run(String a, int b) { }", None, "n"),
    ]
    a = (spark.createDataFrame(sym, S), spark.createDataFrame(ch, C), files)
    got = {r.symbol_id: (r.description, r.origin) for r in documented(*a).collect()}
    assert got == {1: (GOOD, "own"), 2: (GOOD, "own"), 3: (GOOD, "own"), 8: (GOOD, "own"), 9: (GOOD, "own"), 31: (GOOD, "own"), 41: (GOOD, "declaration")}
    assert documented(a[0].limit(0), a[1].limit(0), files.limit(0)).collect() == []
