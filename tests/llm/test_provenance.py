import pytest

from strataline.llm import provenance as p

ROWS = "\n".join(f"{i},abc,{i / 7:.5f},1" for i in range(300))
CODE = "import { a } from './a';\n\nfunction f(x) {\n  return a(x, 3);\n}\n"


@pytest.mark.parametrize(
    "path,code,want",
    [
        ("src/a.ts", CODE, None),
        ("src/vendors/minify.ts", CODE, None),
        ("src/codegen/generatedIds.ts", "// ids generated by the cache are stable\n" + CODE, None),
        ("src/a.ts", "// Copyright (c) the my-repo contributors.\n// Licensed under the MIT License.\n" + CODE, None),
        ("src/a.ts", "/**\n * Auto-generated method stub\n */\n" + CODE, None),
        ("src/a.ts", "// Code generated by tool. DO NOT EDIT.\n" + CODE, "generated"),
        ("src/a.php", "<?php\n// Fichier produit par outil. Toute modification sera perdue.\n$x = 1;\n", "generated"),
        ("src/a.js", "// machine-made output of tool 1.2; source: a.idl\n" + CODE, "generated"),
        ("src/a.cs", CODE + "\n// <auto-generated>\n", "generated"),
        ("src/a.py", "def f(x):\n    return x\n\n# Automatisch erzeugt mit werkzeug, nicht von Hand bearbeiten\n", "generated"),
        ("src/a.java", CODE + "\n/*\n * Code generated by tool. DO NOT EDIT.\n */\n", "generated"),
        ("src/a.cs", CODE + "\n// BANNER = '// Code generated by tool. DO NOT EDIT.';\n", None),
        ("src/a.java", CODE + "\n// ids generated by the shard must not be edited while the rank runs\n", None),
        ("src/a.js", "function f() {\n  // Code generated by tool. DO NOT EDIT.\n  return 1;\n}\n", None),
        ("x/package-lock.json", "{}", "generated"),
        ("lib/a.js", '"use strict";\nObject.defineProperty(exports, "__esModule", { value: true });\n', "generated"),
        ("web/node_modules/x/a.js", CODE, "vendored"),
        ("src/a.js", "// other v1.2.3\n// (c) the other authors, released under the BSD licence\n" + CODE, "vendored"),
        ("src/a.js", "// Copied from other 1.2.3 without changes. Fix upstream.\n" + CODE, "vendored"),
        ("a.min.js", "x", "minified"),
        ("src/a.js", "var a=b||{},c=[];" * 200, "minified"),
        ("src/a.js", CODE + 'const P = "' + "abc|" * 500 + '";\n' + CODE * 3, None),
        ("src/a.js", "// " + "コメント" * 400 + "\n" + CODE, None),
        ("src/a.js", f"const rows = `\n{ROWS}\n`;\n", "data"),
        ("src/a.py", 'BLOB = "' + "aGVsbG8gd29ybGQ" * 99 + '"\n', "data"),
        ("config/a.json", "{\n" + '  "a": 1,\n' * 99 + "}", None),
        ("a.js", None, None),
        ("", "", None),
    ],
)
def test_judge(path, code, want):
    assert p.judge(path, None, code, "my-repo-12345678") == want


FILES = "id long, path string, hash string, mtime double, ext string, is_test boolean, repo_id string, reason string"


def test_merkle_finds_shared_subtrees(spark):
    def lib(first, root, repo, h="h"):
        return [(first + i, f"{root}/{n}", h + n, 1.0, ".js", False, repo, "") for i, n in enumerate(["a.js", "sub/b.js", "sub/c.js"])]

    rows = lib(1, "x/lib", "one-aaaaaaaa") + lib(11, "deep/er/lib", "two-bbbbbbbb") + lib(21, "lib", "three-cccccccc", "other") + lib(31, "y/lib", "one-dddddddd", "same")
    rows += [(41, "y/lib/a.js", "samea.js", 1.0, ".js", False, "one-eeeeeeee", ""), (50, None, "h", None, None, False, None, ""), (51, "top.js", None, 1.0, None, False, "two-bbbbbbbb", ""), (1, "x/lib/a.js", "ha.js", 1.0, ".js", False, "one-aaaaaaaa", "")]
    df = spark.createDataFrame(rows, FILES).selectExpr("*", "cast(null as long) leaf", "0L size")
    assert {r.file_id for r in p.merkle(df.dropDuplicates(["id"])).collect()} == {1, 2, 3, 11, 12, 13}
    assert p.merkle(df.limit(0)).collect() == []


def test_not_by_hand(spark):
    files = spark.createDataFrame([(1, "a.ts", "h1", 1.0, None, False, "r-12345678", ""), (2, "b.ts", "h2", 1.0, ".ts", False, "r-12345678", ""), (2, "b.ts", "h2", 1.0, ".ts", False, "r-12345678", ""), (3, "vendor/c.ts", "h3", None, None, False, None, "")], FILES)
    symbols = spark.createDataFrame([(10, 1, "file", 5), (20, 2, "file", 5), (20, 2, "file", 5), (21, 2, "function", 5)], "id long, file_id long, kind string, code int")
    chunks = spark.createDataFrame([(10, CODE), (20, "// @generated\n" + CODE), (20, "// @generated\n" + CODE), (21, CODE)], "symbol_id long, code string")
    assert {tuple(r) for r in p.not_by_hand(files, symbols, chunks).collect()} == {(2, "generated"), (3, "vendored")}
    assert p.not_by_hand(files.limit(0), symbols.limit(0), chunks.limit(0)).collect() == []


def test_copies_meet_whatever_their_notices_and_layout(spark):
    body = "".join(f"function f{i}(a) {{\n  return a * {i};\n}}\n" for i in range(20))
    other = "// Copyright (c) some people.\n" + body.replace("\n", "\r\n").replace("  return", "\treturn")
    texts = [(1, "lib/a.js", "one-11111111", body), (2, "src/renamed.js", "two-22222222", other), (3, "src/c.js", "two-33333333", body.replace("* 3", "* 4")), (4, "x/a.js", "three-44444444", CODE), (5, "y/a.js", "four-55555555", CODE)]
    files = spark.createDataFrame([(i, p_, f"h{i}", 1.0, ".js", False, r, "") for i, p_, r, _ in texts], FILES)
    symbols = spark.createDataFrame([(i * 10, i, "file", 5) for i, *_ in texts], "id long, file_id long, kind string, code int")
    chunks = spark.createDataFrame([(i * 10, t) for i, _, _, t in texts], "symbol_id long, code string")
    assert {tuple(r) for r in p.not_by_hand(files, symbols, chunks).collect()} == {(1, "vendored"), (2, "vendored")}
