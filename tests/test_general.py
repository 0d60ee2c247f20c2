import random

from strataline.operators.hierarchy import descendants, hierarchy
from strataline.operators.snapshots import changes

LINKS = "src long, dst long, node string, par string"


def brute(pairs):
    par, nodes = {}, set()
    for s, d in pairs:
        if d is None:
            continue
        nodes |= {x for x in (s, d) if x is not None}
        if s is not None:
            par[d] = d if s == d or par.get(d) == d else min(s, par.get(d, s))
    out = {}
    for n in nodes:
        path, x = [], n
        while x not in path:
            path.append(x)
            if x not in par:
                break
            x = par[x]
        out[n] = (path[-1], len(path) - 1, path[::-1]) if path[-1] not in par else (-1, -1, None)
    size = {n: 0 for n in nodes}
    for n, (_, d, p) in out.items():
        for a in p or []:
            size[a] += 1
    return {n: (r, d, size[n] if d >= 0 else -1, p) for n, (r, d, p) in out.items()}


def run(spark, pairs, **kw):
    df = spark.createDataFrame([(s, d, "x", "y") for s, d in pairs], LINKS)
    got = hierarchy(df, paths=True, sizes=True, **kw).collect()
    assert len(got) == len({r.node for r in got})
    return {r.node: (r.root, r.depth, r["size"], r.path) for r in got}


def test_hierarchy_all_rounds_distributed(spark):
    rnd = random.Random(5)
    pairs = [(i - 1, i) for i in range(1, 30)]  # a chain
    pairs += [(100, i) for i in range(101, 140)]  # a star
    pairs += [(rnd.randrange(200, i), i) for i in range(201, 260)]
    pairs += [(300, 301), (301, 302), (302, 300), (302, 303), (303, 304), (310, 310), (310, 311), (320, 321), (321, 320), (321, 322)]
    pairs += [(5, 5000), (None, 6000), (7, None), (0, 1), (0, 1)]
    want = brute(pairs)
    assert run(spark, pairs, local_rows=0) == want
    assert run(spark, pairs) == want


def test_hierarchy_empty_and_null(spark):
    assert run(spark, []) == {}
    assert run(spark, [(1, None), (None, None)]) == {}
    assert run(spark, [(None, 3)], local_rows=0) == {3: (3, 0, 1, [3])}


def test_descendants(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (9, 9)], "src long, dst long")
    got = {tuple(r) for r in descendants(hierarchy(df, paths=True)).collect()}
    assert got == {(1, 2, 1), (1, 3, 2), (2, 3, 1)}


MANIFEST = "repo_id string, version_id string, path string, hash string, mtime double, change string"


def diff(spark, rows):
    return sorted(tuple(r) for r in changes(spark.createDataFrame(rows, MANIFEST)).collect())


def test_changes(spark):
    rows = [
        ("r", "1", "a//b.py", "AA", 1.0, ""), ("r", "1", "a//b.py", "AA", 1.0, ""), ("r", "2", "./a\\b.py", "aa", 9.0, ""),
        ("r", "1", "gone", "1", None, ""), ("r", "2", "new", "1", None, ""),
        ("r", "1", "x", "1", 1.0, ""), ("r", "2", "x", "1", 1.0, ""), ("r", "2", "x", "2", 2.0, ""), ("r", "2", "x", "9", None, ""),
        ("r", "1", "n", None, 1.0, ""), ("r", "2", "n", None, 1.0, ""), ("r", "1", "m", None, 1.0, ""), ("r", "2", "m", "5", 1.0, ""),
        ("q", "1", "only", "1", 1.0, ""), (None, "1", "z", "1", 1.0, ""), ("r", "2", None, "1", 1.0, ""),
    ]
    assert diff(spark, rows) == [("r", "2", "gone", "removed"), ("r", "2", "m", "changed"), ("r", "2", "new", "added"), ("r", "2", "x", "changed")]
    assert diff(spark, []) == []
