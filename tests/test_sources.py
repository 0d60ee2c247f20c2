import json
import subprocess

from pyspark.sql import functions as F

from strataline.operators.incremental import cascade, prune, unique_version_ids
from strataline.sources.files import clean_doc, extract, hashed, list_files, parse, settings
from strataline.sources.store import catalog, drop_old, read_snapshot, write_snapshot
from strataline.streaming.ingest import changes_stream, current, event_counts

JS = """import { a } from './a';
const b = require('./b');

/**
 * Loads the thing once.
 * @param x it
 */
export async function loadThing(x) {
  const s = "function fake() {";
  return helper(x, other.run(s));
}

const arrow = (p) => {
  return loadThing(p);
};

class Box extends Base {
  // opens it
  open(key) {
    return this.turn(key);
  }
}

describe('the box', () => {
  it('opens once', () => { new Box().open(1); });
});
"""
PY = '''import os
from x import y


class Box:
    """A box."""

    @staticmethod
    def open(key):
        """Opens it."""
        return turn(key)


async def load(a, b=(1, 2)):
    def inner():
        return deep()
    return helper(os.path.join(a))
'''


def by_name(path, text):
    return {r["name"]: r for r in parse(path, text)}


def test_parse_javascript():
    got = by_name("src/box.js", JS)
    assert {(n, r["kind"]) for n, r in got.items()} == {("box.js", "file"), ("loadThing", "function"), ("arrow", "function"), ("Box", "class"), ("open", "method"), ("the box", "suite"), ("opens once", "test")}
    f = got["loadThing"]
    assert f["summary"] == "Loads the thing once." and f["signature"] == "export async function loadThing(x) {" and f["calls"] == ["helper", "run"] and (f["start_line"], f["end_line"]) == (8, 11)
    assert got["arrow"]["calls"] == ["loadThing"] and got["open"]["calls"] == ["turn"] and got["open"]["summary"] == "opens it" and "open" in got["opens once"]["calls"]
    assert got["box.js"]["imports"] == ["./a", "./b"]
    assert JS.encode()[f["start_byte"] : f["end_byte"]].decode() == f["code"]


def test_parse_python():
    got = by_name("box.py", PY)
    assert {(n, r["kind"]) for n, r in got.items()} == {("box.py", "file"), ("Box", "class"), ("open", "method"), ("load", "function"), ("inner", "function")}
    assert got["open"]["summary"] == "Opens it." and got["open"]["calls"] == ["turn"] and got["open"]["code"].startswith("@staticmethod") and got["load"]["calls"] == ["helper", "join"] and got["inner"]["calls"] == ["deep"]
    assert got["box.py"]["imports"] == ["os", "x"]


def test_parse_odd_input():
    for path in ("a.py", "a.js", "a.java", "a.php", "a.cs", "a.css", "", "a"):
        for text in ("", "\n\n", "{{{", "def (", "é" * 5000, "/*" * 3000, "x = '" * 500):
            assert [r for r in parse(path, text) if r["kind"] == "file"]
    assert clean_doc("/** Does it.\n * @param x no\n */") == "Does it."


def test_walk_filters(spark, tmp_path):
    def put(p, text="x"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(text)

    for p in ("src/a.js", "src/a b+c.py", "src/x.min.js", "node_modules/y.js", "src/z.bin", "logs/k.js", "keep/logs.js", "gen/a.py", "gen/keep.py", "own.config.json", "src/__tests__/t.ts"):
        put(p)
    put("src/big.js", "x" * 400_000)
    put(".gitignore", "# no\nlogs/\n/gen/*\n!gen/keep.py\n")
    df = list_files(spark, str(tmp_path), "r", own_config="own.config.json")
    assert {r.path for r in df.collect()} == {"src/a.js", "src/a b+c.py", "keep/logs.js", "gen/keep.py", "src/__tests__/t.ts"}
    h = {r.path: r for r in hashed(df).collect()}
    assert len(h["src/a.js"].hash) == 16 and h["src/a.js"].hash == h["keep/logs.js"].hash and h["src/__tests__/t.ts"].is_test and not h["src/a.js"].is_test
    s = extract(df).collect()
    assert {r.path for r in s} == set(h) and all(r.repo_id == "r" for r in s)
    assert extract(df.limit(0)).collect() == []


def test_settings(tmp_path):
    (tmp_path / "h").write_text(json.dumps({"rrfK": 10, "ignoreDirs": ["a"], "odd": 1}))
    (tmp_path / "r").write_text(json.dumps({"rrfK": 20}))
    (tmp_path / "bad").write_text("{")
    assert settings(str(tmp_path / "h"), str(tmp_path / "r")) == {"rrfK": 20, "ignoreDirs": ["a"]}
    assert settings(None, str(tmp_path / "bad")) == {}


def test_snapshot_store(spark, tmp_path):
    path = str(tmp_path / "s")
    df = spark.createDataFrame([("r", "1", 5), ("r", "2", 6), ("r", "3", 7), ("q", "1", 8)], "repo_id string, version_id string, v int")
    write_snapshot(df, path)
    write_snapshot(spark.createDataFrame([("r", "3", 70)], df.schema), path)
    assert [r.v for r in read_snapshot(spark, path, "r", "3").collect()] == [70] and read_snapshot(spark, path, "r", "9").collect() == []
    assert len(drop_old(spark, path)) == 1
    assert [tuple(r) for r in catalog(spark, path).collect()] == [("q", "1"), ("r", "2"), ("r", "3")]


def test_maintenance(spark):
    files = spark.createDataFrame([(1,)], "id long")
    sym = spark.createDataFrame([(10, 1), (20, 2)], "id long, file_id long")
    edges = spark.createDataFrame([(10,), (20,), (None,)], "src_symbol_id long")
    got = cascade(files, sym, edges=(edges, "src_symbol_id"))
    assert [r.id for r in got["symbols"].collect()] == [10] and [r.src_symbol_id for r in got["edges"].collect()] == [10]
    b = spark.createDataFrame([("r", "v", 2), ("r", "v", 1), ("q", "v", 1)], "repo_id string, version_id string, built_at int")
    assert {(r.repo_id, r.version_id, r.built_at) for r in unique_version_ids(b).collect()} == {("r", "v", 1), ("r", "v-2", 2), ("q", "v", 1)}
    assert prune(b, b.where("repo_id = 'q'")).count() == 1


def test_stream_upserts(spark, tmp_path):
    schema = "id long, file_id long, name string, kind string, start_line int, end_line int, start_byte int, end_byte int, signature string"
    drop, store, cp = (str(tmp_path / x) for x in ("drop", "store", "cp"))
    for n, rows in enumerate([[(1, 1, "a"), (2, 1, "b")], [(2, 1, "B"), (3, 2, "c"), (3, 2, "c")]]):
        spark.createDataFrame([(*r, "function", 1, 2, 0, 9, "s") for r in rows], schema).write.mode("append").parquet(drop)
        changes_stream(spark, drop, store, cp).awaitTermination(60)
    assert sorted((r.id, r.name) for r in current(spark, store).collect()) == [(1, "a"), (2, "B"), (3, "c")]
    assert current(spark, str(tmp_path / "none")) is None


def test_event_windows(spark):
    df = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:00:00", "a", 4.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r.n, r.value) for r in event_counts(df).collect()) == [(1, 4.0), (2, 3.0)]


def test_rest_works_without_the_text_subpackage(tmp_path):
    code = "import sys; sys.modules['strataline.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p3_found' not in q and set(e.oracle_sql()) <= set(q)"
    from pathlib import Path

    subprocess.run(["python", "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])
