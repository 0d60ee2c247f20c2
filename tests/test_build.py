import json
from datetime import datetime, timezone

from strataline import build as B
from strataline.__main__ import main
from strataline.api import Index

A = """// Loads settings.
function loadSettings(id) {
  const t = localStorage.getItem('theme'); localStorage.setItem("theme", id);
  return parseSettings(t);
}

function parseSettings(text) {
  return text;
}
"""
C = """class Store:
    def open(self):
        return loadSettings(1)
"""


def rows(spark, store):
    out = {}
    for t in B.TABLES:
        df = B.read(spark, store, t)
        out[t] = sorted(str(r.asDict()) for r in df.drop("built_at", "mtime").collect())
    return out


def test_incremental_equals_full(spark, tmp_path):
    root = tmp_path / "r"
    (root / "src").mkdir(parents=True)
    (root / "src/a.js").write_text(A)
    (root / "src/gone.js").write_text("function gone() {\n  return loadSettings(2);\n}\n")
    (root / "src/c.py").write_text(C)
    inc, full, snaps = str(tmp_path / "inc"), str(tmp_path / "full"), str(tmp_path / "snaps")
    day = datetime(2024, 5, 1, tzinfo=timezone.utc)
    s = B.build(spark, [("r", str(root))], inc, built_at=day, snapshots=snaps).first()
    assert (s.n_total, s.n_added, s.n_changed, s.n_deleted) == (3, 3, 0, 0) and s.n_symbols == s.n_vectors > 5 and s.warning is None
    lit = {(r.key, r.store, r.action, r.line) for r in B.read(spark, inc, "string_literals").collect()}
    assert lit == {("theme", "localStorage", "read", 3), ("theme", "localStorage", "write", 3)}
    assert {(r.callee_name, r.line) for r in B.read(spark, inc, "calls").where("caller_name = 'loadSettings'").collect()} >= {("parseSettings", 4)}

    (root / "src/gone.js").unlink()
    (root / "src/c.py").write_text(C + "\n    def close(self):\n        parseSettings(2)\n")
    (root / "src/d.js").write_text("function parseSettings(x) {\n  return loadSettings(x);\n}\n")
    resolved = spark.createDataFrame([("r", "src/c.py", "open", "loadSettings", "src/a.js", 3), ("r", "src/c.py", "open", "loadSettings", "out.js", 3)], "repo_id string, path string, caller_name string, callee_name string, target_path string, target_line int")
    s = B.build(spark, [("r", str(root))], inc, built_at=day.replace(day=2), resolved=resolved, snapshots=snaps).first()
    assert (s.n_total, s.n_added, s.n_changed, s.n_unchanged, s.n_deleted) == (3, 1, 1, 1, 1)
    B.build(spark, [("r", str(root))], full, force=True, built_at=day.replace(day=2), resolved=resolved)
    assert rows(spark, inc) == rows(spark, full)
    e = B.read(spark, inc, "edges")
    assert e.where("resolution = 'lsp'").count() == 1 and e.where("dst_name = 'parseSettings' and dst_symbol_id is not null").count() >= 4
    assert [r.created for r in B.refresh(spark, inc, snaps, ["r"]).collect()] == [False]

    x = Index(spark, inc, "r")
    found = x.lookup("symbols", "name", ["loadSettings"]).first().id
    near = x.expand([found, 5]).collect()
    assert {(r.name, r.relation) for r in near if r.node} >= {("parseSettings", "callee"), ("open", "caller")} and [r.root for r in near if r.node is None] == [5]
    assert [r.slice for r in x.read([("src/a.js", 7, 8), ("../x", 1, 2)]).orderBy("start").collect()][-1] == "function parseSettings(text) {\n  return text;"
    b = json.loads(x.context(["loadSettings"], 2).first().bundle)
    assert b["primary"][0]["name"] == "loadSettings" and b["filesTouched"][0] == "src/a.js"
    assert x.check([found]).first().risk == "untested"
    assert [r.repo_id for r in x.list().collect()] == ["r"]
    B.clear(spark, inc, "r")
    assert B.read(spark, inc, "symbols").isEmpty()


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.js").write_text(A)
    assert main(["build", str(tmp_path / "s"), f"p={tmp_path}/p"]) == 0
    assert main(["search", str(tmp_path / "s"), "parseSettings", "--k", "2"]) == 0
    out = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert out[0]["n_added"] == 1 and out[1]["name"] == "parseSettings"
