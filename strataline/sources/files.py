"""Repositories as sources: file listing with the walk's filters, content hashes, whole-file and parsed symbols, settings."""

from __future__ import annotations

import ast
import json
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.functions.text import FULL, GENERIC, is_test_file

# Directories a walk leaves out, and the largest file it takes.
IGNORE_DIRS = "node_modules .git dist build out coverage .next .turbo .cache vendor".split()
MAX_BYTES = 300 * 1024
_MINIFIED = re.compile(r"\.min\.(?:js|css)$", re.I)
MAX_CODE, MAX_SIGNATURE, MAX_DOC = 20_000, 160, 500


def ignore_rules(lines: list[str]) -> Column | None:
    """A .gitignore's rules as one condition on a relative path that is true for ignored files; later rules win, ! takes back."""
    cond = None
    p = F.col("path")
    for line in lines:
        r = line.rstrip("\n").strip()
        if not r or r.startswith("#"):
            continue
        back = r.startswith("!")
        r = r[1:] if back else r
        rooted = "/" in r.rstrip("/")
        body = re.escape(r.strip("/")).replace(r"\*\*/", "(?:.*/)?").replace(r"/\*\*", "(?:/.*)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        hit = p.rlike(("^" if rooted else "(?:^|/)") + body + ("/" if r.endswith("/") else "(?:/|$)"))
        cond = (hit if not back else F.lit(False)) if cond is None else (cond & ~hit if back else cond | hit)
    return cond


LISTED = "repo_id string, root string, path string, ext string, n_bytes long, mtime double"


def list_files(spark: SparkSession, root: str, repo_id: str, ignore_dirs: tuple[str, ...] = (), extensions: tuple[str, ...] = (), own_config: str | None = None, gitignore: list[str] | None = None) -> DataFrame:
    """(repo_id, path, ext, n_bytes, mtime, content) of the files of a repository on a shared file system that a walk takes.

    ignore_dirs and extensions add to the defaults. A missing root raises; an empty one gives no row. See walk_all for many repositories at once.
    """
    base = os.path.abspath(root).rstrip("/")
    if not os.path.isdir(base):
        raise FileNotFoundError(base)
    rules = ignore_rules(gitignore if gitignore is not None else _lines(os.path.join(base, ".gitignore")))
    df = walk_all(spark.createDataFrame([(repo_id, base)], "repo_id string, root string"), ignore_dirs, extensions)
    if own_config:
        df = df.where(F.col("path") != own_config)
    return with_content(df if rules is None else df.where(~rules))


def walk_all(roots: DataFrame, ignore_dirs: tuple[str, ...] = (), extensions: tuple[str, ...] = ()) -> DataFrame:
    """LISTED rows of the repositories (repo_id, root): one traversal each, ignored directories aren't entered; names and sizes settle what is taken before anything is read.

    Spark's own file sources leave out names that begin with _ or ., which repositories are full of.
    """
    skip, take = {*IGNORE_DIRS, *ignore_dirs}, {*FULL, *GENERIC, *extensions}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            for repo, root in zip(t["repo_id"], t["root"]):
                out = []
                for at, dirs, names in os.walk(root):
                    dirs[:] = sorted(d for d in dirs if d not in skip)
                    for n in names:
                        ext = os.path.splitext(n)[1].lower() or ("." + n[1:].lower() if n.startswith(".") else "")
                        full = os.path.join(at, n)
                        if ext not in take or _MINIFIED.search(n) or not os.path.isfile(full):
                            continue
                        s = os.stat(full)
                        if s.st_size <= MAX_BYTES:
                            out.append((repo, root, os.path.relpath(full, root).replace(os.sep, "/"), ext, s.st_size, s.st_mtime * 1000))
                    if len(out) > 10_000:
                        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in LISTED.split(", ")])
                        out = []
                yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in LISTED.split(", ")])

    return roots.select("repo_id", "root").repartition("repo_id").mapInPandas(run, LISTED)


def with_content(listed: DataFrame) -> DataFrame:
    """LISTED rows with content (null where a file is gone), read by the workers, spread evenly whatever repository they belong to."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            for i in range(0, len(t), 64):
                part = t.iloc[i : i + 64].copy()
                part["content"] = [_bytes(os.path.join(r, p)) for r, p in zip(part["root"], part["path"])]
                yield part.drop(columns=["root"])

    return listed.repartition("repo_id", "path").mapInPandas(run, LISTED.replace(" root string,", "") + ", content binary")


def _bytes(path: str) -> bytes | None:
    try:
        with open(path, "rb") as f:
            return f.read()
    except OSError:
        return None


def _lines(path: str) -> list[str]:
    if not os.path.exists(path):
        return []
    with open(path, encoding="utf-8", errors="replace") as f:
        return f.readlines()


def hashed(files: DataFrame) -> DataFrame:
    """files with hash: sixteen hex digits of a 64-bit hash of the bytes, for change detection only."""
    return files.withColumn("hash", F.lpad(F.lower(F.hex(F.xxhash64("content"))), 16, "0")).withColumn("is_test", is_test_file(F.col("path")))


def settings(home: str | None, repo: str | None) -> dict:
    """Merged settings of a home and a repository file; the repository's win, unknown keys and broken files count for nothing."""
    keys = {"ignoreDirs", "extensions", "rrfK", "precise", "minConfidence", "maxResults"}
    out: dict = {}
    for path in (home, repo):
        try:
            with open(path, encoding="utf-8") as f:
                got = json.load(f)
        except (OSError, TypeError, ValueError):
            continue
        if isinstance(got, dict):
            out |= {k: v for k, v in got.items() if k in keys}
    return out


SYMBOLS = "repo_id string, path string, name string, kind string, start_line int, end_line int, start_byte int, end_byte int, signature string, code string, summary string, calls array<string>, imports array<string>, call_lines array<int>, literals array<struct<key:string,store:string,action:string,scope:string,line:int>>"
_TEST = re.compile(r"^[ \t]*(it|test|describe|context|suite|before|after|beforeEach|afterEach|beforeAll|afterAll)\s*(?:\.\w+)?\(\s*(?:(['\"`])(.*?)\2\s*,\s*)?(?:async\s*)?(?:function\b|\()", re.M)
_CLASS = re.compile(r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:public\s+|private\s+|protected\s+|internal\s+|abstract\s+|final\s+|static\s+|sealed\s+|partial\s+)*(?:class|interface)\s+(\w+)", re.M)
_FUNC = re.compile(
    r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:(?:public|private|protected|internal|static|final|abstract|async|override|virtual|readonly)\s+)*(?:"
    r"function\s*\*?\s*(?P<f>\w+)\s*\(|(?:const|let|var)\s+(?P<a>\w+)\s*=\s*(?:async\s*)?(?:function\b|\([^()\n]*\)\s*(?::\s*[\w<>\[\], |]+)?\s*=>|\w+\s*=>)|"
    r"(?:[\w<>\[\],.?]+\s+)?(?P<m>(?!(?:if|for|while|switch|catch|return|function|new|else|do|try|throw|await|typeof|foreach|using|lock)\b)\w+)\s*\([^(){};]*(?:\([^()]*\)[^(){};]*)*\)\s*(?::\s*[\w<>\[\], |]+)?\s*(?:throws [\w, .]+)?\{)",
    re.M,
)
_IMPORT = re.compile(r"^[ \t]*(?:import\s+(?:[^'\";]*?from\s+)?['\"]([^'\"]+)['\"]|import\s+(?:static\s+)?([\w.*]+)\s*;|using\s+([\w.]+)\s*;|use\s+([\w\\]+)|(?:const|let|var)\s+[^=\n]+=\s*require\(['\"]([^'\"]+)['\"]\))", re.M)
_CALL = re.compile(r"(?<![\w$])(?:new\s+)?(?:[\w$]+(?:\.|->|::|\?\.))*([A-Za-z_$][\w$]*)\s*\(")
_STORAGE = re.compile(r"(?<![\w$.])(?:window\.|self\.|globalThis\.)?(localStorage|sessionStorage)\s*(?:\?\.|\.)\s*(getItem|setItem|removeItem)\s*\(\s*(?:'((?:[^'\\\n]|\\.)*)'|\"((?:[^\"\\\n]|\\.)*)\"|`([^`$\\]*)`)")
# What a storage call does.
ACTIONS = {"getItem": "read", "setItem": "write", "removeItem": "remove"}
_WORD = set("if for while switch catch return function new else do try throw await typeof foreach using lock def class with and or not in is lambda yield assert print elif except sizeof instanceof super this".split())
_STRIP = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|//[^\n]*|/\*.*?\*/", re.S)
_COMMENT = re.compile(r"((?:[ \t]*(?://[^\n]*|\*[^\n]*|/\*[^\n]*)\n){1,40})$")


def clean_doc(doc: str) -> str:
    """A comment without markers and tags, blanks joined, at most 500 characters."""
    t = re.sub(r"^[ \t]*(?:/\*+|\*+/|\*|///?|#+)[ \t]?|\*+/[ \t]*$", "", doc, flags=re.M)
    t = re.split(r"(?m)^\s*@\w+", t)[0]
    return " ".join(t.split())[:MAX_DOC]


def _close(blank: str, start: int) -> int:
    """The end of the block that opens after start in text whose strings and comments are blanked."""
    i = blank.find("{", start)
    if i < 0:
        return len(blank)
    depth = 0
    for m in re.compile(r"[{}]").finditer(blank, i):
        depth += 1 if m.group() == "{" else -1
        if not depth:
            return m.end()
    return len(blank)


def parse(path: str, text: str) -> Iterator[dict]:
    """Symbols of one file: Python by its syntax tree, other known languages by patterns over text with strings and comments blanked, anything else as one file symbol."""
    ext = os.path.splitext(path)[1].lower()
    lines = text.split("\n")
    first = next((x.strip() for x in lines if x.strip()), "")
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x) + 1)

    def row(name: str, kind: str, a: int, b: int, doc: str = "", calls=(), imports=(), literals=()) -> dict:
        body = text[a:b]
        return {
            "path": path, "name": name, "kind": kind, "start_line": text.count("\n", 0, a) + 1, "end_line": text.count("\n", 0, max(a, b - 1)) + 1, "start_byte": len(text[:a].encode()), "end_byte": len(text[:b].encode()),
            "signature": body[:MAX_SIGNATURE].split("\n")[0].strip(), "code": body[:MAX_CODE], "summary": doc[:MAX_DOC] or None, "calls": [c for c, _ in calls], "imports": list(imports), "call_lines": [n for _, n in calls], "literals": list(literals),
        }

    if ext in (".py", ".pyw"):
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            tree = None
        if tree is not None:
            imports = [a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names] + [n.module or "." for n in ast.walk(tree) if isinstance(n, ast.ImportFrom)]
            yield row(os.path.basename(path), "file", 0, len(text), imports=imports)
            todo = [(tree, None)]
            while todo:
                node, owner = todo.pop()
                for c in ast.iter_child_nodes(node):
                    if isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                        top = min([c.lineno, *(x.lineno for x in c.decorator_list)])
                        b = min(starts[c.end_lineno] - 1, len(text))
                        a = starts[top - 1] + len(lines[top - 1]) - len(lines[top - 1].lstrip())
                        kind = "class" if isinstance(c, ast.ClassDef) else "method" if isinstance(owner, ast.ClassDef) else "function"
                        inner, stack = [], [c] if kind != "class" else []
                        while stack:  # calls belong to the innermost function
                            for k in ast.iter_child_nodes(stack.pop()):
                                if isinstance(k, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                                    continue
                                stack.append(k)
                                if isinstance(k, ast.Call):
                                    f = k.func
                                    inner.append((f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else "", k.lineno))
                        yield row(c.name, kind, a, b, clean_doc(ast.get_docstring(c) or ""), [x for x in inner if x[0]])
                        todo.append((c, c))
                    else:
                        todo.append((c, owner))
            return
    if ext not in FULL:
        r = row(os.path.basename(path), "file", 0, len(text))
        yield r | {"signature": first[:MAX_SIGNATURE]}
        return
    blank = _STRIP.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    found: list[tuple[int, int, str, str]] = []
    classes = [(m.start(), _close(blank, m.end()), m.group(1)) for m in _CLASS.finditer(blank)]
    found += [(a, b, n, "class") for a, b, n in classes]
    for m in _FUNC.finditer(blank):
        name = m.group("f") or m.group("a") or m.group("m")
        if name in _WORD:
            continue
        if m.group("m"):
            end = _close(blank, m.end() - 1)
        else:
            brace = blank.find("{", m.end())
            line = blank.find("\n", m.end())
            end = _close(blank, m.end()) if brace >= 0 else (line if line >= 0 else len(blank))
        inside = any(a < m.start() < b for a, b, _ in classes)
        if m.group("m") and not inside and not re.match(r"[ \t]*(?:public|private|protected|internal|static)", m.group()):
            continue
        found.append((m.start(), end, name, "method" if inside and not m.group("f") else "method" if inside and ext in (".php",) else "function"))
    for m in _TEST.finditer(text):
        if blank[m.start(1)] != " ":
            word = m.group(1)
            kind = "test" if word in ("it", "test") else "suite" if word in ("describe", "context", "suite") else "hook"
            found.append((m.start(), _close(blank, m.end() - 1), m.group(3) or word, kind))
    scopes = sorted((f for f in found if f[3] != "class"), key=lambda f: f[1] - f[0])
    stored = []
    for m in _STORAGE.finditer(text):  # a literal without an enclosing scope has nothing to belong to
        if blank[m.start(1)] != " " and (own := next((f for f in scopes if f[0] < m.start() < f[1]), None)):
            stored.append({"key": next(g for g in m.groups()[2:] if g is not None), "store": m.group(1), "action": ACTIONS[m.group(2)], "scope": own[2], "line": text.count("\n", 0, m.start()) + 1})
    yield row(os.path.basename(path), "file", 0, len(text), imports=[next(g for g in m if g) for m in _IMPORT.findall(text) if any(m)], literals=stored)
    calls: dict[tuple, list[tuple[str, int]]] = {}
    for m in _CALL.finditer(blank):
        if m.group(1) not in _WORD and (own := next((f for f in scopes if f[0] < m.start() < f[1] and not (m.group(1) == f[2] and m.start() - f[0] < 200 and "{" not in blank[f[0] : m.start()])), None)):
            calls.setdefault(own, []).append((m.group(1), text.count("\n", 0, m.start(1)) + 1))
    for f in sorted(found):
        a = f[0] + len(text[f[0] :]) - len(text[f[0] :].lstrip())
        doc = _COMMENT.search(text, 0, text.rfind("\n", 0, a) + 1)
        yield row(f[2], f[3], a, f[1], clean_doc(doc.group(1)) if doc else "", calls.get(f, ()))


def extract(files: DataFrame) -> DataFrame:
    """Symbols of files (repo_id, path, content): one narrow stage, a file at a time, no shuffle. Files that aren't text give their file symbol with what can be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            out = []
            for repo, path, content in zip(t["repo_id"], t["path"], t["content"]):
                text = (bytes(content) if content is not None else b"").decode("utf-8", "replace")
                out += [{"repo_id": repo, **r} for r in parse(path or "", text)]
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in SYMBOLS.split(", ")])

    return files.select("repo_id", "path", "content").mapInPandas(run, SYMBOLS)
