"""Files that nobody wrote by hand: generated, minified, copied from third parties, or data stored as code.

Directories are hashed bottom-up as Merkle trees; a subtree that occurs in unrelated repositories is a copy. A leaf is the file's text without the
notices at its ends, blanks and case, so that copies under another licence header, with other line ends or indentation still meet; without text it is the stored content hash. The hash of
a directory is a sum over its children, so that the combining is map-side and a directory with a third of all files is no heavy group. Notices at the head
and the end, layout and place of each file settle the rest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.session import materialize

#: Directories that hold third-party copies, directories tools write into, lock files, and files with the marks of a generator in their name.
VENDOR_DIRS = "node_modules bower_components jspm_packages third_party third-party thirdparty vendor _vendor vendored deps external site-packages Pods Carthage".split()
TOOL_DIRS = "dist out gen generated generated-sources __generated__ _generated autogen target".split()
LOCKS = "package-lock.json npm-shrinkwrap.json yarn.lock pnpm-lock.yaml composer.lock Gemfile.lock Cargo.lock poetry.lock Pipfile.lock uv.lock go.sum packages.lock.json flake.lock pubspec.lock Podfile.lock mix.lock".split()
PROGRAM = ".js .jsx .mjs .cjs .ts .tsx .py .pyw .java .php .cs .rb .go .rs .c .cc .cpp .h .hpp .kt .swift .scala .lua .pl .r .jl".split()
_TOOL_NAME = re.compile(r"(?:\.pb\.(?:go|cc|h)|_pb2(?:_grpc)?\.py|\.g\.dart|\.designer\.cs|\.g\.cs|\.generated\.\w+|_generated\.\w+|\.bundle\.js|\.map)$", re.I)
_MIN_NAME = re.compile(r"[.\-_]min\.\w+$", re.I)
_VERSION_NAME = re.compile(r"[A-Za-z][\w.]*-\d+\.\d+(?:\.\d+)?(?:[.\-](?:min|prod|slim))?\.\w+$")

_SAID = re.compile(
    r"code generated\b|do not (?:edit|modify)|\b(?:machine|tool|auto)[\- ]?(?:made|written|produced|created|generated)\b(?! method)|\b(?:produced|emitted|written) by (?:a tool|the (?:compiler|generator|build)\b)|\boutput of [\w.\-]+(?: [\d.]+)?; (?:source|from|input)\b|changes? made here (?:will be|are)|@generated\b|<auto-?generated|\bauto-?generated (?:by|file|from|code|with)|^\W*auto-?generated\b(?! method)|(?:^\W*|\b(?:file|code|source|module|class|content|output|parser|bindings?|client)\b[^\n.]{0,40}\b)generated (?:by|from|with|automatically)\b(?!.*\bare\b)|automatically (?:generated|created|produced)|machine generated|(?:will be|are) (?:overwritten|lost)"
    r"|automatisch (?:erzeugt|generiert)|nicht (?:von hand )?(?:bearbeiten|ändern)|änderungen gehen verloren|g[ée]n[ée]r[ée] (?:automatiquement|par)|^\W*fichier (?:produit|créé) par|modifications? (?:sera|seront) perdue|(?:archivo|fichero) (?:generado|producido|creado) por|se perderán|ne pas (?:modifier|éditer)|generado autom[áa]ticamente|no (?:editar|modificar)\b|自动生成|自動生成|请勿(?:手动)?(?:编辑|修改)|gerado automaticamente|não edit",
    re.I | re.M,
)
_NOT_SAID = re.compile(r"auto-?generated method stub", re.I)
_COMPILED = re.compile(r"Object\.defineProperty\(exports, ?[\"']__esModule[\"']|\(this && this\.__(?:assign|awaiter|extends|importDefault|decorate)\)|__webpack_require__|//# sourceMappingURL=|\b_interopRequireDefault\(|^// Generated by CoffeeScript", re.M)
_COPIED = re.compile(r"\bcopied (?:verbatim )?from ([\w.@/\-]+) v?\d+(?:\.\d+)+|\bvendored (?:from|copy)|(?:fix|report|patch)(?:es)? upstream|do not patch here", re.I)
_RELEASE = re.compile(r"^\W*([A-Za-z][\w.\-]*) v\d+\.\d+(?:\.\d+)?\b", re.M)
_AUTHORS = re.compile(r"\(c\) (?:\d{4}[\d,\- ]* )?(?:the )?([\w.\-]+) (?:authors|team|contributors|project|developers|foundation)|@author (?:the )?([\w.\-]+) (?:team|authors)", re.I)
_TAGS = re.compile(r"^\W*@(version|license|author|preserve)\b", re.M | re.I)
_HEAD = re.compile(r"\A﻿?(?:<\?php\s*|#![^\n]*\n|[\"']use strict[\"'];?\s*|(?:\s+|//[^\n]*|#[^\n]*|--[^\n]*|;[^\n]*|/\*.*?\*/|<!--.*?-->|\"\"\".*?\"\"\"|'''.*?'''))*", re.S)
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\.)*+`", re.S)
_ROW = re.compile(r"^\s*[\[({]?\s*(?:[\"']?[\w.\-]*[\"']?\s*[,;:|\t]\s*)*[\"']?-?\d[\w.\-]*[\"']?(?:\s*[,;:|\t]\s*[\"']?-?[\w.\-]*[\"']?)*\s*[\])}]*[,;]?\s*$")
_BLOB = re.compile(r"(?:\\x[0-9a-fA-F]{2}|\\[0-7]{3}|0x[0-9a-fA-F]{2},\s?){12,}|[A-Za-z0-9+/]{120,}={0,2}")
_LINE_COMMENT = re.compile(r"(?://|#(?!\[)|--|;|<!--.*-->\s*$|/\*.*\*/\s*$)")
_RESOLVED = re.compile(r"\"lockfileVersion\"|^# (?:This file is automatically @generated|THIS IS AN AUTOGENERATED FILE)", re.M)


def header(code: str) -> str:
    """The comments before the first line of code."""
    return _HEAD.match(code).group()


def footer(code: str) -> str:
    """The comments after the last line of code, without what they quote."""
    lines = code.rstrip().split("\n")
    i = len(lines)
    while i and (not lines[i - 1].strip() or _LINE_COMMENT.match(lines[i - 1])):
        i -= 1
    if i and lines[i - 1].rstrip().endswith(("*/", "-->")):  # a block comment that stands alone
        j = i - 1
        while j and not lines[j].lstrip().startswith(("/*", "<!--")):
            j -= 1
        if lines[j].lstrip().startswith(("/*", "<!--")):
            i = j
    return _STRING.sub("", "\n".join(lines[i:]))


def leaf(code: str | None, head: str) -> tuple[int | None, int]:
    """(hash, size) of a text without its header, footer, blanks and case; no hash if nothing is left."""
    body = "".join((code or "")[len(head) :].split()).lower()
    return (xxhash.xxh64_intdigest(body.encode("utf-8", "surrogatepass")) - (1 << 63) if body else None), len(body)


def judge(path: str, ext: str | None, code: str | None, repo: str | None) -> str | None:
    """generated, minified, vendored, data, or None for a file written by hand. Null values are unknown and count for nothing."""
    path = path or ""
    parts = path.replace("\\", "/").split("/")
    name, dirs = parts[-1], parts[:-1]
    if name in LOCKS or _TOOL_NAME.search(name):
        return "generated"
    if any(d in VENDOR_DIRS for d in dirs):
        return "vendored"
    ext = (ext or ("." + name.rpartition(".")[2] if "." in name else "")).lower()
    program = ext in PROGRAM
    code = code or ""
    head = header(code)
    said = _NOT_SAID.sub("", head)
    if _SAID.search(said) or code and _SAID.search(_NOT_SAID.sub("", footer(code))):
        return "generated"
    if _COPIED.search(head):
        return "vendored"
    own = (repo or "").lower()
    authors = {(a or b).lower() for a, b in _AUTHORS.findall(head)}
    foreign = {a for a in authors if a != "project" and not own.startswith(a)}
    if foreign and (_RELEASE.search(head) or len(set(_TAGS.findall(head.lower()))) >= 2):
        return "vendored"
    if program and _VERSION_NAME.fullmatch(name) and (foreign or not code):
        return "vendored"
    if _MIN_NAME.search(name):
        return "minified"
    if program and _COMPILED.search(code):
        return "generated"
    if _RESOLVED.search(code):
        return "generated"
    if any(d in TOOL_DIRS for d in dirs) and (program or ext in (".css", ".html", ".map", ".d.ts")):
        return "generated"
    if (program or ext in (".css", ".html", ".scss")) and code:
        bare = _STRING.sub('""', code)
        size = len(bare) or 1
        dense = sum(len(x) for x in bare.split("\n") if len(x) > 400 and len(x.split()) < len(x) / 12 and not x.lstrip().startswith(("//", "#", "*", "/*", "--")))
        if dense > 0.5 * size and dense > 800:
            return "minified"
    if program and len(code) > 400:
        body = code[len(head) :]
        solid = len("".join(body.split())) or 1
        data = 0
        for x in body.split("\n"):
            if len(x) > 100 or "\\x" in x:
                data += sum(len(m.group()) for m in _BLOB.finditer(x))
            elif _ROW.match(x) or re.fullmatch(r"\s*[\"']?[A-Za-z0-9+/]{40,}={0,2}[\"']?[,;+.]?\s*", x):
                data += len("".join(x.split()))
        if data > 0.6 * solid:
            return "data"
    return None


def merkle(files: DataFrame, least_files: int = 2, least_size: int = 400) -> DataFrame:
    """(file_id): files in a subtree that two unrelated repositories share, leaf for leaf and name for name.

    files: id, path, repo_id, leaf (long, see leaf(); null if there is no text), size, hash (of the raw content, used where leaf is null). A subtree counts from least_files files
    on; a single file by its leaf alone, whatever its name, from least_size characters on. Bottom-up, a level of the directory tree at a time: each file or directory hands
    (count, sum of hashes of name and content) to its parent, pre-aggregated before the shuffle. Repositories are unrelated if their names without the
    closing hash differ. Rows with null path, or without leaf and hash, take no part.
    """
    own = files.where("id is not null and path is not null and (leaf is not null or hash is not null)").select(
        F.col("id"), F.coalesce("repo_id", F.lit("")).alias("repo"), F.split(F.regexp_replace("path", r"[\\/]+", "/"), "/").alias("p"), "leaf", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce(F.col("leaf").cast("string"), F.lower("hash")).alias("hash")
    )
    depth = own.agg(F.max(F.size("p"))).head()[0] or 0

    def part(n: int):
        return F.array_join(F.slice("p", 1, n), "/")

    def entry(name, *content):
        return F.xxhash64(name, *content), F.xxhash64(F.lit(7), name, *content)

    levels, below = [], None
    for n in range(depth - 1, 0, -1):  # directories of n parts
        h1, h2 = entry(F.element_at("p", n + 1), F.lit("f"), F.col("hash"))
        rows = own.where(F.size("p") == n + 1).select("repo", part(n).alias("dir"), F.lit(1).cast("long").alias("k"), h1.cast("decimal(38,0)").alias("a"), h2.cast("decimal(38,0)").alias("b"))
        if below is not None:
            name = F.element_at(F.split("dir", "/"), -1)
            g1, g2 = entry(name, F.lit("d"), F.col("k"), F.col("a").cast("string"), F.col("b").cast("string"))
            rows = rows.unionByName(below.select("repo", F.expr("substring_index(dir, '/', size(split(dir, '/')) - 1)").alias("dir"), "k", g1.cast("decimal(38,0)").alias("a"), g2.cast("decimal(38,0)").alias("b")))
        below = rows.groupBy("repo", "dir").agg(F.sum("k").alias("k"), F.sum("a").cast("decimal(38,0)").alias("a"), F.sum("b").cast("decimal(38,0)").alias("b"))
        levels.append(below)
    stem = F.regexp_replace("repo", "-[0-9a-f]{8}$", "")
    # only the smallest and greatest repository of each hash are kept: two different ones are enough
    single = own.where((F.col("size") >= least_size) & F.col("leaf").isNotNull())
    twice = single.groupBy("leaf", "size").agg(F.min(stem).alias("lo"), F.max(stem).alias("hi")).where("lo != hi").select("leaf", "size")
    copies = single.join(twice, ["leaf", "size"], "left_semi").select(F.col("id").alias("file_id"))
    if not levels:
        return copies.distinct()
    dirs = levels[0]
    for x in levels[1:]:
        dirs = dirs.unionByName(x)
    dirs, _ = materialize(dirs.where(F.col("k") >= least_files), "merkle")  # read twice, narrow
    shared = dirs.groupBy("k", "a", "b").agg(F.min(stem).alias("lo"), F.max(stem).alias("hi")).where("lo != hi").select("k", "a", "b")
    hot = dirs.join(shared, ["k", "a", "b"], "left_semi").select("repo", "dir").distinct()
    prefixes = own.select("id", "repo", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("p") - 1)), lambda n: F.array_join(F.slice("p", F.lit(1), n), "/"))).alias("dir"))
    return prefixes.join(hot, ["repo", "dir"], "left_semi").select(F.col("id").alias("file_id")).unionByName(copies).distinct()


JUDGED = "id long, reason string, leaf long, size long"


def not_by_hand(files: DataFrame, symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """(file_id, reason) of the files that were not written by hand, each once. Files without code are judged by place and name alone; empty tables give no row.

    One pass over the files' texts gives each one's own reason and its Merkle leaf, written once as a narrow table; the trees are built on that.
    """
    own = files.select("id", "path", "ext", "repo_id", "hash").where("id is not null").dropDuplicates(["id"])
    whole = symbols.where("kind = 'file'").select(F.col("id").alias("symbol_id"), "file_id").distinct()
    code = whole.join(chunks.select("symbol_id", "code"), "symbol_id").select("file_id", "code")
    rows = own.join(code, own["id"] == code["file_id"], "left").select(F.col("id").cast("long").alias("id"), "path", "ext", "repo_id", "code", "hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            why, leaves, sizes = [], [], []
            for path, ext, repo, text in zip(*(b.column(c).to_pylist() for c in range(1, 5))):
                why.append(judge(path, ext, text, repo))
                x, n = leaf(text, header(text or ""))
                leaves.append(x)
                sizes.append(n)
            out = [b.column(0), pa.array(why, pa.string()), pa.array(leaves, pa.int64()), pa.array(sizes, pa.int64()), b.column(1), b.column(3), b.column(5)]
            yield pa.RecordBatch.from_arrays(out, ["id", "reason", "leaf", "size", "path", "repo_id", "hash"])

    judged, _ = materialize(rows.mapInArrow(run, JUDGED + ", path string, repo_id string, hash string"), "judged")
    copies = merkle(judged).select("file_id", F.lit("vendored").alias("reason"))
    mine = judged.where("reason is not null").select(F.col("id").alias("file_id"), "reason")
    return mine.unionByName(copies).groupBy("file_id").agg(F.min("reason").alias("reason"))
