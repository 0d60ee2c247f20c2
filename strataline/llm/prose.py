"""Text quality statistics, and running prose told from lists, tables and junk.

The statistics of a document are expressions of the JVM. For the verdict the same kind of statistics is taken of every line together
with its paragraph, gradient-boosted trees turn them into a calibrated probability that the line belongs to written sentences, and a document
is prose if at least half of its non-space characters stand in such lines. Whole texts are read, whatever their length.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.llm.gbt import Gbt

MODEL = os.path.join(os.path.dirname(__file__), "prose_model.json")
MAX_COMMON = 10_000  # the word list is checked against this bound before it goes to all workers

#: Articles of four languages; a frequent word right after one is out of place.
ARTICLES = set("the a an der die das ein eine le la les un une el los las una".split())
WORD = r"[\p{L}\p{N}_]+"


def statistics(docs: DataFrame, common: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, word_count, mean_word_len, symbol_ratio, punct_line_share, common_share), a row for each row of docs.

    word: a run of letters, digits and _. symbol_ratio: other non-space characters by non-space characters. punct_line_share: of
    non-blank lines (\\n, \\r\\n or \\r) those ending in . ! ? : ; … 。 ！ ？ (closing quotes and brackets aside). common_share: words that are, in lower
    case, in common. Null, empty and blank texts have 0 throughout.
    """
    words = common_words(common)
    t = F.coalesce(F.col(text), F.lit(""))
    w = F.expr(f"regexp_extract_all(coalesce(`{text}`, ''), r'{WORD}', 0)")
    lines = F.filter(F.split(t, r"\r\n|\n|\r"), lambda x: F.length(F.regexp_replace(x, r"\s", "")) > 0)
    d = docs.select(F.col(key), w.alias("w"), lines.alias("lines"), F.length(F.regexp_replace(t, r"\s", "")).alias("n"), F.length(F.regexp_replace(t, r"[\s\p{L}\p{N}_]", "")).alias("sym"))
    n = F.size("w")

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, F.round(a / b, 6)).otherwise(F.lit(0.0))

    return d.select(
        key,
        n.cast("long").alias("word_count"),
        share(F.aggregate("w", F.lit(0), lambda a, x: a + F.length(x)), n).alias("mean_word_len"),
        share(F.col("sym"), F.col("n")).alias("symbol_ratio"),
        share(F.size(F.filter("lines", lambda x: x.rlike("[.!?:;…。！？][\"'”’»)\\]]*\\s*$"))), F.size("lines")).alias("punct_line_share"),
        share(F.size(F.filter("w", lambda x: F.lower(x).isin(sorted(words)))), n).alias("common_share"),
    )


def common_words(common: DataFrame) -> set[str]:
    """The distinct words in lower case; raises if there are more than MAX_COMMON."""
    rows = common.where("word is not null").select(F.lower("word").alias("word")).distinct().limit(MAX_COMMON + 1).collect()
    if len(rows) > MAX_COMMON:
        raise ValueError(f"more than {MAX_COMMON} common words")
    return {r.word for r in rows}


_W = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_LINES = re.compile(r"\r\n|\n|\r|\x85|\u2028|\u2029")
_LEAD = re.compile(r"^(?:[>|]\s?)+|^\s*(?:\d{1,3}[.)]|[QA]:|[a-z]\))\s+")
_BULLET = re.compile(r"^\s*(?:[-*+•→·▪◦–—]|\[[ xX]\])\s")
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,80}>")
_CELL = re.compile(r"</?(?:t[rdh]|table|li|ul|ol|nav|script|option)\b", re.I)
_IDENT = re.compile(r"[a-z0-9]+[A-Z]\w*|\w+_\w+|\w+(?:\.\w+)+\(?|\w+\(|[\w.\-]*/[\w./\-]+|--?\w{2,}=|\w+=\S")
_TICK = re.compile(r"`[^`\n]*`")
_TIME = re.compile(r"^\W{0,2}(?:\d{4}-\d\d-\d\d|\d\d:\d\d:\d\d|\[?\d+\.\d+\]|(?:ERROR|WARN(?:ING)?|INFO|DEBUG|TRACE|FATAL)\b[:\s\]]|[EWI]\d{4} |\[(?:ERROR|WARN|INFO|DEBUG)|at \w+[.(]|npm |\+\d)")
_CJK = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
_END = re.compile(r"(?:[.!?…。！？:]|[.!?] ?[:;]-?[)(]| \.{2,3})[\"'”’»)\]`*_]*$")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])")
_CODE_END = re.compile(r"(?:[;{},\\]|\(\)|=>|\)\s*:)$")
_BOX = re.compile(r"[│├└┌┐┘─┬┴┼║═╔╗╚╝]")
_HARD = re.compile(r"[bcdfghjklmnpqrstvwxz]{5,}", re.I)
_MARKS, _UPPER = re.compile(r"[\W_]"), re.compile("[A-Z]")
_IDENT_HINT = re.compile(r"\.\w|[a-z0-9][A-Z]")
_RUN = re.compile(r"((\S)\2{4,})")
NAMES = (
    "words word_len symbols digits capitals common common_pairs odd end capital commas idents cjk particles bullet pipes braces time unique hard repeat code_end cells box lead "
    "p_common p_symbols p_words p_idents p_ends p_lines p_unique p_chars d_common d_dup"
).split()


def line_stats(line: str, common: set[str]) -> tuple[list[float], int]:
    """The statistics of one line, and its number of non-space characters."""
    n = len("".join(line.split()))
    cells = float(bool(_CELL.search(line)))
    lead = _LEAD.search(line)
    core = _LEAD.sub("", line)
    bullet = float(bool(_BULLET.match(core)))
    core = _BULLET.sub("", core)
    if "<" in core:
        core = _TAG.sub(" ", core)
    core = core.strip()
    plain = _TICK.sub(" x ", core)
    words = _W.findall(plain)
    low = plain.lower()
    low = _W.findall(low) if len(low) == len(plain) else [w.lower() for w in words]
    k = len(words) or 1
    hit = [w in common for w in low]
    pairs = odd = 0
    before = ""
    seen = False
    for w, h in zip(low, hit):
        if h and before:
            pairs += seen
            odd += before in ARTICLES or before == w
        before, seen = w, h
    m = len(core) or 1
    ascii_only = core.isascii()  # spares the look at each character
    cjk = [] if ascii_only else _CJK.findall(core)
    solid = "".join(core.split())
    s = len(solid) or 1
    alnum = len(solid) - len(_MARKS.findall(solid))
    digits = sum(map(solid.count, "0123456789")) if ascii_only else sum(map(str.isdigit, solid))
    upper = len(_UPPER.findall(solid)) if ascii_only else sum(map(str.isupper, solid))
    idents = sum(map(len, _IDENT.findall(plain))) if "_" in plain or "/" in plain or "(" in plain or "=" in plain or _IDENT_HINT.search(plain) else 0
    repeat = max((len(g[0]) for g in _RUN.findall(core)), default=0) if n > 4 and any(c * 5 in solid for c in set(solid)) else 0
    pair_repeat = s - len(set(zip(solid, solid[1:]))) if s > 60 else 0
    hard = sum(bool(_HARD.search(w)) for w in words) if _HARD.search(plain) else 0
    return [
        float(len(words)), sum(map(len, words)) / k, 1 - alnum / s, digits / s, upper / s, sum(hit) / k, pairs / k, max(0, odd - 1) / k,
        float(bool(_END.search(core))), float(core[:1].isupper() or core[:1] in "\"'“«¿¡"), plain.count(",") / k, idents / m, len(cjk) / s, sum(c in common for c in cjk) / (len(cjk) or 1), bullet, core.count("|") / k,
        sum(map(core.count, "{}[]=<>")) / m, float(bool(_TIME.match(core))), len(set(low)) / k, hard / k, repeat / m + (pair_repeat / s > 0.95 and s > 60), float(bool(_CODE_END.search(core))), cells, (0 if line.isascii() else len(_BOX.findall(line))) / (n or 1), float(bool(lead)),
    ], n


def units(line: str) -> list[str]:
    """A long line at sentence ends in parts of some 200 characters, so that statistics don't depend on how a text is wrapped."""
    if len(line) <= 300:
        return [line]
    out = [""]
    for x in _SENTENCE.split(line):
        if len(out[-1]) >= 200:
            out.append(x)
        else:
            out[-1] += " " * bool(out[-1]) + x
    return [x for x in out if x.strip()]


def document_lines(text: str, common: set[str]) -> tuple[list[list[float]], list[int]]:
    """Statistics and non-space characters of each non-blank line."""
    x: list[list[float]] = []
    size: list[int] = []
    part: list[list[float]] = []
    lens: list[int] = []

    def close() -> None:
        if part:
            total = sum(lens)
            mean = [sum(r[i] * z for r, z in zip(part, lens)) / total for i in (5, 2, 0, 11, 8)]
            words = [sum(r[0] for r in part), sum(r[0] * r[18] for r in part)]
            extra = [*mean, float(len(part)), words[1] / (words[0] or 1), float(total)]
            x.extend(r + extra for r in part)
            size.extend(lens)
            part.clear()
            lens.clear()

    lines = _LINES.split(text)
    for line in lines:
        if not line.strip() or line.strip() in (">", "|"):
            close()
            continue
        for u in units(line):
            r, n = line_stats(u, common)
            part.append(r)
            lens.append(n)
    close()
    total = sum(size) or 1
    whole = sum(r[5] * n for r, n in zip(x, size)) / total
    filled = [y for y in lines if y.strip()]
    dup = 1 - len(set(filled)) / (len(filled) or 1)
    return [[*r, whole, dup] for r in x], size


@lru_cache(maxsize=1)
def model(path: str) -> Gbt:
    return Gbt.load(path)


def prose_shares(texts: list[str | None], common: set[str], path: str = MODEL) -> list[float]:
    """Of each text the share of non-space characters in written sentences; -1 for null, empty and blank texts."""
    rows, sizes, at = [], [], []
    for t in texts:
        x, n = document_lines(t, common) if t and not t.isspace() else ([], [])
        rows += x
        sizes += n
        at.append(len(x))
    if not rows:
        return [-1.0] * len(texts)
    good = (model(path).probability(np.array(rows)) >= 0.5) * np.array(sizes)
    out, i = [], 0
    for k in at:
        total = sum(sizes[i : i + k])
        out.append(float(good[i : i + k].sum() / total) if total else -1.0)
        i += k
    return out


def shares(docs: DataFrame, common: DataFrame, key: str = "doc_id", text: str = "text", path: str = MODEL) -> DataFrame:
    """(key, prose_share double) of every row of docs, repeats included; -1 where there is nothing to judge. An empty table gives no row."""
    words = common_words(common)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 400):
                part = b.slice(i, 400)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prose_shares(part.column(1).to_pylist(), words, path), pa.float64())], [key, "prose_share"])

    return docs.select(F.col(key), F.col(text).alias("t")).mapInArrow(run, f"`{key}` {kind}, prose_share double")
