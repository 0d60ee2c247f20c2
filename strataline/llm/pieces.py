"""Splitting oversized items at natural boundaries, by byte ranges.

An item is cut into ranges of ``range_bytes``. A worker sees one range with a halo on either side, never the whole item:

1. the border between two ranges is moved to the best natural boundary within the halo after its nominal place; both
   neighbours see those bytes and so agree on it;
2. inside its borders each worker cuts greedily at the best boundary of the last half of the room a piece has;
3. the tables of cuts are stitched: a running sum of the ranges' counts numbers the pieces (a window over ranges, not over pieces);
4. pieces are emitted by offset, again from ranges with halos. In an item of one range the numbers are known at once, so that its text is never shuffled.

Boundaries, best first: an empty line before unindented text, any empty line, a line end before unindented text, any line
end, blank or ; or , , any whole character.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataline.session import materialize

LIMIT, OVERLAP, RANGE = 2_000, 200, 65_536


def _rank(b: bytes, i: int, floor: int) -> int:
    """How good a cut before byte i of b is: 5 best, 0 inside a line, -1 inside a character. Looks at no byte before floor, so that neighbours agree."""
    if i >= len(b):
        return 5
    if b[i] & 0xC0 == 0x80:
        return -1
    if b[i - 1] == 10:
        open_line = b[i] not in b" \t\r\n"
        j = b.rfind(b"\n", floor, i - 1)
        if j >= 0 and not b[j + 1 : i - 1].strip():
            return 5 if open_line else 4
        return 3 if open_line else 2
    if b[i - 1] == 13 and b[i] != 10:
        return 2
    return 1 if b[i - 1] in b" \t;," else 0


def best_cut(b: bytes, lo: int, hi: int) -> int:
    """The best place to cut in lo < place <= hi, the last of equals; hi at least lo + 4 finds a whole character."""
    top, at = -1, hi
    i = hi
    line = b.rfind(b"\n", lo, hi)
    if line >= 0:  # only line starts can be better than 2
        while line >= 0:
            r = _rank(b, line + 1, lo)
            if line + 1 > lo and r > top:
                top, at = r, line + 1
            if top == 5:
                break
            line = b.rfind(b"\n", lo, line)
        if top >= 2:
            return at
    while i > lo:
        r = _rank(b, i, lo)
        if r > top:
            top, at = r, i
            if r >= 1:
                break
        i -= 1
    return at


def align(b: bytes, i: int) -> int:
    """i or the next start of a character."""
    while i < len(b) and b[i] & 0xC0 == 0x80:
        i += 1
    return i


def cut_range(b: bytes, off: int, n: int, lo: int, hi: int, limit: int, overlap: int, halo: int) -> list[tuple[int, int, int]]:
    """(begin with overlap, begin of new bytes, end) of each piece of range lo..hi of an item of n bytes; b holds its bytes from off on."""

    def border(x: int) -> int:
        return x if x in (0, n) else off + best_cut(b, x - off, min(x + halo, n) - off)

    begin, end = border(lo), border(hi)
    out = []
    while begin < end:
        room = limit if begin == 0 else limit - overlap
        stop = end if end - begin <= room else off + best_cut(b, begin - off + room // 2, begin - off + room)
        out.append((begin if begin == 0 else off + align(b, max(begin - overlap, 0) - off), begin, stop))
        begin = stop
    return out


def _check(limit: int, overlap: int, range_bytes: int) -> int:
    if not (0 <= overlap and limit - overlap >= 16):
        raise ValueError("limit must be at least 16 more than overlap")
    halo = limit - overlap
    if range_bytes < 4 * limit:
        raise ValueError("range_bytes must be at least 4 times limit")
    return halo


def ranges(items: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = RANGE) -> DataFrame:
    """(key, n, k, off, slice): each item above the limit as ranges with halos; the JVM cuts the slices."""
    halo = _check(limit, overlap, range_bytes)
    b = items.where(F.col(key).isNotNull() & (F.octet_length(text) > limit)).select(F.col(key).alias("key"), F.encode(F.col(text), "UTF-8").alias("b"), F.octet_length(text).alias("n"))
    k = b.select("key", "b", "n", F.explode(F.sequence(F.lit(0), F.expr(f"cast((n - 1) div {range_bytes} as int)"))).alias("k"))
    off = F.greatest(F.lit(0), F.col("k") * range_bytes - overlap - 8)
    return k.select("key", "n", "k", off.alias("off"), F.substring("b", off + 1, range_bytes + overlap + 8 + 2 * halo + 8).alias("slice"))


CUTS = "key long, n int, k int, j int, first int, begin int, stop int"


def cuts(rows: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = RANGE, emit: bool = False) -> DataFrame:
    """The boundary table: one row a piece with its range k and its place j in the range; with emit also its text."""
    halo = _check(limit, overlap, range_bytes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            out = []
            for key, n, k, off, b in zip(t["key"], t["n"], t["k"], t["off"], t["slice"]):
                b = bytes(b)
                found = cut_range(b, off, n, k * range_bytes, min(n, (k + 1) * range_bytes), limit, overlap, halo)
                out += [(key, n, k, j, *x, *([b[x[0] - off : x[2] - off].decode("utf-8", "replace")] if emit else [])) for j, x in enumerate(found)]
            yield pd.DataFrame(out, columns=["key", "n", "k", "j", "first", "begin", "stop"] + ["piece"] * emit)

    return rows.mapInPandas(run, CUTS + ", piece string" * emit)


def stitched(counts: DataFrame) -> DataFrame:
    """(key, k, base): how many pieces the ranges before range k have. counts: (key, k, m), a row a range."""
    return counts.select("key", "k", F.coalesce(F.sum("m").over(Window.partitionBy("key").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))


def pieces(items: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = RANGE) -> DataFrame:
    """(key, piece_no, first, begin, stop, piece) of every item of more than limit bytes.

    items: key (a long, unique; null keys are left out) and text; null and short texts give no row, an empty table none. first..stop are
    the piece's bytes in the item, begin where its new bytes start: begin..stop of all pieces give the item back. Columns other than key
    and text are ignored.
    """
    columns = ["key", "piece_no", "first", "begin", "stop", "piece"]
    r = ranges(items, key, text, limit, overlap, range_bytes)
    one = cuts(r.where(F.col("n") <= range_bytes), limit, overlap, range_bytes, emit=True).withColumn("piece_no", F.col("j"))
    many = r.where(F.col("n") > range_bytes)
    base = stitched(cuts(many, limit, overlap, range_bytes).groupBy("key", "k").agg(F.count("*").alias("m")))
    c = cuts(many, limit, overlap, range_bytes, emit=True).join(base, ["key", "k"]).withColumn("piece_no", (F.col("base") + F.col("j")).cast("int"))
    return one.select(*columns).unionByName(c.select(*columns))


def _read(path: str, off: int, n: int) -> bytes:
    """n bytes from off on of a file on any file system that workers reach (a URI, or a path of a mounted one)."""
    fs, name = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    with fs.open_input_file(name) as f:
        return f.read_at(n, off)


def file_cuts(files: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = 8 << 20) -> DataFrame:
    """The boundary table of files on a shared file system: rows (key long, path, n bytes); each task reads its byte range and halo only."""
    halo = _check(limit, overlap, range_bytes)
    r = files.where(f"n > {limit}").select("key", "path", F.col("n").cast("long").alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {range_bytes}"))).alias("k"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            for key, path, n, k in zip(t["key"], t["path"], t["n"], t["k"]):
                off = max(0, k * range_bytes - overlap - 8)
                b = _read(path, off, min(n - off, range_bytes + overlap + 8 + 2 * halo + 8))
                found = cut_range(b, off, n, k * range_bytes, min(n, (k + 1) * range_bytes), limit, overlap, halo)
                yield pd.DataFrame([(key, path, k, j, *x) for j, x in enumerate(found)], columns=["key", "path", "k", "j", "first", "begin", "stop"])

    # range borders are spread over tasks whatever file they belong to
    return r.repartition("key", "k").mapInPandas(run, "key long, path string, k long, j int, first long, begin long, stop long")


def file_pieces(files: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = 8 << 20) -> DataFrame:
    """(key, piece_no, first, begin, stop, piece) as pieces() gives them, of files that are never read whole: boundary tables of ranges, stitched, then emission by offset.

    files: (key long, path, n), n the file's size in bytes. Files of limit bytes or less and null rows give no row. Of a range's pieces one stretch is read at a time.
    """
    c, _ = materialize(file_cuts(files, limit, overlap, range_bytes), "cuts")  # narrow, read twice
    base = stitched(c.groupBy("key", "k").agg(F.count("*").alias("m")))
    at = c.join(base, ["key", "k"]).select("key", "path", (F.col("base") + F.col("j")).alias("piece_no"), "first", "begin", "stop")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            t["piece"] = [_read(p, a, z - a).decode("utf-8", "replace") for p, a, z in zip(t["path"], t["first"], t["stop"])]
            yield t[["key", "piece_no", "first", "begin", "stop", "piece"]]

    return at.mapInPandas(run, "key long, piece_no long, first long, begin long, stop long, piece string")
