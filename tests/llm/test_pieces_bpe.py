import base64
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from strataline.llm import bpe, pieces


def check_pieces(text, rows, limit, overlap):
    b = text.encode()
    rows = sorted(rows, key=lambda r: r.piece_no)
    assert [r.piece_no for r in rows] == list(range(len(rows)))
    assert b"".join(b[r.begin : r.stop] for r in rows) == b
    for i, r in enumerate(rows):
        assert r.stop - r.first <= limit and r.piece.encode() == b[r.first : r.stop]
        if i:
            assert min(overlap - 3, r.begin) <= r.begin - r.first <= overlap and r.begin == rows[i - 1].stop
        else:
            assert r.first == r.begin == 0


@pytest.mark.parametrize("limit,overlap,size", [(200, 20, 800), (64, 48, 256), (2000, 200, 65536)])
def test_pieces_round_trip(spark, limit, overlap, size):
    rnd = random.Random(1)
    line = ["", "def f():", "    x = 'größe 🧭'", "}", "\tif a; b, c", "é" * 300, "q" * 500, "世界" * 90]
    texts = {i: rnd.choice(["\n", "\r\n", "\r"]).join(rnd.choice(line) for _ in range(rnd.randrange(1, 60))) for i in range(25)}
    texts |= {900: "🧭" * 9000, 901: "x" * 150_000, 902: "", 903: None}
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(None, "y" * 9999, "x")], "symbol_id long, code string, key string")
    by = {}
    for r in pieces.pieces(df, "symbol_id", "code", limit, overlap, size).collect():
        by.setdefault(r.key, []).append(r)
    assert set(by) == {i for i, t in texts.items() if t and len(t.encode()) > limit}
    for i, rows in by.items():
        check_pieces(texts[i], rows, limit, overlap)


def test_pieces_cut_where_code_breaks(spark):
    text = "".join(f"def f{i}():\n    return {i}\n\n" for i in range(200))
    df = spark.createDataFrame([(1, text)], "symbol_id long, code string")
    assert all(text[r.begin :].startswith("def") for r in pieces.pieces(df, "symbol_id", "code").collect())


def test_pieces_empty(spark):
    df = spark.createDataFrame([], "symbol_id long, code string")
    assert pieces.pieces(df, "symbol_id", "code").collect() == []


def test_files_are_cut_and_emitted_by_seeking(spark, tmp_path):
    body = "".join(f"def f{i}():\n    return 'ä{i}'\n\n" for i in range(3_000))
    rows = []
    for k, t in enumerate([body, "x" * 30_000 + "\n" + body[:5_000], "short", ""]):
        (tmp_path / f"{k}.py").write_bytes(t.encode())
        rows.append((k, f"file://{tmp_path}/{k}.py" if k % 2 else f"{tmp_path}/{k}.py", len(t.encode())))
    got = pieces.file_pieces(spark.createDataFrame(rows, "key long, path string, n long"), range_bytes=8_192).orderBy("key", "piece_no").collect()
    for k, t in enumerate([body, "x" * 30_000 + "\n" + body[:5_000]]):
        mine = [r for r in got if r.key == k]
        assert [r.piece_no for r in mine] == list(range(len(mine)))
        assert "".join(r.piece.encode()[r.begin - r.first :].decode() for r in mine) == t
        assert max(len(r.piece.encode()) for r in mine) <= pieces.LIMIT
        assert all(a.stop == b.begin for a, b in zip(mine, mine[1:]))
    assert {r.key for r in got} == {0, 1}


def test_file_ranges_equal_column_ranges(spark, tmp_path):
    text = "".join(f"line {i} größe\n" * (i % 3 + 1) for i in range(900))
    (tmp_path / "a").write_text(text)
    files = spark.createDataFrame([(1, str(tmp_path / "a"), len(text.encode()))], "key long, path string, n long")
    a = sorted(tuple(r)[4:] for r in pieces.file_cuts(files, range_bytes=8192).collect())
    df = spark.createDataFrame([(1, text)], "symbol_id long, code string")
    assert a == sorted((r.first, r.begin, r.stop) for r in pieces.pieces(df, "symbol_id", "code", range_bytes=8192).collect())


@pytest.fixture(scope="module")
def both():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own, split = bpe.encoder(bpe.VOCABULARY)
    return enc.encode_ordinary, lambda t: own.encode([t], split)[0]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_bpe_any_text(both, t):
    want, got = both
    assert got(t) == want(t)


@pytest.mark.parametrize("t", ["a" * 3000, "ab" * 900, "<|endoftext|>", "it's  \n\n x", "0123456789" * 50, "ffffi" * 99, "日本語" * 60, "getUserTokenFromHTTPResponseCache" * 4, " " * 500 + "x"])
def test_bpe_hard_text(both, t):
    want, got = both
    assert got(t) == want(t)


def test_bpe_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "hello <|endoftext|>", "x"), (3, "hello <|endoftext|>", "x")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in bpe.encode(df).collect())
    assert got[:2] == [(1, []), (2, [])] and got[2] == got[3] and len(got[2][1]) > 3
    assert bpe.encode(df.limit(0)).collect() == []
    assert {r.n_tokens for r in bpe.encode(df.limit(2), count_only=True).collect()} == {0}
