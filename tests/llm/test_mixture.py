from collections import Counter

import pytest

from strataline.llm.mixture import fill, mixture

TARGETS = "source string, target_share double, max_repeats int, n_tokens int"


def test_fill():
    assert fill({"a": 100, "b": 100}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 1}, 100) == {"a": 50, "b": 50}
    got = fill({"a": 10, "b": 1000}, {"a": 0.5, "b": 0.4, "c": 0.1}, {"a": 2, "b": 1, "c": 9}, 500)
    assert got == {"a": 20, "b": pytest.approx(480), "c": 0}
    assert fill({}, {"a": 1.0}, {"a": 1}, 0) == {"a": 0}


def run(spark, docs, targets, **kw):
    a = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long, target_share int")
    b = spark.createDataFrame(targets, TARGETS)
    rec, rep = mixture(a, b, **kw)
    return rec.collect(), {r.source: r for r in rep.collect()}


def test_shares_repeats_and_spread(spark):
    docs = [(i, ["Web", " web ", "WEB"][i % 3], 50 + i % 90, 0) for i in range(6000)] + [(10_000 + i, "books", 100, 0) for i in range(100)] + [(20_000 + i, None if i % 2 else "other", 100, 0) for i in range(500)]
    docs += [(30_000 + i, "wiki", 80 + i % 50, 0) for i in range(900)] + [(40_000, "wiki", 0, 0)]
    rec, rep = run(spark, docs, [("web", 0.6, 1, 0), ("Books", 0.1, 3, 0), ("wiki", 0.25, 9, 0), ("none", 0.05, 2, 0), (None, 0.5, 1, 0)], slots=2000, bucket_rows=500)
    total = sum(d[2] for d in docs)
    drawn = sum(r.n_tokens for r in rec)
    assert abs(drawn / total - 1) < 0.02
    most = Counter(r.doc_id for r in rec)
    assert max(c for i, c in most.items() if i < 10_000) == 1 and max(c for i, c in most.items() if 10_000 <= i < 20_000) == 3 and not any(20_000 <= i < 30_000 for i in most)
    assert len({(r.doc_id, r.repeat_no) for r in rec}) == len(rec)
    # books can give 30 000 tokens at most, none nothing; the rest keeps its proportion
    assert rep["books"].drawn_tokens == 30_000 and rep["none"].drawn_tokens == 0
    assert rep["web"].share / rep["wiki"].share == pytest.approx(0.6 / 0.25, rel=0.03)
    first = [r for r in rec if r.slot < 400]
    got = sum(r.n_tokens for r in first if r.source == "web") / sum(r.n_tokens for r in first)
    assert abs(got - rep["web"].share) < 0.05


def test_edges(spark):
    rec, rep = run(spark, [], [("a", 1.0, 1, 0)])
    assert rec == [] and rep["a"].drawn_tokens == 0
    rec, rep = run(spark, [(1, "a", 5, 0)], [])
    assert rec == [] and rep == {}
    rec, rep = run(spark, [(1, "a", 500_000, 0), (2, "b", 3, 0)], [("a", 0.5, 1, 0), ("b", 0.5, 2, 0), ("b", 0.2, 1, 0), ("c", 0.0, None, 0)])
    assert Counter(r.doc_id for r in rec) == {1: 1, 2: 2}
