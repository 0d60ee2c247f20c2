import random

import numpy as np

from strataline.llm import prose
from strataline.llm.gbt import Gbt
from strataline.llm.prose_train import HOLDOUT

COMMON = [("en", w) for w in "the of and to a in is it that for was on are as with be this not but you we i or an from at have has which when if my they so by can will your".split()] + [("de", w) for w in "der die das und ist nicht ein wenn mit".split()]


def tables(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, word string"), spark.createDataFrame(COMMON + [(None, None)], "lang string, word string")


def test_statistics(spark):
    docs, common = tables(spark, [(1, "The cat sat.\r\n\nno end\n", "x"), (2, None, "x"), (3, "", "x"), (4, " \n\t", "x"), (1, "The cat sat.\r\n\nno end\n", "x"), (5, "!!", "x")])
    got = sorted(tuple(r) for r in prose.statistics(docs, common).collect())
    assert got[0] == got[1] == (1, 5, 2.8, round(1 / 15, 6), 0.5, 0.2)
    assert [r[1:] for r in got[2:5]] == [(0, 0.0, 0.0, 0.0, 0.0)] * 3 and got[5] == (5, 0, 0.0, 1.0, 1.0, 0.0)
    assert prose.statistics(docs.limit(0), common).collect() == []


def test_verdicts(spark):
    cases = [t for t in HOLDOUT if len(t[1]) > 30]
    docs, common = tables(spark, [(i, t, "x") for i, (_, t) in enumerate(cases)])
    got = {r.doc_id: r.prose_share >= 0.5 for r in prose.shares(docs, common).collect()}
    assert sum(got[i] == bool(w) for i, (w, _) in enumerate(cases)) >= 0.85 * len(cases)


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n ", "x"), (4, "x " * 200_000, "x"), (5, "This is a sentence that we wrote for the test of the long text. " * 5000, "x"), (5, "y.", "x")]
    docs, common = tables(spark, rows)
    got = [(r.doc_id, r.prose_share) for r in prose.shares(docs, common).collect()]
    assert len(got) == 6 and [s for i, s in sorted(got)[:3]] == [-1.0] * 3 and dict(sorted(got, key=lambda x: x[1]))[5] >= 0.5
    assert prose.shares(docs.limit(0), common).collect() == []


def test_trees_learn_and_calibrate():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    g = Gbt.train(x[:2000], y[:2000], trees=40, depth=3)
    g.calibrate(x[2000:2500], y[2000:2500])
    assert (((g.probability(x[2500:]) > 0.5) == y[2500:]).mean()) > 0.97


def test_long_lines_are_cut_at_sentences():
    random.seed(1)
    t = "Hello there my friend. " * 100
    assert " ".join(prose.units(t)).split() == t.split() and max(map(len, prose.units(t))) < 300
