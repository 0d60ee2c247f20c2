"""Fits the model of prose.py: python -m strataline.llm.prose_train DIR [OUT].

The rows are lines of at most SAMPLE documents of DIR/documents.parquet (every k-th by a hash of doc_id), weakly labelled by the rules of weak();
lines no rule is sure of are left out. The probabilities are calibrated on HOLDOUT, lines and labels checked by hand.
"""

from __future__ import annotations

import sys
import zlib

import numpy as np
import pandas as pd

from strataline.llm.gbt import Gbt
from strataline.llm.prose import MODEL, NAMES, document_lines

SAMPLE, SEED = 4_000, 11
N = {n: i for i, n in enumerate(NAMES)}

#: Checked by hand: 1 written sentences, 0 not.
HOLDOUT = [
    (1, "We looked at the report again and found that the second run is slower than the first one."), (1, "> I think this is fine, but please wait for the tests\n> before you merge it."), (1, "Das Verzeichnis wird nur gelesen, wenn sich die Datei geändert hat."), (1, "Nous avons corrigé l'erreur, et le test passe maintenant sur toutes les machines."),
    (1, "El archivo no se vuelve a leer si el contenido es el mismo que antes."), (1, "如果文件没有改变，就不需要再读一次。"), (1, "この設定は古いので、次の版で削除する予定です。"), (1, "1. Open the settings and choose the folder that holds your notes.\n2. Wait until the list is complete before you close the window."),
    (1, "thanks for the quick answer, i will try it tomorrow and let you know how it went"), (1, "Q: Why does it take so long?\nA: Because every file is read twice when the cache is empty."), (1, "<p>The old page stays online until the end of the year, after that it will be removed.</p>"), (1, "It works."), (1, "Sorry, that was my mistake!"),
    (1, "This line was wrapped by the mail program so that it\nends in the middle of a sentence, and goes on in the\nnext one until it is done."), (1, "You can call `readFile` from the worker, but never from the main thread, because it blocks."), (1, "Could somebody explain what this value means and who sets it?"), (1, "Am Ende war es nur ein Tippfehler, den niemand gesehen hat."),
    (1, "She said that the numbers were right, although nobody had checked them for a year."), (1, "in short, it is slower but safer, and we can live with that"), (1, "La página se muestra vacía aunque los datos ya están cargados."),
    (0, "- apples\n- pears\n- plums\n- cherries"), (0, "* readFile\n* writeFile\n* close all handles"), (0, "| name | size |\n|------|------|\n| a    | 12   |"), (0, "2024-01-02 10:11:12 ERROR worker failed with code 7"), (0, "for (let i = 0; i < n; i++) {\n  total += values[i];\n}"), (0, "{\"a\":1,\"b\":[1,2,3],\"c\":null}"), (0, "Home | About | Contact | Imprint | Login"),
    (0, "xkcdq wrtzz plmkn qqrst vvbnm zzxcd"), (0, "the of and to in is the of it for and the in of to"), (0, "12,44,0.34,17\n13,45,0.77,18\n14,46,0.12,19"), (0, "=================================================="), (0, "src/\n├── main.py\n└── util.py"), (0, "blue car, red house, green tree, old dog, new cat, big ship, small boat, tall man"), (0, "<table><tr><td>one</td><td>2</td></tr></table>"),
    (0, "Traceback (most recent call last):\n  File \"a.py\", line 3, in <module>\n    main()"), (0, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"), (0, "00000000  67 d7 2d 7b 45 ba dd a7  04 b2 91 98 d6 5c 44 41"), (0, "KEY=value\nOTHER=12\nTHIRD=\"x y\""), (0, "Added: new button (#12)\nFixed: old crash (#13)\nRemoved: flag (#14)"), (0, "getUser\nsetUser\ndeleteUser\nlistUsers"),
    (0, "┌────┬────┐\n│ a  │ b  │\n└────┴────┘"), (0, "☐ tests ☐ docs ☐ release ☐ tag"), (0, "SELECT a, b FROM t WHERE c = 3 ORDER BY a;"), (0, "Next Previous Home Search Menu Share Login Docs"),
]


def weak(r: list[float]) -> int:
    """1 surely prose, 0 surely not, -1 unsure."""
    v = {n: r[i] for n, i in N.items()}
    if v["box"] > 0.05 or v["cells"] or v["time"] or v["code_end"] and v["idents"] + v["braces"] > 0.08 or v["braces"] > 0.12 or v["pipes"] > 0.3 or v["repeat"] > 0.4:
        return 0
    if v["symbols"] > 0.3 and v["cjk"] < 0.1 or v["digits"] > 0.3 or v["hard"] > 0.3 or v["idents"] > 0.6 and v["words"] < 6:
        return 0
    if v["words"] >= 10 and (v["odd"] >= 0.05 or v["common"] > 0.5 and not v["capital"] and v["common_pairs"] > 0.35 and not v["commas"] and v["odd"] > 0.02) and v["cjk"] < 0.1:
        return 0
    if v["cjk"] < 0.1 and v["words"] >= 8 and v["common"] == 0:
        return 0
    if v["bullet"] and v["words"] <= 4 and v["common"] < 0.3:
        return 0
    if v["cjk"] < 0.1 and v["words"] <= 3 and v["p_words"] <= 3.5 and v["p_lines"] >= 4:
        return 0
    if v["cjk"] > 0.5 and v["symbols"] < 0.15 and v["particles"] > 0.05:
        return 1
    if v["words"] >= 6 and 0.12 <= v["common"] <= (0.8 if v["capital"] and v["end"] else 0.6) and v["odd"] <= 0.03 and v["symbols"] < 0.14 and v["idents"] < 0.3 and v["digits"] < 0.15 and v["commas"] < 0.25 and not v["code_end"] and not v["bullet"] and (v["end"] and v["capital"] or v["p_common"] > 0.12) and (v["end"] or v["p_ends"] > 0.15 or v["p_words"] > 9):
        return 1
    return -1


def fit(directory: str) -> Gbt:
    common = {w.lower() for w in pd.read_parquet(f"{directory}/common_words.parquet").word.dropna()}
    docs = pd.read_parquet(f"{directory}/documents.parquet", columns=["doc_id", "text"]).dropna().drop_duplicates("doc_id")
    docs = docs.assign(h=[zlib.crc32(b"%d" % i) for i in docs.doc_id]).sort_values("h").head(SAMPLE)
    rows = [r for t in docs.text if t.strip() for r in document_lines(t, common)[0]]
    lab = np.array([weak(r) for r in rows])
    x, y = np.array(rows)[lab >= 0], lab[lab >= 0]
    rng = np.random.default_rng(SEED)
    # the rules must not be learnt as such: single statistics are blurred at random
    blur = rng.random(x.shape) < 0.06
    x = np.where(blur, x[rng.permutation(len(x))], x)
    print(f"{len(docs)} documents, {len(rows)} lines, {len(x)} labelled, {y.mean():.3f} prose")
    gbt = Gbt.train(x, y.astype(float))
    hx, hy = [], []
    for want, text in HOLDOUT:
        own = document_lines(text, common)[0]
        hx += own
        hy += [want] * len(own)
    gbt.calibrate(np.array(hx), np.array(hy, float))
    p = gbt.probability(np.array(hx))
    print(f"holdout: {((p >= 0.5) == np.array(hy)).mean():.3f} of {len(hy)} lines right, a={gbt.a:.2f}, b={gbt.b:.2f}")
    return gbt


if __name__ == "__main__":
    fit(sys.argv[1]).save(sys.argv[2] if len(sys.argv) > 2 else MODEL)
