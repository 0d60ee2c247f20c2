"""A linear-chain conditional random field in numpy: training by Adam on the exact likelihood, Viterbi decoding."""

from __future__ import annotations

import json

import numpy as np


NONE = -1e12


class Crf:
    """Labels are 0..k-1. A sequence is a list of tokens, a token a list of feature names."""

    def __init__(self, k: int, index: dict[str, int], w: np.ndarray, t: np.ndarray, start: np.ndarray) -> None:
        self.k, self.index, self.w, self.t, self.start = k, index, w, t, start
        self.t_list, self.start_list = t.tolist(), start.tolist()

    @classmethod
    def train(cls, data: list[tuple[list[list[str]], list[int]]], k: int, epochs: int = 120, l2: float = 2e-6, rate: float = 0.08, least: int = 3) -> "Crf":
        count: dict[str, int] = {}
        for seq, _ in data:
            for token in seq:
                for f in token:
                    count[f] = count.get(f, 0) + 1
        index = {f: i for i, f in enumerate(sorted(f for f, c in count.items() if c >= least))}
        data = sorted((d for d in data if d[0]), key=lambda d: -len(d[0]))
        n, longest = len(data), len(data[0][0])
        lengths = np.array([len(s) for s, _ in data])
        ids, sizes, place, gold = [], [], [], []
        for r, (seq, lab) in enumerate(data):
            for c, token in enumerate(seq):
                own = [index[f] for f in token if f in index] or [0]
                ids += own
                sizes.append(len(own))
                place.append((r, c))
                gold.append(lab[c])
        ids, sizes, gold = np.array(ids), np.array(sizes), np.array(gold)
        rows, cols = np.array(place).T
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        alive = [int((lengths > c).sum()) for c in range(longest)]  # sequences still running in column c
        y = np.zeros((n, longest), int)
        y[rows, cols] = gold
        par = [np.zeros((len(index), k)), np.zeros((k, k)), np.zeros(k)]
        m1, m2 = [np.zeros_like(p) for p in par], [np.zeros_like(p) for p in par]
        for epoch in range(1, epochs + 1):
            w, t, start = par
            e = np.zeros((n, longest, k))
            e[rows, cols] = np.add.reduceat(w[ids], first, axis=0)
            a = np.zeros_like(e)
            a[:, 0] = start + e[:, 0]
            for c in range(1, longest):
                q = alive[c]
                x = a[:q, c - 1, :, None] + t
                top = x.max(1)
                a[:q, c] = np.log(np.exp(x - top[:, None]).sum(1)) + top + e[:q, c]
            b = np.zeros_like(e)
            for c in range(longest - 2, -1, -1):
                q = alive[c + 1]
                x = t[None] + (e[:q, c + 1] + b[:q, c + 1])[:, None, :]
                top = x.max(2)
                b[:q, c] = np.log(np.exp(x - top[..., None]).sum(2)) + top
            z = a[np.arange(n), lengths - 1]
            top = z.max(1)
            z = np.log(np.exp(z - top[:, None]).sum(1)) + top
            d = np.exp(a[rows, cols] + b[rows, cols] - z[rows, None])
            d[np.arange(len(gold)), gold] -= 1
            spread = np.repeat(d, sizes, axis=0)
            gw = np.stack([np.bincount(ids, spread[:, j], len(index)) for j in range(k)], 1)
            gt = np.zeros((k, k))
            for c in range(1, longest):
                q = alive[c]
                x = a[:q, c - 1, :, None] + t + (e[:q, c] + b[:q, c])[:, None, :] - z[:q, None, None]
                gt += np.exp(x).sum(0)
                np.add.at(gt, (y[:q, c - 1], y[:q, c]), -1)
            gs = np.exp(a[:, 0] + b[:, 0] - z[:, None]).sum(0) - np.bincount(y[:, 0], minlength=k)
            for i, g in enumerate((gw, gt, gs)):
                g = g / n + l2 * par[i]
                m1[i] = 0.9 * m1[i] + 0.1 * g
                m2[i] = 0.99 * m2[i] + 0.01 * g * g
                par[i] = par[i] - rate * (m1[i] / (1 - 0.9**epoch)) / (np.sqrt(m2[i] / (1 - 0.99**epoch)) + 1e-8)
        return cls(k, index, *par)

    def viterbi(self, seqs: list[list[list[str]]], limits: list[list[int]] | None = None) -> list[list[int]]:
        """The best labels of each sequence. limits binds the path by flags: 1 only label 0 is possible, 2 labels 0 and 1 only after label 0 (what was begun goes on), 4 label 1 is not possible."""
        index, ids, first = self.index, [], []
        for seq in seqs:
            for token in seq:
                first.append(len(ids))
                own = [index[f] for f in token if f in index]
                ids += own or [-1]
        if not first:
            return [[] for _ in seqs]
        w = np.vstack([self.w, np.zeros((1, self.k))])
        e = np.add.reduceat(w[np.array(ids)], np.array(first), axis=0).tolist()
        out, at, t, labels = [], 0, self.t_list, range(self.k)
        for which, seq in enumerate(seqs):
            n = len(seq)
            if not n:
                out.append([])
                continue
            bound = limits[which] if limits else None
            score = [self.start_list[j] + e[at][j] for j in labels]
            if bound and bound[0] & 1:
                score[1:] = [NONE] * (self.k - 1)
            elif bound and bound[0] & 4:
                score[1] = NONE
            back = []
            for i in range(at + 1, at + n):
                best = [max(labels, key=lambda j, c=c: score[j] + t[j][c]) for c in labels]
                if bound and bound[i - at]:
                    if bound[i - at] & 1:
                        score = [score[best[0]] + t[best[0]][0] + e[i][0]] + [NONE] * (self.k - 1)
                    else:
                        if bound[i - at] & 2:
                            best[0] = best[1] = 0
                        score = [score[best[c]] + t[best[c]][c] + e[i][c] for c in labels]
                        if bound[i - at] & 4:
                            score[1] = NONE
                    back.append(best)
                    continue
                score = [score[best[c]] + t[best[c]][c] + e[i][c] for c in labels]
                back.append(best)
            at += n
            path = [max(labels, key=score.__getitem__)]
            for best in reversed(back):
                path.append(best[path[-1]])
            out.append(path[::-1])
        return out

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump({"k": self.k, "features": list(self.index), "w": np.round(self.w, 3).tolist(), "t": np.round(self.t, 3).tolist(), "start": np.round(self.start, 3).tolist()}, f, separators=(",", ":"))

    @classmethod
    def load(cls, path: str) -> "Crf":
        with open(path) as f:
            m = json.load(f)
        return cls(m["k"], {x: i for i, x in enumerate(m["features"])}, np.array(m["w"]), np.array(m["t"]), np.array(m["start"]))
