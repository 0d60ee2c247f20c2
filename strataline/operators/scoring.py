"""What search runs on the workers: finding the words and phrases of questions in batches of texts, the best documents of each question in batches of hits, the best names of each
term in batches of names, and the best files of each question in batches of paths.

All work on whole Arrow batches with numpy. Texts never leave their task: what comes out is a short row of numbers a document, then a bounded list a question and task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from strataline.functions.text import MIN_PART

K1, B = 1.2, 0.75
HEAD = 3  # letters by which beginnings are looked up
BLOCK_DOCS, BLOCK_HITS = 65_536, 4_000_000  # documents and hits scored together
PAIRS, KEPT = 4_000_000, 2_000_000  # candidates looked at together, and kept before they are cut to the best
EPS = 1e-6
_CASE, _RUN = [re.compile(x) for x in ("([a-z0-9])([A-Z])", "([A-Z]+)([A-Z][a-z])", "([A-Za-z])([0-9])")], re.compile("[A-Za-z0-9]+")


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each span, one after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


class Asked:
    """The term groups of questions: the words of a term, a bar and, with parts, the sub-words of a compound one."""

    def __init__(self, parts: bool) -> None:
        self.parts = parts

    def _group(self, term: str) -> str:
        """As lexical.query_groups has them, in Python."""
        own = [w for w in _RUN.findall(_CASE[2].sub(r"\1 \2", _CASE[1].sub(r"\1 \2", _CASE[0].sub(r"\1 \2", term))))] if self.parts else []
        return " ".join(w for w in term.lower().split("_") if w) + "|" + " ".join(w.lower() for w in own if len(own) > 1 and len(w) >= MIN_PART)

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(query_id, groups) of (query_id, terms): the groups in order, a line each."""
        for b in batches:
            b = b.filter(pc.greater(pc.list_value_length(b.column(1)), 0))
            d = b.column(1).flatten().dictionary_encode()
            group = [self._group(t) for t in d.dictionary.to_pylist()]
            names = sorted(set(group))
            at = {x: i for i, x in enumerate(names)}
            place = np.array([at[x] for x in group], np.int64)
            size = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
            own, q = place[d.indices.to_numpy()], np.repeat(np.arange(b.num_rows), size)
            own = own[np.lexsort((own, q))]
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(names, pa.string()).take(pa.array(own)))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pc.binary_join(lists, "\n")], names=["query_id", "groups"])


class _Phrases:
    """A trie of word sequences of two words or more; a node ends an exact phrase, or one whose last word is a beginning, or none."""

    def __init__(self, phrases: list[tuple[str, tuple[int, ...], int]], n_words: int) -> None:
        start, children, ends, stars = np.full(n_words + 1, -1, np.int64), {}, [], []
        for how, ws, v in phrases:
            at = int(start[ws[0]])
            for i, w in enumerate(ws):
                at = at if i == 0 else children.get(at * n_words + w, -1)
                if at < 0:
                    at = len(ends)
                    ends.append(-1)
                    stars.append(-1)
                    if i == 0:
                        start[w] = at
                    else:
                        children[before * n_words + w] = at
                before = at
            (stars if how == "*" else ends)[at] = v
        self.start, self.n_words = start, n_words
        self.keys = np.array(sorted(children), np.int64)
        self.nodes = np.array([children[k] for k in self.keys.tolist()], np.int64)
        self.ends, self.stars = np.array(ends, np.int64), np.array(stars, np.int64)
        self.inner = np.zeros(len(ends), bool)
        self.inner[self.keys // n_words] = True

    def child(self, node: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the steps exist, and where they lead."""
        k = node * self.n_words + word
        i = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        ok = self.keys[i] == k
        return ok, self.nodes[i[ok]]


class Wanted:
    """Variants asked for: (how, words). = is a token or several side by side, * the same with a beginning at the end, p as = but only in the column parts."""

    def __init__(self, variants: list[tuple[str, tuple[str, ...]]]) -> None:
        self.words = {w: i for i, w in enumerate(dict.fromkeys(w for _, ws in variants for w in ws))}
        n = len(self.words)
        self.n_variants = len(variants)
        self.one = {how: np.full(n + 1, -1, np.int64) for how in "=*p"}  # the last place is that of tokens nobody asks for
        self.last, self.lengths = {}, {}
        phrases: dict[bool, list] = {False: [], True: []}
        for v, (how, ws) in enumerate(variants):
            ids = tuple(self.words[w] for w in ws)
            if how == "*":
                self.last[ws[-1]] = ids[-1]
            if len(ids) == 1:
                self.one[how][ids[0]] = v
            else:
                phrases[how == "p"].append((how, ids, v))
        for w in self.last:
            if len(w) >= HEAD:
                self.lengths.setdefault(w[:HEAD], set()).add(len(w))
        self.short = sorted({len(w) for w in self.last if len(w) < HEAD})
        self.phrases = {k: _Phrases(x, n) if x else None for k, x in phrases.items()}

    def _meanings(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each distinct token its word, and the words it begins with (a count, where they start, all of them)."""
        word, count, every = np.full(len(tokens), -1, np.int64), np.zeros(len(tokens), np.int64), []
        for j, t in enumerate(tokens):
            w = self.words.get(t)
            if w is not None:
                word[j] = w
            had = len(every)
            for n in self.short:
                if n <= len(t) and (w := self.last.get(t[:n])) is not None:
                    every.append(w)
            for n in self.lengths.get(t[:HEAD], ()):
                if n <= len(t) and (w := self.last.get(t[:n])) is not None:
                    every.append(w)
            count[j] = len(every) - had
        return word, count, np.cumsum(count) - count, np.array(every, np.int64)

    def find(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc, dl, vs, tf) of (doc, the tokens of each column): how often each variant is in the document."""
        for b in batches:
            n, found = b.num_rows, [np.zeros(0, np.int64)]
            dl = np.zeros(n, np.int64)

            def add(doc: np.ndarray, v: np.ndarray, found: list = found) -> None:
                ok = v >= 0
                found.append(doc[ok] * self.n_variants + v[ok])

            for name in b.schema.names[1:]:
                ts = b.column(name)
                lens = pc.list_value_length(ts).to_numpy(zero_copy_only=False).astype(np.int64)
                dl += lens
                d = ts.flatten().dictionary_encode()
                token, doc = d.indices.to_numpy().astype(np.int64), np.repeat(np.arange(n), lens)
                word, count, start, every = self._meanings(d.dictionary.to_pylist())
                w, c = word[token], count[token]
                add(doc, self.one["="][w])
                at = np.flatnonzero(c)
                add(np.repeat(doc[at], c[at]), self.one["*"][every[spans(start[token[at]], c[at])]])
                if name == "parts":
                    add(doc, self.one["p"][w])
                for only_parts, p in self.phrases.items():
                    if p is None or only_parts and name != "parts":
                        continue
                    node = p.start[w]
                    pos = np.flatnonzero(node >= 0)
                    node = node[pos]
                    while len(pos):
                        ok = pos + 1 < len(doc)
                        pos, node = pos[ok], node[ok]
                        ok = doc[pos] == doc[pos + 1]
                        pos, node = pos[ok] + 1, node[ok]
                        k = c[pos]
                        ok, to = p.child(np.repeat(node, k), every[spans(start[token[pos]], k)])
                        add(np.repeat(doc[pos], k)[ok], p.stars[to])
                        ok = w[pos] >= 0
                        pos, node = pos[ok], node[ok]
                        ok, node = p.child(node, w[pos])
                        pos = pos[ok]
                        add(doc[pos], p.ends[node])
                        ok = p.inner[node]
                        pos, node = pos[ok], node[ok]
            keys, tf = np.unique(np.concatenate(found), return_counts=True)
            ends = np.zeros(n + 1, np.int32)
            np.cumsum(np.bincount(keys // max(self.n_variants, 1), minlength=n), out=ends[1:])
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (keys % max(self.n_variants, 1), tf)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dl), *lists], names=["doc", "dl", "vs", "tf"])


def frequencies(n_variants: int):
    """Sums of a task: (v, n) for each variant found in n documents, under -1 the documents and under -2 their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, dl = np.zeros(n_variants, np.int64), 0, 0
        for b in batches:
            n, dl = n + b.num_rows, dl + (pc.sum(b.column("dl")).as_py() or 0)
            df += np.bincount(b.column("vs").flatten().to_numpy(), minlength=n_variants)
        v = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(v, [-1, -2])), pa.array(np.append(df[v], [n, dl]))], names=["v", "n"])

    return run


class Scorer:
    """The best documents of each question. groups: the variants of each; questions: (id, groups of the question as a list or an array, repeats included, at least one)."""

    def __init__(self, groups: list[list[int]], questions: list[tuple[int, list[int] | np.ndarray]], df: np.ndarray, n: int, avgdl: float, most: int, and_only: bool) -> None:
        self.most, self.and_only, self.avgdl = most, and_only, avgdl
        self.idf = np.maximum(np.log((n - df + 0.5) / (df + 0.5)), 1e-6)
        pairs = np.array(sorted((v, g) for g, vs in enumerate(groups) for v in vs), np.int64).reshape(-1, 2)
        self.of_v, self.n_of_v = pairs[:, 1], np.bincount(pairs[:, 0], minlength=len(df))
        self.v_at = np.cumsum(self.n_of_v) - self.n_of_v
        self.n_groups = len(groups)
        self.ids = np.array([q for q, _ in questions], np.int64)
        self.size = np.array([len(g) for _, g in questions], np.int64)  # with repeats
        key = np.repeat(np.arange(len(questions)), self.size) * max(len(groups), 1) + np.concatenate([g for _, g in questions])
        key, times = np.unique(key, return_counts=True)
        q, group = np.divmod(key, max(len(groups), 1))
        self.len = np.bincount(q, minlength=len(questions))
        self.at, self.group, self.times = np.cumsum(self.len) - self.len, group.astype(np.int32), times.astype(np.float32)  # some 10^7

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(question, full, doc, score, rank): each task's best; full 1 where all groups match, which only questions of four groups or fewer ask for."""
        nq = len(self.ids)
        # row 2q: any groups, row 2q + 1: all groups. edge: what a document has to reach
        self.edge, self.full = np.zeros(2 * nq), np.zeros(nq, bool)
        self.kept, self.n_kept, self.limit = [], 0, KEPT
        block, docs, hits = [], 0, 0
        for b in batches:
            block.append(b)
            docs, hits = docs + b.num_rows, hits + len(b.column("vs").flatten())
            if docs >= BLOCK_DOCS or hits >= BLOCK_HITS:
                self._block(block)
                block, docs, hits = [], 0, 0
        if block:
            self._block(block)
        self._cut()
        for row, score, doc in self.kept:
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
            rank = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row)))) + 1
            for a in range(0, len(row), 100_000):
                s = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(self.ids[row[s] >> 1]), pa.array((row[s] & 1).astype(np.int32)), pa.array(doc[s]), pa.array(score[s]), pa.array(rank[s].astype(np.int32))], names=["q", "full", "doc", "score", "rank"])

    def _keep(self, row: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        score = np.floor(score * 1e6 + 0.5) / 1e6
        ok = score >= self.edge[row]
        self.kept.append((row[ok], score[ok], doc[ok]))
        self.n_kept += int(ok.sum())
        if self.n_kept > self.limit:
            self._cut()
            self.limit = max(KEPT, 2 * self.n_kept)  # else every question would sort what all others keep

    def _cut(self) -> None:
        """Each row's best in order of score and document."""
        if not self.kept:
            return
        row, score, doc = (np.concatenate(x) for x in zip(*self.kept))
        ok = (row & 1 == 1) | ~self.full[row >> 1]  # any groups don't count beside all of them
        row, score, doc = row[ok], score[ok], doc[ok]
        o = np.lexsort((doc, -score, row))
        row, score, doc = row[o], score[o], doc[o]
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
        rank = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        edge = rank == self.most - 1
        self.edge[row[edge]] = score[edge]
        ok = rank < self.most
        self.kept, self.n_kept = [(row[ok], score[ok], doc[ok])], int(ok.sum())

    def _block(self, batches: list[pa.RecordBatch]) -> None:
        t = pa.Table.from_batches(batches).combine_chunks()
        doc, dl = t["doc"].to_numpy(), t["dl"].to_numpy()
        n, vs, tf = len(doc), t["vs"].combine_chunks().flatten().to_numpy(), t["tf"].combine_chunks().flatten().to_numpy().astype(np.float64)
        if not len(vs):
            return
        d = np.repeat(np.arange(n), pc.list_value_length(t["vs"]).to_numpy())
        x = self.idf[vs] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[d] / self.avgdl))
        # hits of groups: the sum of the group's variants in a document, in order of (group, document)
        k = self.n_of_v[vs]
        key = self.of_v[spans(self.v_at[vs], k)] * n + np.repeat(d, k)
        if not len(key):  # hits of another search's groups only
            return
        o = np.argsort(key, kind="stable")
        key = key[o]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        x, key = np.add.reduceat(np.repeat(x, k)[o], first), key[first]
        g, d = np.divmod(key, n)
        at = np.searchsorted(g, np.arange(self.n_groups + 1))
        count, at = np.diff(at), at[:-1]
        top = np.zeros(self.n_groups)
        top[count > 0] = np.maximum.reduceat(x, at[count > 0])
        there = count[self.group] > 0
        bound = np.add.reduceat(self.times * top[self.group], self.at)
        every = np.logical_and.reduceat(there, self.at)
        q = np.flatnonzero((self.size <= 4) & every & (bound >= self.edge[1::2] - EPS))
        self._all(q, doc, n, key, x, d, at, count, top)
        if self.and_only:
            return
        for q in np.flatnonzero(~self.full & (bound > 0) & (bound >= self.edge[::2] - EPS)).tolist():
            own = slice(self.at[q], self.at[q] + self.len[q])
            lists = [(slice(at[i], at[i] + count[i]), m) for i, m in zip(self.group[own].tolist(), self.times[own].tolist()) if count[i]]
            if len(lists) == 1:
                (s, m), = lists
                hit, score = d[s], x[s] * m
            else:
                score = np.bincount(np.concatenate([d[s] for s, _ in lists]), np.concatenate([x[s] if m == 1 else x[s] * m for s, m in lists]), n)
                hit = None
            ok = np.flatnonzero(score >= max(self.edge[2 * q] - EPS, EPS / 100))  # every hit's weight is 1e-7 at least
            score = score[ok]
            hit = ok if hit is None else hit[ok]
            if len(score) > 2 * self.most:
                least = np.partition(score, -self.most)[-self.most]
                self.edge[2 * q] = max(self.edge[2 * q], np.floor(least * 1e6 + 0.5) / 1e6)
                ok = score >= least - EPS
                hit, score = hit[ok], score[ok]
            self._keep(np.full(len(hit), 2 * q), score, doc[hit])

    def _all(self, questions: np.ndarray, doc: np.ndarray, n: int, key: np.ndarray, x: np.ndarray, d: np.ndarray, at: np.ndarray, count: np.ndarray, top: np.ndarray) -> None:
        """Documents that have all groups: those with the rarest, looked up in the others while they can still reach the edge."""
        if not len(questions):
            return
        wide = np.arange(4)[None, :] < self.len[questions][:, None]
        place = np.where(wide, self.at[questions][:, None] + np.arange(4)[None, :], 0)
        group, times = np.where(wide, self.group[place].astype(np.int64), -1), np.where(wide, self.times[place], 0.0)
        o = np.argsort(np.where(wide, count[group], 1 << 40), axis=1, kind="stable")
        group, times = np.take_along_axis(group, o, 1), np.take_along_axis(times, o, 1)
        rest = np.cumsum((np.where(group >= 0, top[group], 0.0) * times)[:, ::-1], axis=1)[:, ::-1]  # what groups from here on can add
        slices = np.cumsum(count[group[:, 0]]) // PAIRS
        for part in np.split(np.arange(len(questions)), np.flatnonzero(np.diff(slices)) + 1):
            k = count[group[part, 0]]
            i, hit = np.repeat(part, k), spans(at[group[part, 0]], k)
            where, score = d[hit], x[hit] * times[i, 0]
            row = 2 * questions + 1
            for j in range(1, 4):
                ok = score + rest[i, j] >= self.edge[row[i]] - EPS
                i, where, score = i[ok], where[ok], score[ok]
                more = np.flatnonzero(group[i, j] >= 0)
                want = group[i[more], j] * n + where[more]
                to = np.minimum(np.searchsorted(key, want), len(key) - 1)
                ok = np.ones(len(i), bool)
                ok[more] = key[to] == want
                score[more] += x[to] * times[i[more], j]
                i, where, score = i[ok], where[ok], score[ok]
            self.full[questions[np.unique(i)]] = True
            self._keep(row[i], score, doc[where])


class Names:
    """The best names of each term: equal to it 0, beginning with it 1, holding it 2 (not with strong); ties by length and id."""

    def __init__(self, terms: list[str], most: int, strong: bool) -> None:
        self.terms, self.most, self.strong = {t: i for i, t in enumerate(terms)}, most, strong
        self.short = sorted({len(t) for t in terms if len(t) < HEAD})
        self.lengths: dict[str, list[int]] = {}
        for h, n in sorted({(t[:HEAD], len(t)) for t in terms if len(t) >= HEAD}):
            self.lengths.setdefault(h, []).append(n)

    def _held(self, name: str) -> dict[int, int]:
        """The terms a name holds and how it does."""
        out: dict[int, int] = {}
        for i in range(1 if self.strong else len(name)):
            for n in (*self.short, *self.lengths.get(name[i : i + HEAD], ())):
                if i + n <= len(name) and (t := self.terms.get(name[i : i + n])) is not None and t not in out:
                    out[t] = 2 if i else int(n < len(name))
        return out

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(term, match, len, id) of (id, name in lower case, length): each task's best."""
        kept, n_kept, edge = [], 0, np.full(len(self.terms), np.iinfo(np.int64).max)

        def cut() -> None:
            term, how, own = (np.concatenate(x) for x in zip(*kept))
            o = np.lexsort((own, how, term))
            term, how, own = term[o], how[o], own[o]
            first = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
            rank = np.arange(len(term)) - np.repeat(first, np.diff(np.append(first, len(term))))
            edge[term[rank == self.most - 1]] = how[rank == self.most - 1]
            ok = rank < self.most
            kept[:] = [(term[ok], how[ok], own[ok])]

        for b in batches:
            d = pc.dictionary_encode(b.column(1))
            held = [self._held(n) for n in d.dictionary.to_pylist()]
            count = np.array([len(h) for h in held], np.int64)
            term = np.array([t for h in held for t in h], np.int64)
            match = np.array([m for h in held for m in h.values()], np.int64)
            name = d.indices.to_numpy()
            k = count[name] if len(count) else np.zeros(0, np.int64)
            at = spans((np.cumsum(count) - count)[name], k) if len(count) else k
            # match and length as one number
            term, how, own = term[at], (match[at] << 32) + np.repeat(b.column(2).to_numpy().astype(np.int64), k), np.repeat(b.column(0).to_numpy(), k)
            ok = how <= edge[term]
            kept.append((term[ok], how[ok], own[ok]))
            n_kept += int(ok.sum())
            if n_kept > KEPT:
                cut()
                n_kept = len(kept[0][0])
        if kept:
            cut()
            term, how, own = kept[0]
            for a in range(0, len(term), 100_000):
                s = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(term[s].astype(np.int32)), pa.array((how[s] >> 32).astype(np.int32)), pa.array((how[s] & 0xFFFFFFFF).astype(np.int32)), pa.array(own[s])], names=["term", "match", "len", "symbol_id"])


class Paths:
    """The best files of each question by the words of their paths. words: the weight of each; questions: (id, whether tests count, its words as numbers)."""

    def __init__(self, words: list[str], weights: list[float], questions: list[tuple[int, bool, list[int]]], least: int, most: int) -> None:
        self.words, self.weights, self.least, self.most = {w: i for i, w in enumerate(words)}, np.array(weights, np.float64), least, most
        self.questions = [(q, tests, np.unique(np.array(ws, np.int64))) for q, tests, ws in questions]

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(question, file, score, matched) of (file, whether a test, words of its path): each task's best that match least words or more."""
        # of each question its best files so far, (score, matched, file); edge: the score that another has to reach
        self.best: list[tuple] = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(self.questions)
        self.edge = np.zeros(len(self.questions))
        block, n = [], 0
        for b in batches:
            block.append(b)
            n += b.num_rows
            if n >= BLOCK_DOCS:
                self._block(block)
                block, n = [], 0
        if block:
            self._block(block)
        for a in range(0, len(self.questions), 5_000):
            part = self.best[a : a + 5_000]
            q = np.repeat(np.array([q for q, _, _ in self.questions[a : a + 5_000]], np.int64), [len(x[0]) for x in part])
            score, matched, own = (np.concatenate(x) for x in zip(*part))
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(own), pa.array(score), pa.array(matched)], names=["q", "file_id", "score", "matched"])

    def _block(self, batches: list[pa.RecordBatch]) -> None:
        t = pa.Table.from_batches(batches).combine_chunks()
        own, test = t.column(0).to_numpy(), t.column(1).to_numpy()
        ts = t.column(2).combine_chunks()
        d = ts.flatten().dictionary_encode()
        known = np.array([self.words.get(w, -1) for w in d.dictionary.to_pylist()], np.int64)
        word, file = known[d.indices.to_numpy()] if len(known) else known, np.repeat(np.arange(len(own)), pc.list_value_length(ts).to_numpy(zero_copy_only=False))
        word, file = word[word >= 0], file[word >= 0]
        # files of the greatest weight come first, so that those whose words together don't reach an edge are left out as one end of a list
        total, enough = np.bincount(file, self.weights[word], len(own)), np.bincount(file, minlength=len(own)) >= self.least
        order = np.argsort(np.where(enough, -total, np.inf), kind="stable")[: enough.sum()]
        place = np.full(len(own), -1)
        place[order] = np.arange(len(order))
        own, test, total = own[order], test[order], total[order]
        file = place[file]
        word, file = word[file >= 0], file[file >= 0]
        o = np.lexsort((file, word))
        word, file = word[o], file[o]
        at = np.searchsorted(word, np.arange(len(self.weights) + 1))
        for i, (_, tests, ws) in enumerate(self.questions):
            n = int(np.searchsorted(-total, EPS - self.edge[i], side="right"))
            lists = [x for x in (file[at[w] : at[w + 1]] for w in ws) if len(x)]
            if not n or not lists:
                continue
            ends = [int(np.searchsorted(x, n)) for x in lists]
            hit = np.concatenate([x[:e] for x, e in zip(lists, ends)])
            score = np.bincount(hit, np.repeat(self.weights[[w for w in ws if at[w + 1] > at[w]]], ends), n)
            matched = np.bincount(hit, minlength=n)
            ok = (matched >= self.least) & (score >= self.edge[i] - EPS)
            if not tests:
                ok &= ~test[:n]
            ok = np.flatnonzero(ok)
            if not len(ok):
                continue
            score = np.floor(score[ok] * 1e9 + 0.5) / 1e9
            if len(ok) > self.most:
                near = score >= np.partition(score, -self.most)[-self.most]
                ok, score = ok[near], score[near]
            score, matched, files = (np.concatenate(x) for x in zip(self.best[i], (score, matched[ok], own[ok])))
            o = np.lexsort((files, -matched, -score))[: self.most]
            self.best[i] = score[o], matched[o], files[o]
            if len(o) == self.most:
                self.edge[i] = score[o[-1]]
