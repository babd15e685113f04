"""Toxicity scores from a learned lexicon, Levenshtein automata and context windows.

The lexicon (whole terms, and stems that any ending may follow) is learned from
a bounded sample of labelled rows. It is a trie; the Levenshtein automata of its
terms, intersected with it, become one automaton whose states are made when a
word first needs them, so a word is read once, letter by letter, and most words
leave the automaton after a few letters. Hits are weighed in windows of words
around them, where a hit inside quotation marks counts less, and a logistic
model on the window scores gives the result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, text_col, tidy

#: Bounds of the training sample, by label; and the longest text in it, in characters.
MOST_TOXIC, MOST_CLEAN, LONGEST = 2000, 4000, 50_000
MOST_TERMS = 400
STEM_LENGTHS = range(3, 9)
WINDOW = 8
THRESHOLD = 0.3
#: Rows that go back to the JVM together.
ROWS_AT_ONCE = 1000
FUZZY_FROM = 5  # letters of a term that may be misspelled by one edit
FUZZY_TWO = 9  # by two edits
QUOTED = 0.3  # what a hit inside quotation marks counts, before anything is learned

_WORDS = re.compile(r"[^\W_]+")
#: A quotation of any length ends where it is closed, in the same line; the innermost one counts.
_QUOTES = re.compile("\"[^\"\n]+\"|“[^“”\n]+”|«[^«»\n]+»|„[^„“”\n]+[“”]")
#: Longer words are read by the automaton each time.
LONGEST_KEPT = 64


class Automaton:
    """The trie of terms and stems with up to two edits in terms; deterministic, its states made on demand.

    read(word) gives 0: no hit, 1: a term, 2: a stem with an ending, 3: a misspelled term.
    """

    def __init__(self, terms: list[str], stems: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term, self.stem, self.most = [False], [False], [0]
        for words, mark in ((terms, self.term), (stems, self.stem)):
            for w in words:
                edits = 0 if mark is self.stem or len(w) < FUZZY_FROM else 1 if len(w) < FUZZY_TWO else 2
                node = 0
                self.most[0] = max(self.most[0], edits)
                for c in w:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                        self.term.append(False)
                        self.stem.append(False)
                        self.most.append(0)
                    node = self.children[node][c]
                    self.most[node] = max(self.most[node], edits)
                mark[node] = True
        self.allowed = {}
        for w in terms:
            node = 0
            for c in w:
                node = self.children[node][c]
            self.allowed[node] = 0 if len(w) < FUZZY_FROM else 1 if len(w) < FUZZY_TWO else 2
        self.reset()

    def reset(self):
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.value: list[int] = []
        self.start = self._state(self._closed({(0, 0)}))

    def _closed(self, pairs) -> frozenset:
        """With a letter of the term left out for one edit; a pair that another dominates goes."""
        best: dict[int, int] = {}
        todo = list(pairs)
        while todo:
            node, e = todo.pop()
            if node >= 0 and e > self.most[node] or best.get(node, 9) <= e:
                continue
            best[node] = e
            if node >= 0:
                todo += [(c, e + 1) for c in self.children[node].values()]
        return frozenset(best.items())

    def _state(self, pairs: frozenset) -> int:
        if pairs not in self.ids:
            self.ids[pairs] = len(self.states)
            self.states.append(pairs)
            self.next.append({})
            exact = any(e == 0 and n >= 0 and self.term[n] for n, e in pairs)
            stem = any(n < 0 or e == 0 and self.stem[n] for n, e in pairs)
            near = any(n >= 0 and self.term[n] and e <= self.allowed[n] for n, e in pairs)
            self.value.append(1 if exact else 2 if stem else 3 if near else 0)
        return self.ids[pairs]

    def _step(self, state: int, c: str) -> int:
        out = []
        for node, e in self.states[state]:
            if node < 0 or e == 0 and self.stem[node]:
                out.append((-1, 0))
            if node < 0:
                continue
            out.append((node, e + 1))
            out += [(child, e + (letter != c)) for letter, child in self.children[node].items()]
        to = self._state(self._closed(out))
        self.next[state][c] = to
        return to

    def read(self, word: str) -> int:
        if len(self.states) > 100_000:
            self.reset()
        state = self.start
        for c in word:
            to = self.next[state].get(c)
            if to is None:
                to = self._step(state, c)
            if not self.states[to]:
                return 0
            state = to
        return self.value[state]


class Words(dict):
    """Lower-case words to their kind of hit, in bounded memory. Words may have any length."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, w):
        v = self.automaton.read(w)
        if len(w) <= LONGEST_KEPT:
            if len(self) > 400_000:
                self.clear()
            self[w] = v
        return v


N_FEATURES = 5


def features(text: str, words: Words) -> list[float] | None:
    """What the model sees of a text, or None without any hit: the best window, all hits by kind, quoted hits."""
    low = text.lower()
    kinds = list(map(words.__getitem__, _WORDS.findall(low)))
    if not any(kinds):
        return None
    quotes = [m.span() for m in _QUOTES.finditer(low)]  # in order, apart
    opened = [a for a, _ in quotes]
    hits = []
    for i, m in enumerate(_WORDS.finditer(low)):
        if k := kinds[i]:
            q = bisect_left(opened, m.start()) - 1
            quoted = q >= 0 and m.start() < quotes[q][1]
            hits.append((i, k, quoted))
    weight = {1: 1.0, 2: 1.0, 3: 0.5}
    at = np.array([i for i, _, _ in hits])
    w = np.array([weight[k] * (QUOTED if q else 1.0) for _, k, q in hits])
    total = np.append(0.0, np.cumsum(w))
    best = (total[np.searchsorted(at, at + WINDOW, "right")] - total[np.searchsorted(at, at - WINDOW, "left")]).max()
    count = lambda f: math.log1p(sum(map(f, hits)))
    return [math.log1p(best), count(lambda h: h[1] == 1 and not h[2]), count(lambda h: h[1] == 2 and not h[2]), count(lambda h: h[1] == 3 and not h[2]), count(lambda h: h[2])]


def _forms(text: str, wanted: set | None = None) -> set[str]:
    out = set()
    for w in set(_WORDS.findall(text.lower())):
        out.add(w)
        out.update(w[:k] + "*" for k in STEM_LENGTHS if len(w) > k)
    return out if wanted is None else out & wanted


def learn_lexicon(toxic: list[str], clean: list[str]) -> tuple[list[str], list[str]]:
    """Terms and stems that mark toxic texts: few forms that cover them, then each form that is frequent and as sure."""
    least = max(3, math.ceil(0.0015 * len(toxic)))
    # most forms are in one text: those whose bucket is under the least number are never held
    rough = np.zeros(1 << 21, np.int32)
    for t in toxic:
        rough[np.unique(np.fromiter((hash(f) & 0x1FFFFF for f in _forms(t)), np.int64))] += 1
    a: Counter = Counter()
    for t in toxic:
        a.update(f for f in _forms(t) if rough[hash(f) & 0x1FFFFF] >= least)
    a = Counter({f: n for f, n in a.items() if n >= least})
    wanted = set(a)
    b: Counter = Counter()
    for t in clean:
        b.update(_forms(t, wanted))
    nt, nc = len(toxic) + 1, len(clean) + 1

    def odds(f):
        return math.log((a[f] + 0.5) / nt) - math.log((b[f] + 0.5) / nc)

    sure = {f: odds(f) for f in wanted if (a[f] / nt) > 12 * ((b[f] + 0.5) / nc)}
    held = [_forms(t, set(sure)) for t in toxic]
    where: dict[str, set[int]] = {}
    for i, fs in enumerate(held):
        for f in fs:
            where.setdefault(f, set()).add(i)
    # whole terms come before stems that hold no more, longer stems before shorter ones that hold the same
    rank = lambda f: (-round(len(where[f]) * sure[f], 6), f.endswith("*"), -len(f), f)
    chosen, open_ = [], set(range(len(toxic)))
    todo = sorted(where, key=rank)
    while todo and len(chosen) < MOST_TERMS:
        best = max(todo, key=lambda f: (round(len(where[f] & open_) * sure[f], 6), not f.endswith("*"), len(f), f))
        if len(where[best] & open_) < least:
            break
        chosen.append(best)
        open_ -= where[best]
        todo = [f for f in todo if f != best and where[f] & open_]
    stems = [f[:-1] for f in chosen if f.endswith("*")]
    often = max(8, 0.01 * len(toxic))
    more = [f for f in sorted(where, key=rank) if not f.endswith("*") and len(where[f]) >= often and f not in chosen and not any(f.startswith(s) for s in stems)]
    terms = [f for f in chosen if not f.endswith("*")] + more[: MOST_TERMS - len(chosen)]
    return terms, stems


class Model:
    def __init__(self, terms, stems, weights):
        self.terms, self.stems, self.weights = terms, stems, weights

    def score(self, x: list[float] | None) -> float:
        z = self.weights[0] + (sum(w * v for w, v in zip(self.weights[1:], x)) if x else 0.0)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def train(toxic: list[str], clean: list[str], n_toxic: int, n_clean: int) -> Model:
    """toxic, clean: sampled texts; n_toxic, n_clean: how many such rows there are, for the rows' weights."""
    prior = math.log((n_toxic + 0.5) / (n_clean + 0.5))
    if not toxic or not clean:
        return Model([], [], [prior] + [0.0] * N_FEATURES)
    terms, stems = learn_lexicon(toxic, clean)
    words = Words(Automaton(terms, stems))
    rows = [(features(t, words), y) for ts, y in ((toxic, 1.0), (clean, 0.0)) for t in ts]
    x = np.array([[1.0, *(f or [0.0] * N_FEATURES)] for f, _ in rows])
    y = np.array([y for _, y in rows])
    by = np.where(y == 1, n_toxic / len(toxic), n_clean / len(clean))
    by = by * len(rows) / by.sum()
    w = np.zeros(x.shape[1])
    w[0] = prior
    ridge = np.diag([1e-3] + [0.3] * N_FEATURES)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (by * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (by * (y - p)) - ridge @ (w - np.eye(len(w))[0] * prior))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return Model(terms, stems, w.tolist())


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> Model:
    """Learns from labelled rows outside the held-out quarter: at most so many of either label, in the order of a hash of their ids.

    The bounded sample of ids is broadcast, so docs are read once and only the sample's texts come to the driver; of rows with one id, the least text.
    """
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", (F.col("toxic") != 0).alias("toxic")).where(~held_out()).distinct()
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pick = None
    for y, most in ((True, most_toxic), (False, most_clean)):
        part = rows.where(F.col("toxic") == y).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(most)
        pick = part if pick is None else pick.unionByName(part)
    texts = docs.select("doc_id", text_col().alias("text")).where(F.length("text") <= LONGEST).join(F.broadcast(pick), "doc_id")
    texts = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    got = {r.text: bool(r.toxic) for r in texts.orderBy("doc_id", "toxic").toLocalIterator()}  # equal texts once
    toxic, clean = [t for t, y in got.items() if y], [t for t, y in got.items() if not y]
    del got
    model = train(toxic, clean, counts.get(True, 0), counts.get(False, 0))
    del toxic, clean
    release()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", carry: tuple = (), text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs, and the columns named by carry.

    Null, empty and hitless texts get the model's base score; whole texts of any
    length are read; repeated rows, null ids (not held out) and an empty table
    keep their rows; other columns are not read.
    """
    terms, stems, weights = model.terms, model.stems, model.weights

    def run(batches):
        m, words = Model(terms, stems, weights), Words(Automaton(terms, stems))
        for b in batches:
            for i in range(0, len(b), ROWS_AT_ONCE):
                part = b.iloc[i : i + ROWS_AT_ONCE]
                yield part[names].assign(_score=[m.score(features(t or "", words)) for t in part[text]])

    names = list(dict.fromkeys((id_col, *carry)))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    got = docs.select(*dict.fromkeys((*names, text))).mapInPandas(tidy(run), f"{kinds}, _score double")
    made = (held_out(id_col).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))
    return got.select(id_col, *made, *[F.col(c) for c in carry])


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows predicted toxic; null, empty and repeated rows are judged as score() says, an empty table stays empty, clashing columns are kept."""
    columns = docs.columns
    # by position, since columns of docs may be called as those of the score
    plain = [f"c{i}" for i in range(len(columns))]
    key, text = (plain[columns.index(c)] for c in ("doc_id", "text"))
    scored = score(docs.toDF(*plain), fit(docs, labels), key, tuple(c for c in plain if c != key), text)
    return scored.where("predicted = 0").select(*plain).toDF(*columns)
