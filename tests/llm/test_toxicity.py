"""The automaton against a plain edit distance; held-out accuracy on made texts."""

import random
import zlib

import numpy as np

from loomgraph.llm import toxicity

RND = random.Random(3)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def kind(word, terms, stems):
    if word in terms:
        return 1
    if any(word.startswith(s) for s in stems):
        return 2
    allowed = lambda t: 0 if len(t) < 5 else 1 if len(t) < 9 else 2
    return 3 if any(distance(word, t) <= allowed(t) for t in terms) else 0


def test_automaton_equals_edit_distance():
    for _ in range(30):
        terms = list({"".join(RND.choices("abc", k=RND.randint(3, 10))) for _ in range(5)})
        stems = list({"".join(RND.choices("abc", k=RND.randint(3, 4))) for _ in range(2)})
        a = toxicity.Automaton(terms, stems)
        words = ["".join(RND.choices("abcd", k=RND.randint(1, 11))) for _ in range(300)] + terms + stems + [t[:-1] for t in terms] + [t + "d" for t in terms]
        assert [a.read(w) for w in words] == [kind(w, terms, stems) for w in words]


def made(n):
    voc = ["".join(RND.choices("bcdfglmnprst", k=2)) + RND.choice("aeiou") + "".join(RND.choices("bdlmnrt", k=3)) for _ in range(2000)]
    rows, labels = [], []
    for i in range(n):
        w = RND.choices(voc, k=RND.randint(5, 200))
        y = RND.random() < 0.15
        if y:
            for _ in range(RND.randint(1, 4)):
                w.insert(RND.randrange(len(w)), RND.choice(["gruntwit", "Gruntwit", "bozzle!", "zorf" + RND.choice(voc), "gruntwot"]))
        rows.append((i, " ".join(w), "x", 0.5))
        labels.append((i, int(y)))
    return rows, labels


def test_held_out_accuracy_and_edge_rows(spark):
    rows, labels = made(1500)
    rows += [(None, None, "x", 0.1), (5001, "", "x", 0.1), (5002, None, "x", 0.1), (5003, "word " * 50_000, "x", 0.1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score double")
    truth = spark.createDataFrame(labels + [(3, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, truth)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows)
    y = dict(labels)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [(r.predicted, y[r.doc_id]) for r in got if r.held_out and r.doc_id in y]
    assert sum(p == t for p, t in held) >= 0.97 * len(held)
    assert toxicity.score(docs.limit(0), model).count() == 0
    kept = toxicity.reject_toxic(docs, truth)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {None, 5001, 5002, 5003}
    none = toxicity.fit(docs, truth.limit(0))
    assert toxicity.score(docs, none).where("predicted = 1").count() == docs.count()  # no knowledge: even odds


def test_quotation_counts_less():
    words = toxicity.Words(toxicity.Automaton(["gruntwit"], []))
    a = toxicity.features("you gruntwit and gruntwit", words)
    b = toxicity.features('they wrote "gruntwit" and “gruntwit”', words)
    assert a[0] > b[0] and b[4] > a[4] == 0


def test_words_and_quotations_of_any_length():
    words = toxicity.Words(toxicity.Automaton(["gruntwit"], ["zorf"]))
    assert [words["zorf" + "a" * n] for n in (59, 60, 5000)] == [2, 2, 2] and words["b" * 5000] == 0
    short, long = (toxicity.features(f'they wrote "{"word " * n}gruntwit{" word" * n}" there', words) for n in (3, 300))
    assert short == long and short[4] > 0
    many = '"gruntwit" and ' * 3000 + "“" * 20_000 + " gruntwit"
    assert abs(toxicity.features(many, words)[4] - __import__("math").log1p(3000)) < 1e-9


def test_repeated_ids_are_learned_from_once(spark):
    rows, labels = made(400)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score double")
    truth = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    a, b = toxicity.fit(docs, truth), toxicity.fit(docs.unionByName(docs).unionByName(docs), truth)
    assert (a.terms, a.stems, a.weights) == (b.terms, b.stems, b.weights)


def plain_features(text, terms, stems):
    """The same from every word, every quotation and every window looked at in turn."""
    import math
    import re

    low = text.lower()
    kinds = {'"': ('"', '"'), "“": ("”", "“”"), "«": ("»", "«»"), "„": ("“”", "„“”")}
    quotes, i = [], 0
    while i < len(low):  # from left to right, none inside another
        if low[i] in kinds:
            closed, ends = kinds[low[i]]
            j = i + 1
            while j < len(low) and low[j] not in ends and low[j] != "\n":
                j += 1
            if j < len(low) and low[j] in closed and j > i + 1:
                quotes.append((i, j + 1))
                i = j
        i += 1
    words = [(m.start(), m.group()) for m in re.finditer(r"[^\W_]+", low)]
    hits = [(n, kind(w, terms, stems), any(a < at < b for a, b in quotes)) for n, (at, w) in enumerate(words)]
    hits = [h for h in hits if h[1]]
    if not hits:
        return None
    weight = lambda h: (0.5 if h[1] == 3 else 1.0) * (toxicity.QUOTED if h[2] else 1.0)
    best = max(sum(weight(h) for h in hits if abs(h[0] - n) <= toxicity.WINDOW) for n, _, _ in hits)
    count = lambda f: math.log1p(sum(map(f, hits)))
    return [math.log1p(best), *[count(lambda h, k=k: h[1] == k and not h[2]) for k in (1, 2, 3)], count(lambda h: h[2])]


def test_features_equal_plain_ones():
    terms, stems = ["gruntwit", "bozzle"], ["zorf"]
    words = toxicity.Words(toxicity.Automaton(terms, stems))
    pieces = ["gruntwit", "Gruntwot", "zorfly", "bozzle", "bozle", "some", "words", "here", '"', '"', "“", "”", "«", "»", "\n", "_", "é"]
    for _ in range(400):
        text = " ".join(RND.choice(pieces) for _ in range(RND.randint(0, 60)))
        got, want = toxicity.features(text, words), plain_features(text, terms, stems)
        assert (got is None) == (want is None) and (got is None or all(abs(a - b) < 1e-9 for a, b in zip(got, want))), text
    model = toxicity.Model(terms, stems, [-1.0, 2.0, 0.5, 0.5, 0.5, -0.5])
    x = toxicity.features("a gruntwit", words)
    z = -1.0 + 2.0 * x[0] + 0.5 * x[1]
    assert abs(model.score(x) - 1 / (1 + np.exp(-z))) < 1e-12 and abs(model.score(None) - 1 / (1 + np.exp(1.0))) < 1e-12
