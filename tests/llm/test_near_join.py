"""The join against brute force over all pairs."""

import random

import numpy as np
import pytest

from loomgraph.llm import near_join

RND = random.Random(11)
VOC = [f"w{i}" for i in range(3000)]


def shingle_set(t):
    w = near_join._WORDS.findall(t or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def corpus():
    base = [" ".join(RND.choices(VOC, k=RND.randint(3, 200))) for _ in range(40)]
    rows = list(base)
    for t in base:
        for _ in range(RND.randint(0, 4)):
            w = t.split()
            for _ in range(RND.randint(0, 4)):
                w[RND.randrange(len(w))] = RND.choice(VOC)
            rows.append(" ".join(w))
    hot = " ".join(RND.choices(VOC, k=120)).split()
    for _ in range(60):  # a group whose pairs lie about the threshold
        w = list(hot)
        for _ in range(2):
            w[RND.randrange(len(w))] = RND.choice(VOC)
        rows.append(" ".join(w))
    return rows + rows[:10] + [None, "", " \n", "a", "a", "a b c d", "a b c d", "a  b\tc d"]


def expect(texts):
    sets = [shingle_set(t) for t in texts]
    n = len(texts)
    adj = [[j for j in range(n) if j != i and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(n)]
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            m = min([label[i], *(label[j] for j in adj[i])])
            if m < label[i]:
                label[i], changed = m, True
    return {i: (label[i], len(adj[i])) for i in range(n)}


def check(spark, **options):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, node string, links int").repartition(6)
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_join.join(docs, **options).collect()}
    assert got == expect(texts)


@pytest.mark.parametrize("chunk", [200_000, 40])
def test_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(near_join, "CHUNK", chunk)
    check(spark)


def test_tiles_equal_brute_force(spark):
    check(spark, tile_rows=7)


def test_keep_one(spark):
    texts = corpus()
    want = expect(texts)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x"), (None, "null id words here now", "y"), (None, "null id words here now", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, root string")
    got = near_join.keep_one(docs).collect()
    ids = sorted(r.doc_id for r in got if r.doc_id is not None)
    assert ids == sorted({c for i, (c, _) in want.items()})
    assert sum(r.doc_id is None for r in got) == 1
    assert near_join.keep_one(docs.limit(0)).count() == 0
    assert near_join.join(docs.limit(0)).count() == 0


def test_depth_follows_recall():
    d = near_join.depth_for()
    miss = lambda k, x=0.8: (1 - x**k) ** near_join.TREES
    assert miss(d) <= 1 - near_join.TARGET_RECALL < miss(d + 1)
    for n in range(1, 60):  # the least similarity of a set of n members, over all partners
        every = [i / u for i in range(1, n + 1) for u in range(n, 2 * n + 2) if 5 * i >= 4 * u and i < u]
        least = near_join.least_similarity(n)
        assert (least is None) == (not every) and (not every or abs(least - min(every)) < 1e-9)


def test_labels_are_tries():
    """Equal prefixes of labels are equal first minimums, at each depth."""
    sets = [near_join.shingles(t) for t in corpus() if (t or "").strip()]
    sig = [near_join.signature(x, 4 * near_join.DEEPEST).reshape(4, -1) for x in sets]
    lab = [near_join.labels(x, 4).reshape(4, 2) for x in sets]
    chance = 0
    for a in range(0, len(sets), 3):
        for b in range(len(sets)):
            for t in range(4):
                same = (sig[a][t] != sig[b][t]).argmax() if (sig[a][t] != sig[b][t]).any() else near_join.DEEPEST
                for k in range(1, near_join.DEEPEST + 1):
                    p = lambda x: (near_join._prefix(x[t][:1], k)[0], near_join._prefix(x[t][1:], k - 4)[0])  # noqa: B023, E731
                    assert p(lab[a]) == p(lab[b]) or k > same
                    chance += p(lab[a]) == p(lab[b]) and k > same
    assert chance < 60  # letters of 16 bits


def test_recall_of_the_forest(spark):
    """Of pairs just at the threshold, what the tries join; without verification."""
    rnd = np.random.default_rng(5)
    rows, pairs = [], []
    for i in range(300):
        w = [f"w{x}" for x in rnd.integers(0, 10**6, 104)]
        v = list(w)
        v[3], v[90] = "x", "y"  # 10 of 100 shingles go and 10 come: 90 / 110
        pairs.append((2 * i, 2 * i + 1))
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    kept = near_join.sketch(spark.createDataFrame(rows, "doc_id bigint, text string"), near_join.TREES)
    stars = near_join.stars_of(kept.select("node", "size", "labels"), near_join.TREES, 0.8, near_join.TARGET_RECALL)
    by = {r.doc_id: r.node for r in kept.select("doc_id", "node").collect()}
    joined = {frozenset((r.node, r.top)) for r in stars.collect()}
    assert sum(frozenset((by[a], by[b])) in joined for a, b in pairs) >= 299


def test_long_texts_in_few_tiles(spark):
    """Few rows by many blocks: often a side has no row."""
    for seed in range(4):
        rnd = random.Random(seed)
        w = rnd.choices(VOC, k=300)
        texts = []
        for i in range(2 + seed):
            w[rnd.randrange(len(w))] = f"x{i}"
            texts.append(" ".join(w))
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
        got = {r.doc_id: (r.class_id, r.n_links) for r in near_join.join(docs, tile_bytes=len(texts[0])).collect()}
        assert got == expect(texts)
