"""Removed bytes against a table of all windows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from loomgraph.llm import suffix_dedup

RND = random.Random(8)


def noise(n):
    return "".join(RND.choices("abcdefgh ij\nké", k=n))


def corpus():
    hot = noise(500)
    long = noise(3000)
    rows = [noise(RND.randint(0, 2000)) for _ in range(30)]
    rows += [noise(RND.randint(0, 300)) + hot[RND.randint(0, 60) :][: RND.randint(380, 440)] + noise(RND.randint(0, 300)) for _ in range(40)]
    rows += [noise(RND.randint(200, 600)) + hot[:60] + noise(RND.randint(200, 600)) for _ in range(20)]  # a beginning that many share, and nothing more
    rows += [long[a : a + RND.randint(300, 1500)] + noise(50) for a in range(0, 2500, 170)]
    rows += ["ab" * 1000, "x" * 399, "x" * 400, "x" * 401, "same" * 200, "same" * 200, hot + hot, None, "", "short", "short", noise(399) + "q"]
    return rows + [rows[3], rows[3]]


def expect(texts, length=400, short=240):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    where = {}
    for k, r in enumerate(raw):
        for i in range(len(r) - short + 1):
            where.setdefault(r[i : i + short], set()).add(k)
    out = {}
    for k, r in enumerate(raw):
        hit, near = np.zeros(len(r), bool), np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                hit[i : i + length] = True
        for i in range(len(r) - short + 1):
            if len(where[r[i : i + short]]) > 1:
                near[i : i + short] = True
        spans = int((np.diff(np.append(False, hit).astype(int)) == 1).sum())
        words = [all(near[m.start() : m.end()]) for m in re.finditer(rb"[^\x20\x09-\x0D]+", r)]
        out[k] = (len(r), int(hit.sum()), spans, hashlib.sha256(bytes(np.frombuffer(r, np.uint8)[~hit])).hexdigest(), longest(words) > 50)
    return out


def longest(flags):
    best = n = 0
    for f in flags:
        n = n + 1 if f else 0
        best = max(best, n)
    return best


def shape(rows):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passages > 0) for r in rows.collect()}


def table(spark, texts, start=0):
    return spark.createDataFrame([(i + start, t, 7, "k") for i, t in enumerate(texts)], "doc_id bigint, text string, tid int, runs string").repartition(5)


@pytest.mark.parametrize("hot,batches,chunk", [(2000, 2, 200_000), (3, 3, 50)])
def test_equals_all_windows(spark, monkeypatch, hot, batches, chunk):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    texts = corpus()
    got = shape(suffix_dedup.dedup(table(spark, texts), hot=hot, batches=batches))
    assert got == expect(texts)


def test_still_many_contexts_after_parting(spark):
    hot = noise(700)
    texts = [noise(100) + hot[a : a + 500] + noise(100) for a in range(0, 180, 9)]
    assert shape(suffix_dedup.dedup(table(spark, texts), hot=1, batches=1)) == expect(texts)


def test_family_takes_a_second_batch(spark):
    """A later batch cuts what earlier ones hold and is cut by it, also after the family is opened anew."""
    texts = corpus()
    old, new = texts[::2], texts[1::2]
    family = suffix_dedup.IndexFamily(spark)
    first = shape(suffix_dedup.dedup(table(spark, old), family=family, batches=1))
    assert first == expect(old)
    family = suffix_dedup.IndexFamily(spark, family.root)
    second = shape(suffix_dedup.dedup(table(spark, new, 1000), family=family, batches=1))
    want = expect(old + new)
    assert second == {k - len(old) + 1000: v for k, v in want.items() if k >= len(old)}
    assert shape(suffix_dedup.report(table(spark, old), family)) == {k: v for k, v in want.items() if k < len(old)}


def test_levels_merge_geometrically(spark):
    family = suffix_dedup.IndexFamily(spark)
    sizes = []
    for _ in range(5):
        family.add(spark.createDataFrame([(i, noise(900)) for i in range(12)], "doc_id bigint, text string"))
        sizes.append(sorted(family.levels))
    assert sizes == [[0], [1], [0, 1], [2], [0, 2]]


def test_levels_are_in_byte_order(spark):
    texts = [noise(900) for _ in range(40)]
    family = suffix_dedup.IndexFamily(spark)
    for half in (texts[:20], texts[20:]):
        family.add(table(spark, half))
    rows = family.read(family.levels[1]).orderBy("part", *suffix_dedup.ORDER).collect()
    raw = {r.tid: r.text.encode() for r in family.texts().collect()}
    starts = [raw[r.tid][r.pos : r.pos + suffix_dedup.GRAM] for r in rows]
    assert starts == sorted(starts) and len(starts) > 100


def test_passages_of_many_words(spark):
    words = lambda n: " ".join("".join(RND.choices("abcdefgh", k=5)) for _ in range(n))
    a, b = words(51), words(50)
    texts = [f"{words(30)} {x} {words(30)}" for x in (a, a, b, b)] + [f"{a} {words(9)} {a}", words(90)]
    own = words(60)
    texts.append(f"{own} {words(5)} {own}")  # nowhere else
    got = {r.doc_id: r.n_passages for r in suffix_dedup.dedup(table(spark, texts)).collect()}
    assert got == {0: 1, 1: 1, 2: 0, 3: 0, 4: 2, 5: 0, 6: 0}


def test_every_window_has_its_suffix():
    raw = noise(5000).encode()
    *_, tid, pos, first, last = suffix_dedup.suffixes([(1, raw)])
    assert first[0] == 0 and last[-1] == len(raw) - 240 and (first[1:] == last[:-1] + 1).all()
    assert ((pos >= last) & (pos <= first + 240 - suffix_dedup.GRAM)).all()


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUFFER", 1000)
    long = noise(6000)
    texts = [noise(77) + long, long[500:4000] + noise(50), noise(3000)]
    got = {}
    for k in range(len(texts)):
        *_, tid, pos, first, last = suffix_dedup.suffixes([(k, texts[k].encode())])
        got[k] = np.concatenate([np.arange(a, z + 1) for a, z in zip(first, last)])
    assert all((got[k] == np.arange(len(t.encode()) - 239)).all() for k, t in enumerate(texts))
    assert shape(suffix_dedup.dedup(table(spark, texts))) == expect(texts)


def test_edges(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, "x" * 500)], "doc_id bigint, text string")
    got = {(r.doc_id, r.n_bytes): (r.n_removed, r.n_spans, r.n_kept) for r in suffix_dedup.dedup(docs).collect()}
    assert got == {(None, 0): (0, 0, 0), (1, 0): (0, 0, 0), (1, 500): (500, 1, 0)}
    assert suffix_dedup.dedup(docs.limit(0)).count() == 0
