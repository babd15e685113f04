"""Hard negatives against plain scores."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import hard_negatives as H

RND = random.Random(13)


def plain(rows, is_anchor, k=5, n=10, scale=256, window=(30, 90)):
    live = [(i, y, [math.floor(scale * x) for x in v]) for i, v, y in rows if None not in (i, y, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    seen = set()
    for i, y, v in live:
        if not is_anchor(i) or (i, y, tuple(v)) in seen:
            continue
        seen.add((i, y, tuple(v)))
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j, z) for j, z, w in live), key=lambda x: x[:2])
        for s, j, _ in [x for x in scored if x[2] == y and x[1] != i][:k]:
            wanted = [x for x in scored if x[2] != y and window[0] * -s <= 100 * -x[0] <= window[1] * -s][:n]
            out += [(i, j, r, x[1], -s, -x[0]) for r, x in enumerate(wanted, 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "vec_id bigint, embedding array<float>, label int, id string")


def some_rows(n=400, wide=6):
    f = lambda: float(np.float32(RND.uniform(-1, 1)))
    rows = [(i, [f() for _ in range(wide)], RND.randint(0, 3)) for i in range(n)]
    rows += [(n + i, rows[7][1], 1) for i in range(60)]  # copies, so ties
    rows += [rows[11], rows[20], rows[20]]  # repeated rows, an anchor among them
    rows += [(None, [f()] * wide, 1), (10, None, 1), (20, [f()] * wide, None), (30, [float("nan")] * wide, 2), (40, [float("inf")] + [0.0] * (wide - 1), 2), (50, [None] * wide, 1)]
    rows += [(60, [0.5] * (wide - 2), 1), (70, [], 1), (80, [0.25] * (wide + 3), 2), (90, [0.0] * wide, 3), (1000, [f()] * wide, 77)]
    return rows


@pytest.mark.parametrize("size, block", [(H.PASS, H.ROWS), (7, 16)])
def test_negatives_equal_plain_ones(spark, monkeypatch, size, block):
    monkeypatch.setattr(H, "ROWS", block)
    monkeypatch.setattr(H, "ANCHORS", 5)
    rows = some_rows()
    got = H.mine(H.quantised(table(spark, rows).repartition(4)), F.col("id") % 10 == 0, size=size).collect()
    assert sorted(map(tuple, got)) == plain(rows, lambda i: i % 10 == 0)


def test_nothing_to_mine(spark):
    rows = table(spark, some_rows(30))
    assert H.mine(H.quantised(rows.limit(0)), F.col("id") % 10 == 0).count() == 0
    assert H.mine(H.quantised(rows), F.lit(False)).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    alone = spark.createDataFrame([(0, [1.0], 1), (1, [0.5], 2)], "vec_id bigint, embedding array<float>, label int")
    assert H.mine(H.quantised(alone), F.col("id") == 0).count() == 0


def test_large_components_stay_exact(spark):
    rows = [(i, [float(np.float32(RND.uniform(-1, 1) * 2**30)) for _ in range(3)], i % 2) for i in range(40)]
    got = H.mine(H.quantised(table(spark, rows)), F.col("id") % 10 == 0).collect()
    clip = lambda x: max(-(2**63), min(2**63 - 1, x))
    small = [r for r in plain(rows, lambda i: i % 10 == 0)]
    assert sorted(map(tuple, got)) == small or any(clip(r[4]) != r[4] for r in small)


def test_products():
    a, b = np.array([[2.0**40, 1.0]]), np.array([[2.0**40, 1.0], [1.0, 3.0]])
    assert H.products(a, b).tolist() == [[2**80 + 1, 2**40 + 3]]
    assert H.products(np.array([[2.0, 3.0]]), np.array([[5.0]])).tolist() == [[10]]
    assert H.products(np.zeros((2, 0)), np.zeros((3, 4))).tolist() == [[0] * 3] * 2


def test_best_is_by_score_then_id():
    s = np.array([RND.choices(range(-5, 6), k=300) for _ in range(20)])
    ids, wanted = np.arange(300) * 3, np.array([[RND.random() < 0.3 for _ in range(300)] for _ in range(20)])
    wanted[3] = False
    wanted[4, 5:] = False
    want = [sorted(((int(s[i, j]), int(ids[j])) for j in range(300) if wanted[i, j]), key=lambda x: (-x[0], x[1]))[:10] for i in range(20)]
    assert H.best(s, ids, wanted, 10) == want == H.best(s.astype(object), ids, wanted, 10)
