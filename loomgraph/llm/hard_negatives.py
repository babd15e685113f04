"""Hard negatives by blocked dense products in float64.

Rows are packed into blocks of a matrix. Anchors, a share of all rows, are
taken in passes of bounded size; a pass is broadcast, and every task multiplies
its blocks with it. Quantised components make a product a sum of whole numbers,
exact in float64 below 2**53, which is checked for every pair of blocks. A task
keeps the best rows of each anchor of the pass, so what it returns is bounded
by the pass, and the bests of tasks merge by rank. The first product finds the
positives; the second looks for each positive's negatives inside its window.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_path, large_batches, shared_dir, stage, tidy

#: Anchors of one pass: at 1,024 components a broadcast of 64 MB.
PASS = 8192
#: Anchors and rows of one product: 16 MB of scores.
ANCHORS, ROWS = 512, 4096
#: Whole numbers below it are exact in float64.
EXACT = 1 << 53


def quantised(rows: DataFrame, scale: int = 256, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, label, v) of the rows that take part, v being floor(scale * component) of each component, as double.

    Rows with a null id, label or vector, or a null or non-finite component, are left out.
    """
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    part = rows.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & v.isNotNull() & ~bad)
    # a double's floor is a bigint, which a large one, whole anyway, doesn't fit
    down = lambda x: F.when(F.abs(x) < float(EXACT), F.floor(x).cast("double")).otherwise(x)
    return part.select(F.col(id_col).cast("bigint").alias("id"), F.col(label).alias("label"), F.transform(v, lambda x: down(x * float(scale))).alias("v"))


def _matrix(column) -> np.ndarray:
    """An Arrow column of lists as a matrix; missing components are 0."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    wide = int(sizes.max(initial=0))
    if (sizes == wide).all():
        return flat.reshape(len(sizes), wide)
    out = np.zeros((len(sizes), wide))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T exactly: int64 where every sum stays below 2**53, else Python's whole numbers."""
    wide = min(a.shape[1], b.shape[1])
    a, b = a[:, :wide], b[:, :wide]
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * wide < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return whole(a).dot(whole(b).T)


def best(scores: np.ndarray, ids: np.ndarray, wanted: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """For each row of scores its first k wanted (score, id), by score from above, then by smaller id; ids are in order."""
    n = scores.shape[1]
    top = (1 << 62) // max(1, n)
    if n > 4 * k and scores.dtype != object and len(scores) and int(np.abs(scores).max()) < top:
        # score and place in one number, so that no two are equal and a partition finds the first k
        key = np.where(wanted, scores * n + np.arange(n - 1, -1, -1), np.int64(-(1 << 62)))
        at = np.argpartition(key, n - k, axis=1)[:, n - k :]
        key = np.take_along_axis(key, at, 1)
        order = np.argsort(-key, axis=1)
        at, key = np.take_along_axis(at, order, 1), np.take_along_axis(key, order, 1)
        return [[(int(scores[i, j]), int(ids[j])) for j, x in zip(at[i].tolist(), key[i].tolist()) if x != -(1 << 62)] for i in range(len(scores))]
    out = []
    for i in range(len(scores)):
        at = np.flatnonzero(wanted[i]).tolist()
        out.append(sorted(((int(scores[i, j]), int(ids[j])) for j in at), key=lambda x: (-x[0], x[1]))[:k])
    return out


def _merge(held: list, more: list, k: int) -> list:
    return sorted(held + more, key=lambda x: (-x[0], x[1]))[:k]


def _blocks(batches):
    """(ids in order, labels, matrix) of at most ROWS rows each."""
    import pyarrow as pa

    for b in batches:
        for at in range(0, len(b), ROWS):
            for p in pa.table(b.slice(at, ROWS)).sort_by("id").combine_chunks().to_batches():
                yield p.column("id").to_numpy(), p.column("label").to_pylist(), _matrix(p.column("v"))


class Anchors:
    """The anchors of a pass and, for the second product, the scores of their positives."""

    def __init__(self, ids: np.ndarray, labels: list, matrix: np.ndarray):
        self.ids, self.matrix, self.scores = ids, matrix, None
        self.kinds = {x: i for i, x in enumerate(dict.fromkeys(labels))}
        self.labels = np.array([self.kinds[x] for x in labels])

    def against(self, ids: np.ndarray, labels: list, matrix: np.ndarray):
        """(first, last, scores, same label, other id) by ANCHORS anchors at a time."""
        kinds = np.array([self.kinds.get(x, -1) for x in labels])
        for at in range(0, len(self.ids), ANCHORS):
            to = min(at + ANCHORS, len(self.ids))
            yield at, to, products(self.matrix[at:to], matrix), self.labels[at:to, None] == kinds, self.ids[at:to, None] != ids


def _emit(held: list, names: list[str]):
    """Rows of (anchor's place, ..., score, id); scores beyond a bigint are its bounds."""
    import pyarrow as pa

    clip = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    for at in range(0, len(held), 1000):
        rows = [(*key, clip(s), i) for key, best_of in held[at : at + 1000] for s, i in best_of]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)


def _positives(anchors, k: int):
    """A task's first k rows of an anchor's label, other than the anchor, for each anchor of the pass."""

    def run(batches):
        a = anchors.value
        held = [[] for _ in a.ids]
        for block in _blocks(batches):
            for at, to, scores, same, other in a.against(*block):
                for i, more in enumerate(best(scores, block[0], same & other, k), at):
                    if more:
                        held[i] = _merge(held[i], more, k)
        yield from _emit([((i,), x) for i, x in enumerate(held)], ["place", "score", "id"])

    return run


def _negatives(anchors, k: int, window: tuple):
    """A task's first k rows of another label in the window of each positive of each anchor of the pass."""
    low, high = window

    def run(batches):
        a = anchors.value
        n = a.scores.shape[1]
        held = {}
        # a row below the last of k that are held can't come among them
        least = np.full(a.scores.shape, None, object)
        for block in _blocks(batches):
            for at, to, scores, same, _ in a.against(*block):
                hundredfold = scores * 100
                for p in range(n):
                    positive = a.scores[at:to, p]
                    there = np.array([x is not None for x in positive])
                    if not there.any():
                        continue
                    of = np.array([x if x is not None else 0 for x in positive], dtype=scores.dtype)[:, None]
                    wanted = ~same & there[:, None] & (low * of <= hundredfold) & (hundredfold <= high * of)
                    bound = least[at:to, p]
                    full = np.array([x is not None for x in bound])
                    if full.any():
                        floor = np.array([x if x is not None else 0 for x in bound], dtype=scores.dtype)[:, None]
                        wanted &= ~full[:, None] | (scores >= floor)
                    hit = np.flatnonzero(wanted.any(axis=1))
                    for i, more in zip(hit.tolist(), best(scores[hit], block[0], wanted[hit], k)):
                        now = held[at + i, p] = _merge(held.get((at + i, p), []), more, k)
                        if len(now) == k:
                            least[at + i, p] = now[-1][0]
        yield from _emit(sorted(held.items()), ["place", "positive", "score", "id"])

    return run


def _passes(anchors: DataFrame, size: int):
    """The anchors in parts of at most size rows, each held by the driver by itself."""
    spark = anchors.sparkSession
    path = shared_dir(spark, "anchors")
    try:
        parts = max(1, -(-2 * anchors.count() // size))  # half full in the mean, so that a part is seldom cut
        anchors.withColumn("part", F.pmod(F.xxhash64("id", "label", "v"), F.lit(parts))).write.partitionBy("part").parquet(path)
        kept = spark.read.schema(anchors.withColumn("part", F.lit(0)).schema).parquet(path)
        for k in range(parts):
            rows = kept.where(F.col("part") == k).drop("part").toArrow()
            for at in range(0, len(rows), size):
                for b in rows.slice(at, size).combine_chunks().to_batches():
                    yield Anchors(b.column("id").to_numpy(), b.column("label").to_pylist(), _matrix(b.column("v")))
    finally:
        drop_path(spark, path)


def _first(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, window: tuple = (30, 90), size: int = PASS) -> DataFrame:
    """RESULT for rows(id, label, v) as quantised() gives them; anchor says which rows are anchors, by id.

    An anchor's positives are its first rows of the same label, by score from
    above, then by smaller id; a positive's negatives are the first rows of
    another label whose score is window per cent of the positive's.

    A row is never the positive of an anchor with its id. Repeated rows are
    candidates each by themselves; anchors alike in id, label and vector are
    one. Vectors of different length are multiplied over the length of the
    shorter. An anchor without positives, or a positive without negatives, has
    no rows, and an empty table gives none. Products of 2**53 and more are made
    with Python's whole numbers; scores beyond a bigint are shown as its bounds.
    """
    spark = rows.sparkSession
    rows = rows.select("id", "label", "v")
    out = []
    with large_batches(spark, ROWS):
        for part in _passes(rows.where(anchor).dropDuplicates(["id", "label", "v"]), size):
            sent = spark.sparkContext.broadcast(part)
            found = rows.mapInArrow(tidy(_positives(sent, positives)), "place bigint, score bigint, id bigint")
            # at most size * positives rows
            found = _first(found, ["place"], positives).select("place", "rank", "score", "id").toPandas()
            sent.destroy()
            part.scores = np.full((len(part.ids), positives), None, object)
            named = np.zeros(part.scores.shape, np.int64)
            for place, rank, score, other in found.itertuples(index=False):
                part.scores[place, rank - 1], named[place, rank - 1] = int(score), other
            sent = spark.sparkContext.broadcast(part)
            found = rows.mapInArrow(tidy(_negatives(sent, negatives, window)), "place bigint, positive bigint, score bigint, id bigint")
            found = _first(found, ["place", "positive"], negatives)
            names = spark.createDataFrame(
                [(i, p, int(part.ids[i]), int(named[i, p]), part.scores[i, p]) for i in range(len(part.ids)) for p in range(positives) if part.scores[i, p] is not None],
                "place bigint, positive bigint, anchor_id bigint, positive_id bigint, positive_score bigint",
            )
            made = found.join(F.broadcast(names), ["place", "positive"])  # at most size * positives rows
            out.append(stage(made.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives"))
            sent.destroy()
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], RESULT)
