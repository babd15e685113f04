"""N-gram Jaccard self-join with a MinHash LSH forest and exact verification.

Documents with equal shingle sets are one class. A class has a label of DEEPEST
minimums in each of TREES trees; a tree is its labels in order, a sorted prefix
trie, and one scan of neighbours gives its nodes of every depth. A class's
prefix is shortened from DEEPEST on, in all trees, until the least similarity
above the threshold that a set of its size can have with another is found with
the target recall; what shares that prefix is its candidate. Sets too small to
have any such partner aren't sought.

Candidates are joined into groups by components over one edge for each member
of a trie node, so nothing grows with the square of a node's size. A group's
texts meet once, and all of its pairs are verified exactly in numpy. A larger
group is dealt into sides by a trie prefix, so that what is alike stands
together, and only those pairs of sides meet that some trie node joins. Only
counts and one edge for each row leave a task.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, drop_stage, large_batches, narrow, stage, text_col, tidy
from .components import components

SHINGLE = 5
THRESHOLD = 0.8
TREES = 32
DEEPEST = 8
TARGET_RECALL = 0.9999
TILE_ROWS = 512
#: Rows of the tries that a scan looks at together; nodes at their edges are put together afterwards.
CHUNK = 200_000
LETTER_BITS = 16  # of a minimum, in a label of two 64-bit words
TILE_BYTES = 24 << 20

_WORDS = re.compile(WORD)
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def least_similarity(size: int, threshold: float = THRESHOLD) -> float | None:
    """The least similarity, threshold at least, that a set of so many members can have with another set; None if there is none."""
    if size > 200:  # within a hundredth of the threshold, and never below it
        return threshold
    found = []
    for common in range(max(1, math.ceil(threshold * size - 1e-9)), size + 1):
        union = math.floor(common / threshold + 1e-9)
        if union > size or common < size <= union:
            found.append(common / union)
    return min(found, default=None)


@lru_cache(maxsize=4096)
def depth_for(similarity: float = THRESHOLD, trees: int = TREES, target: float = TARGET_RECALL, deepest: int = DEEPEST) -> int:
    """The longest prefix whose matches in any tree find a pair of that similarity with the target recall."""
    depth = deepest
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < target:
        depth -= 1
    return depth


class WordHashes(dict):
    def __missing__(self, w):
        if len(self) > 300_000:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        return h


@lru_cache(maxsize=1)
def _hashes() -> WordHashes:
    return WordHashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's runs of five words; a shorter text is one shingle, an empty one none."""
    words = _WORDS.findall(text)
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_hashes().__getitem__, words), np.uint64, len(words))
    n = min(SHINGLE, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        h = h * np.uint64(0xD6E8FEB86659FD93) + w[k : len(w) - n + 1 + k] * _MULT[k]
    return np.unique(_mix(h))


@lru_cache(maxsize=4)
def _family(count: int):
    rng = np.random.default_rng(20240101)
    return rng.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, count, dtype=np.uint32)


def signature(sh: np.ndarray, count: int) -> np.ndarray:
    a, b = _family(count)
    x = (sh >> np.uint64(32)).astype(np.uint32)
    out = np.full(count, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        y = x[i : i + 512, None] * a
        y += b
        np.minimum(out, y.min(axis=0), out=out)
    return out


def labels(sh: np.ndarray, trees: int) -> np.ndarray:
    """For each tree its DEEPEST minimums, LETTER_BITS of each, as two words whose order is that of the trie."""
    sig = _mix(signature(sh, trees * DEEPEST).astype(np.uint64) + np.uint64(1)) >> np.uint64(64 - LETTER_BITS)
    out = np.zeros((trees, 2), np.uint64)
    for k, x in enumerate(sig.reshape(trees, 2, -1).transpose(2, 0, 1)):
        out = out << np.uint64(LETTER_BITS) | x
    return out.ravel().view(np.int64)


def node_of(sh: np.ndarray) -> int:
    """Name of a shingle set: 64 bits, so among n distinct sets a wrong meeting has odds of about n**2 / 2**65."""
    return xxhash.xxh3_64_intdigest(sh.tobytes()) - (1 << 63)


def sketch(docs: DataFrame, trees: int, id_col: str = "doc_id") -> DataFrame:
    """doc_id, text_hash, node (null without words), size of the shingle set, labels."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            for i in range(0, len(b), 500):
                part = b.iloc[i : i + 500]
                sets = [shingles(t) for t in part["text"]]
                nodes = pd.array([node_of(x) if len(x) else None for x in sets], "Int64")
                yield pd.DataFrame({"doc_id": part["doc_id"].values, "text_hash": part["text_hash"].values, "node": nodes, "size": [len(x) for x in sets], "labels": [labels(x, trees) if len(x) else None for x in sets]})

    rows = docs.select(F.col(id_col).alias("doc_id"), text_col().alias("text")).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInPandas(tidy(run), f"doc_id {kind}, text_hash bigint, node bigint, size bigint, labels array<bigint>")


STAR = "node bigint, top bigint, edge boolean, tree int, depth int, hi bigint, lo bigint"


def _prefix(x: np.ndarray, letters: int) -> np.ndarray:
    """The words' first letters, 4 at most, the rest zero."""
    bits = 64 - LETTER_BITS * min(4, max(0, letters))
    return x & np.int64(-1 << bits if bits < 64 else 0)


def scan_tries(paths: DataFrame, shallowest: int) -> DataFrame:
    """STAR rows: each class and the least class of a trie node that some class's own prefix names. paths: tree, hi, lo, node, depth, in order.

    A node that touches the edge of a chunk may go on in another: its rows keep its name.
    """

    def close(c):
        out = []
        n = len(c["node"])
        free = np.ones(n, bool)  # not yet under a node that was given
        for k in range(shallowest, DEEPEST + 1):
            hi, lo = _prefix(c["hi"], k), _prefix(c["lo"], k - 4)
            head = np.append(True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]) | (c["tree"][1:] != c["tree"][:-1]))
            begin, run = np.flatnonzero(head), np.cumsum(head) - 1
            size, top = np.diff(np.append(begin, n)), np.minimum.reduceat(c["node"], begin)
            wanted = np.bincount(run, c["depth"] == k) > 0
            edge = np.zeros(len(begin), bool)
            edge[[0, -1]] = True
            keep = np.flatnonzero(free & ((wanted & (size > 1) & ~edge)[run] | edge[run]))
            e = edge[run[keep]]
            name = lambda x: np.where(e, x, 0)  # noqa: B023, E731
            out.append(pd.DataFrame({"node": c["node"][keep], "top": top[run[keep]], "edge": e, "tree": name(c["tree"][keep]), "depth": name(k), "hi": name(hi[keep]), "lo": name(lo[keep])}))
            free &= ~(wanted & (size > 1) & ~edge)[run]
        out = pd.concat(out)
        return out[out["edge"] | (out["node"] != out["top"])]

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append({x: b[x].to_numpy() for x in b.columns})
            size += len(b)
            if size >= CHUNK:
                yield close({x: np.concatenate([h[x] for h in held]) for x in held[0]})
                held, size = [], 0
        if held:
            yield close({x: np.concatenate([h[x] for h in held]) for x in held[0]})

    return paths.select("tree", "hi", "lo", "node", "depth").mapInPandas(tidy(run), STAR)


def stars_of(classes: DataFrame, trees: int, threshold: float, target: float) -> DataFrame:
    """(node, top): classes(node, size, labels) and the tops of the trie nodes that they are in with others, staged."""
    spark = classes.sparkSession
    sizes = [(n, s) for n in range(1, 201) if (s := least_similarity(n, threshold)) is not None]
    shallowest = depth_for(threshold, trees, target)
    depths = F.create_map(*[F.lit(x) for n, s in sizes for x in (n, depth_for(s, trees, target))]) if sizes else F.lit(None).cast("map<int,int>")
    deep = F.when(F.col("size") > 200, F.lit(shallowest)).otherwise(F.try_element_at(depths, F.col("size").cast("int")))
    paths = classes.select("node", deep.alias("depth"), "labels", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).where("depth is not null")
    paths = paths.select("tree", F.col("labels")[2 * F.col("tree")].alias("hi"), F.col("labels")[2 * F.col("tree") + 1].alias("lo"), "node", "depth")
    order = ["tree", "hi", "lo", "node"]
    with large_batches(spark):
        found = stage(scan_tries(paths.repartitionByRange(*order).sortWithinPartitions(*order), shallowest), "tries")
    name = ["tree", "depth", "hi", "lo"]
    tops = found.where("edge").groupBy(*name).agg(F.min("top").alias("whole"))
    edge = found.where("edge").join(tops, name).where("node <> whole").select("node", F.col("whole").alias("top"))
    out = stage(found.where("not edge").select("node", "top").unionByName(edge).distinct(), "stars")
    drop_stage(found)
    return out


def links_inside(sets: list[np.ndarray], side: np.ndarray, threshold: float, cross: bool) -> np.ndarray:
    """Which pairs reach the threshold, as a matrix; cross: only pairs of different sides, as each side's own pairs are another tile's."""
    m = len(sets)
    if cross and (side == side[0]).all():
        return np.zeros((m, m), bool)
    sizes = np.array([len(s) for s in sets])
    flat, row = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[column] > 1  # others are in no intersection
    rank = np.cumsum(times > 1) - 1
    column, row = rank[column[shared]], row[shared]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    common = np.zeros((m, m), np.float32)
    step = max(256, (16 << 20) // (4 * m))
    width = int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, width, step):
        i, j = np.searchsorted(column, (lo, lo + step))
        a = np.zeros((m, min(step, width - lo)), np.float32)
        a[row[i:j], column[i:j] - lo] = 1
        common += a @ a.T
    union = sizes[:, None] + sizes[None, :] - common
    adj = common >= threshold * union - 1e-6
    np.fill_diagonal(adj, False)
    if cross:
        adj &= side[:, None] != side[None, :]
    return adj


def roots_of(adj: np.ndarray, names: np.ndarray) -> np.ndarray:
    """For each row the smallest name in its component."""
    label = names.copy()
    while True:
        near = np.where(adj, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        new = np.minimum(label, near)
        if (new == label).all():
            return label
        label = new


def verify(groups: DataFrame, threshold: float) -> DataFrame:
    """node, links, root, tiled for rows (grp, i, j, side, tiled, node, copies, text) whose tile's rows (grp, i, j) stand together."""

    def close(rows):
        seen, keep = set(), []
        for r in rows:  # a text that came twice
            if r[0] not in seen:
                seen.add(r[0])
                keep.append(r)
        names = np.array([r[0] for r in keep], np.int64)
        copies = np.array([r[1] for r in keep], np.int64)
        adj = links_inside([r[3] for r in keep], np.array([r[2] for r in keep]), threshold, rows[0][5])
        root = roots_of(adj, names)
        return names, adj @ copies, root, rows[0][4]

    def frame(parts):
        return pd.DataFrame({"node": np.concatenate([p[0] for p in parts]), "links": np.concatenate([p[1] for p in parts]), "root": np.concatenate([p[2] for p in parts]), "tiled": np.concatenate([np.full(len(p[0]), p[3]) for p in parts])})

    def run(batches):
        at, rows, done, held = None, [], [], 0
        for b in batches:
            for grp, i, j, side, tiled, node, copies, text in b.itertuples(index=False):
                if (grp, i, j) != at:
                    if rows:
                        done.append(close(rows))
                        held += len(rows)
                    at, rows = (grp, i, j), []
                    if held > 20_000:
                        yield frame(done)
                        done, held = [], 0
                sh = shingles(text)
                if node_of(sh) == node:  # another text under the same id is not meant
                    rows.append((node, copies, side, sh, tiled, i != j))
        if rows:
            done.append(close(rows))
        if done:
            yield frame(done)

    return groups.mapInPandas(tidy(run), "node bigint, links bigint, root bigint, tiled boolean")


def tiles_of(texts: DataFrame, stars: DataFrame, tile_rows: int, tile_bytes: int) -> tuple[DataFrame, list[DataFrame]]:
    """(rows, staged tables that they are read from): the rows of each tile: a group that fits is one; of a larger one, each side with itself and each two sides that a trie node has members in.

    texts: grp, node, home, copies, text. Sides are made by home, a prefix that
    alike texts mostly share, and within one by the node's hash as far as it is too large.
    """
    blocks = lambda: F.greatest(F.ceil(F.count("*") / tile_rows), F.ceil(F.sum("_size") / tile_bytes)).cast("int")
    sized = texts.withColumn("_size", F.octet_length("text"))
    large = stage(sized.groupBy("grp").agg(blocks().alias("blocks")).where("blocks > 1"), "large")
    columns = ["grp", "i", "j", "side", "tiled", "node", "copies", "text"]
    zero = F.lit(0).cast("long")
    small = texts.join(large, "grp", "left_anti").select("grp", zero.alias("i"), zero.alias("j"), zero.alias("side"), F.lit(False).alias("tiled"), "node", "copies", "text")
    if not large.limit(1).count():
        return small.select(*columns), [large]
    rows = sized.join(large, "grp").withColumn("bin", F.pmod(F.xxhash64("home"), F.col("blocks")))
    bins = rows.groupBy("grp", "bin").agg(blocks().alias("parts"))
    rows = rows.join(bins, ["grp", "bin"]).withColumn("side", (F.col("bin") * (1 << 32) + F.pmod(F.xxhash64("node"), F.col("parts"))).cast("long"))
    rows = stage(rows.select("grp", "side", "node", "copies", "text"), "sides")
    places = rows.select("node", "grp", "side")
    at = stars.join(places, "node").select("grp", "top", "side").unionByName(places.select("grp", F.col("node").alias("top"), "side"))
    at = stage(at.distinct(), "places")
    met = at.join(at.withColumnRenamed("side", "other"), ["grp", "top"]).where("side <= other").select("grp", F.col("side").alias("i"), F.col("other").alias("j")).distinct()
    met = stage(met.unionByName(rows.select("grp", F.col("side").alias("i"), F.col("side").alias("j")).distinct()).distinct(), "met")
    ends = met.select("grp", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("side"))
    drop_stage(at)
    return rows.join(ends, ["grp", "side"]).withColumn("tiled", F.lit(True)).select(*columns).unionByName(small.select(*columns)), [large, rows, met]


def join(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, target: float = TARGET_RECALL, id_col: str = "doc_id", tile_rows: int = TILE_ROWS, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """One row for each row of docs: doc_id, class_id, n_links, copy_id, text_hash, class_node.

    class_id is the smallest doc_id that links connect to the document, copy_id
    the smallest among equal shingle sets, n_links the number of other rows
    whose sets have a Jaccard similarity of at least threshold. Words are cut
    at ASCII white space; a text of fewer than five words is one shingle. A
    null, empty or blank text has no shingle: it is alone in its class
    (class_node null). Repeated rows are copies of each other; null ids are kept
    and never name a class that has another id; an empty table gives no rows.
    """
    kept = stage(sketch(docs, trees, id_col), "sketch")
    classes = kept.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("copy_id"), F.count("*").alias("copies"), F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.any_value("size").alias("size"), F.any_value("labels").alias("labels"))
    classes = stage(classes, "classes")
    stars = stars_of(classes, trees, threshold, target)
    # a class and its least trie top are joined, and that top with the class's others (one for each tree at most); many classes share these pairs
    tops = stage(stars.groupBy("node").agg(F.min("top").alias("b"), F.collect_set("top").alias("others")), "tops")
    grouped = components(tops.select(F.col("node").alias("a"), "b").unionByName(tops.select(F.explode("others").alias("a"), "b").where("a <> b").distinct()))
    drop_stage(tops)

    # the texts of candidate groups, one for each class
    home = F.col("labels")[0].bitwiseAND(F.lit(-1 << (64 - 3 * LETTER_BITS)))
    members = grouped.join(classes, "node").select("node", F.col("label").alias("grp"), "copies", home.alias("home"), F.col("rep.doc_id").alias("_rep"), F.col("rep.text_hash").alias("_hash"))
    members = stage(members, "members")
    drop_stage(grouped)
    rows = docs.select(F.col(id_col).alias("_id"), text_col().alias("text"))
    rows = narrow(rows.withColumn("_h", F.xxhash64("text")), members.select(F.col("_hash").alias("_h")).distinct(), "_h")
    texts = rows.join(members, F.col("_id").eqNullSafe(F.col("_rep")) & (F.col("_h") == F.col("_hash")))
    texts = stage(texts.select("grp", "node", "home", "copies", "text"), "texts")
    drop_stage(members)
    tiles, held = tiles_of(texts, stars, tile_rows, tile_bytes)
    verified = stage(verify(tiles.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j"), threshold), "verified")
    for gone in (*held, texts, stars):
        drop_stage(gone)

    found = verified.groupBy("node").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    split = verified.where("tiled").select(F.col("node").alias("a"), F.col("root").alias("b"))
    if split.limit(1).count():
        found = found.join(components(split).withColumnRenamed("label", "whole"), "node", "left").withColumn("root", F.coalesce("whole", "root"))
    info = classes.select("node", "copy_id", "copies").join(found.select("node", "links", "root"), "node", "left")
    info = stage(info.select("node", "copy_id", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "info")
    drop_stage(verified)
    drop_stage(classes)
    # staged, so that a class of very many members meets its name in a join that may be split
    names = stage(info.groupBy("root").agg(F.min("copy_id").alias("class_id"), F.count("*").alias("many")).where("many > 1").drop("many"), "names")
    info = info.join(names, "root", "left").select(F.col("node").alias("_node"), "copy_id", F.coalesce("class_id", "copy_id").alias("class_id"), "root", "n_links")
    out = kept.select("doc_id", "text_hash", "node").join(info, F.col("node") == F.col("_node"), "left")
    return out.select(
        "doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"), "text_hash", F.col("root").alias("class_node"),
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each class, that of the smallest id; rows without words (null, empty, blank) all stay.

    Of repeated rows one stays; a null id is the smallest; an empty table stays empty; other columns, whatever they are called, are kept.
    """
    found = join(docs, **options)
    keepers = found.where("class_node is not null").groupBy("class_node").agg(F.min(F.struct("doc_id", "text_hash")).alias("k"))
    keepers = keepers.select(F.col("k.doc_id").alias("_k"), F.col("k.text_hash").alias("_kh"))
    rows = docs.withColumn("_h", F.xxhash64(text_col()))
    blank = ~text_col().rlike(WORD)
    kept = rows.where(~blank).join(keepers, F.col("doc_id").eqNullSafe(F.col("_k")) & (F.col("_h") == F.col("_kh")), "left_semi")
    kept = kept.dropDuplicates(["doc_id", "_h"])
    return kept.unionByName(rows.where(blank)).drop("_h").select(*docs.columns)
