"""Removal of long repeated byte strings with a logarithmic family of suffix arrays.

An array holds the suffixes that begin at content-defined places: the place of
the least hash among the GRAM-byte grams of each window of SHORT bytes. Equal
windows have their place at the same offset, so nothing is missed, and an array
has about one suffix for 109 bytes. Arrays are in the order of the suffixes'
first GRAM bytes, over range partitions whose bounds go on into what follows
(context, text), so that a common beginning is dealt to many tasks.

A new batch gets an array of its own and is merge-scanned against every level
of the family: in the merged order, neighbours that begin alike are candidates,
and neighbours whose whole contexts are alike match at once. Then arrays of equal
size merge, level by level, so each suffix is rewritten about log2(batches)
times. Of the contexts that differ under one beginning, one of each kind is
compared window by window. Where very many kinds share a beginning they go
through the same scan again under names made of more bytes; if they are still
many, their windows are counted across the cluster.

A family lives in its folder: levels, texts and state can be opened again, and a
later batch cuts, and is cut by, what earlier ones hold.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, Powers, clean_up, drop_path, drop_stage, large_batches, read_text, shared_dir, stage, text_col, tidy, write_text

LENGTH = 400
#: Passages of more words that another document has are told too, if they have at least SHORT bytes.
PASSAGE_WORDS, SHORT = 50, 240
GRAM = 24
BATCHES = 2
#: A beginning with more kinds of context, which is about 2 MB of windows, is parted by more bytes.
HOT = 4_000
#: Windows that are parted together.
BLOCK = 32
BUFFER = 1 << 20
#: Rows that a merge scan looks at together; runs at their edges are put together afterwards.
CHUNK = 200_000
#: Short texts are hashed together in arrays that stay in a core's cache.
TOGETHER = 96 << 10

KEY = ["s1", "s2", "s3"]
ORDER = [*KEY, "ctx", "tid", "first"]
ENTRY = "s1 bigint, s2 bigint, s3 bigint, ctx bigint, tid bigint, pos int, first int, last int"
SCANNED = f"{ENTRY}, settled boolean, across boolean, lead boolean, multi boolean, edge boolean, head boolean, n bigint, new bigint, low bigint, high bigint, same bigint, tmin bigint, tmax bigint, outer boolean"
CONTEXT = "s1 bigint, s2 bigint, s3 bigint, tid bigint, pos int, first int, last int, bytes binary"
RUN = "tid bigint, a bigint, b bigint, short boolean, long boolean"

_WORDS = re.compile(WORD.encode())


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def window_hashes(data: np.ndarray, lengths: tuple) -> list[np.ndarray]:
    """For each length a 64-bit hash of each run of so many bytes, by doubling; the mixing between steps leaves no algebra to collide in.

    A run is hashed from the two runs, of the largest power of two below it, that begin and end it.
    """
    h = _mix((data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    out: list = [h[:0]] * len(lengths)
    size = 1
    while True:
        for k, n in enumerate(lengths):
            if size <= n < 2 * size and len(data) >= n:
                end = len(data) - n + 1
                out[k] = _mix(h[:end] * np.uint64(0xC2B2AE3D27D4EB4F) + h[n - size : n - size + end])
        if 2 * size > max(lengths) or len(h) <= size:
            return out
        h = _mix(h[: len(h) - size] * np.uint64(0x165667B19E3779F9) + h[size:])
        size *= 2


def gram_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each run of GRAM bytes, and the words of eight bytes (the first byte lowest) that it is made of."""
    w = data.astype(np.uint64)
    for k in (1, 2, 4):
        w = w[:-k] | (w[k:] << np.uint64(8 * k))
    n = len(data) - GRAM + 1
    h = w[:n] * np.uint64(0x9E3779B97F4A7C15)
    for k, m in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9)):
        h ^= h >> np.uint64(32)
        h += w[k : k + n] * np.uint64(m)
    return _mix(h), w


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    full = np.concatenate([x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    left = np.minimum.accumulate(full, axis=1).ravel()
    right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


_POWERS = Powers()


def suffixes(texts: list[tuple[int, bytes]], short: int = SHORT, length: int = LENGTH):
    """Columns of ENTRY: s1 to s3, the suffix's first bytes in byte order; ctx, a hash of the bytes of all its windows;
    pos, its start; first to last, the windows of `short` bytes that have it."""
    out = []
    buffer, at = [], 0

    def close():
        data = np.frombuffer(b"".join(x[2] for x in buffer), np.uint8)
        grams, words = gram_hashes(data)
        place = np.arange(len(grams), dtype=np.uint64)
        least = sliding_min((grams & ~np.uint64(0xFFFFFF)) | place, short - GRAM + 1)
        sizes = np.array([len(x[2]) for x in buffer])
        starts = np.cumsum(sizes) - sizes
        count = np.array([x[3] for x in buffer])
        which = np.repeat(np.arange(len(buffer)), count)
        window = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + starts[which]
        pos = (least[window] & np.uint64(0xFFFFFF)).astype(np.int64)
        cut = np.flatnonzero((np.diff(pos) != 0) | (np.diff(which) != 0)) + 1
        lo, hi = np.append(0, cut), np.append(cut, len(pos)) - 1
        doc, p, first, last = which[lo], pos[lo], window[lo], window[hi]
        end = np.minimum(starts[doc] + sizes[doc], last + length)
        up, down = _POWERS.get(len(grams) + 1)
        total = np.append(np.uint64(0), np.cumsum(grams * up[: len(grams)]))
        ctx = _mix((total[end - GRAM + 1] - total[first]) * down[first] + (end - first).astype(np.uint64))
        byte_order = lambda k: (words[p + k].byteswap() ^ np.uint64(1 << 63)).view(np.int64)
        base = np.array([x[1] for x in buffer])[doc] - starts[doc]
        out.append((byte_order(0), byte_order(8), byte_order(16), ctx.view(np.int64), np.array([x[0] for x in buffer], np.int64)[doc], p + base, first + base, last + base))

    for tid, raw in texts:
        for lo in range(0, len(raw) - short + 1, BUFFER):  # a long text in pieces; every window begins in one
            piece = raw[lo : lo + BUFFER + length - 1]
            if at and at + len(piece) > TOGETHER:
                close()
                buffer, at = [], 0
            buffer.append((tid, lo, piece, min(BUFFER, len(raw) - lo - short + 1)))
            at += len(piece)
    if buffer:
        close()
    if not out:
        return [np.zeros(0, np.int64)] * 8
    return [np.concatenate(c) for c in zip(*out)]


def index_entries(texts: DataFrame, short: int = SHORT, length: int = LENGTH) -> DataFrame:
    """The suffixes of each text of texts(tid, text)."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame(dict(zip(NAMES, suffixes([(tid, t.encode("utf-8", "surrogatepass")) for tid, t in zip(b["tid"], b["text"])], short, length))))

    return texts.select("tid", "text").mapInPandas(tidy(run), ENTRY)


NAMES = [x.split()[0] for x in ENTRY.split(", ")]
_SCANNED = [x.split()[0] for x in SCANNED.split(", ")]


def scan_chunk(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Of entries in order, those that begin as a neighbour does, some of them new. What other chunks may still decide, and a summary of either edge's run, is marked edge."""
    size = len(c["s1"])
    change = lambda names: np.append(True, np.logical_or.reduce([c[x][1:] != c[x][:-1] for x in names]))
    head = change(KEY)
    lead = head | change(["ctx"])
    key, kind = np.cumsum(head) - 1, np.cumsum(lead) - 1
    begin, kind_begin = np.flatnonzero(head), np.flatnonzero(lead)
    end, kind_end = np.append(begin[1:], size) - 1, np.append(kind_begin[1:], size) - 1
    n, new = np.bincount(key), np.bincount(key, c["new"]).astype(np.int64)
    same, kinds = np.bincount(kind), np.bincount(key[kind_begin])
    tmin, tmax = c["tid"][kind_begin], c["tid"][kind_end]
    edge, outer = (key == 0) | (key == key[-1]), (kind == 0) | (kind == kind[-1])
    multi, settled, across = kinds[key] > 1, same[kind] > 1, (tmin != tmax)[kind]
    known = (n[key] > 1) & (new[key] > 0) & (multi | ~lead) & (~outer | settled & across)
    edge &= head | lead & outer | ~known
    keep = np.flatnonzero(edge | (new[key] > 0) & (settled | multi & lead))
    k, j = key[keep], kind[keep]
    shown = edge[keep] | (multi & lead)[keep]  # a match that is settled needs no name
    made = {
        "settled": settled[keep], "across": across[keep], "lead": lead[keep], "multi": multi[keep], "edge": edge[keep], "head": head[keep], "n": n[k], "new": new[k],
        "low": c["ctx"][begin][k], "high": c["ctx"][end][k], "same": same[j], "tmin": tmin[j], "tmax": tmax[j], "outer": outer[keep],
    }
    for x in ("n", "new", "low", "high", "same", "tmin", "tmax"):  # asked for of edges only
        made[x] = np.where(made["edge"], made[x], 0)
    return {x: np.where(shown, c[x][keep], 0) if x in (*KEY, "ctx", "pos") else c[x][keep] for x in NAMES} | made


def merge_scan(ordered: DataFrame) -> DataFrame:
    """SCANNED rows of entries in order with columns new (1 or 0) and part, which changes where rows that follow each other aren't neighbours."""

    def run(batches):
        held: list = []

        def close():
            c = {x: np.concatenate([h[x] for h in held]) for x in (*NAMES, "new")}
            return pd.DataFrame({x: v for x, v in scan_chunk(c).items()})[_SCANNED]

        size, at = 0, None
        for b in batches:
            part = b["part"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(b)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                if held and (part[lo] != at or size > CHUNK):
                    yield close()
                    held, size = [], 0
                at = part[lo]
                held.append({x: b[x].to_numpy()[lo:hi] for x in (*NAMES, "new")})
                size += hi - lo
        if held:
            yield close()

    return ordered.select(*NAMES, "new", "part").mapInPandas(tidy(run), SCANNED)


def matched(scanned: DataFrame) -> DataFrame:
    """KEY, tid, pos, first, last, settled, across, rep: entries whose contexts another has (settled; across: another text),
    and one (rep) of each kind where kinds differ under one beginning. Runs at chunks' edges, two of each chunk, are summed."""
    shown = [*KEY, "tid", "pos", "first", "last"]
    inner = scanned.where("not edge").select(*shown, "settled", "across", (F.col("multi") & F.col("lead")).alias("rep"))
    edge = scanned.where("edge")
    keys = edge.where("head").groupBy(*KEY).agg(F.sum("n").alias("kn"), F.sum("new").alias("knew"), F.min("low").alias("klow"), F.max("high").alias("khigh")).where("kn > 1 and knew > 0")
    kinds = edge.where("lead and outer").groupBy(*KEY, "ctx").agg(F.sum("same").alias("ksame"), F.min("tmin").alias("kmin"), F.max("tmax").alias("kmax"))
    fixed = edge.join(keys, KEY).join(kinds, [*KEY, "ctx"], "left")
    settled, across = F.coalesce(F.col("ksame") > 1, F.col("settled")), F.coalesce(F.col("kmin") != F.col("kmax"), F.col("across"))
    fixed = fixed.select(*shown, settled.alias("settled"), across.alias("across"), ((F.col("klow") != F.col("khigh")) & F.col("lead")).alias("rep"))
    return inner.unionByName(fixed.where("settled or rep"))


class IndexFamily:
    """Levels of suffix arrays in byte order, the texts that they index, and what was found; all in one shared folder.

    add() takes a batch; settle() compares what its matches left open; runs() gives all repeats so far, of every batch.
    IndexFamily(spark, root) opens a family that is there.
    """

    def __init__(self, spark, root: str | None = None, length: int = LENGTH, short: int = SHORT, hot: int = HOT):
        self.spark, self.root = spark, root or shared_dir(spark, "suffixes")
        state = read_text(spark, f"{self.root}/state.json")
        state = json.loads(state) if state else {"length": length, "short": min(short, length), "made": 0, "levels": {}, "texts": [], "pending": [], "runs": []}
        self.hot = hot
        self.length, self.short, self.made, self.texts_at, self.pending, self.runs_at = (state[x] for x in ("length", "short", "made", "texts", "pending", "runs"))
        self.levels: dict[int, str] = {int(k): v for k, v in state["levels"].items()}

    def save(self):
        write_text(self.spark, f"{self.root}/state.json", json.dumps({"length": self.length, "short": self.short, "made": self.made, "levels": self.levels, "texts": self.texts_at, "pending": self.pending, "runs": self.runs_at}))

    def _new(self, tag: str) -> str:
        self.made += 1
        return f"{self.root}/{tag}-{self.made}"

    def _kept(self, df: DataFrame, tag: str) -> str:
        path = self._new(tag)
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return path

    def _read(self, paths: list[str], ddl: str) -> DataFrame:
        return self.spark.read.schema(ddl).parquet(*paths) if paths else self.spark.createDataFrame([], ddl)

    def read(self, path: str) -> DataFrame:
        return self._read([path], f"{ENTRY}, part int")

    def texts(self) -> DataFrame:
        """(tid, text, n): each distinct text of at least `short` bytes, and how many rows of a batch have it; text is null where an earlier batch has it."""
        return self._read(self.texts_at, "tid bigint, text string, n bigint")

    def _sorted(self, entries: DataFrame) -> DataFrame:
        return entries.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).withColumn("part", F.spark_partition_id())

    def add(self, docs: DataFrame) -> None:
        """Indexes the texts of a batch that the family doesn't have, and scans them against all levels."""
        rows = docs.select(text_col().alias("text")).where(F.octet_length("text") >= self.short).select(F.xxhash64("text").alias("tid"), "text")
        rows = rows.groupBy("tid").agg(F.any_value("text").alias("text"), F.count("*").alias("n"))
        if self.texts_at:
            known = self.texts().select("tid", F.lit(True).alias("known")).distinct()
            rows = rows.join(known, "tid", "left").select("tid", F.when(F.col("known").isNull(), F.col("text")).alias("text"), "n")
        path = self._kept(rows.select("tid", "text", "n"), "texts")
        self.texts_at.append(path)
        fresh = self._read([path], "tid bigint, text string, n bigint").where("text is not null")
        unsorted = self._kept(index_entries(fresh, self.short, self.length), "entries")
        level, old = 0, dict(self.levels)
        path = self._kept(self._sorted(self._read([unsorted], ENTRY)), "level")
        drop_path(self.spark, unsorted)
        fresh = self.read(path).withColumn("new", F.lit(1))
        merging, gone = [], []
        while level in old:
            merging.append(old.pop(level))
            level += 1
        with large_batches(self.spark):
            if not merging and not old:
                self.pending.append(self._kept(merge_scan(fresh), "scan"))
            else:
                # in one sort: what the family holds and what is new; if all of it merges, the new level is that sort's result
                every = fresh.select(*NAMES, "new").unionByName(self._read(merging + list(old.values()), ENTRY).withColumn("new", F.lit(0)))
                if not old:
                    merged = self._kept(self._sorted(every), "level")
                    found = merge_scan(self._read([merged], f"{ENTRY}, new int, part int"))
                else:
                    found = merge_scan(self._sorted(every))
                self.pending.append(self._kept(found, "scan"))
                if merging:
                    if old:
                        merged = self._kept(self._sorted(fresh.select(*NAMES).unionByName(self._read(merging, ENTRY))), "level")
                    gone = [*merging, path]
                    path = merged
        self.levels = old | {level: path}
        self._saved(gone)

    def settle(self) -> None:
        """Compares the contexts that differ under one beginning, of all batches since the last time; runs go to the family's folder."""
        if not self.pending:
            return
        whole, reps = self._matched(self.pending)
        runs = [whole]
        contexts = stage(self._contexts(reps), "contexts")
        drop_stage(reps)
        done, gone = [contexts], self.pending
        times = self._many(contexts)
        clean_up(self.spark)
        if times.limit(1).count():
            # what begins alike in very many ways goes through the same scan again, under names that are made of more bytes
            contexts = contexts.join(times, KEY, "left")
            hot = stage(contexts.where("many").drop("many"), "contexts")
            path = self._kept(part(hot, self.short, self.length), "deeper")
            with large_batches(self.spark):
                deeper = self._kept(merge_scan(self._sorted(self._read([path], ENTRY).withColumn("new", F.lit(1)))), "scan")
            gone = [*gone, path, deeper]
            more, kinds = self._matched([deeper])
            own = hot.select("tid", "pos", F.col("first").alias("_first"), F.col("last").alias("_last"), "bytes")
            kinds = kinds.join(own, ["tid", "pos"]).where("first >= _first and last <= _last")
            kinds = kinds.withColumn("bytes", F.substr("bytes", F.col("first") - F.col("_first") + 1, F.col("last") - F.col("first") + self.length))
            kinds = stage(kinds.select(*contexts.drop("many").columns), "kinds")
            done += [hot, kinds]
            still = kinds.join(self._many(kinds), KEY, "left")
            runs += [more, compare(still.where("many is null"), self.short, self.length), compare_hot(still.where("many"), self.short, self.length)]
            contexts = contexts.where("many is null")
        runs.append(compare(contexts, self.short, self.length))
        self.runs_at.append(self._kept(reduce(DataFrame.unionByName, runs), "runs"))
        self.pending = []
        self._saved(gone)
        for x in done:
            drop_stage(x)

    def forget_levels(self) -> None:
        """For a family that takes no more batches."""
        gone, self.levels = list(self.levels.values()), {}
        self._saved(gone)

    def _saved(self, gone: list[str]) -> None:
        """The state first, then the folders that it no longer names: what breaks off between leaves folders over and none missing."""
        self.save()
        for path in gone:
            drop_path(self.spark, path)
        clean_up(self.spark)

    def _many(self, contexts: DataFrame) -> DataFrame:
        """KEY, many (true) of the beginnings with more than `hot` contexts, staged."""
        times = contexts.groupBy(*KEY).agg(F.count("*").alias("times")).where(F.col("times") > self.hot)
        return stage(times.select(*KEY, F.lit(True).alias("many")), "many")

    def _matched(self, scans: list[str]) -> tuple[DataFrame, DataFrame]:
        """RUN rows of what is settled in the scans, and what is to be compared, staged."""
        found = [matched(self._read([path], SCANNED)) for path in scans]
        whole = reduce(DataFrame.unionByName, found).where("settled").select("tid", F.col("first").cast("long").alias("a"), F.col("last").cast("long").alias("b"), F.col("across").alias("short"), F.lit(True).alias("long"))
        reps = reduce(DataFrame.unionByName, found).where("rep").select(*KEY, "tid", "pos", "first", "last")
        return whole, stage(reps, "reps")

    def _contexts(self, reps: DataFrame) -> DataFrame:
        """CONTEXT rows: the bytes of the windows of KEY, tid, pos, first, last. A text's places are fewer than its bytes, and come to it together."""
        length = self.length
        spots = reps.groupBy("tid").agg(F.collect_set(F.array(*[F.col(c).cast("long") for c in (*KEY, "pos", "first", "last")])).alias("spots"))
        names = [x.split()[0] for x in CONTEXT.split(", ")]

        def cut(frames):
            for b in frames:
                parts, held = [], 0
                for tid, text, spots in zip(b["tid"], b["text"], b["spots"]):
                    raw = text.encode("utf-8", "surrogatepass")
                    c = np.stack(spots)
                    parts.append((c, tid, [raw[x : y + length] for x, y in zip(c[:, 4].tolist(), c[:, 5].tolist())]))
                    held += sum(map(len, parts[-1][2]))
                    if held > BUFFER:
                        yield frame(parts)
                        parts, held = [], 0
                if parts:
                    yield frame(parts)

        def frame(parts):
            c = np.concatenate([c for c, _, _ in parts])
            tids = np.repeat([t for _, t, _ in parts], [len(c) for c, _, _ in parts])
            columns = [*c[:, :3].T, tids, *c[:, 3:].T, [x for _, _, xs in parts for x in xs]]
            return pd.DataFrame(dict(zip(names, columns)))

        return self.texts().where("text is not null").join(spots, "tid").select("tid", "text", "spots").mapInPandas(tidy(cut), CONTEXT)

    def runs(self) -> DataFrame:
        """(tid, runs): windows a to b of `short` bytes that another text has (short), and of `length` bytes that start anywhere else too (long)."""
        return self._read(self.runs_at, RUN).groupBy("tid").agg(F.collect_list(F.struct("a", "b", "short", "long")).alias("runs"))


def repeated(windows: np.ndarray) -> np.ndarray:
    """Which hashes occur more than once."""
    order = np.argsort(windows, kind="stable")
    x = windows[order]
    same = x[1:] == x[:-1]
    out = np.zeros(len(x), bool)
    out[order] = np.append(same, False) | np.append(False, same)
    return out


def repeated_across(windows: np.ndarray, tids: np.ndarray) -> np.ndarray:
    """Which hashes occur under more than one tid."""
    order = np.lexsort((tids, windows))
    x, t = windows[order], tids[order]
    if not len(x):
        return np.zeros(0, bool)
    begin = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    end = np.append(begin[1:], len(x)) - 1
    out = np.zeros(len(x), bool)
    out[order] = np.repeat(t[begin] != t[end], end - begin + 1)
    return out


def _windows(parts: list[bytes], counts: list[np.ndarray], lengths: tuple):
    """For each length the hash of the first counts[i] windows of each part i, in order, the part of each and its place there."""
    sizes = np.array([len(p) for p in parts])
    begin = np.cumsum(sizes) - sizes
    for h, n in zip(window_hashes(np.frombuffer(b"".join(parts), np.uint8), lengths), counts):
        which = np.repeat(np.arange(len(n)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield h[at + begin[which]], which, at


def _runs(flags: np.ndarray, which: np.ndarray, at: np.ndarray, tids: np.ndarray, firsts: np.ndarray, long: bool) -> pd.DataFrame:
    """Runs of marked windows as RUN rows."""
    k = np.flatnonzero(flags)
    cut = np.flatnonzero((np.diff(k) != 1) | (np.diff(which[k]) != 0)) + 1
    lo, hi = (k[np.append(0, cut)], k[np.append(cut, len(k)) - 1]) if len(k) else (k, k)
    w = which[lo]
    return pd.DataFrame({"tid": tids[w], "a": firsts[w] + at[lo], "b": firsts[w] + at[hi], "short": not long, "long": long})


def _counts(parts: list[bytes], first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """How many short and long windows begin in each part."""
    sizes = np.array([len(p) for p in parts])
    return last - first + 1, np.clip(sizes - length + 1, 0, last - first + 1)


def compare(contexts: DataFrame, short: int, length: int) -> DataFrame:
    """RUN rows of the windows that repeat among the contexts of one beginning, which meet in one task."""

    def close(rows):
        """Window hashes stand under their beginning's, so that many beginnings are compared together."""
        tids, first, last = (np.array([r[k] for r in rows], np.int64) for k in (3, 5, 6))
        parts = [r[7] for r in rows]
        begin = _mix(np.array([hash(r[:3]) & 0xFFFFFFFFFFFFFFFF for r in rows], np.uint64))
        out = []
        for (h, which, at), long in zip(_windows(parts, _counts(parts, first, last, length), (short, length)), (False, True)):
            h = h ^ begin[which]
            out.append(_runs(repeated(h) if long else repeated_across(h, tids[which]), which, at, tids, first, long))
        return pd.concat(out)

    def run(batches):
        done, held, group, last = [], 0, [], None
        for b in batches:
            for r in b.itertuples(index=False, name=None):
                if r[:3] != last:
                    if len(group) > 1:
                        done += group
                        held += sum(len(x[7]) for x in group)
                        if held > TOGETHER:
                            yield close(done)
                            done, held = [], 0
                    group, last = [], r[:3]
                group.append(r)
        if len(group) > 1:
            done += group
        if done:
            yield close(done)

    ordered = contexts.select(*KEY, "tid", "pos", "first", "last", "bytes").repartition(*KEY).sortWithinPartitions(*KEY)
    return ordered.mapInPandas(tidy(run), RUN)


def part(contexts: DataFrame, short: int, length: int) -> DataFrame:
    """Entries anew for contexts of common beginnings: in blocks of windows, each under a hash of the bytes that all windows of its block have, which are nearly all of theirs."""

    def run(batches):
        for b in batches:
            rows = []
            for tid, pos, first, last, raw in zip(*(b[x].tolist() for x in ("tid", "pos", "first", "last", "bytes"))):
                for j in range((pos - last) // BLOCK, (pos - first) // BLOCK + 1):
                    a, z = max(first, pos - BLOCK * j - BLOCK + 1), min(last, pos - BLOCK * j)
                    core = xxhash.xxh3_128_intdigest(raw[pos - BLOCK * j - first : pos - BLOCK * j - BLOCK + 1 + short - first], j)
                    rows.append((signed(core), signed(core >> 64), j, signed(xxhash.xxh3_64_intdigest(raw[a - first : z - first + length], z - a)), tid, pos, a, z))
            if rows:
                yield pd.DataFrame(rows, columns=NAMES)

    def signed(x):
        return (x & 0xFFFFFFFFFFFFFFFF) - (1 << 63)

    return contexts.select("tid", "pos", "first", "last", "bytes").mapInPandas(tidy(run), ENTRY)


def compare_hot(contexts: DataFrame, short: int, length: int) -> DataFrame:
    """As compare(), for very many contexts that are nearly alike: windows counted by two hashes across the cluster."""

    def run(batches):
        for b in batches:
            for i in range(0, len(b), 1000):
                some = b.iloc[i : i + 1000]
                parts, tids = list(some["bytes"]), some["tid"].to_numpy()
                first, last = some["first"].to_numpy().astype(np.int64), some["last"].to_numpy().astype(np.int64)
                counts = _counts(parts, first, last, length)
                # the second hash is of the windows read backwards
                back = [h for size, n in zip((short, length), counts) for h, _, _ in _windows([p[: c + size - 1][::-1] for p, c in zip(parts, n)], [n], (size,))]
                for (h, which, at), n, turned, long in zip(_windows(parts, counts, (short, length)), counts, back, (False, True)):
                    turned = turned[(np.cumsum(n) - 1)[which] - at]
                    yield pd.DataFrame({"h1": h.view(np.int64), "h2": turned.view(np.int64), "long": long, "tid": tids[which], "a": first[which] + at})

    windows = stage(contexts.select("tid", "first", "last", "bytes").mapInPandas(tidy(run), "h1 bigint, h2 bigint, long boolean, tid bigint, a bigint").distinct(), "windows")
    twice = windows.groupBy("h1", "h2", "long").agg(F.count("*").alias("n"), F.min("tid").alias("low"), F.max("tid").alias("high")).where("n > 1 and (long or low <> high)").select("h1", "h2", "long")
    return windows.join(twice, ["h1", "h2", "long"]).select("tid", "a", F.col("a").alias("b"), (~F.col("long")).alias("short"), "long")


def cover(runs: list, length: int, size: int) -> list[tuple[int, int]]:
    """Maximal covered byte runs for runs of window starts (a, b); windows that would pass the end are none."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if a > size - length:
            continue
        end = min(size, b + length)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([a, end])
    return [tuple(x) for x in out]


def passages(raw: bytes, spans: list[tuple[int, int]], words: int = PASSAGE_WORDS) -> int:
    """How many spans have more than so many whole words."""
    count = 0
    for a, z in spans:
        found = list(_WORDS.finditer(raw, a, z))
        cut = sum((m.start() == a and a > 0 and not raw[a - 1 : a].isspace()) or (m.end() == z and z < len(raw) and not raw[z : z + 1].isspace()) for m in (found[:1] + found[1:][-1:]))
        count += len(found) - cut > words
    return count


def report(docs: DataFrame, family: IndexFamily, id_col: str = "doc_id") -> DataFrame:
    """dedup()'s rows for docs, of whichever batch of the family."""
    length, short = family.length, family.short
    family.settle()
    spans_of = "array<struct<start:bigint,end:bigint>>"

    def strip(frames):
        for b in frames:
            out = []
            for tid, text, times, runs in zip(b["tid"], b["text"], b["times"], b["runs"]):
                raw = text.encode("utf-8", "surrogatepass")
                runs = [] if runs is None else runs
                if times > 1:
                    spans, shared = [(0, len(raw))] if len(raw) >= length else [], [(0, len(raw))]
                else:
                    spans = cover([(r["a"], r["b"]) for r in runs if r["long"]], length, len(raw))
                    shared = cover([(r["a"], r["b"]) for r in runs if r["short"]], short, len(raw))
                kept, at = [], 0
                for a, z in spans:
                    kept.append(raw[at:a])
                    at = z
                kept = b"".join([*kept, raw[at:]])
                out.append((tid, sum(z - a for a, z in spans), len(spans), hashlib.sha256(kept).hexdigest(), passages(raw, shared), [{"start": a, "end": z} for a, z in spans]))
            yield pd.DataFrame(out, columns=["tid", "n_removed", "n_spans", "kept_sha256", "n_passages", "spans"])

    texts = family.texts()
    times = texts.groupBy("tid").agg(F.sum("n").alias("times"))
    rows = texts.where("text is not null").join(times, "tid").join(family.runs(), "tid", "left").where("times > 1 or runs is not null")
    cut = rows.select("tid", "text", "times", "runs").mapInPandas(tidy(strip), f"tid bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passages bigint, spans {spans_of}")
    plain = docs.select(F.col(id_col).alias("doc_id"), text_col().alias("text"))
    plain = plain.select("doc_id", F.xxhash64("text").alias("_tid"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("_sha"))
    out = plain.join(cut, F.col("tid") == F.col("_tid"), "left")
    zero = F.lit(0).cast("long")
    n_removed = F.coalesce("n_removed", zero)
    return out.select(
        "doc_id", "n_bytes", n_removed.alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "_sha").alias("kept_sha256"),
        (F.col("n_bytes") - n_removed).alias("n_kept"), F.coalesce("n_passages", zero).alias("n_passages"), F.coalesce("spans", F.array().cast(spans_of)).alias("spans"),
    )


def dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", batches: int = BATCHES, short: int = SHORT, hot: int = HOT, family: IndexFamily | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept, n_passages, spans (the removed byte runs).

    Each byte inside a string of length bytes that starts anywhere else too,
    the same text included, is removed; strings are judged on the input and
    never cross documents. n_passages counts the passages of more than
    PASSAGE_WORDS words, and at least `short` bytes, that another document has;
    they may be shorter than length and are not removed for that. Null text is
    empty; a text under length bytes keeps all; rows with equal texts of length
    bytes or more lose all; an empty table gives no rows; ids may be null or
    repeated; other columns are not read. The texts are added to the family, if
    one is given, and judged with all that it holds; report() gives the earlier
    batches' rows anew. Texts and contexts are named by 64-bit hashes: among n
    distinct ones a wrong meeting has odds of about n**2 / 2**65.
    """
    given = family is not None
    family = family or IndexFamily(docs.sparkSession, length=length, short=short, hot=hot)
    for k in range(batches):
        family.add(docs.where(F.pmod(F.xxhash64(text_col()), F.lit(batches)) == k) if batches > 1 else docs)
    family.settle()
    if not given:
        family.forget_levels()
    return report(docs, family, id_col)
