"""Search over a stored tree by trigrams: files that can't match aren't read.

Files are stored by a bucket of their path. Their postings lie in the same
bucket: segments of lists, sorted by trigram, each of the files that a task
read, so an index is written without a row for each trigram of each file, and
without moving files again. A change rewrites its files' buckets. A pattern gives a
Boolean query over trigrams that every match must hold, and of the postings only
the lists of these are read; a pattern without any reads all files.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folders import staged
from ..streaming.store import BucketStore, latest
from .search import search_lines

FILES, POSTINGS = "path string, content string", "gram string, paths array<string>"
#: Parts of a bucket, which are written by as many tasks.
SEGMENTS = 16
#: Characters indexed at once; postings that a task holds before it lists them; postings in a batch of lists.
CHARS_AT_ONCE, MOST_POSTINGS, POSTINGS_AT_ONCE = 1 << 21, 1 << 22, 1 << 16


def _and(parts: list):
    """A query of all parts, those that ask for nothing left out; None asks for nothing."""
    flat = [y for x in parts if x is not None for y in (x[1] if x[0] == "and" else [x])]
    flat = list(dict.fromkeys(flat))
    return None if not flat else flat[0] if len(flat) == 1 else ("and", tuple(flat))


def _or(parts: list):
    """A query of any part; it asks for nothing where one does."""
    if not parts or any(p is None for p in parts):
        return None
    flat = list(dict.fromkeys(parts))
    return flat[0] if len(flat) == 1 else ("or", tuple(flat))


def _of_run(run: str):
    return _and([("gram", run[i : i + 3]) for i in range(len(run) - 2)])


def _of_tree(items):
    """What every match of a parsed pattern holds: runs of single ASCII letters give their trigrams."""
    from re import _constants as C

    parts, run = [], ""

    def close():
        nonlocal run
        parts.append(_of_run(run))
        run = ""

    for op, value in items:
        if op is C.LITERAL and value < 128 and value not in (10, 13):
            run += chr(value).lower()
            continue
        if op is C.SUBPATTERN and not value[1] and not value[2] and all(o is C.LITERAL and v < 128 for o, v in value[3]):
            run += "".join(chr(v).lower() for _, v in value[3])
            continue
        if op is C.AT:  # a place has no width
            continue
        close()
        if op is C.SUBPATTERN:
            parts.append(_of_tree(value[3]))
        elif op is C.BRANCH:
            parts.append(_or([_of_tree(x) for x in value[1]]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and value[0] > 0:
            parts.append(_of_tree(value[2]))
        elif op is C.ATOMIC_GROUP:
            parts.append(_of_tree(value))
    close()
    return _and(parts)


def query_of(pattern: str, regex: bool = False):
    """("gram", g), ("and", parts), ("or", parts), or None where nothing can be said. What isn't read alike by all engines says nothing."""
    if not regex:
        return _and([_of_run(run) for run in re.split(r"[^\x00-\x7f]|[\r\n]", "".join(c.lower() if c.isascii() else c for c in pattern))])
    if "&&" in pattern or "(?" in re.sub(r"\(\?(?::|=|!|<=|<!)", "", pattern):
        return None
    try:
        return _of_tree(re._parser.parse(pattern))
    except (re.error, RecursionError, OverflowError):
        return None


def grams_in(query) -> list[str]:
    if query is None:
        return []
    return [query[1]] if query[0] == "gram" else sorted({g for x in query[1] for g in grams_in(x)})


def _matching(postings: DataFrame, query) -> DataFrame:
    """path of the files whose postings meet the query."""
    if query[0] == "gram":
        return postings.where(F.col("gram") == query[1]).select("path")
    if query[0] == "or":
        return reduce(DataFrame.union, [_matching(postings, x) for x in query[1]]).distinct()
    plain, other = [x[1] for x in query[1] if x[0] == "gram"], [x for x in query[1] if x[0] != "gram"]
    parts = [_matching(postings, x) for x in other]
    if plain:
        parts.append(postings.where(F.col("gram").isin(*plain)).groupBy("path").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(plain)).select("path"))
    return reduce(lambda a, b: a.join(b, "path", "left_semi"), parts)


def _postings(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(trigram as three code points of 21 bits, text's number) for the distinct trigrams of each text, A to Z in lower case."""
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where((codes >= 65) & (codes <= 90), codes + 32, codes)
    there = np.zeros(int(codes.max(initial=0)) + 1, bool)
    there[codes] = True
    alphabet = np.flatnonzero(there).astype(np.uint64)
    n = len(alphabet)
    if len(texts) > 1 and n**3 * len(texts) >= 1 << 63:  # more letters than a number holds for so many texts
        middle = len(texts) // 2
        (a, x), (b, y) = _postings(texts[:middle]), _postings(texts[middle:])
        return np.concatenate([a, b]), np.concatenate([x, y + middle])
    letters = (np.cumsum(there) - 1)[codes]
    text = np.repeat(np.arange(len(texts)), lengths)
    inside = text[2:] == text[:-2]
    pairs = (((text[:-2] * n + letters[:-2]) * n + letters[1:-1]) * n + letters[2:])[inside]
    pairs.sort()
    pairs = pairs[np.diff(pairs, prepend=-1) != 0]
    text, gram = np.divmod(pairs, max(n, 1) ** 3)
    part = lambda k: alphabet[gram // n**k % n]
    return (part(2) << np.uint64(42)) | (part(1) << np.uint64(21)) | part(0), text


def _lists(paths: list[str], buckets: np.ndarray, grams: np.ndarray, files: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each bucket and trigram, in this order, with its files' paths."""
    order = np.lexsort((grams, buckets[files]))
    grams, files = grams[order], files[order]
    of = buckets[files]
    starts = np.flatnonzero(np.append(True, (np.diff(grams) != 0) | (np.diff(of) != 0)))
    ends, names = np.append(starts[1:], len(grams)), pa.array(paths, pa.string())
    k = 0
    while k < len(starts):
        until = max(k + 1, int(np.searchsorted(ends, starts[k] + POSTINGS_AT_ONCE, "right")))
        first, last = starts[k], ends[until - 1]
        g = grams[starts[k:until]]
        text = np.stack([g >> np.uint64(42), g >> np.uint64(21), g], 1).astype(np.uint64) & np.uint64((1 << 21) - 1)
        text = text.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
        offsets = np.append(starts[k:until], last) - first
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), names.take(pa.array(files[first:last])))
        yield pa.record_batch({"bucket": pa.array(of[starts[k:until]], pa.int32()), "gram": pa.array([text[x : x + 3] for x in range(0, len(text), 3)], pa.string()), "paths": lists})
        k = until


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of the files of a task, of at most about MOST_POSTINGS each time. Batches have path, content, bucket."""
    paths, buckets, held, n = [], [], [], 0
    texts, size, first = [], 0, 0

    def indexed():
        nonlocal texts, size, first, n
        if texts:
            grams, text = _postings(texts)
            held.append((grams, text + first))
            n += len(grams)
        texts, size, first = [], 0, len(paths)

    def listed():
        nonlocal paths, buckets, held, n, first
        if n:
            yield from _lists(paths, np.array(buckets, np.int32), *(np.concatenate(x) for x in zip(*held)))
        paths, buckets, held, n, first = [], [], [], 0, 0

    for batch in batches:
        for path, content, bucket in zip(batch.column("path").to_pylist(), batch.column("content"), batch.column("bucket").to_pylist()):
            text = content.as_py() or ""
            paths.append(path)
            buckets.append(bucket)
            texts.append(text)
            size += len(text)
            if size >= CHARS_AT_ONCE:
                indexed()
                if n >= MOST_POSTINGS:
                    yield from listed()
    indexed()
    yield from listed()


def postings_of(files: DataFrame) -> DataFrame:
    """(bucket, gram, paths): the files(path, content, bucket) of a task that hold a trigram, A to Z in lower case; a trigram has a row for each task and bucket at least."""
    return files.select("path", "content", "bucket").mapInArrow(_index, f"bucket int, {POSTINGS}")


def update_index(spark, path: str, number: int, changed: DataFrame, files: DataFrame, buckets: int = 64) -> BucketStore:
    """Puts files(path, content) in the place of those of changed(path); a changed file that isn't among files is gone. number as in BucketStore."""
    store = BucketStore(spark, path, number, buckets)
    changed = staged(changed.select("path").distinct(), "changed")
    at = store.touched(changed, "path")
    new = files.select("path", "content").where("content is not null").join(changed, "path", "left_semi").dropDuplicates(["path"])
    old = store.read("files", FILES, at).join(changed, "path", "left_anti").select("path", "content")
    segment = F.pmod(F.xxhash64("path", F.lit(SEGMENTS)), F.lit(SEGMENTS))
    store.put("files", old.unionByName(new).withColumn("bucket", store.bucket("path")).repartition("bucket", segment), at)
    # lists are made where files are read
    lists = postings_of(store.read("files", FILES, at).withColumn("bucket", store.bucket("path")))
    store.put("postings", lists.sortWithinPartitions("bucket", "gram"), at)
    store.commit()
    return store


def search(spark, path: str, pattern: str, regex: bool = False, glob: str | None = None, most: int | None = 100, store: BucketStore | None = None) -> DataFrame:
    """search_lines() over the stored files; only buckets of files that the trigrams allow are read."""
    store = store or latest(spark, path)
    query = query_of(pattern, regex)
    if query is None:
        return search_lines(store.read("files", FILES), pattern, regex=regex, glob=glob, most=most)
    asked = store.read("postings", POSTINGS).where(F.col("gram").isin(*grams_in(query))).select("gram", F.explode("paths").alias("path"))
    found = staged(_matching(asked, query).distinct(), "found")
    files = store.read("files", FILES, store.touched(found, "path")).join(found, "path", "left_semi")
    return search_lines(files, pattern, regex=regex, glob=glob, most=most)
