"""Token IDs as Arrow files of fixed-size lists: equal-length sequences and masks with zero-copy random access.

A shard is one Arrow IPC file. Column `ids` is a fixed-size list of seq_len
unsigned integers, column `mask` a fixed-size list of seq_len booleans (false
where the last sequence is padded); every record batch but the last has
BATCH_ROWS sequences, so sequence i lies in batch i // BATCH_ROWS at row
i % BATCH_ROWS, and a memory map of the file gives it without a copy. Beside it
lies `<name>.docs`, an Arrow file of (doc_id, start, n_tokens) in shard order.

A task writes under a name of its own and returns it; the manifest has the
names of the tasks that ended, so a repeated or lost task leaves no wrong rows.
"""

from __future__ import annotations

import re
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Powers, arrow_fs, shared_dir, stage, text_col, tidy

_POWERS = Powers()
SEQ_LEN = 1024
BATCH_ROWS = 256
#: Distinct words that a Python worker remembers; beyond it all are forgotten.
MOST_KEPT = 700_000
#: Characters that are looked at together, in arrays that stay in a core's cache.
TOGETHER = 96 << 10
#: A longer word's hash is taken from its string, not from sums.
LONG_WORD = 48

#: Characters for which this module's word pattern and lower case are those of the tokenizer; other texts go to the library whole.
_OTHER = re.compile("[^\t-\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏ‐-‧€]|<\\|")
_LETTERS = re.compile("[a-zªµºß-öø-ɏ]")  # in lower case
#: What may follow an apostrophe as a word of its own.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
SPACE, LETTER, DIGIT, SIGN, FOREIGN = range(5)


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """The kind and the lower case of each character; the last kind stands for all above."""
    kind, low = np.full(0x20B0, FOREIGN, np.uint8), np.arange(0x20B0, dtype=np.uint64)
    for k in range(len(kind) - 1):
        c = chr(k)
        if not _OTHER.search(c):
            low[k] = ord(c.lower())
            kind[k] = SPACE if c.isspace() else LETTER if _LETTERS.match(c.lower()) else DIGIT if c in "0123456789" else SIGN
    return kind, low


def words_in(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words: runs of letters, runs of signs, digits one by one, an apostrophe with its ending where no sign
    is before it. Then their hashes, the kinds of all characters, and where "<|" is."""
    kinds, lower = _characters()
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.minimum(code, np.uint32(len(kinds) - 1))
    kind, low = kinds[code], lower[code]
    edge = np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)) + 1
    start = np.append(0, edge) if len(code) else edge
    end = np.append(edge, len(code)) if len(code) else edge
    keep = kind[start] != SPACE
    start, end = start[keep], end[keep]
    # an apostrophe alone, with letters right after it
    at = np.flatnonzero((low[start] == ord("'")) & (end - start == 1))
    at = at[at + 1 < len(start)]
    at = at[(start[at + 1] == end[at]) & (kind[start[at + 1]] == LETTER)]
    if len(at):
        a = low[start[at + 1]]
        two = end[at + 1] - start[at + 1] > 1
        b = np.where(two, low[np.minimum(start[at + 1] + 1, len(low) - 1)], 0)
        size = np.zeros(len(at), np.int64)
        for x in _ENDINGS:
            size[(a == ord(x[0])) & ((b == ord(x[1])) if len(x) > 1 else True) & (size == 0)] = len(x)
        start, end = start.copy(), end.copy()
        end[at] += size
        start[at + 1] += size
        keep = start < end
        start, end = start[keep], end[keep]
    up, down = _POWERS.get(len(code) + 1)
    total = np.zeros(len(code) + 1, np.uint64)
    np.cumsum((low + np.uint64(1)) * up[: len(code)], out=total[1:])
    h = (total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    for k in np.flatnonzero(end - start > LONG_WORD).tolist():
        h[k] = xxhash.xxh3_64_intdigest(text[start[k] : end[k]].lower().encode("utf-8", "surrogatepass"))
    h[h == 0] = 1
    special = np.flatnonzero((low[:-1] == ord("<")) & (low[1:] == ord("|")))
    return start, end, h, kind, special


class Table:
    """Hashes to places, by open addressing in arrays; 0 is no hash."""

    def __init__(self, bits: int = 14):
        self.bits, self.n = bits, 0
        self.keys, self.places = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        key = self.keys[slot]
        out = np.where(key == h, self.places[slot], -1)
        todo = np.flatnonzero((key != h) & (key != 0))
        mask = len(self.keys) - 1
        while len(todo):
            slot[todo] = (slot[todo] + 1) & mask
            key = self.keys[slot[todo]]
            hit = key == h[todo]
            out[todo[hit]] = self.places[slot[todo[hit]]]
            todo = todo[~hit & (key != 0)]
        return out

    def add(self, h: np.ndarray, places: np.ndarray):
        """Distinct hashes that are not there."""
        if 2 * (self.n + len(h)) > len(self.keys):
            used = np.flatnonzero(self.keys)
            old, at = self.keys[used], self.places[used]
            self.__init__(max(self.bits + 1, int(3 * (self.n + len(h))).bit_length()))
            self.add(old, at)
        self.n += len(h)
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        todo, mask = np.arange(len(h)), len(self.keys) - 1
        while len(todo):
            _, first = np.unique(slot[todo], return_index=True)
            first = first[self.keys[slot[todo[first]]] == 0]
            self.keys[slot[todo[first]]] = h[todo[first]]
            self.places[slot[todo[first]]] = places[todo[first]]
            todo = np.delete(todo, first)
            slot[todo] = (slot[todo] + 1) & mask


class Encoder:
    """Texts to ids, many words at a time. The tokenizer merges inside a word only, so a text's ids are its words' ids.

    Words are found, hashed and looked up in arrays. New ones are encoded many
    at a time with spaces between them; the ids that end a word, by their
    vocabulary strings, part them again. Words are named by 64-bit hashes:
    among n distinct ones a wrong meeting has odds of about n**2 / 2**65.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab()
        self.dtype = np.dtype("<u4" if max(vocab.values()) >= 1 << 16 else "<u2")
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        self.word_ends = np.zeros(max(vocab.values()) + 1, bool)
        self.word_ends[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True
        #: The word pattern above is this tokenizer's; any other vocabulary is encoded by the library alone.
        rule = str(self.library.pre_tokenizer).replace("\\\\", "\\")
        self.by_words = bool(suffix) and self.library.normalizer is not None and r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in rule and "ByteLevel(add_prefix_space=False" in rule
        self.forget()

    def forget(self):
        #: Word k has the ids from place first[k] to first[k + 1].
        self.table, self.n_ids, self.n = Table(), 0, 0
        self.ids, self.first = np.zeros(1 << 16, self.dtype), np.zeros(1 << 14, np.int64)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _learn(self, words: list[str], hashes: np.ndarray):
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            ids = self._ids(" ".join(part))
            sizes = np.diff(np.append(-1, np.flatnonzero(self.word_ends[ids])))
            if len(sizes) != len(part):
                each = [self._ids(w) for w in part]
                ids, sizes = np.concatenate(each), np.array([len(x) for x in each])
            n, m = self.n + len(part), self.n_ids + len(ids)
            if m > len(self.ids):
                self.ids = np.append(self.ids, np.zeros(max(m, len(self.ids)), self.dtype))
            if n >= len(self.first):
                self.first = np.append(self.first, np.zeros(max(n, len(self.first)), np.int64))
            self.ids[self.n_ids : m] = ids
            self.first[self.n + 1 : n + 1] = self.n_ids + np.cumsum(sizes)
            self.table.add(hashes[i : i + 20_000], np.arange(self.n, n, dtype=np.int32))
            self.n, self.n_ids = n, m

    def _chunk(self, texts: list[str]) -> list[np.ndarray]:
        joined = "\n".join(texts)
        start, end, h, kind, special = words_in(joined)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        begin = np.cumsum(sizes) - sizes
        odd = np.concatenate([np.flatnonzero(kind == FOREIGN), special])
        foreign = np.unique(np.searchsorted(begin, odd, "right") - 1)
        bounds = np.searchsorted(start, np.append(begin, len(joined) + 1))
        if len(foreign):
            keep = np.ones(len(start), bool)
            for k in foreign.tolist():
                keep[bounds[k] : bounds[k + 1]] = False
            bounds = np.append(0, np.cumsum(keep))[bounds]
            start, end, h = start[keep], end[keep], h[keep]
        place = self.table.find(h)
        if (place < 0).any():
            new = np.flatnonzero(place < 0)
            own, at = np.unique(h[new], return_index=True)
            at = new[at]
            if self.n + len(own) > MOST_KEPT:
                self.forget()
                own, at = np.unique(h, return_index=True)
            self._learn([joined[a:z].lower() for a, z in zip(start[at].tolist(), end[at].tolist())], own)
            place = self.table.find(h)
        first = self.first[place]
        count = self.first[place + 1] - first
        total = np.append(0, np.cumsum(count))
        flat = self.ids[np.arange(total[-1]) + np.repeat(first - total[:-1], count)]
        cuts = total[bounds]
        out = [flat[a:z] for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        for k in foreign.tolist():
            out[k] = self._ids(texts[k])
        return out

    def _long(self, text: str) -> np.ndarray:
        """A text of many characters, cut at white space."""
        if _OTHER.search(text):
            return self._ids(text)
        out, lo = [], 0
        while lo < len(text):
            cut = _CUT.search(text, lo + TOGETHER)
            hi = cut.end() if cut else len(text)
            out += self._chunk([text[lo:hi]])
            lo = hi
        return np.concatenate(out)

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, without special tokens."""
        if not self.by_words:
            return [self._ids(t) for t in texts]
        out, held, size = [], [], 0
        for t in texts:
            if held and size + len(t) > TOGETHER:
                out += self._chunk(held)
                held, size = [], 0
            if len(t) > 4 * TOGETHER:
                out.append(self._long(t))
                continue
            held.append(t)
            size += len(t)
        return out + (self._chunk(held) if held else [])


_CUT = re.compile("[ \t-\r]")


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


class ShardWriter:
    """Appends documents; whole record batches go to the file as they fill."""

    def __init__(self, uri: str, dtype: np.dtype, seq_len: int, id_type):
        import pyarrow as pa

        self.pa, self.seq_len, self.dtype = pa, seq_len, dtype
        self.fs, self.path = arrow_fs(uri)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        ids = pa.list_(pa.from_numpy_dtype(dtype), seq_len)
        self.schema = pa.schema([("ids", ids), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.sink = self.fs.open_output_stream(self.path)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.docs_schema = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.docs_sink = self.fs.open_output_stream(self.path + ".docs")
        self.docs_file = pa.ipc.new_file(self.docs_sink, self.docs_schema)
        self.held, self.n_held, self.n_ids, self.n_docs, self.docs = [], 0, 0, 0, []

    def add(self, doc_id, ids: np.ndarray, end: np.ndarray):
        n = len(ids) + len(end)
        self.docs.append((doc_id, self.n_ids, n))
        self.held += (ids, end)
        self.n_held += n
        self.n_ids += n
        self.n_docs += 1
        if self.n_held >= BATCH_ROWS * self.seq_len:
            self._flush(False)
        if len(self.docs) >= 10_000:
            self._flush_docs()

    def _flush(self, last: bool):
        flat = np.concatenate(self.held) if self.held else np.zeros(0, self.dtype)
        step = BATCH_ROWS * self.seq_len
        whole = len(flat) // step * step
        for i in range(0, whole, step):
            self._write(flat[i : i + step], step)
        rest = flat[whole:]
        if last and len(rest):
            n = -(-len(rest) // self.seq_len) * self.seq_len
            self._write(np.concatenate([rest, np.zeros(n - len(rest), self.dtype)]), len(rest))
            rest = rest[:0]
        self.held, self.n_held = [rest.copy()], len(rest)

    def _write(self, flat, n):
        pa = self.pa
        mask = pa.array(np.arange(len(flat)) < n)
        lists = [pa.FixedSizeListArray.from_arrays(x, self.seq_len) for x in (pa.array(flat), mask)]
        self.file.write_batch(pa.record_batch(lists, schema=self.schema))

    def _flush_docs(self):
        if self.docs:
            columns = list(zip(*self.docs))
            self.docs_file.write_batch(self.pa.record_batch([self.pa.array(c, f.type) for c, f in zip(columns, self.docs_schema)], schema=self.docs_schema))
        self.docs = []

    def close(self):
        self._flush(True)
        self._flush_docs()
        for x in (self.file, self.sink, self.docs_file, self.docs_sink):
            x.close()


class Shard:
    """Random access to a written shard."""

    def __init__(self, uri: str):
        import pyarrow as pa

        self.fs, self.path = arrow_fs(uri)
        local = type(self.fs).__name__ == "LocalFileSystem"
        self.source = pa.memory_map(self.path) if local else self.fs.open_input_file(self.path)
        self.file = pa.ipc.open_file(self.source)
        self.seq_len = self.file.schema.field("ids").type.list_size

    def batch(self, k: int) -> tuple[np.ndarray, int]:
        """The ids of a record batch as one array, and how many of them are not padding."""
        b = self.file.get_batch(k)
        ids = b.column("ids").flatten().to_numpy(zero_copy_only=True)
        return ids, b.column("mask").flatten().true_count if k == self.file.num_record_batches - 1 else len(ids)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Sequence i and its mask; the ids are a view into the mapped file."""
        b = self.file.get_batch(i // BATCH_ROWS)
        row = i % BATCH_ROWS
        ids = b.column("ids").flatten().to_numpy(zero_copy_only=True)
        return ids[row * self.seq_len : (row + 1) * self.seq_len], b.column("mask")[row].values.to_numpy(zero_copy_only=False)

    def documents(self):
        """(doc_id, start, ids) in the shard's order."""
        import pyarrow as pa

        pending, held, k = [], 0, 0
        with self.fs.open_input_file(self.path + ".docs") as f:
            for d in range((docs := pa.ipc.open_file(f)).num_record_batches):
                for doc in docs.get_batch(d).to_pylist():
                    n = doc["n_tokens"]
                    while held < n:
                        ids, real = self.batch(k)
                        pending.append(ids[:real])
                        held += real
                        k += 1
                    flat = pending[0] if len(pending) == 1 else np.concatenate(pending)
                    yield doc["doc_id"], doc["start"], flat[:n]
                    pending, held = [flat[n:]], held - n


def write(docs: DataFrame, tokenizer: str, end_id: int = 2, seq_len: int = SEQ_LEN, id_col: str = "doc_id", to: str | None = None) -> DataFrame:
    """Writes all documents in ascending id order (null ids first) and returns the manifest:
    path, first_id, part, n_ids, n_docs, n_sequences, base (ids of all shards before).

    A shard is what one task wrote; range partitions are in order, so part, the
    task's partition number, orders the shards, also where rows of one id fill
    several. Null and empty texts have the end id alone; repeated ids stand
    beside each other, in the order of a hash of their texts; an empty table
    gives an empty manifest; texts of any length are encoded whole; other
    columns are not read.
    """
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    to = to or shared_dir(spark, "tokens")
    kind = docs.schema[id_col].dataType
    arrow_kind = to_arrow_type(kind)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_col().alias("text"))
    rows = rows.withColumn("_h", F.xxhash64("text")).repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").drop("_h")

    def run(batches):
        enc, out, first, uri = encoder(tokenizer), None, None, None
        end = np.array([end_id], enc.dtype)
        for b in batches:
            n = len(b)
            ids = b["doc_id"].astype(object).where(b["doc_id"].notna(), None).tolist()
            for i in range(0, n, 1000):
                for d, x in zip(ids[i : i + 1000], enc.batch(b["text"].iloc[i : i + 1000].tolist())):
                    if out is None:
                        uri = f"{to}/{uuid.uuid4().hex}.arrow"
                        out, first = ShardWriter(uri, enc.dtype, seq_len, arrow_kind), d
                    out.add(d if d is None or not isinstance(d, float) else int(d), x, end)
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [uri], "first_id": pd.Series([first], dtype=object), "part": [TaskContext.get().partitionId()], "n_ids": [out.n_ids], "n_docs": [out.n_docs], "n_sequences": [-(-out.n_ids // seq_len)]})

    made = rows.mapInPandas(tidy(run), f"path string, first_id {kind.simpleString()}, part bigint, n_ids bigint, n_docs bigint, n_sequences bigint")
    made = stage(made, "manifest")
    # one row for each shard
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return made.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of each document, from the files alone.

    A document of null or empty text has its end id; null and repeated ids come
    back as they were written, each row by itself; long documents go over as
    many sequences and record batches as they need; an empty manifest gives no
    rows; only path and base of the manifest are read. A missing or cut file is an error.
    """
    spark = manifest.sparkSession
    shards = max(1, manifest.count())

    def run(batches):
        for b in batches:
            for path, base in zip(b["path"], b["base"]):
                rows = []
                for doc, start, ids in Shard(path).documents():
                    rows.append((doc, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids if with_ids else None))
                    if len(rows) >= (200 if with_ids else 20_000):
                        yield frame(rows)
                        rows = []
                if rows:
                    yield frame(rows)

    def frame(rows):
        d, s, n, c, ids = zip(*rows)
        out = pd.DataFrame({"doc_id": pd.Series(d, dtype=object), "start": s, "n_tokens": n, "ids_crc32": c})
        if with_ids:
            out["ids"] = [x.astype(np.int64) for x in ids]
        return out

    kind = manifest.schema["first_id"].dataType.simpleString()
    shape = f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else "")
    dealt = manifest.select("path", "base").repartition(min(shards, max(shards // 4, spark.sparkContext.defaultParallelism)))
    return dealt.mapInPandas(tidy(run), shape)
