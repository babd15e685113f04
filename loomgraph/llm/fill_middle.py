"""Fill-in-the-middle transformation by overlapping chunks of UTF-8 bytes.

A token is white space and the word after it, so a token begins at the text's
first byte and wherever white space follows something else. White space is
ASCII, and no byte of a longer character is, so the predicate on two adjacent
bytes finds the same places as one on characters. A batch's texts are one
buffer; every text is cut into chunks of CHUNK bytes, each seen with the byte
before it, and the beginnings are counted for all chunks at once. Sums of the
counts before a chunk say which chunk owns a cut's rank; only the two chunks
that own a cut are read again for its place. A row's text is in one task
already, so no text is shuffled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_col, tidy

CHUNK = 4096
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Which bytes are white space: those of [\x20\x09-\x0D].
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


class Chunks:
    """The token beginnings of many texts, counted by chunk. buffer: all texts' bytes; text i is buffer[offsets[i]:offsets[i + 1]]."""

    def __init__(self, buffer: np.ndarray, offsets: np.ndarray, chunk: int = CHUNK):
        self.buffer, self.offsets, self.chunk = buffer, offsets.astype(np.int64), chunk
        sizes = np.diff(self.offsets)
        per_text = -(-sizes // chunk)
        self.first = np.concatenate([[0], np.cumsum(per_text)])  # of each text: its first chunk
        owner = np.repeat(np.arange(len(sizes)), per_text)
        number = np.arange(len(owner)) - self.first[owner]
        self.starts = self.offsets[owner] + number * chunk
        self.ends = np.minimum(self.starts + chunk, self.offsets[owner + 1])
        counts = np.zeros(len(owner), np.int64)
        if len(owner):
            # chunks stand one after another, so counting is one pass over the bytes and their left neighbours
            blank = BLANK[buffer[self.offsets[0] : self.offsets[-1]]]
            begins = np.empty(len(blank), bool)
            begins[1:] = blank[1:] & ~blank[:-1]
            begins[(self.offsets[:-1] - self.offsets[0])[sizes > 0]] = True
            counts = np.add.reduceat(begins, self.starts - self.offsets[0], dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)])  # beginnings in all chunks before

    def n_tokens(self) -> np.ndarray:
        return self.before[self.first[1:]] - self.before[self.first[:-1]]

    def place(self, text: int, rank: int) -> int:
        """The byte, in its text, at which the token of that rank (from 0) begins; the text's end for the rank after the last."""
        lo, hi = self.first[text], self.first[text + 1]
        if rank >= self.before[hi] - self.before[lo]:
            return int(self.offsets[text + 1] - self.offsets[text])
        k = int(np.searchsorted(self.before[lo : hi + 1], self.before[lo] + rank, side="right")) - 1 + lo
        a, b = self.starts[k], self.ends[k]
        blank = BLANK[self.buffer[max(a - 1, self.offsets[text]) : b]]
        begins = blank[1:] & ~blank[:-1]
        if k == lo:  # nothing is before the text's first byte
            begins = np.append(True, begins)
        return int(a - self.offsets[text] + np.flatnonzero(begins)[self.before[lo] + rank - self.before[k]])

    def characters(self, text: int, at: int, to: int) -> int:
        """Characters in the text's bytes from at to to: bytes that don't continue one."""
        return int(np.count_nonzero((self.buffer[self.offsets[text] + at : self.offsets[text] + to] & 0xC0) != 0x80))


def _bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """The buffer of an Arrow column of strings without nulls, and where each begins, without a copy."""
    _, offsets, data = column.buffers()
    wide = np.int64 if str(column.type) == "large_string" else np.int32
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, wide)
    return np.frombuffer(data or b"", np.uint8), at.astype(np.int64)


def _draws(id_col: str, seed: int) -> list[Column]:
    """Four unsigned numbers of 32 bits from the seeded hash of the id; a null id is the text null."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, id_col: str = "doc_id", rate: int = 50, spm_rate: int = 80, seed: int = 42, chunk: int = CHUNK) -> DataFrame:
    """One row for each row of docs: doc_id, n (tokens), form, prefix_chars, middle_chars, output.

    Of a hundred documents rate are cut in three at two token beginnings; spm_rate
    of a hundred of those have form spm (suffix, prefix, middle), the others psm.
    The cuts and the form come from the id and the seed alone, so reruns agree.

    Null and empty texts are plain and have no tokens; so are texts that hold a
    marker. Repeated rows are cut alike, null ids are all drawn as one id, long
    texts are cut whole, an empty table gives no rows, and other columns of
    docs, whatever they are called, are not read.
    """

    def run(batches):
        import pyarrow as pa

        marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
        first, second, third = marks
        for b in batches:
            buffer, offsets = _bytes_of(b.column("_text"))
            chunks = Chunks(buffer, offsets, chunk)
            n = chunks.n_tokens()
            draws = [b.column(f"_h{k}").to_numpy().tolist() for k in (1, 2, 3, 4)]
            out = []
            for i, (h1, h2, h3, h4) in enumerate(zip(*draws)):
                text = buffer[offsets[i] : offsets[i + 1]].tobytes()
                if not text or h3 % 100 >= rate or any(m in text for m in marks):
                    out.append(("plain", None, None, text))
                    continue
                low, high = sorted(h % (int(n[i]) + 1) for h in (h1, h2))
                at, to = chunks.place(i, low), chunks.place(i, high)
                prefix, middle, suffix = text[:at], text[at:to], text[to:]
                spm = h4 % 100 < spm_rate
                cut = (second, suffix, first, prefix, third, middle) if spm else (first, prefix, second, suffix, third, middle)
                out.append(("spm" if spm else "psm", chunks.characters(i, 0, at), chunks.characters(i, at, to), b"".join(cut)))
            form, prefix, middle, output = zip(*out) if out else ((),) * 4
            columns = [b.column("doc_id"), pa.array(n), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col(id_col).alias("doc_id"), text_col().alias("_text"), *[h.alias(f"_h{k}") for k, h in enumerate(_draws(id_col, seed), 1)])
    return rows.mapInArrow(tidy(run), f"doc_id {docs.schema[id_col].dataType.simpleString()}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(form: str = "form", output: str = "output") -> Column:
    """The exact text, from output and form alone. A cut text holds no marker, and none arises where parts meet, so each marker is found once."""
    out = F.col(output)
    after = lambda marker: F.substring_index(out, marker, -1)
    between = lambda a, b: F.substring_index(F.substring_index(out, b, 1), a, -1)
    psm = F.concat(between(PREFIX, SUFFIX), after(MIDDLE), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), after(MIDDLE), between(SUFFIX, PREFIX))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(out)


def digest(docs: DataFrame) -> DataFrame:
    """transform(docs) with the hashes of its output and of the text restored from it in place of the output. Edge cases are those of transform()."""
    cut = transform(docs).withColumn("_restored", restored())
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("_restored", 256).alias("restored_sha256"))
