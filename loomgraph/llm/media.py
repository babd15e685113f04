"""Media columns: progressive JPEG files to full-resolution RGB tensors, and texts stored in such files."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, text_col, tidy

UNIT = 192
#: Output rows go back to the JVM in pieces of about this many bytes.
PIECE = 8 << 20


def payload_bytes(text: str) -> bytes:
    """UTF-8, with spaces up to a positive multiple of UNIT."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" ")


def encode(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, media: each whole text as a progressive JPEG file. Null text is the empty one."""
    from .jpeg import from_payload

    def run(batches):
        for b in batches:
            start, held = 0, 0
            media: list[bytes] = []
            sizes: list[int] = []
            for i, t in enumerate(b["text"]):
                p = payload_bytes(t)
                sizes.append(len(t.encode("utf-8", "surrogatepass")))
                media.append(from_payload(p))
                held += len(media[-1])
                if held > PIECE:
                    yield pd.DataFrame({"doc_id": b["doc_id"].iloc[start : i + 1].values, "n_bytes": sizes, "media": media})
                    start, held, media, sizes = i + 1, 0, [], []
            if media:
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[start:].values, "n_bytes": sizes, "media": media})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text_col().alias("text")).mapInPandas(tidy(run), f"doc_id {kind}, n_bytes bigint, media binary")


def feature(rgb: np.ndarray) -> str:
    """Mean colours of a 4 x 4 grid, as hexadecimal bytes."""
    h, w, _ = rgb.shape
    ys, xs = (np.unique(np.linspace(0, n, 5)[:-1].astype(int)) for n in (h, w))
    sums = np.add.reduceat(np.add.reduceat(rgb, ys, axis=0, dtype=np.uint32), xs, axis=1)
    area = np.outer(np.diff(np.append(ys, h)), np.diff(np.append(xs, w)))
    return (sums // area[..., None]).astype(np.uint8).tobytes().hex()


DECODED = "height int, width int, rgb binary, feature string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, error string"


def decode(media: DataFrame, carry: tuple = ("doc_id", "n_bytes"), tensors: bool = True) -> DataFrame:
    """The carried columns and, from each file in column media, the RGB tensor (rows x columns x 3 bytes) and its feature.

    Where the file stores a payload, its size, hash and the checksum of its
    last 16 bytes follow. A null or broken file gives nulls and an error, never
    a lost row; an empty table gives no rows; other columns are not read.
    """
    from .jpeg import Image, payload_of

    def one(data):
        if data is None:
            return (None,) * 9 + ("no file",)
        head = (len(data), hashlib.sha256(data).hexdigest())
        try:
            image = Image(data)
            rgb = image.rgb()
            digest = (None, None, None)
            if any(c.startswith(b"payload ") for c in image.comments):
                p = payload_of(image)
                digest = (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
            return (image.height, image.width, rgb.tobytes() if tensors else None, feature(rgb), *digest, *head, None)
        except (ValueError, KeyError, IndexError, StopIteration) as e:
            return (None,) * 7 + head + (str(e) or type(e).__name__,)

    names = [x.split()[0] for x in DECODED.split(", ")]
    ints = {"height", "width", "payload_bytes", "tail_crc32", "media_bytes"}

    def run(batches):
        for b in batches:
            rows, start, held = [], 0, 0

            def frame(end):
                out = {c: b[c].iloc[start:end].values for c in carry}
                for k, n in enumerate(names):
                    v = [r[k] for r in rows]
                    out[n] = pd.array(v, dtype="Int64") if n in ints else pd.Series(v, dtype=object)
                return pd.DataFrame(out)

            for i, data in enumerate(b["media"]):
                rows.append(one(data))
                held += len(data or b"") + len(rows[-1][2] or b"")
                if held > PIECE:
                    yield frame(i + 1)
                    rows, start, held = [], i + 1, 0
            if rows:
                yield frame(len(b))

    kinds = ", ".join(f"{c} {media.schema[c].dataType.simpleString()}" for c in carry)
    return media.select(*carry, "media").mapInPandas(tidy(run), f"{kinds}, {DECODED}")


def store_and_read(docs: DataFrame) -> DataFrame:
    """Files of all texts written to a table in the shared folder, then read back and decoded with their tensors.

    One row for each row of docs, repeated and null ids included; null and empty
    texts are payloads of spaces; a text's length is bounded by the format's
    65,500 samples a side, about 4 GB; an empty table gives no rows; other
    columns, whatever they are called, are not read.
    """
    return decode(stage(encode(docs), "media"))
