"""WARC archives: writing with revisit records, and reading by boundary chains.

Reading does not trust the record magic: a payload may contain it. Tasks scan
byte ranges of the archives and emit each candidate's offset with the offset of
the record that would follow it; pointer jumping from the file's start then
keeps the candidates that the chain reaches, and only these are records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_fs, shared_dir, stage

MAGIC = b"WARC/1.1\r\n"
_END = b"\r\n\r\n"
_LENGTH = re.compile(rb"(?i)\r\nContent-Length:\x20*(\d{1,18})\r\n")
#: An archive is closed at this size, so what one task joins is bounded.
FILE_BYTES = 64 << 20
#: A scanning task reads this much, and what the last header in it needs, in steps of READ_ON at least.
SPLIT_BYTES = 16 << 20
READ_ON = 64 << 10


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(kind: str, ident: str, lines: list[str], block: bytes) -> bytes:
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{ident}>", "WARC-Date: 2024-01-01T00:00:00Z", *lines, f"Content-Length: {len(block)}"]
    return MAGIC + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _http(n: int) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n


def page_record(page_id, url: str | None, payload: bytes, refers_to, revisit: bool) -> bytes:
    """A response with its payload, or a revisit that has the HTTP header alone."""
    uri = "".join(c if 32 < ord(c) < 127 else "".join(f"%{x:02X}" for x in c.encode()) for c in url or "")
    lines = [f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return _record("revisit" if revisit else "response", f"urn:page:{'' if page_id is None else page_id}", lines, _http(len(payload)) + (b"" if revisit else payload))


def plan_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page, digest, n, refers_to) of the pages and payloads that are written as revisits: those whose payload, of at least so many bytes, a page with a larger id has."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", F.sha1(html).alias("digest"), F.octet_length(html).alias("n")).where(F.col("n") >= least)
    last = keyed.groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("rows")).where("rows > 1 and refers_to is not null").drop("rows")
    # the side with the hot digest is plain rows of an id and a digest, which Spark may split
    out = keyed.join(last, ["digest", "n"]).where("page_id < refers_to or page_id is null")
    return out.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), F.col("n").alias("_n"), "refers_to").distinct()


def write(pages: DataFrame, least: int = 0, to: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record for each row of pages and returns the manifest (path, size, n_records).

    Payload is the html in UTF-8 (null: empty). Among equal payloads the largest
    page_id is a response, also where its row is repeated; rows with smaller or
    null ids revisit it. Rows of one id may differ in payload; each is judged by
    its own. An empty table gives no archives; columns other than page_id, url
    and html are not read.
    """
    spark = pages.sparkSession
    to = to or shared_dir(spark, "warc")
    # staged, so that the planner knows its size: it is broadcast only where that is under Spark's limit
    again = stage(plan_records(pages, least), "revisits")
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("n"))
    rows = rows.join(again, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")) & (F.col("n") == F.col("_n")), "left")
    rows = rows.select("page_id", "url", "html", "refers_to")

    def run(batches):
        out, made = None, []

        def close():
            out[1].close()
            made.append((out[0], out[2], out[3]))

        for b in batches:
            for page, url, html, refers in zip(b["page_id"], b["url"], b["html"], b["refers_to"]):
                if out is None:
                    uri = f"{to}/{uuid.uuid4().hex}.warc"
                    fs, path = arrow_fs(uri)
                    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out = [uri, fs.open_output_stream(path), 0, 0]
                    info = _record("warcinfo", f"urn:uuid:{uuid.uuid4()}", ["Content-Type: application/warc-fields"], b"format: WARC File Format 1.1\r\n")
                    out[1].write(info)
                    out[2] += len(info)
                revisit = not pd.isna(refers)
                data = page_record(None if pd.isna(page) else int(page), url, html.encode("utf-8", "surrogatepass"), int(refers) if revisit else None, revisit)
                out[1].write(data)
                out[2], out[3] = out[2] + len(data), out[3] + 1
                if out[2] >= file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        if made:
            yield pd.DataFrame(made, columns=["path", "size", "n_records"])

    return stage(rows.mapInPandas(run, "path string, size bigint, n_records bigint"), "archives")


def candidates(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, size, n_records, at, body, next) of each place that looks like a record: its offset, its block's offset and its successor's.

    A header may have any length: the task reads on to its end. The next header's
    end and length are searched once for all places before them.
    """
    splits = manifest.select("path", "size", "n_records", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("lo"))
    n = max(1, min(splits.count(), 10_000))

    def run(batches):
        for b in batches:
            for path, size, n_records, lo in zip(b["path"], b["size"], b["n_records"], b["lo"]):
                hi = min(size, lo + split_bytes)
                fs, inner = arrow_fs(path)
                with fs.open_input_file(inner) as f:
                    f.seek(lo)
                    data = f.read(min(size, hi + READ_ON) - lo)
                    found, end, length, looked = [], -1, None, -1
                    for m in re.finditer(re.escape(MAGIC), data):
                        if lo + m.start() >= hi:
                            break
                        if end < m.end():
                            end = data.find(_END, m.end())
                        while end < 0 and lo + len(data) < size:
                            old, data = len(data), data + f.read(min(size - lo - len(data), max(READ_ON, len(data))))
                            end = data.find(_END, old - len(_END) + 1)
                        if end < 0:
                            break  # nor do later places have an end
                        if looked < m.end() - 2:  # the first length from here on, if it is in a header that ends by `end`
                            length = _LENGTH.search(data, m.end() - 2, end + 2)
                            looked = length.start() if length else end - 1
                        if length and length.start() >= m.end() - 2:
                            body = lo + end + 4
                            found.append((path, size, n_records, lo + m.start(), body, body + int(length[1]) + 4))
                if lo == 0 and not (found and found[0][3] == 0):
                    raise ValueError(f"no record is at the start of {path}")
                if found:
                    yield pd.DataFrame(found, columns=["path", "size", "n_records", "at", "body", "next"])

    return splits.repartition(n).mapInPandas(run, "path string, size bigint, n_records bigint, at bigint, body bigint, next bigint")


def reachable(at: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Which offsets the chain from offset 0 reaches; pointer jumping in about log2(n) rounds. at is ascending and distinct."""
    n = len(at)
    where = np.searchsorted(at, following)
    ok = (where < n) & (at[np.minimum(where, n - 1)] == following)
    jump = np.append(np.where(ok, where, n), n)  # n: nowhere
    seen = np.zeros(n + 1, bool)
    if n and at[0] == 0:
        seen[0] = True
    while True:
        seen[jump[seen]] = True
        jump = jump[jump]
        if (jump == n).all():
            return seen[:n]


READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, path string, at bigint, complete boolean"


def read(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Page records of the archives with their verified digests. complete: the file's chain ends at its end.

    An archive whose chain ends elsewhere, or has other than the manifest's
    number of page records, raises ValueError. An empty manifest gives no rows;
    null ids come back null; repeated rows are records of their own.
    Candidates of one archive meet in one task, as small rows; the writer bounds an archive's size.
    """

    def run(key, c):
        path, size, n_records = key
        c = c.sort_values("at").drop_duplicates("at")
        keep = c[reachable(c["at"].to_numpy(), c["next"].to_numpy())]
        whole = bool(len(keep)) and int(keep["next"].iloc[-1]) == size
        if not whole:
            raise ValueError(f"the chain of {path} doesn't end at the file's end, {size}")
        fs, inner = arrow_fs(path)
        rows = []
        with fs.open_input_file(inner) as f:
            for at, body, after in zip(keep["at"], keep["body"], keep["next"]):
                f.seek(at)
                data = f.read(after - at)
                head = dict(x.split(": ", 1) for x in data[len(MAGIC) : body - at - 4].decode().split("\r\n"))
                kind = head["WARC-Type"]
                if kind not in ("response", "revisit"):
                    continue
                block = data[body - at : -4]
                cut = block.index(b"\r\n\r\n") + 4
                stated = int(re.search(rb"\r\nContent-Length: (\d+)\r\n", block[:cut])[1])
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and (len(block) - cut != stated or sha1_base32(block[cut:]) != digest):
                    raise ValueError(f"the payload at {at} of {path} doesn't fit its digest")
                ident = lambda x: int(y) if (y := x[1:-1].removeprefix("urn:page:")) else None
                rows.append((ident(head["WARC-Record-ID"]), stated, digest, kind, ident(head["WARC-Refers-To"]) if kind == "revisit" else None, head["WARC-Target-URI"], path, at, whole))
        if len(rows) != n_records:
            raise ValueError(f"{path} has {len(rows)} page records and not {n_records}")
        names = [x.split()[0] for x in READ.split(", ")]
        out = pd.DataFrame(rows, columns=names)
        for c in ("page_id", "refers_to"):
            out[c] = out[c].astype("Int64")
        return out

    return candidates(manifest, split_bytes).groupBy("path", "size", "n_records").applyInPandas(run, READ)
