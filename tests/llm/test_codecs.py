"""Exact round trips of the file formats and tokenizers, against plain versions."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest

from loomgraph.llm import jpeg, media, token_counts, token_files, warc

P = pytest.importorskip("public_tokenizers")
RND = random.Random(5)
PIECES = [" ", "  ", "\n", "\t", "a", "the", "Hello", "é", "▁", "<s>", "\r\n", "}", "日本", "🙂", "\u0301", ";\r", "İ", "ΑΣ", "x²", "½", "'s", "!'s", "_a_", "<|endoftext|>", "12", "\x1c", "\x85", "\u00a0", "ß", "\u2028"]
TEXTS = ["", " ", "plain words, here.", "\x7f\x80" * 300, "é" * 5000] + ["".join(RND.choice(PIECES) for _ in range(RND.randint(0, 40))) for _ in range(2000)]


def test_sentencepiece_counts_equal_the_library():
    c = token_counts.counter(P.path("piece_bpe_32k.model"))
    assert c.cuts and len(c.whole) > 30_000
    assert [c.count(t) for t in TEXTS] == [len(x) for x in c.model.encode(TEXTS)]


def test_ids_by_words_equal_the_library(monkeypatch):
    e = token_files.encoder(P.path("word_bpe_49k.json"))
    assert e.by_words
    want = [x.ids for x in e.library.encode_batch(TEXTS, add_special_tokens=False)]
    more = ["'", "it's 'the' we'Re you'lless ''s !'s 'd'd 'v 've", "x" * 5000 + "'s", "a'" * 300, "word " * 100_000, "<|" + "b " * 50, ("y" * 60 + " ") * 9000 + "日本"]
    more += ["".join(RND.choice("abst'' 1!é\n") for _ in range(RND.randint(0, 60))) for _ in range(3000)]
    want += [x.ids for x in e.library.encode_batch(more, add_special_tokens=False)]
    got = lambda: [x.tolist() for x in e.batch(TEXTS + more)]
    assert got() == want
    assert got() == want  # from memory
    monkeypatch.setattr(token_files, "MOST_KEPT", 300)
    monkeypatch.setattr(token_files, "TOGETHER", 500)
    assert got() == want  # from little memory


def test_tables_hold_what_they_were_given():
    t, rng = token_files.Table(4), np.random.default_rng(1)
    h = np.unique(rng.integers(1, 1 << 63, 5000).astype(np.uint64) & np.uint64(0xF00000000000FFFF))  # many meet in a slot
    for i in range(0, len(h), 700):
        t.add(h[i : i + 700], np.arange(i, min(i + 700, len(h)), dtype=np.int32))
    assert (t.find(h) == np.arange(len(h))).all() and (t.find(h + np.uint64(1 << 40)) == -1).all()


@pytest.mark.parametrize("text", TEXTS[:60])
def test_payload_round_trip(text):
    p = media.payload_bytes(text)
    assert len(p) % 192 == 0 and p.rstrip(b" ") == text.encode().rstrip(b" ")
    image = jpeg.Image(data := jpeg.from_payload(p))
    assert jpeg.payload_of(image) == p
    assert image.rgb().shape == (image.height, image.width, 3)
    assert data == jpeg.from_payload(p)


def test_every_byte_and_symbol_by_symbol(monkeypatch):
    p = bytes(range(256)) * 24
    fast = jpeg.Image(jpeg.from_payload(p))
    monkeypatch.setattr(jpeg.Image, "_fast", lambda *a: False)
    slow = jpeg.Image(jpeg.from_payload(p))
    assert jpeg.payload_of(slow) == p
    for a, b in zip(fast.components, slow.components):
        assert (a.coef == b.coef).all()


class Writer:
    """A plain encoder of sparse coefficients: runs, long runs, ends of band and refinement, symbol by symbol."""

    def __init__(self, symbols):
        counts = bytearray(16)
        counts[8 - 1] = 0
        counts[9 - 1] = len(symbols)
        self.table = jpeg.Huffman(bytes(counts), bytes(symbols))
        self.raw = bytes(counts) + bytes(symbols)
        self.bits = ""

    def put(self, v, n):
        self.bits += format(v, f"0{n}b") if n else ""

    def sym(self, s):
        self.put(*self.table.codes[s])

    def value(self, v):
        s = abs(v).bit_length()
        self.put(v if v > 0 else v + (1 << s) - 1, s)

    def done(self):
        b = self.bits + "1" * (-len(self.bits) % 8)
        return int("1" + b, 2).to_bytes(len(b) // 8 + 1, "big")[1:].replace(b"\xff", b"\xff\x00") if b else b""


def sparse_file(coef, quant):
    """coef: (blocks high, blocks wide, 64), one grey component; DC, AC at a lower precision, then both refined."""
    h, w, _ = coef.shape
    flat = coef.reshape(-1, 64)
    dc, ac = list(range(12)), [r << 4 | s for r in range(16) for s in range(0, 9)][:200]
    low = Writer(ac)
    out = [b"\xff\xd8", jpeg._segment(0xDB, b"\0" + bytes(quant))]
    d = Writer(dc)
    out.append(jpeg._segment(0xC4, b"\x00" + d.raw) + jpeg._segment(0xC4, b"\x10" + low.raw))
    out.append(jpeg._segment(0xC2, b"\x08" + (8 * h).to_bytes(2, "big") + (8 * w).to_bytes(2, "big") + b"\x01\x01\x11\x00"))
    scan = lambda ss, se, a, x: out.append(b"\xff\xda\x00\x08\x01\x01\x00" + bytes((ss, se, a)) + x)
    last = 0
    for v in (flat[:, 0] >> 1).tolist():
        s = abs(v - last).bit_length()
        d.sym(s)
        d.value(v - last) if s else None
        last = v
    scan(0, 0, 0x01, d.done())
    first = np.sign(flat) * (np.abs(flat) >> 1)
    e = Writer(ac)
    for block in first.tolist():
        run = 0
        nz = [k for k in range(1, 64) if block[k]]
        for k in range(1, (nz or [0])[-1] + 1):
            if not block[k]:
                run += 1
                continue
            while run > 15:
                e.sym(0xF0)
                run -= 16
            e.sym(run << 4 | abs(block[k]).bit_length())
            e.value(block[k])
            run = 0
        if (nz or [0])[-1] < 63:
            e.sym(0x00)
    scan(1, 63, 0x01, e.done())
    e = Writer(ac)
    for block, before in zip(flat.tolist(), first.tolist()):
        new = [k for k in range(1, 64) if block[k] and not before[k]]
        k, held, run = 1, [], 0
        for k in range(1, 64):
            if before[k]:
                held.append(abs(block[k]) & 1)
                continue
            if not new:
                continue
            if block[k]:
                e.sym(run << 4 | 1)
                e.put(int(block[k] > 0), 1)
                for b in held:
                    e.put(b, 1)
                held, run = [], 0
                new.pop(0)
            else:
                run += 1
                if run == 16:
                    e.sym(0xF0)
                    for b in held:
                        e.put(b, 1)
                    held, run = [], 0
        if held or run or not block[63]:
            e.sym(0x00)
            for b in held:
                e.put(b, 1)
    scan(1, 63, 0x10, e.done())
    e = Writer(dc)
    for v in flat[:, 0].tolist():
        e.put(v & 1, 1)
    scan(0, 0, 0x10, e.done())
    return b"".join(out) + b"\xff\xd9"


def test_sparse_coefficients_and_inverse_transform():
    rng = np.random.default_rng(3)
    coef = rng.integers(-60, 60, (3, 4, 64)) * (rng.random((3, 4, 64)) < 0.2)
    coef[1, 1] = 0
    quant = rng.integers(1, 9, 64)
    image = jpeg.Image(sparse_file(coef, quant.tolist()))
    assert (image.components[0].coef == coef).all()
    natural = np.zeros(64)
    natural[jpeg.ZIGZAG] = coef[0, 0] * quant
    f = natural.reshape(8, 8)
    c = lambda k: np.sqrt(0.5) if k == 0 else 1.0
    want = [[sum(c(u) * c(v) * f[u, v] * np.cos((2 * y + 1) * u * np.pi / 16) * np.cos((2 * x + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) / 4 for x in range(8)] for y in range(8)]
    assert np.allclose(image.plane(image.components[0])[:8, :8], want, atol=1e-2)


def test_media_operator_nulls_and_broken_files(spark):
    rows = [(1, "x", "keep"), (2, None, "keep"), (2, None, "keep"), (None, "", "k"), (5, "é" * 9000, "k")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, media string")
    got = {(r.doc_id, r.n_bytes): r for r in media.store_and_read(docs).collect()}
    assert len(got) == 4
    p = media.payload_bytes("é" * 9000)
    r = got[5, 18000]
    assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert len(r.rgb) == r.height * r.width * 3
    assert got[2, 0].payload_sha256 == got[None, 0].payload_sha256
    bad = spark.createDataFrame([(1, None), (2, b""), (3, b"\xff\xd8\xff\xd9"), (4, jpeg.from_payload(p)[:500])], "doc_id bigint, media binary")
    assert {r.doc_id: bool(r.error) for r in media.decode(bad, carry=("doc_id",)).collect()} == dict.fromkeys((1, 2, 3, 4), True)
    assert media.store_and_read(docs.limit(0)).count() == 0


def test_token_files_round_trip(spark):
    path = P.path("word_bpe_49k.json")
    rows = [(i, t, "x") for i, t in enumerate(TEXTS[:400])] + [(7, "again", "y"), (None, None, "z"), (9999, "long " * 30_000, "l")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string").repartition(5)
    manifest = token_files.write(docs, path, seq_len=64)
    got = token_files.read(manifest, with_ids=True).orderBy("start").collect()
    e = token_files.encoder(path)
    want = {}
    for i, t, _ in rows:
        want.setdefault(i, []).append(e.library.encode(t or "", add_special_tokens=False).ids + [2])
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    at = 0
    for r in got:
        assert r.ids in want[r.doc_id] and r.n_tokens == len(r.ids) and r.start == at
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += len(r.ids)
    m = manifest.orderBy("base").first()
    s = token_files.Shard(m.path)
    ids, mask = s.sequence(0)
    assert len(ids) == 64 and not ids.flags.owndata and mask.dtype == bool
    last, mask = s.sequence(m.n_sequences - 1)
    assert mask.sum() == (m.n_ids - 1) % 64 + 1
    assert token_files.read(token_files.write(docs.limit(0), path)).count() == 0


def test_token_files_of_one_id_over_several_partitions(spark):
    path, key = P.path("word_bpe_49k.json"), "spark.sql.adaptive.coalescePartitions.enabled"
    rows = [(None, f"none {i}") for i in range(1500)] + [(7, f"seven {i} of many") for i in range(4000)] + [(8, f"eight {i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        runs = []
        for _ in range(2):
            manifest = token_files.write(docs, path)
            assert manifest.count() > 2
            runs.append([(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read(manifest).orderBy("start").collect()])
    finally:
        spark.conf.set(key, before)
    assert runs[0] == runs[1]
    assert [r[0] for r in runs[0]] == [None] * 1500 + [7] * 4000 + [8] * 100
    at = 0
    for _, start, n, _ in runs[0]:
        assert start == at
        at += n


def test_warc_chain_rejects_magic_inside_payloads(spark):
    trap = warc.page_record(99, "http://trap", b"trap", None, False).decode()
    rows = [(1, "http://a", "same"), (2, "http://b\r\n", "same"), (3, None, trap * 3), (4, "ü", None), (5, "u", ""), (5, "u", "é" + trap), (None, "n", "same"), (6, "v", warc.MAGIC.decode() * 50)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("path", __import__("pyspark").sql.functions.lit("clash"))
    m = warc.write(pages.coalesce(1))
    assert warc.candidates(m).count() > len(rows) + 1
    got = {(r.page_id, r.payload_digest): r for r in warc.read(m, split_bytes=100).collect()}
    assert len(got) == len(rows) and all(r.complete for r in got.values())
    for i, _, html in rows:
        b = (html or "").encode()
        d = base64.b32encode(hashlib.sha1(b).digest()).decode()
        r = got[i, d]
        assert r.payload_bytes == len(b)
        want = {1: ("revisit", 2), None: ("revisit", 2), 4: ("revisit", 5)}.get(i, ("response", None))
        assert (r.record_type, r.refers_to) == want
    assert warc.read(warc.write(pages.limit(0))).count() == 0


def test_pointer_jumping():
    at = np.array([0, 5, 9, 12, 20, 31])
    assert warc.reachable(at, np.array([9, 20, 20, 31, 40, 40])).tolist() == [True, False, True, False, True, False]
    assert warc.reachable(np.array([3, 5]), np.array([5, 9])).tolist() == [False, False]
    assert warc.reachable(np.array([], int), np.array([], int)).tolist() == []


def test_warc_long_header_and_broken_chain(spark):
    rows = [(1, "http://a", "one"), (2, "http://" + "\u65e5" * 9000, "two"), (3, "c", "three")]
    m = warc.write(spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1))
    for split in (1000, warc.SPLIT_BYTES):
        assert sorted(r.page_id for r in warc.read(m, split).collect()) == [1, 2, 3]
    with pytest.raises(Exception, match="page records"):
        warc.read(m.withColumn("n_records", m["n_records"] + 1)).collect()
    with pytest.raises(Exception, match="doesn't end"):
        warc.read(m.withColumn("size", m["size"] - 1)).collect()


def test_warc_repeated_ids_with_other_payloads(spark):
    """A page revisits only a payload that it has itself."""
    rows = [(1, "a", "same"), (1, "a", "own"), (2, "b", "same"), (None, "n", "same"), (None, "n", "alone"), (3, "c", "own"), (3, "c", "own")]
    m = warc.write(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3))
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    got = sorted((str(r.page_id), r.payload_digest, r.record_type, r.refers_to) for r in warc.read(m).collect())
    want = [(1, "same", "revisit", 2), (1, "own", "revisit", 3), (2, "same", "response", None), (None, "same", "revisit", 2), (None, "alone", "response", None), (3, "own", "response", None), (3, "own", "response", None)]
    assert got == sorted((str(i), digest(t), k, r) for i, t, k, r in want)


def test_bits_are_read_through_a_window():
    raw = bytes(RND.randrange(256) for _ in range(400))
    text, bits, at = "".join(format(x, "08b") for x in raw), jpeg.Bits(raw), 0
    while at < len(text) - 32:
        k = RND.randint(0, 16)
        assert bits.take(k) == (int(text[at : at + k], 2) if k else 0)
        at += k
    with pytest.raises(ValueError, match="too early"):
        for _ in range(40):
            bits.take(16)


def interleaved_file(blocks, restart):
    """Three components, the first sampled twice as finely both ways; DC interleaved, with restart intervals, then refined; AC by component with runs of ended bands."""
    h, w = blocks[0].shape[0] // 2, blocks[0].shape[1] // 2
    dc, ac = list(range(12)), [r << 4 | s for r in range(16) for s in range(0, 9)][:200]
    out = [b"\xff\xd8", jpeg._segment(0xDB, b"\0" + b"\1" * 64), jpeg._segment(0xC4, b"\x00" + Writer(dc).raw) + jpeg._segment(0xC4, b"\x10" + Writer(ac).raw)]
    out.append(jpeg._segment(0xC2, b"\x08" + (16 * h).to_bytes(2, "big") + (16 * w).to_bytes(2, "big") + b"\x03\x01\x22\x00\x02\x11\x00\x03\x11\x00"))
    out.append(jpeg._segment(0xDD, restart.to_bytes(2, "big")))
    units = [[(0, 2 * y + a, 2 * x + b) for a in (0, 1) for b in (0, 1)] + [(1, y, x), (2, y, x)] for y in range(h) for x in range(w)]

    def joined(parts):
        return b"".join(p + (b"\xff" + bytes([0xD0 + k % 8]) if k < len(parts) - 1 else b"") for k, p in enumerate(parts))

    parts, later = [], []
    for i in range(0, len(units), restart):
        d, e, last = Writer(dc), Writer(dc), [0, 0, 0]
        for k, y, x in (b for u in units[i : i + restart] for b in u):
            v = int(blocks[k][y, x, 0]) >> 1
            s = abs(v - last[k]).bit_length()
            d.sym(s)
            d.value(v - last[k]) if s else None
            last[k] = v
            e.put(int(blocks[k][y, x, 0]) & 1, 1)
        parts.append(d.done())
        later.append(e.done())
    out.append(b"\xff\xda\x00\x0c\x03\x01\x00\x02\x00\x03\x00\x00\x00\x01" + joined(parts))
    out.append(b"\xff\xda\x00\x0c\x03\x01\x00\x02\x00\x03\x00\x00\x00\x10" + joined(later))
    for k, c in enumerate(blocks):
        flat, parts = c.reshape(-1, 64), []
        for i in range(0, len(flat), restart):
            e, ended = Writer(ac), 0

            def end(e=e):
                nonlocal ended
                if ended:
                    r = ended.bit_length() - 1
                    e.sym(r << 4)
                    e.put(ended - (1 << r), r)
                ended = 0

            for block in flat[i : i + restart].tolist():
                nz = [j for j in range(1, 64) if block[j]]
                if nz:
                    end()
                run = 0
                for j in range(1, (nz or [0])[-1] + 1):
                    if not block[j]:
                        run += 1
                        continue
                    while run > 15:
                        e.sym(0xF0)
                        run -= 16
                    e.sym(run << 4 | abs(block[j]).bit_length())
                    e.value(block[j])
                    run = 0
                if not nz or nz[-1] < 63:
                    ended += 1
            end()
            parts.append(e.done())
        out.append(b"\xff\xda\x00\x08\x01" + bytes([k + 1, 0, 1, 63, 0]) + joined(parts))
    return b"".join(out) + b"\xff\xd9"


@pytest.mark.parametrize("restart", [2, 3, 100])
def test_interleaved_scans_restarts_and_chroma(restart):
    """Coefficients exactly, and RGB against a plain transform, block by block and sample by sample."""
    rng = np.random.default_rng(restart)
    blocks = [rng.integers(-40, 40, (n, m, 64)) * (rng.random((n, m, 64)) < 0.05) for n, m in ((4, 6), (2, 3), (2, 3))]
    for b in blocks:
        b[..., 0] = rng.integers(-300, 300, b.shape[:2])
    image = jpeg.Image(interleaved_file(blocks, restart))
    for c, b in zip(image.components, blocks):
        assert (c.coef == b).all()
    rgb = image.rgb()
    cos = [[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for u in range(8)] for x in range(8)]

    def sample(k, y, x):
        natural = np.zeros(64)
        natural[jpeg.ZIGZAG] = blocks[k][y // 8, x // 8]
        return sum(natural[8 * u + v] * cos[y % 8][u] * cos[x % 8][v] for u in range(8) for v in range(8))

    for _ in range(60):
        y, x = RND.randrange(image.height), RND.randrange(image.width)
        lum, cb, cr = sample(0, y, x) + 128, sample(1, y // 2, x // 2), sample(2, y // 2, x // 2)
        want = (lum + 1.402 * cr, lum - 0.344136 * cb - 0.714136 * cr, lum + 1.772 * cb)
        assert all(abs(min(255, max(0, a)) - b) <= 1 for a, b in zip(want, rgb[y, x].tolist()))
    grid = media.feature(rgb)
    h, w = image.height // 4, image.width // 4
    assert grid == "".join("%02x%02x%02x" % tuple(int(rgb[y * h : (y + 1) * h, x * w : (x + 1) * w, k].astype(int).sum()) // (h * w) for k in range(3)) for y in range(4) for x in range(4))


def test_slow_scans_take_time_in_proportion(monkeypatch):
    import time

    monkeypatch.setattr(jpeg.Image, "_fast", lambda *a: False)
    took = []
    for n in (200, 1600):
        data, t = jpeg.from_payload(bytes(RND.randrange(256) for _ in range(192 * n))), time.process_time()
        jpeg.Image(data)
        took.append(time.process_time() - t)
    assert took[1] < 25 * took[0]
