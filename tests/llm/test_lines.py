"""Line runs and fill-in-the-middle against plain versions."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import fill_middle, line_runs

RND = random.Random(11)
BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def plain_dedup(rows):
    """rows: (id, text). The text that stays, lines and dropped lines of each row."""
    holders = {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                holders.setdefault(k, []).append(i)
    last = {k: max(v, key=lambda x: (x is not None, x)) for k, v in holders.items() if len(v) >= 5}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if key(x) not in last or last[key(x)] == i]
        out.append((str(i), "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out)


def some_rows():
    lines = [f"line number {i} is shared by several of the documents" for i in range(12)] + ["É" * 39, "É" * 40, "é" * 40, "short", "", "x" * 39, "x" * 40, "  PADDED and CASED line that is long enough to count \t", "padded and cased LINE that is long enough to count\r"]
    rows = [(i, "\n".join(RND.choices(lines, k=RND.randint(0, 6)))) for i in range(60)]
    rows += [(None, lines[0]), (None, lines[1]), (None, None), (70, None), (71, ""), (72, "\n"), (73, "\n".join([lines[2]] * 3000)), (59, lines[3]), (59, lines[3]), (4, lines[3] + "\n\n")]
    return rows + [(None, "only rows without an id hold this line, five of them")] * 5


@pytest.mark.parametrize("batches", [1, 3, 6])
def test_lines_equal_plain_ones(spark, batches):
    rows = some_rows()
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id bigint, text string, h1 int, pos string").repartition(5)
    got = sorted((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in line_runs.dedup(docs, batches=batches).collect())
    assert got == plain_dedup(rows)
    assert line_runs.dedup(docs.limit(0)).count() == 0


def test_lines_that_many_names_share_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(line_runs, "MOST_BROADCAST", 0)
    monkeypatch.setattr(line_runs, "HOT_PARTS", 4)
    rows = some_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in line_runs.dedup(docs).collect()) == plain_dedup(rows)


def test_runs_merge_by_level_and_open_again(spark):
    path = line_runs.shared_dir(spark, "family")
    docs = spark.createDataFrame([(i, f"{'common' if i % 3 else 'rare'} line of the documents, number {i % 7} of them") for i in range(90)], "doc_id bigint, text string")
    whole = line_runs.summed(line_runs.occurrences(docs))
    shapes = []
    for k in range(9):
        runs = line_runs.Runs(spark, path, buckets=4)  # from the manifest each time
        part = docs.where(F.col("doc_id") % 9 == k)
        new = {(r.h1, r.h2) for r in line_runs.unseen_lines(runs, part).collect()}
        seen = {(r.h1, r.h2) for r in runs.totals().collect()}
        assert new == {(r.h1, r.h2) for r in line_runs.summed(line_runs.occurrences(part)).collect()} - seen
        line_runs.add_documents(runs, part, f"batch {k}")
        line_runs.add_documents(runs, part, f"batch {k}")  # once more: nothing
        shapes.append([len(x) for x in runs.state["levels"]])
        runs.close(keep=True)
    assert shapes == [[1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1], [0, 1, 1], [1, 1, 1], [0, 0, 0, 1], [1, 0, 0, 1]]
    runs = line_runs.Runs(spark, path)
    assert sorted(map(tuple, runs.totals().collect())) == sorted(map(tuple, whole.collect()))
    plan = runs.merged(whole)._jdf.queryExecution().executedPlan().toString()
    runs.close()
    assert plan.count("Bucketed: true") == 2


TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PIECES = [" ", "  ", "\n", "\t", "a", "word", "é", "🙂", "\x1c", " ", "<P>", "<", ">", "<S", "M>", "long" * 5]


def plain_cut(i, text, rate=50, spm_rate=80):
    text = text or ""
    h = [int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    w = TOKEN.findall(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(w), "plain", None, None, text
    a, b = sorted((h[0] % (len(w) + 1), h[1] % (len(w) + 1)))
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    return (len(w), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm_rate else (len(w), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_cuts_equal_plain_ones_and_restore(spark, chunk):
    rows = [(i, "".join(RND.choices(PIECES, k=RND.randint(0, 40)))) for i in range(800)]
    rows += [(None, "a b c"), (None, None), (5, None), (5, "again here"), (900, ""), (901, "word " * 30_000), (902, " " * 9000), (903, "é" * 9000), (2**60 + 1, "large id here")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, n int").repartition(3)
    got = fill_middle.transform(docs, chunk=chunk).withColumn("back", fill_middle.restored()).collect()
    want = sorted(((str(i), *plain_cut(i, t), t or "") for i, t in rows), key=repr)
    assert sorted(((str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got), key=repr) == want
    assert {r.form for r in got} == {"plain", "spm", "psm"}
    assert fill_middle.digest(docs.limit(0)).count() == 0


def test_all_of_a_corpus_may_be_cut(spark):
    docs = spark.createDataFrame([(i, f"some words {i} of it") for i in range(50)], "key bigint, text string")
    forms = {r.form for r in fill_middle.transform(docs, id_col="key", rate=100, spm_rate=0).collect()}
    assert forms == {"psm"}


def test_chunks_find_every_place():
    texts = [b"", b" a  b", b"a", b"\t\t", "é é x ".encode(), b"x" * 50 + b" y"]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for size in (1, 2, 7, 100):
        c = fill_middle.Chunks(np.frombuffer(b"".join(texts), np.uint8), offsets, size)
        for i, t in enumerate(texts):
            starts = [len(t.decode()[: m.start()].encode()) for m in TOKEN.finditer(t.decode())]
            assert c.n_tokens()[i] == len(starts)
            assert [c.place(i, k) for k in range(len(starts) + 1)] == [*starts, len(t)]
