"""The event log, the trigram index, and keyed state."""

import json
import random
import re

import pytest

from loomgraph.plans import search, text_index
from loomgraph.sources.folders import shared_dir
from loomgraph.streaming import event_log, keyed_state

RND = random.Random(3)


def test_a_batch_delivered_again_adds_nothing(spark):
    path = shared_dir(spark, "log")
    batch = spark.createDataFrame([("Added", i) for i in range(30)] + [("Deleted", 100 + i) for i in range(5)], "type string, k int").repartition(7)
    for _ in range(2):
        event_log.deliver(batch, 4, path, ("k",), 32)
    event_log.deliver(batch.limit(0), 5, path, ("k",))
    rows = sorted(map(tuple, event_log.events_of(spark, path).select("batch", "sequence", "type").collect()))
    assert rows == [(4, i + 1, "Added" if i < 30 else "Deleted") for i in range(32)]
    assert [tuple(r) for r in event_log.dropped(spark, path).collect()] == [(4, "Deleted", 3)]
    assert json.loads(event_log.events_of(spark, path, (4, 31)).first().event) == {"batch": 4, "sequence": 32, "type": "Deleted", "k": 101}


def test_streams_are_logged_once_and_listened_to(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"type": "Added", "k": 1}\n{"type": "Deleted", "k": 2}\n')
    log = str(tmp_path / "log")
    listener = event_log.QueryEvents(spark, str(tmp_path / "queries"))
    spark.streams.addListener(listener)
    try:
        for _ in range(2):  # started again, it has nothing to do
            stream = spark.readStream.schema("type string, k int").json(str(tmp_path / "in"))
            event_log.log_events(stream, log, str(tmp_path / "check"), ("k",)).trigger(availableNow=True).start().awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    finally:
        spark.streams.removeListener(listener)
    assert event_log.events_of(spark, log).count() == 2
    kinds = [json.loads(p.read_text())["kind"] for p in (tmp_path / "queries").glob("*.json")]
    assert kinds.count("started") == 2 and "progress" in kinds


@pytest.mark.parametrize("pattern, query", [
    ("abc", ("gram", "abc")), ("ABcd", ("and", (("gram", "abc"), ("gram", "bcd")))), ("ab.cd", None), ("abc|bcd", ("or", (("gram", "abc"), ("gram", "bcd")))), ("abc|x", None),
    ("(?:abc)+x*", ("gram", "abc")), ("a(bc)d", ("and", (("gram", "abc"), ("gram", "bcd")))), ("abc?", None), (r"\p{L}abc", None), ("(?i)abc", None), ("x[a&&[b]]yz", None), ("^abc$", ("gram", "abc")), ("aéabc", ("gram", "abc")),
])
def test_trigram_queries(pattern, query):
    assert text_index.query_of(pattern, True) == query


def test_indexed_search_equals_reading_all(spark):
    path, words = shared_dir(spark, "index"), ["Alpha", "beta", "gamma(", "delta", "épsilon", "x", "\n", "alphabet", "BETA"]
    files = {f"d{i % 4}/f{i}.py": " ".join(RND.choices(words, k=RND.randint(0, 12))) for i in range(60)} | {"rare.go": "needle in it"}
    frame = lambda: spark.createDataFrame(list(files.items()), "path string, content string")
    text_index.update_index(spark, path, 0, frame(), frame(), 16)
    for number in (1, 2):
        changed = RND.sample(sorted(p for p in files if p != "rare.go"), 6)
        for p in changed[:3]:
            del files[p]
        for p in changed[3:]:
            files[p] = "gamma( new\nAlpha"
        store = text_index.update_index(spark, path, number, spark.createDataFrame([(p,) for p in changed], "path string"), frame(), 16)
        assert len(store.asked["files"]) <= 6
    for pattern, regex in (("alpha", False), ("gamma(", False), (r"alpha(bet)?\s+beta", True), ("épsilon", False), ("x", False), ("needle|delta.*beta", True), ("nowhere", False)):
        got = sorted(map(tuple, text_index.search(spark, path, pattern, regex, most=None).collect()))
        assert got == sorted(map(tuple, search.search_lines(frame(), pattern, regex=regex, most=None).collect()))
        rx = re.compile(pattern if regex else re.escape(pattern), re.I | re.A)
        assert len(got) == sum(bool(rx.search(line)) for c in files.values() for line in c.split("\n"))
    store = text_index.latest(spark, path)
    assert text_index.search(spark, path, "needle", glob="*.go", store=store).first().path == "rare.go" and len(store.asked["files"]) <= 1


def test_runs_and_restarts_of_keyed_state(spark, tmp_path):
    assert keyed_state.runs_of([(5, "b"), (1, "a"), (8, "c")], 4) == [[(1, "a")], [(5, "b"), (8, "c")]]
    (tmp_path / "in").mkdir()
    snapshot = spark.createDataFrame([("a", 5), ("z", 9)], "path string, entities bigint")

    def run(name, rows):
        (tmp_path / f"in/{name}.json").write_text("\n".join(json.dumps(dict(zip(("path", "change_type", "ts", "entities"), r))) for r in rows))
        stream = spark.readStream.schema("path string, change_type string, ts timestamp, entities bigint").json(str(tmp_path / "in"))
        with keyed_state.state_store(spark):
            out = keyed_state.keyed_updates(stream, 60_000, "0 seconds", snapshot)
            out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).drop("ts").collect()}
        return got, tuple(keyed_state.state_statistics(spark, str(tmp_path / "check")).first())

    first, stats = run(1, [("a", "Modified", "2024-01-01T00:00:00Z", 7), ("a", "Modified", "2024-01-01T00:00:30Z", 8), ("b", "Added", "2024-01-01T00:05:00Z", 3)])
    assert first == {("a", "Modified", 2, 0, 5, 8)} and stats == (2, 17, 1, 1)
    second, stats = run(2, [("b", "Deleted", "2024-01-01T00:10:00Z", 0), ("c", "Added", "2024-01-01T01:00:00Z", 1)])
    assert second - first == {("b", "Added", 1, 3, 0, 0), ("b", "Deleted", 1, 0, 3, 0)} and stats == (2, 17, 1, 1)


def test_lists_are_made_where_files_are_read(spark, monkeypatch):
    """Each distinct trigram of each text is in one list, whatever the letters and however the texts are cut up; no row is moved for it."""
    texts = ["abCDef", "", None, "ab", "ÄBc\U0001f600x\nabc", "abcabc", "İK!"]
    files = spark.createDataFrame([(f"p{i}", t, i % 2) for i, t in enumerate(texts)], "path string, content string, bucket int")
    lists = text_index.postings_of(files)
    assert "Exchange" not in lists._jdf.queryExecution().executedPlan().toString()
    want = set()
    for i, t in enumerate(texts):
        low = "".join(c.lower() if c.isascii() else c for c in t or "")
        want |= {(i % 2, low[k : k + 3], f"p{i}") for k in range(len(low) - 2)}
    key = lambda rows: sorted((r["bucket"], r["gram"], p) for r in rows for p in r["paths"])
    assert key(lists.collect()) == sorted(want)
    batches = files.toArrow().to_batches()
    for name in ("CHARS_AT_ONCE", "MOST_POSTINGS", "POSTINGS_AT_ONCE"):
        monkeypatch.setattr(text_index, name, 1)
        assert key(r for b in text_index._index(batches) for r in b.to_pylist()) == sorted(want)
