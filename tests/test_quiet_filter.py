"""The output filter over slices and on live streams, against the rules line by line."""

import datetime
import random

import numpy as np
import pyarrow as pa
import pytest

from veriloom.streaming import quiet_filter, state_maps
from veriloom.streaming.quiet_filter import Quiet

KINDS = [
    "lint....Passed", "types....Failed", "x....\x1b[33mSkipped\x1b[0m", "(no files to check)Skipped", "- hook id: a", "- duration: 1s", "- files were modified", "", "", "  indented", "text", "[Pre-existing (3)]", "  [Pre-existing (3)]",
    "=" * 50, "=" * 60, "=" * 49, "Banner one", "Banner two", "- item", "7 things", "How to fix:", "How to fix:", "All checks passed!", "  Skipping a (>5KB)", "12 files already formatted", "\x1b[1mBanner one\x1b[0m", "....Passed\r", "[INFO] Stashing", "ü ....Passed", " ",
]


def plain(lines):
    q, out = Quiet(), []
    for at, text in sorted(lines):
        out += [(at, k, x) for k, x in enumerate(q.line(text))]
    end = q.summary()
    return out + ([(max(at for at, _ in lines) + 1, 0, end)] if end else [])


def some_lines(seed, n):
    rng = random.Random(seed)
    weights = [rng.random() ** 3 for _ in KINDS]
    return [(i, rng.choices(KINDS, weights)[0]) for i in range(n)]


@pytest.mark.parametrize("size", [1, 7, 4096])
def test_slices_equal_the_rules(spark, size):
    streams = {f"s{k}": some_lines(k, n) for k, n in enumerate([1, 2, 30, 300, 300, 1500])} | {None: some_lines(9, 200)}
    rows = [(s, at, x) for s, lines in streams.items() for at, x in lines]
    random.Random(1).shuffle(rows)
    got = quiet_filter.filter_batch(spark.createDataFrame(rows, "stream string, ord long, line string").repartition(5), size).collect()
    for s, lines in streams.items():
        assert sorted((r.ord, r.part, r.line) for r in got if r.stream == s) == plain(lines)


def test_odd_streams(spark):
    rows = [("a", 1, None), ("a", 1, None), ("a", 1, "x"), ("b", -5, "types....Failed"), ("c", 0, "lint....Passed")]
    got = quiet_filter.filter_batch(spark.createDataFrame(rows, "stream string, ord long, line string"))
    assert sorted(tuple(r) for r in got.collect()) == [("a", 1, 0, ""), ("a", 1, 0, "x"), ("b", -5, 0, "types....Failed"), ("b", -4, 0, "  (\x1b[31m1 failed\x1b[0m)")]
    assert quiet_filter.filter_batch(got.select("stream", "ord", "line").limit(0)).count() == 0


def test_entries_over_several_tiers(spark, monkeypatch):
    monkeypatch.setattr(state_maps, "BLOCK", 3)
    rng = np.random.default_rng(2)
    maps = rng.integers(0, 4, (40, 4))
    rows = [("g", i, m.tolist()) for i, m in enumerate(maps)] + [(None, 0, [1, 2, 3, 0])]
    got, _ = state_maps.entries(spark.createDataFrame(rows, "g string, i long, map array<int>"), "g", "i", "state", 4, 2)
    state, want = 2, {}
    for i, m in enumerate(maps):
        want[i] = state
        state = int(m[state])
    assert {r.i: r.state for r in got.where("g = 'g'").collect()} == want and got.where("g is null").first().state == 2
    assert (state_maps.scanned(maps)[:, 2][:-1] == [want[i] for i in range(1, 40)]).all()


def test_slices_in_one_batch_are_walked_apart(monkeypatch):
    slices = [np.bitwise_and.reduce(np.random.default_rng(k).integers(0, 1 << 12, (3, n))).tolist() for k, n in enumerate([1, 5, 1, 300, 2, 70])]
    n, at = len(slices), [3, 0, 1, 0, 2, 0]
    columns = {"stream": pa.array(["a", "b", None, "a", "b", "c"]), "slice": pa.array(at, pa.int64()), "codes": pa.array(slices, pa.list_(pa.int16())), "marks": pa.array([[f"{k}-{i}" for i in range(len(x))] for k, x in enumerate(slices)]), "state": pa.array([5, 0, 3, 4, 7, 1], pa.int32()), "second": pa.array([0, 9, 3, 4, 15, 1], pa.int32())}
    columns["firsts"] = pa.array([None if k % 3 == 2 else [at[k] * quiet_filter.SLICE + len(x) - 1] for k, x in enumerate(slices)], pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_pydict(columns)
    made = lambda f, parts: [r for x in f(iter(parts)) for r in x.to_pylist()]
    for f in (quiet_filter._first_maps, quiet_filter._banners, quiet_filter._second_maps, quiet_filter._decisions):
        alone = made(f, [batch.slice(k, 1) for k in range(n)])
        assert alone and made(f, [batch]) == alone
        monkeypatch.setattr(quiet_filter, "LINES", 7)
        assert made(f, [batch]) == alone
        monkeypatch.undo()
    after, outcome = quiet_filter._first_automaton()
    for k, r in enumerate(made(quiet_filter._first_maps, [batch])):
        for state, last in enumerate(r["map"]):
            for code in slices[k]:
                state = after[code, state]
            assert state == last
    codes = np.arange(len(outcome))
    assert ((outcome == quiet_filter._BANNER).any(1) == (codes & quiet_filter._NO_BANNER == 0)).all()


def at(seconds):
    return datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(seconds=seconds)


SCHEMA = "stream string, ord long, line string, at timestamp"


class Feed:
    """A folder that a stream reads a file at a time, and what has left it."""

    def __init__(self, spark, path, **options):
        self.spark, self.path, self.options = spark, path, options

    def put(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(self.path / "in"))

    def run(self):
        """Reads all that is there, from the checkpoint on, and stops."""
        stream = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", "1").parquet(str(self.path / "in"))
        out = quiet_filter.filter_stream(stream, **self.options)
        q = out.writeStream.format("parquet").option("path", str(self.path / "out")).option("checkpointLocation", str(self.path / "cp")).outputMode("append").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    def lines(self, stream):
        return [r.line for r in self.spark.read.parquet(str(self.path / "out")).where(f"stream = '{stream}'").orderBy("seq").collect()]


def test_live_stream_in_order_with_summary_over_restarts(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        lines = some_lines(21, 400)
        moved = sorted(lines, key=lambda x, r=random.Random(4): x[0] + r.randrange(30))  # late by less than 30 places
        feed = Feed(spark, tmp_path, bound=30, end="<end>", timeout_ms=60_000)
        feed.put([("a", i, x, at(i)) for i, x in moved[:180]])  # several Arrow chunks in one micro-batch
        feed.run()
        some = feed.lines("a")
        feed.put([("a", i, x, at(i)) for i, x in moved[180:]])
        feed.run()  # a restart from the checkpoint
        feed.put([("a", 400, "<end>", at(400))])
        feed.run()
        want = [x for _, _, x in plain(lines)]
        assert feed.lines("a") == want and 0 < len(some) < len(want) and some == want[: len(some)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def test_live_stream_ends_by_time(spark, tmp_path):
    feed = Feed(spark, tmp_path, bound=5, timeout_ms=30_000)
    feed.put([("a", i, x, at(i)) for i, x in [(1, "b"), (0, "types....Failed"), (2, None)]] + [("b", 0, "open", at(100))])
    feed.run()  # the watermark passes a's end, not b's
    assert feed.lines("a") == ["types....Failed", "b", "", "  (\x1b[31m1 failed\x1b[0m)"] and feed.lines("b") == []
    feed.put([("a", 9, "anew", at(200)), ("c", 0, "x", at(300))])
    feed.run()
    assert feed.lines("b") == ["open"] and sorted(feed.lines("a"))[-3:] == ["anew", "b", "types....Failed"]  # a new stream of the name
