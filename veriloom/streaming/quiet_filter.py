"""A stateful filter of hook output: counts results, drops noise, collapses blanks. (STM-01 to STM-03, FLT-03, WIN-04,
WIN-05, AGG-07, SRC-18)

Quiet states the rules line by line; live streams run it, keyed by stream. A finished stream of any length is filtered on
all cores instead: what a line does hangs on a few flags of it (its code) and on the state before it, and that state falls
into two finite automata and the set of banners seen.

1. Codes come from built-in functions; lines are numbered in their stream and cut into slices.
2. The first automaton (metadata, pre-existing, separator) decides which lines are dropped, headings or ordinary. It knows
   nothing of banners, so the state in which each slice is entered follows from composed state maps.
3. Headings are then known, and so is the first place of each banner: a minimum by stream and banner.
4. With first places known, the second automaton (repeated banner, how-to-fix, blank) is finite too and is solved alike.
5. Decisions, a byte for each line, are joined to the lines by slice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veriloom.operators.numbering import numbered
from veriloom.session import ready, staged, unstage
from veriloom.streaming.state_maps import entries, scanned

# Fixed values of the reference's settings. (FLT-03, STM-01 to STM-03)
ANSI = re.compile(r"\x1b\[[0-9;]*m")
PASSED = re.compile(r"\.{3,}Passed$")
SKIPPED = re.compile(r"(\.{3,}Skipped$|\(no files to check\)Skipped$)")
FAILED = re.compile(r"\.{3,}Failed$")
STATUS = re.compile(r"\.{3,}(Failed|Passed|Skipped)$")
PRE_EXISTING = re.compile(r"^\s*\[Pre-existing \([0-9]+\)\]$")
SEPARATOR = re.compile(r"^={50,}$")
METADATA = ("- hook id:", "- duration:", "- files were modified")
EXACT = frozenset(("All checks passed!", "Analyzing diff for changed lines..."))
PREFIXES = ("- files were modified", "Both GOOGLE_API_KEY and GEMINI_API_KEY", "[WARNING] Unstaged", "  Failed to get diff for")
PATTERNS = tuple(
    map(
        re.compile,
        (
            "^[0-9]+ files? already formatted$",
            "^[0-9].*files? already formatted$",
            r"^\[INFO\] (Stashing|Restored)",
            "^  (Rate limited|Timeout|Service unavailable|Error), waiting",
            r"^  Skipping .* \(>[0-9]+KB\)",
            "^Running [0-9]+ check types in parallel",
            r"^OK .*: PASS \([0-9]+ms\)$",
            "^Summary: [0-9]+ passed",
            "^Total time: [0-9]+ms",
            r"^\[.*\] Processing [0-9]+ files",
            r"^\[.*\] Batch error:",
        ),
    )
)
HOW, RULE = "How to fix:", "=" * 70


def noise(clean: str) -> bool:
    """Whether a line is dropped wherever it stands. (FLT-03)"""
    return clean in EXACT or clean.startswith(PREFIXES) or any(p.search(clean) for p in PATTERNS)


@dataclass
class Quiet:
    """What is remembered between lines: counts, which kind of lines is being dropped, and headings seen."""

    passed: int = 0
    failed: int = 0
    skipped: int = 0
    metadata: bool = False
    pre_existing: bool = False
    separator: bool = False
    repeated: bool = False
    how: bool = False
    how_again: bool = False
    blank: bool = False
    banners: set[str] = field(default_factory=set)

    def line(self, text: str) -> list[str]:
        """What a line leaves: itself as it came (colours included), nothing, or itself within the rules of its banner."""
        clean = ANSI.sub("", text)
        if PASSED.search(clean):
            self.passed, self.metadata = self.passed + 1, True
            return []
        if SKIPPED.search(clean):
            self.skipped, self.metadata = self.skipped + 1, True
            return []
        self.failed += bool(FAILED.search(clean))
        self.metadata = self.metadata and (not clean or clean.startswith(METADATA))
        if self.metadata or noise(clean):
            return []
        if PRE_EXISTING.search(clean):
            self.pre_existing = True
            return []
        self.pre_existing = self.pre_existing and (not clean or clean[0] == " ")
        if self.pre_existing:
            return []
        if SEPARATOR.search(clean):
            self.separator = True
            return []
        heading, self.separator = self.separator and bool(clean), False
        if heading:
            return self._heading(text, clean)
        self.repeated = self.repeated and not STATUS.search(clean)
        if self.repeated:
            return []
        if clean == HOW:
            self.how, self.how_again = True, self.how
            return [] if self.how_again else [text]
        self.how_again = self.how_again and (not clean or clean[0] == " ")
        if self.how_again:
            return []
        again, self.blank = self.blank and not clean, not clean
        return [] if again else [text]

    def _heading(self, text: str, clean: str) -> list[str]:
        """A line behind a separator: a banner, of which only the first stays, or a list item."""
        if clean[0] == "-" or "0" <= clean[0] <= "9":
            return [RULE, text]
        if clean in self.banners:
            self.repeated = True
            return []
        self.banners.add(clean)
        self.how = self.how or clean == HOW
        return [RULE, text, RULE]

    def summary(self) -> str | None:
        """The totals, only if something failed. (AGG-07)"""
        if not self.failed:
            return None
        counts = ((self.passed, 32, "passed"), (self.failed, 31, "failed"), (self.skipped, 33, "skipped"))
        return "  (" + ", ".join(f"\x1b[{colour}m{n} {name}\x1b[0m" for n, colour, name in counts if n) + ")"

    def packed(self) -> tuple:
        return (self.passed, self.failed, self.skipped, self.metadata, self.pre_existing, self.separator, self.repeated, self.how, self.how_again, self.blank, sorted(self.banners))

    @classmethod
    def unpacked(cls, old: tuple) -> Quiet:
        return cls(*old[:10], set(old[10]))


OUT = "stream string, ord long, part int, line string"
#: Lines of a slice.
SLICE = 4096
_FLAGS = ("passed", "skipped", "failed", "metadata", "noise", "pre_existing", "separator", "blank", "indent", "item", "how", "status")
_BIT = {name: 1 << k for k, name in enumerate(_FLAGS)}
#: Lines that are walked at a time.
LINES = 65_536
_SLICES = "stream string, slice long, codes array<smallint>, marks array<string>, p long, f long, s long, last long, map array<int>"
#: What a banner's line never is.
_NO_BANNER = sum(_BIT[n] for n in ("passed", "skipped", "noise", "pre_existing", "separator", "blank", "item"))
_DROP, _LINE, _ITEM, _BANNER = range(4)


def _pattern(p: re.Pattern) -> Column:
    """Whether `clean` has a match; (?d) leaves \\n as the only line end, as in the rules."""
    return F.col("clean").rlike("(?d)" + p.pattern)


def code() -> Column:
    """The flags of a line's text without colours, `clean`."""
    clean = F.col("clean")
    starts = lambda prefixes: F.coalesce(*[F.when(clean.startswith(p), True) for p in prefixes], F.lit(False))
    noisy = clean.isin(*EXACT) | starts(PREFIXES) | _pattern(re.compile("|".join(f"(?:{p.pattern})" for p in PATTERNS)))
    first = F.substring(clean, 1, 1)
    tests = (_pattern(PASSED), _pattern(SKIPPED), _pattern(FAILED), starts(METADATA), noisy, _pattern(PRE_EXISTING), _pattern(SEPARATOR), clean == "", first == " ", first.isin(*"-0123456789"), clean == HOW, _pattern(STATUS))
    flags = [F.when(t, F.lit(_BIT[n])).otherwise(F.lit(0)) for n, t in zip(_FLAGS, tests, strict=True)]
    return sum(flags[1:], flags[0]).cast("int")


@cache
def _first_automaton() -> tuple[np.ndarray, np.ndarray]:
    """(states after, outcomes) by code and state: metadata 1, pre-existing 2, separator 4."""
    codes, state = np.arange(1 << len(_FLAGS))[:, None], np.arange(8)[None, :]
    has = {n: (codes & b) > 0 for n, b in _BIT.items()}
    meta, pre, sep = ((state & b) > 0 for b in (1, 2, 4))
    swallowed = has["passed"] | has["skipped"]
    meta_after = swallowed | (meta & (has["blank"] | has["metadata"]))
    dropped = meta_after | has["noise"]
    pre_after = np.where(dropped, pre, has["pre_existing"] | (pre & (has["blank"] | has["indent"])))
    dropped = dropped | pre_after
    sep_after = np.where(dropped, sep, has["separator"])
    heading = ~dropped & sep & ~has["blank"] & ~has["separator"]
    outcome = np.where(dropped | has["separator"], _DROP, np.where(heading, np.where(has["item"], _ITEM, _BANNER), _LINE))
    return (meta_after + 2 * pre_after + 4 * sep_after).astype(np.int8), outcome.astype(np.int8)


@cache
def _second_automaton() -> tuple[np.ndarray, np.ndarray]:
    """(states after, parts) by symbol and state: repeated 1, how 2, how again 4, blank 8. A symbol is an outcome, whether
    a banner stands there first, and four flags of the code; parts are the rows that a line leaves (of a heading 2 or 3)."""
    symbol, state = np.arange(128)[:, None], np.arange(16)[None, :]
    outcome, first, how_line, status, blank_line, indent = symbol >> 5, symbol >> 4 & 1, symbol >> 3 & 1, symbol >> 2 & 1, symbol >> 1 & 1, symbol & 1
    repeated, how, again, blank = (state >> k & 1 for k in range(4))
    banner, plain = outcome == _BANNER, outcome == _LINE
    repeated_after = np.where(banner, np.where(first, repeated, 1), np.where(plain, repeated & ~status, repeated))
    live = plain & (repeated_after == 0)
    how_row = live & (how_line == 1)
    again_after = np.where(how_row, how, np.where(live, again & (blank_line | indent), again))
    how_after = np.where(how_row | (banner & (first == 1) & (how_line == 1)), 1, how)
    other = live & ~how_row & (again_after == 0)
    blank_after = np.where(other, blank_line, blank)
    parts = np.where(banner, 3 * first, np.where(outcome == _ITEM, 2, np.where(how_row, 1 - how, other & ~((blank == 1) & (blank_line == 1)))))
    return (repeated_after + 2 * how_after + 4 * again_after + 8 * blank_after).astype(np.int8), parts.astype(np.int8)


def _walk(maps: np.ndarray, place: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The state before each step; place: of a step in its slice, state: in which the slice of a step is entered."""
    before, later = state.astype(np.intp), np.flatnonzero(place)
    before[later] = scanned(maps, place)[later - 1, before[later]]
    return before


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices (stream, slice, codes, ...), many short ones or a few long ones at a time; of their lines, one slice behind
    the other, the code, the row of the slice and the place in it."""
    for batch in batches:
        lengths = pc.list_value_length(batch["codes"]).to_numpy()
        ends, start = np.cumsum(lengths), 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] - lengths[start] + LINES, "right")))
            part, n = batch.slice(start, stop - start), lengths[start:stop]
            row = np.repeat(np.arange(len(n)), n)
            yield part, part["codes"].flatten().to_numpy(), row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = stop


def _ints(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch[name].to_numpy().astype(np.int64)


def _with_map(batch: pa.RecordBatch, maps: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Slices with what each does to a state as `map`."""
    ends = np.flatnonzero(np.append(place[1:] == 0, True))
    whole, states = scanned(maps, place)[ends], maps.shape[1]
    return batch.append_column("map", pa.ListArray.from_arrays(np.arange(0, states * len(ends) + 1, states, dtype=np.int32), whole.astype(np.int32).ravel()))


def _first_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    after, _ = _first_automaton()
    for batch, codes, _, place in _chunks(batches):
        yield _with_map(batch, after[codes], place)


def _outcomes(batch: pa.RecordBatch, codes: np.ndarray, row: np.ndarray, place: np.ndarray) -> np.ndarray:
    after, outcome = _first_automaton()
    return outcome[codes, _walk(after[codes], place, _ints(batch, "state")[row])].astype(np.intp)


def _banners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(stream, mark, n) of the banners in slices (stream, slice, codes, marks, state)."""
    for batch, codes, row, place in _chunks(batches):
        at = np.flatnonzero(_outcomes(batch, codes, row, place) == _BANNER)
        n = _ints(batch, "slice")[row[at]] * SLICE + place[at]
        yield pa.RecordBatch.from_arrays([batch["stream"].take(pa.array(row[at])), batch["marks"].flatten().take(pa.array(at)), pa.array(n)], names=["stream", "mark", "n"])


def _symbols(batch: pa.RecordBatch, codes: np.ndarray, row: np.ndarray, place: np.ndarray) -> np.ndarray:
    outcome, first = _outcomes(batch, codes, row, place), np.zeros(len(codes), dtype=np.intp)
    of = pc.list_parent_indices(batch["firsts"]).to_numpy()  # slices without first places have a null
    first[np.flatnonzero(place == 0)[of] + batch["firsts"].flatten().to_numpy() - _ints(batch, "slice")[of] * SLICE] = 1
    has = lambda n: ((codes & _BIT[n]) > 0).astype(np.intp)
    return outcome << 5 | first << 4 | has("how") << 3 | has("status") << 2 | has("blank") << 1 | has("indent")


def _second_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(stream, slice, map) of slices (stream, slice, codes, state, firsts)."""
    after, _ = _second_automaton()
    for batch, *lines in _chunks(batches):
        yield _with_map(batch.select(["stream", "slice"]), after[_symbols(batch, *lines)], lines[-1])


def _decisions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(stream, slice, parts), a byte for each line, of slices (stream, slice, codes, state, firsts, second)."""
    after, parts = _second_automaton()
    for batch, codes, row, place in _chunks(batches):
        symbols = _symbols(batch, codes, row, place)
        made = parts[symbols, _walk(after[symbols], place, _ints(batch, "second")[row])].astype(np.int8)
        ends = np.append(np.flatnonzero(place == 0), len(place)).astype(np.int32)
        yield batch.select(["stream", "slice"]).append_column("parts", pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(made.tobytes())]))


def _summary(passed: Column, failed: Column, skipped: Column) -> Column:
    """The totals, of which zero ones are left out. (AGG-07)"""
    shown = [F.when(n > 0, F.concat(F.lit(f"\x1b[{colour}m"), n.cast("string"), F.lit(f" {name}\x1b[0m"))) for n, colour, name in ((passed, 32, "passed"), (failed, 31, "failed"), (skipped, 33, "skipped"))]
    return F.concat(F.lit("  ("), F.concat_ws(", ", *shown), F.lit(")"))


def filter_batch(lines: DataFrame, size: int = SLICE) -> DataFrame:
    """(stream, ord, part, line) that stay of lines (stream, ord, line); the summary comes last, where something failed.

    Lines of a stream follow ord, equal ones the text; a null line is empty, a null stream is a stream. A stream of any
    length is spread over all tasks: only slices of `size` lines, as codes without their texts, are held by one. The result
    reads tables in the shared folder.
    """
    spark, used = ready(lines.sparkSession), []
    if size > SLICE:
        raise ValueError(f"slices have {SLICE} lines at most")

    def keep(df: DataFrame, name: str) -> DataFrame:
        out, path = staged(df, name)
        used.append(path)
        return out

    text = F.coalesce(F.col("line").cast("string"), F.lit(""))
    rows = lines.select(F.col("stream").cast("string").alias("stream"), F.col("ord").cast("long").alias("ord"), text.alias("line"))
    coded = rows.withColumn("clean", F.regexp_replace("line", ANSI.pattern, "")).withColumn("code", code()).withColumn("mark", F.when(F.col("code").bitwiseAND(_NO_BANNER) == 0, F.sha2("clean", 256))).drop("clean")
    placed, paths = numbered(coded, "stream", [F.col("ord").asc_nulls_first(), F.col("line")], "n")
    placed = placed.withColumn("slice", F.expr(f"n div {size}"))
    # a line's place in _banners counts SLICE lines a slice, whatever size is
    found = lambda n: (F.col("code").bitwiseAND(_BIT[n]) > 0).cast("long")
    passed, skipped = found("passed"), found("skipped") * (1 - found("passed"))
    counts = (F.sum(passed).alias("p"), F.sum(found("failed") * (1 - found("passed")) * (1 - skipped)).alias("f"), F.sum(skipped).alias("s"), F.max("ord").alias("last"))
    held = F.array_sort(F.collect_list(F.struct("n", F.col("code").cast("short").alias("code"), "mark")))  # a slice's own lines at most
    grouped = placed.groupBy("stream", "slice").agg(held.alias("held"), *counts).select("stream", "slice", F.col("held.code").alias("codes"), F.col("held.mark").alias("marks"), "p", "f", "s", "last")
    packed = keep(grouped.mapInArrow(_first_maps, _SLICES), "slices")
    first, more = entries(packed, "stream", "slice", "state", 8)
    used += more
    same = lambda other: packed["stream"].eqNullSafe(other["stream"]) & (packed["slice"] == other["slice"])
    entered = keep(packed.join(first, same(first)).select(packed["stream"], packed["slice"], "codes", "marks", "state"), "entered")
    places = entered.mapInArrow(_banners, "stream string, mark string, n long").groupBy("stream", "mark").agg(F.min("n").alias("n"))
    firsts = places.groupBy(F.col("stream").alias("_stream"), F.expr(f"n div {SLICE}").alias("_slice")).agg(F.collect_list("n").alias("firsts"))  # a slice's own lines at most
    ready_slices = keep(entered.join(firsts, F.col("stream").eqNullSafe(F.col("_stream")) & (F.col("slice") == F.col("_slice")), "left").select("stream", "slice", "codes", "state", "firsts"), "firsts")
    second, more = entries(ready_slices.mapInArrow(_second_maps, "stream string, slice long, map array<int>"), "stream", "slice", "second", 16)
    used += more
    solved = ready_slices.join(second, ready_slices["stream"].eqNullSafe(second["stream"]) & (ready_slices["slice"] == second["slice"])).select(ready_slices["stream"], ready_slices["slice"], "codes", "state", "firsts", "second")
    decided, _ = staged(solved.mapInArrow(_decisions, "stream string, slice long, parts binary"), "decided")
    decided = decided.select(F.col("stream").alias("_stream"), F.col("slice").alias("_slice"), "parts")
    totals = packed.groupBy("stream").agg(*[F.sum(n).alias(n) for n in "pfs"], F.max("last").alias("last"))
    end, _ = staged(totals.where("f > 0").select("stream", (F.col("last") + 1).alias("ord"), F.lit(0).alias("part"), _summary(F.col("p"), F.col("f"), F.col("s")).alias("line")), "summaries")
    parts = F.ascii(F.substring("parts", (F.col("n") % size + 1).cast("int"), F.lit(1)).cast("string"))
    kept = placed.join(decided, F.col("stream").eqNullSafe(F.col("_stream")) & (F.col("slice") == F.col("_slice"))).withColumn("k", parts).where("k > 0")
    rule = F.lit(RULE)
    left = F.when(F.col("k") == 1, F.array("line")).when(F.col("k") == 2, F.array(rule, F.col("line"))).otherwise(F.array(rule, F.col("line"), rule))
    out = kept.select("stream", "ord", F.posexplode(left).alias("part", "line"))
    unstage(spark, *used)
    return out.unionByName(end)


LIVE = "stream string, seq long, ord long, part int, line string"
_STATE = "passed int, failed int, skipped int, metadata boolean, pre_existing boolean, separator boolean, repeated boolean, how boolean, how_again boolean, blank boolean, banners array<string>, seq long, high long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class _Live(StatefulProcessor):
    """The filter of one live stream: lines wait until `bound` later ones have been seen and leave in order."""

    def __init__(self, bound: int, end: str | None, timeout_ms: int):
        self.bound, self.end, self.timeout_ms = bound, end, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("filter", _STATE)
        self.pending = handle.getListState("pending", "ord long, line string")
        self.last = handle.getValueState("last", "at long")

    def _rows(self, key: tuple, q: Quiet, seq: int, due: list[tuple], finish: bool) -> pd.DataFrame:
        rows = []
        for at, text in due:
            for k, x in enumerate(q.line(text)):
                rows.append((key[0], seq, at, k, x))
                seq += 1
        end = q.summary() if finish else None
        if end:
            rows.append((key[0], seq, due[-1][0] + 1 if due else seq, 0, end))
            seq += 1
        self.seq = seq
        return pd.DataFrame(rows, columns=["stream", "seq", "ord", "part", "line"])

    def _load(self) -> tuple[Quiet, int, int | None, list[tuple]]:
        old = self.state.get() if self.state.exists() else None
        pending = [(r[0], r[1]) for r in self.pending.get()] if self.pending.exists() else []
        return (Quiet.unpacked(old), old[11], old[12], pending) if old else (Quiet(), 0, None, pending)

    def _finish(self) -> None:
        for state in (self.state, self.pending, self.last):
            state.clear()
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        q, seq, high, pending = self._load()
        latest = self.last.get()[0] if self.last.exists() else 0
        for frame in rows:  # several Arrow chunks are one batch of lines
            pending += [(int(at), text if isinstance(text, str) else "") for at, text in frame[["ord", "line"]].itertuples(index=False)]
            latest = max(latest, int(frame["at_ms"].max()))
        pending.sort()
        high = max([pending[-1][0], *([high] if high is not None else [])])
        ended = self.end is not None and any(text == self.end for _, text in pending)
        due = [x for x in pending if ended or x[0] <= high - self.bound]
        yield self._rows(key, q, seq, [x for x in due if x[1] != self.end], ended)
        if ended:
            self._finish()
            return
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(latest + self.timeout_ms)
        self.last.update((latest,))
        self.state.update((*q.packed(), self.seq, high))
        self.pending.put(pending[len(due) :]) if len(due) < len(pending) else self.pending.clear()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        q, seq, _, pending = self._load()
        yield self._rows(key, q, seq, sorted(pending), True)
        self._finish()


def filter_stream(lines: DataFrame, *, bound: int = 1000, end: str | None = None, delay: str = "10 seconds", timeout_ms: int = 60_000) -> DataFrame:
    """(stream, seq, ord, part, line) that stay of streaming lines (stream, ord, line, at), in append mode. (SRC-18)

    A line that comes up to `bound` places late leaves in its place: lines wait until the stream has reached ord + bound. A
    later one leaves when it comes. A stream ends with the line `end`, which is dropped, or once event time (`at`, with a
    watermark of `delay`) is timeout_ms behind its last line: lines that wait leave, then the summary, where something
    failed, and the stream's state is deleted; lines of its name then begin a new stream. seq numbers a stream's rows as they
    leave. Null lines are empty. State is typed and lies in the checkpoint (RocksDB), so a restart goes on where it was.
    """
    spark = ready(lines.sparkSession)
    if "RocksDB" not in spark.conf.get(_PROVIDER, ""):
        spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = lines.withWatermark("at", delay).select(F.col("stream").cast("string").alias("stream"), F.col("ord").cast("long").alias("ord"), F.col("line").cast("string").alias("line"), F.unix_millis("at").alias("at_ms"), "at")
    return timed.groupBy("stream").transformWithStateInPandas(statefulProcessor=_Live(bound, end, timeout_ms), outputStructType=LIVE, outputMode="Append", timeMode="EventTime")
