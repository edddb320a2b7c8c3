"""Quality rules of documents, and host verdicts from shrunk failure rates.

Each whole text gets word, symbol, line and repetition counts. Rules on them mark documents that fail; failures are
summed by host (map-side first), each host's rate is shrunk towards the corpus by a beta prior fitted to all hosts by
moments, and documents of hosts whose shrunk rate passes HOST_RATE leave with the host. Only those hosts are joined back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.llm.shingles import mix, word_hashes
from veriloom.llm.names import free
from veriloom.session import ready, staged, tidy, unstage

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MIN_WORDS, REPEAT_PERCENT = 50, 50
#: Further rules: symbols in percent of words, repeated lines in percent of lines with a word.
SYMBOL_PERCENT, LINE_PERCENT = 50, 50
#: A host leaves if its shrunk failure rate is above this.
HOST_RATE = 0.6
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
_CHUNK = 1 << 20


def _repeats(hashes: np.ndarray) -> int:
    """Words that lie in a window of three words which occurs at least twice."""
    n = len(hashes) - 2
    if n < 2:
        return 0
    rolled = mix(hashes[:n] * _PLACE[0] + hashes[1 : n + 1] * _PLACE[1] + hashes[2:] * _PLACE[2])
    _, inverse, count = np.unique(rolled, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[inverse] > 1)
    if not len(at):
        return 0
    hit = np.zeros(len(hashes), dtype=bool)
    for j in range(3):
        hit[at + j] = True
    return int(hit.sum())


def stats(texts: list[str | None]) -> list[tuple[int, int, int, int, int, int]]:
    """STATS of each text; null texts have no words."""
    out, at = [], 0
    while at < len(texts):
        parts, size, first = [], 0, at
        while at < len(texts) and (size < _CHUNK or at == first):
            parts.append((texts[at] or "").encode("utf-8", "surrogatepass"))
            size += len(parts[-1]) + 1
            at += 1
        starts, hashes = word_hashes(b"\n".join(parts))
        cuts = np.searchsorted(starts, np.cumsum([0] + [len(p) + 1 for p in parts]))
        for k, text in enumerate(texts[first:at]):
            text = text or ""
            own = hashes[cuts[k] : cuts[k + 1]]
            lines, seen, again = 0, set(), 0
            for line in text.split("\n"):
                if line.strip(SPACES):
                    lines += 1
                    again += line in seen
                    seen.add(line)
            spaces = sum(map(text.count, SPACES))
            out.append((len(own), len(text) - spaces, sum(map(text.count, SYMBOLS)), again, _repeats(own), lines))
    return out


def with_stats(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    ready(docs.sparkSession)

    @F.pandas_udf(STATS)
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in STATS.split(", ")]
        for batch in batches:
            yield pd.DataFrame(stats(batch.tolist()), columns=names, dtype="int64")
        tidy()

    return docs.withColumn(name, measure(F.coalesce(F.col(text_col), F.lit(""))))


def base_failed(s: str) -> Column:
    """Too few words, or more than half of them in repeated windows."""
    return (F.col(f"{s}.n_words") < MIN_WORDS) | (100 * F.col(f"{s}.n_repeat_words") > REPEAT_PERCENT * F.col(f"{s}.n_words"))


def any_failed(s: str) -> Column:
    """A base rule, or the symbol or line rule."""
    return base_failed(s) | (100 * F.col(f"{s}.n_symbols") > SYMBOL_PERCENT * F.col(f"{s}.n_words")) | (100 * F.col(f"{s}.n_dup_lines") > LINE_PERCENT * F.col(f"{s}.n_lines"))


def prior(hosts: DataFrame) -> tuple[float, float]:
    """Beta prior (a, b) by moments over (host, n, failed): one row of sums on the driver. Alike hosts give a strong one."""
    rate = F.col("failed") / F.col("n")
    x = hosts.agg(F.sum("n").alias("n"), F.sum("failed").alias("f"), F.sum(F.col("n") * rate * rate).alias("s"), F.count("*").alias("k"), F.sum(1 / F.col("n")).alias("i")).first()
    if not x.n:
        return 1.0, 1.0
    mean = min(max(x.f / x.n, 1e-3), 1 - 1e-3)
    noise = mean * (1 - mean) * x.k / x.n  # what sampling alone adds to the weighted variance
    between = max(x.s / x.n - (x.f / x.n) ** 2 - noise, 1e-6)
    strength = min(max(mean * (1 - mean) / between - 1, 1.0), 1e4)
    return mean * strength, (1 - mean) * strength


def host_table(measured: DataFrame, host: str, s: str) -> DataFrame:
    """(host, n, failed) of all documents; a null host is a host of its own."""
    return measured.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), F.sum(any_failed(s).cast("long")).alias("failed"))


def apply_rules(docs: DataFrame, text_col: str = "text", host_col: str = "source", *, host_rate: float = HOST_RATE, out: str = "quality_rules") -> DataFrame:
    """docs with a struct column `out`: STATS, base_failed, failed, host_failed and kept.

    kept is false if a base rule fails or the host's shrunk failure rate is above host_rate. Null texts count as
    empty, null hosts as one host. Texts of any length are measured whole. Equal rows get equal results. A column named
    like `out` is replaced; all others, and repeated rows, stay, whatever their names. An empty table stays empty.

    The texts are read twice and never shuffled unless the failing hosts are too many for a broadcast. The result reads a
    table of failing hosts in the shared folder.
    """
    s, bad_host, is_bad = free(docs, "stats", "host", "bad")
    hosts, at = staged(host_table(with_stats(docs.select(F.col(host_col).alias("host"), F.col(text_col).alias("text")), "text", s), "host", s), "hosts")
    a, b = prior(hosts)
    shrunk = (F.col("failed") + a) / (F.col("n") + a + b)
    bad, _ = staged(hosts.where(shrunk > host_rate).select(F.col("host").alias(bad_host), F.lit(True).alias(is_bad)), "bad-hosts")
    unstage(docs.sparkSession, at)
    joined = with_stats(docs, text_col, s).join(bad, F.col(host_col).eqNullSafe(F.col(bad_host)), "left")
    host_failed = F.coalesce(F.col(is_bad), F.lit(False))
    names = [c.split()[0] for c in STATS.split(", ")]
    verdict = F.struct(*[F.col(f"{s}.{c}").alias(c) for c in names], base_failed(s).alias("base_failed"), any_failed(s).alias("failed"), host_failed.alias("host_failed"), (~base_failed(s) & ~host_failed).alias("kept"))
    return joined.withColumn(out, verdict).select(*[c for c in docs.columns if c != out], out)
