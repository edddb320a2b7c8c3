"""Token counts of whole texts by a map-side two-tier lookup of pre-token lengths.

A pre-token is a run of spaces with the non-spaces behind it. The vocabulary's pieces hold the space mark only at their
start, so no merge crosses a pre-token's start and a text's count is the sum of its pre-tokens' counts.

Tier one is a broadcast hash table of at most TABLE frequent pre-tokens: two arrays, keys and lengths, which workers map
as they are. What is frequent is learnt from at most SAMPLE texts; that only saves time, for counts don't depend on the
table. Tier two is each worker's own cache, which encodes what the table misses. Pre-tokens are never shuffled: each task
counts its texts on its own, a batch of them at once in numpy.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.shingles import span_hashes
from veriloom.session import ready

MODEL = "piece_bpe_32k"
#: Entries of the broadcast table, and texts and tasks that they are learnt from.
TABLE, SAMPLE, PARTS = 32_768, 2_048, 4
#: Entries of a worker's cache, which then starts anew, and of the counter of the sample's pre-tokens, which then forgets rare ones.
CACHE, COUNTER = 400_000, 400_000
#: Pre-tokens longer than this (bytes) are encoded at once and not kept.
LONG = 64
#: Bytes that are cut into pre-tokens at once.
AT_ONCE = 1 << 20
_PRE = re.compile(" *[^ ]+| +")
_CUT = re.compile("(?<! ) ")


@cache
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of text without the first of their leading spaces (the library puts one before each text).

    One that is left empty is a single space at the end of text, which is one token.
    """
    text = text.replace("▁", " ")
    if "  " not in text and text[-1:] != " " and text[:1] != " ":
        return text.split(" ") if text else []
    return [x[1:] for x in _PRE.findall(" " + text)] if text else []


class Table:
    """An open-addressing hash table of 64-bit keys and small lengths, in two arrays."""

    def __init__(self, keys: np.ndarray, lengths: np.ndarray):
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys, self.lengths = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint16)
        self.probes = 1
        for key, n, at in zip(keys.tolist(), lengths.tolist(), self._slots(keys).tolist(), strict=True):
            steps = 1
            while self.keys[at] and self.keys[at] != key:
                at, steps = (at + 1) & ((1 << self.bits) - 1), steps + 1
            self.keys[at], self.lengths[at] = key, n
            self.probes = max(self.probes, steps)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The length of each key, 0 where there is none."""
        out, at, rest = np.zeros(len(keys), np.int64), self._slots(keys), np.arange(len(keys))
        for _ in range(self.probes):
            there = self.keys[at]
            hit = there == keys[rest]
            out[rest[hit]] = self.lengths[at[hit]]
            go = ~hit & (there != 0)
            rest, at = rest[go], (at[go] + 1) & ((1 << self.bits) - 1)
            if not len(rest):
                break
        return out


def cut_texts(texts: list[str | None]) -> Iterator[tuple[list[int], list[bytes]]]:
    """About AT_ONCE bytes of texts at a time, as parts that begin with a pre-token's first space, with the text of each;
    a longer text is cut between pre-tokens."""
    who, held, size = [], [], 0
    for i, text in enumerate(texts):
        if not text:
            continue
        text = " " + text.replace("▁", " ")
        at = 0
        while at < len(text):
            cut = _CUT.search(text, at + AT_ONCE) if len(text) - at > AT_ONCE else None
            end = cut.start() if cut else len(text)
            held.append(text[at:end].encode("utf-8", "surrogatepass"))
            who.append(i)
            size, at = size + len(held[-1]), end
            if size >= AT_ONCE:
                yield who, held
                who, held, size = [], [], 0
    if held:
        yield who, held


def spans_of(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of parts, starts and ends of their pre-tokens (their first space left out), and each one's part."""
    raw = np.frombuffer(b"".join(parts), np.uint8)
    begins = np.cumsum([0, *map(len, parts)])
    space = raw == 0x20
    first = space & ~np.concatenate([[False], space[:-1]])
    first[begins[:-1]] = True
    starts = np.flatnonzero(first)
    return raw, starts + 1, np.append(starts[1:], len(raw)), np.searchsorted(begins, starts, "right") - 1


class Counts:
    """A worker's look-ups."""

    def __init__(self, path: str, table: Table):
        self.model, self.table, self.kept = processor(path), table, {}

    def count(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for who, parts in cut_texts(texts):
            raw, starts, ends, part = spans_of(parts)
            keys = span_hashes(raw, starts, ends)
            lengths = self.table.get(keys)
            lengths[ends == starts] = 1
            missed = np.flatnonzero(lengths == 0)
            if len(missed):
                lengths[missed] = self._missed(raw, starts[missed], ends[missed], keys[missed])
            out += np.bincount(np.array(who)[part], weights=lengths, minlength=len(texts)).astype(np.int64)
        return out

    def _missed(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> np.ndarray:
        if len(self.kept) > CACHE:
            self.kept = {}
        keys[ends - starts > LONG] ^= np.uint64(1) << np.uint64(63)  # so that a long one never has the key of a kept one by chance of its place
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        names = distinct.tolist()
        found = [*map(self.kept.get, names)]
        new = [i for i, n in enumerate(found) if n is None]
        data = raw.tobytes() if new else b""
        words = [data[starts[first[i]] : ends[first[i]]].decode("utf-8", "surrogatepass") for i in new]
        for i, word, ids in zip(new, words, self.model.encode(words, num_threads=1), strict=True):
            found[i] = len(ids)
            if ends[first[i]] - starts[first[i]] <= LONG:
                self.kept[names[i]] = found[i]
        return np.array(found, dtype=np.int64)[inverse]


def _frequent(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row: the most frequent pre-tokens of a task's first texts, and how often they occur."""
    seen, left = Counter(), SAMPLE // PARTS
    for frame in frames:
        for text in frame["text"].iloc[:left]:
            seen.update(w for w in pre_tokens(text or "") if 0 < len(w) and len(w.encode("utf-8", "surrogatepass")) <= LONG)
        left -= len(frame)
        if len(seen) > COUNTER:
            seen = Counter(dict(seen.most_common(COUNTER // 4)))
        if left <= 0:
            break
    top = seen.most_common(TABLE // PARTS)
    if top:
        yield pd.DataFrame({"pre": [[k for k, _ in top]], "n": [[n for _, n in top]]})


def frequent(docs: DataFrame, text_col: str = "text", *, path: str) -> Table:
    """The table of pre-tokens that are frequent in SAMPLE texts: the first ones of PARTS tasks, without a shuffle."""
    rows = docs.select(F.col(text_col).alias("text")).mapInPandas(_frequent, "pre array<string>, n array<long>").limit(PARTS).collect()  # TABLE pre-tokens at most
    seen = sum((Counter(dict(zip(r.pre, r.n, strict=True))) for r in rows), Counter())
    words = sorted(seen, key=lambda w: (-seen[w], w))
    if not words:
        return Table(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    data = [w.encode("utf-8", "surrogatepass") for w in words]
    ends = np.cumsum([*map(len, data)])
    keys = span_hashes(np.frombuffer(b"".join(data), np.uint8), np.append(0, ends[:-1]), ends)
    return Table(keys, np.array([len(x) for x in processor(path).encode(words, num_threads=1)], dtype=np.int64))


def count_tokens(docs: DataFrame, text_col: str = "text", *, path: str | None = None, limit: int = 4096, out: tuple[str, str, str] = ("n_bytes", "n_tokens", "over_limit")) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens (no begin or end token) and over_limit (n_tokens > limit).

    A null or empty text has 0 of both. Texts of any length are counted whole, a piece at a time. Columns of docs named
    like an output column are replaced; all others, repeated rows and rows with null ids stay as they are. Strings that
    look like control tokens are ordinary text, as in the library. An empty table stays empty.
    """
    import public_tokenizers

    spark = ready(docs.sparkSession)
    path = path or public_tokenizers.path(f"{MODEL}.model")
    table = spark.sparkContext.broadcast(frequent(docs, text_col, path=path))

    @F.pandas_udf("long")
    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counts = Counts(path, table.value)
        for batch in batches:
            yield pd.Series(counts.count(batch.tolist()), dtype="int64")

    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.withColumns({out[0]: F.octet_length(text).cast("long"), out[1]: lengths(text)})
    return counted.withColumn(out[2], F.col(out[1]) > limit)
