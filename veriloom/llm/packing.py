"""Hierarchical multi-length packing of whole documents into sequences.

A document's ids are those of the byte-level vocabulary, then END. Each task packs the documents that it reads, in
windows of bounded size, so packing needs no shuffle and a lost task is simply read and packed again:

* full windows: a document of n ids gives n // 1024 sequences of its own; the rest is routed to the smallest tier
  (128, 256, 512, 1024) that holds it;
* each tier, from the longest down, is packed into windows of its own length, from its longest piece down; the gap behind
  a piece is filled with whole pieces from the same or shorter tiers, best fit first, and what then is left of the gap
  with the head of a cut piece, whose tail is routed anew;
* the last, incomplete sequence of a task is split into sequences of power-of-two lengths, which need no padding.

Sequences are dealt to step groups by length, so that each group of a window holds about as many tokens and as many
sequences of each length as the others. A task numbers its groups on from window to window.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.session import ready, tidy

#: Longest sequence, tiers below it, the id behind each document, sequences' tokens in a step group.
LENGTH, TIERS, END, STEP = 1024, (128, 256, 512, 1024), 0, 64 * 1024
#: Ids that a task holds at once, at least; a window is packed when it is reached.
WINDOW = 8_000_000
VOCABULARY = "byte_bpe_50k"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, tier int, step_group long"

#: Characters on which both libraries' split patterns agree whatever their Unicode version.
_PLAIN = bytes([0x09, 0x0A, 0x0D, *range(0x20, 0x7F), *range(0xA0, 0x100)])
_OTHER = re.compile("[^\\t\\n\\r\\x20-\\x7e\\xa0-\\u024f\\u2013\\u2014\\u2018-\\u201e\\u2022\\u2026\\u20ac]")


#: Public split pattern of the vocabulary, with possessive repeats, which split alike and backtrack less.
_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@cache
def encoders(path: str):
    """The tokenizers library's encoder of path, and tiktoken's over the same vocabulary, whose file lies beside it."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(path)
    import tiktoken

    with open(path.removesuffix(".json") + ".tiktoken", "rb") as file:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    special = {t.content: i for i, t in full.get_added_tokens_decoder().items()}
    return full, tiktoken.Encoding("veriloom", pat_str=_SPLIT, mergeable_ranks=table, special_tokens=special)


def _plain(text: str) -> bool:
    try:
        return not text.encode("latin-1").translate(None, _PLAIN)
    except UnicodeEncodeError:
        return not _OTHER.search(text)


def encode(text: str, path: str) -> np.ndarray:
    """Ids of text as the tokenizers library gives them without added special tokens.

    tiktoken gives the same ids several times faster where the text holds only characters that both split alike (tests
    compare random texts); any other text goes to the tokenizers library.
    """
    full, fast = encoders(path)
    if not _plain(text):
        return np.array(full.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
    return np.asarray(fast.encode_to_numpy(text, allowed_special="all"), dtype=np.uint32)


class Lengths:
    """Pieces by length; takes the longest that fits."""

    def __init__(self, length: int):
        self.stacks: list[list[int]] = [[] for _ in range(length + 1)]
        self.present: list[int] = []

    def add(self, n: int, piece: int) -> None:
        if not self.stacks[n]:
            at = bisect_right(self.present, n)
            self.present.insert(at, n)
        self.stacks[n].append(piece)

    def take(self, most: int) -> tuple[int, int] | None:
        at = bisect_right(self.present, most)
        if not at:
            return None
        n = self.present[at - 1]
        piece = self.stacks[n].pop()
        if not self.stacks[n]:
            self.present.pop(at - 1)
        return n, piece

    def shortest(self) -> tuple[int, int] | None:
        if not self.present:
            return None
        n = self.present[0]
        piece = self.stacks[n].pop()
        if not self.stacks[n]:
            self.present.pop(0)
        return n, piece


def plan(sizes: list[int], length: int = LENGTH, tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length). All but the last few hold exactly as many ids as a tier's window;
    those hold powers of two. The longest window is length."""
    windows = [0, *sorted({t for t in tiers if t < length}), length]
    sequences: list[list[tuple[int, int, int]]] = []
    rest, starts = Lengths(length), {}
    for d, n in enumerate(sizes):
        whole = n // length * length
        sequences += [[(d, s, length)] for s in range(0, whole, length)]
        if n > whole:
            starts[d] = whole
            rest.add(n - whole, d)
    for below, tier in reversed(list(zip(windows, windows[1:], strict=False))):
        while rest.present and rest.present[-1] > below:
            sequence, gap = [], tier
            while gap:
                got = rest.take(gap)
                cut = got is None
                if cut:
                    got = rest.shortest()
                if got is None:
                    break
                n, d = got
                used = min(n, gap)
                sequence.append((d, starts[d], used))
                starts[d] += used
                gap -= used
                if used < n:
                    rest.add(n - used, d)
            if not gap:
                sequences.append(sequence)
                continue
            used = tier - gap  # nothing is left: powers of two need no padding
            pieces = iter(sequence)
            d, s, n = next(pieces)
            for bit in reversed(range(used.bit_length())):
                part, need = [], used & (1 << bit)
                while need:
                    k = min(n, need)
                    part.append((d, s, k))
                    s, n, need = s + k, n - k, need - k
                    if not n:
                        d, s, n = next(pieces, (0, 0, 0))
                if part:
                    sequences.append(part)
            return sequences
    return sequences


def deal(totals: list[int], step: int) -> tuple[list[int], int]:
    """The group, from 0, of each sequence, and the number of groups; the longer ones are dealt first, one to each group
    in turn, and the next length goes on where the last one ended."""
    groups = max(1, round(sum(totals) / step))
    out = [0] * len(totals)
    for k, i in enumerate(sorted(range(len(totals)), key=lambda i: -totals[i])):
        out[i] = k % groups
    return out, groups


def _pack(path: str, length: int, tiers: tuple[int, ...], step: int, window: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        base, made, dealt = TaskContext.get().partitionId() << 40, 0, 0
        ids: list[np.ndarray] = []
        docs: list = []
        held, held_as = 0, np.uint16 if encoders(path)[0].get_vocab_size() <= 1 << 16 else np.uint32

        def flush() -> Iterator[pd.DataFrame]:
            nonlocal made, dealt
            sequences = plan([len(x) + 1 for x in ids], length, tiers)
            totals = [sum(n for _, _, n in s) for s in sequences]
            dealt_to, groups = deal(totals, step)
            flat = [np.append(x, np.uint32(END)).astype("<u4") for x in ids]
            rows = []
            for sequence, total, k in zip(sequences, totals, dealt_to, strict=True):
                name, group, offset = base + made, (base >> 10) + dealt + k, 0
                tier = next((t for t in tiers if total <= t), length)
                for d, s, n in sequence:
                    rows.append((docs[d], s, n, zlib.crc32(flat[d][s : s + n]), len(flat[d]), name, offset, total, tier, group))
                    offset += n
                made += 1
            dealt += groups
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            frame["doc_id"] = pd.array(frame["doc_id"].tolist(), dtype="Int64")
            for a in range(0, len(frame), 20_000):
                yield frame.iloc[a : a + 20_000]

        for frame in frames:
            for doc_id, text in zip(frame["doc_id"].astype("Int64"), frame["text"], strict=True):
                ids.append(encode(text or "", path).astype(held_as))
                docs.append(None if doc_id is pd.NA else doc_id)
                held += len(ids[-1]) + 1
                if held >= window:
                    yield from flush()
                    ids, docs, held = [], [], 0
        if docs:
            yield from flush()
        ids, docs = [], []
        tidy()

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, path: str | None = None, length: int = LENGTH, tiers: tuple[int, ...] = TIERS, step: int = STEP, window: int = WINDOW) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, tier, step_group.

    A null or empty text is one END id. A text of any length is packed whole, though it may make its window longer. Rows
    with equal or null ids are packed on their own; other columns are left out, so their names can't clash. An empty table
    gives no pieces. sequence_id is unique and says which task packed it.
    """
    import public_tokenizers

    ready(docs.sparkSession)
    path = path or public_tokenizers.path(f"{VOCABULARY}.json")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInPandas(_pack(path, length, tiers, step, window), SCHEMA)
