"""Encoding and decoding with a public merge-type piece model, with seeded merge-dropout.

A text is cut into pre-tokens (no piece crosses one, see token_counts). Within one, the agenda holds every adjacent pair
of symbols whose concatenation is a piece, best score first, then leftmost. A popped merge that a keyed hash of (seed,
text, place of the pre-token in the text, place in it, piece) puts below the dropout rate is skipped. Characters without a
piece become bytes. With rate 0 the ids are the library's own, but for texts that hold the space mark U+2581 itself: the
library reads it as a space, here it becomes its three bytes. Decoding joins pieces, so every segmentation decodes to the
very text.

Each pre-token of a text draws its own skips. What a worker keeps is a tree of agenda runs: a run is the sequence of
merges that a word pops once a given set of pops is skipped, and its ids. Drawing needs no agenda then, only hashes of the
run's merges; the first that is skipped leads to another run. Runs only save time.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.names import free
from veriloom.llm.shingles import span_hashes
from veriloom.llm.token_counts import MODEL, cut_texts, pre_tokens, processor, spans_of  # noqa: F401
from veriloom.session import ready

SPACE = "▁"
#: What stands for a text's own space marks until they become bytes; no text of Spark holds a lone surrogate.
OWN = "\ud800"
NONE, BIG, PAD = 1 << 40, 1 << 30, -(1 << 30)
PLACE, PIECE = 0x9E3779B1, 0x85EBCA6B
#: Runs that a worker keeps before it starts anew, the longest pre-token (bytes) that has runs, and the pops of a run
#: that can be skipped in one; whatever is beyond these is segmented alone.
CACHE, LONG, POPS = 1_000_000, 64, 63
#: Characters that are split into pre-tokens at once, but for a longer text.
AT_ONCE = 1_000_000


def words_of(text: str) -> list[str]:
    """The pre-tokens of text (see pre_tokens), its own space marks in them as OWN."""
    return pre_tokens(text.replace(SPACE, OWN))


def dropped(key: int, place: int, piece: int, limit: int) -> bool:
    """Whether the keyed hash of a candidate merge lies under the limit (a share of 2**32)."""
    h = (key + place * PLACE + piece * PIECE) & 0xFFFFFFFF
    h = ((h ^ h >> 15) * 0x2C1B3C6D) & 0xFFFFFFFF
    h = ((h ^ h >> 12) * 0x297A2D39) & 0xFFFFFFFF
    return (h ^ h >> 15) < limit


def _hashes(codes: np.ndarray) -> np.ndarray:
    """The hashes of dropped(), of sums of key, place and piece."""
    h = codes
    h = (h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
    h = (h ^ h >> np.uint32(12)) * np.uint32(0x297A2D39)
    return h ^ h >> np.uint32(15)


def mixed(base: np.ndarray | np.uint64, place: np.ndarray) -> np.ndarray:
    x = (place.astype(np.uint64) + base) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(32)).astype(np.uint32)


def keys_of(text: str, n: int, seed: int) -> np.ndarray:
    """The key of each of a text's n pre-tokens, from the seed, the whole text and the pre-token's place."""
    return mixed(np.uint64(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed & (2**64 - 1))), np.arange(n))


class _Rows:
    """Rows of numbers of different lengths, end to end."""

    def __init__(self, kind: type):
        self.flat, self.used = np.zeros(1 << 16, kind), 0
        self.first, self.size, self.rows = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), 0

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(values) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.rows + len(sizes) > len(self.first):
            self.first, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size))
        self.flat[self.used : self.used + len(values)] = values
        self.first[self.rows : self.rows + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.size[self.rows : self.rows + len(sizes)] = sizes
        self.used, self.rows = self.used + len(values), self.rows + len(sizes)

    def joined(self, rows: np.ndarray) -> np.ndarray:
        sizes = self.size[rows].astype(np.int64)
        return self.flat[np.repeat(self.first[rows] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]


class Pieces:
    """Vocabulary, encoder and decoder of one model file."""

    def __init__(self, path: str):
        model = processor(path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        kinds = [(model.is_byte(i), model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)]
        self.names = names
        self.ids = {names[i]: i for i in range(n) if not any(kinds[i])}
        order = sorted(self.ids.values(), key=lambda i: -model.get_score(i))
        #: Pieces with equal scores have equal ranks, so that the leftmost goes first.
        self.rank, last = {}, None
        for k, i in enumerate(order):
            if last is None or model.get_score(i) != model.get_score(order[last]):
                last = k
            self.rank[i] = last
        byte = {names[i]: i for i in range(n) if kinds[i][0]}
        self.bytes = [byte.get(f"<0x{b:02X}>", 0) for b in range(256)]
        raw = {i: bytes([b]) for b, i in enumerate(self.bytes)}
        self.data = [b"" if kinds[i][1] else raw[i] if i in raw else names[i].replace(SPACE, " ").encode("utf-8", "surrogatepass") for i in range(n)]
        self.texts = _Rows(np.uint8)
        self.texts.add(np.frombuffer(b"".join(self.data), np.uint8), np.array([len(x) for x in self.data]))
        self._table()
        self.pairs: dict[int, tuple[int, int]] = {}
        self._forget()

    def _forget(self) -> None:
        """Starts the tree of runs anew. Words by number, with the symbols of their characters; for each run its word, the
        bit set of skipped pops, its pops and its ids; runs by run and skipped pop. Words' runs without skips by the words' hashes."""
        self.root_keys, self.root_runs = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.chars_of, self.pops, self.made = _Rows(np.int32), _Rows(np.uint32), _Rows(np.int32)
        self.words, self.skips = np.zeros(0, np.int32), np.zeros(0, np.uint64)
        self.edges, self.next = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _table(self) -> None:
        """Merges as an open-addressing table for numpy, and the symbol of each character."""
        keys, values = [], []
        for name, piece in self.ids.items():
            for k in range(1, len(name)):
                a, b = self.ids.get(name[:k]), self.ids.get(name[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(piece)
        self.bits = max(16, (8 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, dtype=np.int64)
        self.merged = np.full(1 << self.bits, -1, dtype=np.int32)
        self.probes = 1
        for key, value, at in zip(keys, values, self._slot(np.array(keys, dtype=np.int64)).tolist(), strict=True):
            n = 1
            while self.slots[at] >= 0:
                at, n = (at + 1) & ((1 << self.bits) - 1), n + 1
            self.slots[at], self.merged[at] = key, value
            self.probes = max(self.probes, n)
        self.ranks = np.full(len(self.names) + 1, BIG, dtype=np.int32)
        for piece, rank in self.rank.items():
            self.ranks[piece] = rank
        self.chars = -1 - np.arange(0x110000, dtype=np.int32)
        for name, piece in self.ids.items():
            if len(name) == 1:
                self.chars[ord(name)] = piece
        self.chars[ord(OWN)] = -1 - ord(SPACE)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _merges(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece of each pair of symbols, -1 if none."""
        out = np.full(left.shape, -1, dtype=np.int32)
        ok = np.flatnonzero((left >= 0) & (right >= 0))
        key = left[ok].astype(np.int64) << 32 | right[ok]
        at = self._slot(key)
        for _ in range(self.probes):
            if not len(ok):
                break
            there = self.slots[at]
            hit = there == key
            out[ok[hit]] = self.merged[at[hit]]
            go = ~hit & (there >= 0)
            ok, key, at = ok[go], key[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return out

    def _grow(self, words: np.ndarray, skips: np.ndarray) -> np.ndarray:
        """The numbers of new runs: of each word with the pops of a bit set skipped."""
        sizes = self.chars_of.size[words].astype(np.int64)
        order = np.argsort(sizes, kind="stable")
        number = np.empty(len(words), np.int64)
        number[order] = len(self.words) + np.arange(len(words))
        self.words, self.skips = np.append(self.words, words[order].astype(np.int32)), np.append(self.skips, skips[order])
        for at in range(0, len(order), 8192):
            chosen = order[at : at + 8192]
            n, width = len(chosen), int(sizes[chosen[-1]])
            symbols = np.full((n, width), PAD, dtype=np.int32)
            symbols[np.arange(width) < sizes[chosen][:, None]] = self.chars_of.joined(words[chosen])
            rows, codes = self._run(symbols, skips[chosen])
            by = np.argsort(rows, kind="stable")
            self.pops.add(codes[by], np.bincount(rows, minlength=n))
            live = symbols != PAD
            counts, flat = live.sum(1), symbols[live]
            odd = np.flatnonzero(((symbols < 0) & live).any(1))
            if len(odd):
                first = np.cumsum(counts) - counts
                outs = [self._out(flat[first[i] : first[i] + counts[i]].tolist()) for i in odd.tolist()]
                flat = np.insert(flat[~np.repeat(np.isin(np.arange(n), odd), counts)], np.repeat((np.cumsum(np.where(np.isin(np.arange(n), odd), 0, counts)))[odd], [len(x) for x in outs]), np.array([x for out in outs for x in out], dtype=np.int32))
                counts[odd] = [len(x) for x in outs]
            self.made.add(flat, counts)
        return number

    def _run(self, symbols: np.ndarray, skips: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs the agendas of many words side by side, one pop each a step, and leaves their pieces in symbols; gives
        the pops of each row (rows, codes) in order."""
        n, width = symbols.shape
        after = np.broadcast_to(np.arange(1, width + 1, dtype=np.int32), (n, width)).copy()
        before = np.broadcast_to(np.arange(-1, width - 1, dtype=np.int32), (n, width)).copy()
        piece = np.full((n, width), -1, dtype=np.int32)
        if width > 1:
            piece[:, :-1] = self._merges(symbols[:, :-1].reshape(-1), symbols[:, 1:].reshape(-1)).reshape(n, width - 1)
        rank = self.ranks[piece]
        rows, step, popped, codes = np.arange(n), 0, [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        while len(rows):
            i = rank[rows].argmin(1)
            go = rank[rows, i] < BIG
            rows, i = rows[go], i[go]
            made = piece[rows, i]
            popped.append(rows)
            codes.append(i.astype(np.uint32) * np.uint32(PLACE) + made.astype(np.uint32) * np.uint32(PIECE))
            skip = (skips[rows] >> np.uint64(step) & np.uint64(1)).astype(bool) if step <= POPS else np.zeros(len(rows), bool)
            step += 1
            rank[rows[skip], i[skip]] = BIG
            m, i, made = rows[~skip], i[~skip], made[~skip]
            j = after[m, i]
            k = after[m, j]
            symbols[m, i], symbols[m, j] = made, PAD
            rank[m, j] = BIG
            after[m, i] = k
            inside = k < width
            before[m[inside], k[inside]] = i[inside]
            right = np.full(len(m), PAD, dtype=np.int32)
            right[inside] = symbols[m[inside], k[inside]]
            new = self._merges(made, right)
            piece[m, i], rank[m, i] = new, self.ranks[new]
            p = before[m, i]
            has = p >= 0
            m, p, made = m[has], p[has], made[has]
            new = self._merges(symbols[m, p], made)
            piece[m, p], rank[m, p] = new, self.ranks[new]
        return np.concatenate(popped), np.concatenate(codes)

    def _pair(self, left: int, right: int) -> tuple[int, int]:
        """(rank, id) of the merge of two symbols, rank NONE if there is none."""
        key = left << 32 | right
        got = self.pairs.get(key)
        if got is None:
            piece = self.ids.get(self.names[left] + self.names[right]) if left >= 0 <= right else None
            got = (NONE, -1) if piece is None else (self.rank[piece], piece)
            if len(self.pairs) < CACHE:
                self.pairs[key] = got
        return got

    def segment(self, word: str, key: int, rate: float) -> tuple[int, ...]:
        """Ids of one pre-token, space marks included, by an agenda of its own."""
        limit = int(rate * 2**32)
        pair = self._pair
        symbols = [int(self.chars[ord(c)]) for c in word]
        places = list(range(len(word)))
        found = [pair(a, b) for a, b in zip(symbols, symbols[1:])]
        while found:
            best = min(found)
            if best[0] == NONE:
                break
            i = next(k for k, x in enumerate(found) if x[0] == best[0])
            if limit and dropped(key, places[i], found[i][1], limit):
                found[i] = (NONE, -1)
                continue
            symbols[i] = found[i][1]
            del symbols[i + 1], places[i + 1], found[i]
            if i:
                found[i - 1] = pair(symbols[i - 1], symbols[i])
            if i < len(found):
                found[i] = pair(symbols[i], symbols[i + 1])
        return self._out(symbols)

    def _out(self, symbols: list[int]) -> tuple[int, ...]:
        if min(symbols, default=0) >= 0:
            return tuple(symbols)
        return tuple(x for s in symbols for x in ([s] if s >= 0 else [self.bytes[b] for b in chr(-1 - s).encode("utf-8", "surrogatepass")]))

    def _long(self, word: str, key: int, limit: int) -> tuple[int, ...]:
        """The same with a heap as agenda, for long pre-tokens."""
        symbols: list[int | None] = [int(self.chars[ord(c)]) for c in word]
        after, before = [*range(1, len(word)), -1], [*range(-1, len(word) - 1)]
        agenda: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else -1
            if j >= 0:
                rank, piece = self._pair(symbols[i], symbols[j])
                if rank != NONE:
                    heapq.heappush(agenda, (rank, i, piece, symbols[i], symbols[j]))

        for i in range(len(word) - 1):
            offer(i)
        while agenda:
            _, i, piece, left, right = heapq.heappop(agenda)
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right or limit and dropped(key, i, piece, limit):
                continue
            symbols[i], symbols[j] = piece, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return self._out([s for s in symbols if s is not None])

    def encode(self, text: str | None, seed: int = 0, rate: float = 0.0) -> list[int]:
        """Ids of a whole text; null is empty."""
        return self.encode_many([text], seed, rate)[0].tolist()

    def encode_many(self, texts: list[str | None], seed: int = 0, rate: float = 0.0) -> list[np.ndarray]:
        """Ids of whole texts. Pre-tokens are found and hashed in numpy, about a megabyte at a time; what is equal has equal
        64-bit hashes, and only new ones are looked at as texts."""
        limit = int(rate * 2**32)
        if len(self.words) > CACHE:
            self._forget()
        out: list[list[np.ndarray]] = [[] for _ in texts]
        base = np.array([xxhash.xxh64_intdigest((t or "").encode("utf-8", "surrogatepass"), seed & (2**64 - 1)) for t in texts], dtype=np.uint64)
        done = np.zeros(len(texts), np.int64)
        for who, parts in cut_texts([t and t.replace(SPACE, OWN) for t in texts]):
            raw, starts, ends, part = spans_of(parts)
            owner = np.array(who)[part]
            counts = np.bincount(owner, minlength=len(texts))
            place = np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner] + done[owner]
            done += counts
            keys = mixed(base[owner], place)
            run = self._roots(raw, starts, ends)
            alone = run < 0
            if limit:
                alone |= self._draw(run, keys, limit)
            run[alone] = 0
            sizes = self.made.size[run].astype(np.int64)
            sizes[alone] = 0
            flat = self.made.joined(run[~alone])
            at = np.flatnonzero(alone)
            if len(at):
                data = raw.tobytes()
                own = [self._long(SPACE + data[starts[i] : ends[i]].decode("utf-8", "surrogatepass").replace(" ", SPACE), int(keys[i]), limit) for i in at.tolist()]
                flat = np.insert(flat, np.repeat((np.cumsum(sizes) - sizes)[at], [len(x) for x in own]), np.array([x for ids in own for x in ids], dtype=np.int32))
                sizes[at] = [len(x) for x in own]
            cuts = np.concatenate([[0], np.cumsum(np.bincount(owner, weights=sizes, minlength=len(texts)).astype(np.int64))])
            for k in dict.fromkeys(who):
                out[k].append(flat[cuts[k] : cuts[k + 1]])
        none = np.zeros(0, np.int32)
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else none for x in out]

    def _roots(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The run without skips of each pre-token; -1 for those that have no runs."""
        keys = span_hashes(raw, starts, ends)
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        short = (ends - starts)[first] < LONG
        fresh = np.flatnonzero(short & ~np.isin(distinct, self.root_keys, assume_unique=True))
        if len(fresh):
            data = raw.tobytes()
            new = [data[starts[i] : ends[i]].decode("utf-8", "surrogatepass") for i in first[fresh].tolist()]
            marked = "".join(SPACE + w for w in new).replace(" ", SPACE)
            known = self.chars_of.rows
            self.chars_of.add(self.chars[np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32)], np.array([len(w) + 1 for w in new]))
            runs = self._grow(np.arange(known, known + len(new)), np.zeros(len(new), np.uint64))
            where = np.searchsorted(self.root_keys, distinct[fresh])
            self.root_keys, self.root_runs = np.insert(self.root_keys, where, distinct[fresh]), np.insert(self.root_runs, where, runs)
        at = np.full(len(distinct), -1, np.int64)
        at[short] = self.root_runs[np.searchsorted(self.root_keys, distinct[short])]
        return at[inverse]

    def _draw(self, run: np.ndarray, keys: np.ndarray, limit: int) -> np.ndarray:
        """Takes each pre-token from its word's run without skips to the run that its key draws; tells which need an
        agenda of their own."""
        alone = np.zeros(len(run), bool)
        rest = np.flatnonzero(run >= 0)
        seen = np.zeros(len(rest), np.int64)  # pops that are decided already
        while len(rest):
            hit = np.full(len(rest), -1, np.int64)
            here, first, size = np.arange(len(rest)), self.pops.first[run[rest]], self.pops.size[run[rest]]
            at = seen
            while True:
                go = at < size[here]
                here, at = here[go], at[go]
                if not len(here):
                    break
                skip = _hashes(self.pops.flat[first[here] + at] + keys[rest[here]]).astype(np.uint64) < np.uint64(limit)
                hit[here[skip]] = at[skip]
                here, at = here[~skip], at[~skip] + 1
            some = hit >= 0
            rest, hit = rest[some], hit[some]
            far = hit > POPS
            alone[rest[far]] = True
            rest, hit = rest[~far], hit[~far]
            edges, inverse = np.unique(run[rest] * 64 + hit, return_inverse=True)
            fresh = edges[~np.isin(edges, self.edges, assume_unique=True)]
            if len(fresh):
                grown = self._grow(self.words[fresh >> 6].astype(np.int64), self.skips[fresh >> 6] | np.uint64(1) << (fresh & 63).astype(np.uint64))
                where = np.searchsorted(self.edges, fresh)
                self.edges, self.next = np.insert(self.edges, where, fresh), np.insert(self.next, where, grown)
            if len(rest):
                run[rest] = self.next[np.searchsorted(self.edges, edges)][inverse]
            seen = hit + 1
        return alone

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space that the encoder puts first goes, control ids give nothing."""
        return self.decode_many([np.asarray(ids, dtype=np.int64)])[0]

    def decode_many(self, lists: list[np.ndarray]) -> list[str]:
        """The texts of lists of ids."""
        flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        data = self.texts.joined(flat).tobytes()
        ends = np.concatenate([[0], np.cumsum(self.texts.size[flat].astype(np.int64))])[np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)]
        found = [data[a:z].decode("utf-8", "replace") for a, z in zip(ends.tolist(), ends[1:].tolist())]
        return [t[1:] if t[:1] == " " else t for t in found]


def parts(texts: list[str]) -> Iterator[list[str]]:
    """texts in order, cut so that the memory of a step doesn't grow with the batch."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > AT_ONCE:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


@cache
def pieces(path: str, seed: int, rate: float) -> Pieces:
    """One encoder a worker for each seed and rate, with its own cache."""
    return Pieces(path)


def _path(path: str | None) -> str:
    import public_tokenizers

    return path or public_tokenizers.path(f"{MODEL}.model")


def encode(docs: DataFrame, text_col: str = "text", *, seed: int = 1, rate: float = 0.1, path: str | None = None, out: str = "piece_ids") -> DataFrame:
    """docs with the ids of each whole text as an int array; null and empty texts have none.

    Equal texts get equal ids; another seed gives other segmentations. Columns named like `out` are replaced, others
    and repeated rows stay; an empty table gives an empty one. Very long texts are encoded about a megabyte at a time.
    """
    path = _path(path)
    ready(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = pieces(path, seed, rate)
        for batch in batches:
            yield pd.Series([x for part in parts(batch.tolist()) for x in model.encode_many(part, seed, rate)], dtype=object)

    # not marked deterministic: else Catalyst copies the call into each use of the column, and texts are encoded again for each
    return docs.withColumn(out, ids.asNondeterministic()(F.coalesce(F.col(text_col), F.lit(""))))


def decode(docs: DataFrame, ids_col: str = "piece_ids", *, path: str | None = None, out: str = "decoded") -> DataFrame:
    """docs with the text of each id array; null arrays and arrays without ids give the empty text, an empty table an
    empty one. Columns named like `out` are replaced, others and repeated rows stay."""
    path = _path(path)
    ready(docs.sparkSession)

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = pieces(path, 0, 0.0)
        for batch in batches:
            yield pd.Series(model.decode_many([np.zeros(0, np.int64) if x is None else np.asarray(x, dtype=np.int64) for x in batch]), dtype=object)

    return docs.withColumn(out, texts(F.col(ids_col)))


def round_trip(docs: DataFrame, text_col: str = "text", *, seed: int = 1, rate: float = 0.1, path: str | None = None, out: str = "packed_ids", decoded: str = "decoded") -> DataFrame:
    """docs with the ids of each whole text as little-endian unsigned 32-bit numbers, and the text that those ids give.

    The same ids and texts as encode() and decode(), made in one pass of one worker: ids don't cross to the JVM and back
    to be decoded. Null and empty texts have no ids (no bytes) and decode to the empty text; an empty table gives an
    empty one, very long texts are encoded about a megabyte at a time. Columns named like `out` and `decoded` are
    replaced, others and repeated rows stay.
    """
    path = _path(path)
    ready(docs.sparkSession)

    @F.pandas_udf("ids binary, text string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = pieces(path, seed, rate)
        for batch in batches:
            ids, texts = [], []
            for part in parts(batch.tolist()):
                ids += [x.astype("<u4").tobytes() for x in model.encode_many(part, seed, rate)]
                texts += model.decode_many([np.frombuffer(x, dtype="<u4").astype(np.int64) for x in ids[len(texts) :]])
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "text": pd.Series(texts, dtype=object)})

    (name,) = free(docs, "both")
    done = docs.withColumn(name, both.asNondeterministic()(F.coalesce(F.col(text_col), F.lit(""))))
    return done.withColumns({out: F.col(f"{name}.ids"), decoded: F.col(f"{name}.text")}).drop(name)
