"""N-gram Jaccard join by a token-group matrix.

Similar documents are put into groups, each group's token union is stored, the overlap of a query with a union bounds
its overlap with every member, and only groups that reach the bound are opened. Tokens are hashed shingles.

1. One pass over the texts gives each document's shingle set, as a digest, and the smallest hashes of the set. Documents
   with equal sets form a class. A pair with Jaccard >= t overlaps in t * n tokens at least, so the two share at least k
   of their first n - ceil(t * n) + k hashes: documents with fewer such hashes in common with any other text leave. Each
   batch sends a hash once, however many of its texts hold it, so that common hashes don't gather in one task.
2. Classes that stay are fetched and grouped by a min-hash, in sub-groups of bounded members and tokens. The linked parts
   of a sub-group are the groups of the matrix: their members and token unions are written to a table. Groups of which
   representatives meet under a second min-hash, and link, get one owner. Both steps only save work in the next ones.
3. Matrix, as blocks of groups with their owners. A first bound takes all unions of other owners as one: each block sends
   a token once, learns whether another owner has it, and members with fewer than t * n such tokens leave, for no union
   can hold more of them. Groups without members leave.
4. What is left of groups is put together by a min-hash over those tokens: similar groups, of several owners, whose links
   are found and whose token unions are stored anew.
5. Second bound, group by group. A pair overlaps in at least t / (1 + t) * (n + m) tokens, all of which two owners have,
   so a query meets a group only if they share one of the first tokens of their members, most common ones last, within
   a band of sizes. A query qualifies if its overlap with the group's union reaches the bound for the group's smallest
   member; only then the group is opened, and its members of other owners are compared one by one.

Every link between two groups of different owners passes both bounds, so components are exact (up to collisions of 64-bit
hashes). Nothing emits pairs of documents, and nothing gathers a key's documents in one task: sub-groups and blocks have
bounded tokens, buckets are slices of the hash space whose number follows the counted tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.llm.names import free
from veriloom.llm.shingles import WIDTH, mix, shingle_sets
from veriloom.session import ready, staged, tidy, unstage

#: Linked if 100 * intersection >= 75 * union.
THRESHOLD = Fraction(75, 100)
#: Members and tokens of a sub-group; representatives of a group in the second round. (A longer set is a sub-group alone.)
GROUP, GROUP_TOKENS, REPRESENTATIVES = 256, 300_000, 4
#: Documents and hashes of a batch of the first pass, tokens of a block of the matrix, hashes of a bucket (about).
BATCH_DOCS, BATCH_TOKENS, BLOCK_TOKENS, BUCKET_TOKENS = 60_000, 500_000, 60_000, 300_000
#: Share of a set that is sent beyond the least prefix.
EXTRA = Fraction(15, 100)
#: Bits of the bitmap of text keys (a multiple of 32,768), entries and least count of the list of very common tokens: bounds of what is broadcast.
BITS, COMMON, COMMON_LEAST = 1 << 24, 65_536, 64
#: Ratio of the sizes within a band.
BAND = Fraction(106, 100)

_FIRST = "kind int, batch long, idx int, doc_id long, text_key long, n long, digest string, bucket int, block binary, counts binary"
_SETS = "digest string, n long, h long, tokens binary"
_GROUPS = "gid string, digests array<string>, sizes array<int>, tokens binary, places binary"
_BLOCKS = "block long, gids array<string>, owners array<string>, members array<int>, sizes array<int>, unions array<int>, tokens binary, places binary"
_LIVE = "h long, gid string, owner string, members int, n long, sizes array<int>, lengths array<int>, tokens binary, places binary"
_MET = "gid string, owner string, owners array<string>, sizes array<int>, lengths array<int>, tokens binary, places binary, was array<string>"
_SEEDS = (np.uint64(0x51ED270B), np.uint64(0x2545F491), np.uint64(0x7F4A7C15))
_IN_BATCH, _MANY = np.uint16(0xFFFF), np.uint64(0)


def _least(n: np.ndarray | int, t: Fraction) -> np.ndarray | int:
    """ceil(t * n): the least overlap of a set of n with any partner."""
    return -(-n * t.numerator // t.denominator)


def _pair(both: np.ndarray | int, t: Fraction) -> np.ndarray | int:
    """The least overlap of two linked sets whose sizes add up to both."""
    return -(-both * t.numerator // (t.numerator + t.denominator))


def _prefix(n: int, t: Fraction) -> int:
    return n - _least(n, t) + max(1, n * EXTRA.numerator // EXTRA.denominator) if n else 0


def _needed(n: int, t: Fraction) -> int:
    """The least count of shared prefix hashes: a partner has t * n shingles at least."""
    return max(1, _least(n, t) * EXTRA.numerator // EXTRA.denominator)


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)


def _in_buckets(tokens: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts tokens by bucket, and each bucket's place in it."""
    bucket = (tokens % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _short(tokens: np.ndarray) -> np.ndarray:
    """32 bits of a token; within a bucket others may have the same, which adds overlap but never loses any."""
    return (tokens >> np.uint64(24)).astype(np.uint32)


def _first_pass(width: int, t: Fraction, buckets: int):
    """kind 0: a row for each document. kind 1: for each batch and bucket, hashes with the one document of the batch that
    has them, or _IN_BATCH for several. kind 2: for each batch, how many hashes its documents share within the batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        rows: list[tuple] = []
        kept: dict[str, int] = {}
        sets: list[np.ndarray] = []

        def flush() -> Iterator[pd.DataFrame]:
            batch = (part << 24) | seq
            out = [(0, batch, i, d, key, n, digest, None, None, None) for i, d, key, n, digest in rows]
            if sets:
                tok, idx = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
                order = np.argsort(tok, kind="stable")
                tok, idx = tok[order], idx[order]
                same = tok[1:] == tok[:-1]
                first = np.concatenate([[True], ~same])
                several = ~first | np.concatenate([same, [False]])
                found, count = np.unique(idx[several], return_counts=True)
                if len(found):
                    out.append((2, batch, None, None, None, None, None, None, found.tobytes(), count.astype(np.uint32).tobytes()))
                tok, idx = tok[first], np.where(several, _IN_BATCH, idx)[first]
                order, cuts = _in_buckets(tok, buckets)
                short, idx = _short(tok)[order], idx[order]
                for b in np.flatnonzero(np.diff(cuts)):
                    a, z = cuts[b], cuts[b + 1]
                    out.append((1, batch, None, None, None, None, None, int(b), short[a:z].tobytes() + idx[a:z].tobytes(), None))
            for a in range(0, len(out), 2000):
                frame = pd.DataFrame(out[a : a + 2000], columns=[c.split()[0] for c in _FIRST.split(", ")], dtype=object)
                for c in ("idx", "doc_id", "text_key", "n", "bucket"):
                    frame[c] = frame[c].astype("Int64")
                yield frame

        held = 0
        for frame in frames:
            for doc_id, key, s in zip(frame["doc_id"].astype("Int64"), frame["text_key"], shingle_sets(frame["text"].tolist(), width), strict=True):
                digest = xxhash.xxh3_128_hexdigest(s.tobytes())
                i = kept.get(digest)
                if i is None and len(s):
                    i = kept[digest] = len(sets)
                    sets.append(s[: _prefix(len(s), t)].copy())
                    held += len(sets[-1])
                rows.append((i, None if doc_id is pd.NA else doc_id, key, len(s), digest))
                if len(rows) >= BATCH_DOCS or held >= BATCH_TOKENS:
                    yield from flush()
                    seq, held = seq + 1, 0
                    rows, kept, sets = [], {}, []
        if rows:
            yield from flush()
        rows, kept, sets = [], {}, []
        tidy()

    return run


def _shared_in_bucket(frame: pd.DataFrame) -> pd.DataFrame:
    """For each batch, how many of its documents' own hashes in this bucket another batch has as well."""
    tokens, idx, sizes = [], [], []
    for block in frame["block"]:
        n = len(block) // 6
        tokens.append(np.frombuffer(block, np.uint32, n))
        idx.append(np.frombuffer(block, np.uint16, n, 4 * n))
        sizes.append(n)
    every = np.concatenate(tokens)
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    same = ranked[1:] == ranked[:-1]
    shared = np.zeros(len(every), dtype=bool)
    shared[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    out, at = [], 0
    for batch, i, n in zip(frame["batch"], idx, sizes, strict=True):
        found, count = np.unique(i[shared[at : at + n] & (i != _IN_BATCH)], return_counts=True)
        at += n
        if len(found):
            out.append((batch, found.tobytes(), count.astype(np.uint32).tobytes()))
    return pd.DataFrame(out, columns=["batch", "block", "counts"], dtype=object)


def _sum_in_batch(frame: pd.DataFrame) -> pd.DataFrame:
    """Counts of a batch's documents over all buckets."""
    idx = np.concatenate([np.frombuffer(x, np.uint16) for x in frame["block"]])
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in frame["counts"]])
    total = np.bincount(idx, weights=counts)
    hit = np.flatnonzero(total)
    return pd.DataFrame({"batch": np.full(len(hit), frame["batch"].iloc[0]), "idx": hit.astype(np.int32), "shared": total[hit].astype(np.int64)})


def _in_bitmap(bitmap):
    """Rows whose text key has its bit set."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = bitmap.value
        for frame in frames:
            at = frame["text_key"].to_numpy(np.int64) & (BITS - 1)
            yield frame[(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)]

    return run


def _sets_pass(width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sets = [s for s in shingle_sets(frame["text"].tolist(), width) if len(s)]
            yield pd.DataFrame([(xxhash.xxh3_128_hexdigest(s.tobytes()), len(s), _min_hash(s, 0), s.tobytes()) for s in sets], columns=["digest", "n", "h", "tokens"], dtype=object).astype({"n": "int64", "h": "int64"})
        tidy()

    return run


def _min_hash(s: np.ndarray, k: int) -> int:
    return int(mix(s ^ _SEEDS[k]).min().view(np.int64))


def _runs(frames: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
    """Rows of each run of equal first two columns, of a partition that is sorted by them; repeated third columns go."""
    held: list[tuple] = []
    for frame in frames:
        for row in frame.itertuples(index=False, name=None):
            if held and row[:2] != held[-1][:2]:
                yield held
                held = []
            if not held or row[2] != held[-1][2]:
                held.append(row)
    if held:
        yield held


def _frames(rows: Iterator[tuple], schema: str) -> Iterator[pd.DataFrame]:
    """Frames of at most a thousand rows or about 4 MB."""
    names, held, size = [c.split()[0] for c in schema.split(", ")], [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if len(held) == 1000 or size > 4 << 20:
            yield pd.DataFrame(held, columns=names, dtype=object)
            held, size = [], 0
    yield pd.DataFrame(held, columns=names, dtype=object)
    held = []
    tidy()


class _Union(dict):
    def find(self, x):
        root = x
        while self.setdefault(root, root) != root:
            root = self[root]
        while self[x] != root:
            self[x], x = root, self[x]
        return root

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self[max(a, b)] = min(a, b)
        return a != b


def _overlaps(query: np.ndarray, ids: np.ndarray, starts: np.ndarray, mask: np.ndarray) -> np.ndarray:
    mask[query] = True
    out = np.add.reduceat(mask[ids], starts, dtype=np.int64)
    mask[query] = False
    return out


def _linked(inter: np.ndarray, n: int, sizes: np.ndarray, t: Fraction) -> np.ndarray:
    return t.denominator * inter >= t.numerator * (n + sizes - inter)


def _parts(sets: list[np.ndarray], t: Fraction) -> list[list[int]]:
    """The linked parts of a few sets, exactly."""
    if len(sets) == 1:
        return [[0]]
    sizes = np.array([len(x) for x in sets])
    starts = _starts(sizes)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mask, union, left = np.zeros(ids.max() + 1, dtype=bool), _Union(), len(sets) - 1
    for i in range(len(sets)):
        if not left:
            break
        own = ids[starts[i] : starts[i] + sizes[i]]
        for j in np.flatnonzero(_linked(_overlaps(own, ids, starts, mask), sizes[i], sizes, t)):
            left -= union.join(i, int(j))
    out: dict[int, list[int]] = {}
    for i in range(len(sets)):
        out.setdefault(union.find(i), []).append(i)
    return list(out.values())


def _groups(t: Fraction):
    """The groups of each sub-group (h, s, digest, tokens): members, token union, and members as places in the union
    (none for a single member, whose union is its set)."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for run in _runs(frames):
            sets = [np.frombuffer(r[3], np.uint64) for r in run]
            for part in _parts(sets, t):
                own = [sets[i] for i in part]
                union, places = (own[0], np.zeros(0)) if len(part) == 1 else np.unique(np.concatenate(own), return_inverse=True)
                digests = [run[i][2] for i in part]
                yield min(digests), digests, [len(s) for s in own], union.tobytes(), places.astype(np.uint32).tobytes()

    return lambda frames: _frames(rows(frames), _GROUPS)


def _representatives(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(gid, n, h, tokens) of a few members of each group; digests are hashes, so the first ones are as good as any."""

    def rows() -> Iterator[tuple]:
        for frame in frames:
            for gid, sizes, tokens, places in zip(frame["gid"], frame["sizes"], frame["tokens"], frame["places"], strict=True):
                union, at = np.frombuffer(tokens, np.uint64), np.frombuffer(places, np.uint32)
                starts = _starts(sizes)
                for k in range(min(len(sizes), REPRESENTATIVES)):
                    s = union[at[starts[k] : starts[k] + sizes[k]]] if len(sizes) > 1 else union
                    yield gid, len(s), _min_hash(s, 1), s.tobytes()

    return _frames(rows(), "gid string, n long, h long, tokens binary")


def _links(t: Fraction):
    """Links between the groups of a sub-group (h, s, gid, tokens), as a star around the smallest of each part."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for run in _runs(frames):
            for part in _parts([np.frombuffer(r[3], np.uint64) for r in run], t) if len(run) > 1 else ():
                names = sorted({run[i][2] for i in part})
                yield from ((names[0], x) for x in names[1:])

    return lambda frames: _frames(rows(frames), "a string, b string")


def _blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of groups with about BLOCK_TOKENS tokens."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId() << 32

    def rows() -> Iterator[tuple]:
        seq, held, size = 0, [], 0
        for frame in frames:
            for row in frame.itertuples(index=False, name=None):
                held.append(row)
                size += len(row[3]) // 8
                if size >= BLOCK_TOKENS:
                    yield block(seq, held)
                    seq, held, size = seq + 1, [], 0
        if held:
            yield block(seq, held)

    def block(seq: int, held: list[tuple]) -> tuple:
        gids, owners, sizes, tokens, places = zip(*held, strict=True)
        return part | seq, list(gids), list(owners), [len(x) for x in sizes], [int(n) for x in sizes for n in x], [len(x) // 8 for x in tokens], b"".join(tokens), b"".join(places)

    return _frames(rows(), _BLOCKS)


def _columns(tokens: bytes, unions: list[int], owners: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct tokens, who of its owners has each (_MANY for several), and each union token's place among them."""
    every = np.frombuffer(tokens, np.uint64)
    own = np.repeat(np.array([xxhash.xxh3_64_intdigest(o) or 1 for o in owners], np.uint64), unions)
    distinct, inverse = np.unique(every, return_inverse=True)
    who = np.zeros(len(distinct), np.uint64)
    who[inverse] = own
    who[inverse[who[inverse] != own]] = _MANY
    return distinct, who, inverse


def _post(buckets: int):
    """(bucket, block, tokens and who has them) of each block."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for frame in frames:
            for block, owners, unions, tokens in zip(frame["block"], frame["owners"], frame["unions"], frame["tokens"], strict=True):
                distinct, who, _ = _columns(tokens, unions, owners)
                order, cuts = _in_buckets(distinct, buckets)
                short, who = _short(distinct)[order], who[order]
                for b in np.flatnonzero(np.diff(cuts)):
                    a, z = cuts[b], cuts[b + 1]
                    yield int(b), block, short[a:z].tobytes() + who[a:z].tobytes()

    return lambda frames: _frames(rows(frames), "bucket int, block long, entries binary")


def _foreign_in_bucket(frame: pd.DataFrame) -> pd.DataFrame:
    """For each block, which of its tokens in this bucket have two owners or more; in a row of block -1 the tokens that
    many blocks have, and how many."""
    sizes = [len(x) // 12 for x in frame["entries"]]
    tok = np.concatenate([np.frombuffer(x, np.uint32, n) for x, n in zip(frame["entries"], sizes, strict=True)])
    who = np.concatenate([np.frombuffer(x, np.uint64, n, 4 * n) for x, n in zip(frame["entries"], sizes, strict=True)])
    order = np.argsort(tok, kind="stable")
    first = np.concatenate([[True], tok[order][1:] != tok[order][:-1]])
    start, run = np.flatnonzero(first), np.cumsum(first) - 1
    ranked = who[order]
    foreign = np.logical_or.reduceat((ranked != ranked[start][run]) | (ranked == _MANY), start)
    flags = np.empty(len(tok), dtype=bool)
    flags[order] = foreign[run]
    ends, bucket = np.cumsum(sizes), int(frame["bucket"].iloc[0])
    out = [(int(b), bucket, np.packbits(flags[z - n : z]).tobytes(), None) for b, n, z in zip(frame["block"], sizes, ends, strict=True) if flags[z - n : z].any()]
    count = np.diff(np.append(start, len(tok)))
    hot = count >= COMMON_LEAST
    if hot.any():
        out.append((-1, bucket, (np.uint64(bucket) << np.uint64(32) | tok[order][start][hot].astype(np.uint64)).tobytes(), count[hot].astype(np.int64).tobytes()))
    return pd.DataFrame(out, columns=["block", "bucket", "flags", "counts"], dtype=object)


def _common(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for flags, counts in zip(frame["flags"], frame["counts"], strict=True):
            yield pd.DataFrame({"token": np.frombuffer(flags, np.int64), "n": np.frombuffer(counts, np.int64)})


def _rank(tokens: np.ndarray, buckets: int, often: np.ndarray) -> np.ndarray:
    """The order of tokens in which very common ones come last."""
    return np.lexsort((tokens, np.isin((tokens % np.uint64(buckets)) << np.uint64(32) | _short(tokens).astype(np.uint64), often)))


def _live(t: Fraction, buckets: int, common):
    """Groups of a block with the members that have t * n tokens of other owners, and only such tokens, the most common
    last."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        often = common.value
        for frame in frames:
            for r in frame.itertuples(index=False):
                distinct, _, inverse = _columns(r.tokens, r.unions, r.owners)
                order, cuts = _in_buckets(distinct, buckets)
                foreign = np.zeros(len(distinct), dtype=bool)
                for x in r.told:
                    a, z = cuts[x["bucket"]], cuts[x["bucket"] + 1]
                    foreign[order[a:z]] = np.unpackbits(np.frombuffer(x["flags"], np.uint8), count=z - a)
                places, sizes = np.frombuffer(r.places, np.uint32), np.array(r.sizes)
                at = member = place = 0
                for gid, owner, n, u in zip(r.gids, r.owners, r.members, r.unions, strict=True):
                    mask, own = foreign[inverse[at : at + u]], sizes[member : member + n]
                    held = places[place : place + own.sum()] if n > 1 else np.arange(u)
                    counts = np.add.reduceat(mask[held], _starts(own), dtype=np.int64)
                    stay = np.flatnonzero(counts >= _least(own, t))
                    if len(stay):
                        keep = held[np.repeat(counts >= _least(own, t), own) & mask[held]]
                        used = np.unique(keep)
                        tokens = distinct[inverse[at : at + u][used]]
                        rank = _rank(tokens, buckets, often)
                        where = np.empty(u, dtype=np.uint32)
                        where[used[rank]] = np.arange(len(used))
                        parts = [np.sort(x) for x in np.split(where[keep], np.cumsum(counts[stay])[:-1])]
                        yield _min_hash(tokens, 2), gid, owner, len(stay), len(keep), own[stay].tolist(), counts[stay].tolist(), tokens[rank].tobytes(), np.concatenate(parts).astype(np.uint32).tobytes()
                    at, member, place = at + u, member + n, place + (own.sum() if n > 1 else 0)

    return lambda frames: _frames(rows(frames), _LIVE)


def _together(t: Fraction, buckets: int, common):
    """What is left of the groups of each sub-group (h, s, gid, owner, sizes, lengths, tokens, places) as one group, its
    members with the owner that they have once the links among them are known, and with the one they had."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for run in _runs(frames):
            tokens, ids = np.unique(np.concatenate([np.frombuffer(r[6], np.uint64) for r in run]), return_inverse=True)
            rank = _rank(tokens, buckets, common.value)
            where = np.empty(len(tokens), dtype=np.uint32)
            where[rank] = np.arange(len(tokens))
            begins = _starts([len(r[6]) // 8 for r in run])
            lengths = np.concatenate([r[5] for r in run])
            sizes = np.concatenate([r[4] for r in run])
            places = np.concatenate([where[ids[a:]][np.frombuffer(r[7], np.uint32)] for a, r in zip(begins, run, strict=True)])
            starts = _starts(lengths)
            places = np.concatenate([np.sort(x) for x in np.split(places, starts[1:])])
            was = [r[3] for r in run for _ in r[4]]
            union, mask = _Union(), np.zeros(len(tokens), dtype=bool)
            left = len(set(was)) - 1
            for q in range(len(sizes)):
                if left <= 0:
                    break
                for j in np.flatnonzero(_linked(_overlaps(places[starts[q] : starts[q] + lengths[q]], places, starts, mask), sizes[q], sizes, t)):
                    left -= union.join(was[q], was[j])
            owners = [union.find(x) for x in was]
            yield min(r[2] for r in run), owners[0] if len(set(owners)) == 1 else None, owners, sizes.tolist(), lengths.tolist(), tokens[rank].tobytes(), places.astype(np.uint32).tobytes(), was

    return lambda frames: _frames(rows(frames), _MET)


@cache
def bands(most: int) -> np.ndarray:
    """The smallest size of each band, up to that of most."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, -(-out[-1] * BAND.numerator // BAND.denominator)))
    return np.array(out)


def _postings(t: Fraction, probe: bool):
    """(band, token, gid, owner): the tokens under which a group is found, or under which its members look for groups
    with members of a band that aren't larger than they."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                places, found, at = np.frombuffer(r.places, np.uint32), {}, 0
                start = bands(1 << int(max(r.sizes)).bit_length())
                for n, f in zip(map(int, r.sizes), map(int, r.lengths), strict=True):
                    last = int(np.searchsorted(start, n, "right")) - 1
                    low = _least(n, t)
                    for b in range(int(np.searchsorted(start, low, "right")) - 1, last + 1) if probe else (last,):
                        k = f - _pair(n + (max(low, int(start[b])) if probe else n), t) + 1
                        if k > 0:
                            found.setdefault(b, []).append(places[at : at + k])
                    at += f
                tokens = np.frombuffer(r.tokens, np.int64)
                for b, parts in found.items():
                    token = tokens[np.unique(np.concatenate(parts))]
                    yield pd.DataFrame({"band": np.full(len(token), b, np.int32), "token": token, "gid": r.gid, "owner": pd.Series([r.owner] * len(token), dtype=object)})

    return rows


def _open(t: Fraction):
    """Links between owners of two groups: the second is opened for the queries of the first whose overlap with its token
    union reaches the bound, until all their owners are linked."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                qn, mn, ql, ml = (np.array(x) for x in (r.sizes_x, r.sizes_y, r.lengths_x, r.lengths_y))
                xt, yt = np.frombuffer(r.tokens_x, np.uint64), np.frombuffer(r.tokens_y, np.uint64)
                both, ids = np.unique(np.concatenate([xt, yt]), return_inverse=True)
                qi, mi = ids[: len(xt)][np.frombuffer(r.places_x, np.uint32)], ids[len(xt) :][np.frombuffer(r.places_y, np.uint32)]
                qa, ma, mask = _starts(ql), _starts(ml), np.zeros(len(both), dtype=bool)
                union, left = _Union(), len({*r.owners_x, *r.owners_y}) - 1
                bound = _overlaps(ids[len(xt) :], qi, qa, mask)
                for q in np.flatnonzero(bound >= np.maximum(_least(qn, t), _pair(qn + mn.min(), t))):
                    if left <= 0:
                        break
                    own = r.owners_x[q]
                    for j in np.flatnonzero(_linked(_overlaps(qi[qa[q] : qa[q] + ql[q]], mi, ma, mask), qn[q], mn, t)):
                        if union.join(own, r.owners_y[j]):
                            left -= 1
                            yield own, r.owners_y[j]

    return lambda frames: _frames(rows(frames), "a string, b string")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> tuple[DataFrame, list[str]]:
    """(node, root) for every node of edges, root being the smallest node that it is connected with.

    Each round takes every label to its smallest neighbour and contracts the edges, together with the steps taken;
    labels fall until no edge joins two of them. Rounds are staged tables, so their lineage stays short.
    """
    spark, paths = edges.sparkSession, []

    def keep(df: DataFrame) -> DataFrame:
        out, path = staged(df, "components")
        paths.append(path)
        return out

    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    live = keep(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = live.select(F.col("u").alias("node")).distinct().withColumn("root", F.col("node"))
    while not live.isEmpty():
        least = keep(live.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        labels = keep(labels.join(least, F.col("root") == F.col("u"), "left").select("node", F.coalesce("m", "root").alias("root")))
        steps = live.unionByName(least.select("u", F.col("m").alias("v")))
        to = least.select(F.col("u").alias("v"), F.col("m").alias("mv"))
        moved = steps.join(least, "u").join(to, "v").select(F.col("m").alias("u"), F.col("mv").alias("v")).where("u <> v")
        live = keep(moved.unionByName(moved.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    return labels, paths


def text_key(text: str | Column) -> Column:
    return F.xxhash64(text)


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = WIDTH, threshold: Fraction = THRESHOLD, buckets: int | None = None
) -> DataFrame:
    """(doc_id, text_key, n_shingles, class_id, component_id), one row for each row of docs.

    class_id names the set (rows with equal sets have equal ids), component_id is the smallest id reachable by links.
    Null and empty texts, and texts of white space, have n_shingles 0 and link with nothing: component_id is their own
    id. A null id takes part like any other; component_id is then the smallest non-null id of its component, or null.
    Texts of any length are taken whole. Repeated rows give repeated rows. Other columns of docs are left out, so their
    names can't clash. An empty table gives an empty result.

    The result reads two tables in the shared folder (a row for each document, and one for each class); the others that
    the operator writes there are deleted before it returns.
    """
    spark = ready(docs.sparkSession)
    t = threshold
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    paths: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out, path = staged(df, name)
        paths.append(path)
        return out

    def sized(tokens: int) -> int:
        return buckets or max(16, -(-tokens // BUCKET_TOKENS))

    # 1: documents that share enough prefix hashes with others
    text_bytes = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    at_first = sized(text_bytes // 6 * 2 // 5)
    first, at = staged(source.mapInPandas(_first_pass(width, t, at_first), _FIRST), "shingles", by="kind")
    rows = first.where("kind = 0").select("batch", "idx", "doc_id", "text_key", "n", "digest")
    others = first.where("kind = 1").select("bucket", "batch", "block").groupBy("bucket").applyInPandas(_shared_in_bucket, "batch long, block binary, counts binary")
    shared = others.unionByName(first.where("kind = 2").select("batch", "block", "counts")).groupBy("batch").applyInPandas(_sum_in_batch, "batch long, idx int, shared long")
    least = f"((n * {t.numerator} + {t.denominator - 1}) div {t.denominator})"
    needed = f"greatest(1, ({least} * {EXTRA.numerator}) div {EXTRA.denominator})"
    near = keep(rows.join(shared, ["batch", "idx"]).where(f"shared >= {needed}").groupBy("digest").agg(F.min(F.struct("doc_id", "text_key")).alias("pick")).select("pick.*"), "near")
    unstage(spark, f"{at}/kind=1", f"{at}/kind=2")
    filled = near.groupBy(F.expr(f"(text_key & {BITS - 1}) div 32768").alias("part")).agg(F.bitmap_construct_agg(F.expr("text_key & 32767")).alias("bits")).collect()  # BITS / 32768 rows at most
    bitmap = np.zeros((BITS // 32768, 4096), dtype=np.uint8)
    for r in filled:
        bitmap[r.part] = np.frombuffer(r.bits, np.uint8)
    key = [F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("doc_id").isNull().alias("z"), "text_key"]
    likely = source.mapInPandas(_in_bitmap(spark.sparkContext.broadcast(bitmap.reshape(-1))), source.schema).select(*key, "text")
    fetched = likely.join(near.select(*key), ["d", "z", "text_key"], "left_semi").dropDuplicates(["d", "z", "text_key"]).select("text")
    sets = keep(fetched.mapInPandas(_sets_pass(width), _SETS), "sets")

    # 2: groups with their unions, and owners of groups
    def spread(of: DataFrame, name: str, salt: int, *more: str, members: str = "1") -> DataFrame:
        """(h, s, name, more), dealt and sorted by sub-groups; the table of large ones is broadcast only if Spark finds it small."""
        size = F.ceil(F.greatest(F.sum(F.expr(members)) / GROUP, F.sum("n") / GROUP_TOKENS))
        big = keep(of.groupBy("h").agg(size.alias("k")).where("k > 1").withColumnRenamed("h", "_h"), "large")
        salted = of.join(big, F.col("h") == F.col("_h"), "left").withColumn("s", F.pmod(F.xxhash64(name, F.lit(salt)), F.coalesce("k", F.lit(1))))
        return salted.select("h", "s", name, *more).repartition("h", "s").sortWithinPartitions("h", "s", name)

    groups = keep(spread(sets, "digest", 0, "tokens").mapInPandas(_groups(t), _GROUPS), "groups")
    some = keep(groups.select("gid", "sizes", "tokens", "places").mapInPandas(_representatives, "gid string, n long, h long, tokens binary"), "representatives")
    edges = keep(spread(some, "gid", 1, "tokens").mapInPandas(_links(t), "a string, b string"), "links")
    owners, more = components(edges)
    paths += more

    # 3: the matrix, and members with enough tokens of other owners
    owned = groups.join(owners, groups["gid"] == owners["node"], "left").select("gid", F.coalesce("root", "gid").alias("owner"), "sizes", "tokens", "places")
    matrix = keep(owned.mapInPandas(_blocks, _BLOCKS), "matrix")
    in_matrix = sized(matrix.agg(F.sum(F.expr("aggregate(unions, 0L, (a, x) -> a + x)"))).first()[0] or 0)
    told = keep(matrix.select("block", "owners", "unions", "tokens").mapInPandas(_post(in_matrix), "bucket int, block long, entries binary").groupBy("bucket").applyInPandas(_foreign_in_bucket, "block long, bucket int, flags binary, counts binary"), "told")
    often = told.where("block = -1").select("flags", "counts").mapInPandas(_common, "token long, n long").orderBy(F.desc("n"), "token").limit(COMMON).collect()
    common = spark.sparkContext.broadcast(np.array([r.token for r in often], dtype=np.int64).view(np.uint64))
    flagged = told.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("bucket", "flags")).alias("told"))
    live = keep(matrix.join(flagged, "block").mapInPandas(_live(t, in_matrix, common), _LIVE), "live")

    # 4 and 5: similar groups together, cells of the matrix that aren't empty, and groups that are opened
    met = keep(spread(live, "gid", 2, "owner", "sizes", "lengths", "tokens", "places", members="members").mapInPandas(_together(t, in_matrix, common), _MET), "met")
    merged = met.select(F.explode(F.arrays_zip("was", "owners")).alias("o")).select(F.col("o.was").alias("a"), F.col("o.owners").alias("b")).where("a <> b").distinct()
    listed, asked = (met.select("gid", "owner", "sizes", "lengths", "tokens", "places").mapInPandas(_postings(t, probe), "band int, token long, gid string, owner string") for probe in (False, True))
    pairs = listed.alias("l").join(asked.alias("a"), (F.col("l.band") == F.col("a.band")) & (F.col("l.token") == F.col("a.token")) & (F.col("l.gid") != F.col("a.gid")) & F.coalesce(F.col("l.owner") != F.col("a.owner"), F.lit(True)))
    cells = pairs.select(F.least("l.gid", "a.gid").alias("x"), F.greatest("l.gid", "a.gid").alias("y")).distinct()
    sides = [met.select(F.col("gid").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("owners", "sizes", "lengths", "tokens", "places")]) for s in "xy"]
    opened = cells.join(sides[0], "x").join(sides[1], "y").mapInPandas(_open(t), "a string, b string").unionByName(merged)
    roots, more = components(keep(edges.unionByName(opened), "links"))
    paths += more

    ids = rows.groupBy("digest").agg(F.min("doc_id").alias("least_id"))
    member = groups.select("gid", F.explode("digests").alias("digest")).join(roots, F.col("gid") == F.col("node"), "left").select("digest", F.coalesce("root", "gid").alias("root"))
    joined = keep(ids.join(member, "digest", "left").select("digest", "least_id", F.coalesce("root", "digest").alias("root")), "members")
    named = keep(joined.groupBy("root").agg(F.min("least_id").alias("component_id")), "components")  # a table of its own, so that a large component's part of the join can be split
    classes, _ = staged(joined.join(named, "root").select(F.col("digest").alias("class_id"), "component_id"), "classes")
    unstage(spark, *paths)
    return rows.join(classes, rows["digest"] == classes["class_id"]).select(
        "doc_id", "text_key", F.col("n").alias("n_shingles"), "class_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs with one row of each component: the one with its smallest id; columns as before, whatever their
    names.

    Rows without shingles are kept. Of repeated rows with the same id and text one stays. Null ids come last.
    """
    parts = jaccard_components(docs, id_col, text_col, **options)
    i, null, key = free(docs, "id", "null", "key")
    named = [F.coalesce("doc_id", F.lit(0)).alias(i), F.col("doc_id").isNull().alias(null), F.col("text_key").alias(key)]
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_key")
    full = parts.where("n_shingles > 0").withColumn("group", F.coalesce(F.col("component_id").cast("string"), "class_id"))
    pick = full.groupBy("group").agg(F.min(order).alias("p")).select("p.doc_id", "p.text_key").select(*named)
    empty = parts.where("n_shingles = 0").select(*named)
    keyed = docs.withColumns({i: F.coalesce(F.col(id_col).cast("long"), F.lit(0)), null: F.col(id_col).cast("long").isNull(), key: text_key(F.col(text_col))})
    return keyed.join(pick.unionByName(empty).distinct(), [i, null, key], "left_semi").dropDuplicates([i, null, key]).select(*docs.columns)
