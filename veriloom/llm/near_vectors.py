"""Near duplicates among embeddings: cross-polytope hashing after fast Hadamard rotations, with multiprobe buckets.

Two vectors link if their labels are equal and their cosine is COSINE or more. A table of the index applies a few
rotations (signs and Hadamard transforms, three times) to a vector; each names the nearest of the 2 * dimension signed
axes, and the names together are the bucket. A query also looks into the next nearest buckets. The number of names follows
the count of vectors, so that buckets stay small; the number of tables follows from the share of pairs at the threshold
that one table finds (measured on PAIRS random pairs), so that all tables together miss at most MISS of them.

1. Vectors that are equal in every component form a class, by partial aggregation.
2. Classes of one bucket of a first table, in sub-groups of at most GROUP, form cells: all members lie within half the
   threshold's angle of a pivot, so each two of them link without being compared. Cells of buckets that were split form
   balls by the same bound, round by round, so that a group of copies of any size ends as a few balls.
3. Postings (bucket, ball) of all tables, listed once and asked for with probes, meet by a join; 128 sign bits leave out
   pairs that can't be near (at five standard deviations). Pairs of balls are verified by pivots and radii: all members
   link, or none, or it depends on them; then cells, and then vectors in double precision, decide.

Pairs of vectors are never emitted: what leaves a verification is a count for each member, cell or ball.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.llm.ngram_join import _frames, _runs, components
from veriloom.llm.shingles import mix
from veriloom.session import ready, staged, tidy, unstage

COSINE = 0.93
#: Members of a sub-group; vectors of a bucket (about) from which on a bucket has another name; alternatives a rotation.
GROUP, IN_BUCKET, PROBES, ALTERNATIVES = 256, 4, 2, 4
#: Share of the pairs at the threshold that all tables may miss; random pairs to measure it on; sign bits (two longs).
MISS, PAIRS, SKETCH = 1e-3, 2000, 128
#: The first of the tables that cells and balls are made by; the index has those from 0.
DEALING = 1 << 20
#: Angles closer than this to a bound are decided by the cosine itself.
SLACK = 1e-6

_CLASSES = "cid string, h long, dom long, weight long, least long, vec binary"
_CELLS = "dom long, pivot binary, radius double, again boolean, weight long, cids array<string>, weights array<long>, leasts array<long>, vectors binary"
_BALLS = "child long, dom long, pivot binary, radius double, again boolean"
_POSTINGS = "bucket long, ask boolean, cell long, s1 long, s2 long, radius double"


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, in log2(columns) steps."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


@lru_cache(maxsize=4096)
def _signs(seed: int, table: int, name: int, dim: int) -> np.ndarray:
    return np.random.default_rng([seed, table, name, dim]).choice([-1.0, 1.0], (3, dim))


def _padded(x: np.ndarray) -> np.ndarray:
    dim = max(16, 1 << (x.shape[1] - 1).bit_length())
    return np.pad(x, ((0, 0), (0, dim - x.shape[1])))


def _names(x: np.ndarray, seed: int, table: int, name: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the ALTERNATIVES nearest signed axes after a rotation, and what each costs against the first."""
    for s in _signs(seed, table, name, x.shape[1]):
        x = _hadamard(x * s)
    size = np.abs(x)
    near = np.argpartition(-size, ALTERNATIVES, axis=1)[:, :ALTERNATIVES]
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(size, near, 1), axis=1, kind="stable"), 1)
    best = np.take_along_axis(size, near, 1)
    return near * 2 + (np.take_along_axis(x, near, 1) > 0), (best[:, :1] - best) ** 2


def _buckets(x: np.ndarray, dom: np.ndarray, seed: int, table: int, names: int, probes: int) -> np.ndarray:
    """Of each row its bucket in a table, and the next nearest ones: (rows, 1 + probes) hashes."""
    named = [_names(x, seed, table, k) for k in range(names)]
    # only choices whose product of ranks is small can be among the first ones
    picks = [p for p in itertools.product(range(ALTERNATIVES), repeat=names) if math.prod(a + 1 for a in p) <= probes + 1]
    costs = np.stack([sum(cost[:, a] for (_, cost), a in zip(named, p, strict=True)) for p in picks], axis=1)
    order = np.argsort(costs, axis=1, kind="stable")[:, : probes + 1]
    out = np.empty((len(x), len(picks)), dtype=np.uint64)
    for j, p in enumerate(picks):
        h = mix(dom + np.uint64((table + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        for (near, _), a in zip(named, p, strict=True):
            h = mix(h * np.uint64(31) + near[:, a].astype(np.uint64))
        out[:, j] = h
    return np.take_along_axis(out, order, 1)


def _shape(dim: int, count: int) -> int:
    """Names of a bucket."""
    return max(2, math.ceil(math.log(max(count, 1) / IN_BUCKET, 2 * dim))) if count > IN_BUCKET else 2


@lru_cache(maxsize=256)
def tables(dim: int, names: int, cosine: float, seed: int) -> int:
    """How many tables miss at most MISS of the pairs at the threshold; dim as padded."""
    rng = np.random.default_rng([seed, dim])
    x, z = rng.standard_normal((2, PAIRS, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    zero = np.zeros(PAIRS, dtype=np.uint64)
    a, b = (_buckets(v, zero, seed, 0, names, PROBES) for v in (x, cosine * x + math.sqrt(1 - cosine * cosine) * z))
    hit = ((a == b[:, :1]).any(1) | (b == a[:, :1]).any(1)).mean()
    return max(2, math.ceil(math.log(MISS) / math.log(max(1 - hit, 1e-9))))


def _matrices(frame: pd.DataFrame, col: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one dimension at a time: their places, and the vectors in col (doubles, as bytes) as a matrix."""
    sizes = frame[col].map(len).to_numpy()
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, np.frombuffer(b"".join(frame[col].iloc[at]), np.float64).reshape(len(at), -1)


def _classes(count: int, seed: int):
    """Unit vectors and their buckets in the table that cells are made by."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            units = []
            for v in frame["vector"]:
                v = np.asarray(v, dtype=np.float64)
                v = v / np.abs(v).max()
                units.append((v / np.sqrt(v @ v)).tobytes())
            frame = frame.assign(vec=units, h=np.int64(0)).drop(columns="vector")
            h = np.zeros(len(frame), dtype=np.uint64)
            for at, x in _matrices(frame, "vec") if len(frame) else ():
                x = _padded(x)
                h[at] = _buckets(x, frame["dom"].to_numpy(np.int64)[at].view(np.uint64), seed, DEALING, _shape(x.shape[1], count), 0)[:, 0]
            yield frame.assign(h=h.view(np.int64))[[c.split()[0] for c in _CLASSES.split(", ")]]

    return run


def _angle(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def _cover(x: np.ndarray, radii: np.ndarray, half: float) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(places, pivot, radius): parts whose points, each with its radius, lie within half of the part's pivot."""
    left = np.arange(len(x))
    while len(left):
        pivot, reach = x[left[0]], _angle(x[left] @ x[left[0]]) + radii[left]
        reach[0] = radii[left[0]]
        inside = reach <= half
        inside[0] = True
        if inside.sum() > 1:
            mean = x[left[inside]].mean(0)
            mean /= np.linalg.norm(mean)
            other = _angle(x[left] @ mean) + radii[left]
            if (other <= half).sum() >= inside.sum():
                pivot, reach, inside = mean, other, other <= half
        yield left[inside], pivot, float(reach[inside].max())
        left = left[~inside]


def _cells(half: float):
    """Cells of each sub-group (h, s, cid, dom, weight, least, vec, again)."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for run in _runs(frames):
            by: dict[tuple, list[tuple]] = {}
            for r in run:  # a bucket is a hash: labels and dimensions are held apart once more
                by.setdefault((r[3], len(r[6])), []).append(r)
            for own in by.values():
                x = np.frombuffer(b"".join(r[6] for r in own), np.float64).reshape(len(own), -1)
                for at, pivot, radius in _cover(x, np.zeros(len(own)), half):
                    some = [own[i] for i in at]
                    yield own[0][3], pivot.tobytes(), radius, own[0][7], sum(r[4] for r in some), [r[2] for r in some], [r[4] for r in some], [None if pd.isna(r[5]) else int(r[5]) for r in some], x[at].tobytes()

    return lambda frames: _frames(rows(frames), _CELLS)


def _balls(half: float):
    """Balls of each sub-group (h, s, cell, dom, pivot, radius, again); a ball is named by its least child."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for run in _runs(frames):
            by: dict[tuple, list[tuple]] = {}
            for r in run:
                by.setdefault((r[3], len(r[4])), []).append(r)
            for own in by.values():
                x = np.frombuffer(b"".join(r[4] for r in own), np.float64).reshape(len(own), -1)
                for at, pivot, radius in _cover(x, np.array([r[5] for r in own]), half):
                    name = min(own[i][2] for i in at)
                    for i in at:
                        yield own[i][2], name, own[0][3], pivot.tobytes(), radius, own[0][6]

    return lambda frames: _frames(rows(frames), "child long, ball long, " + _BALLS.split(", ", 1)[1])


def _dealt(count: int, seed: int, table: int):
    """h of pivots in another table."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            h = np.zeros(len(frame), dtype=np.uint64)
            for at, x in _matrices(frame, "pivot") if len(frame) else ():
                x = _padded(x)
                h[at] = _buckets(x, frame["dom"].to_numpy(np.int64)[at].view(np.uint64), seed, table, _shape(x.shape[1], count), 0)[:, 0]
            yield frame.assign(h=h.view(np.int64))

    return run


def _sketch(x: np.ndarray, seed: int) -> np.ndarray:
    """128 signs of random projections of each row, as two longs."""
    plane = np.random.default_rng([seed, x.shape[1], 7]).standard_normal((x.shape[1], SKETCH))
    return np.packbits(x @ plane > 0, axis=1).view(np.int64)


def _sketched(seed: int):
    """Rows with the sketches of their pivots."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = np.zeros((len(frame), 2), dtype=np.int64)
            for at, x in _matrices(frame, "pivot") if len(frame) else ():
                out[at] = _sketch(x, seed)
            yield frame.assign(s1=out[:, 0], s2=out[:, 1])

    return run


def _postings(count: int, seed: int, cosine: float):
    """Buckets of a cell's members in all tables, each once: listed, and asked for with probes; with the pivot's sketch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sizes = frame["pivot"].map(len).to_numpy()
            for size in np.unique(sizes):
                own = frame[sizes == size]
                x = _padded(np.frombuffer(b"".join(own["vectors"]), np.float64).reshape(-1, size // 8))
                members = own["vectors"].map(len).to_numpy() // size
                sketch = _sketch(np.frombuffer(b"".join(own["pivot"]), np.float64).reshape(len(own), -1), seed)
                row, dom = np.repeat(np.arange(len(own)), members), np.repeat(own["dom"].to_numpy(np.int64), members)
                names = _shape(x.shape[1], count)
                for t in range(tables(x.shape[1], names, cosine, seed)):
                    found = _buckets(x, dom.view(np.uint64), seed, t, names, PROBES).view(np.int64)
                    listed = pd.DataFrame({"bucket": found[:, 0], "ask": False, "row": row})
                    asked = pd.DataFrame({"bucket": found.reshape(-1), "ask": True, "row": np.repeat(row, found.shape[1])})
                    for part in (listed, asked):
                        part = part.drop_duplicates()
                        k = part.pop("row").to_numpy()
                        yield part.assign(cell=own["cell"].to_numpy(np.int64)[k], s1=sketch[k, 0], s2=sketch[k, 1], radius=own["radius"].to_numpy(np.float64)[k])
        tidy()

    return run


def _related(theta: float, cosine: float):
    """Pairs with pivots and radii: kind 1 if all their members link, 0 if it depends on them; the others leave."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keep = np.full(len(frame), -1)
            for at, x in _matrices(frame, "pivot_x") if len(frame) else ():
                y = np.frombuffer(b"".join(frame["pivot_y"].iloc[at]), np.float64).reshape(x.shape)
                rx, ry = (frame[c].to_numpy()[at] for c in ("radius_x", "radius_y"))
                cosines, reach = (x * y).sum(1), rx + ry
                angle = _angle(cosines)
                kind = np.where(angle + reach < theta - SLACK, 1, np.where(angle - reach > theta + SLACK, -1, 0))
                keep[at] = np.where(reach == 0, np.where(cosines >= cosine, 1, -1), kind)
            yield pd.DataFrame({"x": frame["x"], "y": frame["y"], "kind": keep})[keep >= 0]

    return run


def _verified(cosine: float):
    """Of two cells: how many rows each member links with in the other, for members with any."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                wx, wy = np.array(r.weights_x), np.array(r.weights_y)
                x, y = (np.frombuffer(v, np.float64).reshape(len(w), -1) for v, w in ((r.vectors_x, wx), (r.vectors_y, wy)))
                near = x @ y.T >= cosine
                for cell, other, links in ((r.x, r.y, near @ wy), (r.y, r.x, near.T @ wx)):
                    for i in np.flatnonzero(links):
                        yield cell, other, int(i), int(links[i])

    return lambda frames: _frames(rows(frames), "cell long, other long, place int, links long")


def _valid(vector: str, label: str) -> Column:
    v = F.col(vector)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return F.col(label).isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda c: c != 0)


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", *, cosine: float = COSINE, seed: int = 11) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of df.

    n_links counts the other rows that a row links with, component_id is the smallest id reachable by links, and kept says
    whether the row has that id. Each pair found has the cosine or more; recall is measured against brute force by the tests.

    Vectors that are null, empty or zero, or hold a null, NaN or infinite component, and rows with a null label, link with
    nothing; so do vectors of unequal length. A null id takes part like any other; component_id is then the smallest
    non-null id, or null, and a null id is kept only with a null component. Repeated rows are vectors of their own: they
    link with each other, and rows with the smallest id are all kept. Other columns are left out, so their names can't
    clash. An empty table gives an empty result. The result reads a table of the shared folder.
    """
    spark, paths = ready(df.sparkSession), []

    def keep(frame: DataFrame, name: str) -> DataFrame:
        out, path = staged(frame, name)
        paths.append(path)
        return out

    theta = math.acos(cosine)
    half = theta / 2 - SLACK
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("vector"))
    count = rows.count()
    cid = F.concat_ws("-", F.xxhash64("label", "vector"), F.xxhash64(F.lit(seed), "vector", "label"))
    keyed = rows.withColumn("cid", F.when(_valid("vector", "label"), cid))

    # 1: classes
    one = keyed.where("cid is not null").groupBy("cid").agg(F.xxhash64(F.first("label"), F.size(F.first("vector"))).alias("dom"), F.count("*").alias("weight"), F.min("vec_id").alias("least"), F.first("vector").alias("vector"))
    classes = keep(one.mapInPandas(_classes(count, seed), _CLASSES), "classes")

    # 2: cells and balls
    def spread(of: DataFrame, name: str, *more: str) -> DataFrame:
        big = keep(of.groupBy("h").agg(F.ceil(F.count("*") / GROUP).alias("k")).where("k > 1").withColumnRenamed("h", "_h"), "large")
        salted = of.join(big, F.col("h") == F.col("_h"), "left").withColumn("s", F.pmod(F.xxhash64(name, F.lit(seed)), F.coalesce("k", F.lit(1)))).withColumn("again", F.col("k").isNotNull())
        return salted.select("h", "s", name, *more, "again").repartition("h", "s").sortWithinPartitions("h", "s", name)

    cells = keep(spread(classes, "cid", "dom", "weight", "least", "vec").mapInPandas(_cells(half), _CELLS).withColumn("cell", F.monotonically_increasing_id()), "cells")
    balls = cells.select(F.col("cell").alias("ball"), "dom", "pivot", "radius")
    held = cells.select("cell", F.col("cell").alias("ball"))
    live, table = cells.where("again").select("cell", "dom", "pivot", "radius"), DEALING + 1
    before = live.count()
    while before > 1:
        named = live.mapInPandas(_dealt(count, seed, table), "cell long, dom long, pivot binary, radius double, h long")
        made = keep(spread(keep(named, "dealt"), "cell", "dom", "pivot", "radius").mapInPandas(_balls(half), "child long, ball long, " + _BALLS.split(", ", 1)[1]), "made")
        new = made.groupBy("ball").agg(*[F.first(c).alias(c) for c in ("dom", "pivot", "radius", "again")])
        balls = keep(balls.join(made.select(F.col("child").alias("ball")), "ball", "left_anti").unionByName(new.select("ball", "dom", "pivot", "radius")), "balls")
        held = keep(held.join(made.select(F.col("child").alias("_child"), F.col("ball").alias("_ball")), F.col("ball") == F.col("_child"), "left").select("cell", F.coalesce("_ball", "ball").alias("ball")), "held")
        live = keep(new.where("again").select(F.col("ball").alias("cell"), "dom", "pivot", "radius"), "again")
        after, table = live.count(), table + 1
        if after > 0.9 * before:
            break
        before = after

    # 3: pairs of balls
    weights = keep(held.join(cells.select("cell", "weight"), "cell").groupBy("ball").agg(F.sum("weight").alias("weight")).join(balls, "ball").mapInPandas(_sketched(seed), "ball long, weight long, dom long, pivot binary, radius double, s1 long, s2 long"), "weights")
    posted = keep(cells.select("cell", "dom", "pivot", "radius", "vectors").mapInPandas(_postings(count, seed, cosine), _POSTINGS), "postings")
    # postings of balls of several cells are put together; all others go to their bucket as they are
    several = keep(held.join(held.groupBy("ball").agg(F.count("*").alias("k")).where("k > 1").select("ball"), "ball").select(F.col("cell").alias("_cell"), F.col("ball").alias("_ball")), "several")
    if several.isEmpty():
        all_posted = posted.withColumnRenamed("cell", "ball")
    else:
        named = posted.join(several, F.col("cell") == F.col("_cell"), "left")
        shared = named.where("_ball is not null").select("bucket", "ask", F.col("_ball").alias("ball")).distinct().join(weights.select("ball", "s1", "s2", "radius"), "ball")
        all_posted = named.where("_ball is null").select("bucket", "ask", F.col("cell").alias("ball"), "s1", "s2", "radius").unionByName(shared)
    listed, asked = (all_posted.where(f"ask = {ask}").alias(n) for n, ask in (("l", False), ("a", True)))
    share = (F.lit(theta) + F.col("l.radius") + F.col("a.radius")) / math.pi
    apart = F.bit_count(F.col("l.s1").bitwiseXOR(F.col("a.s1"))) + F.bit_count(F.col("l.s2").bitwiseXOR(F.col("a.s2")))
    close = apart <= SKETCH * share + 5 * F.sqrt(SKETCH * share * (1 - share))
    met = listed.join(asked, (F.col("l.bucket") == F.col("a.bucket")) & (F.col("l.ball") != F.col("a.ball")) & close)
    pairs = met.select(F.least("l.ball", "a.ball").alias("x"), F.greatest("l.ball", "a.ball").alias("y")).distinct()

    def related(pairs: DataFrame, of: DataFrame, name: str, *more: str) -> DataFrame:
        sides = [of.select(F.col(name).alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("dom", "pivot", "radius")]) for s in "xy"]
        both = pairs.join(sides[0], "x").join(sides[1], "y").where("dom_x = dom_y and length(pivot_x) = length(pivot_y)")
        return both.select("x", "y", "pivot_x", "radius_x", "pivot_y", "radius_y").mapInPandas(_related(theta, cosine), "x long, y long, kind int")

    of_balls = keep(related(pairs, weights, "ball"), "ball-pairs")
    open_balls = of_balls.where("kind = 0").select("x", "y")
    ends = open_balls.select(F.explode(F.array("x", "y")).alias("ball")).distinct()
    opened = keep(posted.select("bucket", "ask", "cell").join(held.join(ends, "ball"), "cell"), "opened")
    sides = [opened.where(f"ask = {ask}").select("bucket", F.col("ball").alias(f"ball_{n}"), F.col("cell").alias(f"cell_{n}")) for n, ask in (("l", False), ("a", True))]
    both = open_balls.select(F.col("x").alias("ball_l"), F.col("y").alias("ball_a")).unionByName(open_balls.select(F.col("y").alias("ball_l"), F.col("x").alias("ball_a")))
    inner = both.join(sides[0], "ball_l").join(sides[1], ["ball_a", "bucket"]).select(F.least("cell_l", "cell_a").alias("x"), F.greatest("cell_l", "cell_a").alias("y")).distinct()
    of_cells = keep(related(inner, cells, "cell"), "cell-pairs")
    full = [cells.select(F.col("cell").alias(s), F.col("weights").alias(f"weights_{s}"), F.col("vectors").alias(f"vectors_{s}")) for s in "xy"]
    of_members = keep(of_cells.where("kind = 0").join(full[0], "x").join(full[1], "y").mapInPandas(_verified(cosine), "cell long, other long, place int, links long"), "member-links")

    def both_ways(pairs: DataFrame, of: DataFrame, name: str) -> DataFrame:
        turned = pairs.where("kind = 1").select(F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.col("y").alias("a"), F.col("x").alias("b")))).alias("p")).select("p.a", "p.b")
        return turned.join(of.select(F.col(name).alias("b"), "weight"), "b").groupBy("a").agg(F.sum("weight").alias("links"))

    ball_links = both_ways(of_balls, weights, "ball").select(F.col("a").alias("ball"), F.col("links").alias("by_ball"))
    cell_links = both_ways(of_cells, cells, "cell").select(F.col("a").alias("cell"), F.col("links").alias("by_cell"))
    member_links = of_members.groupBy("cell", "place").agg(F.sum("links").alias("by_member"))
    at = [held.select(F.col("cell").alias(s), F.col("ball").alias(f"ball_{s}")) for s in "xy"]
    joined = of_cells.where("kind = 1").select("x", "y").unionByName(of_members.select(F.col("cell").alias("x"), F.col("other").alias("y"))).distinct()
    edges = of_balls.where("kind = 1").select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(joined.join(at[0], "x").join(at[1], "y").select(F.col("ball_x").alias("a"), F.col("ball_y").alias("b")))
    roots, more = components(keep(edges.where("a <> b"), "links"))
    paths.extend(more)

    # what each class has
    owned = held.join(weights.select("ball", F.col("weight").alias("own")), "ball").join(ball_links, "ball", "left").join(cell_links, "cell", "left").join(roots, F.col("ball") == F.col("node"), "left")
    base = owned.select("cell", (F.col("own") - 1 + F.coalesce("by_ball", F.lit(0)) + F.coalesce("by_cell", F.lit(0))).alias("links"), F.coalesce("root", "ball").alias("root"))
    members = keep(
        cells.select("cell", F.posexplode(F.arrays_zip("cids", "leasts")).alias("place", "m")).join(base, "cell").join(member_links, ["cell", "place"], "left")
        .select(F.col("m.cids").alias("class_id"), F.col("m.leasts").alias("least"), (F.col("links") + F.coalesce("by_member", F.lit(0))).alias("n_links"), "root"), "members",
    )
    smallest = members.groupBy("root").agg(F.min("least").alias("component_id"))
    result, _ = staged(members.join(smallest, "root").select("class_id", "n_links", "component_id"), "vector-classes")
    unstage(spark, *paths)
    done = keyed.select("vec_id", "cid").join(result, F.col("cid") == F.col("class_id"), "left")
    component = F.when(F.col("class_id").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return done.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
