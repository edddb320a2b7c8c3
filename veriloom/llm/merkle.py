"""A Merkle manifest of a dataset by superblock reduction.

Leaves are digests of rows. Per group (a source, say) leaves are numbered in the order of their ids, and every FANOUT
consecutive nodes become their parent, level by level, until one is left; the groups' roots, in order, likewise give one
root. Numbers are split into superblocks of FANOUT ** LEVELS: one applyInPandas call collapses LEVELS levels of one
superblock, the roots of superblocks are numbered by their superblock and reduced in the same way, and so on. A leaf's
path is its path within its superblock followed by the path of the superblock's root.

Numbers come from a range shuffle: partitions are sorted, each counts its rows by group, and offsets are sums of those
counts, so that a group of any size is spread over all tasks. A superblock is one row of packed digests from then on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.session import ready, staged, tidy, unstage

FANOUT, LEVELS = 3, 5
_BLOCK = "grp binary, block long, ids array<long>, leaves binary, claims binary, root binary"
_PATHS = "grp binary, idx long, path binary"


def seal(*columns: str | Column) -> Column:
    """Lowercase hex sha256 of columns, each as its UTF-8 byte count, a colon and its value, or a dash for null."""
    parts = []
    for c in columns:
        text = (F.col(c) if isinstance(c, str) else c).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def parent(nodes: list[bytes]) -> bytes:
    """The digest of a run of nodes, which enter as hex text."""
    return hashlib.sha256("".join(n.hex() for n in nodes).encode()).digest()


def _levels(nodes: list[bytes], most: int | None, fanout: int) -> list[list[bytes]]:
    """nodes and the levels above: `most` of them, or until one node is left."""
    out = [nodes]
    while len(out[-1]) > 1 if most is None else len(out) <= most:
        out.append([parent(out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def _path(levels: list[list[bytes]], at: int, fanout: int) -> bytes:
    """For each level a byte of 16 * (size of the run - 1) + place in it, then the run's other nodes."""
    out = []
    for level in levels[:-1]:
        first = at - at % fanout
        run = level[first : first + fanout]
        out += [bytes([16 * (len(run) - 1) + at - first]), *run[: at - first], *run[at - first + 1 :]]
        at //= fanout
    return b"".join(out)


def steps(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(place in the run, siblings) from a leaf to the root."""
    i = 0
    while i < len(path):
        more, place = divmod(path[i], 16)
        yield place, [path[i + 1 + 32 * k : i + 33 + 32 * k] for k in range(more)]
        i += 1 + 32 * more


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its path give."""
    for place, siblings in steps(path):
        leaf = parent([*siblings[:place], leaf, *siblings[place:]])
    return leaf


def _numbered(rows: DataFrame, order: list[Column]) -> tuple[DataFrame, list[str]]:
    """rows (grp, ...) with idx, their place in their group by order (nulls first), and n, the group's size."""
    spark = rows.sparkSession
    at = rows.repartitionByRange(F.col("grp").asc_nulls_first(), *order).sortWithinPartitions(F.col("grp").asc_nulls_first(), *order)
    kept, path = staged(at.withColumn("mid", F.monotonically_increasing_id()), "numbered")
    kept = kept.withColumn("part", F.shiftright("mid", 33))
    counts, more = staged(kept.groupBy("part", "grp").agg(F.min("mid").alias("first"), F.count("*").alias("c")), "counts")
    before = F.sum("c").over(Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("c").over(Window.partitionBy("grp"))
    offsets = counts.select("part", "grp", (F.col("first") - F.coalesce(before, F.lit(0))).alias("zero"), total.alias("n")).alias("o")
    joined = kept.alias("k").join(offsets, (F.col("k.part") == F.col("o.part")) & F.col("k.grp").eqNullSafe(F.col("o.grp")))
    names = [c for c in kept.columns if c not in ("mid", "part")]
    return joined.select(*[f"k.{c}" for c in names], (F.col("mid") - F.col("zero")).alias("idx"), "n"), [path, more]


def _collapse(levels: int, fanout: int):
    """One superblock's rows (grp, block, idx, n, id, leaf, claim) packed, with its root."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("idx")
        leaves = frame["leaf"].tolist()
        alone = int(frame["n"].iloc[0]) <= fanout**levels
        root = _levels(leaves, None if alone else levels, fanout)[-1][0]
        ids = [None if pd.isna(i) else int(i) for i in frame["id"]]
        return pd.DataFrame([(frame["grp"].iloc[0], int(frame["block"].iloc[0]), ids, b"".join(leaves), b"".join(frame["claim"]), root)], columns=[c.split()[0] for c in _BLOCK.split(", ")])

    return run


def _split(packed: bytes) -> list[bytes]:
    return [packed[i : i + 32] for i in range(0, len(packed), 32)]


def _paths(levels: int, fanout: int):
    """(grp, idx, path) of each node of packed superblocks with the path of their root; upper is null for a group's only one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for grp, block, leaves, upper in zip(frame["grp"], frame["block"], frame["leaves"], frame["upper"], strict=True):
                nodes = _split(leaves)
                tree = _levels(nodes, levels if upper is not None else None, fanout)
                yield pd.DataFrame({"grp": [grp] * len(nodes), "idx": block * fanout**levels + np.arange(len(nodes)), "path": [_path(tree, i, fanout) + (upper or b"") for i in range(len(nodes))]})
        tidy()

    return run


class _Tree:
    """The tables of a reduction: superblocks tier by tier, and the root of each group."""

    def __init__(self, numbered: DataFrame, levels: int, fanout: int):
        self.levels, self.fanout, self.tiers, self.paths = levels, fanout, [], []
        rows = numbered
        while True:
            grouped = rows.withColumn("block", F.expr(f"idx div {fanout**levels}")).groupBy("grp", "block")
            tier = self._keep(grouped.applyInPandas(_collapse(levels, fanout), _BLOCK), "superblocks")
            self.tiers.append(tier)
            # groups with several superblocks go on; their size is then the number of superblocks
            size = tier.groupBy("grp").agg(F.count("*").alias("n"))
            more = size.where("n > 1").withColumnRenamed("grp", "_grp")
            rows = self._keep(tier.join(more, F.col("grp").eqNullSafe(F.col("_grp"))).select("grp", F.col("block").alias("idx"), "n", F.lit(None).cast("long").alias("id"), F.col("root").alias("leaf"), F.col("root").alias("claim")), "roots")
            if rows.isEmpty():
                break
        lone = [t.join(t.groupBy("grp").agg(F.count("*").alias("n")).where("n = 1").withColumnRenamed("grp", "_grp"), F.col("grp").eqNullSafe(F.col("_grp"))).select("grp", "root") for t in self.tiers]
        roots = lone[0]
        for t in lone[1:]:
            roots = roots.unionByName(t)
        self.roots = self._keep(roots, "group-roots")

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        out, path = staged(df, name)
        self.paths.append(path)
        return out

    def blocks(self) -> DataFrame:
        """The first tier's superblocks with upper, the path of their root within the group (null for a group's only one)."""
        upper = None
        for tier in reversed(self.tiers):
            joined = tier.withColumn("upper", F.lit(None).cast("binary")) if upper is None else self._under(tier, upper)
            if tier is self.tiers[0]:
                return joined
            upper = self._keep(joined.select("grp", "block", "leaves", "upper").mapInPandas(_paths(self.levels, self.fanout), _PATHS), "paths")
        raise AssertionError

    @staticmethod
    def _under(tier: DataFrame, upper: DataFrame) -> DataFrame:
        u = upper.select(F.col("grp").alias("_grp"), F.col("idx").alias("_idx"), F.col("path").alias("upper"))
        return tier.join(u, F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("block") == F.col("_idx")), "left").drop("_grp", "_idx")


def _proofs(levels: int, fanout: int, schema: str):
    """Rows of `schema` for each leaf of superblocks (grp, block, ids, leaves, claims, upper, subroot, over, root)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for frame in frames:
            for r in frame.itertuples(index=False):
                nodes, claims = _split(r.leaves), _split(r.claims)
                tree = _levels(nodes, levels if r.upper is not None else None, fanout)
                above = (r.upper or b"") + r.over
                subroot, root, out = r.subroot.hex(), r.root.hex(), []
                for i, (id_, leaf, claim) in enumerate(zip(r.ids, nodes, claims, strict=True)):
                    path = _path(tree, i, fanout) + above
                    hexes = "".join(s.hex() for _, siblings in steps(path) for s in siblings)
                    folded = fold(claim, path)
                    out.append((None if pd.isna(id_) else int(id_), r.grp, r.block * fanout**levels + i, leaf.hex(), subroot, root, path, hashlib.sha256(hexes.encode()).hexdigest(), folded.hex(), folded == r.root))
                yield pd.DataFrame(out, columns=names, dtype=object)
        tidy()

    return run


def manifest(docs: DataFrame, leaf: Column, id_col: str = "doc_id", group_col: str = "source", *, claim: Column | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(id, grp, idx, leaf, subroot, root, path, proof_sha256, folded_root, verified), one row for each row of docs.

    leaf: the hex digest of a row, as of seal(). claim: another digest of it, to be proven (leaf where none is given):
    folded_root is what the claim and the leaf's siblings give, and verified says whether it is the root. grp is the
    group's name as UTF-8. path holds the siblings level by level (see steps() and fold()), proof_sha256 is the digest of
    their hex text.

    A null group comes first; null ids come first in their group; rows with equal ids follow the order of their leaves, so
    that the root doesn't depend on the order of rows. Repeated rows are leaves of their own. Texts of any length, null and
    empty ones are digested whole by the expressions given. Columns that leaf and claim don't name are not read, so no name
    can clash. An empty table has no root and gives an empty result.

    The result reads tables of the shared folder (superblocks and paths); all others are deleted before it returns.
    """
    spark = ready(docs.sparkSession)
    text = leaf if claim is None else claim
    rows = docs.select(F.col(group_col).cast("string").cast("binary").alias("grp"), F.col(id_col).cast("long").alias("id"), F.unhex(leaf).alias("leaf"), F.unhex(text).alias("claim"))
    first, at = staged(rows.withColumn("place", F.monotonically_increasing_id()), "leaves")
    # place only spreads rows that are equal in all else
    numbered, used = _numbered(first, [F.col("id").asc_nulls_first(), F.col("leaf"), F.col("claim"), F.col("place")])
    lower = _Tree(numbered.select("grp", "idx", "n", "id", "leaf", "claim"), levels, fanout)
    unstage(spark, at, *used)

    # the groups' roots are the leaves of one more tree
    named = lower.roots.select(F.lit(b"").alias("grp"), F.col("grp").alias("of"), F.col("root").alias("leaf"))
    ordered, used = _numbered(named, [F.col("of").asc_nulls_first()])
    kept, more = staged(ordered, "subroots")
    upper = _Tree(kept.select("grp", "idx", "n", F.lit(None).cast("long").alias("id"), "leaf", F.col("leaf").alias("claim")), levels, fanout)
    over = upper.blocks().select("grp", "block", "leaves", "upper").mapInPandas(_paths(levels, fanout), _PATHS)
    root = upper.roots.first()  # one row
    groups, last = staged(kept.select("idx", F.col("of"), F.col("leaf").alias("subroot")).join(over.select("idx", F.col("path").alias("over")), "idx").drop("idx"), "group-paths")
    blocks, done = staged(lower.blocks().drop("root"), "proof-blocks")
    joined = blocks.join(groups, F.col("grp").eqNullSafe(F.col("of"))).select("grp", "block", "ids", "leaves", "claims", "upper", "subroot", "over", F.lit(bytes(root.root) if root else b"").alias("root"))
    unstage(spark, *used, more, *lower.paths, *upper.paths)
    schema = "id long, grp binary, idx long, leaf string, subroot string, root string, path binary, proof_sha256 string, folded_root string, verified boolean"
    return joined.mapInPandas(_proofs(levels, fanout, schema), schema)
