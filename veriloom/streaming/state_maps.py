"""Finite automata over slices of one long sequence, by composed state maps.

What a slice does to an automaton is a map from the state it is entered in to the state it is left in. Maps compose
associatively, so the states in which slices are entered follow from a scan over maps: slices are composed within blocks,
blocks within blocks of blocks, and so on, and the states come down the same way. No task sees more than a block.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.session import staged

#: Maps that are composed in one step.
BLOCK = 128


def compose(maps: Column, states: int) -> Column:
    """One map of a list of them, the first applied first: an array of the states after."""
    return F.aggregate(maps, F.array(*[F.lit(s) for s in range(states)]), lambda acc, m: F.transform(acc, lambda s: F.element_at(m, s + 1)))


def entries(maps: DataFrame, group: str, at: str, out: str, states: int, start: int = 0) -> tuple[DataFrame, list[str]]:
    """(group, at, out): the state in which each slice is entered, `start` at a group's first, and the folders that it reads.

    maps: (group, at, map), `at` counting a group's slices from 0 without gaps. Null groups are groups.
    """
    tier, paths = maps.select(F.col(group).alias("g"), F.col(at).cast("long").alias("i"), "map"), []
    tiers = []
    while True:
        tier, path = staged(tier, "maps")
        paths.append(path)
        tiers.append(tier)
        if not tier.agg(F.max("i")).first()[0]:
            break
        tier = tier.groupBy("g", F.expr(f"i div {BLOCK}").alias("i")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "map"))), lambda x: x["map"]).alias("maps")).select("g", "i", compose(F.col("maps"), states).alias("map"))
    state = tiers[-1].select("g", "i", F.lit(start).alias("state"))
    for tier in reversed(tiers[:-1]):
        block = F.expr(f"i div {BLOCK}").alias("b")
        earlier = F.collect_list("map").over(Window.partitionBy("g", "b").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
        prefix = tier.select("g", "i", block, "map").select("g", "i", "b", compose(earlier, states).alias("before"))
        above = state.select(F.col("g").alias("_g"), F.col("i").alias("_i"), F.col("state").alias("_state"))
        state = prefix.join(above, F.col("g").eqNullSafe(F.col("_g")) & (F.col("b") == F.col("_i"))).select("g", "i", F.element_at("before", F.col("_state") + 1).alias("state"))
    done, path = staged(state.select(F.col("g").alias(group), F.col("i").alias(at), F.col("state").cast("int").alias(out)), "states")
    return done, [*paths, path]


def scanned(maps: np.ndarray, place: np.ndarray | None = None) -> np.ndarray:
    """Running composition of (steps, states) maps: row k is what the steps up to k do together, from the first one on or,
    with `place` (a step's place in its run, from 0), from the first of its run. Doubling, so log2(longest run) passes."""
    place = np.arange(len(maps)) if place is None else place
    out, d, last = maps.copy(), 1, place.max(initial=0)
    while d <= last:
        at = np.flatnonzero(place >= d)
        out[at] = np.take_along_axis(out[at], out[at - d].astype(np.intp), axis=1)
        d *= 2
    return out
