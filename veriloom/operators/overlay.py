"""Overlays of keyed rows and of nested maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deep_overlay(base: DataFrame, override: DataFrame, key: str = "doc") -> DataFrame:
    """(key, path, value): leaves of base overlaid by override. Present nulls win; a scalar of the override removes the
    subtree of base below it, and a subtree of the override removes base's scalar above it. Lists are leaves. (JOIN-01,
    JOIN-02)"""
    o = override.select(F.col(key).alias("_k"), F.col("path").alias("_p"))
    above = base.select(key, "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", r"\."))), lambda n: F.array_join(F.slice(F.split("path", r"\."), 1, n), "."))).alias("_a"))
    dropped = above.join(o, (F.col(key) == F.col("_k")) & (F.col("_a") == F.col("_p")), "left_semi").select(key, "path")
    parents = override.select(F.col(key).alias("_k"), F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", r"\."))), lambda n: F.array_join(F.slice(F.split("path", r"\."), 1, n), "."))).alias("_p")).distinct()
    kept = base.join(dropped.distinct(), [key, "path"], "left_anti").join(parents, (F.col(key) == F.col("_k")) & (F.col("path") == F.col("_p")), "left_anti")
    return kept.select(key, "path", "value").unionByName(override.select(key, "path", "value"))


def update_join(base: DataFrame, overrides: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """base with fields replaced where the override has them: overrides carry a flag has_<field> beside each, so that a
    present null replaces and an absent one doesn't. (JOIN-05, PRJ-06)"""
    o = overrides.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_{f}") for f in fields], *[F.col(f"has_{f}") for f in fields])
    j = base.join(o, F.col(key) == F.col("_k"), "left")
    return j.select(*[F.when(F.coalesce(F.col(f"has_{c}"), F.lit(False)), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in base.columns])


def unknown(refs: DataFrame, col: str, known: DataFrame, known_col: str) -> DataFrame:
    """Distinct references that aren't known. (JOIN-04, JOIN-06, JOIN-10)"""
    k = known.select(F.col(known_col).alias("_k"))
    return refs.select(col).distinct().join(k, F.col(col) == F.col("_k"), "left_anti")


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """(key, n) of keys that occur more than once. (JOIN-06, SET-01)"""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def union_new(base: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """UNION ALL that fails on a key of more that base or more itself has already. (SET-01)"""
    both = base.unionByName(more)
    clash = duplicates(both, key).limit(1).collect()
    if clash:
        raise ValueError(f"duplicate {key}: {clash[0][key]}")
    return both
