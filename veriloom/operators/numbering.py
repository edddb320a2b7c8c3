"""Places of rows in their group, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.session import staged


def numbered(rows: DataFrame, group: str, order: list[Column], out: str) -> tuple[DataFrame, list[str]]:
    """rows with `out`, their place in their group from 0, and the folders that it reads.

    Rows are dealt by ranges of (group, order), so a large group is spread over all tasks; each task's places start where
    the counts of those before it end, of which there is a row for each task and group. Null groups are groups; rows that
    are equal in group and order get their places in any order.
    """
    keys = [F.col(group).asc_nulls_first(), *order]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id())
    kept, path = staged(dealt, "numbered")
    kept = kept.withColumn("_task", F.shiftright("_place", 33))
    counts, more = staged(kept.groupBy("_task", F.col(group).alias("_group")).agg(F.min("_place").alias("_first"), F.count("*").alias("_count")), "counts")
    before = F.sum("_count").over(Window.partitionBy("_group").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    zero = counts.select(F.col("_task").alias("_at"), "_group", (F.col("_first") - F.coalesce(before, F.lit(0))).alias("_zero"))
    joined = kept.join(zero, (F.col("_task") == F.col("_at")) & F.col(group).eqNullSafe(F.col("_group")))
    return joined.select(*rows.columns, (F.col("_place") - F.col("_zero")).alias(out)), [path, more]
