"""Bounded samples of labelled rows, to fit classifiers on."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.session import ready


def fold(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null ids count as empty text."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % folds


#: Bytes of text that a sample takes to the driver, but for its first row.
BYTES = 1 << 28


def _within(most: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = 0
        for frame in frames:
            sizes = frame["text"].map(lambda x: len(x.encode("utf-8", "surrogatepass"))).cumsum() + held
            first = held == 0
            keep = (sizes <= most) | (first & (sizes.index == sizes.index[0])) if len(frame) else sizes.astype(bool)
            yield frame[keep]
            if len(frame):
                held = int(sizes.iloc[-1])
            if held > most:
                return

    return run


def sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, most: int, *, most_bytes: int = BYTES, id_col: str = "doc_id", text_col: str = "text", per_class: bool = True) -> pd.DataFrame:
    """At most `most` rows (text, label 0 or 1) on the driver: the labelled rows for which train holds (an expression
    of `doc_id`), those with the smallest hash of their id first; per_class: up to half from each class.

    Ids without a label or with both, and documents without an id, are left out. Of rows with equal ids each counts,
    but no more than `most` in all, and no more than hold most_bytes of text (whole texts; the first always counts).
    """
    named = labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null").where(train)
    one = named.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").select("doc_id", "label")
    order = [F.xxhash64(F.col("doc_id"), F.lit(7)), F.col("doc_id")]
    if per_class:
        picked = one.where("label = 0").orderBy(*order).limit(most // 2).unionByName(one.where("label = 1").orderBy(*order).limit(most // 2))
    else:
        picked = one.orderBy(*order).limit(most)
    rows = picked.collect()  # `most` ids at most
    spark = ready(docs.sparkSession)
    chosen = F.broadcast(spark.createDataFrame([(r.doc_id, r.label) for r in rows], f"doc_id {dict(named.dtypes)['doc_id']}, label int"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = texts.join(chosen, "doc_id").orderBy(*order, "text").limit(most).select("text", "label").mapInPandas(_within(most_bytes), "text string, label int").collect()
    return pd.DataFrame([(r.text, r.label) for r in out], columns=["text", "label"])
