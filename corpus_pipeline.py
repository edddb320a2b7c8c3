"""A training-data pipeline over documents: five stages, each on all that the one before it kept.

Each stage takes documents (doc_id, text, lang, source, n_chars) and gives the same columns; the last one gives pieces.
Null, empty and very long texts, ties, repeated rows, nulls in other columns, further columns and empty tables are taken as
each operator's docstring says; the docstrings here say what that means for the documents that stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.llm import ngram_join, packing, quality_cnn, quality_rules, secrets
from veriloom.llm.labelled import fold
from veriloom.llm.names import free
from veriloom.session import staged, table, unstage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the classifier accepts; it never learns from fold 0 of 5.

    A null text is scored as an empty one. Equal texts share a verdict, so repeated rows stay or go together. Further
    columns stay, whatever their names. Without labels of both classes all documents stay.
    """
    model = quality_cnn.fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    score, kept = free(docs, "score", "kept")
    return quality_cnn.score(docs, model, out=(score, kept)).where(F.col(kept) == 1).select(*docs.columns)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the rules and whose host does.

    Null and empty texts have too few words and go. A null source is a host of its own. Repeated rows stay or go together.
    """
    (out,) = free(docs, "rules")
    return quality_rules.apply_rules(docs, out=out).where(F.col(out)["kept"]).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the one with the smallest doc_id, null ids last.

    Documents without words are in no group and stay. Of repeated rows with one id and text one stays.
    """
    return ngram_join.first_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; all documents stay, repeated rows too, and n_chars follows the text (null for null)."""
    return secrets.redact(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens, as pieces of documents; a null or empty text is one token, repeated rows are
    packed each."""
    return packing.pack(docs)


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", rules), ("ngram_jaccard_join", near_duplicates), ("secret_scans", secret_scans), ("packing", pack)]

#: SQL can't express the classifier and the packing; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is staged in the shared folder and read again, and deleted when the next one
    is written. The pieces are made when the result is read, from the last staged one, which stays."""
    docs = table(spark, sf_dir, "documents")
    docs, before = docs.select(*[F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in COLUMNS]), None
    for name, stage in STAGES[:-1]:
        docs, path = staged(stage(spark, docs, sf_dir), name)
        if before:
            unstage(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
