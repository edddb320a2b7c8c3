"""The subpackage's queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.llm import chat, media, merkle, near_vectors, ngram_join, packing, pair_tables, pieces, quality_cnn, quality_rules, secrets, token_counts, toxicity
from veriloom.llm.labelled import fold
from veriloom.session import table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents by five-word shingles at Jaccard 0.75."""
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs).drop("text")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document; rows of fold 1 of 3 are never learnt from."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, fold("doc_id", 3) != 1)
    return toxicity.score(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formatted conversations, read back."""
    probe = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    done = chat.format_conversations(rows.unionByName(more))
    read = done.select("conv_id", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars"
    )


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document; rows of fold 0 of 5 are never learnt from."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = quality_cnn.fit(docs, labels, fold("doc_id", 5) != 0)
    return quality_cnn.score(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op6_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segmentation of each document with merge-dropout, decoded again: ids, their checksum, and whether it is lossless."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    read = pieces.round_trip(docs, seed=1, rate=0.1)
    return read.select(
        "doc_id", (F.octet_length("packed_ids") / 4).cast("long").alias("n_tokens"), F.crc32("packed_ids").alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("lossless")
    )


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each document."""
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["rank"] < len(secrets.BASE))
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(r.kind) for r in secrets.BASE], F.sha2(secrets.spans_text(base), 256).alias("base_sha256"), secrets.spans_text(F.col("secrets")).alias("spans"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics and verdicts of each document."""
    done = quality_rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return done.select("doc_id", *[f"quality_rules.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as an MPEG audio stream, read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = media.media_features(media.media_column(docs))
    return done.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), *[f"features.{c}" for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")])


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of embeddings of one label at cosine 0.93."""
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op12_co_bucketed_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sales and sale_lines as co-bucketed files in a new folder of the shared one: a row for each file."""
    starts = (pair_tables.first_files("sale_id"), pair_tables.second_files("item_id"))
    return pair_tables.rewrite_pair(table(spark, sf_dir, "sales"), table(spark, sf_dir, "sale_lines"), starts=starts)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's leaf, proof and root; texts of ids with an even checksum are tampered with."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    names = ["doc_id", "source", "lang", "n_chars"]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    claim = F.when(hit & F.contains("text", F.lit("\n")), merkle.seal(*names, F.replace("text", F.lit("\n"), F.lit(""))))
    leaf = merkle.seal(*names, "text")
    done = merkle.manifest(docs, leaf, claim=F.coalesce(claim, leaf))
    return done.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_ngram_jaccard_join, op2_token_counts, op3_toxicity, op4_chat_formatting, op5_quality_classifier, op6_piece_encoding, op7_secret_scans, op8_quality_rules, op9_media_columns, op10_packing, op11_embedding_near_dedup, op12_co_bucketed_pair, op13_merkle_manifest, pipeline)
}
