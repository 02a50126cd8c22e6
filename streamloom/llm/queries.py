"""The contract queries of this subpackage: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, language_id, minhash_dedup, nearest_neighbours, packing, piece_codec, quality_classifier, secret_scan, substring_dedup, token_counts
from ._cluster import ROW, Workspace, prepare, row_keyed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(key: str = "doc_id") -> Column:
    """A quarter of all documents, by crc32 of the id as text, is never learnt from."""
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(4)) == 2


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sample = language_id.training_sample(docs.where(~held_out()))
    found = language_id.identify(docs, sample)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "op2")
    docs = row_keyed(table(spark, sf_dir, "documents").select("doc_id", "text"), space)
    docs = substring_dedup.by_key(docs, space, ROW)
    covered = substring_dedup.deduplicate(docs, space, key=ROW)
    return substring_dedup.strip(docs, covered, key=ROW)


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"), Workspace(spark, "op3"), 0.95)


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours.search(vectors, F.col("id") % 20 == 0, Workspace(spark, "op4"), k=20)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    scored = quality_classifier.score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents, which come unlabelled, are compacted, and then get their languages as revisions (a delete and an insert each).

    Every batch is committed twice, as a retry would; each counts once.
    """
    import public_tokenizers

    space = Workspace(spark, "op6")
    rollup = token_counts.TokenRollup(spark, f"{space.path}/rollup")
    counts = token_counts.signed_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, "byte_bpe_50k")
    counts = space.write(counts, "counts")
    unlabelled = counts.withColumn("lang", F.lit(None).cast("string"))
    labelled = counts.where("lang is not null")
    gone = labelled.select("source", F.lit(None).cast("string").alias("lang"), "tokenizer", (-F.col("n_docs")).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))
    for _ in range(2):
        rollup.commit("documents", unlabelled)
    rollup.compact()
    for _ in range(2):
        rollup.commit("documents", unlabelled)
        rollup.commit("languages", gone.union(labelled))
    return rollup.totals()


def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge dropout of 0.1, the customary rate for training, with a fixed seed."""
    import public_tokenizers

    return piece_codec.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), seed=1, rate=0.1)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"), Workspace(spark, "op8"))
    kinds = [r.kind for r in secret_scan.BASE]
    base = secret_scan.of_kinds("spans", kinds)
    counts = [F.size(secret_scan.of_kinds("spans", [k])).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(secret_scan.span_text(base), 256).alias("base_sha256"), secret_scan.span_text(F.col("spans")).alias("spans"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), Workspace(spark, "op9"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), Workspace(spark, "op10"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_token_counts": op6_token_counts,
    "op7_piece_codec": op7_piece_codec,
    "op8_secret_scan": op8_secret_scan,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_packing": op10_packing,
}

ORACLES: dict[str, str] = {}
