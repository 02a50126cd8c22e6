"""The corpus pipeline: language ID, near-duplicates, repeated passages, secrets, packing; each stage reads the last one's Parquet.

The first four stages return the columns of documents: rows go (no language; not the kept one of a group of
near-duplicates; nothing left) or their text changes (repeated passages are cut, secrets are masked, n_chars follows).
The last returns one row a piece of a packed sequence, with its token ids.

Cases, for every stage: columns beside doc_id, text, lang and n_chars are carried along under other names, so none clashes; a null
doc_id is a row of its own; rows that share a doc_id are judged each by itself (near-duplicates: of rows with one doc_id and text
one stays); null, empty and wordless texts leave with the first stage, and the later ones, called by themselves, keep them as
they are; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, minhash_dedup, packing, secret_scan, substring_dedup
from ._cluster import ROW, Workspace, broadcast_if_small, prepare, quoted, row_keyed
from .queries import held_out

OWN = ("doc_id", "text", "lang", "n_chars")


def aside(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """`docs` with the columns that are not OWN under names no operator uses, and the columns that give them theirs again."""
    names = [c if c in OWN else f"extra_column_{i}" for i, c in enumerate(docs.columns)]
    return docs.select(*[quoted(c).alias(n) for c, n in zip(docs.columns, names)]), [F.col(n).alias(c) for c, n in zip(docs.columns, names)]


def _recounted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def detect_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is found (`und`: no text, no letter) go."""
    prepare(spark)
    rows, back = aside(docs)
    sample = language_id.training_sample(rows.where(~held_out()))
    return language_id.identify(rows, sample, keep=rows.columns, names=("stage_lang", "stage_score")).where("stage_lang <> 'und'").select(*back)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group stays (rows without one come last), and of rows with one doc_id and text one."""
    space = Workspace(spark, "stage-near-dedup")
    rows, back = aside(docs)
    rows = row_keyed(rows, space)
    judged = rows.select(F.col(ROW).cast("long").alias("doc_id"), "text")
    near = minhash_dedup.near_duplicates(judged, space).where("not kept").select(F.col("doc_id").alias("gone"))
    # Texts without words are in no group: repeated rows of these go here.
    ids = space.write(rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "ids-repeated")
    again = rows.join(broadcast_if_small(ids), "doc_id", "left_semi")
    first = again.groupBy("doc_id", "text").agg(F.min(ROW).cast("long").alias("gone")).select("gone")
    gone = space.write(near.union(again.select(F.col(ROW).cast("long").alias("gone")).join(first, "gone", "left_anti")), "gone")
    space.drop("found")
    return rows.join(broadcast_if_small(gone), F.col(ROW).cast("long") == F.col("gone"), "left_anti").select(*back)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document has are cut; documents of which nothing is left go."""
    space = Workspace(spark, "stage-substrings")
    rows, back = aside(docs)
    rows = substring_dedup.by_key(row_keyed(rows, space), space, ROW)
    return _recounted(substring_dedup.rewrite(rows, substring_dedup.deduplicate(rows, space, key=ROW), key=ROW)).select(*back)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span that a rule finds is replaced by [SECRET]; no document goes."""
    space = Workspace(spark, "stage-secrets")
    rows, back = aside(docs)
    rows = row_keyed(rows, space)
    found = secret_scan.scan(rows, space, key=ROW).where(F.size("spans") > 0).select(F.col(ROW).alias("id"), "spans")
    found = space.write(found, "spans")
    space.drop("verified")
    rows = rows.join(broadcast_if_small(found, "spans"), F.col(ROW) == F.col("id"), "left")
    text = F.when(F.col("spans").isNotNull(), secret_scan.redact(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    return _recounted(rows.withColumn("text", text)).select(*back)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of packing.pack with the ids of each piece."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), Workspace(spark, "stage-packing"), with_ids=True)


STAGES = [
    ("language_id", detect_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("secret_scan", mask_secrets),
    ("packing", pack_sequences),
]

#: SQL cannot express automata, darts, window hashes or a tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage."""
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = space.write(stage(spark, docs, sf_dir), f"{i}-{name}")
        if i:
            space.drop(f"{i - 1}-{STAGES[i - 1][0]}")
    return docs
