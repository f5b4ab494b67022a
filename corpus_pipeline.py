"""The corpus pipeline: filter, deduplicate, decontaminate and tokenise `documents`.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All but the
last return the columns of their input, whatever further columns it has. Rows without a doc_id can't
be named in a group or a match and stay; null texts are empty texts. Rows that share a doc_id but not
a group are all kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm import bpe, decontaminate, minhash, suffixes, toxicity
from deltaloom.llm.common import cut

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar, learned from the labels, doesn't call toxic."""
    grammar = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, grammar)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the row with the smallest doc_id; texts link that share 0.8 of their five-word shingles.

    Of rows of a group that share that id, the one with the smallest hash of all columns stays.
    """
    hashed = docs.withColumn("_row", F.xxhash64(*(f"`{c}`" for c in docs.columns)))
    found = minhash.duplicates(hashed.where("doc_id IS NOT NULL").select("doc_id", "text", F.col("_row").alias("row")))
    first = found.groupBy("group").agg(F.min(F.struct("doc_id", "row")).alias("first")).select("first.doc_id", F.col("first.row").alias("_row"))
    named = hashed.join(cut(first, "kept-ids"), ["doc_id", "_row"], "left_semi").dropDuplicates(["doc_id", "_row"])
    return named.select(docs.columns).unionByName(docs.where("doc_id IS NULL"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 51 words, or 400 bytes, that repeat; n_chars follows the text. All rows stay."""
    lost = cut(suffixes.repeats(docs, words=suffixes.PASSAGE_WORDS).select(F.col("digest").alias("_digest"), F.col("kept_text").alias("_text")), "lost")
    hashed = docs.withColumn("_digest", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    joined = hashed.join(lost, "_digest", "left")
    text = F.coalesce("_text", "text")
    new = {"text": text, "n_chars": F.char_length(text).cast("bigint")}
    return joined.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item; of rows that share an id only those whose own text has one go."""
    found = decontaminate.overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    lost = cut(found.select("doc_id", "text_digest").distinct(), "contaminated")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), decontaminate.text_digest().alias("text_digest"), F.struct("*").alias("row"))
    return rows.join(lost, ["doc_id", "text_digest"], "left_anti").select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the bytes they decode to."""
    return bpe.encode(docs, decoded=True).select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeats),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: SQL can express neither the grammar nor the encoding; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
