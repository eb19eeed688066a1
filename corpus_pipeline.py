"""A corpus pipeline: quality rules, near-duplicate removal, secret redaction, mixing, tokenisation.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame; all but the
last return the columns of documents.

Defined cases, for all stages: an empty table gives an empty one; texts of any length are handled whole; columns other
than doc_id, text, source and n_chars are carried unchanged, whatever their names; rows that are equal in all columns are
rows like others, but for the second stage, which keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import jaccard, mixing, pieces, quality, secrets
from corpusloom.llm.common import carried, restored, table

#: Near duplicates: shingles of so many words, and least similarity in percent.
WORDS, SIMILARITY = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go. Null and empty texts have no words and go."""
    return quality.judge(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the least id.

    Groups are of texts. Rows without an id get one from their text, above all others; of rows with one id and the same or
    a linked text one stays, and unlinked texts with one id all stay. Texts without words are linked with nothing; of
    those that are equal and have one id, or none, one stays.
    """
    own = F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(F.xxhash64("text"), 2).bitwiseOR(F.lit(1 << 62)))
    keyed = carried(docs, "doc_id", "text").withColumn("_key", own).withColumn("_text", jaccard.text_key(F.col("text")))
    rows = jaccard.linked(keyed.select(F.col("_key").alias("doc_id"), "text"), WORDS, SIMILARITY, 100)
    row = F.struct("doc_id", "key")
    stay = rows.groupBy("component", F.when(F.col("component").isNull(), row).alias("alone")).agg(F.min(row).alias("row"))
    stay = stay.select(F.col("row.doc_id").alias("_key"), F.col("row.key").alias("_text"))
    return keyed.join(stay, ["_key", "_text"], "left_semi").dropDuplicates(["_key", "_text"]).select(*restored(docs.columns, "doc_id", "text"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; documents stay. A null text stays null."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out by Poisson counts towards the target shares of their sources, and shuffled.

    Null sources are one source; every row has a draw of its own, with or without an id.
    """
    return mixing.mix(docs).select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of each document, as piece ids with inclusion scores.

    A null text gives no rows, a text with one segmentation one. Rows with equal ids and texts get equal samples.
    """
    return pieces.encode(docs, pieces.load(), step=1 << 20)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", tokenise),
]

#: SQL cannot express sampled segmentations; tests hold each stage against a plain restatement.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
