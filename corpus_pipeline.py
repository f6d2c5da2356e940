"""The corpus pipeline: language ID, near-duplicates, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and reread as
the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import bpe, langid, minhash, mixing, queries, secrets
from lexloom.llm._shared import fresh, read_table, shared_dir, small_batches

#: Not expressible in SQL (a trained network, a seeded draw, an inferred grammar); tests/llm compares with brute force.
ORACLE_SQL = None
#: Texts of which no window has a language of this probability (less where there are many languages) are rejected, as are those without letters.
LEAST_SCORE = 0.3
#: Byte states of a worker in the token stage: fewer than usual, as the session's other stages need its memory too.
TOKEN_STATES = 40_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language, by its surest window; the others go.

    Twice an even share among the languages is enough where that is below LEAST_SCORE. Without labelled rows to
    learn from, all texts with letters stay.
    """
    net = langid.fit(docs)
    if net is None:
        return docs.where(docs["text"].rlike(r"\p{L}"))
    lang, score = fresh(docs.columns, "lang_pred"), fresh(docs.columns, "lang_score")
    found = langid.predict(docs, net, lang_col=lang, score_col=score, surest=True)
    return found.where((F.col(lang) != langid.UNDETERMINED) & (F.col(score) >= min(LEAST_SCORE, 2 / len(net.langs)))).select(*(f"`{c}`" for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, 0.8)."""
    return minhash.keep_first(docs, k=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to target weights, of whole documents: a document has one row for each time it is used.

    Rows are dealt by their shards, and shuffled inside a shard; a shard may lie in several partitions.
    """
    return mixing.shuffled(docs, whole=True).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, with their count, and digests of ids and decoded text."""
    return bpe.round_trip(docs, queries.tokenizer_file(), TOKEN_STATES, keep=False)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secret_scan), ("mixing", mixture), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
