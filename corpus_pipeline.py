"""A corpus pipeline of five operators; each stage is written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecheck.llm import bpe, decontamination, simhash, substring_dedup, toxicity
from tablecheck.llm.helpers import fresh, named, read
from tablecheck.llm.queries import BYTE_BPE, digests
from tablecheck.session import pin


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models do not reject."""
    (score,) = fresh(docs, "score")
    scored = toxicity.score_toxicity(docs, read(spark, sf_dir, "labels"), score_col=score)
    return scored.where(F.col(score) < 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return simhash.keep_one(docs, width=4, radius=4)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without sentence spans of earlier ones; n_chars follows the text."""
    cut = substring_dedup.remove_repeats(docs)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        cut = cut.withColumn("n_chars", F.coalesce(length, named("n_chars")))
    return cut


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents that are left, and digests of them and of what they decode to."""
    return digests(bpe.round_trip(docs.select("doc_id", "text"), public_tokenizers.path(BYTE_BPE)))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]
#: Learned models, components and token ids cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared scratch folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = pin(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
