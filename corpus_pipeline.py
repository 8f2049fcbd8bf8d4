"""Training-data pipeline: five stages over the documents, each stored and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import decontaminate, jaccard, langid, pieces, pii
from ledgerlens.llm.common import column, scratch
from ledgerlens.llm.queries import PIECE_MODEL, held_out


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents for which language ID has no answer go (no text, no letter).

    Profiles are learned as in the language query; all labelled texts of the input
    but the held-out third teach.
    """
    profiles = langid.learn(docs.where(~held_out()))
    row = docs.select(*[column(c) for c in docs.columns])
    judged = langid.identify(row, profiles, {c: c for c in docs.columns})
    return judged.where("lang_pred != 'und'").select(*[column(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays: that with the smallest id."""
    return jaccard.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.remove_contaminated(docs, items)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become ``<EMAIL>``, ``<IP>``, ``<CARD>`` and ``<PHONE>``."""
    return pii.redact(docs, pii.fit(docs), "text", "n_chars")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, end id last, with their number."""
    encoded = pieces.encode(docs, PIECE_MODEL, {c: c for c in ("doc_id", "lang", "source")})
    return encoded.select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("sentencepiece", encode_pieces),
]

#: The stages are not expressible in SQL as a whole; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder.

    Each result is stored in the shared checkpoint folder, in a folder of this run, and
    read again as the next stage's input; the folder goes when the session's JVM ends.
    """
    folder = scratch(spark, "pipeline")
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, out, sf_dir).write.parquet(path)
        out = spark.read.parquet(path)
    return out
