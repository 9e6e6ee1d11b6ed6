"""The training-data pipeline: language ID, exact dedup, near dedup, decontamination, subword encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next stage's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import decontaminate, exact_dedup, language_id, pieces, similar
from attestry.llm.common import documents, given_table
from attestry.session import shared_folder


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are in none of the labelled rows' languages: no text, no letter, or foreign n-grams."""
    model = language_id.fit(docs)
    found = language_id.predict(docs, model, docs.columns, names=("__lang", "__score", "__ambiguous", "__foreign"))
    return found.filter("NOT __foreign").select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per distinct text stays, the one with the largest doc_id."""
    return exact_dedup.unique_rows(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per group of near copies stays, the one with the smallest doc_id.

    Near copies have SimHash fingerprints within three bits, by op5's method over five-word shingles, or share four fifths
    of these shingles or more; op5 has a contract of its own.
    """
    return similar.one_per_group(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    found = decontaminate.scan(docs, given_table(spark, sf_dir, "benchmark"), docs.columns, name="__overlaps")
    return found.filter(~decontaminate.contaminated("__overlaps")).select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its piece ids and the text they decode to.

    The added columns are ``piece_ids``, ``n_pieces`` and ``decoded``; columns of those names are replaced.
    """
    vocabulary = pieces.load_vocabulary()
    kept = [c for c in docs.columns if c not in ("piece_ids", "n_pieces", "decoded")]
    spelt = pieces.encode_and_decode(docs, kept, vocabulary, ids="piece_ids", decoded="decoded")
    return spelt.withColumn("n_pieces", F.coalesce(F.size("piece_ids"), F.lit(0)))


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", encoding_stage),
]

#: Fingerprints, spaced seeds and subwords are not expressible in SQL; tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    folder, docs = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}", documents(spark, sf_dir)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
