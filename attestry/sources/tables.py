"""Readers with explicit schemas: the given tables and the engine's own input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

GIVEN_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

CASE_DOCUMENTS_SCHEMA = (
    "case_id string, document_id string, document_type string, verification_id string, status string, "
    "document_revision int, uploaded_at timestamp, filename string, traveler_data map<string,string>, "
    "module_statuses map<string,string>"
)


#: Session setting: number of partitions that a scan is dealt over, 0 (default) for the scan's own. Meant for tables in
#: fewer row groups than the cluster has cores, where all the work behind a scan would else run in a few tasks. Tables in
#: many row groups need none, and the setting then only costs a shuffle of the columns that are read.
SPREAD = "spark.attestry.scan.partitions"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table; columns and filters still reach the scan where the setting deals its rows out."""
    partitions = int(spark.conf.get(SPREAD, "0"))
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    return rows.repartition(partitions) if partitions else rows


def load_case_documents(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Case documents from parquet or JSON, never inferring the schema."""
    return spark.read.schema(CASE_DOCUMENTS_SCHEMA).format(fmt).load(path)
