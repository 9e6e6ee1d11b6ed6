"""Stored registry and ledger tables: parquet, one folder per document type or append-only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions import text
from attestry.operators.registry import protect_registry, reveal_registry


def write_registry(records: DataFrame, path: str, secret: bytes, cipher_key: bytes) -> None:
    """Protected records, one partition per document type."""
    protect_registry(records, secret, cipher_key).write.mode("overwrite").partitionBy("document_type").parquet(path)


def scan_registry_by_type(spark: SparkSession, path: str, kind: str, cipher_key: bytes) -> DataFrame:
    """All records of one type, decrypted; other partitions are not read."""
    return reveal_registry(spark.read.parquet(path).filter(F.col("document_type") == kind), cipher_key)


def purge_registry_type(spark: SparkSession, paths: list[str], kind: str) -> int:
    """Drops one type's partition from every registry table and returns the number of records."""
    removed = 0
    for path in paths:
        removed += spark.read.parquet(path).filter(F.col("document_type") == kind).count()
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/document_type={kind}")
        system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        system.delete(folder, True)
    return removed


def append_ledger(blocks: DataFrame, path: str) -> None:
    """Adds blocks; targets spread over buckets so that a read of one target is pruned."""
    bucketed = blocks.withColumn("bucket", F.pmod(F.xxhash64("target_id"), F.lit(256)))
    bucketed.write.mode("append").partitionBy("bucket").parquet(path)


def read_ledger(spark: SparkSession, path: str, target_id: int | None = None) -> DataFrame:
    """The whole ledger, or the blocks of one target."""
    blocks = spark.read.parquet(path)
    if target_id is None:
        return blocks.drop("bucket")
    key = F.lit(target_id).cast(blocks.schema["target_id"].dataType)
    # the bucket is a constant once folded, which prunes the partitions
    return blocks.filter((F.col("bucket") == F.pmod(F.xxhash64(key), F.lit(256))) & (F.col("target_id") == key)).drop("bucket")


def load_registry_table(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """An official or watchlist table with an explicit schema and canonical document types."""
    rows = spark.read.schema(schema).format(fmt).load(path)
    return rows.withColumn("document_type", text.document_type(F.col("document_type")))
