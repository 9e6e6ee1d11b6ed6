"""Intake of uploaded files: size and type by content, with a reason for each rejection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions.text import case_when

MAX_BYTES = 10 * 1024 * 1024
ALLOWED = ("image/jpeg", "image/png", "image/webp")
# Leading bytes (hex) of the types that are told apart.
MAGIC = {
    "FFD8FF": "image/jpeg",
    "89504E470D0A1A0A": "image/png",
    "25504446": "application/pdf",
    "47494638": "image/gif",
}


def intake_manifest(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) manifests of a folder. No image is decoded.

    The file's own bytes decide the type; the name is not trusted. A first read looks at
    names and lengths only, so that oversized files are never loaded.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    oversized = files.filter(F.col("length") > MAX_BYTES).select("path", "length", F.lit(None).cast("string").alias("mime"))
    small = files.filter(F.col("length") <= MAX_BYTES)
    head = F.hex(F.substring("content", 1, 12))
    webp = head.startswith("52494646") & F.substring(head, 17, 8).eqNullSafe("57454250")
    mime = case_when([(head.startswith(h), kind) for h, kind in MAGIC.items()] + [(webp, "image/webp")])
    typed = small.select("path", "length", mime.alias("mime"), F.sha2("content", 256).alias("content_hash"))
    reason = case_when([(F.col("mime").isNull(), "UNRECOGNISED_FORMAT"), (~F.col("mime").isin(*ALLOWED), "TYPE_NOT_ALLOWED")])
    judged = typed.withColumn("reason", reason)
    rejected = judged.filter(F.col("reason").isNotNull()).select("path", "length", "mime", "reason")
    too_large = oversized.withColumn("reason", F.lit("FILE_TOO_LARGE"))
    return judged.filter(F.col("reason").isNull()).drop("reason"), rejected.unionByName(too_large)
