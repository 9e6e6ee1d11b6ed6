"""Face verification over tables of pairs; embeddings are inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.text import case_when
from attestry.operators.ranking import distinct_in_order
from attestry.operators.risk import rounded

THRESHOLD, ELEVATED_THRESHOLD, MARGIN = 0.40, 0.48, 0.06
GEOMETRY_TOLERANCE = 0.18


def cosine(a: Column, b: Column) -> Column:
    """Cosine clipped to [0, 1]; NULL for a missing or zero vector."""
    def dot(x, y):
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / norms)))


def geometry_consistent(a: Column, b: Column) -> Column:
    """Relative difference of two face ratios within tolerance; unknown ratios do not object."""
    return F.coalesce(~((a > 0) & (b > 0)) | (F.abs(a - b) / F.greatest(a, b) <= GEOMETRY_TOLERANCE), F.lit(True))


def fused(total: Column, rigid: Column, core: Column, light: Column, consistent: Column) -> Column:
    """Weighted mix of several representations, never below the global similarity."""
    whole = F.coalesce(total, F.lit(0.0))
    r, c, i = (F.coalesce(x, whole) for x in (rigid, core, light))
    mixed = 0.35 * r + 0.35 * c + 0.20 * i + 0.10 * whole
    boosted = F.greatest(whole, mixed, 0.45 * r + 0.45 * c + 0.10 * i)
    return F.when(consistent & (F.greatest(r, c) >= 0.36), boosted).otherwise(F.greatest(whole, mixed))


def decide(pairs: DataFrame) -> DataFrame:
    """Status and confidence from ``similarity`` and ``elevated``."""
    s = F.col("similarity")
    t = F.when(F.col("elevated"), ELEVATED_THRESHOLD).otherwise(THRESHOLD)
    low = F.greatest(F.lit(0.0), t - MARGIN)
    match = 0.76 + F.least(F.lit(0.23), (s - t) / F.greatest(0.60 - t, F.lit(0.05)) * 0.23)
    unsure = 0.50 + (s - low) / F.greatest(t - low, F.lit(0.01)) * 0.24
    other = F.greatest(F.lit(0.05), s / F.greatest(low, F.lit(0.01)) * 0.49)
    return pairs.withColumns(
        {
            "threshold": t,
            "status": case_when([(s.isNull(), "unavailable"), (s >= t, "match"), (s >= low, "inconclusive")], "no_match"),
            "confidence": rounded(case_when([(s >= t, match), (s >= low, unsure), (s < low, other)]), 4),
        }
    )


def _with_vectors(pairs: DataFrame, embeddings: DataFrame) -> DataFrame:
    vectors = embeddings.select("vec_id", "embedding")
    document = vectors.select(F.col("vec_id").alias("document_id"), F.col("embedding").alias("document_vector"))
    live = vectors.select(F.col("vec_id").alias("live_id"), F.col("embedding").alias("live_vector"))
    return pairs.join(document, "document_id", "left").join(live, "live_id", "left")


def face_verify(pairs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """1:1 verification of every pair at the standard threshold."""
    rows = _with_vectors(pairs, embeddings).withColumn(
        "similarity", rounded(cosine(F.col("document_vector"), F.col("live_vector")), 4)
    )
    return decide(rows.withColumn("elevated", F.lit(False))).select(
        "document_id", "live_id", "similarity", "threshold", "status", "confidence"
    )


def elevated_documents(evidence: DataFrame) -> DataFrame:
    """Documents whose validation or forensic evidence asks for the stricter threshold, with the distinct reasons.

    Reasons name module and signal; validation comes before forensics, else they keep the order of the evidence.
    """
    serious = F.col("module").isin("M2", "M3") & F.col("severity").isin("CRITICAL", "HIGH")
    found = evidence.filter(F.col("available") & (serious | (F.col("signal") == "forensic_high_concern")))
    module = case_when([(F.col("module") == "M2", "m2_validation"), (F.col("module") == "M3", "m3_forensics")], F.col("module"))
    rank = case_when([(F.col("module") == "M2", 0), (F.col("module") == "M3", 1)], 2)
    reasons = distinct_in_order(found, ["case_id"], F.concat(module, F.lit(": "), F.col("signal")), F.struct(rank, "item_seq"), "reasons")
    # evidence without a readable reason still raises the threshold
    return found.select("case_id").distinct().join(reasons, "case_id", "left").select(F.col("case_id").alias("document_id"), "reasons")


def face_verify_elevated(pairs: DataFrame, embeddings: DataFrame, evidence: DataFrame) -> DataFrame:
    """As ``face_verify`` with the threshold raised for documents under suspicion, and the reasons for it."""
    flagged = elevated_documents(evidence).withColumn("elevated", F.lit(True))
    rows = _with_vectors(pairs, embeddings).join(flagged, "document_id", "left").withColumns(
        {
            "elevated": F.coalesce("elevated", F.lit(False)),
            "reasons": F.coalesce(F.array_join("reasons", "; "), F.lit("")),
            "similarity": rounded(cosine(F.col("document_vector"), F.col("live_vector")), 4),
        }
    )
    return decide(rows).select("document_id", "live_id", "elevated", "reasons", "similarity", "threshold", "status", "confidence")


def face_verify_fused(pairs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Fusion of whole, rigid, core and light-normalised parts of each vector."""
    rows = _with_vectors(pairs, embeddings)
    a, b = F.col("document_vector"), F.col("live_vector")

    def part(start: int, length: int) -> Column:
        return cosine(F.slice(a, start, length), F.slice(b, start, length))

    rows = rows.withColumns({"whole": cosine(a, b), "rigid": part(1, 32), "core": part(17, 32), "light": part(33, 32)})
    consistent = geometry_consistent(F.col("document_ratio"), F.col("live_ratio"))
    similarity = fused(F.col("whole"), F.col("rigid"), F.col("core"), F.col("light"), consistent)
    rows = rows.withColumn("similarity", F.when(F.col("whole").isNotNull(), rounded(similarity, 4)))
    return decide(rows.withColumn("elevated", F.lit(False))).select(
        "document_id", "live_id", rounded(F.col("whole"), 4).alias("global_similarity"), "similarity", "status", "confidence",
        F.when(F.col("similarity").isNotNull(), F.col("similarity") > rounded(F.col("whole"), 4) + 0.02).alias("fusion_gain"),
    )
