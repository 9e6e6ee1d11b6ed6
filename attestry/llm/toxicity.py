"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: density of lexicon words (a short fixed list and terms learned from labelled rows),
the share of lexicon words close to a second-person word, capitals, punctuation, and obfuscation (letters mixed
with digits or symbols, lexicon words found only after undoing that, letters repeated). The labelled rows are
split in three: terms of the lexicon come from one part, the trees are fitted on the second, the calibration on
the third, so no stage sees its own training rows. Each part is a hash sample of at most about ``SAMPLE_ROWS``
rows; trees and calibration are those of Spark's own library.

Defined results: every row gets a score from 0 to 1, null and empty texts that of all-zero features; repeated
rows score the same. Without rows of both labels the score is the share of label 1 (0 without labels). Labels
that are null are ignored; a document labelled twice counts as toxic if any of its labels says so.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import checkpointed, map_texts

#: Bound on the labelled rows that each of the three fits reads.
SAMPLE_ROWS = 6_000
#: Bound on the learned lexicon.
LEXICON_TERMS = 5_000
THRESHOLD = 0.3

# Insults and second-person words.
INSULTS = (
    "idiot", "idiots", "moron", "stupid", "dumb", "loser", "losers", "trash", "scum", "pathetic", "worthless",
    "disgusting", "clown", "garbage", "vermin", "filth", "imbecile", "ugly", "hate", "kill", "shut", "damn",
)
SECOND_PERSON = (
    "you", "your", "yours", "yourself", "u", "ur", "youre", "du", "dich", "dir", "dein", "deine", "ihr", "euch",
    "tu", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "tú", "ti", "te", "usted", "ustedes", "vosotros",
)
UNDO = str.maketrans("013457@$!*", "oieastasi_")
WORD = re.compile(r"[^\W_]+(?:[*@$!'][^\W_]+)*")
REPEATED = re.compile(r"([^\W\d_])\1\1")
MIXED = re.compile(r"[^\W\d_][\d*@$!]+[^\W\d_]")
PREFIXES = range(4, 8)
NEAR = 4
FEATURES = (
    "log_words", "fixed_density", "learned_density", "prefix_density", "fixed_hits", "learned_hits", "prefix_hits",
    "near_second_person", "second_person_rate", "capitals", "capital_words", "exclamation", "question", "punctuation",
    "mixed_words", "obfuscated_density", "repeated_letters",
)


def terms_of(text: str) -> set[str]:
    """Distinct words, and their beginnings marked by a trailing hyphen."""
    words = set(WORD.findall(text.lower()))
    return words | {w[:n] + "-" for w in words for n in PREFIXES if len(w) > n}


@dataclass(frozen=True)
class Lexicon:
    learned: frozenset
    prefixes: frozenset

    def features(self, text: str | None) -> list[float]:
        if not text:
            return [0.0] * len(FEATURES)
        raw = WORD.findall(text)
        words = [w.lower() for w in raw]
        count = max(len(words), 1)
        learned, prefixes, fixed = self.learned, self.prefixes, _INSULTS
        hits, n_fixed, n_learned, n_prefix, obfuscated, mixed = [], 0, 0, 0, 0, 0
        for at, w in enumerate(words):
            a, b = w in fixed, w in learned
            c = any(w[:n] in prefixes for n in PREFIXES if len(w) > n)
            n_fixed, n_learned, n_prefix = n_fixed + a, n_learned + b, n_prefix + c
            if not w.isalpha() and MIXED.search(w):
                mixed += 1
                plain = w.translate(UNDO)
                if plain in fixed or plain in learned:
                    obfuscated += 1
                    a = True
            if a or b or c:
                hits.append(at)
        second = np.array([at for at, w in enumerate(words) if w in _SECOND], dtype=np.int64)
        near = 0.0
        if hits and len(second):
            place = np.searchsorted(second, hits)
            after = second[np.minimum(place, len(second) - 1)] - hits
            before = hits - second[np.maximum(place - 1, 0)]
            near = float(((np.abs(after) <= NEAR) | (np.abs(before) <= NEAR)).mean())
        letters = max(sum(map(len, raw)), 1)
        upper = sum(len(w) for w in raw if len(w) > 1 and w.isupper())
        capitals = sum(map(str.isupper, text))
        size = len(text)
        spaces = text.count(" ") + text.count("\n") + text.count("\t")
        return [
            float(np.log1p(len(words))), n_fixed / count, n_learned / count, n_prefix / count,
            float(np.log1p(n_fixed)), float(np.log1p(n_learned)), float(np.log1p(n_prefix)), near, len(second) / count,
            capitals / letters, upper / letters, text.count("!") / size, text.count("?") / size,
            max(size - spaces - sum(map(len, raw)), 0) / size, mixed / count, obfuscated / count,
            len(REPEATED.findall(text)) / count,
        ]


_INSULTS, _SECOND = frozenset(INSULTS), frozenset(SECOND_PERSON)


def bounded(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """All rows, or a hash sample of about ``bound`` of them."""
    total = rows.count()
    return rows if total <= bound else rows.filter(F.pmod(F.xxhash64(key), F.lit(total)) < bound)


def learn_lexicon(rows: DataFrame, label: str = "label", text: str = "text") -> Lexicon:
    """Terms whose share among toxic rows is far above that among the others; counted per task, then summed."""

    def count(batches):
        seen = {0: Counter(), 1: Counter()}
        for batch in batches:
            for y, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[y].update(terms_of(body or ""))
        terms = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), pa.array([seen[1][t] for t in terms], pa.int64()), pa.array([seen[0][t] for t in terms], pa.int64())],
            names=["term", "toxic", "clean"],
        )

    counts = rows.select(label, text).mapInArrow(count, "term string, toxic long, clean long")
    summed = counts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    sizes = rows.groupBy(label).count().collect()
    n = {r[0]: r[1] for r in sizes}
    lift = ((F.col("toxic") + 0.5) / (n.get(1, 0) + 1)) / ((F.col("clean") + 0.5) / (n.get(0, 0) + 1))
    chosen = summed.filter(F.col("toxic") >= 3).withColumn("lift", lift).filter("lift >= 8")
    terms = [r.term for r in chosen.orderBy(F.desc("lift"), "term").limit(LEXICON_TERMS).collect()]
    return Lexicon(
        frozenset(t for t in terms if not t.endswith("-")), frozenset(t[:-1] for t in terms if t.endswith("-"))
    )


def with_features(docs: DataFrame, columns: list[str], lexicon: Lexicon, text: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # at most LEXICON_TERMS terms

    def compute():
        return lambda texts: [pa.array([shared.value.features(t) for t in texts], pa.list_(pa.float64()))]

    made = map_texts(docs, columns, "__features array<double>", compute, text)
    return made.select(*columns, array_to_vector("__features").alias("features"))


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: Lexicon
    trees: object | None
    calibration: object | None
    base: float

    def score(self, docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
        """``columns`` of every row and ``score``."""
        if self.trees is None:
            return docs.select(*columns, F.lit(self.base).alias("score"))
        raw = _raw(self.trees, with_features(docs, columns, self.lexicon, text))
        if self.calibration is None:
            return raw.select(*columns, F.col("__raw").alias("score"))
        steps = self.calibration.transform(raw)
        # within a step of the calibration the uncalibrated score keeps the order, at a thousandth of its weight
        score = F.col("__step") * 0.999 + F.col("__raw") * 0.001
        return steps.select(*columns, F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("score"))


def _raw(trees, features: DataFrame) -> DataFrame:
    return trees.transform(features).withColumn("__raw", vector_to_array("__probability")[1])


def fit(labelled: DataFrame, part: str, text: str = "text", sample: int = SAMPLE_ROWS) -> ToxicityModel:
    """``labelled`` has ``label`` (0/1), the text, ``doc_id`` and ``part``: 0, 1 or 2 for the three fits."""
    base = labelled.agg(F.avg("label")).first()[0] or 0.0
    rows = labelled.select("doc_id", "label", text, part)
    lexicon = learn_lexicon(bounded(rows.filter(F.col(part) == 0), "doc_id", sample), text=text)

    def fold(n: int) -> DataFrame:
        chosen = bounded(rows.filter(F.col(part) == n), "doc_id", sample)
        made = with_features(chosen, ["label"], lexicon, text).withColumn("label", F.col("label").cast("double"))
        return checkpointed(made.repartition(4))

    train, check = fold(1), fold(2)
    if train.select("label").distinct().count() < 2:
        return ToxicityModel(lexicon, None, None, float(base))
    boosting = GBTClassifier(maxIter=25, maxDepth=4, stepSize=0.2, minInstancesPerNode=4, seed=1)
    boosting = boosting.setProbabilityCol("__probability").setRawPredictionCol("__margin").setPredictionCol("__class")
    trees = boosting.fit(train)
    calibration = None
    if check.select("label").distinct().count() == 2:
        isotonic = IsotonicRegression(featuresCol="__raw", labelCol="label", predictionCol="__step")
        calibration = isotonic.fit(_raw(trees, check).select("__raw", "label"))
    return ToxicityModel(lexicon, trees, calibration, float(base))


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with their label; repeated documents keep one row per document row."""
    one = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    one = one.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    return docs.select("doc_id", "text").join(one, "doc_id")
