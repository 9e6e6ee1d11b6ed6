"""Language identification by error-correcting output codes over hashed byte n-grams.

Every language gets a codeword of bits. For each bit a binary n-gram classifier is fitted: the log-ratio of
smoothed n-gram frequencies of the languages with that bit set against the others, from counts over all
training rows. A text gets one margin per bit, and the loss-weighted decoder takes the language whose codeword
has the least logistic loss against those margins, each bit's loss weighed by how often that classifier is right on
labelled rows of the language. When the two best losses are too close the result is flagged.

Defined results: null text or text without a letter -> ``und``, score 0, ambiguous. Repeated rows are scored
one by one. Without any labelled row every text is ``und``. With one learned language that language is taken.

The classifiers only say which learned language is nearest, so keys, base64 and languages never learned get one too.
Whether a text is in the language found is decided apart, by how usual its three-byte n-grams are there: the mean of
their log frequencies is set against mean and spread over the labelled rows of that language. A text is foreign
when it lies more than ``FOREIGN + FOREIGN_SHORT / sqrt(n)`` spreads below, with n its number of n-grams. Texts that
are ``und`` are foreign.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import map_texts

UNDETERMINED = "und"
ORDERS = (1, 2, 3)
BUCKETS = 4096
WIDTH = BUCKETS * len(ORDERS)
# spreads below the mean; none of the labelled rows of sf0.1 and check_s, junk among them, is below the bound
FOREIGN, FOREIGN_SHORT = 2.5, 6.0
# labelled rows, about so many by hash, on which the classifiers of the bits are rated
RATING_ROWS = 20_000
TYPICAL = slice(WIDTH - BUCKETS, WIDTH)  # n-grams of the largest order
# mixing factors of the n-gram positions; any odd numbers do
FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)
# ASCII that is not a letter carries no language: it becomes one separator
FOLD = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], dtype=np.uint8)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def gram_counts(text: str) -> np.ndarray:
    """Counts of hashed n-grams of the whole text, one block of buckets per order."""
    data = FOLD[np.frombuffer(text.lower().encode("utf-8", "replace"), dtype=np.uint8)]
    edge = np.array([32], dtype=np.uint8)
    data = np.concatenate([edge, data, edge])
    data = data[np.concatenate([[True], (data[1:] != 32) | (data[:-1] != 32)])].astype(np.uint32)
    buckets, mixed = [], np.zeros(len(data), dtype=np.uint32)
    for block, n in enumerate(ORDERS):  # consecutive from 1: each order adds one byte to the hashes of the order before
        mixed = (mixed[: max(0, len(data) - n + 1)] ^ data[n - 1 :]) * FACTORS[n - 1]
        mixed ^= mixed >> np.uint32(15)
        buckets.append((mixed >> np.uint32(20)) + np.uint32(block * BUCKETS))
    return np.bincount(np.concatenate(buckets), minlength=WIDTH)


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """Rows of +1/-1, one per language, chosen for a large least distance between rows.

    Up to five languages get all distinct splits in two; more get the best of random balanced codes.
    """
    if languages == 1:
        return np.ones((1, 1))
    if languages <= 5:
        splits = np.arange(1, 2 ** (languages - 1))
        bits = (splits[None, :] >> np.arange(languages)[:, None]) & 1
        return 1.0 - 2.0 * bits
    length = 8 * math.ceil(math.log2(languages)) + 7
    rng, best, reach = np.random.default_rng(seed), None, -1.0
    for _ in range(200):
        code = np.where(np.argsort(rng.random((languages, length)), axis=0) < languages // 2, 1.0, -1.0)
        near = (length - (code @ code.T - 2 * length * np.eye(languages))).min() / 2
        if near > reach:
            best, reach = code, near
    return best


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # float32, WIDTH x bits
    ambiguous_gap: float
    usual: np.ndarray  # languages x BUCKETS, log frequency of each n-gram in spreads from the language's mean
    trust: np.ndarray  # languages x bits, weight of each bit's loss; a language's weights average 1

    def margins(self, grams: np.ndarray) -> np.ndarray:
        return (grams @ self.weights) / np.sqrt(grams.sum(axis=1, keepdims=True))

    def scores(self, texts: list) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score in 0..1, ambiguity and whether it is foreign to that language, per text."""
        found = [UNDETERMINED] * len(texts)
        score, unsure = np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        foreign = np.ones(len(texts), dtype=bool)
        usable = [i for i, t in enumerate(texts) if has_letter(t)] if self.languages else []
        for part in range(0, len(usable), 256):
            rows = usable[part : part + 256]
            grams = np.stack([gram_counts(texts[i]) for i in rows]).astype(np.float32)
            margins = self.margins(grams)
            losses = (np.logaddexp(0.0, -margins[:, None, :] * self.code[None, :, :]) * self.trust[None, :, :]).sum(axis=2)
            order = np.argsort(losses, axis=1, kind="stable")
            least = np.take_along_axis(losses, order[:, :1], axis=1)
            share = np.exp(least - losses)
            share = 1.0 / share.sum(axis=1)
            second = np.take_along_axis(losses, order[:, 1:2], axis=1) if len(self.languages) > 1 else least + np.inf
            gap = (second - least)[:, 0]
            for k, i in enumerate(rows):
                found[i] = self.languages[order[k, 0]]
            score[rows] = share
            unsure[rows] = gap < self.ambiguous_gap
            parts, best = grams[:, TYPICAL], order[:, 0]
            count = np.maximum(parts.sum(axis=1), 1.0)
            mean = (parts * self.usual[best]).sum(axis=1) / count
            foreign[rows] = mean < -(FOREIGN + FOREIGN_SHORT / np.sqrt(count))
        return found, score, unsure, foreign


def gram_totals(rows: DataFrame, label: str, text: str) -> DataFrame:
    """(label, bucket, total): summed per task before the shuffle, so it moves labels x buckets per task."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if has_letter(body):
                    if lang not in sums:
                        sums[lang] = np.zeros(WIDTH, dtype=np.int64)
                    sums[lang] += gram_counts(body)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(total[at])],
                names=["label", "bucket", "total"],
            )

    chosen = rows.filter(F.col(label).isNotNull()).select(F.col(label).cast("string"), F.col(text).cast("string"))
    counted = chosen.mapInArrow(run, "label string, bucket int, total long")
    return counted.groupBy("label", "bucket").agg(F.sum("total").alias("total"))


def rated(model: LanguageModel, rows: DataFrame, label: str, text: str) -> LanguageModel:
    """``model`` with its bits weighed by their accuracy on about RATING_ROWS labelled rows.

    The sample is by hash of whole rows, so it is the same on a retry; languages x bits numbers reach the driver.
    A language without a sampled row trusts all bits alike.
    """
    places = {lang: i for i, lang in enumerate(model.languages)}
    labelled = rows.filter(F.col(label).isNotNull())
    step = max(1, labelled.count() // RATING_ROWS)
    hashed = [F.col(f"`{c}`") for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]
    sample = labelled.filter(F.pmod(F.xxhash64(*hashed), F.lit(step)) == 0)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        right = np.zeros(model_shape, dtype=np.int64)
        seen = np.zeros(model_shape[0], dtype=np.int64)
        for batch in batches:
            for lang, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if has_letter(body) and lang in places:
                    at = places[lang]
                    grams = gram_counts(body).astype(np.float32)[None, :]
                    right[at] += shared.value.margins(grams)[0] * shared.value.code[at] > 0
                    seen[at] += 1
        at = np.repeat(np.arange(model_shape[0]), model_shape[1])
        bits = np.tile(np.arange(model_shape[1]), model_shape[0])
        columns = [at.astype(np.int32), bits.astype(np.int32), right.ravel(), np.repeat(seen, model_shape[1])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["place", "bit", "right", "seen"])

    model_shape = model.code.shape
    chosen = sample.select(F.col(label).cast("string"), F.col(text).cast("string"))
    counted = chosen.mapInArrow(run, "place int, bit int, right long, seen long").groupBy("place", "bit")
    trust = np.ones(model_shape)
    for place, bit, right, seen in counted.agg(F.sum("right"), F.sum("seen")).collect():
        trust[place, bit] = (right + 1.0) / (seen + 2.0)
    return replace(model, trust=trust / trust.mean(axis=1, keepdims=True))


def fit(rows: DataFrame, label: str = "lang", text: str = "text", ambiguous_gap: float = 0.05) -> LanguageModel:
    """Counts n-grams of all ``rows`` and derives the bit classifiers.

    Only the totals (languages x WIDTH numbers, whatever the input size) reach the driver.
    """
    totals: dict[str, np.ndarray] = {}
    for lang, bucket, total in gram_totals(rows, label, text).collect():
        totals.setdefault(lang, np.zeros(WIDTH))[bucket] = total
    languages = sorted(totals)
    if not languages:
        return LanguageModel(
            [], np.ones((0, 1)), np.zeros((WIDTH, 1), dtype=np.float32), ambiguous_gap, np.zeros((0, BUCKETS)), np.ones((0, 1))
        )
    code = codewords(len(languages))
    # every language weighs the same, however many rows it has
    share = np.stack([totals[x] / max(totals[x].sum(), 1.0) for x in languages])
    smooth = 1e-6
    weights = np.zeros((WIDTH, code.shape[1]), dtype=np.float32)
    for bit in range(code.shape[1]):
        on, off = code[:, bit] > 0, code[:, bit] < 0
        if on.any() and off.any():
            weights[:, bit] = np.log(share[on].mean(axis=0) + smooth) - np.log(share[off].mean(axis=0) + smooth)
    common = share[:, TYPICAL] / np.maximum(share[:, TYPICAL].sum(axis=1, keepdims=True), smooth)
    logs = np.log(common + smooth)
    mean = (common * logs).sum(axis=1, keepdims=True)
    spread = np.sqrt((common * (logs - mean) ** 2).sum(axis=1, keepdims=True))
    # a language learned from a few equal n-grams has hardly a spread of its own
    usual = ((logs - mean) / np.maximum(spread, 1.0)).astype(np.float32)
    model = LanguageModel(languages, code, weights, ambiguous_gap, usual, np.ones(code.shape))
    return rated(model, rows, label, text)


def predict(
    docs: DataFrame,
    model: LanguageModel,
    columns: list[str],
    text: str = "text",
    names: tuple[str, ...] = ("lang_pred", "score", "ambiguous"),
) -> DataFrame:
    """``columns`` of every row with the language, the score and whether it is ambiguous, under ``names``.

    A fourth name adds whether the text is foreign to the language found.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x buckets, independent of the input

    def compute():
        def of_texts(texts):
            found, score, unsure, foreign = shared.value.scores(texts)
            made = [pa.array(found, pa.string()), pa.array(score, pa.float64()), pa.array(unsure), pa.array(foreign)]
            return made[: len(names)]

        return of_texts

    kinds = ("string", "double", "boolean", "boolean")
    fields = ", ".join(f"`{name}` {kind}" for name, kind in zip(names, kinds, strict=False))
    return map_texts(docs, columns, fields, compute, text)
