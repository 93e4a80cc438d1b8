"""Quality rules: counts with fixed limits, and a calibrated model on hashed n-grams.

The model is a logistic regression on hashed words, word pairs and character triples, trained on rows that labels mark, and
calibrated on labelled rows it was not trained on.  Documents are scored in Arrow batches against a fixed threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.llm.common import WordHasher, mixed, shingles
from gaugework.llm.logistic import calibrate, fit, sigmoid

SYMBOLS = "#*$%&|<>"
BLANK_CHARACTERS = " \t\n\v\f\r"
LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of words in repeated windows
BUCKETS = 2048  # of each family of n-grams
FAMILIES = 3
TRAINING_ROWS = 3_000  # labelled rows used at most, those with the smallest hash of doc_id
CALIBRATION = 3  # one row in so many is kept for calibration
THRESHOLD = 0.5  # a calibrated probability of good quality below it rejects


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    intercept: float
    slope: float
    shift: float

    def score(self, features: np.ndarray) -> float:
        return float(sigmoid(self.slope * (features @ self.weights + self.intercept) + self.shift))


def rule_counts(text: str, hashes: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    lines = [line for line in text.split("\n") if line.strip(BLANK_CHARACTERS)]
    repeated = 0
    if len(hashes) >= 3:
        _, which, times = np.unique(shingles(hashes, 3), return_inverse=True, return_counts=True)
        change = np.zeros(len(hashes) + 1, np.int64)
        starts = np.flatnonzero(times[which] > 1)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + 3, -1)
        repeated = int((np.cumsum(change[:-1]) > 0).sum())
    blanks = sum(map(text.count, BLANK_CHARACTERS))
    return len(hashes), len(text) - blanks, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


def features(text: str, hashes: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed words, word pairs and character triples."""
    letters = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    triples = letters[:-2] * np.uint64(0x100000001B3) + letters[1:-1] * np.uint64(0x1000193) + letters[2:]
    pairs = shingles(hashes, 2) if len(hashes) > 1 else hashes[:0]
    found = np.zeros(FAMILIES * BUCKETS)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    for i, grams in enumerate((mixed(hashes), pairs, mixed(triples))):
        if len(grams):
            found[i * BUCKETS : (i + 1) * BUCKETS] = np.bincount((grams >> shift).astype(np.int64), minlength=BUCKETS) / len(grams)
    return np.sqrt(found)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> QualityModel:
    """A model of quality 1 against 0 from at most ``rows`` labelled documents.  Null labels, ids and texts are not used;
    without both classes each document scores 0.5 or its class.  Of several labels of a doc_id the smallest counts, of
    several texts the one whose features come first, so the model does not depend on the order of rows."""
    marked = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where("quality IN (0, 1)").dropna()
    chosen = marked.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHasher()
        for batch in batches:
            at, values = [], []
            for text in batch.column("text").to_pylist():
                found = features(text, known.of(text.encode()))
                held = np.flatnonzero(found)
                at.append(held.astype("<u2").tobytes())
                values.append(found[held].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), pa.array(at, pa.binary()), pa.array(values, pa.binary())],
                names=["doc_id", "quality", "at", "found"],
            )

    texts = docs.select(F.col("doc_id").cast("long"), "text").dropna()
    rows_of = texts.join(F.broadcast(chosen), "doc_id").mapInArrow(run, "doc_id long, quality int, at binary, found binary")
    rows_of = rows_of.groupBy("doc_id", "quality").agg(F.min(F.struct("at", "found")).alias("first")).select(
        "doc_id", "quality", "first.*"
    )
    sample = sorted((r["doc_id"], r) for r in rows_of.collect())
    x = np.zeros((len(sample), FAMILIES * BUCKETS), np.float32)
    for row, (_, r) in zip(x, sample):
        row[np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["found"], "<f4")
    y = np.array([r["quality"] for _, r in sample], np.float64)
    held = np.arange(len(y)) % CALIBRATION == CALIBRATION - 1
    weights, intercept = fit(x[~held], y[~held])
    slope, shift = calibrate(x[held] @ weights + intercept, y[held])
    return QualityModel(weights, intercept, slope, shift)


def quality_rules(
    docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD, into: str = "quality"
) -> DataFrame:
    """``docs`` with a struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score and kept.

    A null text has no words and fails.  All rows and columns stay; a column named ``into`` is replaced.
    """
    known = WordHasher()

    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts.to_pylist():
            text = text or ""
            hashes = known.of(text.encode())
            counts = rule_counts(text, hashes)
            failed = counts[0] < LEAST_WORDS or 100 * counts[4] > MOST_REPEATED * counts[0]
            score = model.score(features(text, hashes))
            rows.append((*counts, failed, score, not failed and score >= threshold))
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
        columns = zip(*rows) if rows else [()] * len(names)
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    schema = (
        "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
        "score double, kept boolean"
    )
    return docs.withColumn(into, F.arrow_udf(run, schema)("text"))
