"""Document quality from a linear-chain conditional random field over lines.

Each line with a word is good or bad.  A line's state depends on its own features, on those of the lines before and after it,
and on the neighbouring states.  Labels mark documents, not lines, so training starts with a line's document's label and then,
within bad documents, takes those lines for good that a classifier of single lines holds to be good.  The field's
marginals come from the forward-backward algorithm; a document's quality is their mean, weighted by length, calibrated to labels.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.llm.logistic import calibrate, fit, sigmoid
from gaugework.session import cut_lineage

SYMBOLS = "#*$%&|<>"
TRAINING_ROWS = 3_000  # labelled rows used at most, those with the smallest hash of doc_id
TRAINING_LINES = 600_000  # lines of all training rows at most; fewer rows are used then, but each as a whole
CALIBRATION = 3  # one row in so many is kept for calibration
ROUNDS = 150
PENALTY = 1e-3
OWN = 12  # features of a line
ROWS = 500  # texts that are searched together
FOLDS, HELD_OUT = 4, 2


@dataclass(frozen=True)
class LineField:
    """weights: of the standardised features, for state good; turns: [from, to]; rest: what a text without lines scores."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    intercept: float
    turns: np.ndarray
    slope: float
    shift: float
    rest: float

    def means(self, owns: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
        """Length-weighted mean of the lines' P(good) of each text; texts without lines are left out by the caller."""
        ends = np.cumsum([0, *map(len, sizes)])
        unary = (np.concatenate([around(x) for x in owns]) - self.mean) / self.spread @ self.weights + self.intercept
        weight = np.concatenate(sizes)
        good, _ = marginals(unary, ends, self.turns)
        return np.add.reduceat(good * weight, ends[:-1]) / np.add.reduceat(weight, ends[:-1])

    def scores(self, texts: list[str]) -> np.ndarray:
        found = [line_features(text) for text in texts]
        some = [i for i, (_, sizes) in enumerate(found) if len(sizes)]
        scores = np.full(len(texts), self.rest)
        if some:
            means = self.means([found[i][0] for i in some], [found[i][1] for i in some])
            scores[some] = sigmoid(self.slope * means + self.shift)
        return scores


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line with a word, and the lines' lengths."""
    rows, sizes, before = [], [], None
    for line in text.split("\n"):
        words = line.split()
        if not words:
            continue
        n, size = len(words), len(line)
        symbols = sum(map(line.count, SYMBOLS))
        upper = sum(map(str.isupper, words))
        most = Counter(words).most_common(1)[0][1]
        rows.append((
            min(n, 200) ** 0.5 / 10, min(size / n, 30) / 10, symbols / size, line.count("!") / size, upper / n,
            len(set(words)) / n, most / n if n > 3 else 0.0, float(line[-1] in ".!?"), float(line == before),
            sum(map(line.count, "0123456789")) / size, float("|" in words), sum(map(line.count, ".,")) / n,
        ))
        sizes.append(size)
        before = line
    return np.array(rows, np.float64).reshape(-1, OWN), np.array(sizes, np.float64)


def around(own: np.ndarray) -> np.ndarray:
    """Each line's features with those of its neighbours, and whether it has any."""
    n = len(own)
    blank = np.zeros((1, own.shape[1]))
    before, after = np.concatenate([blank, own[:-1]]), np.concatenate([own[1:], blank])
    ends = np.zeros((n, 2))
    ends[:1, 0] = ends[-1:, 1] = 1
    return np.concatenate([own, before, after, ends], axis=1)


def marginals(unary: np.ndarray, ends: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line and the expected turns, by forward-backward over all chains at once.

    ``ends`` holds where each chain begins, and the end of the last; no chain is empty.
    """
    sizes = np.diff(ends)
    order = np.argsort(-sizes, kind="stable")
    begins, sizes = ends[:-1][order], sizes[order]
    longest = int(sizes[0])
    active = np.searchsorted(-sizes, -np.arange(longest + 1), "left")  # chains with more than t lines
    peak = np.maximum(unary, 0)
    node = np.stack([np.exp(-peak), np.exp(unary - peak)], axis=1)
    step = np.exp(turns - turns.max())
    ahead, behind, scale = np.empty_like(node), np.ones_like(node), np.empty(len(unary))
    for t in range(longest):
        rows = begins[: active[t]] + t
        now = node[rows] if t == 0 else (ahead[rows - 1] @ step) * node[rows]
        scale[rows] = now.sum(1)
        ahead[rows] = now / scale[rows, None]
    for t in range(longest - 2, -1, -1):
        rows = begins[: active[t + 1]] + t
        behind[rows] = (node[rows + 1] * behind[rows + 1]) @ step.T / scale[rows + 1, None]
    both = ahead * behind
    inner = np.ones(len(unary), bool)
    inner[ends[1:] - 1] = False
    at = np.flatnonzero(inner)
    pairs = step * (ahead[at].T @ (node[at + 1] * behind[at + 1] / scale[at + 1, None]))
    return both[:, 1] / both.sum(1), pairs


def fitting(counts: list[tuple[int, int]], most: int) -> list[int]:
    """The first ids of (id, lines) whose lines are ``most`` together; one that has more on its own is passed over."""
    ids, total = [], 0
    for i, lines in counts:
        if lines > most:
            continue
        total += lines
        if total > most:
            break
        ids.append(i)
    return ids


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, lines: int = TRAINING_LINES) -> LineField:
    """A field learnt from whole texts of at most ``rows`` labelled documents outside the held-out fold, in order of their hash
    while their lines are at most ``lines`` together.  Null labels, ids and texts are not used.  Of several labels of a doc_id
    the smallest counts, of several texts the one whose features come first, whatever the order of rows."""
    marked = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where("quality IN (0, 1)").dropna()
    marked = marked.where(fold(F.col("doc_id")) != HELD_OUT).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = cut_lineage(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    texts = docs.select(F.col("doc_id").cast("long"), "text").dropna()
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n")))
    counts = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max(breaks + 1).alias("lines"))
    counts = [(r["doc_id"], r["lines"]) for r in counts.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    ids = fitting(counts, lines)
    chosen = chosen.where(F.col("doc_id").isin(ids)) if len(ids) < len(counts) else chosen

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = [], []
            for text in batch.column("text").to_pylist():
                own, lengths = line_features(text)
                found.append(own.astype("<f4").tobytes())
                sizes.append(lengths.astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), pa.array(found, pa.binary()), pa.array(sizes, pa.binary())],
                names=["doc_id", "quality", "found", "sizes"],
            )

    made = texts.join(F.broadcast(chosen), "doc_id").mapInArrow(run, "doc_id long, quality int, found binary, sizes binary")
    made = made.groupBy("doc_id", "quality").agg(F.min(F.struct("found", "sizes")).alias("first"))
    sample = [r for r in sorted(made.select("doc_id", "quality", "first.*").collect()) if r["sizes"]]
    owns = [np.frombuffer(r["found"], "<f4").reshape(-1, OWN).astype(np.float64) for r in sample]
    sizes = [np.frombuffer(r["sizes"], "<f4").astype(np.float64) for r in sample]
    return learn(owns, sizes, np.array([r["quality"] for r in sample], np.float64))


def learn(owns: list[np.ndarray], sizes: list[np.ndarray], quality: np.ndarray) -> LineField:
    width = 3 * OWN + 2
    if not len(quality):
        return LineField(np.zeros(width), np.ones(width), np.zeros(width), 0.0, np.zeros((2, 2)), 1.0, 0.0, 0.5)
    held = np.arange(len(quality)) % CALIBRATION == CALIBRATION - 1
    used = np.flatnonzero(~held) if (~held).any() else np.arange(len(quality))
    ends = np.cumsum([0, *(len(owns[i]) for i in used)])
    x = np.concatenate([around(owns[i]) for i in used])
    mean, spread = x.mean(0), x.std(0) + 1e-6
    x = (x - mean) / spread
    y = np.repeat(quality[used], np.diff(ends))
    weights, intercept = fit(x, y)
    doubtful = sigmoid(x @ weights + intercept) > 0.5
    for i, low, high in zip(used, ends[:-1], ends[1:]):
        if not quality[i] and not doubtful[low:high].all():
            y[low:high] = doubtful[low:high]
    weights, intercept, turns = _train_field(x, y, ends, weights, intercept)
    field = LineField(mean, spread, weights, intercept, turns, 1.0, 0.0, 0.5)
    means = field.means(owns, sizes)
    pick = held if held.any() else ~held
    slope, shift = calibrate(means[pick], quality[pick])
    return LineField(mean, spread, weights, intercept, turns, slope, shift, float(quality.mean()))


def _train_field(x, y, ends, weights, intercept):
    """Most likely weights under a penalty, by Adam steps over all lines; each chain's gradient is expected less seen."""
    turns = np.zeros((2, 2))
    good = y.astype(int)
    seen = np.zeros((2, 2))
    for low, high in zip(ends[:-1], ends[1:]):
        np.add.at(seen, (good[low : high - 1], good[low + 1 : high]), 1)
    at = np.concatenate([weights, [intercept], turns.ravel()])
    first, second, d, n = np.zeros_like(at), np.zeros_like(at), x.shape[1], len(y)
    for i in range(1, ROUNDS + 1):
        p, pairs = marginals(x @ at[:d] + at[d], ends, at[d + 1 :].reshape(2, 2))
        error = p - y
        slope = np.concatenate([error @ x, [error.sum()], (pairs - seen).ravel()]) / n + PENALTY * at
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope * slope
        at = at - 0.05 * (first / (1 - 0.9**i)) / (np.sqrt(second / (1 - 0.99**i)) + 1e-8)
    return at[:d], float(at[d]), at[d + 1 :].reshape(2, 2)


def score_quality(docs: DataFrame, field: LineField, into: str = "score") -> DataFrame:
    """``docs`` with the probability of good quality.  A null text or one without words gets the share of good training
    documents.  All rows and columns stay; a column of that name is replaced."""
    def run(texts: pa.Array) -> pa.Array:
        parts = [texts.slice(low, ROWS).to_pylist() for low in range(0, len(texts), ROWS)]
        scores = [field.scores([text or "" for text in part]) for part in parts]
        return pa.array(np.concatenate([*scores, np.zeros(0)]), pa.float64())

    return docs.withColumn(into, F.arrow_udf(run, "double")("text"))
