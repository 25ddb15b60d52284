"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated isotonically.

1. Each whole text gives a vector of statistics (lengths, repetition, character classes, lines): one pass, no shuffle.
2. Random Fourier features cos(Wx + b) approximate a Gaussian kernel over the standardised statistics.
3. Normal equations are summed by partition and then over partitions on the executors; the driver solves one D x D system.
4. Raw scores of training rows that the fit did not see are counted in a fixed number of bins; pooling adjacent violators over
   the bins gives a monotone map to a probability.

All labelled training rows take part; nothing the driver holds grows with the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.llm.common import Scratch, crc_mod, list_array, text_or_empty, text_slices, tree_sum

FEATURES = (
    "log_chars", "log_words", "word_length", "distinct_words", "repeats_next", "upper", "digits", "bangs", "bars", "symbols", "stops", "commas",
    "other_marks", "spaces", "high_bytes", "log_lines", "repeated_lines", "longest_word", "capital_words", "marked_words",
)
#: Random features, kernel width in units of the mean distance, ridge weight a row, bins of the calibration, seed.
DIM, WIDTH, RIDGE, BINS, SEED = 256, 1.0, 1e-4, 2_000, 11
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 4
THRESHOLD = 0.3

_CLASSES = np.zeros((256, 9))
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!", b"|", b"#$%&*@^~_=+<>{}[]\\", b".?", b",;:", b"\"'()-/`", b" \t\r\n")):
    _CLASSES[list(_chars), _k] = 1
_MARKS = set("!#$%&*@^~_=+<>{}[]\\|")


def statistics(text: str) -> list[float]:
    """The statistics of one whole text, in the order of FEATURES; an empty text has zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    n = int(counts.sum())
    shares = (counts @ _CLASSES) / n
    words = text.split()
    w = len(words) or 1
    kinds = set(words)
    lines = text.split("\n")
    return [
        np.log1p(n), np.log1p(w), len(text) / w, len(kinds) / w, sum(map(eq, words, words[1:])) / w, *shares[:9], counts[128:].sum() / n,
        np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), np.log1p(max(map(len, kinds), default=0)),
        sum(1 for x in kinds if x.isupper() and len(x) > 1) / (len(kinds) or 1), sum(1 for x in kinds if x[-1] in _MARKS) / (len(kinds) or 1),
    ]


def _statistics(texts: pa.Array) -> np.ndarray:
    return np.array([statistics(t) for some in text_slices(texts) for t in some], np.float32).reshape(-1, len(FEATURES))


def text_statistics(texts: pa.Array) -> pa.Array:
    """The statistics of each text. Only texts go to Python: ids and other columns stay where they are."""
    x = _statistics(texts)
    return list_array(x.ravel(), [len(FEATURES)] * len(x))


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x array<float>) of each row of docs (doc_id, text); null texts are empty ones, other columns are ignored."""
    return docs.select("doc_id", F.arrow_udf(text_statistics, "array<float>")(text_or_empty()).alias("x"))


@dataclass
class Model:
    """Means and spreads of the statistics, ridge weights of the random features, steps of the calibration."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    levels: np.ndarray

    def random_features(self, x: np.ndarray) -> np.ndarray:
        return random_features((x - self.mean) / self.spread)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), self.levels[0])
        raw = self.random_features(x) @ self.weights
        return np.clip(np.interp(raw, self.edges, self.levels), 0.0, 1.0)


def random_features(z: np.ndarray) -> np.ndarray:
    """cos(Wz + b) and a constant; W's rows are normal with the kernel's width, so inner products approximate the kernel."""
    rng = np.random.default_rng(SEED)
    w = rng.normal(0, WIDTH / np.sqrt(len(FEATURES)), (len(FEATURES), DIM))
    b = rng.uniform(0, 2 * np.pi, DIM)
    f = np.cos(np.clip(z, -8, 8) @ w + b) * np.sqrt(2 / DIM)
    return np.hstack([f, np.ones((len(z), 1))])


def isotonic(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the nondecreasing levels closest to sums/counts in weighted squares; a level for each entry."""
    blocks: list[list[float]] = []
    for s, n in zip(sums, counts, strict=True):
        blocks.append([s, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.concatenate([np.full(int(k), s / n) for s, n, k in blocks]) if blocks else np.zeros(0)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Statistics, sum and number of the labels of each row."""
    x = batch["x"].flatten().to_numpy().reshape(-1, len(FEATURES)).astype(float)
    return x, *(batch[c].to_numpy().astype(float) for c in ("ones", "n"))


def fit(labelled: DataFrame) -> Model:
    """A model from (x, ones, n, fold): n labels of 0 or 1 with the sum ``ones``. Rows of the calibration fold are kept for the calibration.

    Without labels of both classes every score is the share of ones (0.5 without labels).
    """
    d, k = len(FEATURES), DIM + 1

    def moments(batches):
        out = np.zeros((3, d + 1))
        for batch in batches:
            x, ones, n = _columns(batch)
            out[:, :d] += [np.full(d, n.sum()), n @ x, n @ (x * x)]
            out[0, d] += ones.sum()
        return out

    sums = tree_sum(labelled, moments, 3, d + 1)
    (n, s, q), ones = sums[:, :d], sums[0, d]
    if not n[0] or ones in (0, n[0]):
        return Model(np.zeros(d), np.ones(d), np.zeros(0), np.zeros(1), np.array([ones / n[0] if n[0] else 0.5]))
    mean = s / n
    spread = np.sqrt(np.maximum(q / n - mean**2, 0))
    base = Model(mean, np.where(spread < 1e-9, 1.0, spread), np.zeros(0), np.zeros(1), np.zeros(1))

    def normal(batches):
        out = np.zeros((k, k + 1))
        for batch in batches:
            x, ones, n = _columns(batch)
            f = base.random_features(x)
            out += f.T @ np.column_stack([f * n[:, None], ones])
        return out

    sums = tree_sum(labelled.where(F.col("fold") != CALIBRATION), normal, k, k + 1)
    rows = max(sums[-1, -2], 1.0)
    weights = np.linalg.solve(sums[:, :k] + RIDGE * rows * np.eye(k), sums[:, k])

    def counted(batches):
        out = np.zeros((2, BINS))
        for batch in batches:
            x, ones, n = _columns(batch)
            at = np.clip(((base.random_features(x) @ weights + 1) / 3 * BINS).astype(int), 0, BINS - 1)
            out += [np.bincount(at, ones, BINS), np.bincount(at, n, BINS)]
        return out

    unseen = labelled.where(F.col("fold") == CALIBRATION)
    sums, counts = tree_sum(unseen, counted, 2, BINS)
    if not counts.sum():
        sums, counts = tree_sum(labelled, counted, 2, BINS)
    at = np.flatnonzero(counts)
    return Model(base.mean, base.spread, weights, (at + 0.5) / BINS * 3 - 1, isotonic(sums[at], counts[at]))


def learn(stats: DataFrame, labels: DataFrame, scratch: Scratch, label: str = "quality") -> Model:
    """A model of the statistics (doc_id, x) of documents with labels (doc_id, ``label``), from the rows that may be learned from."""
    y = F.col(label).cast("double")
    known = labels.where(y.isNotNull() & (crc_mod("doc_id", FOLDS) != HELD_OUT)).groupBy("doc_id").agg(F.sum(y).alias("ones"), F.count("*").alias("n"))
    return fit(scratch.stage("labelled", known.join(stats, "doc_id").select("x", "ones", "n", crc_mod("doc_id", FOLDS).alias("fold"))))


def text_score(model: Model, text: Column) -> Column:
    """The score of a text, straight from it."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(_statistics(texts).astype(float)))

    return F.arrow_udf(run, "double")(text)


def statistics_score(model: Model, x: Column) -> Column:
    def run(xs: pa.Array) -> pa.Array:
        return pa.array(model.score(xs.flatten().to_numpy().reshape(-1, len(FEATURES)).astype(float)))

    return F.arrow_udf(run, "double")(x)


def score_documents(docs: DataFrame, labels: DataFrame, scratch: Scratch, label: str = "quality") -> DataFrame:
    """Score every row of docs (doc_id, text): doc_id, held_out, score (0 to 1), predicted (1 where score >= 0.3).

    Labels (doc_id, ``label``) are learned only where crc32(doc_id as text) mod 5 is not 0. Null labels and labels of unknown
    documents are ignored; repeated label rows weigh as often as they stand. Null and empty texts are scored like any other, texts of any length
    whole; a null doc_id is scored and never held out. Repeated documents keep their rows; no documents, no rows. Other columns are never inputs.
    """
    stats = scratch.stage("statistics", document_statistics(docs))
    scored = stats.select("doc_id", statistics_score(learn(stats, labels, scratch, label), F.col("x")).alias("score"))
    scratch.drop("labelled")
    held = F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def keep_accepted(docs: DataFrame, labels: DataFrame, scratch: Scratch, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs (doc_id, text and any others) whose score is at least ``threshold``, unchanged and unshuffled.

    Labels are learned as in ``score_documents``. Each text is gone through twice, once to learn and once to be judged, so that texts
    never travel. Null and empty texts are judged like any other; repeated rows all stay or all go; no documents, no rows.
    """
    stats = scratch.stage("statistics", document_statistics(docs))
    model = learn(stats, labels, scratch, label)
    scratch.drop("labelled", "statistics")
    return docs.where(text_score(model, text_or_empty()) >= threshold)
