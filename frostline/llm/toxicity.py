"""Toxicity classifier with counterfactual regularisation.

A document's features are the words in it, their first four and their first five letters (present or not). Features are chosen by
a likelihood ratio over labelled documents, and a logistic model is fitted by Newton steps whose sums are formed by partition.

Counterfactuals: in each labelled sentence that names a group, the identity term is swapped for another of its set (each set
holds a neutral term too). The change d of the sentence's features must not move its score: the loss carries MU/2 times the sum of
(w.d)^2, a quadratic form whose matrix is summed by partition like the Hessian. So a group's name alone does not make a
neutral sentence look toxic, however often it stands in toxic ones.

The sets of identity terms are a parameter; IDENTITY is what stands in for them.

Training rows are a bounded sample (MAX_LABELLED); every document is scored over its whole text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm.common import Scratch, crc_mod, list_array, maybe_broadcast, text_or_empty, text_slices, tree_sum

#: Sets of identity terms that can stand for each other; the first of a set is its neutral term. Fixed values.
IDENTITY = (
    ("people", "women", "men", "girls", "boys", "muslims", "christians", "jews", "hindus", "atheists", "gays", "lesbians", "immigrants", "refugees", "africans", "asians", "europeans", "mexicans"),
    ("person", "woman", "man", "girl", "boy", "muslim", "christian", "jew", "hindu", "atheist", "lesbian", "immigrant", "refugee", "african", "asian", "european", "mexican"),
    ("local", "gay", "black", "white", "jewish", "trans", "disabled", "deaf", "blind", "old", "young", "foreign"),
    ("leute", "frauen", "männer", "juden", "muslime", "christen", "ausländer", "flüchtlinge"),
    ("gens", "femmes", "hommes", "juifs", "musulmans", "chrétiens", "étrangers", "réfugiés"),
    ("gente", "mujeres", "hombres", "judíos", "musulmanes", "cristianos", "extranjeros", "refugiados"),
)
MAX_LABELLED, CHOSEN, RIDGE, MU, STEPS = 40_000, 256, 0.1, 50.0, 10
FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7
MEMO = 200_000
_EDGE = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127), *range(0xA1, 0xC0)]))
_SENTENCE = re.compile(r"[.!?\n]+")


def features_of(word: str) -> tuple[int, ...]:
    """The features of one lower-case word, as 32-bit hashes; words of under three letters have none."""
    word = word.strip(_EDGE)
    if len(word) < 3:
        return ()
    return tuple({zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in ("w" + word, "4" + word[:4], "5" + word[:5])})


class Memo(dict):
    def __init__(self, keep=None):
        super().__init__()
        self.keep = keep

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > MEMO:
            self.clear()
        out = features_of(word)
        self[word] = out if self.keep is None else tuple(self.keep[x] for x in out if x in self.keep)
        return self[word]


def present(text: str, memo: Memo) -> set[int]:
    return {f for w in set(text.lower().split()) for f in memo[w]}


def swaps_of(sets: tuple[tuple[str, ...], ...]) -> dict[str, tuple[str, ...]]:
    """What each term may be swapped for, its set's neutral term first."""
    return {t: tuple(x for x in group if x != t) for group in sets for t in group}


def swapped(text: str, swaps: dict[str, tuple[str, ...]]) -> Iterator[tuple[list[str], list[str]]]:
    """The words of each sentence that names a group, and the same with its identity terms swapped for others of their sets."""
    low = text.lower()
    for sentence in _SENTENCE.split(low):
        words = [w.strip(_EDGE) for w in sentence.split()]
        if any(w in swaps for w in words):
            turn = zlib.crc32(sentence.encode("utf-8", "surrogatepass"))
            yield words, [swaps[w][0] if w in swaps and turn % 2 else swaps[w][turn % len(swaps[w])] if w in swaps else w for w in words]


@dataclass
class Model:
    chosen: dict[int, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def score(self, at: list[set[int]]) -> np.ndarray:
        z = np.array([self.weights[-1] + sum(self.weights[k] for k in x) for x in at])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def choose_features(labelled: DataFrame, swaps: dict[str, tuple[str, ...]], n: int = CHOSEN) -> dict[int, int]:
    """The features whose presence tells most about the label (likelihood ratio), and every identity term's own word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, seen = Memo(), (Counter(), Counter())
        for batch in batches:
            k, labels = 0, [batch[c].to_pylist() for c in ("ones", "n")]
            for some in text_slices(batch["text"]):
                for text in some:
                    have, ones, of = present(text, memo), int(labels[0][k]), labels[1][k]
                    for kind, times in ((0, of - ones), (1, ones)):
                        for f in have if times else ():
                            seen[kind][f] += times
                    k += 1
        keys = list(seen[0].keys() | seen[1].keys())
        for at in range(0, len(keys), 100_000):
            some = keys[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (some, [seen[0][k] for k in some], [seen[1][k] for k in some])], ["f", "clean", "toxic"])

    clean, toxic = labelled.agg(F.sum(F.col("n") - F.col("ones")), F.sum("ones")).first()
    c, t = F.col("clean"), F.col("toxic")
    counts = labelled.mapInArrow(count, "f long, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    share = (c + t) / float(clean + toxic)
    term = lambda k, n: k * F.log((k + 0.1) / (n * share + 0.1)) + (n - k) * F.log((n - k + 0.1) / (n * (1 - share) + 0.1))
    best = counts.where(c + t > 1).withColumn("g", term(t, float(toxic)) + term(c, float(clean))).orderBy(F.desc("g"), "f").limit(n).select("f").collect()
    own = [zlib.crc32(("w" + w).encode()) for w in swaps]
    return {f: k for k, f in enumerate(dict.fromkeys([*(r["f"] for r in best), *own]))}


def fit(labelled: DataFrame, scratch: Scratch, mu: float = MU, n: int = CHOSEN, sets: tuple[tuple[str, ...], ...] = IDENTITY) -> Model:
    """A model from (text, ones, n): n labels of 0 or 1 with the sum ``ones``. Without labels of both classes every score is the share of ones (0.5 without labels)."""
    ones, of = labelled.agg(F.sum("ones"), F.sum("n")).first()
    if not of or ones in (0, of):
        share = min(max(ones / of if of else 0.5, 1e-6), 1 - 1e-6)
        return Model({}, np.array([np.log(share / (1 - share))]))
    swaps = swaps_of(sets)
    chosen = choose_features(labelled, swaps, n)
    k = len(chosen) + 1

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(chosen)
        for batch in batches:
            at, (ones, of) = 0, (batch[c].to_pylist() for c in ("ones", "n"))
            for some in text_slices(batch["text"]):
                rows: list[tuple] = []
                for text in some:
                    rows.append((ones[at], of[at], sorted(present(text, memo)), False, []))
                    for a, b in swapped(text, swaps):
                        fa, fb = ({f for w in x for f in memo[w]} for x in (a, b))
                        if fa != fb:
                            rows.append((0.0, of[at], sorted(fb - fa), True, sorted(fa - fb)))
                    at += 1
                lists = [list_array(np.array([f for x in rows for f in x[c]], np.int32), [len(x[c]) for x in rows]) for c in (2, 4)]
                flat = [pa.array([x[c] for x in rows], t) for c, t in ((0, pa.float64()), (1, pa.int64()), (3, pa.bool_()))]
                yield pa.RecordBatch.from_arrays([flat[0], flat[1], lists[0], flat[2], lists[1]], ["ones", "n", "up", "swap", "down"])

    small = scratch.stage(f"reduced{mu:g}", labelled.mapInArrow(reduced, "ones double, n long, up array<int>, swap boolean, down array<int>"))
    weights = np.zeros(k)
    weights[-1] = np.log(ones / (of - ones))

    def sums_at(w: np.ndarray):
        def run(batches):
            out = np.zeros((k, k + 1))  # Hessian and gradient of the loss
            for batch in batches:
                for a in range(0, batch.num_rows, 2_000):
                    out += newton_sums(batch.slice(a, 2_000), w, mu)
            return out

        return run

    prior = RIDGE * np.eye(k)
    prior[-1, -1] = 1e-6
    for _ in range(STEPS):
        sums = tree_sum(small, sums_at(weights), k, k + 1)
        step = np.linalg.solve(sums[:, :k] + prior, sums[:, k] + prior @ weights)
        weights = weights - step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-3:
            break
    scratch.drop(f"reduced{mu:g}")
    return Model(chosen, weights)


def newton_sums(batch: pa.RecordBatch, w: np.ndarray, mu: float) -> np.ndarray:
    """Hessian and gradient, side by side, of the loss over rows (ones, n, up, swap, down): a matrix of their features, and two products."""
    k = len(w)
    x = np.zeros((batch.num_rows, k))
    for column, value in (("up", 1.0), ("down", -1.0)):
        lists = batch[column]
        x[np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()] = value
    swap = batch["swap"].to_numpy(zero_copy_only=False)
    x[:, -1] = ~swap
    ones, n = batch["ones"].to_numpy(), batch["n"].to_numpy()
    z = x @ w
    p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    curve = np.where(swap, mu * n, n * p * (1 - p))
    slope = np.where(swap, mu * n * z, n * p - ones)
    return x.T @ np.column_stack([x * curve[:, None], slope])


def score_documents(docs: DataFrame, labels: DataFrame, scratch: Scratch, label: str = "toxic", mu: float = MU, max_labelled: int = MAX_LABELLED, sets: tuple[tuple[str, ...], ...] = IDENTITY) -> DataFrame:
    """Score every row of docs (doc_id, text): doc_id, held_out, score (0 to 1), predicted (1 where score >= 0.7).

    Labels (doc_id, ``label``) are learned only where crc32(doc_id as text) mod 3 is not 1, from about ``max_labelled`` documents at most:
    the share of them that fits, by the hash of their doc_id. Null labels and labels of unknown documents are ignored; repeated label rows weigh
    as often as they stand. Null texts are empty; empty texts get the score of a document without features; texts of any length are scored
    whole. A null doc_id is scored and never held out. Repeated documents keep their rows; no documents, no rows. Other columns are never inputs.
    ``sets``: terms that name groups, in sets of terms that may stand for one another, a neutral one first.
    """
    y = F.col(label).cast("double")
    known = labels.where(y.isNotNull() & (crc_mod("doc_id", FOLDS) != HELD_OUT)).groupBy("doc_id").agg(F.sum(y).alias("ones"), F.count("*").alias("n"))
    share = min(1.0, max_labelled / max(known.count(), 1))
    known = scratch.stage("known", known.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < share * 1_000_000))
    labelled = docs.select("doc_id", text_or_empty().alias("text")).join(maybe_broadcast(known), "doc_id").select("text", "ones", "n")
    model = fit(scratch.stage("labelled", labelled), scratch, mu, sets=sets)
    scratch.drop("known", "labelled")

    def score(texts: pa.Array) -> pa.Array:
        memo = Memo(model.chosen)
        return pa.array(np.concatenate([np.zeros(0), *(model.score([present(t, memo) for t in some]) for some in text_slices(texts))]))

    out = docs.select("doc_id", F.arrow_udf(score, "double")(text_or_empty()).alias("score"))
    held = F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
