"""Recall of the nearest-neighbour search on tables of several shapes."""

import numpy as np
import pytest

from frostline.llm import vectors
from frostline.llm.common import Scratch


def table_of(kind: str, n: int = 1200, width: int = 32) -> np.ndarray:
    rng = np.random.default_rng(17)
    x = rng.normal(size=(n, width))
    if kind == "heavy":  # norms over four powers of ten
        return x / np.linalg.norm(x, axis=1, keepdims=True) * np.exp(rng.normal(0, 2.5, (n, 1)))
    if kind == "clusters":
        return rng.normal(size=(12, width))[rng.integers(0, 12, n)] * 3 + 0.3 * x
    if kind == "sparse":
        return np.where(rng.random((n, width)) < 0.08, x, 0.0)
    if kind == "outliers":
        x[rng.choice(n, 6, replace=False)] *= 1e4
        return x
    return np.abs(x)  # all to one side


@pytest.mark.parametrize("kind", ["heavy", "clusters", "sparse", "outliers", "one side"])
def test_recall_on_a_table(spark, kind):
    rows = [(i, v.tolist()) for i, v in enumerate(table_of(kind))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    asked = [i for i, v in rows if i % 20 == 0 and any(v)]
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in vectors.nearest(df, df.where("vec_id % 20 = 0"), Scratch(spark, "t")).collect()}
    want = {(q, v): s for q, _, v, s in vectors.brute_force(rows, asked)}
    ties = {q: min(s for (a, _), s in want.items() if a == q) for q in asked}  # of equal scores any may be found
    hit = sum(1 for (q, v), s in want.items() if (q, v) in got or s == ties[q] and sum(1 for (a, _), t in got.items() if a == q and t == s))
    assert hit >= 0.95 * len(want) and all(got[k] == want[k] for k in got.keys() & want.keys())
