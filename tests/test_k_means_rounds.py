"""Lloyd's rounds over plain columns: compiled, and each session for itself."""

import numpy as np

from frostline.operators import inference, selection
from frostline.sources.stage import Store

SHAPE = "session_id string, k long, a double, b double"


def lloyd(x, k, rounds):
    """(regime, squared distance) of each row of x, null coordinates as None."""
    d2 = lambda r, c: None if any(v is None or w is None for v, w in zip(r, c, strict=True)) else sum((v - w) ** 2 for v, w in zip(r, c, strict=True))
    nearest = lambda r, c: min(range(len(c)), key=lambda j: (d2(r, c[j]) is not None, d2(r, c[j]), j))
    centres, was = [list(r) for r in x[:k]], None
    for _ in range(rounds):
        now = [nearest(r, centres) for r in x]
        if now == was:
            break
        for j in set(now):
            mine = [r for r, g in zip(x, now, strict=True) if g == j]
            columns = [[r[i] for r in mine if r[i] is not None] for i in range(2)]
            centres[j] = [sum(c) / len(c) if c else None for c in columns]
        was = now
    return [(g, d2(r, centres[g])) for r, g in ((r, nearest(r, centres)) for r in x)]


def sessions():
    rng = np.random.default_rng(3)
    out = {"slow": [[float(i * i), 1.0] for i in range(40)], "fast": [[float(10 * (i % 3)), 5.0] for i in range(30)], "two": [[1.0, 2.0], [3.0, 4.0]], "one": [[1.0, None]]}
    out["many"] = [[float(a), float(b)] for a, b in rng.normal(size=(200, 2)).round(3)]
    out["gaps"] = [[None if i % 7 == 3 else float(i), float(i % 5)] for i in range(30)]
    out["nulls"] = [[None, 1.0], [1.0, 1.0], [2.0, 1.0], [None, 3.0], [9.0, 1.0]]
    return out


def test_sessions_rest_at_different_rounds(spark, monkeypatch):
    rows = [(s, i, *r) for s, x in sessions().items() for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, SHAPE).repartition(3)
    for k, rounds, small in ((3, 50, selection.SMALL), (3, 50, 2), (3, 4, selection.SMALL), (3, 1, selection.SMALL), (1, 3, selection.SMALL)):
        monkeypatch.setattr(selection, "SMALL", small)
        got = {(r["session_id"], r["k"]): (r["regime"], r["confidence"]) for r in inference.k_means(df, "k", ["a", "b"], k=k, rounds=rounds).collect()}
        assert len(got) == len(rows)
        for s, x in sessions().items():
            for i, (regime, d2) in enumerate(lloyd(x, k, rounds)):
                assert got[s, i][0] == regime and (got[s, i][1] is None if d2 is None else abs(got[s, i][1] - 1 / (1 + d2)) < 1e-9), (s, i, k, rounds, got[s, i], regime, d2)


def test_rows_meet_no_interpreted_function(spark):
    """Distances over arrays, which Spark does not compile, took ten times as long."""
    store, plans = Store(spark), []

    def keep(name, df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return store.keep(name, df)

    df = spark.createDataFrame([("s", i, float(i * i % 17), float(i)) for i in range(40)], SHAPE)
    out = inference.k_means(df, "k", ["a", "b"], k=3, keep=keep)
    assert len(plans) > 4
    assert not any("zip_with" in p or "aggregate(" in p.replace("Aggregate", "") for p in [*plans, out._jdf.queryExecution().optimizedPlan().toString()])
