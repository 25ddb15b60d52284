"""State-space smoothing by associative scans: a random walk seen through several series, over sessions of any length.

A step of the filter is an element (A, b, C, e, J), a step of the smoother one (E, g, L). Both compose associatively, so a piece of a session is
composed without what comes before it or after it: pieces are scanned side by side, one row a piece is gone through in order to find what is carried into each, and
the pieces' own rows follow from that. The work is linear in the rows, and no task holds more than a piece, or a row a piece of one session.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.operators.stream import lists
from frostline.sources.stage import Store

#: Steps of ``order`` in a piece.
PIECE = 4096
Element = tuple[np.ndarray, ...]


def filter_elements(h: np.ndarray, z: np.ndarray, q: float) -> Element:
    """One element a step: h the precision of what is seen (0: nothing), z its value, q the walk's variance."""
    scale = 1.0 / (1.0 + q * h)
    return scale, q * h * scale * z, q * scale, h * scale * z, h * scale


def compose_filter(i: Element, j: Element) -> Element:
    """First i, then j."""
    a, b, c, e, k = i
    a2, b2, c2, e2, k2 = j
    d = 1.0 / (1.0 + c * k2)
    return a2 * d * a, a2 * d * (b + c * e2) + b2, a2 * a2 * d * c + c2, a * d * (e2 - k2 * b) + e, a * a * d * k2 + k


def apply_filter(x: float, p: float, element: Element) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance after an element, from those before it."""
    a, b, c, e, k = element
    d = 1.0 / (1.0 + p * k)
    return a * d * (x + p * e) + b, a * a * d * p + c


def smooth_elements(x: np.ndarray, p: np.ndarray, q: float, last: bool) -> Element:
    """One element a step from filtered means and variances; a session's last step takes nothing from the right."""
    ahead = p + q
    gain = np.divide(p, ahead, out=np.zeros_like(p), where=ahead > 0)
    if last:
        gain[-1:] = 0.0
    return gain, (1.0 - gain) * x, (1.0 - gain) * p


def compose_smooth(i: Element, j: Element) -> Element:
    """i stands left of j."""
    return i[0] * j[0], i[0] * j[1] + i[1], i[0] * i[0] * j[2] + i[2]


def scan(elements: Element, compose: Callable[[Element, Element], Element], backwards: bool = False) -> Element:
    """All compositions from the first element on, or up to the last one: whole arrays, in as many rounds as the logarithm of their length."""
    out, step = [np.array(x, dtype=np.float64) for x in elements], 1
    while step < len(out[0]):
        left, right = tuple(x[:-step] for x in out), tuple(x[step:] for x in out)
        for x, new in zip(out, compose(left, right), strict=True):
            x[slice(None, -step) if backwards else slice(step, None)] = new
        step *= 2
    return tuple(out)


def kalman_smooth(bins: DataFrame, observed: list[str], order: str = "bin", q: float = 1.0, r: float = 1.0, x0: float = 0.0, p0: float = 1.0, penalties: dict[str, float] | None = None, penalty: str | None = None, keep: Callable[[str, DataFrame], DataFrame] | None = None, piece: int = PIECE) -> DataFrame:
    """(session_id, order, filtered, filtered_var, smoothed, smoothed_var, loglik): a random walk seen through ``observed`` columns with independent noise.

    Steps follow ``order`` (whole numbers, one row each). Missing observations (null, NaN, infinite) are skipped. Penalties p in (0, 1) of a column raise its noise to r / p^2; others change nothing.
    ``penalty`` names a column of bins that does so for all columns of its row. Observations of one step count as one of their summed precision, which for
    independent noise equals the joint update; loglik is the session's, of all of them. An empty table gives none.

    A session is cut into pieces of ``piece`` steps of order, each one row of arrays. keep(name, df) writes them between the passes (in spark.checkpoint.dir if not given).
    """
    if r <= 0 or q < 0 or p0 < 0:
        raise ValueError("variances must not be negative, and r must be positive")
    keep = keep or Store(bins.sparkSession).keep
    weak = {c: p for c, p in (penalties or {}).items() if 0 < p < 1}
    w = F.col(f"`{penalty}`") if penalty else F.lit(1.0)
    inflate = F.when((w > 0) & (w < 1), 1.0 / (w * w)).otherwise(1.0)
    each = []
    for c in observed:
        y = F.col(f"`{c}`").cast("double")
        each.append((F.when(~F.isnan(y) & (F.abs(y) < float("inf")), y), F.lit(r / weak.get(c, 1.0) ** 2) * F.col("inflate")))
    total = lambda parts: reduce(lambda a, b: a + b, parts)
    rows = bins.withColumn("inflate", inflate)
    rows = rows.select("session_id", F.col(f"`{order}`").cast("long").alias("k"), *[F.struct(y.alias("y"), v.alias("v")).alias(f"o{i}") for i, (y, v) in enumerate(each)])
    seen = [(F.col(f"o{i}.y"), F.col(f"o{i}.v")) for i in range(len(each))]
    rows = rows.withColumn("h", total([F.when(y.isNotNull(), 1.0 / v).otherwise(0.0) for y, v in seen]))
    rows = rows.withColumn("z", F.when(F.col("h") > 0, total([F.coalesce(y / v, F.lit(0.0)) for y, v in seen]) / F.col("h")).otherwise(0.0))
    apart = total([F.coalesce(-0.5 * (F.log(2.0 * F.pi() * v) + (y - F.col("z")) * (y - F.col("z")) / v), F.lit(0.0)) for y, v in seen])
    rows = rows.withColumn("e", F.when(F.col("h") > 0, apart + 0.5 * F.log(2.0 * F.pi() / F.col("h"))).otherwise(0.0))
    at = F.floor(F.col("k") / F.lit(piece)).alias("at")
    pieces = keep("pieces", rows.groupBy("session_id", at).agg(F.sort_array(F.collect_list(F.struct("k", "h", "z", "e"))).alias("s")))

    def steps_of(batch: pa.RecordBatch, i: int) -> list[np.ndarray]:
        s = batch["s"][i].values
        return [s.field(c).to_numpy() for c in ("k", "h", "z", "e")]

    def one(names: list[str], batch: pa.RecordBatch, i: int, *values) -> pa.RecordBatch:
        kinds = [pa.array([float(v)]) if np.ndim(v) == 0 else lists(v, np.array([len(v)]), pa.int64() if v.dtype.kind == "i" else pa.float64()) for v in values]
        return pa.RecordBatch.from_arrays([batch["session_id"].slice(i, 1), batch["at"].slice(i, 1), *kinds], ["session_id", "at", *names])

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, h, z, _ = steps_of(batch, i)
                yield one(list("abcej"), batch, i, *(x[-1] for x in scan(filter_elements(h, z, q), compose_filter)))

    def forward(rows: pa.Table) -> pa.Table:
        rows, x, p, before = rows.sort_by("at"), x0, p0, []
        for element in zip(*(rows[c].to_pylist() for c in "abcej"), strict=True):
            before.append((x, p))
            x, p = map(float, apply_filter(x, p, element))
        last = np.arange(rows.num_rows) == rows.num_rows - 1
        return pa.Table.from_arrays([rows["session_id"], rows["at"], *(pa.array([b[i] for b in before]) for i in range(2)), pa.array(last)], ["sid", "piece", "x0", "p0", "last"])

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                k, h, z, e = steps_of(batch, i)
                start, var = batch["x0"][i].as_py(), batch["p0"][i].as_py()
                x, p = apply_filter(start, var, scan(filter_elements(h, z, q), compose_filter))
                some = h > 0
                s = np.concatenate([[var], p[:-1]])[some] + q + 1.0 / h[some]
                gap = z[some] - np.concatenate([[start], x[:-1]])[some]
                loglik = (e[some] - 0.5 * (np.log(2 * np.pi * s) + gap * gap / s)).sum()
                whole = [v[0] for v in scan(smooth_elements(x, p, q, batch["last"][i].as_py()), compose_smooth, backwards=True)]
                yield one(["k", "x", "p", "a", "b", "c", "ll", "end"], batch, i, k, x, p, *whole, loglik, float(batch["last"][i].as_py()))

    def backward(rows: pa.Table) -> pa.Table:
        rows, x, p, after = rows.sort_by([("at", "descending")]), 0.0, 0.0, []
        for a, b, c in zip(*(rows[n].to_pylist() for n in "abc"), strict=True):
            after.append((x, p))
            x, p = a * x + b, a * a * p + c
        loglik = np.full(rows.num_rows, rows["ll"].to_numpy()[::-1].sum())
        return pa.Table.from_arrays([rows["session_id"], rows["at"], *(pa.array([v[i] for v in after]) for i in range(2)), pa.array(loglik)], ["sid", "piece", "x1", "p1", "loglik"])

    def smoothed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                k, x, p = (batch[c][i].values.to_numpy() for c in ("k", "x", "p"))
                a, b, c = scan(smooth_elements(x, p, q, bool(batch["end"][i].as_py())), compose_smooth, backwards=True)
                right, var = batch["x1"][i].as_py(), batch["p1"][i].as_py()
                session = pa.array([batch["session_id"][i].as_py()] * len(k), batch["session_id"].type)
                columns = [k, x, p, a * right + b, a * a * var + c, np.full(len(k), batch["loglik"][i].as_py())]
                yield pa.RecordBatch.from_arrays([session, *map(pa.array, columns)], ["session_id", "k", "filtered", "filtered_var", "smoothed", "smoothed_var", "loglik"])

    kind = bins.schema["session_id"].dataType.simpleString()
    # a merge join: Spark might else broadcast the pieces and leave all work to the one task that holds a session's carried rows
    both = lambda left, right: left.join(right.hint("merge"), left["session_id"].eqNullSafe(right["sid"]) & (left["at"] == right["piece"]))
    carried = pieces.mapInArrow(composed, f"session_id {kind}, at long, a double, b double, c double, e double, j double").groupBy("session_id").applyInArrow(lambda t: forward(t), f"sid {kind}, piece long, x0 double, p0 double, last boolean")
    shape = f"session_id {kind}, at long, k array<long>, x array<double>, p array<double>, a double, b double, c double, ll double, end double"
    done = keep("filtered", both(pieces, carried).select("session_id", "at", "s", "x0", "p0", "last").mapInArrow(filtered, shape))
    right = done.select("session_id", "at", "a", "b", "c", "ll").groupBy("session_id").applyInArrow(lambda t: backward(t), f"sid {kind}, piece long, x1 double, p1 double, loglik double")
    out = both(done, right).select("session_id", "k", "x", "p", "end", "x1", "p1", "loglik").mapInArrow(smoothed, f"session_id {kind}, k long, filtered double, filtered_var double, smoothed double, smoothed_var double, loglik double")
    return out.withColumnRenamed("k", order)
