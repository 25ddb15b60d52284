"""Nearest neighbours by largest inner product: inverted lists scanned dimension by dimension.

Units. Rows with one vector are one unit: the search runs over distinct vectors, and each unit keeps its K + 1 smallest ids, which are all that
a query can need of it. So copies of one vector, however many, cost what one vector costs.

Index. Inner products become distances by one more dimension, sqrt(R^2 - |x|^2) with R the largest norm (0 for a query): |q' - x'|^2 is
R^2 + |q|^2 - 2 q.x. Vectors are turned by a random rotation, so that any of their first dimensions are a fair sample of all.
Centroids are fitted by k-means on about SAMPLE units; every unit is put into the list of its nearest centroid.
How many lists a query probes is measured on the sample: the fewest with which TARGET of the true neighbours are met.

Search. A query first scans the list next to it. The worst of its K + 1 best there is the distance to beat, and goes along to its other lists;
a list whose radius keeps all of its members beyond that distance is not probed. A list is cut into blocks, however large it is, and its
queries into chunks; each meets each. In a block, dimensions are read in blocks of STEP columns. After each, a candidate is given up if its
partial distance, scaled up to all dimensions, is over the distance to beat by more than a hypothesis test allows (EPS). Survivors are scored
exactly on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from frostline.llm.common import Scratch

K, SAMPLE, MAX_LISTS, TARGET = 20, 20_000, 1_024, 0.97
#: Bytes of a block's vectors and the most vectors in it; queries in a chunk; columns read at once.
BLOCK_BYTES, BLOCK, CHUNK, STEP, EPS, SEED = 4 << 20, 4_096, 256, 16, 2.1, 5
#: With fewer live pairs than this share, pairs are followed one by one and not as a whole matrix.
DENSE = 0.1


@dataclass
class Index:
    """Rotation, centroids in the turned space, largest norm, lists to probe, and the units and the radius of each list."""

    rotation: np.ndarray
    centroids: np.ndarray
    radius: float
    probes: int = 1
    sizes: np.ndarray | None = None
    reach: np.ndarray | None = None

    def turned(self, x: np.ndarray, query: bool) -> np.ndarray:
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.radius**2 - (x * x).sum(1), 0))
        return np.column_stack([x, more]) @ self.rotation

    def blocks(self) -> np.ndarray:
        rows = min(BLOCK, max(64, BLOCK_BYTES // (8 * self.rotation.shape[0])))
        return np.maximum(1, -(-self.sizes // rows))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)


def _closest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and the squared distance to it; 2,048 rows at once."""
    near, far = np.empty(len(x), np.int64), np.empty(len(x))
    for at in range(0, len(x), 2_048):
        d = _distances(x[at : at + 2_048], centres)
        near[at : at + 2_048] = d.argmin(1)
        far[at : at + 2_048] = d.min(1)
    return near, np.maximum(far, 0)


def k_means(x: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's rounds from random rows; an empty cluster keeps its centre."""
    rng = np.random.default_rng(SEED)
    centres = x[rng.choice(len(x), lists, replace=False)].copy()
    for _ in range(rounds):
        near, _ = _closest(x, centres)
        counts = np.bincount(near, minlength=lists)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, x array<double>) of the rows that take part: neither null nor empty nor zero, all components finite."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull())
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(finite & F.exists("x", lambda v: v != 0))
    return rows.select("vec_id", F.transform("x", lambda v: v + F.lit(0.0)).alias("x"))  # no negative zeros


def fit(units: DataFrame, n: int, k: int = K) -> Index:
    """An index without list sizes, from a bounded sample of the n units (uid, x) of one dimension."""
    top = units.agg(F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))).first()[0]
    share = min(1.0, SAMPLE / n)
    drawn = units.where(F.pmod(F.xxhash64("x", F.lit(SEED)), F.lit(1 << 40)) < int(share * (1 << 40)))
    found = drawn.select("x").collect() or units.limit(1).select("x").collect()
    sample = np.array(sorted(r["x"] for r in found))
    sample = sample[np.random.default_rng(SEED).permutation(len(sample))]
    d = sample.shape[1] + 1
    rotation = np.linalg.qr(np.random.default_rng(SEED).normal(size=(d, d)))[0]
    index = Index(rotation, np.zeros((1, d)), float(np.sqrt(top)))
    turned = index.turned(sample, False)
    lists = int(min(MAX_LISTS, max(1, round(n**0.5 / 2)), len(sample)))
    index.centroids = k_means(turned, lists)
    some = sample[:300]
    best = np.argsort(-(some @ sample.T), axis=1, kind="stable")[:, : k + 1]
    near, _ = _closest(turned, index.centroids)
    order = np.argsort(_distances(index.turned(some, True), index.centroids), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(lists)[None, :].repeat(len(some), 0), 1)
    needed = np.take_along_axis(place, near[best], 1)
    index.probes = 1 + int(np.quantile(needed, TARGET, method="higher"))
    return index


def scan(firsts: np.ndarray, uids: np.ndarray, x: np.ndarray, turned: np.ndarray, q: np.ndarray, qturned: np.ndarray, beat: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, candidate number, score) of the ``need`` best candidates of each query in one block, given up as early as may be.

    beat: squared distances that candidates must not pass, infinite where none is known. Equal scores stand by firsts, then uids.
    """
    dims = turned.shape[1]
    partial = _distances(qturned[:, :STEP], turned[:, :STEP])
    beat = beat.copy()
    new = np.flatnonzero(np.isinf(beat))
    if len(new) and len(uids) > need:  # the whole distances of those that look best so far
        start = np.argpartition(partial[new], need - 1, axis=1)[:, :need]
        beat[new] = np.stack([((turned[start[:, j]] - qturned[new]) ** 2).sum(1) for j in range(need)]).max(0)
    who = None
    for at in range(STEP, dims, STEP):
        bar = beat * ((1 + EPS / np.sqrt(at)) ** 2 * at / dims)
        cols = slice(at, at + STEP)
        if who is None:
            live = partial <= bar[:, None]
            if np.count_nonzero(live) > DENSE * live.size:
                partial += _distances(qturned[:, cols], turned[:, cols])
                partial[~live] = np.inf
                continue
            who, what = np.nonzero(live)
            partial = partial[who, what]
        else:
            live = partial <= bar[who]
            who, what, partial = who[live], what[live], partial[live]
        partial += ((turned[what, cols] - qturned[who, cols]) ** 2).sum(1)
    limit = beat * (1 + 1e-4) + 1e-9
    if who is None:
        who, what = np.nonzero(partial <= limit[:, None])
    else:
        live = partial <= limit[who]
        who, what = who[live], what[live]
    score = np.empty(len(who))
    for a in range(0, len(who), 1 << 16):
        b = slice(a, a + (1 << 16))
        score[b] = (x[what[b]] * q[who[b]]).sum(1)
    order = np.lexsort([uids[what], firsts[what], -score, who])
    who, what, score = who[order], what[order], score[order]
    place = np.arange(len(who)) - np.searchsorted(who, who)
    return who[place < need], what[place < need], score[place < need]


def _pack(keys: list[str], numbers: list[str]):
    """The rows of a group as one: numbers and vectors as bytes."""

    def run(table: pa.Table) -> pa.Table:
        out = {k: table[k].slice(0, 1) for k in keys} | {c: pa.array([table[c].to_numpy().tobytes()], pa.binary()) for c in numbers}
        return pa.table(out | {"v": pa.array([b"".join(table["v"].to_pylist())], pa.binary())})

    return run


def _matrix(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    return batch[column].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _search(units: DataFrame, asked: DataFrame, n: int, d: int, k: int, scratch: Scratch) -> DataFrame:
    """(quid, uid, first, score): the k + 1 best units (uid, x, first) of one dimension d for each unit of asked (quid), itself among them, and more."""
    spark, need = units.sparkSession, k + 1
    index = fit(units, n, k)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                near, far = _closest(index.turned(x, False), index.centroids)
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), batch["uid"], batch["first"], pa.array(far), pa.array([v.tobytes() for v in x], pa.binary())], ["list", "uid", "first", "far", "v"])

    listed = scratch.stage(f"listed{d}", units.mapInArrow(assign, "list int, uid long, first long, far double, v binary"))
    index.sizes, index.reach = np.zeros(len(index.centroids), np.int64), np.zeros(len(index.centroids))
    for r in listed.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # a row a list
        index.sizes[r["list"]], index.reach[r["list"]] = r["n"], r["far"] ** 0.5
    per_list = spark.createDataFrame([(i, int(b)) for i, b in enumerate(index.blocks())], "list int, blocks int")
    placed = listed.join(F.broadcast(per_list), "list").withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    shape = "list int, block int, uid binary, first binary, v binary"
    blocks = placed.select("list", "block", "uid", "first", "v").groupBy("list", "block").applyInArrow(_pack(["list", "block"], ["uid", "first"]), shape)
    blocks = scratch.stage(f"blocks{d}", blocks)
    scratch.drop(f"listed{d}")

    def route(others: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, bar = _matrix(batch), batch["bar"].to_numpy(zero_copy_only=False)
                beat = index.radius**2 + (x * x).sum(1) - 2 * bar if others else np.full(len(x), np.inf)
                beat = np.where(np.isnan(beat), np.inf, beat)
                away = np.where(index.sizes > 0, _distances(index.turned(x, True), index.centroids), np.inf)
                order = np.argsort(away, axis=1, kind="stable")
                before = np.cumsum(index.sizes[order], axis=1) - index.sizes[order]
                place = np.arange(order.shape[1])
                if others:
                    gap = np.sqrt(np.maximum(np.take_along_axis(away, order, 1), 0)) - index.reach[order]
                    near = np.maximum(gap, 0) ** 2 <= beat[:, None] * (1 + 1e-6) + 1e-9
                    wanted = (place > 0) & ((place < index.probes) | (before < need)) & near  # enough candidates in any case
                else:
                    wanted = np.broadcast_to(place == 0, order.shape)
                who, at = np.nonzero(wanted & (index.sizes[order] > 0))
                v = pa.array([a.tobytes() for a in x], pa.binary()).take(pa.array(who))
                yield pa.RecordBatch.from_arrays([pa.array(order[who, at].astype(np.int32)), batch["uid"].take(pa.array(who)), pa.array(beat[who]), v], ["list", "uid", "beat", "v"])

        return run

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x, turned = None, None, None
        for batch in batches:
            for r in range(batch.num_rows):
                numbers = lambda c, t=np.int64: np.frombuffer(batch[c][r].as_buffer(), t)  # noqa: B023, E731
                at = (batch["list"][r].as_py(), batch["block"][r].as_py())
                uids = numbers("uid")
                if at != last:  # the chunks of a block follow one another
                    x = np.array(numbers("v", np.float64)).reshape(-1, d)
                    last, turned = at, index.turned(x, False)
                q = numbers("q", np.float64).reshape(-1, d)
                firsts = numbers("first")
                who, what, score = scan(firsts, uids, x, turned, q, index.turned(q, True), numbers("beat", np.float64), need)
                yield pa.RecordBatch.from_arrays([pa.array(numbers("quid")[who]), pa.array(uids[what]), pa.array(firsts[what]), pa.array(score)], ["quid", "uid", "first", "score"])

    def meet(routed: DataFrame) -> DataFrame:
        loads = routed.groupBy("list").count().select("list", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks"))
        chunked = routed.join(F.broadcast(loads), "list").withColumn("chunk", F.pmod(F.xxhash64("uid"), F.col("chunks")).cast("int"))
        chunked = chunked.select("list", "chunk", "uid", "beat", "v").groupBy("list", "chunk").applyInArrow(_pack(["list", "chunk"], ["uid", "beat"]), "list int, chunk int, uid binary, beat binary, v binary")
        over = chunked.join(F.broadcast(per_list), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("uid").alias("quid"), "beat", F.col("v").alias("q"))
        return blocks.join(over, ["list", "block"]).select("list", "block", "uid", "first", "v", "quid", "beat", "q").mapInArrow(search, "quid long, uid long, first long, score double")

    def routed(queries: DataFrame, others: bool) -> DataFrame:
        return scratch.stage(f"routed{d}-{others:d}", queries.mapInArrow(route(others), "list int, uid long, beat double, v binary"))

    mine = scratch.stage(f"asked{d}", units.join(asked.select(F.col("quid").alias("uid")).distinct(), "uid", "left_semi").select("uid", "x"))
    near = scratch.stage(f"near{d}", meet(routed(mine.withColumn("bar", F.lit(None).cast("double")), False)))
    bars = best(near, need).groupBy("quid").agg(F.count("*").alias("found"), F.min("score").alias("low"))
    bars = bars.select(F.col("quid").alias("uid"), F.when(F.col("found") == need, F.col("low")).alias("bar"))
    far = scratch.stage(f"far{d}", meet(routed(mine.join(bars, "uid", "left"), True)))
    return near.unionByName(far)


def best(found: DataFrame, need: int) -> DataFrame:
    """The rows of found with the ``need`` highest scores of each quid; equal scores by first, then uid."""
    order = Window.partitionBy("quid").orderBy(F.desc("score"), "first", "uid")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= need).drop("place")


def nearest(vectors: DataFrame, queries: DataFrame, scratch: Scratch, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of vectors (vec_id, embedding) to each row whose id is in queries (vec_id), by largest inner product.

    Ties go to the smaller vec_id; a query's own row is no candidate of it. Vectors that are null, empty, zero or hold null or non-finite
    components take no part, and neither do null ids. Candidates of a query are the rows of its own dimension, as others have no
    inner product with it: each dimension has its own index. Repeated rows stay, each a candidate, and each a query if its id is asked for; another row
    under the query's id is a candidate like any other. Where fewer than k candidates are there, all are returned; no valid vectors, no rows.
    Other columns are ignored.
    """
    spark, need = vectors.sparkSession, k + 1
    rows = usable(vectors)
    few = rows.withColumn("place", F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))).where(F.col("place") <= need)
    units = few.groupBy("x").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # k + 1 at most
    units = scratch.stage("units", units.select(F.monotonically_increasing_id().alias("uid"), F.size("x").alias("d"), "x", F.col("ids")[0].alias("first"), "ids"))
    wanted = queries.select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
    asked = rows.join(wanted, "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), "x").join(units.select("x", "uid", "d"), "x")
    asked = scratch.stage("asked", asked.select("query_id", F.col("uid").alias("quid"), "d"))
    parts = []
    for r in units.groupBy("d").count().orderBy("d").collect():  # a row a dimension
        one = units.where(F.col("d") == r["d"]).select("uid", "x", "first")
        parts.append(_search(one, asked.where(F.col("d") == r["d"]), r["count"], r["d"], k, scratch))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    top = best(reduce(DataFrame.unionByName, parts), need).join(units.select("uid", "ids"), "uid")
    entry = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("low"), i.alias("vec_id"), (F.col("uid") != F.col("quid")).alias("other")))
    lists = top.groupBy("quid").agg(F.slice(F.array_sort(F.flatten(F.collect_list(entry))), 1, need).alias("found"))
    own = F.array_position(F.transform("found", lambda e: (e["vec_id"] == F.col("query_id")) & ~e["other"]), True)
    kept = F.slice(F.filter("found", lambda e, i: i + 1 != F.col("own")), 1, k)
    out = asked.select("query_id", "quid").join(lists, "quid").withColumn("own", own).select("query_id", F.posexplode(kept).alias("rank", "e"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("e.vec_id").alias("vec_id"), (-F.col("e.low")).alias("score"))


def brute_force(vectors: list[tuple[int | None, list[float] | None]], queries: list[int], k: int = K) -> list[tuple[int, int, int, float]]:
    """The definition, for tests."""
    good = [(i, np.array(v, float)) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for at, (q, x) in enumerate(good):
        if q in queries:
            scores = sorted((-float((v * x).sum()), i) for j, (i, v) in enumerate(good) if j != at and len(v) == len(x))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return out
