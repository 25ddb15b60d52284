"""Source divergence audit: how far the term shares of a language's sources lie apart, by sorted streams of (lang, term, source, document).

Four passes, each of which sorts rows and scans the runs of equal keys in a stream; no pass holds more than a bounded slab or one run:

1. In each task, slabs of texts are cut into terms and sorted by (lang, term, source, document). A run of a document counts once towards its document
   frequency, a run of (lang, term, source) gives a partial row. So what is shuffled is a row for each distinct term of a source and slab, however
   long or frequent. A row without a term stands for each (lang, source) met.
2. Dealt and sorted by (lang, term, source): runs add partial rows up. A key gets a row a slab at most, so hot sources and terms are no heavier.
3. Dealt and sorted by (lang, term), then source: a run is all the sources of a term, and is kept if they have it in enough documents.
4. Sources are dealt into blocks; (lang, two blocks, part of the terms) are dealt out and sorted by term and source. The rows without a term come first and
   bring each source's total. Then each run is one term: it adds |p - q| to the sums of pairs, and gives candidates for a source's own terms. Each part
   ends with its partial pairs and terms, which are summed and ranked at the end.

All numbers are integers. A share is 1 + floor(1e9 (count + 5) / (N + 5 V)), divided in steps of 1000, so that it is exact up to 9e15 occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from frostline.llm.common import Scratch, trim

#: A term is kept if so many documents of its language have it; terms reported of a source.
LEAST_DOCS, TOP = 30, 50
#: Bytes and rows of texts sorted at once; sources in a block; terms of which a matrix is made at once.
SLAB_BYTES, SLAB_ROWS, BLOCK, CHUNK = 12 << 20, 50_000, 128, 512
#: Parts of a language's terms, at least, and kept rows for one more: each part gives its partial pairs and terms once.
PIECES, PIECE_ROWS = 16, 100_000

#: Bytes that belong to terms, letters of ASCII and all beyond it: as each byte of a longer character is beyond it, bytes can be cut as characters are.
LETTER = np.array([chr(b).isalpha() or b >= 128 for b in range(128)] + [True] * 128)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

PARTIAL = "lang string, term string, source string, docs long, n long"
KEPT = "lang string, term string, source string, n long, total long, first long"
FOUND = "lang string, source string, part string, item string, value long"


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct terms, the term of each occurrence, its text's place) of texts without nulls."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    letter = LETTER[data]
    begins, stops = letter.copy(), letter.copy()
    begins[1:] &= ~letter[:-1]
    stops[:-1] &= ~letter[1:]
    edge = ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < len(data))]
    begins[edge], stops[edge - 1] = letter[edge], letter[edge - 1]
    at = np.flatnonzero(begins)
    sizes = np.flatnonzero(stops) + 1 - at
    flat = LOWER[data[letter]]
    words = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.py_buffer(flat)])
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(ends, at, "right") - 1


def count_slab(rows: pa.Table) -> pa.RecordBatch:
    """Partial rows of a slab (lang, source, text), and one without a term for each (lang, source)."""
    lang, source, text = (rows[c].combine_chunks() for c in ("lang", "source", "text"))
    lang, source = lang.dictionary_encode(), source.dictionary_encode()
    pair = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(source.dictionary) + source.indices.to_numpy(zero_copy_only=False)
    groups, group = np.unique(pair, return_inverse=True)
    terms, term, doc = terms_of(text)
    # one number orders (lang and source within the term, document): all occurrences of a run follow one another
    key = np.sort((term * len(groups) + group[doc]) * len(rows) + doc)
    docs = key[np.flatnonzero(np.diff(key, prepend=-1))] // len(rows)
    starts = np.flatnonzero(np.diff(docs, prepend=-1))
    found = docs[starts]
    places = np.flatnonzero(np.diff(key // len(rows), prepend=-1))
    n = np.diff(places, append=len(key))
    g = np.concatenate([np.arange(len(groups)), found % len(groups)])
    columns = [
        lang.dictionary.take(pa.array(groups[g] // len(source.dictionary))),
        pa.concat_arrays([pa.nulls(len(groups), pa.string()), terms.take(pa.array(found // len(groups)))]),
        source.dictionary.take(pa.array(groups[g] % len(source.dictionary))),
        pa.array(np.concatenate([np.bincount(group, minlength=len(groups)), np.diff(starts, append=len(docs))]).astype(np.int64)),
        pa.array(np.concatenate([np.zeros(len(groups), np.int64), n]).astype(np.int64)),
    ]
    return pa.RecordBatch.from_arrays(columns, ["lang", "term", "source", "docs", "n"])


def partial_counts(docs: DataFrame, slab: int = SLAB_BYTES) -> DataFrame:
    """Pass 1, in slabs of about ``slab`` bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            start = 0
            for at, n in enumerate(pc.binary_length(batch["text"]).to_pylist(), 1):
                size += n + slab // SLAB_ROWS
                if size > slab:
                    held.append(batch.slice(start, at - start))
                    yield count_slab(pa.Table.from_batches(held))
                    held, size, start = [], 0, at
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield count_slab(pa.Table.from_batches(held))
        del held
        trim()

    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*plain).mapInArrow(run, PARTIAL)


def runs(rows: pa.Table, *keys: str) -> np.ndarray:
    """Where the runs of equal keys begin; nulls are equal."""
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for k in keys:
        coded = rows[k].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= coded[1:] != coded[:-1]
    return np.flatnonzero(new)


def whole_runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """The sorted rows in tables that end where a run ends; what a batch leaves of its last run waits for the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*held, batch])
        last = int(runs(rows, *keys)[-1])
        if last:
            yield rows.slice(0, last)
        held = rows.slice(last).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)
    trim()


def _sums(rows: pa.Table, column: str, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(rows[column].to_numpy(), starts)


def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass 2: a row for each run of (lang, term, source), with its sums; the last run so far is held as one row until it ends."""
    keys, held = ("lang", "term", "source"), []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*held, batch])
        starts = runs(rows, *keys)
        columns = [*(rows[k].combine_chunks().take(pa.array(starts)) for k in keys), *(pa.array(_sums(rows, c, starts)) for c in ("docs", "n"))]
        summed = pa.RecordBatch.from_arrays(columns, [*keys, "docs", "n"])
        yield summed.slice(0, len(starts) - 1)
        held = [summed.slice(len(starts) - 1)]
    yield from held
    trim()


def keep_terms(least: int):
    """Pass 3: the rows of terms that enough documents of a language have, with the term's total; ``first`` is 1 once a term. Rows without a term stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(batches, "lang", "term"):
            starts = runs(rows, "lang", "term")
            sizes = np.diff(starts, append=len(rows))
            total, first = np.repeat(_sums(rows, "n", starts), sizes), np.zeros(len(rows), np.int64)
            first[starts] = 1
            none = rows["term"].is_null().to_numpy()
            kept = (np.repeat(_sums(rows, "docs", starts), sizes) >= least) | none
            first[none] = 0
            columns = [*(rows[c].combine_chunks() for c in ("lang", "term", "source", "n")), pa.array(total), pa.array(first)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "term", "source", "n", "total", "first"]).filter(pa.array(kept))

    return run


def shares(count: np.ndarray, n: np.ndarray, v: int) -> np.ndarray:
    """1 + floor(1e9 (count + 5) / (n + 5 v)), exactly."""
    whole = np.maximum(n + 5 * v, 1)
    out, rest = np.divmod(count + 5, whole)
    for _ in range(3):
        step, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + step
    return 1 + out


class Block:
    """One run of (lang, a, b, part): the sources of two blocks, the sums of their pairs, and the best terms of each."""

    def __init__(self, key: tuple, top: int):
        self.lang, self.a, self.b, self.part = key
        self.top, self.names, self.n, self.block = top, [], [], []
        self.v = self.whole = 0
        self.ready = False
        self.best: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []

    def begin(self) -> None:
        """After the rows without a term."""
        self.ready, self.base = True, shares(np.zeros(len(self.n), np.int64), np.array(self.n, np.int64), self.v)
        self.index, self.counts = pa.array(self.names, pa.string()), np.array(self.n, np.int64)
        self.left, self.right = (np.flatnonzero(np.array(self.block) == x) for x in (self.a, self.b))
        self.away = np.abs(self.base[self.left, None] - self.base[None, self.right])
        self.sums = self.away * (self.v if self.part == 0 else 0)

    def add(self, rows: pa.Table) -> None:
        """Whole runs of terms. A term that no source of the blocks has adds what counts of 0 do, which ``begin`` has added for all of them."""
        if not self.ready:
            head = int(pc.sum(rows["term"].is_null()).as_py())
            some = rows.slice(0, head)
            self.names += some["source"].to_pylist()
            self.n += some["n"].to_pylist()
            self.block += some["block"].to_pylist()
            if head:
                self.v, self.whole = some["v"][0].as_py(), some["total"][0].as_py()
            rows = rows.slice(head)
            if not len(rows):
                return
            self.begin()
        starts = runs(rows, "term")
        at = pc.index_in(rows["source"].combine_chunks(), self.index).to_numpy()
        run = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(rows)))
        n, total, terms = rows["n"].to_numpy(), rows["total"].to_numpy()[starts], rows["term"].combine_chunks().take(pa.array(starts))
        for low in range(0, len(starts), CHUNK):
            high = min(low + CHUNK, len(starts))
            mine = (run >= low) & (run < high)
            count = np.zeros((high - low, len(self.counts)), np.int64)
            count[run[mine] - low, at[mine]] = n[mine]
            p = shares(count, self.counts, self.v)
            for i, x in enumerate(self.left):
                self.sums[i] += (np.abs(p[:, [x]] - p[:, self.right]) - self.away[i]).sum(axis=0)
            if self.a == self.b:
                over = np.where(count > 0, p - shares(total[low:high], np.int64(self.whole), self.v)[:, None], 0)
                t, s = np.nonzero(over > 0)
                self.keep(s, over[t, s], terms.take(pa.array(low + t)))

    def keep(self, source: np.ndarray, value: np.ndarray, term: pa.Array) -> None:
        """The best ``top`` terms of each source so far, ties by the terms' bytes."""
        self.best.append((source, value, term))
        if sum(len(x[0]) for x in self.best) > 64 * self.top * max(1, len(self.n)):
            self.best = [self.best_of()]

    def best_of(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        source, value = (np.concatenate([x[k] for x in self.best]) for k in (0, 1))
        rows = pa.table({"s": source, "v": value, "t": pa.concat_arrays([x[2] for x in self.best]).cast(pa.binary())})
        order = pc.sort_indices(rows, [("s", "ascending"), ("v", "descending"), ("t", "ascending")]).to_numpy()
        s = source[order]
        starts = np.flatnonzero(np.diff(s, prepend=-1))
        rank = np.arange(len(s)) - np.repeat(starts, np.diff(starts, append=len(s)))
        order = order[rank < self.top]
        return source[order], value[order], rows["t"].combine_chunks().take(pa.array(order)).cast(pa.string())

    def end(self) -> Iterator[pa.RecordBatch]:
        if not self.ready:
            self.begin()
        if len(self.left) and len(self.right):
            x, y = np.repeat(self.left, len(self.right)), np.tile(self.right, len(self.left))
            value = self.sums.reshape(-1)
            if self.a == self.b:
                other = x != y
                yield self.rows("pair", self.index.take(pa.array(x[other])), self.index.take(pa.array(y[other])), value[other])
            else:
                yield self.rows("pair", self.index.take(pa.array(np.concatenate([x, y]))), self.index.take(pa.array(np.concatenate([y, x]))), np.concatenate([value, value]))
        if self.best:
            source, value, term = self.best_of()
            yield self.rows("term", self.index.take(pa.array(source)), term, value)

    def rows(self, part: str, source: pa.Array, item: pa.Array, value: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([self.lang] * len(source), pa.string()), source, pa.array([part] * len(source), pa.string()), item, pa.array(value, pa.int64())], ["lang", "source", "part", "item", "value"])


def compare(top: int):
    """Pass 4."""
    key = ("lang", "a", "b", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Block | None = None
        for rows in whole_runs(batches, *key, "term"):
            starts = runs(rows, *key)
            for low, high in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], strict=True):
                mine = rows.slice(low, high - low)
                this = tuple(mine[k][0].as_py() for k in key)
                if now is None or (now.lang, now.a, now.b, now.part) != this:
                    if now:
                        yield from now.end()
                    now = Block(this, top)
                now.add(mine)
        if now:
            yield from now.end()
        trim()

    return run


def divergence(docs: DataFrame, scratch: Scratch, least: int = LEAST_DOCS, top: int = TOP, block: int = BLOCK, slab: int = SLAB_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (lang, source, text; other columns are ignored, whatever their names).

    Part "pair": how far a source's shares lie from those of each other source of its language, summed over all kept terms. Part "term": the ``top`` terms
    by which its share is over its language's. Ranks fall with value, ties by the items' bytes.

    Null lang, source and text are ''. Each row is a document, repeated ones too. Sources without terms take part with counts of 0; a language without
    kept terms gives pairs of value 0. Empty tables give none. A text of any length is cut whole. Memory is bounded by a slab of texts, one term's sources and
    two blocks of sources, not by how frequent a term or how large a source is.
    """
    parts = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    summed = partial_counts(docs, slab).repartition(parts, "lang", "term", "source").sortWithinPartitions("lang", "term", "source").mapInArrow(add_up, PARTIAL)
    kept = summed.repartition(parts, "lang", "term").sortWithinPartitions("lang", "term", "source").mapInArrow(keep_terms(least), KEPT)
    kept = scratch.stage("kept", kept)
    sources = kept.groupBy("lang", "source").agg(F.sum(F.when(F.col("term").isNotNull(), F.col("n")).otherwise(0)).alias("n"), F.sum("first").alias("v"))
    every = Window.partitionBy("lang")
    sources = scratch.stage("sources", sources.select("lang", "source", "n", F.sum("n").over(every).alias("total"), F.sum("v").over(every).alias("v")))
    most = sources.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    blocks = -(-most // block) or 1
    pieces = max(PIECES, kept.count() // PIECE_ROWS)
    own = F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int")
    none = F.lit(None)
    head = sources.select("lang", none.cast("string").alias("term"), "source", "n", "total", "v", own.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("part"))
    body = kept.where("term is not null").select("lang", "term", "source", "n", "total", none.cast("long").alias("v"), own.alias("block"), F.pmod(F.xxhash64("term"), F.lit(pieces)).cast("int").alias("part"))
    rows = head.unionByName(body).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.select("lang", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "part", "term", "source", "n", "total", "v", "block")
    dealt = rows.repartitionByRange(parts, "lang", "a", "b", "part").sortWithinPartitions("lang", "a", "b", "part", "term", "source")
    found = scratch.stage("found", dealt.mapInArrow(compare(top), FOUND))
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.unionByName(found.where("part = 'term'")).withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))


_SHARE = "(1 + (1000000000::HUGEINT * ({n} + 5)) // ({total} + 5 * {v}))::BIGINT"
ORACLE = rf"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
o AS (SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY ALL HAVING count(DISTINCT id) >= {LEAST_DOCS}),
l AS (SELECT lang, sum(n) AS total, count(*) AS v FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
t AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, {_SHARE.format(n="coalesce(c.n, 0)", total="t.total", v="l.v")} AS p, {_SHARE.format(n="k.n", total="l.total", v="l.v")} AS q
  FROM t JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.other = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}"""
