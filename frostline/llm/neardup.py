"""Near-duplicate classes by BagMinHash: weighted Jaccard similarity of multisets of word shingles.

1. A text's bag is the multiset of its runs of five words. Texts with one bag are one unit from here on, however often they stand.
2. BagMinHash signature of each bag: a shingle of weight w is a Poisson process over the weights (0, w]. The weights are split into dyadic
   blocks (1, 1, 2, 4, ...), each the root of a tree of processes, seeded by the shingle and the block. A process over an interval gives its
   first point and is then split in halves: one takes the point over, the other draws its own, later one; the half of a block that lies
   beyond w is never entered. A point falls on one of M registers, which keep the earliest time. Processes whose point is later than the
   latest register end. Two registers agree with the probability of the bags' weighted Jaccard similarity.
3. Bands of ROWS registers give buckets. In a bucket only pairs with one of two pivots are looked at, so a bucket of n units costs 2n checks
   at most, and links found join components.
4. Units of buckets that still hold several components are searched by their rarest shingles: bags that are similar enough share one of
   the first n - ceil(s n) + 1 of a bag's n items in order of their frequency. Items that one bag alone has take part in the order but never
   meet. So what bags have in common with thousands (a licence, a menu) brings no pairs about. Sizes, places in the order and four bits of each register
   are compared in the join, so that pairs come out of it only where links are likely, and each from the first item that its two bags share.
5. Every link is verified on whole bags. Classes are the components of the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.llm.common import BROADCAST_ROWS, Scratch, maybe_broadcast, packed, text_or_empty, trim, unpacked

WORDS, SIMILARITY = 5, 0.8
#: Registers, and registers in a band: a pair of similarity 0.8 shares no band with a probability of 5e-8.
M, ROWS = 128, 4
#: Words gathered for one step, and words whose hashes a worker remembers.
CHUNK, MEMO = 100_000, 100_000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > MEMO:
            self.clear()
        self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return self[word]


def bags(texts: list[str], memo: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, weight) of each distinct shingle, by text and shingle; shingles are 47-bit hashes, lower-case words between white space.

    A text of fewer than five words has one shingle of them all; one without words has none.
    """
    words = [x.lower().split() for x in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    h = np.fromiter((memo[x] for w in words for x in w), np.uint64, int(sizes.sum()))
    pad = np.zeros(WORDS - 1, np.uint64)
    mixed, h = np.zeros(len(h), np.uint64), np.concatenate([h, pad])
    begin = np.cumsum(sizes) - sizes
    left = np.repeat(begin + sizes, sizes) - np.arange(len(mixed))
    for k in range(WORDS):
        mixed = _mix(mixed * _GOLDEN + np.where(left > k, h[k : k + len(mixed)], np.uint64(0)))
    owner = np.repeat(np.arange(len(texts)), sizes)
    first = np.arange(len(mixed)) == begin[owner] if len(mixed) else np.zeros(0, bool)
    keep = (left >= WORDS) | (first & (sizes[owner] < WORDS) if len(mixed) else first)
    both = np.sort((owner[keep] << 47) | (mixed[keep] >> np.uint64(17)).astype(np.int64))
    new = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])[: len(both)])
    return both[new] >> 47, both[new] & ((1 << 47) - 1), np.diff(np.append(new, len(both)))


def signatures(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """BagMinHash registers (n x M) of n bags: the earliest times, inf for an empty bag."""
    full = np.full(n * M, np.inf)
    top = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)  # the last block: 0 is (0, 1], j is (2^(j-1), 2^j]
    at = np.repeat(np.arange(len(owner)), top + 1)
    block = np.arange(len(at)) - np.repeat(np.cumsum(top + 1) - (top + 1), top + 1)
    who, limit = owner[at], weight[at]
    low = np.where(block > 0, 1 << np.maximum(block - 1, 0), 0)
    width = np.maximum(low, 1)
    seed = _mix((shingle[at].astype(np.uint64) << np.uint64(6)) + block.astype(np.uint64) + np.uint64(1))
    time, place = _point(seed, np.zeros(len(at)), width)
    while len(who):
        inside = low + width <= limit
        np.minimum.at(full, who[inside] * M + place[inside], time[inside])
        live = time < full.reshape(n, M).max(axis=1)[who]
        who, limit, low, width, seed, time, place = (x[live] for x in (who, limit, low, width, seed, time, place))
        # a process over one weight goes on by itself; others are split in halves, of which one keeps the point
        seed = _mix(seed + _GOLDEN)
        wide = width > 1
        time[~wide], place[~wide] = _point(seed[~wide], time[~wide], width[~wide])
        cut = np.flatnonzero(wide)
        if not len(cut):
            continue
        half = width[cut] >> 1
        right = (seed[cut] >> np.uint64(63)).astype(np.int64)  # 1: the right half keeps the point
        other = _mix(seed[cut] ^ np.uint64(0xD6E8FEB86659FD93))
        later, fresh = _point(other, time[cut], half)
        new = (who[cut], limit[cut], low[cut] + half * (1 - right), half, other, later, fresh)
        width[cut] = half
        low[cut] += half * right
        who, limit, low, width, seed, time, place = (np.concatenate(x) for x in zip((who, limit, low, width, seed, time, place), new, strict=True))
        reached = low < limit
        who, limit, low, width, seed, time, place = (x[reached] for x in (who, limit, low, width, seed, time, place))
    return full.reshape(n, M)


def _point(seed: np.ndarray, after: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time and register of the next point of processes with the rate ``width``."""
    u = _mix(seed + np.uint64(0x2545F4914F6CDD1D))
    return after - np.log(((u >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / width, (u & np.uint64(M - 1)).astype(np.int64)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band, which holds the band's number."""
    bits = registers.view(np.uint64).reshape(len(registers), M // ROWS, ROWS)
    key = np.broadcast_to(np.arange(M // ROWS, dtype=np.uint64), bits.shape[:2]).copy()
    for k in range(ROWS):
        key = _mix(key * _GOLDEN + bits[:, :, k])
    return key.view(np.int64)


def sketches(registers: np.ndarray) -> np.ndarray:
    """Four bits of each register, 16 registers to a 64-bit word."""
    bits = (registers.view(np.uint64) * _GOLDEN >> np.uint64(60)).reshape(len(registers), M // 16, 16)
    return (bits << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64).view(np.int64)


def _text_chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[str]]]:
    """Bounds of consecutive rows and their texts; a batch's other texts stay in Arrow meanwhile."""
    i, size = 0, 0
    for j, n in enumerate(pc.binary_length(batch["text"]).to_pylist(), 1):
        size += n + 20
        if size > 6 * CHUNK or j == batch.num_rows or j - i == 1 << 15:
            yield i, j, batch["text"].slice(i, j - i).to_pylist()
            i, size = j, 0


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, uid, n, bands, sketch) of each row of docs (doc_id, mark, text): uid tells bags apart, n is the bag's total weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            for i, j, texts in _text_chunks(batch):
                owner, shingle, weight = bags(texts, memo)
                registers = signatures(owner, shingle, weight, len(texts))
                keys, words = band_keys(registers), sketches(registers)
                cut = np.searchsorted(owner, np.arange(len(texts) + 1))
                packed = np.column_stack([shingle, weight])
                uid = [xxhash.xxh3_128_digest(packed[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                n = np.bincount(owner, weight, len(texts)).astype(np.int64)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
                short = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * words.shape[1]), pa.array(words.ravel()))
                rows = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([rows["doc_id"], rows["mark"], pa.array(uid, pa.binary()), pa.array(n), bands, short], ["doc_id", "mark", "uid", "n", "bands", "sketch"])
        trim()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, mark long, uid binary, n long, bands array<long>, sketch array<long>")


def bag_table(docs: DataFrame) -> DataFrame:
    """(uid, bag): each distinct shingle with its occurrences counted out, as sorted hashes: a set whose overlaps are those of the multiset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            for i, j, texts in _text_chunks(batch):
                owner, shingle, weight = bags(texts, memo)
                at = np.repeat(np.arange(len(owner)), weight)
                turn = np.arange(len(at)) - np.repeat(np.cumsum(weight) - weight, weight)
                items = (_mix(shingle[at].astype(np.uint64) + (turn.astype(np.uint64) << np.uint64(47))) >> np.uint64(1)).astype(np.int64)
                order = np.lexsort([items, owner[at]])
                cut = np.searchsorted(owner[at], np.arange(len(texts) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch["uid"].slice(i, j - i), pa.ListArray.from_arrays(pa.array(cut), pa.array(items[order]))], ["uid", "bag"])
        trim()

    return docs.select("uid", "text").mapInArrow(run, "uid binary, bag array<long>")


def verify(pairs: DataFrame, bag: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (u, v) whose whole bags are similar enough. Bags of v travel with the pairs, those of u wait where pairs of one u meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch["a"], batch["b"]
            keep = []
            for k in range(batch.num_rows):
                x, y = a[k].values.to_numpy(), b[k].values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= similarity * max(len(x), len(y)) - 1e-9 else 0
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9 and both > 0)
            yield pa.RecordBatch.from_arrays([batch["u"].filter(pa.array(keep, pa.bool_())), batch["v"].filter(pa.array(keep, pa.bool_()))], ["u", "v"])

    with_v = pairs.join(bag.select(F.col("uid").alias("v"), F.col("bag").alias("b")), "v")
    both = with_v.join(bag.select(F.col("uid").alias("u"), F.col("bag").alias("a")), "u")
    return both.select("u", "v", "a", "b").mapInArrow(run, "u binary, v binary")


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(uid, label) of each unit in links (u, v): the least uid of its component.

    In a round each unit takes the least label of its neighbours and hands it to the root that its own label names, then labels jump once along
    labels. So whole trees move at once, and a chain of links takes about the logarithm of its length in rounds. Labels only fall, so the loop
    ends, and when a round changes none, all neighbours have one label: a component's least uid. Labels are broadcast while there are few.
    """
    edges = scratch.stage(f"{name}-edges", links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = scratch.stage(f"{name}-0", edges.groupBy(F.col("u").alias("uid")).agg(F.min("v").alias("m")).select("uid", F.least("uid", "m").alias("label")))
    small = labels.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # every round has as many
    side = F.broadcast if small else lambda df: df
    for k in count(1):
        near = edges.join(side(labels), edges["v"] == labels["uid"]).groupBy("u").agg(F.min("label").alias("near"))
        near = near.join(side(labels), labels["uid"] == near["u"]).select("uid", F.least("label", "near").alias("near"), F.col("label").alias("old"))
        own = F.struct("uid", F.col("near").alias("label"), "old")
        root = F.struct(F.col("old").alias("uid"), F.col("near").alias("label"), F.lit(None).cast("binary").alias("old"))
        new = near.select(F.explode(F.when(F.col("near") == F.col("old"), F.array(own)).otherwise(F.array(own, root))).alias("r")).select("r.*")
        new = scratch.stage(f"{name}-{k}n", new.groupBy("uid").agg(F.min("label").alias("label"), F.max("old").alias("old")))
        if new.where("label != old").isEmpty():
            scratch.drop(f"{name}-{k}n")
            break
        jump = new.select(F.col("uid").alias("at"), F.col("label").alias("further"))
        labels = scratch.stage(f"{name}-{k}", new.join(side(jump), new["label"] == jump["at"]).select("uid", F.col("further").alias("label")))
        scratch.drop(f"{name}-{k - 1}", f"{name}-{k}n")
    scratch.drop(f"{name}-edges")
    return labels


def near_duplicates(docs: DataFrame, scratch: Scratch, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, mark, class_id, class_key) of each row of docs (doc_id, text): class_id is the least doc_id of the row's class, class_key tells classes apart.

    Rows are in one class if a chain of texts leads from one to the other in which neighbours have a weighted Jaccard similarity of five-word
    shingles of at least ``similarity``. Words are lower-case, between white space; a text of fewer words has one shingle of them
    all. Texts without words, null and empty ones, make one class; texts of any length count whole. Repeated rows stay, each in the same class. A null doc_id
    counts as larger than all others, so a class has a null id only if all its rows do. Classes share a class_id where unrelated texts have
    one doc_id or none; class_key is then still each class's own. ``mark`` is a hash of id and text; other columns stay out. An empty table gives none.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("mark", F.xxhash64("doc_id", "text"))
    signed = scratch.stage("signed", sign(rows.select("doc_id", "mark", "text")))
    least = F.min(F.struct(F.isnull("doc_id").alias("late"), F.col("doc_id").alias("least"), "mark")).alias("row")
    units = signed.groupBy("uid").agg(least, F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.max("n").alias("n"))
    units = scratch.stage("units", units.select("uid", "row.least", "row.mark", "bands", "sketch", "n"))
    banded = units.where("n > 0").select("uid", "n", F.explode("bands").alias("bucket"))
    pivots = banded.groupBy("bucket").agg(F.min(F.struct("uid", "n")).alias("lo"), F.max(F.struct("uid", "n")).alias("hi")).where("lo.uid != hi.uid")
    members = scratch.stage("members", banded.join(pivots, "bucket").select("bucket", "uid", "n", "lo", "hi"))
    wanted = members.select("uid").distinct().join(units.select("uid", "least", F.col("mark").alias("m")), "uid").select("uid", "least", "m")
    wanted = scratch.stage("wanted", wanted)
    own = (F.col("mark") == F.col("m")) & F.col("doc_id").eqNullSafe(F.col("least"))
    bag = scratch.stage("bags", bag_table(rows.join(maybe_broadcast(wanted), own).dropDuplicates(["uid"]).select("uid", "text")))
    scratch.drop("wanted")

    pairs = _pivot_pairs(members, "lo", similarity)
    good = scratch.stage("good-lo", verify(pairs, bag, similarity))
    # what hangs on the first pivot together with the second needs no check of its own
    linked = _hanging(members, good)
    both = linked.where("hangs and uid = hi.uid").select("bucket", F.lit(True).alias("one"))
    rest = linked.join(both, "bucket", "left").where("not (hangs and coalesce(one, false)) and uid != lo.uid").select("bucket", "uid", "n", "lo", "hi")
    links = good.unionByName(scratch.stage("good-hi", verify(_pivot_pairs(rest, "hi", similarity), bag, similarity)))
    label = components(links, scratch, "pivots")
    named = _labelled(members.select("bucket", F.col("uid").alias("u")), label, "u")
    mixed = named.groupBy("bucket").agg(F.min("u_label").alias("a"), F.max("u_label").alias("b")).where("a != b").select("bucket")
    open_ = scratch.stage("open", members.select("bucket", "uid").join(mixed, "bucket").select(F.col("uid").alias("u")).distinct())
    scratch.drop("members")
    more = scratch.stage("more", verify(_rare_pairs(open_, units, bag, label, similarity), bag, similarity))
    # components of components: links between labels
    ends = _labelled(_labelled(more, label, "u"), label, "v").select(F.col("u_label").alias("u"), F.col("v_label").alias("v"))
    merged = components(ends, scratch, "merged").select(F.col("uid").alias("old"), F.col("label").alias("root"))
    scratch.drop("bags", "open")

    named = units.join(label, "uid", "left").select("uid", "least", F.coalesce("label", "uid").alias("label"))
    named = named.join(merged, named["label"] == merged["old"], "left").select("uid", "least", F.coalesce("root", "label").alias("label"))
    class_ids = named.groupBy("label").agg(F.min("least").alias("class_id"))
    unit_class = scratch.stage("classes", named.join(class_ids, "label").select("uid", "class_id", F.col("label").alias("class_key")))
    scratch.drop("units", "good-lo", "good-hi", "more")
    return signed.select("doc_id", "mark", "uid").join(unit_class, "uid").select("doc_id", "mark", "class_id", "class_key")


def _pivot_pairs(members: DataFrame, pivot: str, similarity: float) -> DataFrame:
    """(u, v), each once: members v and their buckets' pivots u, of sizes that allow the similarity."""
    size, top = F.col("n").cast("double"), F.col(f"{pivot}.n").cast("double")
    fits = (F.col("uid") != F.col(f"{pivot}.uid")) & (F.least(size, top) >= similarity * F.greatest(size, top) - 1e-9)
    return members.where(fits).select(F.col(f"{pivot}.uid").alias("u"), F.col("uid").alias("v")).distinct()


def _hanging(members: DataFrame, good: DataFrame) -> DataFrame:
    """members with hangs: whether the unit is its bucket's first pivot or linked to it."""
    good = good.select(F.col("u").alias("g_u"), F.col("v").alias("g_v"))
    found = members.join(good, (F.col("lo.uid") == F.col("g_u")) & (F.col("uid") == F.col("g_v")), "left")
    return found.select("bucket", "uid", "n", "lo", "hi", (F.col("g_u").isNotNull() | (F.col("uid") == F.col("lo.uid"))).alias("hangs"))


def _labelled(df: DataFrame, label: DataFrame, column: str) -> DataFrame:
    named = label.select(F.col("uid").alias(column), F.col("label").alias(f"{column}_label"))
    return df.join(named, column, "left").withColumn(f"{column}_label", F.coalesce(f"{column}_label", column))


def _rare_pairs(rest: DataFrame, units: DataFrame, bag: DataFrame, label: DataFrame, similarity: float) -> DataFrame:
    """Candidate pairs (u, v) of different components among the units of rest (u): an exact prefix join on their bags' rarest items.

    Frequencies are counted over the bags of rest. A bag with more items of its own than its prefix is long can have no partner.
    """
    items = rest.select(F.col("u").alias("uid")).join(bag, "uid").select("uid", F.size("bag").alias("n"), F.explode("bag").alias("item"))
    shared = items.groupBy("item").agg(F.count("*").cast("int").alias("f")).where("f > 1")
    held = items.join(shared, "item").groupBy("uid", "n").agg(F.sort_array(F.collect_list(F.struct("f", "item"))).alias("common"))
    first = (F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1).cast("int")  # items of a prefix
    alone = F.col("n") - F.size("common")
    held = held.withColumn("alone", alone).where(F.col("alone") < first).withColumn("prefix", F.slice("common", 1, F.least(first - F.col("alone"), F.size("common"))))
    held = held.withColumn("prefix", F.col("prefix.item")).select(F.col("uid").alias("u"), "n", "alone", "prefix", F.posexplode("prefix").alias("at", "item"))
    held = held.select("u", "n", (F.col("alone") + F.col("at")).alias("at"), "item", F.slice("prefix", F.lit(1), F.col("at")).alias("before"))
    held = _labelled(held, label, "u").join(units.select(F.col("uid").alias("u"), "sketch"), "u")
    # both sides are the same but for their columns' names, so that they share one shuffle
    one, two = (held.select(*[F.col(c).alias(f"{c}{k}") for c in held.columns]) for k in (1, 2))
    # a loop over the words, not 8 times its code: methods of over 8,000 bytes are never compiled by the JVM
    agree = F.aggregate(F.zip_with("sketch1", "sketch2", _equal_registers), F.lit(0), lambda total, k: total + k)
    needed = similarity / (1 + similarity) * (F.col("n1") + F.col("n2")) - 1e-9
    test = (
        (F.col("u1") < F.col("u2")) & (F.col("u_label1") != F.col("u_label2")) & (F.least("n1", "n2") >= similarity * F.greatest("n1", "n2").cast("double") - 1e-9)
        & (F.least(F.col("n1") - F.col("at1"), F.col("n2") - F.col("at2")) >= needed) & (agree >= _agreeing(similarity))
        & ~F.arrays_overlap("before1", "before2")
    )
    return one.join(two, F.col("item1") == F.col("item2")).where(test).select(F.col("u1").alias("u"), F.col("u2").alias("v"))


def _equal_registers(a: Column, b: Column) -> Column:
    """How many of the 16 four-bit parts of two words are equal."""
    x = a.bitwiseXOR(b)
    x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
    x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
    return 16 - F.bit_count(x)


def _agreeing(similarity: float) -> int:
    """Registers that agree in four bits, less 5.3 deviations: bags of this similarity fall under it once in 10^7 pairs."""
    p = similarity + (1 - similarity) / 16
    return max(0, int(M * p - 5.3 * (M * p * (1 - p)) ** 0.5))


def keep_one(docs: DataFrame, scratch: Scratch, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, with their columns, that stand for their classes: those with the class's least doc_id; of rows with one id and text, one.

    Rows with one doc_id and different texts in a class: the one whose text hashes least stays. Each class keeps its own row, also where
    unrelated texts share a doc_id or have none. Null and empty texts are one class, of which one row stays; an empty table gives none.
    Columns of docs may have any name.
    """
    found = near_duplicates(docs, scratch, similarity).where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    kept = scratch.stage("kept", found.groupBy("class_key").agg(F.min("doc_id").alias("__id"), F.min("mark").alias("__mark")))
    scratch.drop("signed", "classes")
    marked = packed(docs, F.col("doc_id").alias("id"), F.xxhash64("doc_id", text_or_empty()).alias("m"))
    once = marked.join(maybe_broadcast(kept), (F.col("m") == F.col("__mark")) & F.col("id").eqNullSafe(F.col("__id")), "left_semi")
    repeated = once.groupBy("m").count().where("count > 1").select(F.col("m").alias("r"))
    repeated = maybe_broadcast(scratch.stage("repeated", repeated))
    single = once.join(repeated, once["m"] == repeated["r"], "left_anti")
    several = once.join(repeated, once["m"] == repeated["r"], "left_semi").dropDuplicates(["m"])
    return unpacked(single.unionByName(several), docs)


def brute_force(rows: list[tuple[int, str | None]], similarity: float = SIMILARITY) -> dict[int, int]:
    """The definition, for tests: doc_id -> class_id of few small rows with distinct ids."""
    from collections import Counter

    held = []
    for _, text in rows:
        w = (text or "").lower().split()
        runs = [tuple(w[i : i + WORDS]) for i in range(len(w) - WORDS + 1)] if len(w) >= WORDS else [tuple(w)] if w else []
        held.append(Counter(runs))
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both, either = sum((held[i] & held[j]).values()), sum((held[i] | held[j]).values())
            if either == 0 or both >= similarity * either - 1e-9:
                a, b = sorted((root(i), root(j)), key=lambda k: rows[k][0])
                parent[b] = a
    least: dict[int, int] = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return {doc: least[root(i)] for i, (doc, _) in enumerate(rows)}
