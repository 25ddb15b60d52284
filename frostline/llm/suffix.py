"""Repeated byte strings across documents, found with suffix arrays.

A byte goes if a ``length``-byte string that covers it also starts in a document with a smaller doc_id. The work is split by content:

1. Every ``length``-byte window has anchors: those of its ``GRAM``-byte strings whose hash is the least in it. Equal windows have equal
   anchors, and as much of the text before or after the first of them is equal as the window holds: half of its other bytes on one side at least. A
   hash of the anchor with these bytes is the window's key: a window repeats only where its key does. A row that is a copy, by its SHA-256, of the
   text of a row with a smaller doc_id has all its windows there, and takes no part. Each task sends its keys, with their rows' numbers, packed by the
   keys' first bits; a key that two rows have is reported back to these rows. Windows whose key stands in one row alone cannot repeat and need no more work.
2. Consecutive windows of one anchor whose keys repeat form a segment of under twice ``length`` bytes. A task sends equal segments on once. Segments go
   by a 64-bit hash of their bytes, but never by it alone: a task tells them apart by their bytes, and a shard compares the bytes that different tasks
   sent under one hash. Should two segments ever share one, the work is done again with another hash.
3. Segments are dealt to shards by anchor; an anchor with more than HOT segments is dealt over several shards. Each shard
   sorts its suffixes by Larsson-Sadakane refinement (only groups that are still tied are sorted again, by the rank of the suffix
   that follows) as far as their first ``length`` bytes, for all segments of the shard side by side. Suffixes of one rank are
   equal windows: the group's least doc_id is known.
4. Shards of one anchor are merged: their sorted distinct windows are looked up in each other's by binary search.
5. Each document takes the windows that have a smaller doc_id than its own, and drops the bytes under them.

No task ever holds more than one shard, and nothing but counts reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm.common import Scratch, list_array, maybe_broadcast, text_or_empty, trim

LENGTH, GRAM = 50, 16
#: Segments of one anchor in one shard; bytes of segments sorted at once; windows merged at once.
HOT, SHARD_BYTES, MERGE = 4_096, 128 << 10, 50_000
#: Bytes of text hashed at once.
CHUNK = 256 << 10
#: Segments that a task remembers, so as to send the bytes of each once.
MEMO = 500_000
#: Bits of a key that deal it out, of a key, and of a row's number beside it; keys sent at once, bytes of keys compared at once.
DEAL_BITS, KEY_BITS, ROW_BITS, KEYS, KEY_BYTES = 12, 48, 16, 1 << 20, 8 << 20
#: Rows that are copies of others, if they are broadcast.
COPIES = 500_000


def _slide(a: np.ndarray, width: int, op) -> np.ndarray:
    """op over each run of ``width`` entries, by doubling."""
    n = 1
    while 2 * n <= width:
        a, n = op(a[:-n], a[n:]), 2 * n
    return op(a[: len(a) - (width - n)], a[width - n :]) if width > n else a


def _hashes(text: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each GRAM bytes."""
    text = np.ascontiguousarray(text)
    h = np.ndarray(len(text) - 7, "<u8", text, strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)  # of each eight bytes
    h ^= h >> np.uint64(29)
    v = h[: len(h) - (GRAM - 8)] * np.uint64(0xBF58476D1CE4E5B9)
    v += h[GRAM - 8 :]
    v ^= v >> np.uint64(32)
    v *= np.uint64(0x94D049BB133111EB)
    v ^= v >> np.uint64(31)
    return v


def _anchored(text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first window, windows, the anchor's place) of each maximal run of windows with the same first anchor, places in text; and the hash at each place."""
    if len(text) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, np.uint64)
    v = _hashes(text)
    # half a hash and the place: the least of a window is its first anchor, also where two halves are equal
    least = _slide(v & np.uint64(0xFFFFFFFF << 32) | np.arange(len(v), dtype=np.uint64), length - GRAM + 1, np.minimum)
    place = least.astype(np.uint32)
    whole = np.ones(len(text) + 1, bool)  # windows inside one document
    begins = np.concatenate([[0], ends[:-1]])
    some = begins < ends  # an empty text ends where the next begins
    for back in range(1, length):
        whole[np.maximum(ends[some] - back, begins[some])] = False
    whole = whole[: len(place)]
    cut = whole.copy()
    cut[1:] &= ~whole[:-1] | (place[1:] != place[:-1])
    first = np.flatnonzero(cut)
    # a segment ends before the next, or where its document has no more windows
    stop = np.flatnonzero(whole & np.append(cut[1:] | ~whole[1:], True)) + 1
    return np.searchsorted(ends, first, side="right"), first, stop - first, place[first].astype(np.int64), v


def segments(text: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, windows, anchor hash) of each maximal run of windows with the same first anchor.

    text: documents one after another; ends: where each ends. Starts count from the document's beginning.
    """
    owner, first, windows, place, v = _anchored(text, ends, length)
    return owner, first - np.concatenate([[0], ends[:-1]])[owner], windows, v[place].view(np.int64)


def _before(length: int) -> int:
    """Windows that begin so many bytes before their anchor, or more, have the anchor and these bytes as key; the others the anchor and the bytes after it that all of them hold."""
    return (length - GRAM) // 2


def _keys(first: np.ndarray, windows: np.ndarray, place: np.ndarray, v: np.ndarray, length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For the windows of each kind: the segments that have some, and the keys of these."""
    before = _before(length)
    after = length - GRAM - before + 1
    out = []
    for has, more, odd in ((first <= place - before, range(-before, 0, GRAM), 0x9E3779B97F4A7C15), (first + windows > place - before + 1, (*range(GRAM, after, GRAM), after), 0xD6E8FEB86659FD93)):
        at = np.flatnonzero(has)
        h = v[place[at]] * np.uint64(odd)
        for n in more:
            h ^= h >> np.uint64(32)
            h = (h ^ v[place[at] + n]) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
        out.append((at, h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - KEY_BITS)))
    return out


def suffix_order(text: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of concatenated segments that have ``depth`` bytes at least, in the order of these bytes, and the rank of each; ends: cumulative lengths.

    Larsson-Sadakane refinement: start from the order by a few bytes; while groups are tied, sort them by the rank of the suffix that
    lies as many bytes on as are known to be equal, which doubles that number each time; the last time only as far on as is missing to ``depth``, so
    equal ranks are equal bytes. A suffix with too few bytes for a round takes no part in it: no longer one asks for its rank after that.
    Sort keys carry the position in their low bits. Ties stand by position.
    """
    n = len(text)
    bits = max(n + 2, 2).bit_length()
    lengths = np.diff(np.concatenate([[0], ends]))
    left = np.repeat(ends, lengths) - np.arange(n)
    met = np.bincount(text, minlength=256) > 0
    code = np.where(met, np.cumsum(met), 0)  # the end of a segment stands before all bytes
    base = int(code.max()) + 1
    known = max(k for k in range(1, depth + 1) if k == 1 or base**k << bits < 1 << 63)
    padded = np.concatenate([code[text], np.zeros(known, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(known):
        key = key * base + np.where(left > k, padded[k : k + n], 0)
    at, low = np.arange(n), (1 << bits) - 1
    both = np.sort(key << bits | at)
    sa, both = both & low, both >> bits
    head = np.concatenate([[True], both[1:] != both[:-1]])[:n]
    group = np.maximum.accumulate(np.where(head, at, 0))
    rank, some = np.empty(n, np.int64), sa
    rank[sa] = group
    while known < depth:
        step = min(known, depth - known)
        known += step
        live = np.flatnonzero((~head | ~np.append(head[1:], True)) & (left[some] >= known))
        if not len(live):
            break
        at, some, group = at[live], some[live], group[live]
        follow = rank[some + step]
        if 3 * bits < 64:
            both = np.sort((group << bits | follow) << bits | some)
            some, both = both & low, both >> bits
            apart = both[1:] != both[:-1]
        else:
            order = np.lexsort([some, follow, group])
            some, follow = some[order], follow[order]
            apart = (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])
        sa[at] = some
        head = np.concatenate([[True], apart])
        group = np.maximum.accumulate(np.where(head, at, 0))
        rank[some] = group
    sa = sa[left[sa] >= depth]
    return sa, rank[sa]


def equal_windows(parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, offset, group) of each window of the segments, in suffix order; group numbers rise from 0."""
    text = np.frombuffer(b"".join(parts), np.uint8)
    lengths = np.array([len(x) for x in parts], np.int64)
    ends = np.cumsum(lengths)
    sa, rank = suffix_order(text, ends, length)
    owner = np.repeat(np.arange(len(parts)), lengths)[sa]
    return owner, sa - (ends - lengths)[owner], np.cumsum(np.diff(rank, prepend=rank[:1]) != 0)


#: In place of a shard's number: a segment whose windows are done with, and one of several that share a hash.
DONE, SHARED = -1, -2
RUNS = "array<struct<off:int,n:int,least:long>>"
SORTED = ["anchor", "id", "salt", "runs", "window", "offset", "least"]


def _run_lists(off: np.ndarray, n: np.ndarray, least: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """Lists of runs, the next ``sizes[i]`` of them in list i."""
    runs = pa.StructArray.from_arrays([pa.array(off.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(least.astype(np.int64))], ["off", "n", "least"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), runs)


def _runs(owner: np.ndarray, offset: np.ndarray, least: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """The segments that have windows with a least doc_id under the segment's largest, and for each the runs of windows with one least doc_id."""
    keep = least < own[owner]
    owner, offset, least = owner[keep], offset[keep], least[keep]
    order = np.lexsort([offset, owner])
    owner, offset, least = owner[order], offset[order], least[order]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1) | (least[1:] != least[:-1])])[: len(owner)]
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(owner)))
    cut = np.flatnonzero(np.concatenate([[True], owner[at][1:] != owner[at][:-1]])[: len(at)])
    return owner[at][cut], _run_lists(offset[at], size, least[at], np.diff(np.append(cut, len(at))))


def segment_hash(part: bytes, seed: int) -> int:
    """64 bits of a segment's bytes."""
    return xxhash.xxh3_64_intdigest(part, seed)


def _batch(anchor: np.ndarray, ids: np.ndarray, runs: pa.ListArray, salt: int = DONE) -> pa.RecordBatch:
    """Segments whose windows are done with, or that share a hash."""
    n = len(anchor)
    none = [pa.array(np.full(n, salt, np.int32)), runs, pa.nulls(n, pa.binary()), pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, np.int64))]
    return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(ids), *none], SORTED)


def _chunks(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """The columns of consecutive rows as arrays, the batch's part, their texts' bytes one after another, and the texts' ends."""
    for batch in batches:
        texts = batch["text"]
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        body = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, side="right")) - 1)
            yield *(batch[c].to_numpy()[i:j] for c in columns), batch.slice(i, j - i), body[at[i] : at[j]], at[i + 1 : j + 1] - at[i]
            i = j


def _bytes_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and the number of each value's."""
    parts = []
    for x in column.chunks:
        _, offsets, data = x.buffers()
        at = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(x.type) else np.int32)[x.offset : x.offset + len(x) + 1]
        parts.append((np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8), np.diff(at)))
    return np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts])


def _binary(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """data as binary values that begin at cuts."""
    offsets = (np.append(cuts, len(data)) * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _shards(batches: Iterator[pa.RecordBatch], size: int, by: tuple[str, ...] = ("anchor", "salt"), body: str = "part") -> Iterator[pa.Table]:
    """Gather rows that stand in order of ``by`` into shards of about ``size`` bytes, never cutting rows that agree in it."""
    held: list[pa.RecordBatch] = []
    total, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch[c].to_numpy() for c in by]
        bytes_so_far = np.cumsum(pc.fill_null(pc.binary_length(batch[body]), 0).to_numpy().astype(np.int64)) + total
        new = np.concatenate([[tuple(k[0] for k in keys) != last], np.any([k[1:] != k[:-1] for k in keys], axis=0)])
        start, done = 0, 0
        for at in np.flatnonzero(new):
            before = int(bytes_so_far[at - 1]) if at else total
            if before - done >= size:
                held.append(batch.slice(start, at - start))
                yield pa.Table.from_batches(held)
                held, start, done = [], at, before
        held.append(batch.slice(start))
        total, last = int(bytes_so_far[-1]) - done, tuple(k[-1] for k in keys)
    if held:
        yield pa.Table.from_batches(held)


def _copies(docs: DataFrame, scratch: Scratch, length: int) -> DataFrame:
    """(doc, mark, n_bytes) of the rows of docs (doc, mark, text) whose whole text, of ``length`` bytes at least, a row with a smaller doc has too."""
    n = F.octet_length("text")
    names = scratch.stage("names", docs.where(n >= length).select("doc", "mark", F.unhex(F.sha2("text", 256)).alias("name"), n.alias("n_bytes")))
    least = names.groupBy("name").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("name", "least")
    least = maybe_broadcast(scratch.stage("originals", least))
    copies = scratch.stage("copies", names.join(least, "name").where("doc > least").select("doc", "mark", "n_bytes").dropDuplicates(["doc", "mark"]))
    scratch.drop("names", "originals")
    return copies


def _repeated_keys(docs: DataFrame, length: int) -> DataFrame:
    """(doc, mark, keys array<long>) of the rows of docs (doc, mark, text) that have keys which other rows have too."""
    low = np.uint64((1 << ROW_BITS) - 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys with the numbers of their rows below them, sorted; ``rows`` of a sender's first message has (doc, mark) of each number."""
        held, names, n_keys, n_rows, turn = [], [], 0, 0, 0

        def messages() -> pa.RecordBatch:
            both = np.sort(np.concatenate(held))
            both = both[np.append(True, both[1:] != both[:-1])]
            deal = both >> np.uint64(KEY_BITS + ROW_BITS - DEAL_BITS)
            cuts = np.flatnonzero(np.append(True, deal[1:] != deal[:-1]))
            rows = pa.array([np.concatenate(names).tobytes(), *[None] * (len(cuts) - 1)], pa.binary())
            sender = np.full(len(cuts), TaskContext.get().partitionId() << 32 | turn)
            return pa.RecordBatch.from_arrays([pa.array(deal[cuts].astype(np.int32)), pa.array(sender), _binary(both, cuts), rows], ["deal", "sender", "both", "rows"])

        for doc, mark, _, text, ends in _chunks(batches, "doc", "mark"):
            owner, first, windows, place, v = _anchored(text, ends, length)
            if not len(owner):
                continue
            some, number = np.unique(owner, return_inverse=True)
            if held and (n_keys >= KEYS or n_rows + len(some) > 1 << ROW_BITS):
                yield messages()
                held, names, n_keys, n_rows, turn = [], [], 0, 0, turn + 1
            for at, key in _keys(first, windows, place, v, length):
                held.append(key << np.uint64(ROW_BITS) | (number[at] + n_rows).astype(np.uint64))
                n_keys += len(at)
            names.append(np.stack([doc[some], mark[some]], axis=1))
            n_rows += len(some)
        if held:
            yield messages()
        trim()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """To each sender what it sent of keys that stand twice, as no row sends one twice."""
        for table in _shards(batches, KEY_BYTES, ("deal",), "both"):
            both, sizes = _bytes_of(table["both"])
            both, sender = both.view(np.uint64), table["sender"].to_numpy()
            key = both >> np.uint64(ROW_BITS)
            order = np.argsort(key)
            key = key[order]
            same = key[1:] == key[:-1]
            twice = np.zeros(len(both), bool)
            twice[order] = np.append(same, False) | np.append(False, same)
            both, to = both[twice], np.repeat(sender, sizes // 8)[twice]
            order = np.argsort(to, kind="stable")
            both, to = both[order], to[order]
            cuts = np.flatnonzero(np.append(True, to[1:] != to[:-1])[: len(to)])
            yield pa.RecordBatch.from_arrays([pa.array(to[cuts]), _binary(both, cuts), pa.nulls(len(cuts), pa.binary())], ["sender", "both", "rows"])
            named = table.filter(table["rows"].is_valid())
            for batch in named.select(["sender", "rows"]).to_batches():
                yield pa.RecordBatch.from_arrays([batch["sender"], pa.nulls(batch.num_rows, pa.binary()), batch["rows"]], ["sender", "both", "rows"])
        trim()

    def report(table: pa.Table) -> pa.Table:
        """A sender's rows with the keys that came back."""
        both = np.sort(_bytes_of(table["both"])[0].view(np.uint64) if table["both"].null_count < table.num_rows else np.zeros(0, np.uint64))
        names = _bytes_of(table["rows"])[0].view(np.int64).reshape(-1, 2)
        number = (both & low).astype(np.uint16)
        keys = (both >> np.uint64(ROW_BITS)).view(np.int64)[np.argsort(number, kind="stable")]
        sizes = np.bincount(number, minlength=len(names))
        some = sizes > 0
        return pa.table({"doc": names[some, 0], "mark": names[some, 1], "keys": list_array(keys, sizes[some])})

    sent = docs.mapInArrow(send, "deal int, sender long, both binary, rows binary").repartition("deal").sortWithinPartitions("deal")
    found = sent.mapInArrow(compare, "sender long, both binary, rows binary")
    found = found.groupBy("sender").applyInArrow(report, "doc long, mark long, keys array<long>")
    return found.groupBy("doc", "mark").agg(F.first("keys").alias("keys"))  # rows that agree in both have the same keys


def find_repeats(docs: DataFrame, scratch: Scratch, length: int = LENGTH, hot: int = HOT, identify: Callable[[bytes, int], int] = segment_hash, seed: int = 0) -> DataFrame:
    """(doc, mark, spans array<struct<start, n>>) of each document with repeats: runs of window starts; docs (doc, mark, text).

    identify(bytes, seed) gives segments 64-bit names; where it gives two of them one, all is done again with the next seed.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} at least")

    copies = _copies(docs, scratch, length)
    originals = docs.join(maybe_broadcast(copies.select("doc", "mark"), COPIES), ["doc", "mark"], "left_anti")
    wanted = scratch.stage("wanted", _repeated_keys(originals, length))
    scratch.free_shuffles()
    before = _before(length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows of each segment whose keys other rows have; their bytes with the first of their rows in this task, and a second row is marked as well."""
        met: dict[bytes, int] = {}  # the place of each segment met in the lists
        names: list[int] = []  # equal segments have one name, and so one anchor
        lowest: list[int] = []
        twice = bytearray()
        for docs, marks, rows, text, ends in _chunks(batches, "doc", "mark"):
            owner, first, windows, place, v = _anchored(text, ends, length)
            want = np.unique(rows["keys"].flatten().to_numpy()).view(np.uint64)
            repeats = np.zeros((2, len(owner)), bool)
            for met_here, (at, key) in zip(repeats, _keys(first, windows, place, v, length), strict=True):
                met_here[at] = np.isin(key, want)
            # windows of the one kind stand before those of the other
            stop = np.where(repeats[1], first + windows, np.minimum(first + windows, place - before + 1))
            first = np.where(repeats[0], first, np.maximum(first, place - before + 1))
            at = np.flatnonzero(repeats.any(axis=0))
            owner, first, stop, hashes = owner[at], first[at], stop[at], v[place[at]].view(np.int64)
            raw, start = text.tobytes(), first - np.concatenate([[0], ends[:-1]])[owner]
            parts = [raw[i:j] for i, j in zip(first.tolist(), (stop + length - 1).tolist(), strict=True)]
            doc, send, ids = docs[owner], [False] * len(parts), []
            for k, (part, d) in enumerate(zip(parts, doc.tolist(), strict=True)):
                at = met.get(part)
                if at is None:
                    at = met[part] = len(names)
                    names.append(identify(part, seed))
                    lowest.append(d)
                    twice.append(0)
                    send[k] = True
                elif d < lowest[at]:
                    lowest[at], twice[at], send[k] = d, 1, True
                else:
                    parts[k] = None
                    if d != lowest[at] and not twice[at]:
                        twice[at], send[k] = 1, True
                ids.append(names[at])
            ids = np.array(ids, np.uint64).view(np.int64)
            if len(met) > MEMO:
                for memory in (met, names, lowest, twice):
                    memory.clear()
            cols = [pa.array(x) for x in (doc, marks[owner], start.astype(np.int32), hashes, ids, send)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(parts, pa.binary())], ["doc", "mark", "start", "anchor", "id", "send", "part"])
        trim()

    parts = docs.join(wanted, ["doc", "mark"]).select("doc", "mark", "text", "keys").mapInArrow(cut, "doc long, mark long, start int, anchor long, id long, send boolean, part binary")
    parts = scratch.stage("parts", parts)
    scratch.drop("wanted")
    scratch.free_shuffles()
    sent = parts.where("send").select("anchor", "id", "doc", "part")
    counts = sent.where("part is not null").groupBy("anchor").count().where(F.col("count") > hot).select("anchor", F.ceil(F.col("count") / hot).alias("over"))
    counts = scratch.stage("hot", counts)
    salt = F.coalesce(F.pmod(F.xxhash64("id", F.lit(5)), F.col("over")), F.lit(-1)).cast("int")
    dealt = sent.join(maybe_broadcast(counts), "anchor", "left").select("anchor", salt.alias("salt"), "id", "doc", "part")
    dealt = dealt.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "id", "doc")

    def sort_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _shards(batches, SHARD_BYTES):
            anchor, salt, ids, doc = (table[c].to_numpy() for c in ("anchor", "salt", "id", "doc"))
            first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (ids[1:] != ids[:-1])]))
            least, largest = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)
            # what was sent under one hash must be one segment, byte for byte
            begin = np.repeat(first, np.diff(first, append=len(ids)))
            again = np.flatnonzero(table["part"].is_valid().to_numpy() & (begin != np.arange(len(ids))))
            clash = again[pc.fill_null(pc.not_equal(table["part"].take(again), table["part"].take(begin[again])), True).to_numpy().astype(bool)]
            if len(clash):
                yield _batch(anchor[clash], ids[clash], _run_lists(*[np.zeros(0, np.int64)] * 3, np.zeros(len(clash), np.int64)), SHARED)
            bodies = table["part"].take(first).to_pylist()  # the least doc_id's row has the bytes
            anchor, salt, ids = anchor[first], salt[first], ids[first]
            alone = np.concatenate([[True], anchor[1:] != anchor[:-1]]) & np.concatenate([anchor[1:] != anchor[:-1], [True]]) & (salt < 0)
            at = np.flatnonzero(alone & (least < largest))  # all the anchor's rows are equal: so are their windows, and no others are
            windows = np.array([len(bodies[k]) - length + 1 for k in at.tolist()], np.int64)
            yield _batch(anchor[at], ids[at], _run_lists(np.zeros(len(at)), windows, least[at], np.ones(len(at), np.int64)))
            rest = np.flatnonzero(~alone)
            anchor, salt, ids, least, largest = (x[rest] for x in (anchor, salt, ids, least, largest))
            bodies = [bodies[k] for k in rest.tolist()]
            owner, offset, group = equal_windows(bodies, length)
            low = np.minimum.reduceat(least[owner], np.flatnonzero(np.diff(group, prepend=-1))) if len(group) else np.zeros(0, np.int64)
            cold = salt[owner] < 0
            seg, runs = _runs(owner[cold], offset[cold], low[group[cold]], largest)
            yield _batch(anchor[seg], ids[seg], runs)
            warm = np.flatnonzero(~cold)  # windows of split anchors: each with its bytes, in order
            for a in range(0, len(warm), 50_000):
                w = warm[a : a + 50_000]
                windows = [bodies[o][s : s + length] for o, s in zip(owner[w].tolist(), offset[w].tolist(), strict=True)]
                none = _run_lists(*[np.zeros(0, np.int64)] * 3, np.zeros(len(w), np.int64))
                columns = [anchor[owner[w]], ids[owner[w]], salt[owner[w]], none, pa.array(windows, pa.binary()), offset[w].astype(np.int32), low[group[w]]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], SORTED)
        trim()

    shape = f"anchor long, id long, salt int, runs {RUNS}, window binary, offset int, least long"
    sorted_ = dealt.mapInArrow(sort_shards, shape)
    sorted_ = scratch.stage("sorted", sorted_)
    scratch.free_shuffles()
    if not sorted_.where(F.col("salt") == SHARED).isEmpty():
        scratch.drop("parts", "sorted", "hot", "copies")
        return find_repeats(docs, scratch, length, hot, identify, seed + 1)
    runs = sorted_.where("salt < 0").select("anchor", "id", F.explode("runs").alias("r")).select("anchor", "id", "r.*")
    split = sorted_.where("salt >= 0").select("anchor", "id", "salt", "window", "offset", "least")
    runs = runs.unionByName(_merged(split, counts, hot, length))
    places = parts.select("doc", "mark", "start", "anchor", "id")
    hit = places.join(runs, ["anchor", "id"]).where(F.col("least") < F.col("doc")).select("doc", "mark", (F.col("start") + F.col("off")).alias("start"), "n")
    hit = hit.unionByName(copies.select("doc", "mark", F.lit(0).alias("start"), (F.col("n_bytes") - length + 1).alias("n")))
    return hit.groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def _merged(split: DataFrame, counts: DataFrame, hot: int, length: int) -> DataFrame:
    """(anchor, id, off, n, least) of the windows of anchors that several shards share: the least doc_id of the shard, and that of all shards where it is lower.

    A window goes to a part of its anchor by its own hash, so a part holds a sorted run of each shard, and all equal windows.
    """
    keys = split.groupBy("anchor", "salt", "window").agg(F.min("least").alias("least"))
    keys = keys.join(maybe_broadcast(counts), "anchor").withColumn("part", F.pmod(F.xxhash64("window"), F.col("over") * (-(-hot * length // MERGE))).cast("int"))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        have, low = np.zeros(0, f"S{length}"), np.zeros(0, np.int64)
        for _, run in pdf.groupby("salt"):
            words, docs = np.array(run["window"].tolist(), f"S{length}"), run["least"].to_numpy()
            order = np.argsort(words)
            words, docs = words[order], docs[order]
            at = np.searchsorted(have, words)
            same = (at < len(have)) & (have[np.minimum(at, len(have) - 1)] == words) if len(have) else np.zeros(len(words), bool)
            low[at[same]] = np.minimum(low[at[same]], docs[same])
            have, low = np.insert(have, at[~same], words[~same]), np.insert(low, at[~same], docs[~same])
        at = np.searchsorted(have, np.array(pdf["window"].tolist(), f"S{length}"))
        found = low[at]
        better = found < pdf["least"].to_numpy()
        return pd.DataFrame({"anchor": pdf["anchor"], "salt": pdf["salt"], "window": pdf["window"], "better": found})[better]

    better = keys.select("anchor", "salt", "window", "least", "part").groupBy("anchor", "part").applyInPandas(merge, "anchor long, salt int, window binary, better long")
    lower = split.join(better, ["anchor", "salt", "window"]).withColumn("least", F.col("better"))  # beside what each shard knows itself
    out = split.select("anchor", "id", "offset", "least").unionByName(lower.select("anchor", "id", "offset", "least"))
    return out.select("anchor", "id", F.col("offset").alias("off"), F.lit(1).alias("n"), "least")


def remove_repeats(docs: DataFrame, scratch: Scratch, length: int = LENGTH, hot: int = HOT, identify: Callable[[bytes, int], int] = segment_hash) -> DataFrame:
    """docs (doc_id, text; other columns stay out) with what is left of each: doc_id, n_bytes, n_removed, n_spans, kept binary.

    Removed is each byte under a ``length``-byte string that also starts in a row with a smaller doc_id, judged on the input. Null texts
    are empty. Rows of one doc_id remove nothing from each other; null ids stand before all others. Strings may begin and end
    inside a character, so what is left is bytes. An empty table gives none.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), text_or_empty().alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    spans = scratch.stage("spans", find_repeats(rows.select("doc", "mark", "text"), scratch, length, hot, identify))
    scratch.drop("parts", "sorted", "hot", "copies")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, texts = batch["spans"], batch["text"].cast(pa.binary())
            runs = spans.flatten()
            start, n = (runs.field(c).to_numpy() for c in ("start", "n"))
            ends = np.cumsum(pc.fill_null(spans.value_lengths(), 0).to_numpy())
            kept, facts, last = [], [], 0
            for k, end in enumerate(ends.tolist()):
                body = texts[k].as_py()
                if end == last:
                    kept.append(body)
                    facts.append((len(body), 0, 0))
                    continue
                edge = np.zeros(len(body) + 1, np.int64)
                np.add.at(edge, start[last:end], 1)
                np.add.at(edge, start[last:end] + n[last:end] + length - 1, -1)
                gone = np.cumsum(edge)[:-1] > 0
                facts.append((len(body), int(gone.sum()), int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))))
                kept.append(np.frombuffer(body, np.uint8)[~gone].tobytes())
                last = end
            numbers = [pa.array(c, pa.int64()) for c in zip(*facts, strict=True)] or [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *numbers, pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    held = rows.join(spans, ["doc", "mark"], "left").select("doc_id", "text", "spans")
    return held.mapInArrow(strip, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(stripped: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of stripped documents."""
    return stripped.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int | None, str | None]], length: int = LENGTH) -> list[tuple]:
    """The definition, for tests: (doc_id, n_bytes, n_removed, n_spans, kept_sha256) of few small rows."""
    low = lambda i: -(2**63) if i is None else i
    least: dict[bytes, int] = {}
    for i, x in rows:
        b = (x or "").encode()
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            least[w] = min(least.get(w, 2**63), low(i))
    out = []
    for i, x in rows:
        b = (x or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if least[b[k : k + length]] < low(i):
                gone[k : k + length] = [True] * length
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out
