"""Token ids in a compact binary table: one zstandard frame a document under a shared dictionary.

File format: a folder with three Parquet tables.

* ``blocks`` (part, block, frames): ``frames`` is the frames of consecutive documents, one after another. A frame is one
  document's ids as little-endian unsigned integers of ``id_bytes`` bytes, compressed on its own under the dictionary.
* ``index`` (part, row, doc_id, block, offset, length, n_tokens, start, dict_hash): where each document's frame lies, and the
  ids of all documents before it. A short document is read by one index row and one slice of a block.
* ``dictionary`` (dict_hash, id_bytes, body): the shared dictionary and its sha256.

Documents stand in ascending doc_id order (null ids first; equal ids by the crc of their ids). Parts are ranges of doc_id, so only the
totals of the parts, a row each, are summed up in order. Spark's committer writes the tables: a task that runs again leaves nothing twice.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from frostline.llm.common import Scratch, text_or_empty, trim

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
#: The dictionary: its size, and the sample it is trained on. Only short texts profit from it, so it samples those.
DICT_BYTES, SAMPLE_DOCS, SAMPLE_CHARS = 64 << 10, 2_000, 16_384
LEVEL = 3
#: Frames gathered in one block, and texts encoded at once, both in bytes.
BLOCK_BYTES, BATCH_BYTES = 4 << 20, 12_000_000
#: Pieces whose ids a worker remembers (about 50 bytes each): runs after a space, runs without one, and all others; the longest of them in bytes.
MEMO, BARE, MADE, SHORT = 1_000_000, 200_000, 150_000, 64
#: New runs encoded as one text.
TOGETHER = 500

#: Letters, digits and signs that the byte-level pattern keeps in runs of their own: Latin and Cyrillic letters, ASCII digits, ASCII signs but the
#: apostrophe (it begins contractions). All other bytes are of kind 0.
_LETTERS, _DIGITS, _SIGNS = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0400-\u0481\u048a-\u052f", "0-9", r"!-&(-/:-@\[-`{-~"
_KIND, _PAIRED = np.zeros(256, np.uint8), np.zeros(1 << 16, bool)
for _n, _set in enumerate((_LETTERS, _DIGITS, _SIGNS), 1):
    for _c in re.findall(f"[{_set}]", "".join(map(chr, range(0x800)))):
        _c = _c.encode()
        if len(_c) == 1:
            _KIND[_c[0]] = _n
        else:
            _PAIRED[_c[0] << 8 | _c[1]] = True
#: First two bytes of what may be white space: no cut before a space that stands before them.
_WHITE = np.zeros(1 << 16, bool)
for _b in (*range(9, 14), *range(28, 33)):
    _WHITE[_b << 8 : _b + 1 << 8] = True
_WHITE[[0xC285, 0xC2A0, 0xE19A, 0xE280, 0xE281, 0xE380]] = True


def pieces(data: np.ndarray, edges: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of texts begin in their bytes, and whether each is one run of letters, digits or signs after a space at most.

    edges: where each text begins, and the end; whole: numbers of the texts that stay uncut. Cut is at spaces that no white space follows,
    between runs of different kinds, and around one or two line ends between runs: there the byte-level pattern begins anew in any case, and finds
    before it what it finds in the piece alone. A space that ends a text, or more line ends, may be one piece with what stands before.
    """
    n, begins, ends = len(data), edges[:-1], edges[1:]
    padded = np.concatenate([data, np.zeros(2, np.uint8)])
    kind = np.frombuffer(bytearray(padded.tobytes().translate(_KIND.tobytes())), np.uint8)
    wide = np.flatnonzero(data >= 0xC0)
    wide = wide[_PAIRED[padded[wide].astype(np.uint16) << 8 | padded[wide + 1]]]
    kind[wide] = kind[wide + 1] = 1
    run = kind > 0
    cut = np.zeros(n + 2, bool)
    cut[1:] = (kind[1:] != kind[:-1]) & run[1:] & run[:-1]
    space = np.flatnonzero(data == 32)
    cut[space] = ~_WHITE[padded[space + 1].astype(np.uint16) << 8 | padded[space + 2]]
    some = begins < ends
    cut[ends[some][data[ends[some] - 1] == 32] - 1] = False  # of the next text is nothing known
    line = np.flatnonzero(data == 10)
    line = line[run[line - 1] & (line > 0)]
    one = line[run[line + 1]]
    two = line[padded[line + 1] == 10]
    last = np.zeros(n + 2, bool)
    last[edges] = True
    two = two[run[two + 2] & ~last[two + 2]]
    cut[one] = cut[one + 1] = cut[two] = cut[two + 1] = cut[two + 2] = True
    cut[begins[some]] = True
    odd = ~run[:n]
    odd[space[cut[space]]] = False
    for k in whole.tolist():
        cut[edges[k] + 1 : edges[k + 1]] = False
        odd[edges[k]] = True
    at = np.flatnonzero(cut[:n])
    alone = (data[at] == 32) & (np.diff(at, append=n) == 1)
    return at, ~(np.logical_or.reduceat(odd, at) | alone) if n else alone


class Memory:
    """The ids of at most ``most`` pieces, as Arrow columns; beyond, the half met last stays."""

    def __init__(self, most: int):
        self.most, self.now = most, 0
        self.names = self.ids = pa.array([], pa.large_binary())
        self.met = np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.names)

    def find(self, names: pa.Array) -> np.ndarray:
        """The place of each name, -1 where it is unknown."""
        at = pc.fill_null(pc.index_in(names, value_set=self.names), -1).to_numpy()
        self.now += 1
        self.met[at[at >= 0]] = self.now
        return at

    def keep(self, names: pa.Array, ids: pa.Array) -> None:
        some = pc.less_equal(pc.binary_length(names), SHORT)
        self.names, self.ids = (pa.concat_arrays([x, y.filter(some)]) for x, y in ((self.names, names), (self.ids, ids)))
        self.met = np.append(self.met, np.full(len(self.names) - len(self.met), self.now))
        if len(self.names) > self.most:
            last = np.sort(np.argsort(self.met, kind="stable")[len(self.met) - self.most // 2 :])
            self.names, self.ids, self.met = self.names.take(pa.array(last)), self.ids.take(pa.array(last)), self.met[last]


def _binaries(sizes: np.ndarray, data: np.ndarray) -> pa.Array:
    """Byte strings of the given sizes, one after another in data."""
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes texts with the tokenizers library, a distinct piece once.

    Texts are cut where the byte-level pattern cuts them too (``pieces``), so the ids of a text are those of its pieces, one after another. New runs are
    encoded many at once: after a space, the ids of each begin with the one id that holds its space; others are joined by line ends. Pieces of
    another make are encoded one by one, and a text that names an added token (as <|endoftext|>) whole, as the library then cuts it elsewhere.

    What is remembered is bounded by ``MEMO``, ``BARE`` and ``MADE``.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2") if max(self.tokenizer.get_vocab_size(), END_ID + 1) <= 1 << 16 else np.dtype("<u4")
        names = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.spaced = np.array([names.get(i, "").startswith("Ġ") for i in range(max(names) + 1)])
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo, self.bare, self.made = Memory(MEMO), Memory(BARE), Memory(MADE)
        self.line = self._ids(["\n"])[0]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _singly(self, new: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
        """The ids of pieces one after another, and how many each has."""
        ids = [x for at in range(0, len(new), 20_000) for x in self._ids([x.decode() for x in new[at : at + 20_000].to_pylist()])]
        return ids, np.fromiter(map(len, ids), np.int64, len(ids))

    def _together(self, new: pa.Array, spaced: bool) -> tuple[list[np.ndarray], np.ndarray]:
        """As ``_singly``, of runs that all follow a space, and so can be joined by nothing, or all do not, and are joined by line ends."""
        if not spaced and len(self.line) != 1:
            return self._singly(new)
        out, sizes = [], [np.zeros(0, np.int64)]
        for at in range(0, len(new), 40 * TOGETHER):
            groups = [new[k : k + TOGETHER] for k in range(at, min(at + 40 * TOGETHER, len(new)), TOGETHER)]
            between = b"" if spaced else b"\n"
            for group, ids in zip(groups, self._ids([between.join(g.to_pylist()).decode() for g in groups]), strict=True):
                if spaced:
                    begin = np.flatnonzero(self.spaced[ids])
                    size = np.diff(begin, append=len(ids))
                else:
                    begin = np.concatenate([[0], np.flatnonzero(ids == self.line[0]) + 1])
                    size = np.diff(begin, append=len(ids) + 1) - 1
                    ids = ids[ids != self.line[0]]
                if len(begin) != len(group) or begin[0]:
                    ids, size = self._singly(group)
                    ids = np.concatenate(ids)
                out.append(ids)
                sizes.append(size)
        return out, np.concatenate(sizes)

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text and the end id, as bytes.

        Arrow tells the distinct pieces and looks each up once; the ids are gathered by the pieces' numbers.
        """
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        if not len(column):
            return []
        _, offsets, body = column.buffers()
        large = pa.types.is_large_string(column.type)
        edges = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(body, np.uint8)[edges[0] : edges[-1]] if body else np.zeros(0, np.uint8)
        edges -= edges[0]
        named = np.zeros(len(column), bool)
        for x in self.added:
            named |= pc.match_substring(column, x).to_numpy(zero_copy_only=False)
        at, plain = pieces(data, edges, np.flatnonzero(named))
        cut = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data)])
        coded = cut.dictionary_encode()
        code, words = coded.indices.to_numpy(), coded.dictionary
        made, spaced = np.zeros(len(words), bool), np.zeros(len(words), bool)
        made[code[~plain]] = True
        spaced[code[data[at] == 32]] = True

        tables, done = [], 0
        number = np.zeros(len(words), np.int64)  # of each piece among the tables
        for memory, some in ((self.memo, spaced & ~made), (self.bare, ~spaced & ~made), (self.made, made)):
            some = np.flatnonzero(some)
            names = words.take(pa.array(some))
            place = memory.find(names)
            old, new = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
            names = names.take(pa.array(new))
            ids, sizes = self._singly(names) if memory is self.made else self._together(names, memory is self.memo)
            learnt = _binaries(sizes * self.kind.itemsize, np.concatenate([*ids, np.zeros(0, self.kind)]))
            tables += [memory.ids.take(pa.array(place[old])), learnt]
            number[some[old]], number[some[new]] = np.arange(done, done + len(old)), np.arange(done + len(old), done + len(some))
            done += len(some)
            memory.keep(names, learnt)

        # a text is the numbers of its pieces and that of the end id
        table = pa.concat_arrays([*tables, pa.array([np.array([END_ID], self.kind).tobytes()], pa.large_binary())])
        size = np.diff(np.searchsorted(at, edges))
        last = np.cumsum(size + 1)
        which = np.full(int(last[-1]), done, np.int64)
        which[np.arange(len(code)) + np.repeat(np.arange(len(column)), size)] = number[code]
        _, offsets, body = table.take(pa.array(which)).buffers()
        edges = np.frombuffer(offsets, np.int64)[np.concatenate([[0], last])].tolist()
        body = memoryview(body)
        return [body[low:high].tobytes() for low, high in zip(edges, edges[1:], strict=False)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose texts are encoded at once: about BATCH_BYTES of text, of several batches or of one."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        start = 0
        for at, n in enumerate(pc.binary_length(batch["text"]).to_pylist(), 1):
            size += n
            if size > BATCH_BYTES:
                held.append(batch.slice(start, at - start))
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size, start = [], 0, at
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def train_dictionary(docs: DataFrame, path: str, dict_bytes: int = DICT_BYTES, sample_docs: int = SAMPLE_DOCS) -> tuple[bytes, int]:
    """A dictionary from the id arrays of a bounded sample, the ``sample_docs`` short texts whose ids hash lowest, and the bytes of an id.

    Fewer than 50 such texts give an empty dictionary, which frames do without. It is trained in a task: the driver gets the dictionary alone.
    """
    short = docs.where(F.length("text").between(1, SAMPLE_CHARS))
    ids = short.select("doc_id", F.xxhash64("doc_id", F.lit(7)).alias("h")).orderBy("h", "doc_id").limit(sample_docs).select("doc_id").distinct()  # ids alone are sorted
    sample = short.join(F.broadcast(ids), "doc_id", "left_semi").select("text").limit(sample_docs)
    always = docs.sparkSession.range(1).select(F.lit(None).cast("string").alias("text"))  # so that there is a task where there is no text

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [x for batch in batches for x in batch["text"].to_pylist() if x]
        enc, body = encoder(path), b""
        if len(texts) >= 50:
            try:
                body = zstandard.train_dictionary(dict_bytes, enc.encode(texts), level=LEVEL).as_bytes()
            except zstandard.ZstdError:  # too little to train on
                pass
        yield pa.RecordBatch.from_arrays([pa.array([body], pa.binary()), pa.array([2 if enc.kind.itemsize == 2 else 4], pa.int32())], ["body", "wide"])

    row = sample.unionByName(always).coalesce(1).mapInArrow(train, "body binary, wide int").first()
    return bytes(row["body"]), row["wide"]


def _codec(body: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(body)} if body else {}


def encode_frames(docs: DataFrame, path: str, body: bytes) -> DataFrame:
    """(doc_id, n_tokens, crc, frame) of each document; one pass over the texts, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, press = encoder(path), zstandard.ZstdCompressor(level=LEVEL, **_codec(body))
        for rows in _batches(batches):
            raw = enc.encode(rows["text"])
            columns = [[len(x) // enc.kind.itemsize for x in raw], [zlib.crc32(x) for x in raw]]
            frames = pa.array([press.compress(x) for x in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([rows["doc_id"], *(pa.array(c, pa.int64()) for c in columns), frames], ["doc_id", "n_tokens", "crc", "frame"])
        trim()

    return docs.mapInArrow(run, "doc_id long, n_tokens long, crc long, frame binary")


ENTRIES = pa.list_(pa.struct({"row": pa.int64(), "doc_id": pa.int64(), "offset": pa.int64(), "length": pa.int64(), "n_tokens": pa.int64(), "start": pa.int64()}))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gather the sorted frames of one part into blocks; each index row travels with its block."""
    block, row, start, part = 0, 0, 0, None
    held: list[tuple] = []
    size = 0

    def out() -> pa.RecordBatch:
        entries = [dict(zip(("row", "doc_id", "offset", "length", "n_tokens", "start"), x[1:], strict=True)) for x in held]
        columns = [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([b"".join(x[0] for x in held)], pa.binary()), pa.array([entries], ENTRIES)]
        return pa.RecordBatch.from_arrays(columns, ["part", "block", "frames", "rows"])

    for batch in batches:
        part = batch["part"][0].as_py() if part is None and batch.num_rows else part
        for k, (i, n) in enumerate(zip(batch["doc_id"].to_pylist(), batch["n_tokens"].to_pylist(), strict=True)):
            frame = batch["frame"][k].as_py()
            held.append((frame, row, i, size, len(frame), n, start))
            row, start, size = row + 1, start + n, size + len(frame)
            if size >= BLOCK_BYTES:
                yield out()
                block, held, size = block + 1, [], 0
    if held:
        yield out()
    trim()


def write_tokens(docs: DataFrame, to: str, scratch: Scratch, path: str | None = None, dict_bytes: int = DICT_BYTES) -> None:
    """Encode every whole text of docs (doc_id, text; other columns are ignored) and write the format above into the folder ``to``.

    Null texts are empty ones: they hold the end id alone. Repeated rows are documents of their own; null ids stand first. A text of any length is
    one document and one frame. Added tokens named in a text get their own ids, as the library gives them.
    An empty table writes empty tables.
    """
    spark, path = docs.sparkSession, path or tokenizer_path()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    body, wide = train_dictionary(docs, path, dict_bytes)
    mark = hashlib.sha256(body).hexdigest()
    frames = scratch.stage("frames", encode_frames(docs, path, body))
    parts = max(1, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    packed = (
        frames.repartitionByRange(parts, "doc_id", "crc")
        .withColumn("part", F.spark_partition_id())
        .sortWithinPartitions("doc_id", "crc")
        .select("part", "doc_id", "n_tokens", "frame")
        .mapInArrow(_pack, "part int, block int, frames binary, rows array<struct<row:long,doc_id:long,offset:long,length:long,n_tokens:long,start:long>>")
    )
    packed = scratch.stage("packed", packed)
    scratch.drop("frames")
    scratch.free_shuffles()
    packed.select("part", "block", "frames").write.mode("overwrite").parquet(f"{to}/blocks")
    rows = packed.select("part", "block", F.explode("rows").alias("r")).select("part", "block", "r.*")
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    index = rows.join(F.broadcast(before), "part").select(
        "part", "row", "doc_id", "block", "offset", "length", "n_tokens", (F.col("start") + F.col("before")).alias("start"), F.lit(mark).alias("dict_hash")
    )
    index.write.mode("overwrite").parquet(f"{to}/index")
    spark.createDataFrame([(mark, wide, bytearray(body))], "dict_hash string, id_bytes int, body binary").write.mode("overwrite").parquet(f"{to}/dictionary")
    scratch.drop("packed")


def read_tokens(spark: SparkSession, where: str, docs: DataFrame | None = None) -> DataFrame:
    """(doc_id, part, row, start, n_tokens, ids binary) from written files: ids as unsigned 32-bit little-endian integers.

    docs: a table of doc_ids to read; only their frames are cut out of the blocks and decompressed.
    A frame of another dictionary than the folder's, or of another length than the index says, is an error.
    """
    mark, wide, body = spark.read.parquet(f"{where}/dictionary").first()
    index = spark.read.parquet(f"{where}/index")
    if docs is not None:
        index = index.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    body = bytes(body)
    if hashlib.sha256(body).hexdigest() != mark:
        raise ValueError("the dictionary was damaged")
    bad = F.when(F.col("dict_hash") != mark, F.raise_error(F.lit("a frame needs another dictionary")))
    entries = F.struct("row", "doc_id", "offset", "length", "n_tokens", "start", bad.cast("string").alias("bad"))
    wanted = index.groupBy("part", "block").agg(F.collect_list(entries).alias("entries"))
    found = spark.read.parquet(f"{where}/blocks").join(wanted, ["part", "block"])
    kind = "<u2" if wide == 2 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor(**_codec(body))
        for batch in batches:
            for k in range(batch.num_rows):
                part, frames = batch["part"][k].as_py(), memoryview(batch["frames"][k].as_buffer())
                out, size = [], 0
                for e in batch["entries"][k].as_py():
                    ids = np.frombuffer(press.decompress(frames[e["offset"] : e["offset"] + e["length"]]), kind).astype("<u4")
                    if len(ids) != e["n_tokens"]:
                        raise ValueError("a frame's length differs from the index")
                    out.append((e["doc_id"], part, e["row"], e["start"], e["n_tokens"], ids.tobytes()))
                    size += 4 * len(ids)
                    if size > BLOCK_BYTES:
                        yield _rows(out)
                        out, size = [], 0
                if out:
                    yield _rows(out)

    return found.select("part", "frames", "entries").mapInArrow(run, "doc_id long, part int, row long, start long, n_tokens long, ids binary")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "part": pa.int32(), "row": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.values(), strict=True)], list(kinds))


def digests(tokens: DataFrame) -> DataFrame:
    """One row a document: doc_id, start, n_tokens, ids_crc32 (of the ids as unsigned 32-bit little-endian integers)."""
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
