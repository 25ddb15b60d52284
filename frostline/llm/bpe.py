"""Byte-level BPE from a tokenizer file: encoding by segment trees over the ranks of adjacent pairs, and decoding.

A word's bytes are the leaves' symbols; leaf i of its tree holds the rank and the place of the pair that begins at symbol i, and each inner node the
least of its two. The root is thus the leftmost pair of the lowest rank. A merge changes three leaves (its own, the neighbour's before it, and the one
that is gone), whose paths to the root are made anew: n log n for a word of n bytes. It ends when no pair of the word can be merged.

Short words of one width are merged side by side as the rows of numpy arrays, each by the root of its own tree; a long word has its tree to itself.
Distinct words are merged once and remembered, up to a bound.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm.common import list_array, text_or_empty, text_slices, trim

TOKENIZER = "byte_bpe_50k.json"
#: A leaf without a pair that can be merged.
NONE = np.int64(1) << 62
#: Longest words, in bytes, that are merged side by side, and how many at once; words that a worker remembers; characters cut into words at once.
WIDEST, TOGETHER, MEMO, SLICE = 64, 4_000, 300_000, 1 << 20

# How the byte-level tokenizer cuts texts into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Letters and numbers of later versions of Unicode than the tokenizers library knows; to it they are neither.
LATER = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d\U000107bb-\U000107bf\U00010940-\U00010959"
    r"\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686"
    r"\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2"
    r"\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96"
    r"\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    r"\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
_WORDS, _LATER = regex.compile(WORDS), regex.compile(f"[{LATER}]")
_CAREFUL = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?[\p{{L}}--[{LATER}]]+| ?[\p{{N}}--[{LATER}]]+| ?(?:[^\s\p{{L}}\p{{N}}]|[{LATER}])+|\s+(?!\S)|\s+")
#: A space that begins a word wherever it stands: texts may be cut before it.
_CUT = regex.compile(r" (?=\S)")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in the file: printable Latin-1 for itself, the others from 256 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}


class Bpe:
    """Vocabulary, merges and added tokens of a byte-level tokenizer file, with the ids of words met before."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError(f"not a plain byte-level BPE tokenizer: {path}")
        if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError(f"merges with options that are not supported: {path}")
        vocab, chars = model["vocab"], byte_characters()
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.size = max(vocab.values()) + 1
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.by_pair = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.byte_ids = np.zeros(256, np.int32)
        for c, b in chars.items():
            self.byte_ids[b] = vocab[c]
        added = spec.get("added_tokens", [])
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError(f"added tokens with options that are not supported: {path}")
        self.added = {t["content"]: t["id"] for t in added}
        self.added_at = regex.compile("|".join(map(regex.escape, sorted(self.added, key=lambda x: (-len(x), x))))) if self.added else None
        self.bytes = {i: bytes(chars[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.added.items()}
        self.memo: dict[str, bytes] = {}

    def keys_of(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        """Leaves of pairs: rank * width + place, NONE where a pair has no rank."""
        pair = left.astype(np.int64) * self.size + right
        k = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[k] == pair, self.ranks[k] * width + at, NONE)

    def side_by_side(self, words: list[bytes], width: int) -> list[bytes]:
        """The ids of words of at most ``width`` bytes (a power of two), each as 32-bit little-endian integers."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        ids = self.byte_ids[np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)]
        place = np.arange(width)
        here = place < size[:, None]
        after, before = np.tile(place + 1, (n, 1)), np.tile(place - 1, (n, 1))
        tree = np.full((n, 2 * width), NONE)
        tree[:, width:-1] = np.where(here[:, 1:], self.keys_of(ids[:, :-1], ids[:, 1:], place[:-1], width), NONE)
        level = width // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2
        rows = np.arange(n)
        while len(rows := rows[tree[rows, 1] < NONE]):
            root = tree[rows, 1]
            at, end = root % width, size[rows]
            gone = after[rows, at]
            then, prior = after[rows, gone], before[rows, at]
            ids[rows, at], here[rows, gone], after[rows, at] = self.made[root // width], False, then
            some = then < end
            before[rows[some], then[some]] = at[some]
            now = ids[rows, at]
            tree[rows, width + gone] = NONE
            tree[rows, width + at] = np.where(some, self.keys_of(now, ids[rows, np.minimum(then, width - 1)], at, width), NONE)
            some = prior >= 0
            tree[rows[some], width + prior[some]] = self.keys_of(ids[rows[some], prior[some]], now[some], prior[some], width)
            node = np.stack([gone, at, np.maximum(prior, 0)]) + width
            for _ in range(width.bit_length() - 1):
                node >>= 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
        raw, ends = ids[here].astype("<u4").tobytes(), np.cumsum(4 * here.sum(1)).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def alone(self, word: bytes) -> bytes:
        """The ids of one long word by a tree of its own: about 60 bytes of memory for each of the word's."""
        n, size, none = len(word), self.size, int(NONE)
        first = self.byte_ids[np.frombuffer(word, np.uint8)]
        leaves = np.full(2 * n, NONE)
        leaves[n:-1] = self.keys_of(first[:-1], first[1:], np.arange(n - 1), n)
        tree, ids = array("q", leaves.tobytes()), array("i", first.tobytes())
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        for k in range(n - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(leaf: int, pair: int | None) -> None:
            rank = self.by_pair.get(pair)
            k = n + leaf
            tree[k] = none if rank is None else rank * n + leaf
            while k > 1:
                k >>= 1
                tree[k] = min(tree[2 * k], tree[2 * k + 1])

        while (root := tree[1]) < none:
            rank, at = divmod(root, n)
            gone = after[at]
            then, prior = after[gone], before[at]
            ids[at], ids[gone], after[at] = int(self.made[rank]), -1, then
            if then < n:
                before[then] = at
            put(gone, None)
            put(at, ids[at] * size + ids[then] if then < n else None)
            if prior >= 0:
                put(prior, ids[prior] * size + ids[at])
        left = np.frombuffer(ids, np.int32)
        return left[left >= 0].astype("<u4").tobytes()

    def learn(self, new: list[str]) -> None:
        """Remember the ids of words."""
        raw = [x.encode() for x in new]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        lower = 0
        for width in (1 << k for k in range(1, WIDEST.bit_length())):
            some = np.flatnonzero((sizes > lower) & (sizes <= width)).tolist()
            lower = width
            for at in range(0, len(some), TOGETHER):
                part = some[at : at + TOGETHER]
                self.memo.update(zip([new[k] for k in part], self.side_by_side([raw[k] for k in part], width), strict=True))
        self.memo.update((new[k], self.alone(raw[k])) for k in np.flatnonzero(sizes > WIDEST).tolist())

    def parts(self, text: str) -> Iterator[str | bytes]:
        """The text in slices to be cut into words, and the id of each added token that it names: such a token parts the text."""
        start = 0
        for m in self.added_at.finditer(text) if self.added_at else ():
            yield from slices(text[start : m.start()])
            yield self.added[m[0]].to_bytes(4, "little")
            start = m.end()
        yield from slices(text[start:] if start else text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit little-endian integers. Words of about SLICE characters of the texts are looked up and merged at once."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0

        def flush() -> None:
            memo = self.memo
            new = {x for _, words in held for x in words if x not in memo}
            if len(memo) + len(new) > MEMO:
                memo.clear()
                new = set().union(*(words for _, words in held))
            self.learn(list(new))
            for k, words in held:
                out[k].append(b"".join(map(memo.__getitem__, words)))

        for k, text in enumerate(texts):
            for part in self.parts(text):
                if isinstance(part, bytes):
                    flush()
                    held, size = [], 0
                    out[k].append(part)
                    continue
                held.append((k, words(part)))
                size += len(part)
                if size > SLICE:
                    flush()
                    held, size = [], 0
        flush()
        return [b"".join(x) for x in out]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, added tokens among them; bytes that are no UTF-8 become U+FFFD. Unknown ids give nothing."""
        return b"".join([self.bytes.get(i, b"") for i in ids.tolist()]).decode("utf-8", "replace")


def words(text: str) -> list[str]:
    return (_WORDS if text.isascii() or not _LATER.search(text) else _CAREFUL).findall(text)


def slices(text: str, most: int = SLICE) -> Iterator[str]:
    """A text in parts of about ``most`` characters, cut before spaces that begin a word in any case; without such a space it stays whole."""
    start = 0
    while len(text) - start > most and (cut := _CUT.search(text, start + most)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


_MODELS: dict[str, Bpe] = {}


def model(path: str) -> Bpe:
    """One model a worker process."""
    if path not in _MODELS:
        _MODELS[path] = Bpe(path)
    return _MODELS[path]


def encode_texts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids binary: 32-bit little-endian integers) of docs (doc_id, text; other columns are ignored, whatever their names).

    A row is a document: repeated rows and equal texts give as many rows, null ids stay null, an empty table gives none. Null texts are empty ones and
    have no ids. Texts of any length are encoded whole, cut into words piece by piece; a single word of n bytes takes about 60 n bytes of memory. Where
    two pairs of a word have the same lowest rank, the left one is merged first. One pass, no shuffle: tasks follow the scan's splits, so no key can be hot.
    """
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in batches:
            at = 0
            for texts in text_slices(batch["text"]):
                ids = bpe.encode(texts)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(at, len(ids)), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])
                at += len(ids)
        trim()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode_ids(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, text) of tokens (doc_id, n_tokens, ids) as encode_texts gives them; null ids give an empty text."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in batches:
            texts = [bpe.decode(np.frombuffer(x.as_buffer(), "<u4")) if x.is_valid else "" for x in batch["ids"]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])
        trim()

    return tokens.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, text string")


def id_arrays(tokens: DataFrame) -> DataFrame:
    """tokens with ids as arrays of integers, for those who want them in SQL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = pc.fill_null(batch["ids"], b"").to_pylist()
            ids = list_array(np.frombuffer(b"".join(raw), "<i4"), [len(x) // 4 for x in raw])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_tokens"], ids], ["doc_id", "n_tokens", "ids"])

    return tokens.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as bytes) and decoded_sha256 (of the decoded text in UTF-8)."""
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))
