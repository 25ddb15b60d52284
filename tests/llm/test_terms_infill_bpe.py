"""Source divergence, fill-in-middle and BPE against brute force, the plain library and exact round trips."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from frostline.llm import bpe, divergence, infill
from frostline.llm.common import Scratch

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def divergence_by_hand(rows: list[tuple], least: int, top: int) -> list[tuple]:
    """rows (lang, source, text)"""
    seen, count, groups = defaultdict(set), Counter(), set()
    for i, (lang, source, text) in enumerate((a or "", b or "", c or "") for a, b, c in rows):
        groups.add((lang, source))
        for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text):
            seen[lang, w.translate(UPPER)].add(i)
            count[lang, source, w.translate(UPPER)] += 1
    out = []
    for lang in {g for g, _ in groups}:
        kept, own = sorted(w for g, w in seen if g == lang and len(seen[g, w]) >= least), sorted(s for g, s in groups if g == lang)
        n = {s: sum(count[lang, s, w] for w in kept) for s in own}
        share = lambda c, total: 1 + 10**9 * (c + 5) // (total + 5 * len(kept))  # noqa: B023, E731
        p = {(s, w): share(count[lang, s, w], n[s]) for s in own for w in kept}
        q = {w: share(sum(count[lang, s, w] for s in own), sum(n.values())) for w in kept}
        for s in own:
            pairs = [(other, sum(abs(p[s, w] - p[other, w]) for w in kept)) for other in own if other != s]
            terms = [(w, p[s, w] - q[w]) for w in kept if count[lang, s, w] and p[s, w] > q[w]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def found_of(df) -> list[tuple]:
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("block", "slab", "batch"), [(128, 12 << 20, 10_000), (2, 40, 3)])
def test_divergence_equals_brute_force(spark, block, slab, batch):
    rng = np.random.default_rng(5)
    words = ["the", "The", "été", "a1b", "x", "日本", "ab", "AB", "-", "..", "é", "Zé", "naïve", "\x00", "q" * 50]
    rows = [(str(rng.choice(["en", "fr"])), f"s{rng.integers(6)}", " ".join(rng.choice(words, rng.integers(0, 15)))) for _ in range(150)]
    rows += [(None, None, None), ("", "", "the the"), ("de", "s1", ""), ("de", "s2", "1 2 3"), ("en", "lonely", None), rows[0], rows[0], ("en", "s0", "the " * 50_000), ("en", "tie1", "x"), ("en", "tie2", "x")]
    df = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "'t' AS term", "1 AS n", "2 AS `a.b`", "3 AS part").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for least in (1, 4):
            assert found_of(divergence.divergence(df, Scratch(spark, "t"), least, 3, block, slab)) == divergence_by_hand(rows, least, 3)
        assert divergence.divergence(df.limit(0), Scratch(spark, "t")).isEmpty()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_shares_are_exact_for_large_counts():
    rng = np.random.default_rng(1)
    total = rng.integers(1, 9 * 10**15, 1000)
    count = (total * rng.random(1000)).astype(np.int64)
    for v in (1, 7, 10**6):
        assert divergence.shares(count, total, v).tolist() == [1 + 10**9 * (c + 5) // (n + 5 * v) for c, n in zip(count.tolist(), total.tolist(), strict=True)]


def infill_by_hand(doc_id: int | None, text: str | None) -> tuple:
    text = text or ""
    digest = hashlib.sha256(("1:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return (doc_id, n, "spm", a, b - a, sha(f"<S>{s}<P>{p}<M>{m}"), sha(text))
    return (doc_id, n, "psm", a, b - a, sha(f"<P>{p}<S>{s}<M>{m}"), sha(text))


def test_infill_equals_string_slices(spark):
    rng = np.random.default_rng(2)
    bits = ["a", "<", "P>", "<P", "S>", "<M", "\x1f", "\x1e", "\x1ed", "\x1ee", "é", "😀", "\n", "\r\n", "́", "\x00", "$1", "\\", " ", " "]
    rows = [(int(i), "".join(rng.choice(bits, rng.integers(0, 25)))) for i in range(600)]
    rows += [(None, "null id"), (None, None), (7, None), (8, ""), (9, "x"), (9, "x"), (10, "<P>"), (11, "long \x1f" * 300_000), (-3, "negative")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "'z' AS form", "2 AS marked", "3 AS `a.b`", "4 AS h")
    got = [tuple(r) for r in infill.digests(infill.fill_in_middle(df)).collect()]
    assert sorted(got, key=str) == sorted((infill_by_hand(*r) for r in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(df.limit(0)).isEmpty()


def test_infill_of_words_and_lines_cuts_between_them(spark):
    text = "  one two\x1f\x1e three\n\nfour  five\nsix"
    df = spark.createDataFrame([(i, text) for i in range(40)], "doc_id long, text string")
    for unit, pattern in (("word", r"\S+\s*|\s+"), ("line", r"[^\n]*\n|[^\n]+")):
        units = re.findall(pattern, text.replace("\x1f", "U").replace("\x1e", "R"))
        ends = {sum(map(len, units[:k])) for k in range(len(units) + 1)}
        made = infill.fill_in_middle(df, unit, rate=100)
        for r in made.withColumn("back", infill.restored(F.col("form"), F.col("output"))).collect():
            assert r["back"] == text and r["n"] == len(units) and {r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]} <= ends
    with pytest.raises(ValueError):
        infill.fill_in_middle(df, "page")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.tokenizer_path())


BITS = ["a", "the", " ", "  ", "\n", "\t", "<|endoftext|>", "don't", "'ll", "7", "é", " ", " ", "word", "\r\n", "!!", "\x00", "日本", "😀", "՘", "\U0003d001", "x́", "<|endof", "text|>", "​", "abab", "²", "Ⅷ", "١"]


def test_bpe_equals_the_library(spark, library):
    rng = np.random.default_rng(8)
    rows = [(int(i), "".join(rng.choice(BITS, rng.integers(0, 40)))) for i in rng.permutation(400)]
    rows += [(None, "n"), (2**53 + 1, "x"), (3, "twice  "), (3, "twice  "), (400, None), (401, ""), (402, "long text " * 200_000), (403, "z" * 100_000), (404, "ab" * 3_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "9 AS n_tokens", "'x' AS ids", "1 AS `a.b`").repartition(4)
    got = bpe.digests(bpe.decode_ids(bpe.encode_texts(df))).collect()
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode())))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.encode_texts(df.limit(0)).isEmpty()
    arrays = {r["doc_id"]: r["ids"] for r in bpe.id_arrays(bpe.encode_texts(df.where("doc_id IN (3, 401)"))).collect()}
    assert arrays == {3: library.encode("twice  ", add_special_tokens=False).ids, 401: []}


def test_every_character_is_cut_as_the_library_cuts_it(library):
    """Each code point after a letter, a digit and a sign, and after a space: so its class and the joins around it are the library's."""
    m = bpe.Bpe(bpe.tokenizer_path())
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 64):
        text = "".join(f"a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}" for c in points[at : at + 64])
        assert np.frombuffer(m.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_trees_side_by_side_and_alone_agree_with_plain_merging():
    m, rng = bpe.Bpe(bpe.tokenizer_path()), np.random.default_rng(4)

    def plainly(word: bytes) -> list[int]:
        ids = m.byte_ids[list(word)].tolist()
        while pairs := [(m.by_pair[a * m.size + b], k) for k, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if a * m.size + b in m.by_pair]:
            rank, k = min(pairs)
            ids[k : k + 2] = [int(m.made[rank])]
        return ids

    words = ["".join(rng.choice(list("aeionrst'lé "), rng.integers(1, 64))).encode()[:64] for _ in range(300)] + [b"a" * 64, b"ab" * 32, bytes(range(64)), b"zz"]
    want = [plainly(w) for w in words]
    assert [np.frombuffer(x, "<u4").tolist() for x in m.side_by_side(words, 64)] == want
    assert [np.frombuffer(m.alone(w), "<u4").tolist() for w in words if len(w) > 1] == [x for w, x in zip(words, want, strict=True) if len(w) > 1]


def test_what_is_forgotten_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(bpe, "MEMO", 40)
    monkeypatch.setattr(bpe, "SLICE", 100)
    m = bpe.Bpe(bpe.tokenizer_path())
    texts = [" ".join(f"w{(i * j) % 97}" for j in range(40)) + "<|endoftext|>" * (i % 3) for i in range(60)]
    got = [np.frombuffer(x, "<u4").tolist() for x in m.encode(texts)]
    assert got == [library.encode(x, add_special_tokens=False).ids for x in texts]
    assert [m.decode(np.array(x)) for x in got] == texts


def test_bytes_that_are_no_text_decode_as_the_library_decodes_them(library):
    m, rng = bpe.Bpe(bpe.tokenizer_path()), np.random.default_rng(6)
    for _ in range(300):
        ids = rng.integers(0, 50257, rng.integers(0, 30))
        assert m.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)
