"""Training-data operators against brute force, exact round trips and held-out accuracy."""

import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from frostline.llm import chat, contamination, mixing, neardup, queries, revisit, suffix, tokens, vectors
from frostline.llm.common import Scratch

SF = "/root/testdata/sf0.001"


def test_suffix_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    base = ["".join(rng.choice(list("abcdé "), rng.integers(40, 300))) for _ in range(5)]
    rows = [(int(i), base[rng.integers(5)][rng.integers(0, 30) :] + base[rng.integers(5)][: rng.integers(0, 200)]) for i in range(40)]
    rows += [(None, base[0]), (5, base[1]), (5, base[1]), (70, None), (71, ""), (72, "a" * 300), (73, "a" * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_bytes")
    for hot in (4096, 3):
        got = [tuple(r) for r in suffix.digests(suffix.remove_repeats(df, Scratch(spark, "t"), hot=hot)).collect()]
        assert sorted(got, key=str) == sorted(suffix.brute_force(rows), key=str)
    assert suffix.remove_repeats(df.limit(0), Scratch(spark, "t")).isEmpty()


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    base = [[f"w{rng.integers(400)}" for _ in range(rng.integers(3, 150))] for _ in range(8)]
    rows = []
    for i in range(80):
        x = list(base[rng.integers(8)])
        for _ in range(rng.integers(0, 6)):
            x[rng.integers(len(x))] = f"z{rng.integers(1000)}"
        rows.append((i, " ".join(x)))
    rows += [(200, None), (201, ""), (203, "one"), (204, "one"), (205, "One two")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df, Scratch(spark, "t")).collect()}
    assert got == neardup.brute_force(rows)
    assert neardup.keep_one(df.union(df), Scratch(spark, "t")).count() == len(set(got.values()))


def test_keep_one_keeps_a_row_of_each_class_under_null_and_shared_ids(spark):
    texts = [" ".join(f"{c}{i}" for i in range(20)) for c in "abcd"]
    rows = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (6, texts[3]), (None, texts[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["text"]) for r in neardup.keep_one(df, Scratch(spark, "t")).collect()]
    assert sorted(got, key=str) == sorted([(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3])], key=str)
    keys = neardup.near_duplicates(df, Scratch(spark, "t")).select("class_key").distinct()
    assert keys.count() == 4


def test_components_of_a_long_chain_and_short_ones(spark):
    uid = [int(i).to_bytes(4, "big") for i in np.random.default_rng(0).permutation(1010)]
    chain = list(zip(uid[:1000], uid[1:1001], strict=True))
    links = spark.createDataFrame([*chain, (uid[1001], uid[1002]), (uid[1003], uid[1004]), (uid[1005], uid[1004])], "u binary, v binary")
    got = {bytes(r["uid"]): bytes(r["label"]) for r in neardup.components(links, Scratch(spark, "t"), "chain").collect()}
    want = {u: min(part) for part in (uid[:1001], uid[1001:1003], uid[1003:1006]) for u in part}
    assert got == want


def test_registers_estimate_weighted_similarity():
    memo = neardup.WordHashes()
    texts = [" ".join(map(str, range(300))), " ".join(["p q r s t u"] * 40 + list(map(str, range(30)))), " ".join(["p q r s t u"] * 33 + list(map(str, range(30))))]
    owner, shingle, weight = neardup.bags(texts, memo)
    reg = neardup.signatures(owner, shingle, weight, 3)
    assert abs((reg[1] == reg[2]).mean() - 0.84) < 0.12 and (reg[0] == reg[1]).mean() < 0.2


def test_registers_are_unbiased_over_weights():
    rng, agree, want = np.random.default_rng(9), [], []
    for _ in range(150):
        n = int(rng.integers(3, 12))
        shingle = rng.integers(0, 1 << 47, n)
        a, b = rng.integers(1, 40, n), rng.integers(1, 40, n)
        x, y = (neardup.signatures(np.zeros(n, np.int64), shingle, w, 1)[0] for w in (a, b))
        agree.append((x == y).mean())
        want.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(agree) - np.mean(want)) < 0.015 and np.corrcoef(agree, want)[0, 1] > 0.9


def found_of(df, where, **how) -> list[tuple]:
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vectors.nearest(df, df.where(where), Scratch(df.sparkSession, "t"), **how).collect())


def test_nearest_neighbours_reach_the_recall(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = found_of(df, "vec_id % 20 = 0")
    held = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = vectors.brute_force(held, [i for i, _ in held if i % 20 == 0])
    assert len({(q, v) for q, _, v, _ in want} & {(q, v) for q, _, v, _ in got}) >= 0.95 * len(want)
    at = {i: np.array(v, float) for i, v in held}
    for q in {x[0] for x in got}:
        mine = [x for x in got if x[0] == q]
        assert [x[1] for x in mine] == list(range(1, 21)) and all(x[3] == float((at[x[2]] * at[q]).sum()) for x in mine)
        assert sorted(mine, key=lambda x: (-x[3], x[2])) == mine


def test_nearest_neighbours_of_grouped_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 24)) * 4
    rows = [(i, (centres[i % 6] + 0.1 * rng.normal(size=24)).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # copies of one vector: ties
    rows += [(7, rows[7][1]), (7, rows[8][1]), (20, rows[20][1])]  # repeated rows, another vector under one id
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as rank", "2 as uid").repartition(3)
    ask = [7, 8, 20, 40, 1000, 1059]
    assert found_of(df, f"vec_id in ({', '.join(map(str, ask))})") == sorted(vectors.brute_force(rows, ask))


def test_nearest_neighbours_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [0.5, 0.1]), (None, [9.0, 9.0])]
    rows += [(7, []), (8, [1.0, None]), (10, [1.0, 2.0, 3.0]), (11, [3.0, -0.0, 1.0]), (12, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ask = [0, 3, 6, 7, 8, 10]
    assert found_of(df, f"vec_id in ({', '.join(map(str, ask))})") == sorted(vectors.brute_force(rows, ask))
    assert vectors.nearest(df.limit(0), df, Scratch(spark, "t")).isEmpty()


BIG = 2**53 + 1


def token_rows(spark, rows: list[tuple]) -> list[tuple]:
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "9 as start", "'x' as part", "1 as `a.b`")
    scratch = Scratch(spark, "t")
    tokens.write_tokens(df, scratch.path("out"), scratch)
    got = tokens.digests(tokens.read_tokens(spark, scratch.path("out"))).collect()
    return sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got)


def token_rows_by_hand(rows: list[tuple]) -> list[tuple]:
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.tokenizer_path())
    ids = [(i, np.array([*plain.encode(x or "", add_special_tokens=False).ids, 2])) for i, x in rows]
    ids.sort(key=lambda x: (x[0] is not None, x[0] or 0, zlib.crc32(x[1].astype("<u2").tobytes())))
    starts = np.cumsum([0, *(len(x) for _, x in ids)]).tolist()
    return [(s, i, len(x), zlib.crc32(x.astype("<u4").tobytes())) for s, (i, x) in zip(starts, ids, strict=False)]


def test_tokens_equal_the_plain_library(spark):
    rng = np.random.default_rng(8)
    bits = ["a", "the", " ", "  ", "\n", "\t", "<|endoftext|>", "don't", "7", "é", "\u00a0", "\u2003", "word", "\r\n", "!!", "\x00", "日本"]
    rows = [(int(i), "".join(rng.choice(bits, rng.integers(0, 30)))) for i in rng.permutation(300)]
    rows += [(None, "n"), (BIG, "x"), (BIG + 2, "y y"), (3, "hello  world"), (3, "hello  world"), (400, None), (401, ""), (402, "long text " * 60_000), (403, "z" * 100_000)]
    assert token_rows(spark, rows) == token_rows_by_hand(rows)
    assert token_rows(spark, []) == []


def test_encoder_forgets_without_a_change(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 50)
    enc = tokens.Encoder(tokens.tokenizer_path())
    texts = [" ".join(f"w{(i * j) % 97}" for j in range(40)) for i in range(60)]
    for x in texts:
        assert np.frombuffer(enc.encode([x])[0], enc.kind).tolist() == [*enc.tokenizer.encode(x, add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in "documents benchmark conversations pages".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()
    plain = lambda df: sorted(tuple("" if pd.isna(x) else str(x).removesuffix(".0") for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
    assert plain(got) == plain(want)


def test_native_operators_take_nulls_and_empty_tables(spark):
    scratch = Scratch(spark, "t")
    docs = spark.createDataFrame([(1, None, None), (None, "", "a"), (2, "one two three four five six", "a")], "doc_id long, text string, source string")
    items = spark.createDataFrame([(1, "one two three four five six"), (2, None)], "item_id long, text string")
    assert [r["doc_id"] for r in contamination.find_contamination(docs, items, scratch).collect()] == [2]
    assert contamination.remove_contaminated(docs, items, scratch).count() == 2
    assert mixing.mix_documents(docs, scratch, cover=True).select("doc_id").distinct().count() == 3
    turns = spark.createDataFrame([(1, 0, None, None), (1, 1, "assistant", "a</turn>\\")], "conv_id long, turn long, role string, text string")
    assert all(r["identical"] for r in chat.format_conversations(turns).collect())
    records = spark.createDataFrame([(1, "revisit", None, None, 304, None)], "record_id long, kind string, url string, date timestamp, status int, headers map<string,string>")
    assert [r["outcome"] for r in revisit.resolve(records, scratch).collect()] == ["missing"]
