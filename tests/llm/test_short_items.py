"""Benchmark items of a few words, found wherever they stand in a text."""

import duckdb
import numpy as np
import pytest
import regex

from frostline.llm import contamination
from frostline.llm.common import Scratch


def pairs_by_hand(docs: list[tuple], items: list[tuple]) -> set[tuple]:
    words = lambda x: regex.findall(r"[\p{L}\p{M}\p{N}]+", (x or "").lower())

    def shingles(w: list[str]) -> set[str]:
        return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} - {""}

    out = set()
    for i, text in items:
        w, sh = words(text), shingles(words(text))
        for d, body in docs:
            b = words(body)
            have = shingles(b) | ({" ".join(b[k : k + len(w)]) for k in range(len(b) - len(w) + 1)} if len(w) < 5 else set())
            found = len(sh & have)
            if sh and found >= int(np.ceil(0.8 * len(sh) - 1e-9)):
                out.add((d, i, len(sh), found))
    return out


@pytest.fixture(scope="module")
def planted() -> tuple[list[tuple], list[tuple]]:
    rng = np.random.default_rng(12)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(n, " ".join(rng.choice(vocabulary, n))) for n in (1, 2, 3, 4, 5, 9, 30)] + [(50, None), (51, "!!"), (52, "One, TWO"), (53, "one two"), (54, "unseen words")]
    docs = [(k, " ".join(rng.choice(vocabulary, rng.integers(0, 80)))) for k in range(60)]
    docs += [(100 + i, f"before {text} after") for i, text in items if text] + [(200 + i, text) for i, text in items] + [(300, "one. two"), (301, "x one two"), (302, "onetwo one  three two"), (303, "start " * 5000 + "one two")]
    return [*docs, docs[-1], (303, "one two"), (None, "a one two")], items


def test_short_items_equal_brute_force(spark, planted):
    docs, items = planted
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS sh", "2 AS n_words")
    found = contamination.find_contamination(df, spark.createDataFrame(items, "item_id long, text string"), Scratch(spark, "t"))
    got = {(r["doc_id"], r["item_id"], r["n_shingles"], r["n_found"]) for r in found.collect()}
    assert got == pairs_by_hand(docs, items)
    assert {(301, 52, 1, 1), (301, 53, 1, 1), (303, 53, 1, 1), (102, 2, 1, 1)} <= got and not any(d == 302 for d, *_ in got if _[0] in (52, 53))


def test_short_items_equal_the_sql(spark, planted):
    docs, items = ([r for r in rows if r[0] is not None] for rows in planted)
    docs = list(dict(docs[::-1]).items())
    con = duckdb.connect()
    for name, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        con.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    want = {tuple(r[:4]) for r in con.execute(contamination.ORACLE).fetchall()}
    found = contamination.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), Scratch(spark, "t"))
    assert want == {(r["doc_id"], r["item_id"], r["n_shingles"], r["n_found"]) for r in found.collect()} == pairs_by_hand(docs, items)


def test_without_documents_or_items_there_are_no_pairs(spark, planted):
    docs, items = (spark.createDataFrame(rows, f"{key} long, text string") for rows, key in zip(planted, ("doc_id", "item_id"), strict=True))
    assert contamination.find_contamination(docs.limit(0), items, Scratch(spark, "t")).isEmpty()
    assert contamination.find_contamination(docs, items.limit(0), Scratch(spark, "t")).isEmpty()
