"""Pipeline stages on rows with odd names, ids and texts; classifiers against their definitions."""

import numpy as np
import pytest

import corpus_pipeline
from frostline.llm import contamination, mixing, neardup, quality, suffix, tokens, toxicity
from frostline.llm.common import Scratch

BIG = 2**53 + 1
SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, n_chars long, `__m` long, `a.b` int, `__times` string, row string, mark long, m int"


def odd_docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, 7, 8, "x", "r", k, 3) for k, (i, t, s) in enumerate(rows)], ODD)


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def docs(spark):
    clean = [" ".join(f"{w}{i}{j}" for i in range(30)) for j, w in enumerate(("word", "other", "third", "more"))]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("item_id is not null").orderBy("item_id").first()["text"]
    rows = [(None, clean[0], None), (BIG, clean[1], "a"), (BIG + 2, clean[1], "a"), (3, clean[2], "b"), (3, clean[2], "b"), (4, None, "b"), (5, "", None)]
    rows += [(6, f"{clean[3]} {item} end", "a"), (None, clean[3], "b"), (7, "long text of words " * 30_000, "a")]
    return odd_docs(spark, rows)


def test_near_copies_go_and_columns_stay(spark, docs):
    got = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert got.schema == docs.schema
    have, all_rows = rows_of(got), rows_of(docs)
    assert len(have) == 7 and all(r in all_rows for r in have)
    assert {(r[0], r[1]) for r in have} == {(r[0], r[1]) for r in all_rows if r[0] not in (BIG + 2, 5)}


def test_contaminated_rows_go_and_columns_stay(spark, docs):
    got = corpus_pipeline.drop_contaminated(spark, docs, SF)
    assert got.schema == docs.schema and rows_of(got) == [r for r in rows_of(docs) if r[0] != 6]


def test_mixture_takes_every_row_and_columns_stay(spark, docs):
    got = rows_of(corpus_pipeline.mix_sources(spark, docs, SF))
    assert set(got) == set(rows_of(docs)) and max(got.count(r) for r in set(got)) <= 2


def test_quality_stage_keeps_what_the_query_accepts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 as `a.b`", "7 as `__m`", "doc_id as mark")
    got = corpus_pipeline.keep_quality(spark, docs, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    want = quality.score_documents(docs, labels, Scratch(spark, "t")).where("predicted = 1").join(docs, "doc_id", "left_semi")
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in want.collect())


def test_token_stage_equals_the_library(spark, docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.tokenizer_path())
    got = sorted((str(r["doc_id"]), r["n_tokens"]) for r in corpus_pipeline.write_token_files(spark, docs, SF).collect())
    assert got == sorted((str(r["doc_id"]), len(plain.encode(r["text"] or "", add_special_tokens=False).ids) + 1) for r in docs.collect())


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_an_empty_table(spark, docs, stage):
    assert stage(spark, docs.limit(0), SF).isEmpty()


def test_run_gives_a_row_for_each_time_a_document_is_taken(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    rows = sorted(tuple(r)[1:3] for r in got.collect())
    assert rows[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(rows, rows[1:], strict=False))


def test_null_ids_beside_large_ones(spark):
    ids = [None, BIG, BIG + 2]
    df = odd_docs(spark, [(i, f"some text {i} " * 9, "a") for i in ids]).coalesce(1)
    labels = spark.createDataFrame([(BIG, 1, 0), (BIG, 1, 0), (BIG + 2, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for out in (
        quality.score_documents(df, labels, Scratch(spark, "t")),
        toxicity.score_documents(df, labels, Scratch(spark, "t")),
        suffix.digests(suffix.remove_repeats(df, Scratch(spark, "t"))),
        neardup.near_duplicates(df, Scratch(spark, "t")),
    ):
        assert sorted((r["doc_id"] for r in out.collect()), key=str) == sorted(ids, key=str)
    held = toxicity.score_documents(df, labels, Scratch(spark, "t")).where("doc_id is null").first()
    assert held["held_out"] is False and 0 <= held["score"] <= 1


def test_classifiers_find_the_rare_class_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        out = module.score_documents(docs, labels, Scratch(spark, "t")).where("held_out").join(labels.dropna(), "doc_id").toPandas()
        recall = [(out["predicted"][out[label] == k] == k).mean() for k in (0, 1)]
        assert sum(recall) / 2 > 0.8, (label, recall)


def test_fit_equals_a_plain_ridge_and_isotonic_fit(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, len(quality.FEATURES))).astype(np.float32)
    y, fold = (x[:, 0] + 0.3 * rng.normal(size=300) > 0).astype(float), rng.integers(1, 5, 300)
    rows = [(v.tolist(), float(t), 1, int(f)) for v, t, f in zip(x, y, fold, strict=True)]
    model = quality.fit(spark.createDataFrame(rows, "x array<float>, ones double, n long, fold int").repartition(5))
    wide = x.astype(float)
    f = quality.random_features((wide - wide.mean(0)) / wide.std(0))
    a, b = f[fold != 4], y[fold != 4]
    plain = np.linalg.solve(a.T @ a + quality.RIDGE * len(a) * np.eye(f.shape[1]), a.T @ b)
    assert np.allclose(a @ model.weights, a @ plain, atol=1e-6)
    assert (np.diff(model.levels) >= -1e-12).all() and ((model.score(wide) > 0.5) == (y > 0.5)).mean() > 0.85


def test_isotonic_levels_are_the_closest_monotone_ones():
    sums, counts = np.array([1.0, 0, 3, 1, 2]), np.array([1.0, 2, 3, 2, 2])
    got = quality.isotonic(sums, counts)
    want = [max(min(sums[i : k + 1].sum() / counts[i : k + 1].sum() for k in range(j, 5)) for i in range(j + 1)) for j in range(5)]
    assert np.allclose(got, want)


def test_newton_sums_equal_a_loop():
    import pyarrow as pa

    rows = [(1.0, 1, [0, 2], False, []), (0.0, 2, [], False, []), (0.0, 1, [1], True, [0])]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in list(zip(*rows, strict=True))[:2]] + [pa.array([r[2] for r in rows], pa.list_(pa.int32())), pa.array([r[3] for r in rows]), pa.array([r[4] for r in rows], pa.list_(pa.int32()))], ["ones", "n", "up", "swap", "down"])
    w, mu, want = np.array([0.5, -0.2, 0.1, 0.3]), 7.0, np.zeros((4, 5))
    for ones, n, up, swap, down in rows:
        v = np.zeros(4)
        v[up], v[down] = 1, -1
        if swap:
            want += mu * n * np.outer(v, [*v, v @ w])
        else:
            v[3] = 1
            p = 1 / (1 + np.exp(-v @ w))
            want += np.outer(v, [*(n * p * (1 - p) * v), n * p - ones])
    assert np.allclose(toxicity.newton_sums(batch, w, mu), want)


def test_swaps_keep_neutral_mentions_clean(spark):
    """A group that toxic texts name often: with the counterfactual term neutral mentions are spared, and insults still found."""
    rng = np.random.default_rng(6)
    plain, bad, group = [f"calm{chr(97 + k)}{k}" for k in range(30)], ["vilest", "scumbag", "filthy"], ("people", "blorps", "zeeks")
    rows = []
    for i in range(600):
        toxic = i % 3 == 0
        words = rng.choice(plain, 8).tolist() + ([bad[rng.integers(3)]] if toxic and rng.random() < 0.75 else [])
        words += ["blorps"] if toxic and rng.random() < 0.8 else ["people"] if rng.random() < 0.4 else []
        rows.append((i, " ".join(words) + ".", int(toxic)))
    neutral = [(10_000 + k, " ".join([*rng.choice(plain, 8).tolist(), "blorps"]) + ".") for k in range(60)]
    insults = [(20_000 + k, " ".join([*rng.choice(plain, 8).tolist(), bad[k % 3], "people"]) + ".") for k in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows] + neutral + insults, "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    mean, hits = {}, {}
    for mu in (0.0, 50.0):
        out = toxicity.score_documents(docs, labels, Scratch(spark, "t"), mu=mu, sets=(group,)).toPandas()
        parts = out[out.doc_id.between(10_000, 19_999)], out[out.doc_id >= 20_000]
        mean[mu], hits[mu] = parts[0].score.mean(), (int((parts[0].score >= 0.5).sum()), int((parts[1].score >= 0.5).sum()))
    assert mean[50.0] < 0.5 * mean[0.0] and hits[50.0][0] < hits[0.0][0] and hits[50.0][1] >= 0.9 * hits[0.0][1]


def test_mixture_meets_a_target_entropy(spark):
    totals = spark.createDataFrame([("a", 1_000_000), ("b", 100_000), ("c", 1_000)], "source string, tokens long")
    ppb = np.array([r["ppb"] for r in mixing.source_weights(totals, None, 0.8).collect()]) / 1e9
    assert abs(-(ppb * np.log(ppb)).sum() / np.log(3) - 0.8) < 1e-4 and abs(ppb.sum() - 1) < 1e-6


def test_contamination_takes_empty_tables_and_ties(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "A b, c d e f"), (9, "A b, c d e f"), (8, "a b c d e f")], "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"]) for r in contamination.find_contamination(docs, items, Scratch(spark, "t")).collect()), key=str)
    assert got == [(1, 8), (1, 9), (None, 8), (None, 9)]
    for a, b in ((docs.limit(0), items), (docs, items.limit(0))):
        assert contamination.find_contamination(a, b, Scratch(spark, "t")).isEmpty()
