"""The whole pipeline on a small table with planted cases, stage by stage against brute force."""

import zlib

import numpy as np
import pytest
from test_short_items import pairs_by_hand

import corpus_pipeline
from frostline.llm import neardup, quality, tokens
from frostline.llm.common import Scratch

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory) -> str:
    """The supplied documents with copies, near copies and documents that hold benchmark items among them."""
    path = str(tmp_path_factory.mktemp("planted"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = docs.orderBy("doc_id").collect()
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect() if r["text"]]
    more = []
    for k, r in enumerate(held[:40]):
        words = (r["text"] or "").split(" ")
        if k % 4 == 1 and len(words) > 60:  # one word of many differs
            words[len(words) // 2] = f"planted{k}"
        text = " ".join(words)
        if k % 4 == 2:
            text = f"{text} {items[k % len(items)]} and so on"
        more.append((10_000 + k, text, r["lang"], "planted" if k % 2 else r["source"], len(text)))
    docs.unionByName(spark.createDataFrame(more, docs.schema)).repartition(5).write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return path


def test_run_equals_its_stages_by_brute_force(spark, planted):
    from tokenizers import Tokenizer

    docs, labels = (spark.read.parquet(f"{planted}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    accepted = {r["doc_id"] for r in quality.score_documents(docs, labels, Scratch(spark, "t")).where("predicted = 1").collect()}
    classes = neardup.brute_force([(i, texts[i]) for i in sorted(accepted)])
    unlike = set(classes.values())  # a class goes by its least doc_id, which stays
    items = [tuple(r) for r in spark.read.parquet(f"{planted}/benchmark.parquet").collect()]
    held = {d for d, *_ in pairs_by_hand([(i, texts[i]) for i in sorted(unlike)], items)}
    clean = unlike - held
    assert len(texts) > len(accepted) > len(unlike) > len(clean) > 50  # each stage takes something

    got = sorted(corpus_pipeline.run(spark, planted).collect(), key=lambda r: r["start"])
    count = {i: sum(1 for r in got if r["doc_id"] == i) for i in {r["doc_id"] for r in got}}
    assert set(count) == clean and set(count.values()) <= {1, 2}
    library, start = Tokenizer.from_file(tokens.tokenizer_path()), 0
    assert [r["doc_id"] for r in got] == sorted(r["doc_id"] for r in got)
    for r in got:
        ids = np.array([*library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, tokens.END_ID], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
