"""Texts are encoded many at once, from Arrow, and a distinct part once."""

import numpy as np
import pyarrow as pa

from frostline.llm import tokens


def test_small_batches_are_gathered_and_long_ones_cut(monkeypatch):
    monkeypatch.setattr(tokens, "BATCH_BYTES", 100)
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + 3)), pa.array(["x" * 12, "", "y" * 20])], ["doc_id", "text"]) for k in range(0, 30, 3)]
    batches += [pa.RecordBatch.from_arrays([pa.array([30, 31]), pa.array(["z" * 500, "w" * 500])], ["doc_id", "text"]), batches[0].slice(0, 0)]
    got = list(tokens._batches(iter(batches)))
    assert pa.Table.from_batches(got) == pa.Table.from_batches(batches) and 3 < len(got) < len(batches)
    assert list(tokens._batches(iter([]))) == []


def test_arrow_texts_are_encoded_as_the_library_does(monkeypatch):
    monkeypatch.setattr(tokens, "MADE", 40)
    monkeypatch.setattr(tokens, "BARE", 20)
    enc, rng = tokens.Encoder(tokens.tokenizer_path()), np.random.default_rng(5)
    bits = ["a", "the", " ", " ", "  ", "\n", "<|endoftext|>", "don't", "7", "é", " ", "\x1c", "word,", "x.y", "Ünd;", " .", "日本", "\n\n"]
    for kind in (pa.string(), pa.large_string()):
        for _ in range(5):
            texts = ["".join(rng.choice(bits, rng.integers(0, 25))) for _ in range(300)] + ["", " ", "a ", " a"]
            want = [[*x.ids, tokens.END_ID] for x in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
            got = enc.encode(pa.array(["cut off", *texts], kind).slice(1))
            assert [np.frombuffer(x, enc.kind).tolist() for x in got] == want
            assert len(enc.made) <= 40 and len(enc.bare) <= 20
    assert enc.encode(pa.array([], pa.string())) == []
