"""Texts are cut into pieces on their bytes, and a piece met before is not encoded again."""

import numpy as np
import pyarrow as pa
import pytest

from frostline.llm import tokens


@pytest.fixture(scope="module")
def enc():
    return tokens.Encoder(tokens.tokenizer_path())


def equal(enc, texts: list[str]) -> None:
    want = [[*x.ids, tokens.END_ID] for x in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, enc.kind).tolist() for x in enc.encode(pa.array(texts))] == want


def test_known_runs_are_not_encoded_again(enc, monkeypatch):
    first = ["Alpha, beta.\nGamma delta!", "Epsilon (zeta) 12"]
    equal(enc, first)
    asked = []
    monkeypatch.setattr(enc, "_ids", lambda texts: asked.append(texts) or tokens.Encoder._ids(enc, texts))
    equal(enc, [*first, "Alpha.\nEpsilon", "Gamma, delta.\nGamma beta! delta, beta"])
    assert sum(map(len, asked)) == 0


def test_pieces_at_the_edges_of_texts(enc):
    ends = ["", " ", "  ", "\n", "\n\n", "\n\n\n", " \n", "\n ", " ", "  ", "　", "'", "'s", "é", "×", "ҁ", "҂", "5", "!", "́", "\x1c", "\x85", "日", "–"]
    texts = [a + b + c for a in ends for b in ("", "a", "'s", "é!") for c in ends]
    equal(enc, texts)
    equal(enc, ["x" + a + " " + b + "y" for a in ends for b in ends])
    equal(enc, ["a<|endoftext|> b", "<|endoftext|>", " <|endoftext|>\n", "<|endoftext| >"])


def test_memory_keeps_what_was_met_last():
    memory = tokens.Memory(4)
    names = lambda *x: pa.array([f"{i}".encode() for i in x], pa.large_binary())
    for x in (1, 2, 3, 4):
        assert memory.find(names(x)).tolist() == [-1]
        memory.keep(names(x), names(x * 10))
    assert memory.find(names(1)).tolist() == [0]
    memory.find(names(5))
    memory.keep(names(5), names(50))
    assert len(memory) == 2 and memory.find(names(1, 5, 2)).tolist() == [0, 1, -1] and memory.ids.to_pylist() == [b"10", b"50"]
