"""Segments are united by their bytes: a hash that gives different ones the same name changes nothing."""

import numpy as np
import xxhash

from frostline.llm import suffix
from frostline.llm.common import Scratch


def narrowed():
    """Five names for all segments at first, four bits with the next seed, then enough."""

    def narrow(part: bytes, seed: int) -> int:
        return xxhash.xxh3_64_intdigest(part, seed) % (5, 16)[seed] if seed < 2 else xxhash.xxh3_64_intdigest(part, seed)

    return narrow  # made in here, so that it goes to workers by value


def rows_of(seed: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    base = ["".join(rng.choice(list("abcdefgh é"), 400)) for _ in range(4)]
    rows = [(int(i), base[rng.integers(4)][rng.integers(0, 100) :][: rng.integers(60, 300)] + base[rng.integers(4)][: rng.integers(0, 150)]) for i in range(50)]
    return [*rows, (60, base[0]), (61, base[0]), (None, base[1]), (3, base[2])]


def test_shared_names_are_found_out(spark):
    rows = rows_of(5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for hot in (4096, 3):
        got = [tuple(r) for r in suffix.digests(suffix.remove_repeats(df, Scratch(spark, "t"), hot=hot, identify=narrowed())).collect()]
        assert sorted(got, key=str) == sorted(suffix.brute_force(rows), key=str)


def test_the_work_is_done_again_until_names_differ(spark, monkeypatch):
    seeds, plan = [], suffix.find_repeats

    def spied(*args):
        seeds.append(args[5] if len(args) > 5 else 0)
        return plan(*args)

    monkeypatch.setattr(suffix, "find_repeats", spied)
    suffix.remove_repeats(spark.createDataFrame(rows_of(6), "doc_id long, text string"), Scratch(spark, "t"), identify=narrowed())
    assert seeds == [0, 1, 2]
