"""What is sent to shards: no copies of whole texts, and no texts that share less than a window's key."""

import numpy as np

from frostline.llm import suffix
from frostline.llm.common import Scratch


class Counted(Scratch):
    """Knows how many rows each table had."""

    def stage(self, name, df):
        out = super().stage(name, df)
        self.rows = getattr(self, "rows", {}) | {name: out.count()}
        return out


def removed(spark, rows):
    scratch = Counted(spark, "t")
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(r) for r in suffix.digests(suffix.remove_repeats(df, scratch)).collect()]
    assert sorted(got, key=str) == sorted(suffix.brute_force(rows), key=str)
    return scratch.rows


def letters(rng, n):
    return "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz é"), n))


def test_copies_of_a_table_send_no_more_than_the_table(spark, monkeypatch):
    rng = np.random.default_rng(8)
    passage = letters(rng, 90)
    rows = [(i, letters(rng, 300) + passage * (i % 3 == 0) + letters(rng, 40)) for i in range(12)] + [(20, "short"), (21, letters(rng, 49)), (None, letters(rng, 60)), (22, None)]
    copies = [((i or 0) + 100 * k, x) for k in (1, 2, 3) for i, x in rows]
    once = removed(spark, rows)
    for most in (suffix.COPIES, 3):  # copies broadcast, and joined by shuffle
        monkeypatch.setattr(suffix, "COPIES", most)
        often = removed(spark, rows + copies + rows[:3])
        assert often["parts"] < 2 * once["parts"] + 100 and often["copies"] == 3 * 14
    assert removed(spark, rows + copies)["parts"] == once["parts"] > 0


def test_texts_that_share_an_anchor_alone_send_nothing(spark):
    rng = np.random.default_rng(9)
    common = letters(rng, 30).replace("é", "e")
    assert removed(spark, [(i, letters(rng, 100) + common + letters(rng, 100)) for i in range(60)])["parts"] == 0


def test_windows_of_one_key_stand_on_one_side_of_their_anchor():
    """Each window belongs to one key of its segment, and windows that are equal have equal keys."""
    rng = np.random.default_rng(10)
    for length in (32, 50, 77):
        keys: dict[bytes, set] = {}
        found: dict[int, set] = {}
        base = rng.integers(97, 100, 400).astype(np.uint8)
        for shift in (0, 1, 7, 30):
            text = np.concatenate([rng.integers(97, 123, shift).astype(np.uint8), base])
            owner, first, windows, place, v = suffix._anchored(text, np.array([len(text)]), length)
            left, right = (dict(zip(at.tolist(), key.tolist(), strict=True)) for at, key in suffix._keys(first, windows, place, v, length))
            for k, (a, n, p) in enumerate(zip(first.tolist(), windows.tolist(), place.tolist(), strict=True)):
                ahead = [w <= p - suffix._before(length) for w in range(a, a + n)]
                assert (k in left, k in right) == (any(ahead), not all(ahead))
                for w, is_left in zip(range(a, a + n), ahead, strict=True):
                    body = text[w : w + length].tobytes()
                    keys.setdefault(body, set()).add((left if is_left else right)[k])
                    found.setdefault((left if is_left else right)[k], set()).add(text[p - suffix._before(length) if is_left else p : p + suffix.GRAM if is_left else w + length].tobytes()[: suffix.GRAM + 9])
        assert all(len(x) == 1 for x in keys.values())
        assert all(len(x) == 1 for x in found.values())
