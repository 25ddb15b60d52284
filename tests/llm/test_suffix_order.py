"""Windows are sorted as far as their own length, and anchors are found by place."""

import numpy as np

from frostline.llm import suffix


def test_suffixes_stand_in_order_of_their_first_bytes():
    rng = np.random.default_rng(4)
    for k in range(60):
        depth = int(rng.integers(1, 60))
        parts = [bytes(rng.integers(0, 256, int(rng.integers(1, 110))) % (k % 4 + 1) + 97 * (k % 3)).replace(b"\0\0\0", b"") or b"x" for _ in range(12)]
        parts = [bytes(np.array(list(x), np.uint8)) for x in parts] + [parts[0]]
        want = sorted((x[i : i + depth], o, i) for o, x in enumerate(parts) for i in range(len(x) - depth + 1))
        owner, offset, group = suffix.equal_windows(parts, depth)
        assert list(zip(owner.tolist(), offset.tolist(), strict=True)) == [(o, i) for _, o, i in want]
        ranks = {w: n for n, w in enumerate(sorted({w for w, _, _ in want}))}
        assert group.tolist() == [ranks[w] for w, _, _ in want]


def test_no_more_is_sorted_than_windows_need(monkeypatch):
    parts, seen, plain = [b"ab" * 45] * 40, [], np.sort
    monkeypatch.setattr(np, "sort", lambda a, *x, **y: seen.append(len(a)) or plain(a, *x, **y))
    suffix.equal_windows(parts, 50)
    assert sum(seen) <= 2 * 40 * 90


def test_segments_are_runs_of_windows_with_one_first_anchor():
    rng = np.random.default_rng(6)
    for k in range(40):
        sizes = rng.integers(0, 130, 8)
        ends = np.cumsum(sizes)
        text = rng.integers(97, 99 + k % 5, int(ends[-1])).astype(np.uint8)
        hashes = suffix._hashes(text).tolist() if len(text) >= suffix.GRAM else []
        want = []
        for d, (a, b) in enumerate(zip(ends - sizes, ends, strict=True)):
            last = None
            for s in range(a, b - 49):
                at = min(range(s, s + 50 - suffix.GRAM + 1), key=lambda i: (hashes[i] >> 32, i))
                if at == last:
                    want[-1][2] += 1
                else:
                    want.append([d, int(s - a), 1, int(np.array(hashes[at], np.uint64).view(np.int64))])
                last = at
        assert [list(x) for x in zip(*(c.tolist() for c in suffix.segments(text, ends)), strict=True)] == want


def test_the_first_window_after_an_empty_text_counts():
    text = np.arange(50, dtype=np.uint8)
    owner, start, windows, _ = suffix.segments(text, np.array([0, 50]))
    assert (owner.tolist(), start.tolist(), windows.tolist()) == ([1], [0], [1])
