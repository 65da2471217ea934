"""Resolving contexts: both ways against comparing the windows themselves."""

import random

import numpy as np
import pytest

from perfloom.llm import suffix_dedup


@pytest.mark.parametrize("paired", [12, 1])
def test_resolve_equals_comparing_windows(monkeypatch, paired):
    monkeypatch.setattr(suffix_dedup, "PAIRED", paired)
    rng = random.Random(paired)
    keys, offsets, windows, texts = [], [], [], []
    for g in range(60):
        middle = bytes(rng.choices(b"abcdefgh ", k=64))
        left, right = bytes(rng.choices(b"ab ", k=136)), bytes(rng.choices(b"ab ", k=400))
        for _ in range(rng.choice([1, 2, 2, 3, 5, 9])):
            o = rng.randint(0, 136)
            w = rng.randint(1, min(137, o + 1))
            t = bytearray((left[136 - o :] + middle + right)[: w + 199])
            for _ in range(rng.choice([0, 1, 1, 2])):
                k = rng.randrange(len(t))
                if not o <= k < o + 64:
                    t[k] = 90
            keys.append(g)
            offsets.append(o)
            windows.append(w)
            texts.append(bytes(t))
    got = suffix_dedup.resolve(np.array(keys), np.array(offsets), np.array(windows), texts)
    seen = {}
    for i, (g, o, w, t) in enumerate(zip(keys, offsets, windows, texts, strict=True)):
        for k in range(w):
            seen.setdefault((g, o - k, t[k : k + 200]), []).append((i, k))
    want = [np.zeros(w, bool) for w in windows]
    for places in seen.values():
        if len({i for i, _ in places}) > 1:
            for i, k in places:
                want[i][k] = True
    assert all((a == b).all() for a, b in zip(got, want, strict=True)) and sum(x.sum() for x in want) > 0
