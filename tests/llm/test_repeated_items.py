"""Items that repeat are searched for once and found as often as they are."""

from __future__ import annotations

import time
import tracemalloc

import numpy as np

from perfloom.llm.decontaminate import Items, leaks, sequences


def test_equal_items_cost_as_one():
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(400)]
    item = " ".join(rng.choice(words, 30)).encode()
    text = (" ".join(rng.choice(words, 4_000)) + " ").encode() + item + b" " + " ".join(rng.choice(words, 4_000)).encode()
    items = Items([(i, item) for i in range(20_000)])
    tracemalloc.start()
    began = time.process_time()
    found = list(items.find(iter([("d", sequences([text])[0])])))
    seconds, peak = time.process_time() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(f[1] for f in found) == list(range(20_000)) and {f[2:] for f in found} == {(4_000, 30, 0)}
    assert seconds < 20 and peak < 200 << 20


def test_equal_items_among_others(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    kinds = [" ".join(rng.choice(words, n)) for n in (1, 2, 9, 20, 20)]
    items = spark.createDataFrame([(i, kinds[i % 5]) for i in range(25)] + [(90, None), (91, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, kinds[2] + " x " + kinds[3]), (2, "y " + kinds[4].replace(" ", "  ").upper()), (3, None)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks(docs, items).collect()}
    for d, k in ((1, 2), (1, 3), (2, 4)):
        assert {(d, i) for i in range(25) if i % 5 == k} <= got
    assert all((d, i) in got for d, i in got for i in range(i % 5, 25, 5))
