"""Phrases held against brute force and against SQL."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from perfloom.llm.collocations import Shard, bits, bloom, collocations, counts, hashes, phrase_counts, phrase_hash, suffix_order, tokens
from perfloom.llm.oracles import COLLOCATIONS

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text: str | None) -> list[list[str]]:
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))]


def brute(rows, longest=3, least=10, covered=50, top=2000) -> list[tuple]:
    f: Counter = Counter()
    n: Counter = Counter()
    for lang, text in rows:
        for p in pieces(text):
            n[lang or "und"] += len(p)
            for s in range(1, longest + 1):
                f.update((lang or "und", *p[i : i + s]) for i in range(len(p) - s + 1))
    frequent = {k: a for k, a in f.items() if len(k) > 2 and a >= least}
    out: dict[str, list] = {}
    for (lang, *w), a in frequent.items():
        s = len(w)
        if any(100 * b >= covered * a and k[0] == lang and len(k) - 1 > s and any(list(k[i : i + s]) == w for i in range(1, len(k) - s + 1)) for k, b in frequent.items()):
            continue
        best = min((1_000_000 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, s))
        k = best[1]
        out.setdefault(lang, []).append((-best[0], -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n[lang], -score) for lang, ps in out.items() for i, (score, a, p, x, y) in enumerate(sorted(ps)[:top]))


def rows_of(df) -> list[tuple]:
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def some_texts(seed: int, n: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    words = ["the", "The", "of", "and", "été", "x", "'s", "a-b", "日本", "\x1cq", " ", "\t", "nb sp", ".", ",", "\n", "!?", "\x0b"]
    weights = np.arange(len(words), 0, -1) / sum(range(len(words) + 1))
    sep = [" ", "  ", "\t", " "]
    return [(str(rng.choice(["en", "fr"])), "".join(str(w) + sep[int(rng.integers(4))] for w in rng.choice(words, int(rng.integers(0, 200)), p=weights))) for _ in range(n)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=40), st.integers(1, 5))
def test_suffixes_are_in_order(w, depth):
    order = suffix_order(np.array(w, np.int32), depth).tolist()
    assert sorted(order) == list(range(len(w)))
    heads = [[*w[i : i + depth], *[-1] * depth][:depth] for i in order]
    # A suffix that ends is before those that go on, or beside separators, which have no phrases.
    assert [[max(0, x) for x in h] for h in heads] == sorted([max(0, x) for x in h] for h in heads)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_intervals_are_counts(w):
    expected = {d: Counter(tuple(w[i : i + d]) for i in range(len(w) - d + 1) if 0 not in w[i : i + d]) for d in (1, 2, 3)}
    found = phrase_counts(np.array(w, np.int32), [1, 2, 3])
    assert {d: {tuple(w[s : s + d]): int(n) for s, n in zip(*found[d], strict=True)} for d in found} == {d: dict(c) for d, c in expected.items()}


@pytest.mark.parametrize("limit", [1, 7, 40, 10_000])
def test_shards_lose_and_double_nothing(limit):
    text = " ".join(t for _, t in some_texts(3, 30))
    got: Counter = Counter()
    shard = Shard([1, 2, 3])
    batches = []
    for words in tokens(text.encode(), limit):
        shard.add("en", words)
        batches += shard.close("en")
    batches += shard.close()
    for b in batches:
        for r in b.to_pylist():
            got[r["size"], r["phrase"].decode()] += r["n"]
    expected: Counter = Counter()
    for p in pieces(text):
        expected[0, ""] += len(p)
        for s in (1, 2, 3):
            expected.update((s, " ".join(p[i : i + s])) for i in range(len(p) - s + 1))
    assert +got == +expected


def test_filter_holds_every_phrase(spark):
    phrases = [f"w{i} v{i % 7}" for i in range(3_000)]
    for limit in (1 << 20, 64):
        known = bloom(spark.createDataFrame([(p,) for p in phrases], "phrase string"), limit)
        assert len(known) <= limit
        columns = [hashes(list(c)) for c in zip(*[p.encode().split() for p in phrases], strict=True)]
        for b in bits(phrase_hash(columns), len(known) * 8):
            assert (known[b >> 3] >> (b & 7).astype(np.uint8) & 1).all()
    assert len(bloom(spark.createDataFrame([], "phrase string"))) >= 8


@pytest.mark.parametrize(("longest", "least", "covered", "top"), [(3, 10, 50, 2000), (3, 3, 80, 15), (2, 5, 50, 2000), (4, 4, 60, 2000)])
def test_collocations_against_brute_force(spark, longest, least, covered, top):
    rows = some_texts(11, 40) + [(None, "lone words of und. " * 12), (None, None), ("de", ""), ("en", None), ("en", "The of " * 700)]
    docs = spark.createDataFrame([(i, t, g, "clash", 5) for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, n int").repartition(3)
    expected = brute(rows, longest, least, covered, top)
    assert len(expected) > 10
    assert rows_of(collocations(docs, longest, least, covered, top, shard_words=500)) == expected


def test_large_counts_are_exact(spark):
    # a a (10^6) passes 64 bits from a of some four million on.
    a, x, y = 10**15, 10**15 + 7, 10**15 + 9
    row = spark.range(1).selectExpr(f"cast({a} as decimal(16,0)) a", f"cast({x} as decimal(16,0)) l", f"cast({y} as decimal(16,0)) r").selectExpr("a * a o", "l * r u").selectExpr("(o * 1000000) div u s").first()
    assert row.s == 10**6 * a * a // (x * y)


def test_empty_table_and_texts(spark):
    assert collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert collocations(spark.createDataFrame([("en", None), (None, " .,\n")], "lang string, text string")).collect() == []
    assert counts(spark.createDataFrame([("en", "a b")], "lang string, text string"), [1, 2]).count() == 4


def test_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    path = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{path}'")
    got = rows_of(collocations(spark.read.parquet(path)))
    assert got and got == sorted(con.sql(COLLOCATIONS).fetchall())
