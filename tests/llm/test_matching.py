"""Large-item matching, held against brute force."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from perfloom.llm.matching import Plan, cut, pack_whole, placed
from perfloom.llm.packing import CAPACITY


def packed(lengths: list[int], capacity: int) -> list[list[int]]:
    """The lengths in each sequence; fails where offsets leave gaps, overlap or pass the capacity."""
    counts: dict[int, int] = defaultdict(int)
    for x in lengths:
        counts[x] += 1
    plan = Plan(counts, capacity)
    rank, seen = [], defaultdict(int)
    for x in lengths:
        rank.append(seen[x])
        seen[x] += 1
    sequence, offset = placed(plan.places(), np.array(lengths, np.int64), np.array(rank, np.int64))
    bins: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for s, o, x in zip(sequence.tolist(), offset.tolist(), lengths, strict=True):
        bins[s].append((o, x))
    for pieces in bins.values():
        at = 0
        for o, x in sorted(pieces):
            assert o == at
            at += x
        assert at <= capacity
    assert sorted(bins) == list(range(plan.sequences))
    return [[x for _, x in sorted(p)] for p in bins.values()]


def matched(large: list[int], capacity: int) -> int:
    """The most pairs that fit, by trying all."""
    if len(large) < 2:
        return 0
    a, rest = large[0], large[1:]
    return max([matched(rest, capacity), *(1 + matched(rest[:i] + rest[i + 1 :], capacity) for i, b in enumerate(rest) if a + b <= capacity)])


def best_fit_decreasing(lengths: list[int], capacity: int) -> int:
    gaps: list[int] = []
    for x in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= x]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - x)
        else:
            gaps.append(capacity - x)
    return len(gaps)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=40))
def test_plan_packs_every_piece_once(lengths):
    packed(lengths, 30)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(11, 30), max_size=8))
def test_matching_makes_as_many_pairs_as_can_be(large):
    bins = packed(large, 30)
    assert all(len(b) <= 2 for b in bins)
    assert sum(len(b) == 2 for b in bins) == matched(large, 30)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10), max_size=60))
def test_small_pieces_are_packed_as_best_fit_decreasing(lengths):
    assert len(packed(lengths, 30)) == best_fit_decreasing(lengths, 30)


def test_few_sequences_are_used():
    rng = np.random.default_rng(5)
    for _ in range(20):
        lengths = np.minimum(CAPACITY, rng.lognormal(5.5, 1.3, 2_000).astype(int) + 1).tolist()
        assert len(packed(lengths, CAPACITY)) <= best_fit_decreasing(lengths, CAPACITY)


def test_cut_leaves_only_the_first_piece_short():
    for n in (1, 5, 2047, 2048, 2049, 4096, 10_000):
        pieces = cut(n)
        assert pieces[0][0] == 0 and sum(x for _, x in pieces) == n and all(x == CAPACITY for _, x in pieces[1:])
        assert all(a + x == b for (a, x), (b, _) in zip(pieces, pieces[1:], strict=False))


def expected(rows) -> list[tuple]:
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    out = []
    for doc_id, text in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        out += [(doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return sorted(out, key=repr)


def test_pieces_are_those_of_the_library_and_sequences_are_full(spark):
    rng = np.random.default_rng(7)
    words = ["the", "haning", "<|endoftext|>", "été", "日本", "0001", "\n\n", "x" * 50]
    rows = [(i, " ".join(rng.choice(words, int(n)))) for i, n in enumerate(rng.lognormal(4, 1.6, 120))]
    rows += [(1, None), (2, ""), (None, "no id"), (5, "long " * 9_000), (5, "long " * 9_000), (7, "ab" * 30_000)]
    docs = spark.createDataFrame([(a, b, "x", 1, 2) for a, b in rows], "doc_id long, text string, sequence_id string, piece int, part int").repartition(5)
    got = pack_whole(docs).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == expected(rows)
    bins: dict[int, list] = defaultdict(list)
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 2048
    assert len(bins) <= best_fit_decreasing([r.length for r in got], 2048)


@pytest.mark.parametrize("rows", [[], [(3, None)]])
def test_empty_tables_and_texts(spark, rows):
    got = pack_whole(spark.createDataFrame(rows, "doc_id long, text string"), with_ids=False)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert [tuple(r) for r in got.collect()] == [(3, 0, 0, 1, zlib.crc32(bytes(4)), 0, 0)] * len(rows)
