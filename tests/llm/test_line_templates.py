"""Lines of one template: every near pair is found, and others are hardly compared."""

from __future__ import annotations

import random

import pytest

from perfloom.llm.line_dedup import _packed, _packed_agree, dedup_lines, rare_pairs


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng: random.Random, line: str, edits: int) -> str:
    x = list(line)
    for _ in range(edits):
        at = rng.randrange(len(x))
        kind = rng.randrange(3)
        if kind == 0:
            x[at] = rng.choice("xyz0")
        elif kind == 1:
            x.insert(at, rng.choice("xyz0"))
        else:
            del x[at]
    return "".join(x)


def templated(rng: random.Random, n: int, size: int = 20) -> list[str]:
    return [f"2024-05-01T12:00:00 INFO server.handler request finished id={''.join(rng.choice('0123456789abcdef') for _ in range(size))} ok" for _ in range(n)]


@pytest.mark.parametrize(("tau", "size"), [(1, 20), (2, 20), (2, 3), (3, 12)])
def test_rare_segments_meet_every_near_pair(spark, tau, size):
    rng = random.Random(tau * 100 + size)
    lines = templated(rng, 40, size) + ["".join(rng.choice("ab ") for _ in range(rng.randrange(30, 40))) for _ in range(20)]
    lines = list(dict.fromkeys(lines + [edited(rng, x, rng.randrange(1, tau + 2)) for x in lines]))
    got = {(r.pos, r.other) for r in rare_pairs(spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "bucket int, pos long, line string"), tau).collect()}
    near = {(i, j) for i in range(len(lines)) for j in range(i) if abs(len(lines[i]) - len(lines[j])) <= tau and distance(lines[i], lines[j]) <= tau}
    assert len(near) > 20 and near <= got


def test_lines_of_one_template_make_few_pairs(spark):
    rng = random.Random(5)
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(templated(rng, 3_000))], "bucket int, pos long, line string")
    assert rare_pairs(lines, 2).count() < 3_000


def test_templated_lines_go_only_where_near(spark):
    rng = random.Random(6)
    lines = templated(rng, 300)
    copies = {i: edited(rng, lines[i], rng.choice([1, 2])) for i in range(0, 300, 25)}
    far = {i: edited(rng, lines[i], 6) for i in range(7, 300, 50)}
    rows = [(k, "\n".join(lines[30 * k : 30 * k + 30])) for k in range(10)] + [(50, "\n".join(copies.values())), (60, "\n".join(far.values()))]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert all(got[k].n_removed == 0 for k in range(10))
    assert got[50].n_removed == len(copies)
    assert got[60].n_removed == sum(any(distance(x, y) <= 2 for y in lines) for x in far.values())


def reworded(rng: random.Random, words: list[str], edits: int) -> str:
    x = list(words)
    for at in rng.sample(range(len(x)), edits):
        x[at] = rng.choice(words) if rng.randrange(2) else x[at] + rng.choice(words)
    return " ".join(x)


def test_near_copies_of_a_line_make_few_pairs(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 8))) for _ in range(90)]
    lines = list(dict.fromkeys(reworded(rng, words, rng.randrange(1, 4)) for _ in range(600)))
    n = len(lines)
    lines += [edited(rng, lines[i], 2) for i in range(40)]
    got = {(r.pos, r.other) for r in rare_pairs(spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "bucket int, pos long, line string"), 2).collect()}
    assert {(n + i, i) for i in range(40)} <= got
    assert len(got) < 3_000


def test_packed_counts_agree_where_lines_are_near(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("eEtT0123v.- ") for _ in range(rng.randrange(30, 90))) for _ in range(300)]
    rows = [(tau, x, edited(rng, x, tau)) for x in base for tau in (1, 2, 3)] + [(0, x, edited(rng, x, 25)) for x in base]
    pairs = spark.createDataFrame(rows, "tau int, x string, y string")
    pairs = pairs.selectExpr("*", *_packed("x")).withColumnsRenamed({"low": "a", "high": "b"}).selectExpr("*", *_packed("y")).localCheckpoint()
    for tau in (1, 2, 3):
        assert pairs.where(f"tau = {tau}").where(_packed_agree(("a", "b"), ("low", "high"), tau)).count() == 300
    assert pairs.where("tau = 0").where(_packed_agree(("a", "b"), ("low", "high"), 2)).count() < 30
