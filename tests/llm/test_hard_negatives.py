"""Hard negatives held against brute force and against SQL."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from perfloom.llm import queries
from perfloom.llm.hard_negatives import FAR, Pivots, Split, first, hard_negatives, products
from perfloom.llm.oracles import HARD_NEGATIVES


def brute(rows, anchors, positives=5, negatives=5, least=80) -> list[tuple]:
    """rows: different (id, label, vector)."""
    out = []
    for a, label, q in rows:
        if a not in anchors:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), i, g) for i, g, v in rows if i != a)
        for p in [s for s in scored if s[2] == label][:positives]:
            good = [s for s in scored if s[2] != label and least * -p[0] <= 100 * -s[0] <= 100 * -p[0]][:negatives]
            out += [(a, p[1], k + 1, s[1], -p[0], -s[0]) for k, s in enumerate(good)]
    return sorted(out)


def rows_of(df) -> list[tuple]:
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def some_rows(seed: int, n: int, width: int = 12) -> list[tuple]:
    """Clusters, near copies of one vector in a third of the rows, equal vectors, and labels that cut across."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 60, (6, width))
    out = []
    for i in range(n):
        c = 0 if i % 3 == 0 else int(rng.integers(1, 6))
        v = centres[c] + rng.normal(0, 2 if c == 0 else 25, width) * (i % 5 > 0)
        out.append((i, int(rng.integers(0, 4)), [int(x) for x in v]))
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(-300, 300), min_size=4, max_size=4), min_size=2, max_size=40))
def test_brackets_hold_every_score(vectors):
    x = np.array(vectors, np.int64)
    p = Pivots(x, float((x * x).sum(1).max()), 5)
    exact, dq, d = products(x, x), p.queries(x), p.rows(x)
    for i in range(len(x)):
        for j in range(len(x)):
            low = high = np.array([exact[i, j]])
            assert p.survivors(x[i : i + 1], dq[i : i + 1], d[j : j + 1], low, high).all()
    # A cell of all rows can't be ruled out for any score in it.
    n = len(x)
    assert p.cells(x, d.min(0)[None], d.max(0)[None], exact.max(1), exact.min(1))[:, 0].all() or n == 0
    assert all(p.cells(x, d.min(0)[None], d.max(0)[None], exact[:, j], exact[:, j]).all() for j in range(n))


def test_brackets_rule_rows_out():
    rows = some_rows(1, 600)
    x = np.array([v for _, _, v in rows], np.int64)
    p = Pivots(x, float((x * x).sum(1).max()), 16)
    exact = products(x[:20], x)
    fifth = np.sort(exact, axis=1)[:, -5]
    left = p.survivors(x[:20], p.queries(x[:20]), p.rows(x), fifth, np.full(20, FAR))
    assert (left | (exact < fifth[:, None])).all() and left.mean() < 0.7


def test_products_are_exact_beyond_floating_point():
    x = np.array([[2**26 + 1, 3], [2**26 - 1, -5]], np.int64)
    assert products(x, x).tolist() == [[sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for s in x] for r in x]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-3, 3), st.integers(0, 50)), max_size=60), st.integers(1, 6))
def test_first_takes_ties_by_id(pairs, n):
    score, ids = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
    got = [(int(score[i]), int(ids[i])) for i in first(score, ids, n)]
    assert got == sorted(pairs, key=lambda p: (-p[0], p[1]))[:n]


def test_split_searches_labels():
    rows = some_rows(4, 200)
    x = np.array([v for _, _, v in rows], np.int64)
    ids, labels = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    p = Pivots(x, float((x * x).sum(1).max()))
    split = Split(ids, labels, x, p.rows(x))
    asks = {"id": ids[:70], "label": labels[:70], "q": x[:70], "d": p.queries(x[:70]), "low": [[-FAR]] * 70, "high": [[FAR]] * 70}
    for same in (True, False):
        got = {i: list(zip(found.tolist(), score.tolist(), strict=True)) for i, _, found, score in split.search(p, asks, same, 3)}
        for i in range(70):
            mine = sorted((-int(x[i] @ x[j]), j) for j in range(200) if j != i and (labels[j] == labels[i]) == same)[:3]
            assert got[i] == [(j, -s) for s, j in mine]


@pytest.mark.parametrize(("positives", "negatives", "least", "pivots"), [(5, 5, 80, 16), (3, 2, 50, 1), (1, 7, 95, 6)])
def test_against_brute_force(spark, positives, negatives, least, pivots, monkeypatch):
    monkeypatch.setattr("perfloom.llm.hard_negatives.CELL_ROWS", 40)
    monkeypatch.setattr("perfloom.llm.hard_negatives.QUERY_ROWS", 7)
    rows = some_rows(9, 500)
    table = [(i, g, v, "x", 1.5) for i, g, v in rows] + [(7, *rows[7][1:], "again", 2.0), (None, 1, [1] * 12, "", 0.0), (600, None, [1] * 12, "", 0.0), (601, 1, None, "", 0.0), (602, 1, [*[1] * 11, None], "", 0.0), (603, 1, [1, 2], "", 0.0), (604, 2, [2**60] * 12, "", 0.0), (605, 2, [], "", 0.0)]
    df = spark.createDataFrame(table, "id long, label int, v array<long>, cell string, score double").repartition(3)
    expected = brute(rows, {i for i in range(500) if i % 10 == 0}, positives, negatives, least)
    assert len(expected) > 50
    assert rows_of(hard_negatives(df, "id % 10 = 0", positives, negatives, least, pivots, fit_rows=100)) == expected


def test_ties_zero_and_negative_scores(spark):
    vectors = [[0, 0], [1, 0], [1, 0], [-1, 0], [2, 2], [0, 0], [1, 0]]
    rows = [(i, i % 2, v) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "id long, label long, v array<int>")
    assert rows_of(hard_negatives(df, "true")) == brute(rows, set(range(7)))


def test_empty_tables(spark):
    schema = "id long, label int, v array<long>"
    assert hard_negatives(spark.createDataFrame([], schema), "true").collect() == []
    one = spark.createDataFrame([(1, 1, [1, 2])], schema)
    assert hard_negatives(one, "true").collect() == []
    assert hard_negatives(one, "id = 2").collect() == []
    assert hard_negatives(one, "cast(null as boolean)").columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_query_against_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(0, 10)), [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(400)]
    rows += [(400, None, [0.1] * 8), (500, 1, None), (600, 1, [float("nan"), *[0.1] * 7]), (700, 2, [float("inf"), *[0.1] * 7]), (800, 3, [None, *[0.5] * 7]), (-100, 3, [0.3] * 8)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got = rows_of(queries.op11_hard_negatives(spark, str(tmp_path)))
    assert got and got == sorted(con.sql(HARD_NEGATIVES).fetchall())
