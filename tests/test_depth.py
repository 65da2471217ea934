"""Ranges, as-of lookups, graph rounds, streams and paged listings, held against brute force."""

from __future__ import annotations

import json
import random

import pytest

from perfloom.operators import aggregates as A
from perfloom.operators import graph as G
from perfloom.operators import joins as J
from perfloom.operators import ordered as O
from perfloom.operators import ranges as I
from perfloom.sources.paged import SCHEMA, PageReader, StagedPages, StagedReader, listing
from perfloom.streaming.increments import Results, append_unseen


def some_ranges(seed: int, n: int) -> list[tuple[int, int, int, int]]:
    """(k, id, start, end) of lengths from 1 to 10^9, some empty, around 0 and far from it."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        s = r.choice([0, -5, 10**6, -(10**9), 7]) + r.randrange(-50, 50)
        out.append((r.randrange(3), i, s, s + r.choice([-1, 0, 0, 1, 3, 64, 1000, 10**6, 10**9]) + r.randrange(0, 3)))
    return out


def test_blocks_cover_exactly(spark):
    rows = [(s, e) for s in range(-9, 10) for e in range(-9, 12)] + [(-(2**61), 2**61), (5, 10**9 + 5), (None, 3), (3, None)]
    got = spark.createDataFrame(rows, "s long, e long").withColumn("b", I.blocks("s", "e")).collect()
    for r in got:
        if r.s is None or r.e is None or r.s > r.e:
            assert not r.b
            continue
        parts = sorted((b.block << b.level, ((b.block + 1) << b.level) - 1) for b in r.b)
        assert parts[0][0] == r.s and parts[-1][1] == r.e and all(a[1] + 1 == b[0] for a, b in zip(parts, parts[1:], strict=False))
        assert len(parts) <= 2 * (r.e - r.s + 1).bit_length()
        assert r.e - r.s > 10**9 or len(parts) <= 60


def test_joins_of_ranges_of_any_length(spark):
    a, b = some_ranges(1, 120), some_ranges(2, 120)
    x, y = spark.createDataFrame(a, "k int, a long, s1 long, e1 long"), spark.createDataFrame(b, "k int, b long, s2 long, e2 long")
    want = sorted((i, j) for k, i, s, e in a for m, j, t, f in b if k == m and s <= e and t <= f and s <= f and t <= e)
    assert sorted((r.a, r.b) for r in I.overlapping(x, y, ["k"], ("s1", "e1"), ("s2", "e2")).collect()) == want
    want = sorted((i, j) for k, i, s, _ in a for m, j, t, f in b if k == m and t <= s <= f)
    assert sorted((r.a, r.b) for r in I.stabbed(x, y, ["k"], "s1", "s2", "e2").collect()) == want
    want = sorted(i for k, i, s, e in a if s <= e and any(k == m and t <= s and e <= f for m, _, t, f in b))
    assert sorted(r.a for r in I.contained(x, y, ["k"], ("s1", "e1"), ("s2", "e2")).collect()) == want
    want = sorted((i, min((f - t, t, j) for m, j, t, f in b if k == m and t <= s <= f)[2]) for k, i, s, _ in a if any(k == m and t <= s <= f for m, _, t, f in b))
    assert sorted((r.a, r.b) for r in I.smallest_span(x, y, ["k"], "s1", "s2", "e2", "b").collect()) == want
    none = spark.createDataFrame([], y.schema)
    assert I.overlapping(x, none, ["k"], ("s1", "e1"), ("s2", "e2")).collect() == [] and I.smallest_span(x, none, ["k"], "s1", "s2", "e2", "b").collect() == []


def test_keys_dealt_out_and_rows_as_many_as_the_input(spark):
    a, b = some_ranges(3, 150), some_ranges(4, 150)
    x, y = spark.createDataFrame(a, "k int, a long, s1 long, e1 long"), spark.createDataFrame(b, "k int, b long, s2 long, e2 long")
    want = sorted((i, j) for k, i, s, e in a for m, j, t, f in b if k == m and s <= e and t <= f and s <= f and t <= e)
    assert sorted((r.a, r.b) for r in I.overlapping(x, y, ["k"], ("s1", "e1"), ("s2", "e2"), hot=9).collect()) == want
    want = sorted(i for k, i, s, e in a if s <= e and any(k == m and t <= s and e <= f for m, _, t, f in b))
    assert sorted(r.a for r in I.contained(x, y, ["k"], ("s1", "e1"), ("s2", "e2"), hot=9).collect()) == want
    want = sorted((i, min((f - t, t, j) for m, j, t, f in b if k == m and t <= s <= f)[2]) for k, i, s, _ in a if any(k == m and t <= s <= f for m, _, t, f in b))
    assert sorted((r.a, r.b) for r in I.smallest_span(x, y, ["k"], "s1", "s2", "e2", "b", hot=9).collect()) == want
    # No row for each block, which a broadcast could take for few.
    for out in (I.overlapping(x, y, ["k"], ("s1", "e1"), ("s2", "e2")), I.contained(x, y, ["k"], ("s1", "e1"), ("s2", "e2")), I.smallest_span(x, y, ["k"], "s1", "s2", "e2", "b")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "Join" not in plan


def test_a_dense_place_does_not_multiply(spark):
    # 3,000 ranges around one place and 3,000 numbers there: 9 million pairs, of which none is made.
    points, spans = spark.range(3_000).selectExpr("1 k", "id p", "id % 7 + 500 x"), spark.range(3_000).selectExpr("1 k", "id s", "400 - id % 90 a", "600 + id % 80 b")
    out = I.smallest_span(points, spans, ["k"], "x", "a", "b", "s")
    assert {r.s for r in out.collect()} == {r.s for r in spans.orderBy(spans.b - spans.a, "a", "s").limit(1).collect()}
    joined = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in joined


def test_covered_and_uncovered(spark):
    r = random.Random(5)
    make = lambda n: [(r.randrange(3), s := r.randrange(0, 60), s + r.randrange(-1, 9)) for _ in range(n)]
    a, k = make(40), make(30)
    x, y = (spark.createDataFrame(v, "k int, s long, e long") for v in (a, k))
    numbers = lambda rows, g: {n for m, s, e in rows if m == g for n in range(s, e + 1)}
    for got, want in ((I.covered(x, ["k"], "s", "e"), lambda g: numbers(a, g)), (I.uncovered(x, y, ["k"], "s", "e"), lambda g: numbers(a, g) - numbers(k, g))):
        rows = sorted((q.k, q.s, q.e) for q in got.collect())
        for g in range(3):
            mine = [(g, s, e) for m, s, e in rows if m == g]
            assert numbers(mine, g) == want(g) and all(p[2] + 1 < q[1] for p, q in zip(mine, mine[1:], strict=False))


@pytest.mark.parametrize("by", [None, ["k"]])
def test_as_of_within_a_hot_key(spark, by):
    r = random.Random(3)
    left = [(i, r.choice([1, 1, 1, 2, None]), r.choice([None, *range(40)])) for i in range(300)]
    right = [(r.choice([1, 1, 1, 2, None]), r.choice([None, *range(40)]), r.choice([None, *range(9)])) for _ in range(60)]
    x, y = spark.createDataFrame(left, "id int, k int, t int"), spark.createDataFrame(right, "k int, at int, v int")
    got = {q.id: q.v for q in J.as_of(x, y if by else y.drop("k"), "t", "at", "v", by).collect()}
    for i, k, t in left:
        found = [(at, v) for m, at, v in right if at is not None and v is not None and t is not None and at < t and (m == k or not by)]
        assert got[i] == (max(found)[1] if found else None)
    assert len(got) == len(left)


def test_among_paths_is_existence_of_pairs(spark):
    names = ["a/b/c.py", "c.py", "./c.py", "x/y/bc.py", "d//e.py", "e.py", "", "  ", "dir/", "dir", "q/z.py", "z", None, "__init__.py", "p/__init__.py", "r/s/__init__.py", "/abs/c.py"]
    a = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, p string")
    for some in (names, ["c.py"], ["u/v/w/xc.py"], ["y"], []):
        b = spark.createDataFrame([(n,) for n in some], "q string")
        pairs = {r.i for r in J.same_path(a, b, "p", "q").collect()}
        assert sorted(r.i for r in J.among_paths(a, b, "p", "q").collect()) == sorted(pairs)


def brute_references(refs, test, start, end, most) -> dict[str, set[int]]:
    seen: dict[str, set[int]] = {}
    now = {(test, n) for n in range(start, end + 1)}
    for depth in range(most + 2):
        now = {(f, n) for f, n in now if n not in seen.get(f, set())}
        for f, n in now:
            seen.setdefault(f, set()).add(n)
        if depth <= most:
            now = {(t, x) for f, n, t, s, e in refs if (f, n) in now and "test" not in t for x in range(s, e + 1)}
    return seen


def test_referenced_ranges(spark):
    r = random.Random(8)
    files = ["lib/a.py", "lib/b.py", "c.py", "data.bin", "lib/test_x.py", "test_1.py"]
    refs = [(r.choice(files), r.randrange(30), r.choice(files), s := r.randrange(30), s + r.randrange(0, 6)) for _ in range(150)] + [("test_1.py", 2, "lib/a.py", 0, 29)] * 2
    edges = spark.createDataFrame(refs, "file string, line int, to_file string, start int, end int")
    tests = spark.createDataFrame([("test_1.py", 0, 9), ("lib/test_x.py", 3, 4), ("test_none.py", 0, 5)], "test string, start int, end int")
    for most in (0, 1, 5):
        got: dict[str, dict[str, set[int]]] = {}
        for q in G.referenced_ranges(edges, tests, most).collect():
            mine = got.setdefault(q.test, {}).setdefault(q.file, set())
            assert not mine & set(range(q.start - 1, q.end + 2)), "ranges that could be one"
            mine |= set(range(q.start, q.end + 1))
        for test, start, end in (("test_1.py", 0, 9), ("lib/test_x.py", 3, 4), ("test_none.py", 0, 5)):
            assert got[test] == brute_references(refs, test, start, end, most)
    hunks = spark.createDataFrame([("c.py", 100, 200), ("test_none.py", 5, 9)], "file string, start int, end int")
    assert {q.test for q in G.referenced_ranges(edges, tests, 3, hunks=hunks).collect()} == {"test_none.py"}


def test_unseen_records_are_appended_once(spark, tmp_path):
    base = str(tmp_path)
    for rows in ([(1, "a"), (1, "b"), (2, "c")], [(2, "d"), (3, "e")], []):
        spark.createDataFrame(rows, "id int, text string").write.mode("append").parquet(f"{base}/in")
        append_unseen(spark.readStream.schema("id int, text string").parquet(f"{base}/in"), ["id"], f"{base}/out", f"{base}/state").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{base}/out").collect()) == [1, 2, 3]


def test_results_merge_and_replay(spark, tmp_path):
    schema = "id string, text string, n int"
    results = Results(spark, f"{tmp_path}/r", schema, "id", "text", "n", buckets=3)
    assert results.read().collect() == []
    first = spark.createDataFrame([("a", "x", 1), ("b", None, 1), ("a", "y", 1), (None, "z", 9), ("a", "x", 0)], schema)
    second = spark.createDataFrame([("a", "x", 5), ("c", "w", 1), ("a", "y", 0)], schema)
    results.merge(first, 0)
    assert sorted(results.read().collect(), key=str) == sorted([("a", "x", 1), ("a", "y", 1), ("b", None, 1)], key=str)
    for number in (1, 1):
        results.merge(second, number)
        assert sorted(results.read().collect(), key=str) == sorted([("a", "x", 5), ("a", "y", 1), ("b", None, 1), ("c", "w", 1)], key=str)
    tasks = spark.createDataFrame([("a", "x"), ("a", "new"), ("b", ""), ("q", "w")], "id string, text string")
    assert sorted((r.id, r.text) for r in results.pending(tasks).collect()) == [("a", "new"), ("q", "w")]


def flaky() -> type[StagedPages]:
    """A source whose pages fail as often as their files say; made here, so that workers get its code."""

    class Flaky(StagedReader):
        def fetch(self, page: int) -> list[str]:
            path = f"{self.options['path']}/fails-{page}"
            try:
                with open(path) as f:
                    left = int(f.read())
            except OSError:
                left = 0
            if left:
                with open(path, "w") as f:
                    f.write(str(left - 1))
                raise ConnectionError("slow down")
            return StagedReader.fetch(self, page)

    class FlakyPages(StagedPages):
        @classmethod
        def name(cls) -> str:
            return "flaky_pages"

        def reader(self, schema):
            return Flaky(self.options)

    return FlakyPages


def staged(path, pages: dict[int, list[str]]) -> str:
    for page, items in pages.items():
        folder = path / f"page={page}"
        folder.mkdir(parents=True)
        (folder / "part-0").write_text("".join(f"{i}\n" for i in items), encoding="utf-8")
    return str(path)


def test_paged_listing_stops_at_the_first_empty_page(spark, tmp_path):
    pages = {p: [f"{p}-{i}" for i in range(p % 3 + 1)] for p in range(1, 12)} | {13: ["behind the end"], 40: ["far behind"]}
    path = staged(tmp_path / "a", pages)
    want = sorted((p, i, x) for p in range(1, 12) for i, x in enumerate(pages[p]))
    for width, tasks in ((1, 1), (2, 3), (5, 8), (100, 2)):
        assert sorted(map(tuple, listing(spark, StagedPages, path=path, pages_per_task=width, tasks=tasks).collect())) == want
    assert {r.page for r in listing(spark, StagedPages, path=path, pages_per_task=3, tasks=2, most_pages=7).collect()} == set(range(1, 8))
    assert listing(spark, StagedPages, path=str(tmp_path / "none")).collect() == [] and SCHEMA.startswith("page")


def test_failed_pages_are_fetched_again(spark, tmp_path):
    path = staged(tmp_path / "b", {1: ["x"], 2: ["y", "z"]})
    (tmp_path / "b" / "fails-2").write_text("2")
    assert sorted(r.item for r in listing(spark, flaky(), path=path, pages_per_task=2, tasks=2, retries=3, pause=0.01).collect()) == ["x", "y", "z"]
    reader = PageReader({"retries": "1", "pause": "0"})
    with pytest.raises(NotImplementedError):
        list(reader.read(reader.partitions()[0]))
    busy = tmp_path / "b" / "page=3"
    busy.mkdir()
    (busy / "busy.json").write_text(json.dumps({"reason": "limit"}))
    with pytest.raises(ConnectionError, match="limit"):
        StagedReader({"path": path, "retries": "0"})._fetched(3)


def test_quantiles_by_group(spark):
    np = pytest.importorskip("numpy")
    r = random.Random(4)
    rows = [(r.choice(["a", "a", "a", "b", None, "one"]), r.choice([None, 1.5, r.gauss(0, 10), float(r.randrange(4))])) for _ in range(500)] + [("nulls", None), ("single", 7.0)]
    shares = [0.0, 0.15, 0.5, 0.77, 1.0]
    got = {q.g: q.quantiles for q in O.quantiles_by(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", shares).collect()}
    want = {g: np.quantile([x for k, x in rows if k == g and x is not None], shares).tolist() for g in {k for k, x in rows if x is not None}}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g]) for g in want)


def test_layout_has_every_level(spark):
    chain = [(1, f"n{i:02}", f"n{i - 1:02}" if i else None, 100.0 - i) for i in range(12)] + [(1, "n03b", "n02", 5.0), (1, "lost", "nowhere", 1.0), (2, "r", None, 3.0), (2, "s", None, 4.0)]
    got = {(q.k, q.node): (q.depth, q.x) for q in O.layout(spark.createDataFrame(chain, "k int, node string, parent string, total double"), ["k"]).collect()}
    assert got[1, "n11"] == (11, 0.0) and got[1, "n03b"] == (3, 97.0) and got[2, "s"] == (0, 3.0)
    assert (1, "lost") not in got and len(got) == 15


def test_positions_are_the_order(spark):
    r = random.Random(1)
    rows = [(r.randrange(5), i) for i in range(300)]
    got = sorted((q.position, q.a, q.b) for q in O.positions(spark.createDataFrame(rows, "a int, b int").repartition(7), ["a", "b"]).collect())
    assert got == [(i + 1, a, b) for i, (a, b) in enumerate(sorted(rows))]


def test_same_rows(spark):
    of = lambda rows: spark.createDataFrame(rows, "a int, b string")
    same = lambda x, y, **k: A.same_rows(of(x), of(y), **k).first()["same"]
    one = [(1, "a"), (2, None), (None, "c"), (1, "a")]
    assert same(one, one[::-1]) and same([], [])
    assert not same(one, one[1:]) and not same(one, [(1, "a"), (2, None), (None, "c"), (2, None)]) and not same(one, [])
    assert same(one, one[1:], as_sets=True) and not same(one, one[:2], as_sets=True)
