import os

import pytest
from pyspark.sql import functions as F

from perfloom.operators import aggregates as A
from perfloom.operators import graph as G
from perfloom.operators import joins as J
from perfloom.operators import ordered as O
from perfloom.operators import sampling as S
from perfloom.plans import curation, scoring


def test_as_of_is_strict_and_keeps_unmatched(spark):
    tasks = spark.createDataFrame([(1, "2020-01-02"), (2, "2020-01-01"), (3, "2021-01-01")], "id int, day string")
    releases = spark.createDataFrame([("1.0", "2020-01-01"), ("1.1", "2020-05-01"), ("1.2", "2020-05-01")], "version string, released string")
    got = {r.id: r.version for r in J.as_of(tasks, releases, "day", "released", "version").collect()}
    assert got == {1: "1.0", 2: None, 3: "1.2"}


def test_means_and_gates(spark):
    one = lambda xs, f: spark.createDataFrame([(x,) for x in xs], "x double").agg(f(F.col("x")).alias("y")).first()["y"]
    assert one([1.0, 2.0, 2.0], A.harmonic_mean) == pytest.approx(1.5)
    assert one([1.0, 0.0], A.harmonic_mean) == 0 and one([None], A.harmonic_mean) is None
    assert one([1.0, -1.0, float("nan"), float("inf"), None], A.harmonic_mean_positive) == 1 and one([-1.0], A.harmonic_mean_positive) is None
    assert one([2.0, 8.0, 0.0], A.geometric_mean) == pytest.approx(4)
    gate = lambda d, i, sd: spark.range(1).select(A.bad_run(F.lit(d), F.lit(i), F.lit(sd))).first()[0]
    assert gate(0.0, 0.0, 0.0) and gate(-1.0, -10.0, 2.0)
    assert not gate(-1.0, -25.0, 2.0) and not gate(-2.0, -10.0, 2.0)


def test_scored_report_rules(spark):
    inst = spark.createDataFrame([(i,) for i in range(4)], "instance_id int")
    pred = spark.createDataFrame([(0, 4.0, 2.0), (1, 4.0, 2.0)], "instance_id int, before double, after double")
    gold = spark.createDataFrame([(0, 4.0, 1.0), (1, 4.0, 1.0), (2, 3.0, 1.0)], "instance_id int, before double, after double")
    ok = spark.createDataFrame([(0, 2, 2), (1, 1, 2), (2, 0, 0)], "instance_id int, passed int, expected int")
    r = {x.instance_id: x for x in scoring.report(inst, pred, gold, ok).collect()}
    assert (r[0].human_speedup_ratio, r[1].pred_speedup_ratio, r[1].raw_pred_speedup_ratio) == (0.5, 1.0, 2.0)
    assert r[2].correctness_pct == 1 and r[2].pred_speedup_ratio == 1 and r[3].raw_pred_speedup_ratio is None and r[3].gold_speedup_ratio == 1


def test_intervals(spark):
    x = spark.createDataFrame([(1, 1, 3), (1, 3, 5), (1, 6, 7), (1, 9, 9), (1, 2, 2)], "k int, s int, e int")
    assert sorted((r.s, r.e) for r in O.merged(x, ["k"], "s", "e", gap=1).collect()) == [(1, 7), (9, 9)]
    a, b = x.selectExpr("k", "s s1", "e e1"), x.selectExpr("k", "s s2", "e e2")
    rows = [r[1:] for r in x.collect()]
    want = sorted((s, e, t, f) for s, e in rows for t, f in rows if s <= f and t <= e)
    assert sorted((r.s1, r.e1, r.s2, r.e2) for r in J.overlapping(a, b, ["k"], ("s1", "e1"), ("s2", "e2")).collect()) == want


def test_graph_with_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "caller string, callee string")
    roots = spark.createDataFrame([("a",), ("zzz",)], "node string")
    assert {r.node: r.depth for r in G.depths(e, roots).collect()} == {"a": 0, "b": 1, "c": 2, "zzz": 0}
    assert {r.node for r in G.ancestors(e, spark.createDataFrame([("a",)], "node string")).collect()} == {"a", "b", "c", "d"}


def test_samples(spark):
    x = spark.range(200).selectExpr("id", "cast(pow(1.05, id) as double) v", "cast(id % 7 - 1 as double) w")
    assert S.three_way(x, "id", ["v", "w"], 50).select("id").distinct().count() == 50
    assert S.three_way(x, "id", ["v", "w"], 500).count() == 200
    parts = sorted(r["count"] for r in S.splits(x.select("id"), ["id"], 7).groupBy("split").count().collect())
    assert sum(parts) == 200 and parts[0] >= 28 and parts[-1] <= 29


def test_greedy_bans_ancestors(spark):
    n = spark.createDataFrame([(1, "leaf", 3, 5.0, ["mid", "top"]), (1, "mid", 2, 5.0, ["top"]), (1, "other", 1, 4.0, ["top"]), (1, "top", 0, 9.0, [])], "g int, node string, depth int, gain double, ancestors array<string>")
    assert [r.node for r in O.greedy_cover(n, "g", 0.9).orderBy("rank").collect()] == ["leaf", "other"]


def test_minimal_patches(spark):
    patch = "diff --git a/f b/f\nindex 1..2\n--- a/f\n+++ b/f\n@@ -1,5 +1,6 @@ def x\n a\n b\n-c  \n+d\n+e\n f\n g\n@@ -20,2 +21,2 @@\n x\n-y\n+z\n@@ -40,1 +41,1 @@\n same\ndiff --git a/g b/g\n--- a/g\n+++ b/g\n@@ -7,1 +9,1 @@\n-u\n+v\n"
    want = "--- a/f\n+++ b/f\n@@ -3,2 +3,3 @@\n-c\n+d\n+e\n f\n@@ -21,1 +22,1 @@\n-y\n+z\n--- a/g\n+++ b/g\n@@ -7,1 +7,1 @@\n-u\n+v"
    rows = spark.createDataFrame([(1, patch), (2, None), (3, "no patch"), (4, "--- /dev/null\n+++ b/n\n@@ -0,0 +1,1 @@\n+x")], "id int, patch string")
    assert {r.id: r.patch for r in O.minimal_patches(rows, "id").collect()} == {1: want, 2: "", 3: "", 4: ""}


def test_paths_match_by_name_or_end(spark):
    left = ["lib/a/core.py", "core.py", "x/other.py", "/usr/lib/a/core.py", "b//./c.py", "", "ore.py"]
    right = ["a/core.py", "re.py", "core.py", "b/c.py", "zcore.py", " ", "q.py"]
    a, b = spark.createDataFrame([(x,) for x in left], "l string"), spark.createDataFrame([(x,) for x in right], "r string")

    def meets(x, y):
        x, y = (os.path.normpath(p.strip()) if p.strip() else "" for p in (x, y))
        return bool(x and y) and (os.path.basename(x) == os.path.basename(y) or x.endswith(y) or y.endswith(x))

    assert sorted(map(tuple, J.same_path(a, b, "l", "r").collect())) == sorted((x, y) for x in left for y in right if meets(x, y))


def test_spans_and_pairs(spark):
    p = spark.createDataFrame([(1, 5, 6), (1, 150, 260), (1, 150, 240), (2, 5, 6), (None, 5, 6)], "k int, a int, b int")
    s = spark.createDataFrame([(1, 0, 10), (1, 120, 250), (1, 9, 3), (None, 0, 9)], "k int, s int, e int")
    assert sorted((r.k or 0, r.a, r.b) for r in J.contained(p, s, ["k"], ("a", "b"), ("s", "e")).collect()) == [(0, 5, 6), (1, 5, 6), (1, 150, 240)]
    x = spark.createDataFrame([("m", 3, "a"), ("m", 1, "b"), ("n", 1, "c")], "g string, at int, v string")
    y = spark.createDataFrame([("m", 7, "p"), ("m", 9, "q"), ("m", 11, "r")], "g string, at int, v string")
    assert sorted((r.place, r.v, r.other.v) for r in J.paired(x, y, ["g"], "at").collect()) == [(0, "b", "p"), (1, "a", "q")]
    z = spark.createDataFrame([(1, "p2", "t2"), (1, "p1", "t1"), (2, "no", "x")], "id int, path string, text string")
    ids = spark.createDataFrame([(1,), (2,)], "id int")
    assert sorted((r.id, r.path) for r in J.first_found(ids, z, "id", ["p1", "p2"]).collect()) == [(1, "p1"), (2, None)]


def test_overlap_totals_and_extensions(spark):
    x = spark.createDataFrame([(["a.py", "b.py"], ["b.py", "c.h"]), ([], []), (["a.py"], ["a.py"]), (["x"], [])], "g array<string>, p array<string>")
    r = A.overlap_totals(x, "g", "p").first()
    assert (r.evaluated, r.skipped) == (3, 1) and r.hit_rate == pytest.approx(2 / 3) and r.exact_rate == pytest.approx(1 / 3)
    assert r.macro_jaccard == pytest.approx((1 / 3 + 1) / 4) and r.micro_jaccard == pytest.approx(2 / 5)
    assert r.macro_precision == pytest.approx(1.5 / 4) and r.macro_recall == pytest.approx(1.5 / 4) and r.macro_f1 == pytest.approx(1.5 / 4)
    assert {(e.ext, e.n) for e in A.extension_counts(x, "g", "p").collect()} == {(".py", 3), (".h", 1), ("", 1)}


def test_references_of_tests(spark):
    e = spark.createDataFrame([("test_a.py", "m.py"), ("m.py", "n.py"), ("n.py", "o.py"), ("n.py", "m.py"), ("m.py", "test_b.py"), ("test_b.py", "z.py")], "file string, uses string")
    t = spark.createDataFrame([("test_a.py",), ("test_b.py",)], "test string")
    got = {(r.test, r.file, r.depth) for r in G.referenced_files(e, t, 2).collect()}
    assert got == {("test_a.py", "test_a.py", 0), ("test_a.py", "m.py", 1), ("test_a.py", "n.py", 2), ("test_b.py", "test_b.py", 0), ("test_b.py", "z.py", 1)}
    long = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(30)], "caller string, callee string")
    assert G.reachable(long, spark.createDataFrame([("n000",)], "node string")).count() == 31


def test_costs_are_exact(spark):
    from decimal import Decimal

    u = spark.createDataFrame([("m", 1_000_000, 0, 0, 400_000, 10)], "model string, input long, cache_write long, cache_write_hour long, cache_read long, output long")
    p = spark.createDataFrame([("real", *(Decimal(x) for x in ("3", "3.75", "6", "0.3", "15")))], "model string, base_in decimal(12,6), write_5m decimal(12,6), write_1h decimal(12,6), hit decimal(12,6), out decimal(12,6)")
    assert A.priced(u, p, "model", {"m": "real"}).first()["total_cost"] == Decimal("1.92015")


def test_curation(spark):
    pulls = spark.createDataFrame([(1, "pandas", "PERF x", None, "2020"), (2, "pandas", "perf: y", "b", "2020"), (3, "dask", "Avoid copies", "b", "2020"), (4, "other", "speedup", "", None), (5, "other", "docs", "<!-- fast -->", "2020")], "number int, repo string, title string, body string, merged_at string").withColumn("labels", F.array().cast("array<struct<name:string>>"))
    assert sorted(r.number for r in curation.performance_pulls(pulls, curation.rules(spark)).collect()) == [1, 2, 3]
    d = spark.createDataFrame([(1, "diff --git a/a.md b/a.md\n"), (2, "diff --git a/a.md b/a.md\ndiff --git a/b.py b/b.py\n"), (3, "diff --git a/b.py b/b.py\ndiff --git a/p.lock b/p.lock\n")], "id int, patch string")
    assert [r.id for r in curation.code_changes(d).collect()] == [2]
    runs = spark.createDataFrame([("a", r, 10.0, 5.0, 1.0) for r in range(3)] + [("b", r, 10.0, 9.9, 1.0) for r in range(3)] + [("c", 0, 10.0, 5.0, 1.0)], "id string, run int, before double, after double, after_sd double")
    assert [r.id for r in curation.passed_gates(runs, "id", 3).collect()] == ["a"]


def test_running_totals_and_quantiles_are_exact(spark):
    x = spark.range(1000).selectExpr("cast((id * 7919) % 1009 as double) x", "id % 5 n")
    rows = sorted((r.x, r.n) for r in x.collect())
    want, total = {}, 0
    for v, n in rows:
        total += n
        want[v] = total
    assert {r.x: r.n for r in O.running_totals(x, "x", ["n"]).collect()} == want
    y = spark.createDataFrame([(v,) for v in [1.0, 2.0, 2.0, 5.0, 9.0, None]], "y double")
    assert O.quantiles(y, "y", [0.0, 0.15, 0.5, 1.0]).first()[0] == pytest.approx([1.0, 1.6, 2.0, 9.0])
    assert O.quantiles(y.limit(0), "y", [0.5]).first()[0] == []
