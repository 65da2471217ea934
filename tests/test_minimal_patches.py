"""Minimal patches are made within their rows."""

from __future__ import annotations

from perfloom.operators import ordered as O


def test_patches_are_read_without_a_shuffle(spark):
    rows = spark.createDataFrame([(1, "--- a/f\n+++ b/f\n@@ -1,1 +1,1 @@\n-x\n+y")], "id int, patch string")
    assert "Exchange" not in O.minimal_patches(rows, "id")._jdf.queryExecution().executedPlan().toString()


def test_hunks_shift_by_all_before_them_in_their_file(spark):
    hunks = "".join(f"@@ -{10 * i},2 +{10 * i},3 @@\n c\n+n \t \n c\n" for i in range(1, 300))
    want = "\n".join(f"@@ -{10 * i + 1},1 +{10 * i + i},2 @@\n+n \t\n c" for i in range(1, 300))
    heads = lambda x: f"--- a/{x}\n+++ b/{x}\n"
    rows = spark.createDataFrame([(1, heads("f") + hunks + heads("g") + hunks), (2, "+z\n" + heads("h") + "@@ -1,1 +1,1 @@\n\r--- a/k\n-u\n+v\n\n")], "id int, patch string")
    got = {r.id: r.patch for r in O.minimal_patches(rows, "id").collect()}
    assert got == {1: heads("f") + want + "\n" + heads("g") + want, 2: heads("h") + "@@ -2,1 +2,1 @@\n-u\n+v"}
