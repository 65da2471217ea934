from perfloom.functions import diffs as D

PATCH = """diff --git a/x b/x
--- a/x
+++ b/x
@@ -1,3 +5,4 @@ head
-gone first
 a
-gone
-again
+new
+++ later
 b
-last
\\ No newline at end of file
diff --git a/y b/y
--- a/y
+++ b/y
@@ -9 +9 @@
-only
@@ -3,1 +3,1 @@
 c
-d
 e"""


def test_diffs_are_read_within_their_rows(spark):
    df = spark.createDataFrame([(1, PATCH), (2, None), (3, "no diff"), (4, "@@ -1 +7 @@\n-z")], "id int, patch string")
    rows = D.diff_lines(df, "id")
    got = sorted((r.id, r.file, r.hunk, r.pos, r.kind, r.line_no, r.text) for r in rows.where("id = 1").collect())
    want = [("x", 1, 4, "-", 4, "gone first"), ("x", 1, 5, " ", 5, "a"), ("x", 1, 6, "-", 5, "gone"), ("x", 1, 7, "-", 5, "again"), ("x", 1, 8, "+", 6, "new")]
    want += [("later", 1, 10, " ", 7, "b"), ("later", 1, 11, "-", 7, "last"), ("y", 2, 17, "-", 8, "only"), ("y", 3, 19, " ", 3, "c"), ("y", 3, 20, "-", 3, "d"), ("y", 3, 21, " ", 4, "e")]
    assert got == sorted((1, *w) for w in want)
    near = {(r.id, r.pos): (r.before, r.after) for r in D.surviving_neighbours(rows, "id").collect()}
    assert near == {(1, 4): (None, 5), (1, 6): (5, 6), (1, 7): (5, 6), (1, 11): (7, None), (1, 17): (None, None), (1, 20): (3, 4), (4, 1): (None, None)}
    assert "Exchange" not in D.surviving_neighbours(D.diff_lines(df, "id"), "id")._jdf.queryExecution().executedPlan().toString()
