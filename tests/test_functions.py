from pyspark.sql import functions as F

from perfloom.functions import diffs as D
from perfloom.functions import logs as L
from perfloom.functions import numbers as N
from perfloom.functions import text as T


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


def test_summary_and_workload(spark):
    text = "Before Mean: 2.0\nBefore SD: 0.1\nAfter Mean: 1.0\nAfter SD: x\nImprovement: -50%"
    assert [one(spark, text, _line(i)) for i in (1, 3, 4)] == [2.0, 1.0, None]
    out = "Mean: 9\nPERF_START:\n+ echo Mean: 7\nMean: 1.5\nStd Dev: 0.25\nMean: 3\nPERF_END:\n"
    assert tuple(one(spark, out, T.workload_numbers)) == (1.5, 0.25)
    assert tuple(one(spark, "Mean: 1", T.workload_numbers)) == (None, None)


def _line(i):
    return lambda x: T.summary_value(x, i)


def test_lines_and_diffs(spark):
    assert one(spark, "a\nb\n", T.lines) == ["a", "b"] and one(spark, "", T.lines) == []
    patch = "diff --git a/x/old.py b/x/new.py\n--- a/x/old.py\n+++ b/x/new.py\n@@ -1,3 +1,3 @@ def f():\n a\n-b\n+c\n+def g():\n"
    assert one(spark, patch, D.changed_lines) == 3 and one(spark, patch, D.total_lines) == 8
    assert one(spark, patch, D.files) == ["x/new.py"] and one(spark, patch, D.old_files) == ["x/old.py"]
    assert sorted(one(spark, patch, D.functions)) == ["f", "g"]
    assert one(spark, None, D.changed_lines) == 0
    rows = D.diff_lines(spark.createDataFrame([(1, patch)], "id int, patch string"), "id").orderBy("pos").collect()
    assert [(r.kind, r.line_no) for r in rows][:4] == [(" ", 1), ("-", 1), ("+", 2), ("+", 3)]


def test_keywords_and_comments(spark):
    assert not one(spark, "<!-- faster -->nothing", T.about_performance)
    assert one(spark, "PERF: x", T.about_performance) and one(spark, "it is Faster", T.about_performance)
    assert not one(spark, None, T.about_performance)
    assert one(spark, "Fixes #12, closes #13 <!-- fixes #9 --> see #4, prefixes #5, fix: #6", T.issue_references) == ["12", "13"]


def test_small_texts(spark):
    assert tuple(one(spark, "scikit-learn__scikit-learn-123", T.id_parts)) == ("scikit-learn", "scikit-learn", "123")
    assert one(spark, "0-3,8", T.cpu_list) == [0, 1, 2, 3, 8]
    assert one(spark, "1.2.3rc1", T.major_minor) == "1.2"
    assert str(one(spark, "January 5, 2020", T.release_date)) == "2020-01-05" and one(spark, "soon", T.release_date) is None
    assert one(spark, "a\n```python\nx\n```\n```suggestion\ny\n```", T.code_blocks) == ["x\n"]
    assert one(spark, "1577836800000", T.iso_from_millis) == "2020-01-01T00:00:00Z" and one(spark, "x", T.iso_from_millis) == "x"
    assert one(spark, "a/b/c.py", T.module_names) == ["a.b.c", "b.c", "c"]
    assert one(spark, 0.25, lambda x: N.bucket_right(x, [0, 0.25, 0.5]), "double") == 0


def parsed(spark, format, log):
    return {r.test: r.status for r in L.parse(spark.createDataFrame([(1, log)], "id int, log string"), "id", format).collect()}


def test_log_formats(spark):
    assert parsed(spark, "pytest", "PASSED a/t.py::a\nFAILED a/t.py::b - boom\nPASSED t.py::c[x[1]-y z] extra\nPASSED\nother\nFAILED a/t.py::a") == {"a/t.py::a": "FAILED", "a/t.py::b": "FAILED", "t.py::c[x[1]-y z]": "PASSED"}
    assert parsed(spark, "pytest_options", "PASSED t.py::d[/tmp/abc/f.txt]\nPASSED t.py::e[//x]") == {"t.py::d[/f.txt]": "PASSED", "t.py::e[//x]": "PASSED"}
    assert parsed(spark, "pytest_v2", "\x1b[32mPASSED t.py::a\x1b[0m\nt.py::e PASSED") == {"t.py::a": "PASSED", "t.py::e": "PASSED"}
    assert parsed(spark, "seaborn", "FAILED t::a\nt::b PASSED [ 1%]\nPASSED t::c") == {"t::a": "FAILED", "t::b": "PASSED", "t::c": "PASSED"}
    assert parsed(spark, "matplotlib", "PASSED t[MouseButton.LEFT]") == {"t[1]": "PASSED"}
    assert parsed(spark, "django", "test_f (m.T) ... ok\ntest_g (m.T) ... noise\nok\nERROR: test_h (m.T)\ntest_i (m.T) ... skipped 'x'") == {"test_f (m.T)": "PASSED", "test_g (m.T)": "PASSED", "test_h": "ERROR", "test_i (m.T)": "SKIPPED"}
    assert parsed(spark, "sympy", "____ a/b.py:test_j ____\ntest_h ok\ntest_i F") == {"a/b.py:test_j": "FAILED", "test_h": "PASSED", "test_i": "FAILED"}
    assert parsed(spark, "unique_prefix", "PASSED t::a[1]\nPASSED t::a[2]\nFAILED t::b[1]") == {"t::b": "FAILED"}


def test_grading(spark):
    rows = spark.createDataFrame([(s,) for s in ("PASSED", "XFAIL", "FAILED", "ERROR", "SKIPPED", None)], "s string").select(L.passes(F.col("s")), L.fails(F.col("s"))).collect()
    assert [tuple(r) for r in rows] == [(True, False), (True, False), (False, True), (False, True), (False, False), (False, True)]
    assert one(spark, ">>>>> Applied Patch (pred)\nrest", L.usable_part) == "\nrest" and one(spark, "nothing", L.usable_part) is None
