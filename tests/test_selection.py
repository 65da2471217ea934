import pytest
from pyspark.sql import functions as F

from perfloom.functions import code as C
from perfloom.plans import selection as P


def test_code_functions(spark):
    a, b, c = "x = 1\n", "# c\ny = 'z'\n", "x = 1\nx = 2\n"
    df = spark.createDataFrame([(a, b), (a, c), (a, "def (")], "a string, b string")
    assert [r[0] for r in df.select(C.facts(F.col("a"))["shape"] == C.facts(F.col("b"))["shape"]).collect()] == [True, False, None]
    src = "import os\n\n__all__ = ['f']\ndef f(\n    a,\n):\n    return a\nx = 1\n"
    assert C.facts_of(src)["passive"] == [1, 2, 3, 4, 5, 6, 9]
    bad = "import sys as s, inspect\nfrom traceback import walk_stack as w\nw(s._getframe().f_back)\ns.settrace(1)  # stackguard: allow\n__import__('inspect')\n"
    got = spark.createDataFrame([(bad,)], "s string").select(F.explode(C.facts(F.col("s"))["findings"])).select("col.*").collect()
    assert [(r.line, r.kind, r.qual) for r in got] == [(1, "IMPORT", "inspect"), (2, "IMPORT", "traceback"), (3, "CALL", "traceback.walk_stack"), (3, "ATTR", ".f_back"), (3, "CALL", "sys._getframe"), (5, "DYNIMPORT", "inspect")]


def test_cache_warnings():
    src = "import functools\n@functools.lru_cache(3)\ndef f(a):\n    return a\nmy_cache = {}\nstore: list = list()\nmemo['a'] += 1\nrows = []\n"
    assert C.facts_of(src)["caches"] == ["function f is memoised", "memo is updated", "my_cache is a container", "store is a container"]


def test_selection(spark):
    inst = spark.createDataFrame([("a", ""), ("b", "tests"), ("c", None)], "instance_id string, test_patch string")
    pred = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "")], "instance_id string, model_patch string")
    ids = lambda df: sorted(r.instance_id for r in df.collect())
    assert ids(P.runnable(inst, pred)) == ["a", "c"] and ids(P.runnable(inst, pred, True)) == ["a", "b", "c"]
    assert ids(P.to_run(pred, inst, inst.where("instance_id = 'a'"))) == ["b"] and ids(P.by_id(inst, "[ab]")) == ["a", "b"]
    with pytest.raises(ValueError, match="unknown instances: c"):
        P.to_run(pred, inst.where("instance_id <> 'c'"), inst.limit(0))
    t = spark.sql("select array(struct('x' action, 'agent' source), struct(null action, 'agent' source), struct('x' action, 'user' source)) h")
    assert t.select(P.agent_steps(F.col("h"))).first()[0] == 1
    rows = spark.createDataFrame([(1, 0.5, 1), (2, None, 0), (3, None, 2), (4, 0.0, None)], "id int, j double, d int")
    assert [r.id for r in P.by_overlap_and_depth(rows, "j", "d", "id").collect()] == [3, 2, 4, 1]
