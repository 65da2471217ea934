"""Queries for what reads records: log formats, filters, diffs, texts, sources and sinks, each with its SQL.

Records are made from the test tables by rules that the SQL knows too: logs from documents' lines, pulls and patches from
orders. Files are staged in the shared checkpoint folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perfloom.functions import code as C
from perfloom.functions import diffs as D
from perfloom.functions import logs as L
from perfloom.functions import numbers as N
from perfloom.functions import text as T
from perfloom.operators import aggregates as A
from perfloom.operators import graph as G
from perfloom.operators import joins as J
from perfloom.operators import ordered as O
from perfloom.plans import curation, selection
from perfloom.plans.catalog import _round, query
from perfloom.sources import readers as R
from perfloom.sources import sinks as K
from perfloom.sources.readers import table

# ------------------------------------------------------------------ logs

_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)),1) AS pos FROM documents), r AS (SELECT doc_id, pos, length(x) AS n, length(x)%3 AS k, string_split(x,' ')[1] AS w FROM l WHERE regexp_matches(x, '^[A-Za-z]+ '))"
_STATUS = "CASE k WHEN 0 THEN 'PASSED' WHEN 1 THEN 'FAILED' ELSE 'ERROR' END"


def _logs(spark: SparkSession, d: str, line, head: str = "") -> DataFrame:
    """A log for each document: `line(word, kind)` for each of its lines that begin with a word, kind from 0 to 2."""
    one = lambda x: F.when(x.rlike("^[A-Za-z]+ "), line(F.split(x, " ")[0], F.length(x) % 3)).otherwise(F.lit("# other"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.concat(F.lit(head), F.array_join(F.transform(F.split("text", "\n"), one), "\n")).alias("log"))


def _status(k: Column) -> Column:
    return F.when(k == 0, "PASSED").when(k == 1, "FAILED").otherwise("ERROR")


def _by_kind(k: Column, a: Column, b: Column, c: Column) -> Column:
    return F.when(k == 0, a).when(k == 1, b).otherwise(c)


def _found(test: str, status: str = _STATUS) -> str:
    return f"WITH {_LINES} SELECT doc_id, {test} AS test, arg_max({status}, pos) AS status FROM r GROUP BY 1,2"


@query(_found("'m::' || w || '[/' || w || ']'"))
def log_pytest_options(spark, d):
    return L.parse(_logs(spark, d, lambda w, k: F.concat(_status(k), F.lit(" m::"), w, F.lit("[/a/b/"), w, F.lit("]"))), "doc_id", "pytest_options")


@query(_found("'m::' || w"))
def log_pytest_v2(spark, d):
    line = lambda w, k: _by_kind(k, F.concat(F.lit("PASSED m::"), w), F.concat(F.lit("\u001b[31mFAILED\u001b[0m m::"), w), F.concat(F.lit("m::"), w, F.lit(" ERROR")))
    return L.parse(_logs(spark, d, line), "doc_id", "pytest_v2")


@query(_found("w", "CASE k WHEN 1 THEN 'FAILED' ELSE 'PASSED' END"))
def log_seaborn(spark, d):
    line = lambda w, k: _by_kind(k, F.concat(w, F.lit(" PASSED [ 10%]")), F.concat(F.lit("FAILED "), w, F.lit(" - why")), F.concat(F.lit("PASSED "), w))
    return L.parse(_logs(spark, d, line), "doc_id", "seaborn")


@query(_found("'t[1-' || w || ']'"))
def log_matplotlib(spark, d):
    return L.parse(_logs(spark, d, lambda w, k: F.concat(_status(k), F.lit(" t[MouseButton.LEFT-"), w, F.lit("]"))), "doc_id", "matplotlib")


@query(_found("'m::' || w"))
def log_pydantic(spark, d):
    line = lambda w, k: _by_kind(k, F.concat(F.lit("\u001b[32mPASSED m::"), w), F.concat(F.lit("FAILED [ 10%] m::"), w), F.concat(F.lit("m::"), w, F.lit(" \u001b[31mERROR")))
    return L.parse(_logs(spark, d, line), "doc_id", "pydantic")


@query(f"WITH {_LINES}, t AS (SELECT doc_id, w, k, arg_max({_STATUS}, pos) AS status FROM r GROUP BY 1,2,3) SELECT doc_id, w AS test, max(status) AS status FROM t GROUP BY 1,2 HAVING count(*)=1")
def log_unique_prefixes(spark, d):
    return L.parse(_logs(spark, d, lambda w, k: F.concat(_status(k), F.lit(" "), w, F.lit("["), k, F.lit("]"))), "doc_id", "unique_prefix")


@query(_found("CASE k WHEN 0 THEN w || ' (mod.T)' ELSE w END", "CASE k WHEN 0 THEN 'PASSED' WHEN 1 THEN 'FAILED' ELSE 'SKIPPED' END"))
def log_django(spark, d):
    line = lambda w, k: _by_kind(k, F.concat(w, F.lit(" (mod.T) ... ok")), F.concat(w, F.lit(" ... FAIL")), F.concat(w, F.lit(" ... skipped 'x'")))
    return L.parse(_logs(spark, d, line), "doc_id", "django")


@query(_found("'sympy/' || w || '.py'"))
def log_sympy(spark, d):
    return L.parse(_logs(spark, d, lambda w, k: F.concat(F.lit("sympy/"), w, F.lit(".py "), _status(k), F.lit(" 0.1")), "pytest run\n"), "doc_id", "sympy")


@query("SELECT doc_id, CASE doc_id%3 WHEN 0 THEN 'PASSED' WHEN 1 THEN 'FAILED' ELSE 'ERROR' END AS status, 'test_' || doc_id AS test FROM documents")
def log_sympy_endings(spark, d):
    ending = F.when(F.col("doc_id") % 3 == 0, " ok [OK]").when(F.col("doc_id") % 3 == 1, " F").otherwise(" E")
    logs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("start\ntest_"), "doc_id", ending, F.lit("\nend")).alias("log"))
    return L.parse(logs, "doc_id", "sympy")


@query("SELECT doc_id, CASE doc_id%3 WHEN 0 THEN 't' ELSE 'm::t' || doc_id END AS test, CASE doc_id%2 WHEN 0 THEN 'PASSED' ELSE 'FAILED' END AS status FROM documents WHERE doc_id%3<>0 UNION ALL SELECT doc_id, 't (mod.C)', 'PASSED' FROM documents WHERE doc_id%3=0")
def log_dispatch(spark, d):
    k = F.col("doc_id")
    plain = F.concat(F.when(k % 2 == 0, "PASSED").otherwise("FAILED"), F.lit(" m::t"), k)
    rows = table(spark, d, "documents").select(k, F.when(k % 3 == 0, "Django").when(k % 3 == 1, "pandas").otherwise("dask").alias("repo"), F.when(k % 3 == 0, "t (mod.C) ... ok").otherwise(plain).alias("log"))
    return L.parse_all(rows, "doc_id", "repo")


@query("SELECT doc_id, CASE WHEN doc_id%3=0 THEN NULL ELSE md5(chr(10) || text) END AS part FROM documents WHERE text IS NOT NULL")
def log_gate(spark, d):
    head = F.when(F.col("doc_id") % 6 == 0, ">>>>> Tests Errored\n").when(F.col("doc_id") % 6 == 3, "nothing").otherwise("early\n")
    mark = F.when(F.col("doc_id") % 6 == 3, "").otherwise(">>>>> Applied Patch (pred)")
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.md5(L.usable_part(F.concat(head, mark, F.lit("\n"), F.when(F.col("doc_id") % 6 == 3, "").otherwise(F.col("text"))))).alias("part"))


@query("SELECT o_orderkey, CASE o_orderkey%5 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' WHEN 2 THEN 'FAIL' WHEN 3 THEN 'SKIP' END AS reported, o_orderkey%5=0 AS passes, o_orderkey%5 IN (1,2) OR o_orderkey%5=4 AS fails FROM orders")
def status_policies(spark, d):
    k = F.col("o_orderkey") % 5
    status = F.when(k == 0, "PASSED").when(k == 1, "FAILED").when(k == 2, "ERROR").when(k == 3, "SKIPPED")
    return table(spark, d, "orders").select("o_orderkey", L.reported(status).alias("reported"), L.passes(status).alias("passes"), L.fails(status).alias("fails"))


@query("SELECT o_orderkey, o_orderkey%2=0 AS broken, o_orderkey%3=0 AS counts, 'a.py ' || o_orderkey AS report, o_orderkey::DOUBLE + 0.5 AS seconds FROM orders")
def log_flags(spark, d):
    k = F.col("o_orderkey")
    log = F.concat(F.when(k % 2 == 0, "x\nE   AttributeError: no\n").otherwise("fine\n"), F.lit("BEGIN\n+ trace\n"), F.when(k % 3 == 0, "edit is MEANINGFUL\n").otherwise("edit is nothing\n"), F.lit("END\nCOV\n+ run\na.py "), k, F.lit("\nVOC\nWall time: "), k, F.lit(".5 s"))
    between = F.array_join(L.lines_between(log, "COV", "VOC"), " ")
    return table(spark, d, "orders").select(k, L.imports_broken(log).alias("broken"), L.edit_counts(log, "BEGIN", "END").alias("counts"), between.alias("report"), T.wall_seconds(log).alias("seconds"))


# ------------------------------------------------------------------ filters


def _pulls(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        k.alias("number"),
        F.when(k % 7 != 0, "2020-01-01").alias("merged_at"),
        F.when(k % 4 == 0, "pandas").when(k % 4 == 1, "dask").when(k % 4 == 2, "numpy").otherwise("none").alias("repo"),
        F.element_at(F.array(*[F.lit(x) for x in ("PERF: x", "Avoid copies", "docs", "perf y", "speed up z")]), (k % 5 + 1).cast("int")).alias("title"),
        F.lit("text <!-- faster -->").alias("body"),
        F.when(k % 6 == 0, F.array(F.struct(F.lit("Performance 2").alias("name")))).otherwise(F.array().cast("array<struct<name:string>>")).alias("labels"),
        F.when(k % 5 == 1, "").when(k % 5 == 2, F.lit(None)).otherwise("diff").alias("patch"),
        F.when(k % 3 == 0, " \n ").otherwise("diff").alias("test_patch"),
    )


@query("SELECT o_orderkey AS number FROM orders WHERE o_orderkey%7<>0 AND o_orderkey%5 NOT IN (1,2) AND o_orderkey%3<>0")
def merged_candidates(spark, d):
    return curation.candidates(_pulls(spark, d), tests=True).select("number")


@query("SELECT o_orderkey AS number FROM orders WHERE o_orderkey%7<>0 AND (o_orderkey%5 IN (0,4) OR (o_orderkey%4=0 AND (o_orderkey%6=0 OR o_orderkey%5=3)) OR (o_orderkey%4=1 AND o_orderkey%5 IN (1,3)) OR (o_orderkey%4=2 AND o_orderkey%5=3))")
def performance_pulls(spark, d):
    return curation.performance_pulls(_pulls(spark, d), curation.rules(spark)).select("number")


@query("SELECT o_orderkey AS number, o_orderkey%6=0 AS labelled, o_orderkey%5=4 AS mentioned FROM orders")
def label_and_words(spark, d):
    return _pulls(spark, d).select("number", T.label_contains(F.col("labels"), ["performance"]).alias("labelled"), T.mentions(F.col("title")).alias("mentioned"))


def _patch(k: Column) -> Column:
    """A diff of m<k>.py and, by k, of a document, a lock file or a test."""
    part = lambda f, body: F.concat(F.lit("diff --git a/"), f, F.lit(" b/"), f, F.lit("\nindex 1..2 100644\n--- a/"), f, F.lit("\n+++ b/"), f, F.lit("\n@@ -3,4 +3,5 @@ def head\n"), body)
    body = F.concat(F.lit(" a\n b\n-old "), k, F.lit("\n+new\n+def f"), k, F.lit("(x):\n c\n"))
    main = F.when(k % 4 == 0, part(F.lit("doc/x.md"), body)).otherwise(part(F.concat(F.lit("src/m"), k, F.lit(".py")), body))
    more = F.when(k % 4 == 2, part(F.lit("poetry.lock"), F.lit("-1\n+2\n"))).when(k % 4 == 3, part(F.lit("pkg/tests/test_m.py"), F.lit("-1\n+2\n"))).otherwise("")
    return F.concat(main, more)


def _patches(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", _patch(F.col("o_orderkey")).alias("patch"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey%4 IN (1,3)")
def code_changes(spark, d):
    return curation.code_changes(_patches(spark, d)).select("o_orderkey")


_MAIN = "CASE WHEN o_orderkey%4=0 THEN 'doc/x.md' ELSE 'src/m' || o_orderkey || '.py' END"
_MORE = "CASE o_orderkey%4 WHEN 2 THEN ' poetry.lock' WHEN 3 THEN ' pkg/tests/test_m.py' ELSE '' END"


@query(f"SELECT o_orderkey, {_MAIN} || {_MORE} AS files, {_MAIN} || {_MORE} AS old, CASE WHEN o_orderkey%4=0 THEN 'doc/x.md' ELSE 'src/m' || o_orderkey || '.py' END || CASE o_orderkey%4 WHEN 2 THEN ' poetry.lock' WHEN 3 THEN ' tests/test_m.py' ELSE '' END AS tails, CASE o_orderkey%4 WHEN 0 THEN '' WHEN 3 THEN 'src/m' || o_orderkey || '.py pkg/tests/test_m.py' ELSE 'src/m' || o_orderkey || '.py' END AS sources, 'head f' || o_orderkey AS functions, 3 + CASE WHEN o_orderkey%4>=2 THEN 2 ELSE 0 END AS changed FROM orders")
def patch_files(spark, d):
    p, text = F.col("patch"), lambda x: F.array_join(x, " ")
    return _patches(spark, d).select("o_orderkey", text(D.files(p)).alias("files"), text(D.old_files(p)).alias("old"), text(D.tails(D.all_files(p))).alias("tails"), text(D.source_files(p)).alias("sources"), text(D.functions(p)).alias("functions"), D.changed_lines(p).alias("changed"))


@query(f"SELECT o_orderkey, {_MAIN} AS source, 1 AS n FROM orders UNION ALL SELECT o_orderkey, trim({_MORE}), 1 FROM orders WHERE o_orderkey%4>=2")
def file_parts(spark, d):
    return D.file_diffs(_patches(spark, d)).where("dest = source").groupBy("o_orderkey", "source").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_orderkey%4=3 AS has_tests, CASE WHEN o_orderkey%4=2 THEN 2 ELSE 1 END AS fix_files, CASE o_orderkey%4 WHEN 3 THEN 'pkg.tests.test_m' ELSE '' END AS targets FROM orders")
def tests_apart(spark, d):
    s = D.split_tests(_patches(spark, d), "o_orderkey")
    return s.select("o_orderkey", (F.col("test_patch") != "").alias("has_tests"), F.size(D.files(F.col("fix_patch"))).alias("fix_files"), F.array_join(D.test_targets(F.col("test_patch"), True), " ").alias("targets"))


@query(f"SELECT o_orderkey, '--- a/' || {_MAIN} || chr(10) || '+++ b/' || {_MAIN} || chr(10) || '@@ -5,2 +5,3 @@' || chr(10) || '-old ' || o_orderkey || chr(10) || '+new' || chr(10) || '+def f' || o_orderkey || '(x):' || chr(10) || ' c' || CASE WHEN o_orderkey%4>=2 THEN chr(10) || '--- a/' || trim({_MORE}) || chr(10) || '+++ b/' || trim({_MORE}) || chr(10) || '@@ -3,1 +3,1 @@' || chr(10) || '-1' || chr(10) || '+2' ELSE '' END AS patch FROM orders")
def minimal_patch(spark, d):
    return O.minimal_patches(_patches(spark, d), "o_orderkey")


@query("SELECT o_orderkey, 4 AS before, 7 AS after FROM orders")
def removed_neighbours(spark, d):
    rows = D.surviving_neighbours(D.diff_lines(_patches(spark, d), "o_orderkey"), "o_orderkey")
    return rows.where("hunk = 1").select("o_orderkey", F.col("before"), (F.col("after") + 2).alias("after"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, (10*l_linenumber + coalesce(sum(l_suppkey - l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0))::BIGINT AS new_start FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1,2))")
def hunk_shifts(spark, d):
    h = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("old_count"), F.min("l_suppkey").alias("new_count"))
    h = D.renumbered(h.withColumn("file", F.lit("f")).withColumn("old_start", 10 * F.col("l_linenumber")), "l_orderkey")
    return h.select("l_orderkey", "l_linenumber", F.col("old_count").alias("l_partkey"), "new_start")


@query("WITH t AS (SELECT o_orderkey, o_orderkey%3 AS repo, o_orderdate::DATE AS day FROM orders), r AS (SELECT l_orderkey%3 AS repo, l_shipdate::DATE AS day, max(l_orderkey) AS version FROM lineitem GROUP BY 1,2) SELECT o_orderkey, version::VARCHAR AS version FROM t ASOF JOIN r ON t.repo=r.repo AND t.day>r.day")
def versioned_tasks(spark, d):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    tasks = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 3).alias("repo"), F.concat(day("o_orderdate"), F.lit("T00:00:00Z")).alias("created_at"))
    releases = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 3).alias("repo"), day("l_shipdate").alias("release_date")).agg(F.max("l_orderkey").cast("string").alias("version"))
    return curation.versioned(tasks, releases).select("o_orderkey", "version")


@query("SELECT o_orderkey::VARCHAR AS instance_id FROM orders WHERE o_orderkey%2=0 AND o_orderkey%3=0 AND o_orderkey%5<>0 AND regexp_matches(o_orderkey::VARCHAR, '[1-4]')")
def runnable_instances(spark, d):
    k = F.col("o_orderkey")
    i = table(spark, d, "orders").select(k.cast("string").alias("instance_id"), F.when(k % 3 == 0, " nan ").otherwise("diff").alias("test_patch"))
    p = table(spark, d, "orders").where(k % 2 == 0).select(k.cast("string").alias("instance_id"), F.when(k % 5 == 0, "").otherwise("x").alias("model_patch"))
    done = i.where(F.lit(False))
    return selection.by_id(selection.runnable(i, selection.to_run(p, i, done)), "[1-4]").select("instance_id")


@query("SELECT p_partkey, p_partkey%4 IN (0,1) AS is_test FROM part")
def test_file_names(spark, d):
    k = F.col("p_partkey")
    path = F.concat(F.lit("test/sub/"), F.when(k % 4 == 0, "Test_x.py").when(k % 4 == 1, "x_test.py").when(k % 4 == 2, "latest.py").otherwise("test_x.txt"))
    return table(spark, d, "part").select(k, T.is_test_file(path).alias("is_test"))


@query("SELECT p_partkey, p_partkey%4=1 AS single_thread FROM part WHERE p_partkey%4<>0")
def usable_tests(spark, d):
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, "a/b.py::test_dropna_x").when(k % 4 == 1, "pandas/tests/io/x.py::test_y").otherwise("a/b.py::test_z")
    return curation.usable_tests(table(spark, d, "part").select(k, name.alias("test"))).select("p_partkey", "single_thread")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey%3<>0")
def not_ignored(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, "numpy__numpy-23088").otherwise(F.concat(F.lit("a__b-"), "s_suppkey")).alias("instance_id"))
    return curation.without_ignored(s).select("s_suppkey")


@query("SELECT conv_id, count(*) FILTER (role='assistant' AND turn%3<>0) AS steps FROM conversations GROUP BY 1")
def agent_steps(spark, d):
    h = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.when(F.col("turn") % 3 != 0, "run").alias("action"), F.when(F.col("role") == "assistant", "agent").otherwise("user").alias("source"))).alias("history"))
    return h.select("conv_id", selection.agent_steps(F.col("history")).cast("long").alias("steps"))


@query("WITH s AS (SELECT o_orderkey AS instance_id, o_totalprice/100000 AS raw, o_custkey%7 AS human, (o_orderstatus<>'F')::INT AS ok FROM orders) SELECT instance_id FROM s WHERE ok=1 AND raw>=1 ORDER BY human DESC, instance_id LIMIT 20")
def best_successes(spark, d):
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("instance_id"), (F.col("o_totalprice") / 100000).alias("raw_pred_speedup_ratio"), (F.col("o_custkey") % 7).alias("human_speedup_ratio"), (F.col("o_orderstatus") != "F").cast("int").alias("correctness"))
    return selection.successes(s).select("instance_id").limit(20)


@query("SELECT c_custkey FROM customer ORDER BY CASE WHEN c_acctbal<0 THEN 0 ELSE c_acctbal END, CASE WHEN c_nationkey%5=0 THEN 1e308*10 ELSE c_nationkey%5 END, c_custkey LIMIT 150")
def by_overlap_and_depth(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("j"), (F.col("c_nationkey") % 5).alias("depth"))
    return selection.by_overlap_and_depth(c, "j", "depth", "c_custkey").select("c_custkey").limit(150)


@query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS ids FROM orders")
def spread_order(spark, d):
    return selection.spread(table(spark, d, "orders"), "o_orderkey").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("ids"))


# ------------------------------------------------------------------ numbers and texts


@query("SELECT o_orderkey, 2.0::DOUBLE*o_orderkey AS before, CASE WHEN o_orderkey<>0 THEN -25.0::DOUBLE END AS improvement, 0.25::DOUBLE*o_orderkey AS mean, 0.5::DOUBLE AS sd FROM orders")
def workload_summaries(spark, d):
    k = F.col("o_orderkey")
    summary = F.concat(F.lit("Before Mean: "), 2.0 * k, F.lit("\nBefore SD: 0.1\nAfter Mean: "), 1.5 * k, F.lit("\nAfter SD: 0.1\n"))
    out = F.concat(F.lit("Mean: 7\nPERF_START:\n+ echo Mean: 9\nMean: "), 0.25 * k, F.lit("\nStd Dev: 0.5\nPERF_END:\n"))
    before, after = T.summary_value(summary, 1), T.summary_value(summary, 3)
    rows = table(spark, d, "orders").select(k, before.alias("before"), _round(N.improvement_percent(before, after), 6).alias("improvement"), T.workload_numbers(out).alias("w"))
    return rows.select("o_orderkey", "before", "improvement", "w.mean", "w.sd")


@query("SELECT s_suppkey, 'ok ' || s_suppkey AS plain, 'x' || chr(10) || '|mid' || chr(10) AS blocks, 'a ' || s_suppkey AS first, CASE WHEN s_suppkey%2=0 THEN s_suppkey::VARCHAR ELSE 'Unknown' END AS answer, 'a or b' || s_suppkey AS cases FROM supplier")
def fenced_and_coloured(spark, d):
    k = F.col("s_suppkey")
    md = F.concat(F.lit("text\n```python\nx\n```\n```suggestion\nno\n```\nmid\n```\ny\n```\n"))
    js = F.when(k % 2 == 0, F.concat(F.lit('so {"classification": "'), k, F.lit('"} end'))).otherwise("nothing")
    answer = T.json_answer(js, "struct<classification:string>", F.struct(F.lit("Unknown").alias("classification")))
    return table(spark, d, "supplier").select(
        k, T.without_colours(F.concat(F.lit("\u001b[1;31mok\u001b[0m "), k)).alias("plain"), F.array_join(T.code_blocks(md), "|").alias("blocks"), F.trim(F.regexp_replace(T.first_code_block(F.concat(F.lit("```\na "), k, F.lit("\n```"))), "\n", "")).alias("first"),
        answer["classification"].alias("answer"), T.case_names(F.concat(F.lit("[case a]\nq\n[case b"), k, F.lit("]"))).alias("cases"),
    )


@query("SELECT s_suppkey, s_suppkey || '.1.0' AS version, 'acme/en-gine' AS repo, 'a__b__c' AS folder, CASE WHEN s_suppkey%2=0 THEN 'Sonnet' ELSE 'other' END AS label, 'a.b.c b.c c' AS modules, 'numpy==1 torch' AS requirements, s_suppkey%2=0 AS truth FROM supplier")
def names_and_versions(spark, d):
    k = F.col("s_suppkey")
    source = F.concat(F.lit('"""version = "9.9.9" """\n__version__ = "'), k, F.lit('.1.0"\nversion = "0"'))
    req = T.requirement_lines(F.lit("numpy\n-e .\npytorch\n"), ["-e"], {"numpy": "numpy==1", "pytorch": "torch"})
    return table(spark, d, "supplier").select(
        k, T.version_in(source, [r'__version__ = "([^"]+)"', r'version = "([^"]+)"']).alias("version"), T.repo_of_log(F.concat(F.lit("logs/run/m/acme__en-gine-"), k, F.lit("/t.log"))).alias("repo"), T.model_folder(F.lit("a/b/c")).alias("folder"),
        T.starts_with_label(F.when(k % 2 == 0, "claude-sonnet").otherwise("other"), {"claude": "Sonnet"}).alias("label"), F.array_join(T.module_names(F.lit("a/b/c/__init__.py")), " ").alias("modules"),
        F.replace(req, F.lit("\n"), F.lit(" ")).alias("requirements"), T.truth(F.when(k % 2 == 0, "Yes").otherwise("0")).alias("truth"),
    )


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d 00:00:00') AS t FROM orders")
def tracker_times(spark, d):
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(k % 3 == 0, F.concat(day, F.lit("T00:00:00.000Z"))).when(k % 3 == 1, F.concat(day, F.lit("T02:00:00+02:00"))).otherwise(F.concat(day, F.lit(" 00:00:00")))
    return table(spark, d, "orders").select(k, F.date_format(T.tracker_time(text), "yyyy-MM-dd HH:mm:ss").alias("t"))


@query("SELECT s_suppkey, s_suppkey::VARCHAR AS whole, s_suppkey || '.3' AS one, CASE WHEN s_suppkey=0 THEN '0' ELSE s_suppkey || 'k' END AS thousands, s_suppkey || '.3%' AS percent, chr(8212) AS none FROM supplier")
def short_numbers(spark, d):
    k = F.col("s_suppkey").cast("double")
    return table(spark, d, "supplier").select("s_suppkey", N.short_number(k).alias("whole"), N.short_number(k + 0.3).alias("one"), N.short_number(k * 1000, thousands=True).alias("thousands"), N.short_number(k + 0.3, percent=True).alias("percent"), N.short_number(F.lit(None).cast("double")).alias("none"))


_SOURCE = "import os, inspect\n__all__ = []\n\n@lru_cache(3)\ndef f{k}(a,\n        b):\n    return a + {k}\nmy_cache = {{}}\n"


@query("SELECT s_suppkey, CASE WHEN s_suppkey%3=0 THEN NULL ELSE true END AS same, CASE WHEN s_suppkey%3=0 THEN NULL ELSE '1,2,3,5,6,9' END AS passive, CASE WHEN s_suppkey%3=0 THEN NULL ELSE 'IMPORT inspect' END AS found, CASE WHEN s_suppkey%3=0 THEN NULL ELSE 2 END AS verdict, CASE WHEN s_suppkey%3=0 THEN NULL ELSE 'function f' || s_suppkey || ' is memoised; my_cache is a container' END AS caches FROM supplier")
def source_trees(spark, d):
    k = F.col("s_suppkey")
    left, right = (F.format_string(_SOURCE.replace("{k}", "%d").replace("{{}}", "{}"), *[x.cast("long")] * 2) for x in (k, k + 1))
    bad = lambda x: F.when(k % 3 == 0, "def (").otherwise(x)
    rows = table(spark, d, "supplier").select(k, C.facts(bad(left)).alias("a"), C.facts(bad(right)).alias("b"))
    found = F.array_join(F.transform("a.findings", lambda x: F.concat(x["kind"], F.lit(" "), x["qual"])), ";").alias("found")
    return rows.select("s_suppkey", (F.col("a.shape") == F.col("b.shape")).alias("same"), F.array_join(F.transform("a.passive", lambda x: x.cast("string")), ",").alias("passive"), found, C.verdict(F.col("a.findings")).alias("verdict"), F.array_join("a.caches", "; ").alias("caches"))


# ------------------------------------------------------------------ aggregates, joins and sets


@query("WITH s AS (SELECT l_suppkey, l_partkey::VARCHAR AS t, CASE WHEN min(l_quantity)>10 THEN 'PASS' ELSE 'FAIL' END AS a, CASE WHEN max(l_quantity)>40 THEN 'PASS' ELSE 'FAIL' END AS b FROM lineitem GROUP BY 1,2) SELECT l_suppkey, md5(coalesce(string_agg(t, ',' ORDER BY t) FILTER (a='PASS' AND b='FAIL'),'')) AS broke, md5(coalesce(string_agg(t, ',' ORDER BY t) FILTER (a='FAIL' AND b='PASS'),'')) AS fixed FROM s GROUP BY 1")
def transition_lists(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_suppkey", F.col("l_partkey").cast("string").alias("t")).agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    s = s.select("l_suppkey", "t", F.when(F.col("lo") > 10, "PASS").otherwise("FAIL").alias("from"), F.when(F.col("hi") > 40, "PASS").otherwise("FAIL").alias("to"))
    return A.transition_lists(s, ["l_suppkey"], "t").select("l_suppkey", F.md5(F.array_join("pass_fail", ",")).alias("broke"), F.md5(F.array_join("fail_pass", ",")).alias("fixed"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1")
def grouped_lists(spark, d):
    g = A.grouped_lists(table(spark, d, "nation"), "n_regionkey", ["n_nationkey", "n_name"])
    return g.select("n_regionkey", F.array_join(F.transform("rows", lambda r: r["n_name"]), ",").alias("names"))


@query("WITH f AS (SELECT o_orderkey, CASE o_orderkey%4 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['a.py','b.c'] ELSE ['a.py'] END AS g, CASE o_orderkey%3 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['a.py'] ELSE ['b.c','Makefile'] END AS p FROM orders), m AS (SELECT *, len(list_intersect(g,p)) AS i, len(list_distinct(list_concat(g,p))) AS u FROM f) SELECT count(*) FILTER (u>0) AS evaluated, round(count(*) FILTER (i>0)/count(*) FILTER (u>0),6) AS hit_rate, round(count(*) FILTER (i=u AND u>0)/count(*) FILTER (u>0),6) AS exact_rate, round(sum(CASE WHEN u>0 THEN i/u END)/count(*),6) AS macro_jaccard, round(sum(CASE WHEN len(p)>0 THEN i/len(p) END)/count(*),6) AS macro_precision, round(sum(i)/sum(u),6) AS micro_jaccard FROM m")
def file_overlap_totals(spark, d):
    out = A.overlap_totals(_file_sets(spark, d), "g", "p")
    return out.select("evaluated", *[_round(c, 6).alias(c) for c in ("hit_rate", "exact_rate", "macro_jaccard", "macro_precision", "micro_jaccard")])


def _file_sets(spark, d):
    k, some = F.col("o_orderkey"), lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    return table(spark, d, "orders").select(k, F.when(k % 4 == 0, some()).when(k % 4 == 1, some("a.py", "b.c")).otherwise(some("a.py")).alias("g"), F.when(k % 3 == 0, some()).when(k % 3 == 1, some("a.py")).otherwise(some("b.c", "Makefile")).alias("p"))


@query("WITH f AS (SELECT CASE o_orderkey%4 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['a.py','b.c'] ELSE ['a.py'] END AS g, CASE o_orderkey%3 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['a.py'] ELSE ['b.c','Makefile'] END AS p FROM orders), x AS (SELECT unnest(list_distinct(list_concat(g,p))) AS f FROM f) SELECT CASE WHEN contains(f,'.') THEN '.' || string_split(f,'.')[2] ELSE '' END AS ext, count(*) AS n FROM x GROUP BY 1")
def extension_counts(spark, d):
    return A.extension_counts(_file_sets(spark, d), "g", "p")


@query("SELECT role AS model, kind, sum(n)::BIGINT AS n FROM (SELECT role, 'in' AS kind, length(text) AS n FROM conversations UNION ALL SELECT role, 'out', turn FROM conversations) GROUP BY 1,2")
def token_totals(spark, d):
    c = table(spark, d, "conversations").select(F.col("role").alias("model"), F.create_map(F.lit("in"), F.length("text").cast("long"), F.lit("out"), F.col("turn").cast("long")).alias("usage"))
    return A.token_totals(c, "usage", ["model"])


@query("SELECT l_suppkey, max(l_quantity) AS longest, bool_and(l_quantity<50) AS all_below FROM lineitem GROUP BY 1")
def slowest_runs(spark, d):
    return A.slowest_runs(table(spark, d, "lineitem"), "l_suppkey", "l_quantity", 50)


@query("WITH e AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders), r AS (SELECT o_orderkey, least(greatest(floor(20.0*(ln(o_totalprice)-ln(a))/(ln(b)-ln(a))),0),19)::INT AS bin FROM orders, e) SELECT bin, count(*) AS n, count(*) FILTER (o_orderkey%9=0) AS n_selected FROM r GROUP BY 1")
def log_histogram(spark, d):
    from perfloom.operators.sampling import binned

    return A.selected_histogram(binned(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "bin"), "bin", F.col("o_orderkey") % 9 == 0)


@query("WITH o AS (SELECT o_custkey AS k, o_orderkey AS id, o_orderstatus AS st, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS t FROM orders) SELECT p.id AS point FROM o p WHERE st='F' AND EXISTS (SELECT 1 FROM o s WHERE s.st<>'F' AND s.k=p.k AND s.t-30<=p.t AND p.t+5<=s.t+30)")
def contained_ranges(spark, d):
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("point"), "o_orderstatus", day.alias("t"))
    spans = o.where("o_orderstatus <> 'F'").selectExpr("k", "t - 30 s", "t + 30 e")
    return J.contained(o.where("o_orderstatus = 'F'").withColumn("u", F.col("t") + 5), spans, ["k"], ("t", "u"), ("s", "e")).select("point")


@query("WITH a AS (SELECT o_custkey AS c, o_orderkey AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)-1 AS place FROM orders WHERE o_orderstatus='F'), b AS (SELECT o_custkey AS c, o_orderkey AS y, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)-1 AS place FROM orders WHERE o_orderstatus<>'F') SELECT c, place, x, y FROM a JOIN b USING (c, place)")
def positional_pairs(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("x"), "o_orderstatus")
    p = J.paired(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'"), ["c"], "x")
    return p.select("c", F.col("place").cast("long").alias("place"), "x", F.col("other.x").alias("y"))


@query("SELECT l_orderkey, count(DISTINCT l_linenumber) FILTER (l_returnflag<>'R')::INT AS passed FROM (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1,2) GROUP BY 1")
def mapped_statuses(spark, d):
    t = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").cast("string").alias("t")).agg(F.max("l_returnflag").alias("f"))
    m = t.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("t", F.when(F.col("f") == "R", "FAILED").otherwise("PASSED").alias("s")))).alias("m"), F.collect_list("t").alias("tests"))
    return m.select("l_orderkey", J.mapped_status(F.array_append("tests", F.lit("absent")), F.col("m")).alias("passed"))


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity>45)")
def not_imported(spark, d):
    m = table(spark, d, "part").select("p_partkey", F.concat(F.lit("pkg.sub.m"), "p_partkey").alias("name"))
    i = table(spark, d, "lineitem").where("l_quantity > 45").select(F.concat(F.lit("sub.m"), "l_partkey").alias("imported"))
    return J.not_imported(m, i, "name", "imported").select("p_partkey")


@query("SELECT n_regionkey, arg_max(n_name, n_nationkey) AS root FROM nation WHERE contains(n_name,'A') GROUP BY 1")
def heaviest_roots(spark, d):
    return G.heaviest_root(table(spark, d, "nation"), ["n_regionkey"], "n_name", "n_nationkey", "A")


@query("WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, o_custkey//2 AS b FROM orders), r AS (SELECT 3::BIGINT AS node UNION SELECT a FROM r JOIN e ON b=node) SELECT node FROM r")
def graph_ancestors(spark, d):
    e = table(spark, d, "orders").select(F.col("o_custkey").alias("caller"), F.expr("o_custkey div 2").alias("callee")).distinct()
    return G.ancestors(e, spark.createDataFrame([(3,)], "node long"))


@query("WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, o_custkey//3 AS b FROM orders), r AS (SELECT DISTINCT o_custkey AS test, o_custkey AS node, 0 AS depth FROM orders WHERE o_custkey%10=0 AND o_custkey>0 UNION SELECT test, b, depth+1 FROM r JOIN e ON a=node WHERE depth<2) SELECT 'test_' || test AS test, min(depth)::INT AS depth, CASE WHEN node=test THEN 'test_' ELSE 'm' END || node AS file FROM r GROUP BY test, node")
def referenced_files(spark, d):
    k = F.col("o_custkey")
    low = F.expr("o_custkey div 3")
    e = table(spark, d, "orders").select(F.concat(F.lit("m"), k).alias("file"), F.concat(F.lit("m"), low).alias("uses")).distinct()
    tests = table(spark, d, "orders").where((k % 10 == 0) & (k > 0)).select(F.concat(F.lit("test_"), k).alias("test")).distinct()
    own = table(spark, d, "orders").where((k % 10 == 0) & (k > 0)).select(F.concat(F.lit("test_"), k).alias("file"), F.concat(F.lit("m"), low).alias("uses")).distinct()
    return G.referenced_files(e.unionByName(own), tests, 2)


@query("SELECT p_name || '.py' AS test FROM part WHERE p_size>40 UNION SELECT p_name || '.py' FROM part WHERE p_name LIKE 'test%'")
def relevant_tests(spark, d):
    p = table(spark, d, "part").select(F.concat("p_name", F.lit(".py")).alias("test"), "p_size")
    return J.relevant_tests(p.where("p_size > 40"), p, T.is_test_file(F.col("test")))


# ------------------------------------------------------------------ sources and sinks


def _folder(spark: SparkSession) -> str:
    G.checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/staged-{uuid.uuid4().hex}"


def _instances(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(F.concat(F.lit("a__b-"), k).alias("instance_id"), F.lit("a/b").alias("repo"), F.concat(F.lit("p"), k).alias("patch"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"), F.array(F.lit("t1"), F.concat(F.lit("t"), k)).alias("PASS_TO_PASS"))


@query("SELECT 'a__b-' || o_orderkey AS instance_id, 'p' || o_orderkey AS patch, 't' || o_orderkey AS last FROM orders")
def dataset_round_trip(spark, d):
    path = _folder(spark) + ".jsonl"
    K.json(_instances(spark, d), path)
    return R.dataset(spark, path).select("instance_id", "patch", F.element_at("PASS_TO_PASS", -1).alias("last"))


@query("SELECT 'a__b-' || o_orderkey AS instance_id FROM orders WHERE o_orderkey<=3")
def dataset_subset(spark, d):
    path = _folder(spark)
    K.parquet(_instances(spark, d), path)
    ids = [f"a__b-{r[0]}" for r in table(spark, d, "orders").where("o_orderkey <= 3").select("o_orderkey").collect()]
    return R.dataset(spark, path, ids).select("instance_id")


@query("SELECT 'a__b-' || o_orderkey AS instance_id, 'kind' AS kind, o_orderkey%2=0 AS patched FROM orders")
def predictions_round_trip(spark, d):
    path = _folder(spark)
    k = F.expr("cast(split(instance_id, '-')[1] as long)")
    K.json(_instances(spark, d).select("instance_id", F.when(k % 2 == 0, "x").alias("model_patch"), F.lit("kind").alias("model_name_or_path")), path)
    p = R.predictions(spark, path)
    return p.select("instance_id", F.col("model_name_or_path").alias("kind"), F.col("model_patch").isNotNull().alias("patched"))


@query("SELECT 'a__b-' || o_orderkey AS instance_id, 'p' || o_orderkey AS gold, '' AS empty FROM orders")
def fixed_predictions(spark, d):
    i = _instances(spark, d)
    gold, empty = R.fixed_predictions(i, True).select("instance_id", F.col("model_patch").alias("gold")), R.fixed_predictions(i, False).select("instance_id", F.col("model_patch").alias("empty"))
    return gold.join(empty, "instance_id")


@query("SELECT n_nationkey::VARCHAR AS instance_id, n_name AS model_patch, 'r' || n_regionkey AS model_name_or_path FROM nation")
def keyed_predictions(spark, d):
    path = _folder(spark)
    entry = F.struct(F.col("n_name").alias("model_patch"), F.concat(F.lit("r"), "n_regionkey").alias("model_name_or_path"))
    one = table(spark, d, "nation").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), entry)))).alias("value"))
    one.write.text(path)
    return R.keyed_predictions(spark, path)


@query("SELECT o_orderkey::VARCHAR AS instance_id, CASE WHEN o_orderkey%2=0 THEN 'd' ELSE '' END AS model_patch, 'm' || o_orderkey AS model_name_or_path FROM orders WHERE o_orderkey%3<>0 AND o_orderkey%5<>0")
def trajectory_predictions(spark, d):
    k = F.col("o_orderkey")
    runs = table(spark, d, "orders").select(k.cast("string").alias("instance_id"), F.when(k % 3 != 0, F.struct(F.concat(F.lit("out/x/m"), k).alias("eval_output_dir"))).alias("metadata"), F.struct(F.when(k % 2 == 0, "d").alias("git_patch")).alias("test_result"))
    return R.trajectory_predictions(runs, runs.where(k % 5 != 0).select("instance_id"))


@query("SELECT n_nationkey::VARCHAR AS instance_id, 'm' AS model, 'run' AS run_id, n_name AS status FROM nation")
def result_tree(spark, d):
    path = _folder(spark)
    n = table(spark, d, "nation").select(F.lit("run").alias("a"), F.lit("m").alias("b"), F.col("n_nationkey").cast("string").alias("c"), F.to_json(F.create_map(F.lit("t"), "n_name")).alias("value"))
    # A folder for each instance, as runs leave them: plain names, since these folders are read as parts of the path.
    for k in range(25):
        n.where(f"c = '{k}'").select("value").coalesce(1).write.text(f"{path}/run/m/{k}")
    files = R.status_maps(R.result_files(spark, path, "*.txt"))
    return files.select("run_id", "model", "instance_id", F.col("status")["t"].alias("status"))


@query("SELECT n_nationkey::VARCHAR AS key, 'f' AS file, 't' || n_regionkey AS test, n_name AS status FROM nation")
def nested_statuses(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.to_json(F.create_map(F.lit("f"), F.create_map(F.concat(F.lit("t"), "n_regionkey"), F.col("n_name")))).alias("text"))
    return R.nested_status(n)


@query("SELECT o_orderkey::VARCHAR AS instance_id, round(o_totalprice/1000,3)::DOUBLE AS human, CASE WHEN o_orderkey%4=0 THEN NULL ELSE 1.5::DOUBLE END AS raw FROM orders")
def report_csv(spark, d):
    path = _folder(spark)
    k = F.col("o_orderkey")
    r = table(spark, d, "orders").select(k.cast("string").alias("instance_id"), F.when(k % 4 != 0, 1.5).alias("raw_pred_speedup_ratio"), F.lit(1.0).alias("pred_speedup_ratio"), F.lit(2.0).alias("gold_speedup_ratio"), _round(F.col("o_totalprice") / 1000, 3).alias("human_speedup_ratio"), F.lit(1.0).alias("correctness"), F.lit(1.0).alias("correctness_pct"), F.lit(0.5).alias("pre_edit_runtime"), F.lit(3).alias("patch_length"))
    K.csv(r, path)
    return R.eval_reports(spark, path).select("instance_id", F.col("human_speedup_ratio").alias("human"), F.col("raw_pred_speedup_ratio").alias("raw"))


@query("SELECT n_nationkey, n_name AS note FROM nation WHERE n_nationkey%2=0 UNION ALL SELECT n_nationkey, 'old' FROM nation WHERE n_nationkey%2=1")
def sheet_update(spark, d):
    path = _folder(spark)
    n = table(spark, d, "nation")
    K.csv(n.select("n_nationkey", F.lit("old").alias("note")), path)
    sheet = R.sheet(spark, path, ["n_nationkey", "note"]).withColumn("n_nationkey", F.col("n_nationkey").cast("long"))
    back = _folder(spark)
    K.status_back(sheet, n.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), F.col("n_name").alias("note")), "n_nationkey", ["note"], back)
    return R.sheet(spark, back, ["note"]).select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "note")


@query("SELECT n_nationkey AS item FROM nation WHERE n_nationkey<10")
def paged_listing(spark, d):
    n = table(spark, d, "nation").select((F.expr("n_nationkey div 5") + 1).cast("int").alias("page"), "n_nationkey")
    pages = n.groupBy("page").agg(F.collect_list(F.when(F.col("page") != 3, F.col("n_nationkey"))).alias("items"))
    return R.pages_until_empty(pages).select("item")


@query("SELECT o_orderkey AS number FROM orders WHERE o_orderdate>=TIMESTAMP '1997-01-01' ORDER BY strftime(o_orderdate,'%Y-%m-%d') DESC, o_orderkey DESC LIMIT 25")
def recent_pulls(spark, d):
    p = table(spark, d, "orders").select(F.col("o_orderkey").alias("number"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"))
    return R.recent_pulls(p, "1997-01-01", 25).select("number")


@query("SELECT DISTINCT 'v' || (o_orderkey%50) AS version, DATE '2020-01-05' + (o_orderkey%20)::INT AS release_date FROM orders")
def release_pages(spark, d):
    k = F.col("o_orderkey")
    day = F.date_format(F.date_add(F.lit("2020-01-05").cast("date"), (k % 20).cast("int")), "MMM d, yyyy")
    html = F.concat(F.lit("<li>v"), k % 50, F.lit(" ("), day, F.lit(")</li><li>v0 (soon)</li>"))
    return R.releases(table(spark, d, "orders").select(html.alias("html")), r"<li>(v[0-9]+) \(([^)]*)\)</li>")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey%2=0")
def lenient_lines(spark, d):
    path = _folder(spark)
    table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, F.to_json(F.struct("o_orderkey"))).otherwise("{broken").alias("value")).write.text(path)
    return R.lenient_jsonl(spark, path, "o_orderkey long").select("o_orderkey")


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def strict_lines(spark, d):
    path = _folder(spark)
    K.json(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), path)
    return R.strict_jsonl(spark, path, "o_orderkey long, o_orderstatus string")


@query("SELECT o_orderkey, CASE o_orderkey%3 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END AS n FROM orders")
def lists_from_text(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k, F.when(k % 3 == 0, '["a","b"]').when(k % 3 == 1, "not a list").otherwise('["c"]').alias("x"))
    return R.lists_as_arrays(rows, ["x"]).select("o_orderkey", F.size("x").alias("n"))


@query("SELECT o_orderkey, true AS tested FROM orders WHERE o_orderkey%3=0 UNION ALL SELECT o_orderkey, false FROM orders")
def two_outputs(spark, d):
    every, tested = _folder(spark), _folder(spark)
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k, F.when(k % 3 == 0, "diff").otherwise("  ").alias("test_patch"))
    for part in (rows.where(k % 2 == 0), rows.where(k % 2 == 1)):
        K.valid_and_tested(part, every, tested)
    of = lambda p, t: spark.read.schema("o_orderkey long").json(p).select("o_orderkey", F.lit(t).alias("tested"))
    return of(every, False).unionAll(of(tested, True))


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus='F') AS resolved_count, md5(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) FILTER (o_orderstatus='F')) AS resolved, 2 AS schema_version FROM orders")
def run_report(spark, d):
    r = K.run_report(table(spark, d, "orders").withColumn("label", F.when(F.col("o_orderstatus") == "F", "resolved").otherwise("completed")), "label", "o_orderkey")
    return r.select("total", "resolved_count", F.md5(F.array_join(F.transform("resolved_ids", lambda x: x.cast("string")), ",")).alias("resolved"), "schema_version")


@query("SELECT c_custkey FROM customer")
def merged_shards(spark, d):
    a, b, out = _folder(spark), _folder(spark), _folder(spark)
    c = table(spark, d, "customer").select("c_custkey")
    K.json(c.where("c_custkey % 2 = 0"), a)
    K.json(c.where("c_custkey % 2 = 1"), b)
    K.merge_shards(spark.read.schema("c_custkey long").json([a, b]), out)
    return spark.read.schema("c_custkey long").json(out)


@query("SELECT n_regionkey, md5(string_agg(n_name || chr(10) || chr(10) || n_nationkey, '|' ORDER BY n_name)) AS digest FROM nation GROUP BY 1")
def text_bundles(spark, d):
    path = _folder(spark)
    K.bundles(table(spark, d, "nation").select("n_regionkey", "n_name", F.col("n_nationkey").cast("string").alias("id")), "n_regionkey", ["n_name", "id"], path)
    lines = spark.read.option("lineSep", "\u0000").text(path)
    return lines.groupBy(F.col("n_regionkey").cast("long").alias("n_regionkey")).agg(F.md5(F.array_join(F.array_sort(F.flatten(F.collect_list(F.transform(F.filter(F.split("value", r"\n(?=[A-Z])"), lambda x: x != ""), lambda x: F.rtrim(F.regexp_replace(x, r"\n$", "")))))), "|")).alias("digest"))


@query("SELECT 'a__b-' || o_orderkey AS instance_id, 'https://host/a/b/pull/' || o_orderkey AS url FROM orders")
def link_list(spark, d):
    path = _folder(spark)
    K.links(_instances(spark, d), "instance_id", T.pull_url(F.col("instance_id"), "https://host"), path)
    return spark.read.option("header", True).csv(path)


@query("SELECT s_suppkey, CASE s_suppkey%3 WHEN 0 THEN 'env.yml' WHEN 1 THEN 'requirements.txt' END AS path FROM supplier")
def first_existing_file(spark, d):
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").select(k)
    held = s.where(k % 3 == 0).select(k, F.explode(F.array(F.lit("requirements.txt"), F.lit("env.yml"))).alias("path")).unionAll(s.where(k % 3 == 1).select(k, F.lit("requirements.txt"))).withColumn("text", F.lit("x"))
    return J.first_found(s, held, "s_suppkey", ["env.yml", "requirements.txt"]).select("s_suppkey", "path")


@query("SELECT n_name AS name, n_regionkey AS region FROM nation WHERE n_nationkey%2=0 EXCEPT SELECT n_name, n_regionkey FROM nation WHERE n_regionkey=1")
def shard_union(spark, d):
    n = table(spark, d, "nation").selectExpr("n_name name", "n_regionkey region", "n_nationkey k")
    both = n.where("k % 4 = 0").unionByName(n.where("k % 4 = 2"))
    return J.drop(both, n.where("region = 1").select("name"), "name").select("name", "region")
