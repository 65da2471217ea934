"""Queries on patches whose files, hunks and lines come from documents' texts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perfloom.functions import diffs as D
from perfloom.plans.catalog import query
from perfloom.sources.readers import table


def _patches(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, patch: every six lines of a text are a file with one hunk; a line's length says whether it stays, goes or comes."""
    kind = lambda x: F.when(F.length(x) % 4 == 0, "-").when(F.length(x) % 4 == 1, "+").otherwise(" ")

    def head(x: Column, i: Column) -> Column:
        n = F.floor(i / 6)
        path = F.concat(F.lit("lib/f"), n, F.when(F.length(x) % 2 == 0, ".py").otherwise("_test.py"))
        return F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n@@ -1,6 +"), n * 100 + 5, F.lit(",6 @@\n"))

    rows = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.when(i % 6 == 0, head(x, i)).otherwise(""), kind(x), x))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(rows, "\n").alias("patch"))


_LINES = """l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, i, i // 6 AS n, CASE length(x) % 4 WHEN 0 THEN '-' WHEN 1 THEN '+' ELSE ' ' END AS kind, x FROM l),
p AS (SELECT doc_id, n, 'lib/f' || n || CASE WHEN length(arg_min(x, i)) % 2 = 0 THEN '.py' ELSE '_test.py' END AS file FROM k GROUP BY 1, 2),
b AS (SELECT k.*, file, (100 * n + 4 + sum(CASE WHEN kind <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, n ORDER BY i))::INT AS line_no FROM k JOIN p USING (doc_id, n) WHERE NOT starts_with(kind || x, '--- ') AND NOT starts_with(kind || x, '+++ '))"""


@query(f"WITH {_LINES} SELECT doc_id, file, count(*) FILTER (kind = '+') AS added, count(*) FILTER (kind = '-') AS removed, sum(line_no)::BIGINT AS numbers, sum(length(x))::BIGINT AS chars FROM b GROUP BY 1,2")
def patch_lines_of_documents(spark, d):
    rows = D.diff_lines(_patches(spark, d), "doc_id")
    return rows.groupBy("doc_id", "file").agg(F.count_if(F.col("kind") == "+").alias("added"), F.count_if(F.col("kind") == "-").alias("removed"), F.sum("line_no").alias("numbers"), F.sum(F.length("text")).alias("chars"))


@query(
    f"""WITH {_LINES}, s AS (SELECT *, last_value(CASE WHEN kind <> '-' THEN line_no END IGNORE NULLS) OVER (PARTITION BY doc_id, n ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
    first_value(CASE WHEN kind <> '-' THEN line_no END IGNORE NULLS) OVER (PARTITION BY doc_id, n ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM b)
    SELECT doc_id, file, before, after, count(*) AS n FROM s WHERE kind = '-' GROUP BY ALL"""
)
def removed_lines_of_documents(spark, d):
    rows = D.surviving_neighbours(D.diff_lines(_patches(spark, d), "doc_id"), "doc_id")
    return rows.groupBy("doc_id", "file", "before", "after").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_LINES}, f AS (SELECT doc_id, n, file, 'diff --git a/' || file || ' b/' || file || chr(10) || '--- a/' || file || chr(10) || '+++ b/' || file || chr(10) || '@@ -1,6 +' || (100 * n + 5) || ',6 @@' || chr(10)
        || string_agg(kind || x, chr(10) ORDER BY i) || CASE WHEN n < max(n) OVER (PARTITION BY doc_id) THEN chr(10) ELSE '' END AS body FROM k JOIN p USING (doc_id, n) GROUP BY doc_id, n, file)
    SELECT doc_id, md5(coalesce(string_agg(body, '' ORDER BY file, body) FILTER (NOT contains(file, 'test')), '')) AS fix, md5(coalesce(string_agg(body, '' ORDER BY file, body) FILTER (contains(file, 'test')), '')) AS tests, count(*) AS files FROM f GROUP BY 1"""
)
def patches_of_documents_apart(spark, d):
    patches = _patches(spark, d)
    files = D.file_diffs(patches).groupBy("doc_id").agg(F.count("*").alias("files"))
    return D.split_tests(patches, "doc_id").join(files, "doc_id").select("doc_id", F.md5("fix_patch").alias("fix"), F.md5("test_patch").alias("tests"), "files")
