"""Queries on logs whose tests, options and messages come from documents and conversations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from perfloom.functions import logs as L
from perfloom.plans.catalog import query
from perfloom.sources.readers import table

_WORDS = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), w AS (SELECT doc_id, pos, length(x) AS n, string_split(x, ' ') AS s FROM l WHERE regexp_matches(x, '^[A-Za-z]+ [A-Za-z]+ [A-Za-z]+ '))"


@query(
    f"""WITH {_WORDS} SELECT doc_id, 'm::' || s[1] || CASE WHEN n % 2 = 0 THEN '[/' || s[3] || ']' ELSE '[' || s[2] || '[' || s[3] || ']/' || s[1] || ']' END AS test,
    arg_max(CASE n % 3 WHEN 0 THEN 'PASSED' WHEN 1 THEN 'FAILED' ELSE 'ERROR' END, pos) AS status FROM w GROUP BY 1, 2"""
)
def log_nested_options(spark, d):
    """Options with brackets and paths in them; a path counts by its last part, brackets within an option stay."""

    def line(x):
        s, n = F.split(x, " "), F.length(x)
        status = F.when(n % 3 == 0, "PASSED").when(n % 3 == 1, "FAILED").otherwise("ERROR")
        option = F.when(n % 2 == 0, F.concat(F.lit("/"), s[1], F.lit("[x]/"), s[2])).otherwise(F.concat(s[1], F.lit("["), s[2], F.lit("]/"), s[0]))
        return F.when(x.rlike("^[A-Za-z]+ [A-Za-z]+ [A-Za-z]+ "), F.concat(status, F.lit(" m::"), s[0], F.lit("["), option, F.lit("]"))).otherwise(F.lit("."))

    docs = table(spark, d, "documents").where("text is not null")
    return L.parse(docs.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("log")), "doc_id", "pytest_options")


@query(
    """WITH c AS (SELECT conv_id, role, turn, length(text) % 6 AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM conversations WHERE text IS NOT NULL)
    SELECT conv_id, 'test_' || role || '_' || i || ' (m.T)' AS test, CASE k WHEN 4 THEN 'ERROR' WHEN 5 THEN 'FAILED' ELSE 'PASSED' END AS status FROM c"""
)
def log_django_messages(spark, d):
    """Turns stand for tests. Between a name and its `ok` there may be messages of one line or several."""
    c = table(spark, d, "conversations").where("text is not null")
    of = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def line(t, i):
        k = F.length(t["text"]) % 6
        first = F.split(F.regexp_replace(t["text"], "[^A-Za-z]+", " "), " ")[0]
        said = (
            F.when(k == 0, "ok")
            .when(k == 1, F.concat(F.lit("Testing against Django installed in '/"), first, F.lit("'\nFound "), F.length(t["text"]), F.lit(" tests (0 silenced).\nok")))
            .when(k == 2, F.concat(F.lit("Internal Server Error: /"), first, F.lit("/\nok")))
            .when(k == 3, "System check identified no issues (0 silenced)\nok")
            .when(k == 4, "ERROR")
            .otherwise("FAIL")
        )
        return F.concat(F.lit("test_"), t["role"], F.lit("_"), i + 1, F.lit(" (m.T) ... "), said)

    return L.parse(of.select("conv_id", F.array_join(F.transform("turns", line), "\n").alias("log")), "conv_id", "django")
