"""The engine's queries on the test tables, each with its SQL.

The tables are not shaped like the engine's records, so each query maps them first: orders stand for instances, their
lineitems for tests and runtimes, events for pulls and releases, documents for patches, logs and texts. The operators are
those that records go through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfloom.functions import diffs as D
from perfloom.functions import logs as L
from perfloom.functions import numbers as N
from perfloom.functions import text as T
from perfloom.operators import aggregates as A
from perfloom.operators import graph as G
from perfloom.operators import joins as J
from perfloom.operators import ordered as O
from perfloom.operators import sampling as S
from perfloom.plans import curation, scoring
from perfloom.sources.readers import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _round(c, n: int = 4):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


# ------------------------------------------------------------------ scoring


def _scored(spark: SparkSession, d: str) -> DataFrame:
    orders, items = table(spark, d, "orders"), table(spark, d, "lineitem")
    per = items.groupBy(F.col("l_orderkey").alias("instance_id")).agg(
        F.sum("l_extendedprice").alias("before"),
        F.sum(F.expr("l_extendedprice * (1 - l_discount) * (1 + l_tax)")).alias("after"),
        F.count_if(F.col("l_returnflag") != "R").alias("passed"),
        F.count("*").alias("expected"),
    )
    instances = orders.selectExpr("o_orderkey instance_id", "o_orderpriority priority", "o_totalprice price")
    gold = instances.select("instance_id", F.greatest(F.col("price") / 100000, F.lit(0.01)).alias("before"), F.lit(1.0).alias("after"))
    return scoring.report(instances, per, gold, per)


_SCORED = """
per AS (SELECT l_orderkey AS id, sum(l_extendedprice) AS b, sum(l_extendedprice*(1-l_discount)*(1+l_tax)) AS a,
        count(*) FILTER (l_returnflag <> 'R') AS p, count(*) AS e FROM lineitem GROUP BY 1),
s AS (SELECT o_orderkey AS instance_id, o_orderpriority AS priority,
        CASE WHEN p IS NOT NULL THEN coalesce(b/nullif(a,0), 1.0) END AS raw,
        greatest(o_totalprice/100000, 0.01) AS gold,
        CASE WHEN p IS NULL THEN 0.0 WHEN e = 0 THEN 1.0 ELSE p/e END AS pct FROM orders LEFT JOIN per ON o_orderkey = id),
r AS (SELECT *, CASE WHEN pct = 1 THEN 1.0 ELSE 0.0 END AS ok, CASE WHEN pct = 1 THEN coalesce(raw, 1.0) ELSE 1.0 END AS pred FROM s),
scored AS (SELECT *, CASE WHEN gold = 0 THEN 0.0 ELSE pred/gold END AS human FROM r)
"""


@query(f"WITH {_SCORED} SELECT instance_id, round(raw,4) AS raw_ratio, round(pred,4) AS pred_ratio, round(gold,8) AS gold_ratio, round(human,4) AS human_ratio, round(pct,4) AS correctness_pct, ok::DOUBLE AS correctness FROM scored")
def scored_report(spark, d):
    r = _scored(spark, d)
    return r.select("instance_id", _round("raw_pred_speedup_ratio").alias("raw_ratio"), _round("pred_speedup_ratio").alias("pred_ratio"), _round("gold_speedup_ratio", 8).alias("gold_ratio"), _round("human_speedup_ratio").alias("human_ratio"), _round("correctness_pct").alias("correctness_pct"), "correctness")


@query(
    f"""WITH {_SCORED} SELECT priority, count(*) AS n, round(count(*)/sum(1/human),4) AS harmonic_mean, round(exp(avg(ln(human))),4) AS geometric_mean, round(avg(ok)*100,4) AS correct_percent,
    round(avg((ok<>1)::INT),4) AS incorrect, round(avg(coalesce(ok=1 AND raw<1,false)::INT),4) AS slower, round(avg(coalesce(ok=1 AND raw>=1 AND human<1,false)::INT),4) AS below_expert,
    round(avg(coalesce(ok=1 AND raw>=1 AND human>=1,false)::INT),4) AS expert FROM scored GROUP BY 1"""
)
def score_summary(spark, d):
    out = scoring.summary(_scored(spark, d), ["priority"])
    return out.select("priority", "n", *[_round(c).alias(c) for c in out.columns[2:]])


@query(f"WITH {_SCORED} SELECT CASE WHEN human<=0.25 THEN 0 WHEN human<=0.5 THEN 1 WHEN human<=1 THEN 2 ELSE 3 END AS bucket, count(*) AS n, round(exp(avg(CASE WHEN human>0 THEN ln(human) END)),4) AS gm FROM scored GROUP BY 1")
def geometric_mean_by_bucket(spark, d):
    r = _scored(spark, d).withColumn("bucket", N.bucket_right(F.col("human_speedup_ratio"), [0, 0.25, 0.5, 1.0, float("inf")]))
    return r.groupBy("bucket").agg(F.count("*").alias("n"), _round(A.geometric_mean(F.col("human_speedup_ratio"))).alias("gm"))


@query(f"WITH {_SCORED}, l AS (SELECT instance_id, priority, CASE WHEN raw IS NULL THEN 'error' WHEN ok=1 THEN 'resolved' ELSE 'unresolved' END AS label FROM scored) SELECT priority, count(*) AS total, count(*) FILTER (label='error') AS error_count, count(*) FILTER (label='resolved') AS resolved_count, count(*) FILTER (label='unresolved') AS unresolved_count, md5(coalesce(string_agg(instance_id::VARCHAR, ',' ORDER BY instance_id) FILTER (label='error'),'')) AS error_ids FROM l GROUP BY 1")
def run_outcome_sets(spark, d):
    r = _scored(spark, d).withColumn("label", F.when(F.col("raw_pred_speedup_ratio").isNull(), "error").when(F.col("correctness") == 1, "resolved").otherwise("unresolved"))
    out = A.outcome_sets(r, "label", "instance_id", ["error", "resolved", "unresolved"], ["priority"])
    return out.select("priority", "total", "error_count", "resolved_count", "unresolved_count", F.md5(F.array_join(F.transform("error_ids", lambda x: x.cast("string")), ",")).alias("error_ids"))


@query("SELECT n_name, count(*) FILTER (c_acctbal>0) AS used, round(count(*) FILTER (c_acctbal>0)/sum(1/c_acctbal) FILTER (c_acctbal>0),4) AS hm FROM customer JOIN nation ON c_nationkey=n_nationkey GROUP BY 1")
def harmonic_mean_positive(spark, d):
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.expr("c_nationkey = n_nationkey"))
    x = F.col("c_acctbal")
    return c.groupBy("n_name").agg(F.count_if(N.positive_finite(x)).alias("used"), _round(A.harmonic_mean_positive(x)).alias("hm"))


@query(f"WITH {_SCORED} SELECT priority, round(avg((ok<>1)::INT),4) AS incorrect, round(avg(coalesce(ok=1 AND raw>=1,false)::INT),4) AS faster FROM scored GROUP BY 1")
def outcome_proportions(spark, d):
    a = _scored(spark, d).groupBy("priority").agg(*A.outcomes(F.col("raw_pred_speedup_ratio"), F.col("correctness"), F.col("human_speedup_ratio")))
    return a.select("priority", _round("incorrect").alias("incorrect"), _round(F.col("below_expert") + F.col("expert")).alias("faster"))


@query("WITH r AS (SELECT l_orderkey AS id, avg((l_returnflag<>'R')::INT) AS f, avg((l_linestatus='F')::INT) AS p FROM lineitem GROUP BY 1) SELECT CASE WHEN f=1 AND p=1 THEN 'FULL' WHEN f<1 AND f>0 AND p=1 THEN 'PARTIAL' ELSE 'NO' END AS resolution, count(*) AS n FROM r GROUP BY 1")
def resolution_status(spark, d):
    r = table(spark, d, "lineitem").groupBy("l_orderkey").agg(A.pass_fraction(F.count_if(F.col("l_returnflag") != "R"), F.count("*")).alias("f"), A.pass_fraction(F.count_if(F.col("l_linestatus") == "F"), F.count("*")).alias("p"))
    return r.groupBy(A.resolution(F.col("f"), F.col("p")).alias("resolution")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ order


@query("SELECT DISTINCT o_totalprice AS x, round(count(*) OVER w / sum(1/greatest(o_custkey,1)) OVER w, 4) AS prefix_mean FROM orders WINDOW w AS (ORDER BY o_totalprice RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def prefix_harmonic_curve(spark, d):
    o = table(spark, d, "orders").select(F.col("o_totalprice").alias("x"), F.greatest(F.col("o_custkey"), F.lit(1)).cast("double").alias("ratio"))
    return O.prefix_harmonic(o, "x", "ratio").select("x", _round("prefix_mean").alias("prefix_mean"))


@query("WITH e AS (SELECT quantile_cont(o_totalprice, 0.15) AS a, max(o_totalprice) AS b FROM orders) SELECT i::INT AS point, round(exp(ln(a)+i*(ln(b)-ln(a))/19),3) AS threshold FROM e, range(20) t(i)")
def log_grid_thresholds(spark, d):
    return O.log_grid(table(spark, d, "orders"), "o_totalprice", 20).select("point", _round("threshold", 3).alias("threshold"))


@query("WITH e AS (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b FROM lineitem), r AS (SELECT least(greatest(floor(20.0*(ln(l_extendedprice)-ln(a))/(ln(b)-ln(a))),0),19)::INT AS bin, l_quantity AS q FROM lineitem, e) SELECT bin, count(*) AS n, CASE WHEN count(*)>=3 THEN round(count(*)/sum(1/q),4) END AS hm FROM r GROUP BY 1")
def log_bin_hm_mincount(spark, d):
    r = S.binned(table(spark, d, "lineitem").select("l_extendedprice", "l_quantity"), "l_extendedprice", "bin")
    return r.groupBy("bin").agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, _round(A.harmonic_mean(F.col("l_quantity")))).alias("hm"))


@query("WITH e AS (SELECT list_sort(list_distinct(quantile_cont(c_acctbal, [0.0,0.25,0.5,0.75,1.0]))) AS edges FROM customer) SELECT greatest(len(list_filter(edges, lambda x: x < c_acctbal))-1,0)::INT AS bucket, count(*) AS n, round(max(c_acctbal),2) AS hi FROM customer, e GROUP BY 1")
def quantile_buckets(spark, d):
    c = table(spark, d, "customer").select("c_acctbal")
    r = c.crossJoin(F.broadcast(O.quantile_edges(c, "c_acctbal", 4)))
    return r.groupBy(O.bucket_of(F.col("c_acctbal"), F.col("edges")).cast("int").alias("bucket")).agg(F.count("*").alias("n"), _round(F.max("c_acctbal"), 2).alias("hi"))


@query("WITH c AS (SELECT conv_id, count(*) AS steps, (conv_id%2)::INT AS m, median(length(text)) AS size FROM conversations WHERE role='user' AND text IS NOT NULL GROUP BY conv_id), b AS (SELECT least(steps,5)::INT-1 AS bucket, m, size FROM c) SELECT i::INT AS bucket, round(median(size) FILTER (m=0),2) AS even, round(median(size) FILTER (m=1),2) AS odd FROM range(6) t(i) LEFT JOIN b ON bucket=i GROUP BY 1")
def median_by_bucket_pivot(spark, d):
    c = table(spark, d, "conversations").where("role = 'user' and text is not null").groupBy("conv_id").agg(F.count("*").alias("steps"), F.median(F.length("text")).alias("size"))
    b = c.select((F.least("steps", F.lit(5)).cast("int") - 1).alias("bucket"), F.when(F.col("conv_id") % 2 == 0, "even").otherwise("odd").alias("model"), "size")
    return O.median_pivot(b, "bucket", 6, "model", ["even", "odd"], "size").select("bucket", _round("even", 2).alias("even"), _round("odd", 2).alias("odd"))


@query("WITH o AS (SELECT o_custkey AS k, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) - 15 AS s, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) + 15 AS e FROM orders), w AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s,e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM o), i AS (SELECT *, sum(CASE WHEN r IS NULL OR s>r+1 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s,e ROWS UNBOUNDED PRECEDING) AS g FROM w) SELECT k, min(s) AS s, max(e) AS e FROM i GROUP BY k, g")
def interval_merge(spark, d):
    return O.merged(_intervals(spark, d), ["k"], "s", "e", gap=1).select("k", "s", "e")


def _intervals(spark, d):
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k"), (day - 15).alias("s"), (day + 15).alias("e"), "o_orderkey", "o_orderstatus")


@query("WITH o AS (SELECT o_custkey AS k, o_orderkey AS id, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS t FROM orders) SELECT a.k AS k, a.id AS a, b.id AS b FROM o a JOIN o b ON a.k=b.k AND a.id<b.id AND a.t-15<=b.t+15 AND b.t-15<=a.t+15")
def interval_overlap(spark, d):
    o = _intervals(spark, d)
    a, b = o.select("k", F.col("s").alias("s1"), F.col("e").alias("e1"), F.col("o_orderkey").alias("a")), o.select("k", F.col("s").alias("s2"), F.col("e").alias("e2"), F.col("o_orderkey").alias("b"))
    return J.overlapping(a, b, ["k"], ("s1", "e1"), ("s2", "e2")).where("a < b").select("k", "a", "b")


@query("WITH o AS (SELECT o_custkey AS k, o_orderkey AS id, o_orderstatus AS st, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS t FROM orders), p AS (SELECT * FROM o WHERE st='F'), s AS (SELECT *, t-15-(id%40) AS a, t+15+(id%40) AS b FROM o WHERE st<>'F') SELECT p.id AS point, arg_min(s.id, {'w': b-a, 'a': a, 'i': s.id}) AS span FROM p JOIN s ON p.k=s.k AND p.t BETWEEN a AND b GROUP BY 1")
def enclosing_span(spark, d):
    o = _intervals(spark, d).withColumn("t", F.col("s") + 15)
    points = o.where("o_orderstatus = 'F'").select("k", F.col("t").alias("t"), F.col("o_orderkey").alias("point"))
    spans = o.where("o_orderstatus <> 'F'").select("k", (F.col("s") - F.col("o_orderkey") % 40).alias("a"), (F.col("e") + F.col("o_orderkey") % 40).alias("b"), F.col("o_orderkey").alias("span"))
    return O.smallest_span(points, spans, ["k"], "t", "a", "b", "span").select("point", "span")


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)),1) AS pos FROM documents), k AS (SELECT *, CASE WHEN x LIKE '% of %' THEN 1 ELSE 0 END AS gone FROM l) SELECT doc_id, pos-1 AS pos, (100 + sum(1-gone) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1)::INT AS line_no FROM k")
def hunk_line_numbers(spark, d):
    # Every line becomes a hunk's line: those with ` of ` are removed ones.
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,1 +100,1 @@\n"), F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.when(F.contains(x, F.lit(" of ")), "-").otherwise(" "), x)), "\n")).alias("patch"))
    return D.diff_lines(docs, "doc_id").select("doc_id", (F.col("pos") - 4).cast("long").alias("pos"), "line_no")


@query("WITH c AS (SELECT conv_id, turn, CASE WHEN role='user' THEN length(text) END AS n FROM conversations) SELECT conv_id, turn, last_value(n IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, n ROWS UNBOUNDED PRECEDING)::BIGINT AS last_user FROM c")
def log_parser_last_name(spark, d):
    c = table(spark, d, "conversations").withColumn("n", F.when(F.col("role") == "user", F.length("text").cast("long")))
    return O.carried(c.withColumn("_o", F.coalesce("n", F.lit(1 << 40))), ["conv_id"], ["turn", "_o"], F.col("n"), "last_user").select("conv_id", "turn", "last_user")


@query("WITH c AS (SELECT *, max((length(text)>900)::INT) OVER (PARTITION BY conv_id ORDER BY turn RANGE UNBOUNDED PRECEDING) AS late FROM conversations) SELECT conv_id, count(*) AS n FROM c WHERE late=0 GROUP BY 1")
def take_while(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.max(F.length("text")).alias("longest"), F.count("*").alias("n"))
    return J.take_while(c, ["conv_id"], ["turn"], F.col("longest") <= 900).groupBy("conv_id").agg(F.sum("n").alias("n"))


@query("SELECT l_suppkey, round(avg(l_quantity),4) AS mean, round(stddev_samp(l_quantity),4) AS sd FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_quantity DESC) AS n FROM lineitem) WHERE n<=50 GROUP BY 1")
def tail_statistics(spark, d):
    r = O.last_n(table(spark, d, "lineitem"), ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"], 50)
    return r.groupBy("l_suppkey").agg(_round(F.avg("l_quantity")).alias("mean"), _round(F.stddev_samp("l_quantity")).alias("sd"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40")
def top_k(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(40)


# ------------------------------------------------------------------ joins and sets


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey=o_orderkey AND l_returnflag='R')")
def semi_subset(spark, d):
    items = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.keep(table(spark, d, "orders").select("o_orderkey"), items, "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey=o_orderkey)")
def anti_completed(spark, d):
    return J.drop(table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def missing_ids(spark, d):
    return J.missing(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("WITH t AS (SELECT event_id, user_id, ts FROM events WHERE event_type='purchase'), r AS (SELECT user_id, ts, max(event_id) AS version FROM events WHERE event_type='signup' GROUP BY 1,2) SELECT t.event_id, r.version FROM t ASOF LEFT JOIN r ON t.user_id=r.user_id AND t.ts > r.ts")
def asof_version(spark, d):
    e = table(spark, d, "events")
    tasks = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    releases = e.where("event_type = 'signup'").select("user_id", F.col("ts").alias("released"), F.col("event_id").alias("version"))
    return J.as_of(tasks, releases, "ts", "released", "version", ["user_id"]).select("event_id", "version")


@query("WITH n AS (SELECT doc_id, min(quality) AS q FROM labels GROUP BY 1) SELECT doc_id, coalesce(q, n_chars)::BIGINT AS value FROM (SELECT doc_id, min(n_chars) AS n_chars FROM documents GROUP BY 1) LEFT JOIN n USING (doc_id)")
def update_coalesce(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("value"))
    return J.updated(docs, table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("value")), "doc_id", ["value"], "value").select("doc_id", "value")


@query("WITH a AS (SELECT l_partkey AS k, sum(l_quantity) AS v FROM lineitem WHERE year(l_shipdate)=1996 GROUP BY 1), b AS (SELECT l_partkey AS k, sum(l_quantity) AS v FROM lineitem WHERE year(l_shipdate)=1997 GROUP BY 1) SELECT coalesce(a.k,b.k) AS l_partkey, round(coalesce(a.v,0.0)-coalesce(b.v,0.0),4) AS delta FROM a FULL JOIN b ON a.k=b.k")
def full_outer_delta(spark, d):
    x = table(spark, d, "lineitem")
    of = lambda y: x.where(F.year("l_shipdate") == y).groupBy("l_partkey").agg(F.sum("l_quantity").alias("v"))
    return J.deltas(of(1996), of(1997), ["l_partkey"], "v").select("l_partkey", _round("delta").alias("delta"))


@query("WITH e AS (SELECT user_id, event_type, CASE WHEN sum(value)::DOUBLE > 300 THEN 'PASS' WHEN sum(value)>100 THEN 'FAIL' ELSE 'SKIP' END AS s, day(ts)<=15 AS h FROM events GROUP BY user_id, event_type, day(ts)<=15), a AS (SELECT * FROM e WHERE h), b AS (SELECT * FROM e WHERE NOT h AND s<>'SKIP') SELECT coalesce(a.s,'NONE') AS \"from\", b.s AS \"to\", count(*) AS n FROM b LEFT JOIN a USING (user_id, event_type) GROUP BY 1,2")
def transition_matrix(spark, d):
    e = table(spark, d, "events").groupBy("user_id", "event_type", (F.dayofmonth("ts") <= 15).alias("h")).agg(F.sum("value").alias("v"))
    e = e.withColumn("s", F.when(F.col("v") > 300, "PASS").when(F.col("v") > 100, "FAIL").otherwise("SKIP"))
    t = A.transitions(e.where("h").drop("h"), e.where("not h").drop("h"), ["user_id", "event_type"], "s")
    return t.groupBy("from", "to").agg(F.count("*").alias("n"))


@query("WITH e AS (SELECT user_id, event_type, count(*) AS c, day(ts)<=15 AS h FROM events GROUP BY 1,2,4), a AS (SELECT * FROM e WHERE h), b AS (SELECT * FROM e WHERE NOT h) SELECT user_id, event_type, a.c AS left_value, b.c AS right_value FROM a FULL JOIN b USING (user_id, event_type) WHERE a.c IS DISTINCT FROM b.c")
def run_mismatches(spark, d):
    e = table(spark, d, "events").groupBy("user_id", "event_type", (F.dayofmonth("ts") <= 15).alias("h")).agg(F.count("*").alias("c"))
    return J.mismatches(e.where("h"), e.where("not h"), ["user_id", "event_type"], "c")


@query("SELECT l_partkey, l_suppkey, count(DISTINCT l_returnflag) AS statuses, count(DISTINCT l_returnflag)>1 AS flaky FROM lineitem GROUP BY 1,2")
def flaky_groups(spark, d):
    return A.flaky(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], "l_returnflag")


@query("WITH p AS (SELECT p_partkey, string_split(p_name,' ')[1] || p_size::VARCHAR AS k FROM part) SELECT p_partkey FROM p WHERE k IN (SELECT k FROM p GROUP BY 1 HAVING count(*)=1)")
def unique_prefix(spark, d):
    return O.unique_by(table(spark, d, "part"), F.concat(F.split("p_name", " ")[0], F.col("p_size").cast("string"))).select("p_partkey")


@query("WITH s AS (SELECT l_partkey AS part, (month(l_shipdate)%3) AS run, avg(l_extendedprice) AS before, avg(l_extendedprice*(1-l_discount*5)) AS after, stddev_samp(l_extendedprice) AS sd FROM lineitem GROUP BY 1,2), g AS (SELECT part, count(DISTINCT run) AS n, bool_or(coalesce((after-before>=0) OR ((after-before)/before*100>-25 AND abs(after-before)<sd),true)) AS bad, count(*) FILTER (after > before-2*sd) AS weak FROM s GROUP BY 1) SELECT part, weak, n=3 AND NOT bad AS kept FROM g")
def sigma_gate(spark, d):
    runs = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("part"), (F.month("l_shipdate") % 3).alias("run")).agg(F.avg("l_extendedprice").alias("before"), F.avg(F.expr("l_extendedprice * (1 - l_discount * 5)")).alias("after"), F.stddev_samp("l_extendedprice").alias("after_sd"))
    kept = curation.passed_gates(runs, "part", 3).select(F.col("part").alias("passed"), F.lit(True).alias("kept"))
    weak = runs.groupBy("part").agg(F.count_if(A.not_two_sigma(F.col("before"), F.col("after"), F.col("after_sd"))).alias("weak"))
    # Lines without a part are a group too.
    return weak.join(kept, F.col("part").eqNullSafe(F.col("passed")), "left").select("part", "weak", F.coalesce("kept", F.lit(False)).alias("kept"))


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents), b AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS x FROM benchmark) SELECT DISTINCT doc_id AS test FROM l WHERE x IN (SELECT x FROM b)")
def line_coverage_semi(spark, d):
    of = lambda t: F.explode(F.split(t, "\n")).alias("line")
    run = table(spark, d, "documents").select(F.col("doc_id").alias("test"), F.lit("f").alias("file"), of("text"))
    return J.covering_tests(run, table(spark, d, "benchmark").select(F.lit("f").alias("file"), of("text")))


@query("WITH p AS (SELECT page_id, rtrim(regexp_replace(url, '^https?://', ''), '/') AS u FROM pages), q AS (SELECT page_id AS k, regexp_replace(u, '^[^/]*/', '') AS v FROM p) SELECT DISTINCT page_id, k FROM p JOIN q ON u <> '' AND v <> '' AND (string_split(u,'/')[-1] = string_split(v,'/')[-1] OR suffix(u, v) OR suffix(v, u))")
def fuzzy_path(spark, d):
    p = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("u"))
    q = p.select(F.col("page_id").alias("k"), F.regexp_replace("u", "^[^/]*/", "").alias("v"))
    return J.same_path(p, q, "u", "v").select("page_id", "k").distinct()


@query("(SELECT c_custkey AS k, 'only customers' AS side FROM customer WHERE c_acctbal>0 EXCEPT SELECT o_custkey, 'only customers' FROM orders) UNION ALL (SELECT o_custkey, 'only orders' FROM orders EXCEPT SELECT c_custkey, 'only orders' FROM customer WHERE c_acctbal>0) UNION ALL (SELECT o_custkey, 'both' FROM orders INTERSECT SELECT c_custkey, 'both' FROM customer WHERE c_acctbal>0)")
def set_ops(spark, d):
    a = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    b = table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    side = lambda df, s: df.withColumn("side", F.lit(s))
    return side(a.subtract(b), "only customers").unionAll(side(b.subtract(a), "only orders")).unionAll(side(a.intersect(b), "both"))


# ------------------------------------------------------------------ texts


_WORDS = ["performance", "memory", "fast", "cache", "parallel", "this", "with", "licen"]


@query(f"SELECT doc_id FROM documents WHERE {' OR '.join(f"contains(lower(text), '{w}')" for w in dict.fromkeys(T.PERFORMANCE_WORDS))} OR contains(text,'PERF') OR contains(text,'OPTIM')")
def keyword_filter(spark, d):
    return table(spark, d, "documents").where(T.about_performance(F.col("text"))).select("doc_id")


@query("WITH k AS (SELECT unnest([" + ",".join(f"'{w}'" for w in _WORDS) + "]) AS word) SELECT word, count(*) AS n FROM documents, k WHERE contains(lower(text), word) GROUP BY 1")
def keyword_hits(spark, d):
    return table(spark, d, "documents").select(F.explode(T.keyword_hits(F.col("text"), _WORDS)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN contains(lower(text),' was ') OR contains(lower(text),'perf') WHEN 'de' THEN contains(text,'Der ') END AS hit FROM documents")
def rule_dispatch(spark, d):
    r = curation.rules(spark, [("en", [], [" was ", "perf"], True), ("de", [], ["Der "], False)])
    docs = table(spark, d, "documents").select("doc_id", "lang", F.col("text").alias("title"))
    return curation.by_rule(docs, r, "lang", "title").select("doc_id", "hit")


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_name, 'e[a-d]')")
def regex_subset(spark, d):
    return table(spark, d, "part").where(F.col("p_name").rlike("e[a-d]")).select("p_partkey")


@query("WITH o AS (SELECT l_orderkey, list(l_returnflag) AS f FROM lineitem GROUP BY 1) SELECT l_orderkey, NOT list_contains(list_transform(f, lambda x: x='N'), false) AS all_n, list_contains(f,'R') AS any_r FROM o")
def array_all_any(spark, d):
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("f"))
    return o.select("l_orderkey", F.forall("f", lambda x: x == "N").alias("all_n"), F.exists("f", lambda x: x == "R").alias("any_r"))


@query("SELECT doc_id, (len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END)::BIGINT AS lines, len(list_filter(string_split(text, chr(10)), lambda x: (x LIKE '+%' AND x NOT LIKE '+++%') OR (x LIKE '-%' AND x NOT LIKE '---%')))::BIGINT AS changed FROM documents")
def token_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", D.total_lines(F.col("text")).alias("lines"), D.changed_lines(F.col("text")).alias("changed"))


@query("SELECT page_id, len(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1))::INT AS links, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1))), ' ') AS names FROM pages")
def regex_extract_all(spark, d):
    found = F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.size(found).alias("links"), F.array_join(F.array_sort(F.array_distinct(found)), " ").alias("names"))


_STRIP = "regexp_replace(html, '<!--.*?-->', '', 'gs')"
for _pattern, _to, _opt in (("<(script|style)[^>]*>.*?</(script|style)>", " ", "gis"), ("<[^>]*>", " ", "g"), ("&lt;", "<", "g"), ("&gt;", ">", "g"), ("&nbsp;", " ", "g"), ("&amp;", "&", "g"), (r"[\s\x0b]+", " ", "g")):
    _STRIP = f"regexp_replace({_STRIP}, '{_pattern}', '{_to}', '{_opt}')"


@query(f"SELECT page_id, md5(trim({_STRIP})) AS digest FROM pages")
def html_strip(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(T.plain_html(F.col("html"))).alias("digest"))


@query("SELECT s_suppkey, 'acme' AS owner, 'eng-ine' AS repo, s_suppkey::VARCHAR AS number, 'https://host/acme/eng-ine/pull/' || s_suppkey AS url FROM supplier")
def id_parse(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("acme__eng-ine-"), F.col("s_suppkey").cast("string")).alias("id"))
    return s.select("s_suppkey", T.id_parts(F.col("id")).alias("p"), T.pull_url(F.col("id"), "https://host").alias("url")).select("s_suppkey", "p.*", "url")


@query("SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM orders")
def date_parse(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "MMMM d, yyyy").alias("text"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).cast("string").alias("ms"))
    return o.select("o_orderkey", T.release_date(F.col("text")).cast("string").alias("day"), T.iso_from_millis(F.col("ms")).alias("iso"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (json_extract_string(props, '$.' || k) IS NOT NULL) AS with_key FROM events, (SELECT min(j) AS k FROM (SELECT unnest(json_keys(props)) AS j FROM events)) GROUP BY 1")
def json_status(spark, d):
    e = table(spark, d, "events").select("event_type", F.from_json("props", "map<string,string>").alias("m"))
    first = e.select(F.explode(F.map_keys("m")).alias("k")).agg(F.min("k").alias("k"))
    return e.crossJoin(F.broadcast(first)).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.try_element_at("m", F.col("k")).isNotNull()).alias("with_key"))


@query("SELECT doc_id, left(sha256(array_to_string(string_split(text, chr(10)), chr(10))), 22) AS key FROM documents")
def hash_key(spark, d):
    return table(spark, d, "documents").select("doc_id", T.script_key(F.split("text", "\n")).alias("key"))


@query(
    """WITH w AS (SELECT source, list_distinct(list(word)) AS ws FROM (SELECT source, unnest(string_split(text,' ')) AS word FROM documents) GROUP BY 1),
    p AS (SELECT a.source AS a, b.source AS b, len(list_intersect(a.ws,b.ws)) AS i, len(a.ws) AS x, len(b.ws) AS y FROM w a JOIN w b ON a.source<b.source)
    SELECT a, b, round(i/(x+y-i),4) AS jaccard, round(i/y,4) AS precision, round(i/x,4) AS recall FROM p"""
)
def jaccard_files(spark, d):
    words = table(spark, d, "documents").select("source", F.explode(F.split("text", " ")).alias("word")).distinct()
    sizes = words.groupBy("source").agg(F.count("*").alias("n"))
    # A word's sources, which are few, are paired; no vocabulary stands in one row.
    pairs = words.groupBy("word").agg(F.array_sort(F.collect_set("source")).alias("s")).where(F.size("s") > 1)
    pairs = pairs.select(F.explode(F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("i"))
    of = lambda k, n: F.broadcast(sizes.select(F.col("source").alias(k), F.col("n").alias(n)))
    every = of("a", "x").crossJoin(of("b", "y")).where("a < b").join(pairs, ["a", "b"], "left").withColumn("i", F.coalesce("i", F.lit(0)))
    return every.select("a", "b", _round(F.col("i") / (F.col("x") + F.col("y") - F.col("i"))).alias("jaccard"), _round(F.col("i") / F.col("y")).alias("precision"), _round(F.col("i") / F.col("x")).alias("recall"))


@query(
    """WITH g AS (SELECT n_regionkey AS r, l_suppkey AS file, l_partkey AS func, sum(CASE WHEN l_returnflag='R' THEN l_quantity ELSE -l_quantity END) AS e, sum(CASE WHEN l_linestatus='F' THEN l_quantity ELSE -l_quantity END) AS o
    FROM lineitem JOIN supplier ON l_suppkey=s_suppkey JOIN nation ON s_nationkey=n_nationkey GROUP BY 1,2,3),
    f AS (SELECT r, file FROM g WHERE o>0 GROUP BY 1,2), x AS (SELECT g.*, f.file IS NOT NULL AS hf FROM g LEFT JOIN f USING (r,file) WHERE e>0)
    SELECT r, round(sum(e) FILTER (hf)/sum(e),4) AS file_coverage, round(coalesce(sum(e) FILTER (o>0),0)/sum(e),4) AS func_coverage, round(1-sum(e) FILTER (hf)/sum(e),4) AS wrong_file_loss FROM x GROUP BY 1"""
)
def loss_decomposition(spark, d):
    items = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.expr("l_suppkey = s_suppkey")).join(F.broadcast(table(spark, d, "nation")), F.expr("s_nationkey = n_nationkey"))
    of = lambda c, v: items.groupBy(F.col("n_regionkey").alias("r"), F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("func")).agg(F.sum(F.when(F.col(c) == v, F.col("l_quantity")).otherwise(-F.col("l_quantity"))).alias("gain"))
    out = A.expert_coverage(of("l_returnflag", "R"), of("l_linestatus", "F"), ["r"])
    return out.select("r", *[_round(c).alias(c) for c in ("file_coverage", "func_coverage", "wrong_file_loss")])


@query(
    """WITH u AS (SELECT role AS model, sum(length(text)//4)::BIGINT AS i, sum(length(text)//16)::BIGINT AS w, sum(length(text)//32)::BIGINT AS h, sum(length(text)//8)::BIGINT AS o FROM conversations GROUP BY 1)
    SELECT model, round(((i-w-h)*3.0 + w*3.75 + h*0.3 + o*15.0)/1000000, 6)::DOUBLE AS cost FROM u"""
)
def decimal_cost(spark, d):
    n = F.length("text").cast("long")
    part = lambda k: F.sum(F.expr(f"length(text) div {k}")).cast("long")
    u = table(spark, d, "conversations").groupBy(F.col("role").alias("model")).agg(part(4).alias("input"), part(16).alias("cache_write"), part(32).alias("cache_read"), part(8).alias("output")).withColumn("cache_write_hour", F.lit(0).cast("long"))
    from decimal import Decimal

    rows = [(r, *(Decimal(x) for x in ("3", "3.75", "6", "0.3", "15"))) for r in ("user", "assistant", "system", "tool")]
    prices = spark.createDataFrame(rows, "model string, base_in decimal(12,6), write_5m decimal(12,6), write_1h decimal(12,6), hit decimal(12,6), out decimal(12,6)")
    return A.priced(u, prices, "model").select("model", F.round("total_cost", 6).cast("double").alias("cost"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)),1) AS pos FROM documents),
    r AS (SELECT doc_id, pos, string_split(x,' ')[1] AS name, CASE WHEN length(x)%3=0 THEN 'PASSED' WHEN length(x)%3=1 THEN 'FAILED' ELSE 'ERROR' END AS status FROM l WHERE regexp_matches(x, '^[A-Za-z]+ '))
    SELECT doc_id, name AS test, arg_max(status, pos) AS status FROM r GROUP BY 1,2"""
)
def log_parser_pytest(spark, d):
    line = lambda x: F.when(x.rlike("^[A-Za-z]+ "), F.concat(F.when(F.length(x) % 3 == 0, "PASSED ").when(F.length(x) % 3 == 1, "FAILED ").otherwise("ERROR "), F.split(x, " ")[0], F.lit(" - more"))).otherwise("# other")
    logs = table(spark, d, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("log"))
    return L.parse(logs, "doc_id", "pytest")


# ------------------------------------------------------------------ graph, choice, samples, streams


def _edges(spark, d):
    i = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    part, supp = F.concat(F.lit("p"), F.col("l_partkey")), F.concat(F.lit("s"), F.col("l_suppkey"))
    return i.where("(l_partkey + l_suppkey) % 2 = 0").select(part.alias("caller"), supp.alias("callee")).unionAll(i.where("(l_partkey + l_suppkey) % 2 = 1").select(supp.alias("caller"), part.alias("callee")))


_REACH = """WITH RECURSIVE i AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem),
e AS (SELECT 'p'||l_partkey AS a, 's'||l_suppkey AS b FROM i WHERE (l_partkey+l_suppkey)%2=0 UNION ALL SELECT 's'||l_suppkey, 'p'||l_partkey FROM i WHERE (l_partkey+l_suppkey)%2=1),
r AS (SELECT 'p1' AS node, 0 AS depth UNION SELECT b, depth+1 FROM r JOIN e ON a=node WHERE depth<6)
"""


@query(_REACH + "SELECT DISTINCT node FROM r")
def graph_reach(spark, d):
    return G.reachable(_edges(spark, d), spark.createDataFrame([("p1",)], "node string"), most=6)


@query(_REACH + "SELECT node, min(depth)::INT AS depth FROM r GROUP BY 1")
def graph_depth(spark, d):
    return G.depths(_edges(spark, d), spark.createDataFrame([("p1",)], "node string"), most=6)


@query(
    """WITH RECURSIVE n AS (SELECT l_suppkey AS profile, l_partkey AS node, max(l_linenumber) AS depth, sum(l_quantity) AS gain FROM lineitem GROUP BY 1,2),
    o AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY depth DESC, gain DESC, node) AS i, 0.8::DOUBLE*sum(gain) OVER (PARTITION BY profile) AS goal FROM n),
    r(profile, i, got, banned, node, rank, took) AS (SELECT DISTINCT profile, 0::BIGINT, 0::DOUBLE, []::BIGINT[], NULL::BIGINT, 0, false FROM o UNION ALL
      SELECT profile, i, CASE WHEN t THEN got+gain ELSE got END, CASE WHEN t THEN list_append(banned, (node+1)::BIGINT) ELSE banned END, node::BIGINT, rank+t::INT, t
      FROM (SELECT r.profile, o.i, r.got, r.banned, o.node, o.gain, r.rank, r.got<o.goal AND o.gain>0 AND NOT list_contains(r.banned, o.node::BIGINT) AS t FROM r JOIN o ON r.profile=o.profile AND o.i=r.i+1))
    SELECT profile, node, rank FROM r WHERE took"""
)
def greedy_select(spark, d):
    i = table(spark, d, "lineitem")
    nodes = i.groupBy(F.col("l_suppkey").alias("profile"), F.col("l_partkey").alias("node")).agg(F.max("l_linenumber").alias("depth"), F.sum("l_quantity").alias("gain"), F.array_distinct(F.collect_list(F.col("l_partkey") + 1)).alias("ancestors"))
    return O.greedy_cover(nodes, "profile", 0.8)


@query(
    """WITH e AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders), r AS (SELECT o_orderkey, least(greatest(floor(20.0*(ln(o_totalprice)-ln(a))/(ln(b)-ln(a))),0),19)::INT AS bin FROM orders, e),
    z AS (SELECT bin, count(*) AS n, count(*)*100.0::DOUBLE/(SELECT count(*) FROM r) AS share FROM r GROUP BY 1), q AS (SELECT bin, floor(share) + (row_number() OVER (ORDER BY share-floor(share) DESC, bin) <= 100 - sum(floor(share)) OVER ())::INT AS quota FROM z),
    k AS (SELECT o_orderkey, bin, row_number() OVER (PARTITION BY bin ORDER BY md5(o_orderkey::VARCHAR || 's'), o_orderkey) AS i FROM r) SELECT o_orderkey, k.bin FROM k JOIN q ON k.bin=q.bin WHERE i<=quota"""
)
def stratified_sample(spark, d):
    o = S.binned(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "bin")
    return S.stratified(o, "o_orderkey", "bin", 100, "s").select("o_orderkey", "bin")


def _three_way_sql() -> str:
    bins, picks = [], []
    for i, (c, n) in enumerate((("size", 30), ("price", 30))):
        bins.append(f"least(greatest(floor(20.0*(ln({c})-(SELECT ln(min({c})) FROM i))/(SELECT ln(max({c}))-ln(min({c})) FROM i)),0),19)::INT AS bin_{i}")
        picks.append(
            f"""z{i} AS (SELECT bin_{i} AS b, count(*)*{n}.0::DOUBLE/(SELECT count(*) FROM r) AS share FROM r GROUP BY 1), q{i} AS (SELECT b, floor(share) + (row_number() OVER (ORDER BY share-floor(share) DESC, b) <= {n} - sum(floor(share)) OVER ())::INT AS quota FROM z{i}),
            k{i} AS (SELECT k FROM (SELECT k, bin_{i} AS b, row_number() OVER (PARTITION BY bin_{i} ORDER BY md5(k::VARCHAR || 'wbin_{i}'), k) AS i FROM r) x JOIN q{i} USING (b) WHERE i<=quota)"""
        )
    return f"""WITH i AS (SELECT p_partkey AS k, p_size::DOUBLE AS size, p_retailprice::DOUBLE AS price FROM part), r AS (SELECT *, {', '.join(bins)} FROM i), {', '.join(picks)},
    c AS (SELECT k FROM k0 UNION SELECT k FROM k1), u AS (SELECT r.*, count(*) OVER (PARTITION BY bin_0) AS c0, count(*) OVER (PARTITION BY bin_1) AS c1, (('0x'||left(md5(k::VARCHAR||'w'),12))::UBIGINT::DOUBLE+1)/281474976710656.0 AS x FROM r WHERE k NOT IN (SELECT k FROM c)),
    m AS (SELECT k FROM u ORDER BY -ln(x)/(1.0/c0/c1), k LIMIT 60), a AS (SELECT k, 0 AS o FROM c UNION ALL SELECT k, 1 FROM m)
    SELECT k AS p_partkey, size, price, bin_0, bin_1 FROM (SELECT * FROM a ORDER BY o, md5(k::VARCHAR||'w'), k LIMIT 60) JOIN r USING (k)"""


@query(_three_way_sql())
def weighted_sample(spark, d):
    i = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return S.three_way(i, "p_partkey", ["size", "price"], 60, "w")


@query("SELECT o_orderkey, ntile(7) OVER (ORDER BY o_orderkey)::INT AS split FROM orders")
def split_ntile(spark, d):
    return S.splits(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 7)


@query(
    """WITH t AS (SELECT n_regionkey AS r, 'n'||n_nationkey AS node, count(*)::DOUBLE AS total FROM customer JOIN nation ON c_nationkey=n_nationkey GROUP BY 1,2),
    p AS (SELECT r, sum(total) AS total FROM t GROUP BY 1), px AS (SELECT r, coalesce(sum(total) OVER (ORDER BY 'r'||r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS x, total FROM p)
    SELECT 'r'||r AS node, 0 AS depth, x::DOUBLE AS x FROM px UNION ALL SELECT t.node, 1, (px.x + coalesce(sum(t.total) OVER (PARTITION BY t.r ORDER BY t.node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0))::DOUBLE FROM t JOIN px ON t.r=px.r"""
)
def profile_tree(spark, d):
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.expr("c_nationkey = n_nationkey"))
    leaf = c.groupBy("n_regionkey", "n_nationkey").agg(F.count("*").cast("double").alias("total"))
    region = F.concat(F.lit("r"), F.col("n_regionkey"))
    tree = leaf.select(F.lit(0).alias("g"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("node"), region.alias("parent"), "total")
    tree = tree.unionByName(leaf.groupBy(region.alias("node")).agg(F.sum("total").alias("total")).select(F.lit(0).alias("g"), "node", F.lit(None).cast("string").alias("parent"), "total"))
    return O.layout(tree, ["g"]).select("node", "depth", "x")


@query("SELECT user_id, event_type, min(event_id) AS first_event FROM events GROUP BY 1,2")
def seen_first(spark, d):
    return J.first_by(table(spark, d, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", F.col("event_id").alias("first_event"))


@query("SELECT event_id FROM events WHERE NOT (event_type = 'purchase' AND coalesce(value, 0) <= 50)")
def pending_tasks(spark, d):
    from perfloom.streaming.increments import pending

    e = table(spark, d, "events").select("event_id", "event_type", "value", F.col("props").alias("text"))
    results = e.where("event_type = 'purchase'").withColumn("text", F.when(F.coalesce("value", F.lit(0.0)) <= 50, F.col("text")).otherwise("changed"))
    return pending(e, results, "event_id", "text").select("event_id")


@query("SELECT c_mktsegment, round(avg(c_acctbal),4) AS c_acctbal_mean, min(c_acctbal) AS c_acctbal_min, max(c_acctbal) AS c_acctbal_max, count(c_acctbal) AS c_acctbal_count FROM customer GROUP BY 1")
def column_statistics(spark, d):
    s = A.statistics(table(spark, d, "customer"), ["c_acctbal"], ["c_mktsegment"])
    return s.withColumn("c_acctbal_mean", _round("c_acctbal_mean"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY 1,2")
def group_counts(spark, d):
    return A.counts(table(spark, d, "documents"), ["lang", "source"])


@query("SELECT count(*)::BIGINT AS count, round(avg(length(text)),3) AS mean, round(stddev_samp(length(text)),3) AS sd, min(length(text))::DOUBLE AS min, quantile_cont(length(text)::DOUBLE,0.25) AS q25, quantile_cont(length(text)::DOUBLE,0.5) AS q50, quantile_cont(length(text)::DOUBLE,0.75) AS q75, max(length(text))::DOUBLE AS max FROM documents")
def length_summary(spark, d):
    s = A.length_summary(table(spark, d, "documents"), "text")
    return s.withColumn("mean", _round("mean", 3)).withColumn("sd", _round("sd", 3))


@query("SELECT l_suppkey, round(sum(l_quantity*l_linenumber) FILTER (l_quantity>10)/sum(l_quantity) FILTER (l_quantity>10),4) AS depth FROM lineitem GROUP BY 1")
def weighted_depth(spark, d):
    w = F.when(F.col("l_quantity") > 10, F.col("l_quantity"))
    depth, _ = A.weighted_depth(w, F.col("l_linenumber"))
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(depth).select("l_suppkey", _round("depth").alias("depth"))


# ------------------------------------------------------------------ selection, lookups and small formats


@query("SELECT c_custkey AS instance_id, 'w' || max(o_orderkey) AS workload FROM customer JOIN orders ON o_custkey=c_custkey WHERE o_orderstatus IN ('F','O') GROUP BY 1")
def approved_workloads(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus in ('F', 'O')").groupBy(F.col("o_custkey").alias("instance_id")).agg(F.max("o_orderkey").alias("k"))
    sheet = o.select("instance_id", F.lit("APPROVED").alias("status"), F.concat(F.lit("w"), F.col("k")).alias("workload"))
    return J.approved(table(spark, d, "customer").select(F.col("c_custkey").alias("instance_id"), F.lit("").alias("workload")), sheet, "instance_id")


@query("SELECT c_custkey, CASE WHEN c_acctbal<0 THEN '' WHEN c_mktsegment='BUILDING' THEN 'new' ELSE '' END AS workload FROM customer")
def overridden_workloads(spark, d):
    c = table(spark, d, "customer").withColumn("workload", F.lit("old"))
    new = c.where("c_mktsegment = 'BUILDING'").withColumn("workload", F.when(F.col("c_acctbal") < 0, "nan").otherwise("new"))
    return J.overridden(c, new, "c_custkey", "workload").select("c_custkey", "workload")


@query("SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT month(l_shipdate)) = 12")
def in_all_runs(spark, d):
    return J.in_all_runs(table(spark, d, "lineitem").withColumn("run", F.month("l_shipdate")), "l_partkey", "run", 12)


@query("WITH a AS (SELECT o_orderkey AS id, o_orderstatus AS x, left(o_orderpriority,1) AS y, (o_totalprice>100000) AS ok FROM orders) SELECT count(*) AS n, count(*) FILTER ((x='F') <> (y IN ('1','2'))) AS different FROM a WHERE ok")
def disagreements(spark, d):
    from perfloom.plans import selection

    o = table(spark, d, "orders").withColumnRenamed("o_orderkey", "instance_id")
    a = o.select("instance_id", (F.col("o_orderstatus") == "F").alias("label"))
    b = o.select("instance_id", F.left("o_orderpriority", F.lit(1)).isin("1", "2").alias("label"))
    return selection.disagreements(a, b, "label", o.select("instance_id", (F.col("o_totalprice") > 100000).cast("double").alias("correctness"))).select("n", "different")


@query("WITH t AS (SELECT l_suppkey AS s, l_linestatus AS g, avg(l_quantity) AS m, stddev_samp(l_quantity) AS sd FROM lineitem GROUP BY 1,2) SELECT a.s, a.m-b.m > greatest(a.sd,b.sd) AS faster FROM t a JOIN t b ON a.s=b.s AND a.g='F' AND b.g='O'")
def one_sigma(spark, d):
    t = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s"), "l_linestatus").agg(F.avg("l_quantity").alias("m"), F.stddev_samp("l_quantity").alias("sd"))
    a, b = t.where("l_linestatus = 'F'").selectExpr("s", "m m1", "sd sd1"), t.where("l_linestatus = 'O'").selectExpr("s", "m m2", "sd sd2")
    return a.join(b, "s").select("s", A.one_sigma_faster(F.col("m1"), F.col("sd1"), F.col("m2"), F.col("sd2")).alias("faster"))


@query("WITH t AS (SELECT unnest([0.0, 50000.0, 150000.0, 300000.0, 1e9])::DOUBLE AS threshold) SELECT threshold, round(count(o_orderkey)/sum(1/greatest(o_custkey,1)) FILTER (o_orderkey IS NOT NULL),4) AS prefix_mean FROM t LEFT JOIN orders ON o_totalprice<=threshold GROUP BY 1")
def curve_at_thresholds(spark, d):
    o = table(spark, d, "orders").select(F.col("o_totalprice").alias("x"), F.greatest(F.col("o_custkey"), F.lit(1)).cast("double").alias("ratio"))
    t = spark.createDataFrame([(v,) for v in (0.0, 50000.0, 150000.0, 300000.0, 1e9)], "threshold double")
    return O.at_thresholds(O.prefix_harmonic(o, "x", "ratio"), F.broadcast(t), "x", "prefix_mean").select("threshold", _round("prefix_mean").alias("prefix_mean"))


@query("SELECT o_orderkey, o_orderkey::VARCHAR || ' ' || (o_orderkey+1)::VARCHAR AS issues FROM orders")
def issue_references(spark, d):
    k = F.col("o_orderkey")
    text = F.concat(F.lit("Fixes #"), k, F.lit(", see #5 <!-- fixes #0 -->\nand it closes #"), k + 1)
    return table(spark, d, "orders").select("o_orderkey", F.array_join(T.issue_references(text), " ").alias("issues"))


@query("SELECT s_suppkey, s_suppkey || ' ' || (s_suppkey+1) || ' ' || (s_suppkey+2) || ' ' || (s_suppkey+9) AS cpus, (s_suppkey%7) || '.' || (s_suppkey%5) AS version FROM supplier")
def cpu_lists_and_versions(spark, d):
    s = F.col("s_suppkey")
    cpus = T.cpu_list(F.concat(s, F.lit("-"), s + 2, F.lit(","), s + 9))
    version = T.major_minor(F.concat(F.lit("v"), s % 7, F.lit("."), s % 5, F.lit(".1rc2")))
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(F.transform(cpus, lambda x: x.cast("string")), " ").alias("cpus"), version.alias("version"))


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: contains(x, ' the '))) AS hits FROM documents WHERE length(text) - length(replace(text, chr(10), '')) < 5")
def short_texts(spark, d):
    from perfloom.plans import selection

    docs = table(spark, d, "documents").where(~F.col("text").endswith("\n"))
    return selection.short_patches(docs, "text", "text", 5).select("doc_id", F.size(F.filter(F.split("text", "\n"), lambda x: F.contains(x, F.lit(" the ")))).cast("long").alias("hits"))


@query("SELECT l_suppkey, l_linestatus AS bin, count(*) AS n FROM lineitem GROUP BY 1,2")
def bin_counts(spark, d):
    return A.histogram(table(spark, d, "lineitem"), F.col("l_linestatus"), ["l_suppkey"])


# The queries on records register themselves here.
from perfloom.plans import catalog_depth, catalog_logs, catalog_patches, catalog_records  # noqa: E402, F401
