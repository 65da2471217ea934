"""Queries whose work goes in rounds, in runs of a stream, or over ranges of any length, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perfloom.operators import aggregates as A
from perfloom.operators import graph as G
from perfloom.operators import joins as J
from perfloom.operators import ordered as O
from perfloom.operators import ranges as I
from perfloom.operators import sampling as S
from perfloom.plans.catalog import query
from perfloom.sources import sinks as K
from perfloom.sources.paged import StagedPages, listing
from perfloom.sources.readers import table
from perfloom.streaming.increments import Results, append_unseen


def _folder(spark: SparkSession) -> str:
    G.checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/runs-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ references


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers stand for files and days for lines: an order's line leads from its supplier and ship day to the next line's supplier, from that one's ship day on for as many days as its quantity."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    i = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", day.alias("day"), F.col("l_quantity").cast("long").alias("n"))
    after = i.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_suppkey").alias("to_file"), F.col("day").alias("start"), (F.col("day") + F.col("n")).alias("end"))
    name = lambda c: F.concat(F.lit("s"), c)
    refs = i.join(after, ["l_orderkey", "l_linenumber"]).select(name("l_suppkey").alias("file"), F.col("day").alias("line"), name("to_file").alias("to_file"), "start", "end")
    tests = table(spark, d, "supplier").where("s_acctbal > 5000").select(name("s_suppkey").alias("test"), F.lit(1500).cast("long").alias("start"), F.lit(1540).cast("long").alias("end"))
    return refs, tests


_REFERENCES = """i AS (SELECT l_orderkey AS o, l_linenumber AS n, 's'||l_suppkey AS file, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS day, l_quantity::BIGINT AS q FROM lineitem),
refs AS (SELECT a.file, a.day AS line, b.file AS to_file, b.day AS s, b.day + b.q AS e FROM i a JOIN i b ON a.o = b.o AND b.n = a.n + 1),
tests AS (SELECT 's'||s_suppkey AS test FROM supplier WHERE s_acctbal > 5000),
v(test, file, line, depth) AS (SELECT test, test, unnest(range(1500, 1541)), 0 FROM tests UNION
    SELECT v.test, to_file, unnest(range(s, e + 1)), depth + 1 FROM v JOIN refs ON v.file = refs.file AND v.line = refs.line WHERE depth <= 2)"""


@query(f"WITH RECURSIVE {_REFERENCES} SELECT test, file, count(DISTINCT line) AS lines, min(line) AS first, max(line) AS last FROM v GROUP BY 1,2")
def referenced_ranges(spark, d):
    refs, tests = _references(spark, d)
    out = G.referenced_ranges(refs, tests, 2)
    return out.groupBy("test", "file").agg(F.sum(F.expr("end - start + 1")).alias("lines"), F.min("start").alias("first"), F.max("end").alias("last"))


@query(f"WITH RECURSIVE {_REFERENCES}, h AS (SELECT 's'||ps.k AS file, unnest(range(a, a + 3)) AS line FROM (SELECT l_suppkey AS k, min(date_diff('day', DATE '1992-01-01', l_shipdate::DATE)) + 900 AS a FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ps) SELECT DISTINCT v.test FROM v JOIN h USING (file, line)")
def tests_touching_hunks(spark, d):
    refs, tests = _references(spark, d)
    first = F.min(F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))).cast("long") + 900
    hunks = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.concat(F.lit("s"), "l_suppkey").alias("file")).agg(first.alias("start")).withColumn("end", F.col("start") + 2)
    return G.referenced_ranges(refs, tests, 2, hunks=hunks).select("test").distinct()


# ------------------------------------------------------------------ ranges of any length


def _charges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Lineitems as ranges of cents, from the price on for as much as discount and tax come to: from 1 to 10^9 and more."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    i = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", cents.alias("at"))
    width = F.when(F.col("l_linenumber") == 1, F.col("at") * 300).otherwise(F.pmod("at", F.lit(5000)))
    spans = i.where("l_linenumber < 3").select("l_suppkey", F.col("l_orderkey").alias("span"), F.col("l_linenumber").alias("n"), F.col("at").alias("s"), (F.col("at") + width).alias("e"))
    return i.where("l_linenumber > 2").select("l_suppkey", F.col("l_orderkey").alias("point"), F.col("l_linenumber").alias("m"), "at"), spans


_CHARGES = """c AS (SELECT l_suppkey AS k, l_orderkey AS o, l_linenumber AS n, round(l_extendedprice*100)::BIGINT AS cents FROM lineitem),
p AS (SELECT * FROM c WHERE n > 2), s AS (SELECT k, o, n, cents AS s, cents + CASE WHEN n = 1 THEN cents*300 ELSE cents % 5000 END AS e FROM c WHERE n < 3)"""


@query(f"WITH {_CHARGES} SELECT p.o AS point, p.n AS m, arg_min(s.o, {{'w': e - s, 's': s, 'o': s.o}}) AS span FROM p JOIN s ON p.k = s.k AND cents BETWEEN s AND e GROUP BY p.k, p.o, p.n, p.cents")
def smallest_of_any_length(spark, d):
    points, spans = _charges(spark, d)
    return I.smallest_span(points, spans, ["l_suppkey"], "at", "s", "e", "span").select("point", "m", "span")


@query(f"WITH {_CHARGES} SELECT p.o AS point, p.n AS m FROM p WHERE EXISTS (SELECT 1 FROM s WHERE s.k = p.k AND s.s <= p.cents AND p.cents + 20000 <= s.e)")
def contained_of_any_length(spark, d):
    points, spans = _charges(spark, d)
    return I.contained(points.withColumn("to", F.col("at") + 20000), spans, ["l_suppkey"], ("at", "to"), ("s", "e")).select("point", "m")


@query(f"WITH {_CHARGES}, x AS (SELECT k, o, s, e FROM s WHERE n = 2), y AS (SELECT k, o, s, least(e, s + 2000000) AS e FROM s WHERE n = 1) SELECT x.o AS a, y.o AS b FROM x JOIN y ON x.k = y.k AND x.s <= y.e AND y.s <= x.e")
def overlapping_of_any_length(spark, d):
    _, spans = _charges(spark, d)
    x = spans.where("n = 2").select("l_suppkey", F.col("span").alias("a"), F.col("s").alias("s1"), F.col("e").alias("e1"))
    y = spans.where("n = 1").select("l_suppkey", F.col("span").alias("b"), F.col("s").alias("s2"), F.least("e", F.col("s") + 2000000).alias("e2"))
    return I.overlapping(x, y, ["l_suppkey"], ("s1", "e1"), ("s2", "e2")).select("a", "b")


@query(
    f"""WITH {_CHARGES}, q AS (SELECT k, s, e FROM s WHERE n = 2), a AS (SELECT k, cents AS s, cents + 700 AS e FROM p),
    cuts AS (SELECT k, s AS cents FROM q UNION SELECT k, e + 1 FROM q UNION SELECT k, s FROM a UNION SELECT k, e + 1 FROM a),
    piece AS (SELECT k, cents, lead(cents) OVER (PARTITION BY k ORDER BY cents) - 1 AS upto FROM cuts)
    SELECT k AS l_suppkey, sum(upto - cents + 1)::BIGINT AS left FROM piece WHERE upto IS NOT NULL AND EXISTS (SELECT 1 FROM a WHERE a.k = piece.k AND a.s <= cents AND upto <= a.e) AND NOT EXISTS (SELECT 1 FROM q WHERE q.k = piece.k AND q.s <= cents AND upto <= q.e) GROUP BY 1"""
)
def uncovered_lengths(spark, d):
    points, spans = _charges(spark, d)
    a = points.select("l_suppkey", F.col("at").alias("s"), (F.col("at") + 700).alias("e"))
    left = I.uncovered(a, spans.where("n = 2").select("l_suppkey", "s", "e"), ["l_suppkey"], "s", "e")
    return left.groupBy("l_suppkey").agg(F.sum(F.expr("e - s + 1")).alias("left"))


# ------------------------------------------------------------------ as of, without a key and within a hot one


@query("WITH r AS (SELECT ts, max(event_id) AS version FROM events WHERE event_type='signup' GROUP BY 1) SELECT t.event_id, r.version FROM (SELECT event_id, ts FROM events WHERE event_type<>'signup') t ASOF LEFT JOIN r ON t.ts > r.ts")
def asof_without_key(spark, d):
    e = table(spark, d, "events")
    releases = e.where("event_type = 'signup'").select(F.col("ts").alias("released"), F.col("event_id").alias("version"))
    return J.as_of(e.where("event_type <> 'signup'").select("event_id", "ts"), releases, "ts", "released", "version").select("event_id", "version")


@query("WITH r AS (SELECT event_type = 'view' AS k, ts, max(value) AS last FROM events WHERE user_id % 3 = 0 GROUP BY 1,2) SELECT t.event_id, r.last FROM (SELECT event_id, event_type = 'view' AS k, ts FROM events) t ASOF LEFT JOIN r ON t.k = r.k AND t.ts > r.ts")
def asof_hot_key(spark, d):
    e = table(spark, d, "events").withColumn("k", F.col("event_type") == "view")
    releases = e.where("user_id % 3 = 0").select("k", F.col("ts").alias("released"), F.col("value").alias("last"))
    return J.as_of(e.select("event_id", "k", "ts"), releases, "ts", "released", "last", ["k"]).select("event_id", "last")


# ------------------------------------------------------------------ paths


@query("WITH p AS (SELECT page_id, rtrim(regexp_replace(url, '^https?://', ''), '/') AS u FROM pages), q AS (SELECT DISTINCT regexp_replace(u, '^[^/]*/', '') AS v FROM p WHERE page_id % 2 = 0) SELECT page_id FROM p WHERE u <> '' AND EXISTS (SELECT 1 FROM q WHERE v <> '' AND (string_split(u,'/')[-1] = string_split(v,'/')[-1] OR suffix(u, v) OR suffix(v, u)))")
def paths_found(spark, d):
    p = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("u"))
    q = p.where("page_id % 2 = 0").select(F.regexp_replace("u", "^[^/]*/", "").alias("v"))
    return J.among_paths(p, q, "u", "v").select("page_id")


# ------------------------------------------------------------------ increments


@query("WITH e AS (SELECT user_id, event_type, min(CASE WHEN day(ts) <= 15 THEN 1 ELSE 2 END) AS run FROM events GROUP BY 1,2) SELECT user_id, event_type, run FROM e")
def unseen_by_run(spark, d):
    """Two runs over growing input: the second appends only what the first hasn't seen."""
    base = _folder(spark)
    e = table(spark, d, "events").select("user_id", "event_type", "ts")
    for run, part in ((1, F.dayofmonth("ts") <= 15), (2, F.dayofmonth("ts") > 15)):
        e.where(part).withColumn("run", F.lit(run)).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema("user_id long, event_type string, ts timestamp, run int").parquet(f"{base}/in")
        append_unseen(stream, ["user_id", "event_type"], f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("user_id", "event_type", "run")


@query(
    """WITH t AS (SELECT conv_id AS k, coalesce(text, '') AS x, turn FROM conversations WHERE conv_id IS NOT NULL), r AS (SELECT k, x, max(turn) AS turn FROM t GROUP BY 1,2)
    SELECT k AS conv_id, count(*) AS results, max(turn)::INT AS last, md5(string_agg(md5(x), ',' ORDER BY md5(x))) AS texts FROM r GROUP BY 1"""
)
def merged_results(spark, d):
    """Results come in two runs, and all of the first run's batches once more: nothing changes by that."""
    base = _folder(spark)
    schema = "conv_id long, text string, turn int"
    rows = table(spark, d, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), "text", F.col("turn").cast("int").alias("turn"))
    results = Results(spark, f"{base}/results", schema, "conv_id", "text", "turn")
    for part in (F.col("turn") % 2 == 0, F.col("turn") % 2 == 1):
        rows.where(part).write.mode("append").parquet(f"{base}/in")
        results.follow(spark.readStream.schema(schema).parquet(f"{base}/in"), f"{base}/state").awaitTermination()
    results.merge(rows.where(F.col("turn") % 2 == 1), 1)
    return results.read().groupBy("conv_id").agg(F.count("*").alias("results"), F.max("turn").alias("last"), F.md5(F.array_join(F.array_sort(F.collect_list(F.md5(F.coalesce("text", F.lit(""))))), ",")).alias("texts"))


@query("SELECT turn::INT + 1 AS page, conv_id::VARCHAR AS item FROM conversations WHERE turn < (SELECT min(x) FROM (SELECT unnest(range(0, 200)) AS x EXCEPT SELECT turn FROM conversations))")
def paged_source(spark, d):
    """Turns stand for pages, conversations for items."""
    base = _folder(spark)
    table(spark, d, "conversations").where("conv_id is not null").select((F.col("turn") + 1).cast("int").alias("page"), F.col("conv_id").cast("string").alias("value")).repartition("page").write.partitionBy("page").text(base)
    return listing(spark, StagedPages, path=base, pages_per_task=2, tasks=4, pause=0.1).select("page", "item")


# ------------------------------------------------------------------ quantiles, layouts and orders of groups of any size


@query("SELECT l_returnflag, round(unnest(quantile_cont(l_extendedprice, [0.0, 0.1, 0.333, 0.5, 0.9, 1.0])), 4) AS value, unnest(range(6))::INT AS i FROM lineitem GROUP BY 1")
def quantiles_of_hot_groups(spark, d):
    q = O.quantiles_by(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.0, 0.1, 0.333, 0.5, 0.9, 1.0])
    return q.select("l_returnflag", F.posexplode("quantiles").alias("i", "value")).select("l_returnflag", "i", F.round("value", 4).alias("value"))


@query("SELECT l_suppkey, l_linestatus, median(l_quantity) AS m FROM lineitem GROUP BY 1,2")
def medians_of_many_groups(spark, d):
    return O.quantiles_by(table(spark, d, "lineitem"), ["l_suppkey", "l_linestatus"], "l_quantity", [0.5]).select("l_suppkey", "l_linestatus", F.col("quantiles")[0].alias("m"))


@query("WITH e AS (SELECT o_orderpriority AS p, quantile_cont(o_totalprice, 0.15) AS a, max(o_totalprice) AS b FROM orders GROUP BY 1) SELECT p, i::INT AS point, round(exp(ln(a)+i*(ln(b)-ln(a))/9),3) AS threshold FROM e, range(10) t(i)")
def log_grid_by_priority(spark, d):
    return O.log_grid(table(spark, d, "orders").withColumnRenamed("o_orderpriority", "p"), "o_totalprice", 10, by=["p"]).select("p", "point", F.round("threshold", 3).alias("threshold"))


@query(
    """WITH a AS (SELECT 'customer' AS model, c_acctbal AS x FROM customer UNION ALL SELECT 'supplier', s_acctbal FROM supplier), e AS (SELECT list_sort(list_distinct(quantile_cont(x, [0.0,0.2,0.4,0.6,0.8,1.0]))) AS edges FROM a)
    SELECT model, greatest(len(list_filter(edges, lambda y: y < x))-1,0)::INT AS bucket, count(*) AS n FROM a, e GROUP BY 1,2"""
)
def pooled_buckets(spark, d):
    """Both models' values set the edges."""
    of = lambda t, c: table(spark, d, t).select(F.lit(t).alias("model"), F.col(c).alias("x"))
    pooled = of("customer", "c_acctbal").unionByName(of("supplier", "s_acctbal"))
    rows = pooled.crossJoin(F.broadcast(O.quantile_edges(pooled, "x", 5)))
    return rows.groupBy("model", O.bucket_of(F.col("x"), F.col("edges")).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


@query(
    """WITH RECURSIVE o AS (SELECT o_custkey AS k, o_orderkey AS id, round(o_totalprice*100)::BIGINT AS total, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders),
    t AS (SELECT c.k, c.id, p.id AS parent, c.total FROM o c LEFT JOIN o p ON p.k = c.k AND p.i = c.i // 2 AND c.i > 1),
    s AS (SELECT *, coalesce(sum(total) OVER (PARTITION BY k, parent ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ins FROM t),
    r AS (SELECT k, id, 0 AS depth, ins AS x FROM s WHERE parent IS NULL UNION ALL SELECT s.k, s.id, depth + 1, (x + ins)::BIGINT FROM r JOIN s ON s.k = r.k AND s.parent = r.id)
    SELECT k, id AS node, depth, x FROM r"""
)
def layout_of_any_depth(spark, d):
    """A customer's orders as a tree: the i-th in time hangs on the one at half its place."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("node"), "o_orderdate", F.round(F.col("o_totalprice") * 100).alias("total"))
    o = o.withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy("o_orderdate", "node")))
    up = o.select("k", F.col("i").alias("half"), F.col("node").alias("parent"))
    tree = o.withColumn("half", F.expr("case when i > 1 then i div 2 end")).join(up, ["k", "half"], "left").select("k", "node", "parent", "total")
    return O.layout(tree, ["k"]).select("k", "node", "depth", F.col("x").cast("long").alias("x"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey::VARCHAR || '42'), o_orderkey) AS position FROM orders")
def order_positions(spark, d):
    """The places of rows spread by a seeded hash."""
    o = table(spark, d, "orders").select("o_orderkey", S.hash_order(F.col("o_orderkey"), "42").alias("h"))
    return O.positions(o, ["h", "o_orderkey"]).select("o_orderkey", F.col("position").cast("long").alias("position"))


@query(
    """WITH early AS (SELECT user_id, event_type FROM events WHERE day(ts) <= 15), late AS (SELECT user_id, event_type FROM events WHERE day(ts) > 15), u AS (SELECT DISTINCT user_id % 10 AS u FROM early), v AS (SELECT DISTINCT user_id % 10 AS u FROM late),
    a AS (SELECT * FROM early UNION ALL SELECT * FROM late), b AS (SELECT user_id, event_type FROM events)
    SELECT 'halves' AS what, (SELECT count(*) FROM (SELECT * FROM early EXCEPT ALL SELECT * FROM late)) + (SELECT count(*) FROM (SELECT * FROM late EXCEPT ALL SELECT * FROM early)) = 0 AS same UNION ALL
    SELECT 'last digits', (SELECT count(*) FROM (SELECT * FROM u EXCEPT SELECT * FROM v)) + (SELECT count(*) FROM (SELECT * FROM v EXCEPT SELECT * FROM u)) = 0 UNION ALL
    SELECT 'both', (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) + (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) = 0"""
)
def same_rows(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", F.dayofmonth("ts").alias("day"))
    early, late = (e.where(c).drop("day") for c in ("day <= 15", "day > 15"))
    digits = lambda df: df.select((F.col("user_id") % 10).alias("u"))
    pairs = {"halves": A.same_rows(early, late), "last digits": A.same_rows(digits(early), digits(late), as_sets=True), "both": A.same_rows(late.unionByName(early), e.drop("day"))}
    out = None
    for what, row in pairs.items():
        one = row.select(F.lit(what).alias("what"), "same")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT DISTINCT l_partkey AS p_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)")
def missing_parts(spark, d):
    return J.missing(table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey")), table(spark, d, "part").where("p_size < 25").select("p_partkey"), "p_partkey")


# ------------------------------------------------------------------ reruns and shards


@query(
    """WITH r AS (SELECT user_id, event_type, day(ts) > 20 AS again, sum(value) AS value FROM events GROUP BY ALL), again AS (SELECT user_id, event_type, value FROM r WHERE again AND event_type = 'error')
    SELECT user_id, event_type, round(value, 4) AS value, true AS rerun FROM again UNION ALL SELECT user_id, event_type, round(value, 4), false FROM r WHERE NOT again AND (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM again)"""
)
def rerun_results(spark, d):
    """Errors are run again; what was is taken from the rerun."""
    e = table(spark, d, "events").groupBy("user_id", "event_type", (F.dayofmonth("ts") > 20).alias("again")).agg(F.sum("value").alias("value")).withColumn("key", F.struct("user_id", "event_type"))
    first, again = e.where("not again"), e.where("again and event_type = 'error'")
    out = J.rerun_or_first(first, again, "key")
    return out.select("user_id", "event_type", F.round("value", 4).alias("value"), F.col("again").alias("rerun"))


@query("SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def merged_and_removed_shards(spark, d):
    """Shards are gone once they are merged."""
    base = _folder(spark)
    table(spark, d, "documents").select("source", "n_chars").repartition(5).write.json(f"{base}/shards")
    K.merge_shards(spark.read.json(f"{base}/shards"), f"{base}/merged", 400, remove=True)
    left = spark.read.schema("source string, n_chars long").json(f"{base}/shards")
    rows = spark.read.schema("source string, n_chars long").json(f"{base}/merged").unionByName(left)
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
