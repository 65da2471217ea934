"""Reachability and depth over edges (caller, callee), by rounds of joins with the frontier."""

from __future__ import annotations

import tempfile
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perfloom.operators.ranges import covered, overlapping, stabbed, uncovered


def checkpoints(spark: SparkSession) -> None:
    """Makes checkpoint() usable with the folder that spark.checkpoint.dir names; without one, a local session (a test) gets a temporary one, a cluster an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


def depths(edges: DataFrame, roots: DataFrame, by: list[str] | None = None, most: int | None = None) -> DataFrame:
    """by, node, depth: the least number of calls from any root, up to `most` if that is given.

    A round joins the frontier with the edges and leaves out what is known, so cycles end; it stops when nothing is new.
    Edges and rounds are checkpointed, so that no round repeats the ones before.
    """
    checkpoints(edges.sparkSession)
    by = by or []
    e = edges.select(*by, "caller", "callee").distinct().checkpoint()
    known = roots.select(*by, F.col("node")).distinct().withColumn("depth", F.lit(0)).checkpoint()
    frontier = known
    for d in count(1):
        if most is not None and d > most:
            break
        step = frontier.withColumnRenamed("node", "caller").join(e, [*by, "caller"]).select(*by, F.col("callee").alias("node")).distinct()
        frontier = step.join(known.select(*by, "node"), [*by, "node"], "left_anti").withColumn("depth", F.lit(d)).checkpoint()
        if not frontier.take(1):
            break
        known = known.unionByName(frontier)
        if d % 8 == 0:
            known = known.checkpoint()
    return known


def reachable(edges: DataFrame, roots: DataFrame, by: list[str] | None = None, most: int | None = None) -> DataFrame:
    return depths(edges, roots, by, most).drop("depth")


def ancestors(edges: DataFrame, nodes: DataFrame, by: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Everything from which a node is reached, the nodes themselves included."""
    back = edges.select(*(by or []), F.col("callee").alias("caller"), F.col("caller").alias("callee"))
    return reachable(back, nodes, by, most)


def named_roots(nodes: DataFrame, names: list[str], column: str = "node") -> DataFrame:
    """Nodes whose name is one of `names`, in any case."""
    return nodes.where(F.lower(column).isin([n.lower() for n in names])).select(F.col(column).alias("node"))


def heaviest_root(nodes: DataFrame, by: list[str], name: str, value: str, wanted: str) -> DataFrame:
    """by, root: of the nodes called exactly `wanted` the heaviest, else of those that contain it."""
    exact = F.max_by(name, F.when(F.col(name) == wanted, F.struct(F.col(value), F.col(name))))
    near = F.max_by(name, F.when(F.contains(name, F.lit(wanted)), F.struct(F.col(value), F.col(name))))
    return nodes.groupBy(*by).agg(F.coalesce(exact, near).alias("root"))


def referenced_files(references: DataFrame, tests: DataFrame, most: int, wanted: DataFrame | None = None) -> DataFrame:
    """test, file, depth: the files that a test's references lead to, breadth first, at most `most` references beyond the test.

    References are (file, uses). Files of tests are only entered as roots; `wanted` (file) keeps some files of the result.
    """
    of_test = F.contains(F.lower(F.element_at(F.split("callee", "/"), -1)), F.lit("test"))
    edges = references.selectExpr("file caller", "uses callee").where(~of_test)
    roots = tests.select("test", F.col("test").alias("node"))
    checkpoints(references.sparkSession)
    # A frontier of (test, file) pairs: each test searches for itself.
    known = roots.withColumn("depth", F.lit(0)).checkpoint()
    frontier = known
    for d in range(1, most + 1):
        step = frontier.join(edges, F.col("node") == F.col("caller")).select("test", F.col("callee").alias("node")).distinct()
        frontier = step.join(known.select("test", "node"), ["test", "node"], "left_anti").withColumn("depth", F.lit(d)).checkpoint()
        if not frontier.take(1):
            break
        known = known.unionByName(frontier)
        if d % 8 == 0:
            known = known.checkpoint()
    out = known.select("test", F.col("node").alias("file"), "depth")
    return out.join(wanted, "file", "left_semi") if wanted is not None else out


def referenced_ranges(references: DataFrame, tests: DataFrame, most: int, is_test: Column | None = None, followed: Column | None = None, hunks: DataFrame | None = None) -> DataFrame:
    """test, file, start, end: the lines that a test's references lead to, as the fewest closed ranges.

    References are (file, line, to_file, start, end): what stands at that line leads to those lines. Tests are (test, start,
    end), their own files' lines. Each round follows the references on lines that are new to a test: what a test has
    covered already is taken out of the ranges that a round finds before they are followed, so no line is followed twice
    and cycles end. Lines at a depth up to `most` are followed, so those one deeper are the last to be covered. Files where
    `is_test` holds (of the column file) are only entered as roots; where `followed` doesn't, lines are covered but lead
    nowhere. With `hunks` (file, start, end) only tests remain whose lines touch one.
    """
    checkpoints(references.sparkSession)
    keys = ["test", "file"]
    is_test = F.contains(F.lower(F.element_at(F.split("file", "/"), -1)), F.lit("test")) if is_test is None else is_test
    ends = references.select(F.col("to_file").alias("file"), F.struct("start", "end").alias("_to"), F.col("file").alias("_from"), "line").where(~is_test)
    edges = ends.select(F.col("_from").alias("file"), "line", F.col("file").alias("_file"), "_to").checkpoint()
    known = covered(tests.select("test", F.col("test").alias("file"), "start", "end"), keys, "start", "end").checkpoint()
    frontier = known
    for depth in range(most + 1):
        active = frontier if followed is None else frontier.where(followed)
        hits = stabbed(edges, active.select("test", "file", F.col("start").alias("_a"), F.col("end").alias("_b")), ["file"], "line", "_a", "_b")
        found = hits.select("test", F.col("_file").alias("file"), "_to.start", "_to.end").distinct()
        frontier = uncovered(found, known, keys, "start", "end").checkpoint()
        if not frontier.take(1):
            break
        known = covered(known.unionByName(frontier), keys, "start", "end")
        # The last round's lines are not followed, and nothing reads them twice.
        known = known.checkpoint() if depth < most else known
    if hunks is None:
        return known
    touched = overlapping(known, hunks.select("file", F.col("start").alias("_a"), F.col("end").alias("_b")), ["file"], ("start", "end"), ("_a", "_b"))
    return known.join(touched.select("test").distinct(), "test", "left_semi")
