"""Sources of records. All but the profile and coverage readers are Spark's own."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfloom import schemas
from perfloom.operators.joins import keep, require


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dataset(spark: SparkSession, path: str, ids: list[str] | None = None, schema: str = schemas.INSTANCE) -> DataFrame:
    """Instances from .json, .jsonl or Parquet; with `ids` only these, and an error if one is missing."""
    if path.endswith((".jsonl", ".jsonl.all")):
        rows = spark.read.schema(schema).json(path)
    elif path.endswith(".json"):
        rows = spark.read.schema(schema).option("multiLine", True).json(path)
    else:
        rows = spark.read.parquet(path)
    if ids is None:
        return rows
    wanted = spark.createDataFrame([(i,) for i in ids], "instance_id string")
    require(wanted, rows, "instance_id", "instances")
    return keep(rows, wanted, "instance_id")


def lists_as_arrays(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns that hold a list, or a list as JSON text; what can't be read is an empty list."""
    kinds = dict(rows.dtypes)
    empty = F.array().cast("array<string>")
    return rows.withColumns({c: F.coalesce(F.from_json(c, "array<string>") if kinds[c] == "string" else F.col(c), empty) for c in columns})


def lenient_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Malformed and blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def strict_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions from JSONL; a row without an id or a model is an error."""
    rows = spark.read.schema(schemas.PREDICTION).json(path)
    bad = F.col("instance_id").isNull() | F.col("model_name_or_path").isNull()
    return rows.withColumn("instance_id", F.when(bad, F.raise_error(F.lit("a prediction lacks a required key"))).otherwise(F.col("instance_id")))


def keyed_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions from one JSON object keyed by instance."""
    text = spark.read.text(path, wholetext=True)
    body = F.from_json("value", f"map<string,struct<{schemas.PREDICTION.replace(' string', ':string')}>>")
    return text.select(F.explode(body).alias("_id", "p")).select(F.coalesce("p.instance_id", "_id").alias("instance_id"), "p.model_patch", "p.model_name_or_path")


def trajectory_predictions(runs: DataFrame, known: DataFrame) -> DataFrame:
    """Predictions of agents' trajectories: those with metadata, for known instances; the model is its folder's last part."""
    rows = keep(runs.where("metadata is not null"), known, "instance_id")
    return rows.select("instance_id", F.coalesce("test_result.git_patch", F.lit("")).alias("model_patch"), F.element_at(F.split("metadata.eval_output_dir", "/"), -1).alias("model_name_or_path"))


def fixed_predictions(instances: DataFrame, gold: bool) -> DataFrame:
    """Expert patches, or empty ones."""
    return instances.select("instance_id", F.col("patch").alias("model_patch") if gold else F.lit("").alias("model_patch"), F.lit("gold" if gold else "empty").alias("model_name_or_path"))


def result_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """run_id, model, instance_id, text of the files `name` in root/<run_id>/<model>/<instance_id>/."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root, wholetext=True)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return files.select(F.element_at(parts, -4).alias("run_id"), F.element_at(parts, -3).alias("model"), F.element_at(parts, -2).alias("instance_id"), F.col("value").alias("text"))


def status_maps(files: DataFrame) -> DataFrame:
    """With `status`: the map test -> status of each file's JSON."""
    return files.withColumn("status", F.from_json("text", "map<string,string>"))


def nested_status(files: DataFrame) -> DataFrame:
    """Rows (file, test, status) of maps file -> (test -> status)."""
    keys = [c for c in files.columns if c != "text"]
    rows = files.select(*keys, F.explode(F.from_json("text", "map<string,map<string,string>>")).alias("file", "tests"))
    return rows.select(*keys, "file", F.explode("tests").alias("test", "status"))


def eval_reports(spark: SparkSession, path: str, without: str = "gold") -> DataFrame:
    """Report rows with their file's name as `report`, without reports named after `without`."""
    rows = spark.read.schema(schemas.EVAL_REPORT).option("header", True).csv(path).withColumn("report", F.col("_metadata.file_name"))
    return rows.where(~F.contains("report", F.lit(without))) if without else rows


def sheet(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A spreadsheet staged as CSV; an error if a required column is missing."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if lost := [c for c in required if c not in rows.columns]:
        raise ValueError(f"missing columns: {', '.join(lost)}")
    return rows


def pages_until_empty(pages: DataFrame, most_pages: int | None = None) -> DataFrame:
    """Items of a paged listing staged as (page, items): pages before the first empty one, up to a cap."""
    first_empty = pages.where(F.size("items") == 0).agg(F.min("page").alias("_stop"))
    rows = pages.crossJoin(F.broadcast(first_empty)).where("_stop is null or page < _stop").drop("_stop")
    if most_pages is not None:
        rows = rows.where(F.col("page") <= most_pages)
    return rows.select("page", F.posexplode("items").alias("pos", "item"))


def recent_pulls(pulls: DataFrame, cutoff: str | None = None, most: int | None = None) -> DataFrame:
    """Pulls created at the cutoff or later, newest first, at most `most`."""
    rows = pulls.where(F.col("created_at") >= cutoff) if cutoff else pulls
    rows = rows.orderBy(F.desc("created_at"), F.desc("number"))
    return rows.limit(most) if most else rows


def profiles(spark: SparkSession, path: str, root: str = "workload") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of binary profile files (unreadable ones give nothing), restricted to what is called from functions named `root`."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(edges: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import marshal

            for b in batches:
                for p, content in zip(b["path"], b["content"], strict=True):
                    try:
                        stats = marshal.loads(content)
                    except (EOFError, ValueError, TypeError):
                        continue  # as coverage files that can't be read
                    if not isinstance(stats, dict):
                        continue
                    down: dict = {}
                    for callee, row in stats.items():
                        for caller in row[4]:
                            down.setdefault(caller, []).append(callee)
                    todo = [k for k in stats if root in k[2]]
                    held = set(todo)
                    while todo:
                        for c in down.get(todo.pop(), ()):
                            if c not in held:
                                held.add(c)
                                todo.append(c)
                    name = lambda k: f"{k[0]}:{k[1]}:{k[2]}"
                    if edges:
                        rows = [(p, name(a), name(k), int(v[1]), float(v[2]), float(v[3])) for k in stats if k in held for a, v in stats[k][4].items() if a in held]
                        yield pd.DataFrame(rows, columns=["path", "caller", "callee", "calls", "tottime", "cumtime"])
                    else:
                        rows = [(p, k[0], int(k[1]), k[2], int(v[1]), float(v[2]), float(v[3])) for k, v in stats.items() if k in held]
                        yield pd.DataFrame(rows, columns=["path", "file", "line", "func", "ncalls", "tottime", "cumtime"])

        return run

    return files.mapInPandas(parse(False), schemas.PROFILE_NODE), files.mapInPandas(parse(True), schemas.PROFILE_EDGE)


def coverage_files(spark: SparkSession, path: str) -> DataFrame:
    """test, file, line of coverage databases; the first context names the test, unreadable files give nothing."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sqlite3

        for b in batches:
            for content in b["content"]:
                try:
                    db = sqlite3.connect(":memory:")
                    db.deserialize(bytes(content))
                    test = (db.execute("select context from context where context <> '' order by id limit 1").fetchone() or ("",))[0]
                    rows = [(test, f, 8 * i + k) for f, bits in db.execute("select f.path, l.numbits from line_bits l join file f on f.id = l.file_id") for i, byte in enumerate(bits) for k in range(8) if byte >> k & 1]
                    yield pd.DataFrame(rows, columns=["test", "file", "line"]).drop_duplicates()
                except sqlite3.Error:
                    continue

    return files.mapInPandas(run, "test string, file string, line int")


def releases(pages: DataFrame, pattern: str) -> DataFrame:
    """version, release_date of release pages staged as (html), by a pattern that captures the version and the date's text."""
    from perfloom.functions.text import release_date

    whole = pages.select(F.explode(F.regexp_extract_all("html", F.lit(pattern), F.lit(0))).alias("_m"))
    rows = whole.select(F.regexp_extract("_m", pattern, 1).alias("version"), release_date(F.regexp_extract("_m", pattern, 2)).alias("release_date"))
    return rows.where("release_date is not null").distinct()


def coverage_runs(spark: SparkSession, root: str, known: DataFrame, prefix: str = "debugging_coverage_") -> DataFrame:
    """Rows of `known` (instance_id, ...) for which a folder of a coverage run below `root` lists covering tests, with `folder` and `tests`."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "covering_tests.txt*").text(root, wholetext=True)
    folder = F.regexp_extract("_metadata.file_path", "^(.*)/[^/]*$", 1)
    runs = files.select(folder.alias("folder"), F.filter(F.split("value", "\n"), lambda x: x != "").alias("tests")).where(F.contains("folder", F.lit(prefix)))
    return known.join(runs.withColumn("instance_id", F.element_at(F.split("folder", "/"), -1)), "instance_id")


def test_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths of files whose name holds `test`."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*test*").load(path).select("path")
