import cProfile
import json

import pytest
from pyspark.sql import functions as F

from perfloom.sources import readers as R
from perfloom.sources import sinks as K
from perfloom.streaming import increments as I


def test_predictions_and_dataset(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"instance_id":"a","model_patch":null,"model_name_or_path":"m"}\n\n')
    assert R.predictions(spark, str(tmp_path / "p.jsonl")).first()["instance_id"] == "a"
    (tmp_path / "bad.jsonl").write_text('{"model_patch":"x"}\n')
    with pytest.raises(Exception, match="required key"):
        R.predictions(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "k.json").write_text(json.dumps({"a": {"model_patch": "x", "model_name_or_path": "m"}}))
    assert tuple(R.keyed_predictions(spark, str(tmp_path / "k.json")).first()) == ("a", "x", "m")
    (tmp_path / "d.json").write_text(json.dumps([{"instance_id": "a", "patch": "p"}, {"instance_id": "b"}]))
    assert R.dataset(spark, str(tmp_path / "d.json"), ["a"]).count() == 1
    with pytest.raises(ValueError, match="unknown instances: z"):
        R.dataset(spark, str(tmp_path / "d.json"), ["z"])


def test_lenient_and_lists(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a":1}\n{broken\n\n{"a":2}\n')
    assert sorted(r.a for r in R.lenient_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").collect()) == [1, 2]
    with pytest.raises(Exception):  # noqa: B017
        R.strict_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").collect()
    rows = R.lists_as_arrays(spark.createDataFrame([('["x"]',), ("oops",), (None,)], "t string"), ["t"]).collect()
    assert [r.t for r in rows] == [["x"], [], []]


def test_result_files_and_profiles(spark, tmp_path):
    f = tmp_path / "run" / "model" / "inst"
    f.mkdir(parents=True)
    (f / "status.json").write_text('{"t":"PASSED"}')
    r = R.status_maps(R.result_files(spark, str(tmp_path), "status.json")).first()
    assert (r.run_id, r.model, r.instance_id, r.status) == ("run", "model", "inst", {"t": "PASSED"})
    p = cProfile.Profile()

    def workload():
        return sorted([3, 1])

    p.runcall(workload)
    p.dump_stats(tmp_path / "x.prof")
    nodes, edges = R.profiles(spark, str(tmp_path / "x.prof"))
    assert "workload" in {r.func for r in nodes.collect()} and edges.where("callee like '%sorted%'").count() == 1


def test_pages_and_sinks(spark, tmp_path):
    pages = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"]), (3, []), (4, ["d"])], "page int, items array<string>")
    assert sorted(r.item for r in R.pages_until_empty(pages).collect()) == ["a", "b", "c"]
    df = spark.createDataFrame([(1, "t"), (2, " ")], "id int, test_patch string")
    K.valid_and_tested(df, str(tmp_path / "all"), str(tmp_path / "tested"))
    assert spark.read.json(str(tmp_path / "all")).count() == 2 and spark.read.json(str(tmp_path / "tested")).count() == 1
    r = K.run_report(spark.createDataFrame([("b", "resolved"), ("a", "resolved"), ("c", "error")], "id string, label string"), "label", "id").first()
    assert (r.total, r.resolved_count, r.resolved_ids, r.error_ids, r.schema_version) == (3, 2, ["a", "b"], ["c"], 2)


def test_streams_equal_batches(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    (tmp_path / "in").mkdir()
    e.withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(str(tmp_path / "in"))
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    stream = I.first_seen(I.events(spark, str(tmp_path / "in"), schema), ["user_id", "event_type"], "ts", "40 days")
    I.append_new(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == e.select("user_id", "event_type").distinct().count()
    counts = I.windowed_counts(I.events(spark, str(tmp_path / "in"), schema), "ts", "1 day", ["event_type"], "0 seconds")
    I.append_new(counts, str(tmp_path / "out2"), str(tmp_path / "cp2")).awaitTermination()
    got = {(str(r.window.start), r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "out2")).collect()}
    want = {(str(r[0].start), r[1]): r[2] for r in e.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day"), "event_type").count().collect()}
    assert got and all(want[k] == n for k, n in got.items())


def test_coverage_runs_and_bad_profiles(spark, tmp_path):
    run = tmp_path / "debugging_coverage_1" / "a__b-7"
    run.mkdir(parents=True)
    (run / "covering_tests.txt").write_text("t1\nt2\n")
    other = tmp_path / "elsewhere" / "a__b-8"
    other.mkdir(parents=True)
    (other / "covering_tests.txt").write_text("t3\n")
    known = spark.createDataFrame([("a__b-7", 1), ("a__b-8", 2)], "instance_id string, n int")
    assert [(r.instance_id, r.n, r.tests) for r in R.coverage_runs(spark, str(tmp_path), known).collect()] == [("a__b-7", 1, ["t1", "t2"])]
    (tmp_path / "bad.prof").write_bytes(b"not a profile")
    nodes, edges = R.profiles(spark, str(tmp_path / "*.prof"))
    assert nodes.count() == 0 and edges.count() == 0
