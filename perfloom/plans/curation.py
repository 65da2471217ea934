"""From pulls to tasks: keywords and rules, documents and lock files, versions, repeated-run gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfloom.functions import diffs as D
from perfloom.functions import text as T
from perfloom.operators import aggregates as A
from perfloom.operators import joins as J

# For each repository the labels and title keywords that mark performance work, and whether titles are lowered.
RULES = [
    ("astropy", ["performance"], ["eff", "perf", "speed up"], True),
    ("scikit-learn", ["performance"], ["eff", "perf"], True),
    ("matplotlib", ["performance"], ["perf"], True),
    ("pylint", ["performance"], ["perf"], True),
    ("seaborn", ["perf"], ["perf"], True),
    ("sphinx", ["type:performance"], ["perf"], True),
    ("sympy", ["performance"], ["perf"], True),
    ("xarray", ["topic-performance"], ["perf", "speed up"], True),
    ("pandas", ["performance"], ["perf", "speed up", "efficiency", "performance"], False),
    ("dask", [], ["perf", "speed up", "efficiency", "remove", "avoid", "overhead", "memory"], True),
    ("numpy", [], ["perf", "speed up", "efficiency", "performance"], False),
    ("scipy", [], ["perf", "speed up", "efficiency", "performance"], False),
    ("statsmodels", ["performance"], ["perf", "speed up", "efficiency", "performance"], False),
    ("pillow", ["performance"], ["perf", "speed", "efficiency", "performance"], False),
    ("spacy", ["perf"], ["perf", "speed", "efficiency", "performance"], False),
    ("numba", ["performance"], ["perf", "speed", "efficiency", "performance"], False),
    ("gensim", ["performance"], ["perf", "speed", "efficiency", "performance"], False),
    ("scikit-image", ["performance"], ["perf", "speed", "efficiency", "performance"], False),
]


def rules(spark: SparkSession, rows: list[tuple] = RULES) -> DataFrame:
    return spark.createDataFrame(rows, "rule string, labels array<string>, title_keywords array<string>, fold_case boolean")


def by_rule(rows: DataFrame, rule_table: DataFrame, key: str, title: str, labels: str | None = None) -> DataFrame:
    """With `hit`: a label contains one of the rule's labels, or the title one of its keywords; null without a rule."""
    wide = rows.join(F.broadcast(rule_table.withColumnsRenamed({"rule": "_rule", "labels": "_labels", "title_keywords": "_words", "fold_case": "_fold"})), F.col(key) == F.col("_rule"), "left")
    text = F.when(F.col("_fold"), F.lower(title)).otherwise(F.col(title))
    hit = F.exists("_words", lambda w: F.contains(text, w))
    if labels:
        hit = hit | F.exists("_labels", lambda v: F.exists(labels, lambda x: F.contains(F.lower(x["name"]), v)))
    return wide.withColumn("hit", F.when(F.col("_rule").isNotNull(), F.coalesce(hit, F.lit(False)))).drop("_rule", "_labels", "_words", "_fold")


def performance_pulls(pulls: DataFrame, rule_table: DataFrame, repo: str = "repo") -> DataFrame:
    """Merged pulls that their repository's rule or the general words mark."""
    rows = by_rule(pulls.where("merged_at is not null"), rule_table, repo, "title", "labels")
    return rows.where(F.coalesce("hit", F.lit(False)) | T.about_performance(F.col("body"), F.col("title"))).drop("hit")


def code_changes(rows: DataFrame, patch: str = "patch") -> DataFrame:
    """Without changes to documents alone, and without any to a lock file."""
    f = D.files(F.col(patch))
    return rows.where((F.size(f) > 0) & ~D.only_documents(f) & ~D.any_lock(f))


def candidates(pulls: DataFrame, patch: str = "patch", test_patch: str = "test_patch", tests: bool = False) -> DataFrame:
    """Merged pulls with a patch and, if `tests`, with tests."""
    rows = pulls.where(f"merged_at is not null and coalesce({patch}, '') <> ''")
    return rows.where(T.stripped(F.col(test_patch)) != "") if tests else rows


def versioned(tasks: DataFrame, releases: DataFrame, repo: str = "repo") -> DataFrame:
    """Tasks with the version of their repository's newest release before the day they were created; without one they go."""
    days = tasks.drop("version").withColumn("_day", F.left("created_at", F.lit(10)))
    return J.as_of(days, releases, "_day", "release_date", "version", [repo]).drop("_day").where("version is not null")


# Tasks that are left out.
IGNORED_INSTANCES = """
scikit-learn__scikit-learn-14075
numpy__numpy-23088
scipy__scipy-16449
scikit-learn__scikit-learn-19934
scipy__scipy-22610
pandas-dev__pandas-36611
pandas-dev__pandas-52290
pandas-dev__pandas-44608
pandas-dev__pandas-54223
scikit-learn__scikit-learn-13987
matplotlib__matplotlib-20197
pandas-dev__pandas-39678
scipy__scipy-10574
numpy__numpy-11518
matplotlib__matplotlib-24847
matplotlib__matplotlib-18997
pandas-dev__pandas-43623
pandas-dev__pandas-43316
pandas-dev__pandas-52132
numpy__numpy-25991
sympy__sympy-12748
scikit-learn__scikit-learn-16499
sympy__sympy-21320
pandas-dev__pandas-41503
pandas-dev__pandas-43737
numpy__numpy-13634
pandas-dev__pandas-43307
""".split()
# Tests that are left out, by parts of their names.
SKIPPED_TESTS = """
test_user_agent.py
sklearn/tests/test_common.py
pandas/tests/extension/json/test_json.py::TestArithmeticOps::test_arith_frame_with_scalar
pandas/tests/indexes/test_base.py::TestIndex::test_isin_nan_common_object
pandas/tests/test_algos.py::TestIsin::test_different_nans
test_nan
numpy/_core/tests/test_umath_accuracy.py::TestAccuracy::test_validate_svml_fp16
numpy/_core/tests/test_scalarmath.py::test_array_scalar_ufunc_dtypes
test_reindex_nan
pandas/tests/series/methods/test_reindex.py::test_reindex_nan
pandas/tests/io/json/test_pandas.py::TestPandasContainer::test_roundtrip_simple[columns-True-True-float]
pandas/tests/io/json/test_json_table_schema.py::TestTableOrient::test_build_series
dropna
pandas/tests/test_algos.py::TestUnique::test_first_nan_kept
pandas/tests/io/json/test_readlines.py::test_to_jsonl
pandas/tests/io/json/test_readlines.py::test_readjson_chunks[1]
pandas/tests/io/json/test_readlines.py::test_readjson_chunks[1.0]
pandas/tests/io/json/test_readlines.py::test_readjson_each_chunk
xarray/tests/test_backends.py::test_open_mfdataset_manyfiles[h5netcdf-20-True-None-5]
xarray/tests/test_backends.py::test_open_mfdataset_manyfiles[h5netcdf-20-True-5-5]
xarray/tests/test_backends.py::test_open_mfdataset_manyfiles[netcdf4-20-True-None-5]
pandas/tests/io/test_fsspec.py::test_json_options
pandas/tests/indexes/period/test_freq_attr.py::TestFreq::test_freq_setter_deprecated
pandas/tests/reshape/test_get_dummies.py::TestGetDummies::test_get_dummies_basic_drop_first_NA[sparse]
pandas/tests/reshape/test_get_dummies.py::TestGetDummies::test_get_dummies_basic_drop_first_NA[dense]
dask/dataframe/tests/test_dataframe.py::test_describe_empty
pandas/tests/apply/test_series_apply.py::test_map_missing_mixed[vals0-mapping0-exp0]
pandas/tests/tools/test_to_datetime.py::TestDatetimeParsingWrappers::test_parsers[True-2005-11-expected20-None]
pandas/tests/tools/test_to_datetime.py::TestDatetimeParsingWrappers::test_parsers[True-2014-06-expected36-None]
pandas/tests/tools/test_to_datetime.py::TestDatetimeParsingWrappers::test_parsers[True-2014-6-expected38-None]
pandas/tests/tools/test_to_datetime.py::TestDatetimeParsingWrappers::test_parsers[False-2005-11-expected20-None]
pandas/tests/tools/test_to_datetime.py::TestDatetimeParsingWrappers::test_parsers[False-2014-06-expected36-None]
pandas/tests/tools/test_to_datetime.py::TestDatetimeParsingWrappers::test_parsers[False-2014-6-expected38-None]
pandas/tests/apply/test_series_apply.py::TestSeriesMap::test_map_missing_mixed[vals0-mapping0-exp0]
pandas/tests/scalar/timestamp/test_unary_ops.py::TestTimestampUnaryOps::test_round_sanity[ceil-18]
pandas/tests/libs/test_hashtable.py::TestHashTableUnsorted::test_vector_resize[True-Int32HashTable-Int32Vector-int32-False-10]
pandas/tests/computation/test_eval.py::TestAlignment::test_complex_series_frame_alignment[python-pandas-i-s-i-s0]
pandas/tests/scalar/timedelta/test_timedelta.py::TestTimedeltas::test_round_sanity
lib/matplotlib/tests/test_constrainedlayout.py::test_compressed1
pandas/tests/test_algos.py::TestIsin::test_different_nan_objects
xarray/tests/test_backends.py::TestH5NetCDFDataRos3Driver::test_get_variable_list
pandas/tests/io/parser/common/test_file_buffer_url.py::test_url
pandas/tests/io/json/test_pandas.py::TestPandasContainer::test_round_trip_exception_
pandas/tests/io/parser/test_common.py::test_url
pandas/tests/io/parser/test_parsers.py
numpy/f2py/tests/test_quoted_character.py
pandas/tests/io/pytables/test_store.py::test_coordinates
pandas/tests/io/pytables/test_select.py::test_select_as_multiple
xarray/tests/test_strategies.py::TestDimensionNamesStrategy::test_types
""".split()
# Tests that run in one thread, by parts of their names.
SINGLE_THREAD_TESTS = ["pandas/tests/io", "xarray/tests/test_backends.py"]


def usable_tests(tests: DataFrame, name: str = "test", skipped: list[str] = SKIPPED_TESTS, single: list[str] = SINGLE_THREAD_TESTS) -> DataFrame:
    """Tests without those that `skipped` names by a part, and with `single_thread`; more patterns can be given for either."""
    return J.without_matches(tests, skipped, name).withColumn("single_thread", T.contains_any(F.col(name), single))


def without_ignored(instances: DataFrame, ignored: list[str] = IGNORED_INSTANCES, key: str = "instance_id") -> DataFrame:
    rows = instances.sparkSession.createDataFrame([(i,) for i in ignored], f"{key} string")
    return J.drop(instances, F.broadcast(rows), key)


def passed_gates(runs: DataFrame, key: str, count: int) -> DataFrame:
    """Keys that all `count` runs have and of which no run is bad. Runs hold before, after, after_sd."""
    delta = F.col("after") - F.col("before")
    bad = A.bad_run(delta, F.try_divide(delta, F.col("before")) * 100, F.col("after_sd"))
    return runs.groupBy(key).agg(F.count_distinct("run").alias("runs"), F.bool_or(F.coalesce(bad, F.lit(True))).alias("bad")).where(f"runs = {count} and not bad").select(key)


def stable_tests(runs: DataFrame, key: list[str]) -> DataFrame:
    """Tests with one status over all runs."""
    return A.flaky(runs, key, "status").where("not flaky").select(*key)
