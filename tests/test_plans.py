"""Plan checks over every catalogued query: no cartesian products or nested-loop joins, Python only where
expected, filters and column pruning reach the scans."""

import pytest

import os
import re

import __spark_entry__ as entry
from replyscope.plans.catalog import QUERIES

SMOKE = "/root/testdata/sf0.001"
PYTHON_OK = {"rouge_l", "rouge_lsum", "run_comparison", "comparison_pivot", "comparison_pivot_dataset", "greedy_match_score",
             "cosine_knn", "pca_2d", "infer_stub", "chat_gold", "judge_regroup", "embed_texts", "guess_two_stage", "scores_all", "run_comparison_all", "group_covariance", "cosine_knn_lsh", "projected_points", "infer_logprobs"}

# Queries whose feature is to write and commit tables: they run jobs when built.
WRITES = {"guess_two_stage", "gold_two_stage", "stream_resume", "scores_all", "run_comparison", "run_comparison_all", "comparison_pivot",
          "comparison_pivot_dataset", "judge_request_manifest", "scores_selected", "report_csv"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_shape(spark, name):
    plan = _plan(entry.queries()[name](spark, SMOKE))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    python = any(k in plan for k in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas",
                                     "PythonMapInArrow", "MapInArrow"))
    # Python only in the row-local cores that need it (its stage may also run while a small dimension is
    # materialised, leaving none in the final plan).
    assert not python or name in PYTHON_OK, name


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITES))
def test_building_a_query_runs_no_job(spark, name):
    """Only reading the schemas of the files may start a job."""
    sc = spark.sparkContext
    sc.setJobGroup(f"build-{name}", name)
    try:
        QUERIES[name](spark, SMOKE)
        jobs = sc.statusTracker().getJobIdsForGroup(f"build-{name}")
        stages = [sc.statusTracker().getStageInfo(s) for j in jobs for s in sc.statusTracker().getJobInfo(j).stageIds]
        assert all(s is None or s.name.startswith("parquet at") for s in stages), [s.name for s in stages if s]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_library_never_pulls_rows_to_the_driver():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "replyscope")
    pulls = re.compile(r"(?<!F)\.(collect|first|toPandas|toLocalIterator|take|head)\(|\.count\(\)|localCheckpoint")
    for folder, dirs, files in os.walk(root):
        dirs[:] = [d for d in dirs if d != "llm"]
        for f in files:
            if f.endswith(".py"):
                text = open(os.path.join(folder, f)).read()
                assert not pulls.search(text), (f, pulls.search(text))


def test_no_text_is_cut():
    """The surrogate views and the catalogue use whole texts."""
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "replyscope")
    for f in ("sources/fixtures.py", "plans/catalog.py", "streaming/inference.py"):
        text = open(os.path.join(root, f)).read().replace("substr('ABC'", "").replace("F.substring(F.md5(", "")
        assert not re.search(r"substr\(|substring\(|\[:\d+\]", text), f


def _formatted(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_column_pruning_reaches_scan(spark):
    plan = _formatted(entry.queries()["task_suffix"](spark, SMOKE))
    schemas = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert schemas and all("text" not in s for s in schemas), schemas


def test_filter_pushed_to_scan(spark):
    plan = _formatted(entry.queries()["loglik_score"](spark, SMOKE))
    assert "EqualTo(role,assistant)" in plan and "EqualTo(role,user)" in plan


def test_rounded_columns_match_schemas(spark):
    """Every DOUBLE output column is in the rounding list (same list on the Spark and SQL sides)."""
    from replyscope.plans.catalog import QUERIES
    from replyscope.plans.rounding import DOUBLE_COLUMNS

    for name, fn in QUERIES.items():
        df = fn(spark, SMOKE)
        doubles = tuple(f.name for f in df.schema.fields if f.dataType.simpleString() == "double")
        assert doubles == DOUBLE_COLUMNS.get(name, ()), name
