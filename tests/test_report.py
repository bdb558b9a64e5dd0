import pytest
from pyspark.sql import functions as F

from replyscope.operators import report, stats


def test_macro_average_two_stage(spark):
    df = spark.createDataFrame([("x", 1, 1.0), ("x", 1, 0.0), ("x", 2, 1.0), ("x", 3, None), ("y", None, 1.0)],
                               "c string, example_id long, accuracy double")
    out = {r["c"]: r["accuracy"] for r in report.macro_average(df, "c").collect()}
    assert out == {"x": pytest.approx(0.75)}  # not 0.667; the all-NULL example and the NULL key are skipped


def test_histogram_edges(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 5.0, 6.0, 6.5, 7.0, -1.0)], "v double")
    out = {r["bin"]: r["n"] for r in stats.histogram(df, "v").collect()}
    assert out == {0: 1, 1: 0, 2: 0, 3: 0, 4: 0, 5: 2}


def test_round_half_even_on_binary_value(spark):
    """Same as numpy/pandas ``round(2)``: rint of the scaled binary value (0.285 -> 0.28, 0.125 -> 0.12)."""
    import numpy as np

    vals = [0.285, 0.125, 2.675, 0.135, 1.005, 0.5, 12.345]
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "v double")
    got = [r[0] for r in df.select(report.round_half_even(F.col("v"))).collect()]
    assert got == [float(np.round(v, 2)) for v in vals] + [None]
    assert got[:2] == [0.28, 0.12]


def test_multi_ref(spark):
    df = spark.createDataFrame([(1, 0, -1.0), (1, 1, -3.0), (2, 0, -2.0), (2, 1, -2.0)], "row_id long, ref_idx int, score double")
    assert {r[0]: r[1] for r in report.multi_ref(df, agg="mean").collect()} == {1: -2.0, 2: -2.0}
    assert {r[0]: r[1] for r in report.multi_ref(df, agg="max").collect()} == {1: -1.0, 2: -2.0}
    bad = df.union(spark.createDataFrame([(3, 0, 1.0)], df.schema))
    with pytest.raises(Exception, match="different numbers of references"):
        report.multi_ref(bad).collect()


def test_drop_dataset_keeps_null(spark):
    df = spark.createDataFrame([(3,), (1,), (None,)], "dataset_id int")
    assert sorted(str(r[0]) for r in report.drop_dataset(df).collect()) == ["1", "None"]


def test_fill_missing_accuracy(spark):
    df = spark.createDataFrame([(3, None), (1, None), (4, 1.0)], "dataset_id int, accuracy double")
    assert [r[1] for r in report.fill_missing_accuracy(df).orderBy("dataset_id").collect()] == [None, 0.0, 1.0]


def test_comparison_of_all_metrics_equals_direct_means(spark):
    """The 13-metric report from the score table, against plain means of its rows."""
    from collections import defaultdict

    from replyscope.plans import catalog

    sf = "/root/testdata/sf0.001"
    metrics = report.metric_columns("all")
    assert len(metrics) == 13
    rows = catalog.scored_runs_full(spark, sf).collect()
    assert any(r["rouge_lsum"] for r in rows) and any(r["bertscore_f1"] for r in rows) and any(r["bartscore_f1"] for r in rows)
    names = {"standard": "standard", "add_all_native": "native", "add_all_non_native": "non_native", "guess_native": "guess_native"}
    per = defaultdict(lambda: defaultdict(list))
    for r in rows:
        for run in [names[r["mode"]]] + (["guess_native_correct"] if r["mode"] == "guess_native" and r["guess_correct"] else []):
            for m in metrics:
                if r[m] is not None:
                    per[run, r["native_or_not"], m][r["example_id"]].append(r[m])
    got = {(r["run"], r["native_or_not"], m): r[m] for r in catalog.run_comparison_all(spark, sf).collect() for m in metrics}
    for key, value in got.items():
        means = [sum(v) / len(v) for v in per[key].values()]
        assert (value is None and not means) or abs(value - sum(means) / len(means)) < 1e-9


def test_macro_averages_of_all_levels_in_one_scan(spark, tmp_path):
    rows = [(c, e, s, d, a) for i, (c, e, s, d, a) in enumerate(
        (("x" if i % 3 else "y"), i % 7, i % 2 if i % 11 else None, i % 5 if i % 13 else None, (i * 7 % 10) / 10 if i % 4 else None) for i in range(200))]
    spark.createDataFrame(rows, "c string, example_id long, set_id int, dataset_id int, accuracy double").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    got = report.macro_average_sets(df, "c")
    assert str(got._jdf.queryExecution().executedPlan().toString()).count("FileScan") == 1
    got = {(r["level"], r["c"], r["set_id"], r["dataset_id"]): r["accuracy"] for r in got.collect()}
    want = {("overall", r["c"], None, None): r["accuracy"] for r in report.macro_average(df, "c").collect()}
    want |= {("set_id", r["c"], r["set_id"], None): r["accuracy"] for r in report.macro_average(df, "c", by=["set_id"]).collect()}
    want |= {("dataset_id", r["c"], None, r["dataset_id"]): r["accuracy"] for r in report.macro_average(df, "c", by=["dataset_id"]).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_multi_ref_with_a_given_number(spark):
    df = spark.createDataFrame([(1, 0, -1.0), (1, 1, -3.0), (2, 0, -2.0)], "row_id long, ref_idx int, score double")
    assert report.multi_ref(df.where("row_id = 1"), refs=2).first()["score"] == -2.0
    with pytest.raises(Exception, match="different numbers of references"):
        report.multi_ref(df, refs=2).collect()
    plan = report.multi_ref(df, refs=2)._jdf.queryExecution().executedPlan().toString()
    assert "Subquery" not in plan
