import os
import tempfile

from pyspark.sql import functions as F

from replyscope.operators import prompts
from replyscope.sources import io


def test_request_shards_and_manifest(spark):
    rows = [(i, "task1553-1", f"reply {i}", "src") for i in range(45)]
    df = spark.createDataFrame(rows, "row_id long, nat_instr_id string, reply string, final_prompt_en string")
    lines = io.judge_request_lines(prompts.judge_prompts(df))
    path = tempfile.mkdtemp(prefix="rs-shards-") + "/batches"
    manifest = {r["shard"]: r["n_requests"] for r in io.write_request_shards(lines, path).collect()}
    assert manifest == {0: 60, 20: 60, 40: 15}
    import json

    text = [r["line"] for r in io.read_request_shard(spark, path, 20).collect()]
    assert len(text) == 60
    first = json.loads(text[0])
    assert first["method"] == "POST" and first["body"]["max_tokens"] == 1000
    assert first["body"]["messages"][0]["role"] == "system"
    # A second write adds its shards and keeps the first ones.
    more = spark.createDataFrame([(i, "task1553-1", f"reply {i}", "src") for i in range(45, 80)], df.schema)
    io.write_request_shards(io.judge_request_lines(prompts.judge_prompts(more)), path)
    assert spark.read.parquet(f"{path}/manifest").agg({"n_requests": "sum"}).first()[0] == 80 * 3
    assert io.read_requests(spark, path).select("custom_id").distinct().count() == 80 * 3


def _lines(spark, ids):
    rows = [(i, "task1553-1", f"reply {i}", "src") for i in ids]
    return io.judge_request_lines(prompts.judge_prompts(spark.createDataFrame(rows, "row_id long, nat_instr_id string, reply string, final_prompt_en string")))


def test_a_rerun_adds_no_request(spark):
    path = tempfile.mkdtemp(prefix="rs-shards-") + "/batches"
    lines = _lines(spark, range(30))
    first = sorted(map(tuple, io.write_request_shards(lines, path).collect()))
    assert sorted(map(tuple, io.write_request_shards(lines.union(lines), path).collect())) == first
    more = {r["shard"]: r["n_requests"] for r in io.write_request_shards(_lines(spark, range(25, 50)), path).collect()}
    assert more == {0: 60, 20: 60, 40: 30} and io.read_requests(spark, path).count() == 150
    sent = io.read_requests(spark, path).where("shard = 20")
    assert sent.selectExpr("sum(octet_length(line) + 1)").first()[0] == io.read_manifest(spark, path).where("shard = 20").first()["n_bytes"]


def test_unpublished_lines_are_not_seen(spark):
    """A run that dies after its lines and before its manifest."""
    path = tempfile.mkdtemp(prefix="rs-shards-") + "/batches"
    lines = _lines(spark, range(10))
    lines.write.parquet(f"{path}/requests/commit=dead")
    assert io.write_request_shards(lines, path).first()["n_requests"] == 30
    lines.write.parquet(f"{path}/requests/commit=dead2")
    assert io.read_requests(spark, path).count() == 30
    plan = io.read_request_shard(spark, path, 0)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "PushedFilters: [" in plan


def test_runs_selected_by_a_table(spark):
    base = tempfile.mkdtemp(prefix="rs-select-")
    df = spark.range(400).selectExpr("id as row_id", "concat('a', id % 2) approach", "concat('m', id % 5) model", "concat('mode', id % 4) mode", "id / 400 accuracy")
    io.write_table(df, f"{base}/scores", partition_by=("approach", "model", "mode"))
    runs = spark.createDataFrame([("a0", "m1", "x"), ("a1", "m3", "x"), ("a0", "m2", "y")], "approach string, model string, report string")
    io.write_table(runs, f"{base}/runs")
    got = io.read_scores_selected(spark, f"{base}/scores", spark.read.parquet(f"{base}/runs").where("report = 'x'"))
    want = {r["row_id"] for r in df.collect() if (r["approach"], r["model"]) in (("a0", "m1"), ("a1", "m3"))}
    assert {r["row_id"] for r in got.collect()} == want and want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    import pytest

    with pytest.raises(ValueError):
        io.read_scores_selected(spark, f"{base}/scores", runs.select("report"))


def test_request_ids_of_two_runs_are_unique(spark):
    rows = [(1, "m", mode, "task1553-1", "r", "s") for mode in ("standard", "add_all_native")]
    df = spark.createDataFrame(rows, "row_id long, model string, mode string, nat_instr_id string, reply string, final_prompt_en string")
    keys = ("row_id", "model", "mode")
    lines = io.judge_request_lines(prompts.judge_prompts(df, keys=keys), keys=keys)
    assert lines.count() == lines.select("custom_id").distinct().count() == 6
    answers = prompts.judge_prompts(df, keys=keys).withColumn("answer", F.concat_ws("/", "mode", "criterion"))
    out = {r["mode"]: r["fluency"] for r in prompts.regroup_judgements(answers, keys).collect()}
    assert out == {m: f"{m}/fluency" for m in ("standard", "add_all_native")}


def test_partitioned_scores_pruning(spark):
    path = tempfile.mkdtemp(prefix="rs-scores-") + "/scores"
    df = spark.createDataFrame([(1, "appr2", "m1", "standard", 1.0), (2, "appr1", "m1", "standard", 0.0),
                                (3, "appr2", "m2", "guess_native", 0.5)],
                               "row_id long, approach string, model string, mode string, accuracy double")
    io.write_table(df, path, partition_by=("approach", "model", "mode"))
    got = io.read_scores(spark, path, approach="appr2", models=["m1"])
    assert [r["row_id"] for r in got.collect()] == [1]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan


def test_materialize_cuts_lineage(spark):
    df = spark.range(100).selectExpr("id", "id * 2 AS x").where("id % 3 = 0")
    m = io.materialize(df, "unit")
    assert sorted(r[0] for r in m.collect()) == sorted(r[0] for r in df.collect())
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert "Range" not in plan and "FileScan" in plan
    assert spark.conf.get("spark.checkpoint.dir") in m.inputFiles()[0].replace("file:", "")


def test_read_runs_and_csv_report(spark):
    base = tempfile.mkdtemp(prefix="rs-runs-")
    df = spark.createDataFrame([(1, "standard", "m1", "1", "a"), (2, "guess_native", "m1", "1", "b"),
                                (3, "standard", "m1", "2", "c")],
                               "row_id long, mode string, model string, run string, reply string")
    io.write_table(df, f"{base}/runs", partition_by=("mode", "model", "run"))
    got = io.read_runs(spark, f"{base}/runs", mode="standard", model="m1", run="1")
    assert [r["row_id"] for r in got.collect()] == [1]
    io.write_report_csv(got.select("row_id", "reply"), f"{base}/report")
    files = [f for f in os.listdir(f"{base}/report") if f.endswith(".csv")]
    assert len(files) == 1
    assert open(f"{base}/report/{files[0]}").read().splitlines() == ["row_id,reply", "1,a"]
