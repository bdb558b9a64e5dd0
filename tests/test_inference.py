"""Inference stage: batching, failures as rows, resumable reruns, streaming form."""

import tempfile

import pytest

from pyspark.sql import functions as F

from replyscope.operators import prompts
from replyscope.sources import io
from replyscope.streaming import inference as inf


def _requests(spark, n=30):
    rows = [(i, i % 10, "Task.", "Answer: <markprompt>[Your Prompt]</markprompt>.", f"p{i}") for i in range(n)]
    df = spark.createDataFrame(rows, "row_id long, dataset_id int, task_def string, instruction string, prompt_en string")
    return prompts.build_messages(df).withColumn("model", F.lit("m")).withColumn("mode", F.lit("standard"))


def test_echo(spark):
    out = {r["row_id"]: r for r in inf.run_inference(_requests(spark), inf.echo_model, batch_size=4).collect()}
    assert len(out) == 30
    assert out[3]["reply"] == "1 echo 10: Answer: p3" and out[3]["error"] is None


def test_failures_become_rows(spark):
    def flaky(chats, params):
        if any("p1" in c[-1]["content"] for c in chats):
            raise RuntimeError("rate limited")
        return inf.echo_model(chats, params)

    out = inf.run_inference(_requests(spark), flaky, batch_size=1, retries=1, backoff_seconds=0.0).collect()
    failed = [r for r in out if r["reply"] is None]
    assert {r["row_id"] for r in failed} == {1} | set(range(10, 20))
    assert all("rate limited" in r["error"] for r in failed)


def test_params_passed(spark):
    def show_params(chats, params):
        return [f"{p['temperature']}|{p['top_p']}|{p['max_tokens']}" for p in params]

    out = {r["reply"] for r in inf.run_inference(_requests(spark, 10), show_params).collect()}
    assert out == {"0.0|None|4096", "0.7|0.8|4096"}


def test_resumable(spark):
    path = tempfile.mkdtemp(prefix="rs-run-") + "/out"
    calls = spark.sparkContext.accumulator(0)

    def counting(chats, params):
        calls.add(len(chats))
        if any(c[-1]["content"].endswith("p7") for c in chats):
            raise RuntimeError("down")
        return inf.echo_model(chats, params)

    req = _requests(spark)
    inf.run_resumable(spark, req, counting, path, batch_size=1, retries=0, backoff_seconds=0.0)
    first = calls.value
    res = spark.read.parquet(path)
    assert res.where(F.col("reply").isNotNull()).count() == 29
    # The rerun infers only the pending row; with a healthy model it finishes it.
    inf.run_resumable(spark, req, inf.echo_model, path, batch_size=1)
    assert spark.read.parquet(path).where(F.col("reply").isNotNull()).count() == 30
    before = spark.read.parquet(path).count()
    inf.run_resumable(spark, req, inf.echo_model, path)
    assert spark.read.parquet(path).count() == before  # a finished job writes nothing
    assert first == 30


def test_streaming_available_now(spark):
    base = tempfile.mkdtemp(prefix="rs-stream-")
    src, sink, ckpt = f"{base}/in", f"{base}/out", f"{base}/ckpt"
    req = _requests(spark).select("row_id", "model", "mode", "messages", "temperature")
    req.where("row_id < 15").write.parquet(src, mode="append")
    inf.stream_inference(spark, src, req.schema, inf.echo_model, sink, ckpt)
    assert spark.read.parquet(sink).count() == 15
    req.where("row_id >= 10").write.parquet(src, mode="append")  # overlaps 10..14: not inferred twice
    inf.stream_inference(spark, src, req.schema, inf.echo_model, sink, ckpt)
    out = spark.read.parquet(sink)
    assert out.count() == 30 and out.select("row_id").distinct().count() == 30


def test_factory_built_once_per_worker(spark):
    def factory():
        import os as _os
        import time as _t

        tag = f"{_os.getpid()}:{_t.time_ns()}"
        return lambda chats, params: [tag] * len(chats)

    out = inf.run_inference(_requests(spark, 40).repartition(8), fn_factory=factory, batch_size=3).collect()
    tags = {r["reply"] for r in out}
    pids = {t.split(":")[0] for t in tags}
    assert len(tags) == len(pids)  # one model object per worker process, however many tasks and batches
    with pytest.raises(ValueError):
        inf.run_inference(_requests(spark, 2))


def test_two_factories_in_one_session_stay_apart(spark):
    def loader(tag):
        return lambda: (lambda chats, params: [tag] * len(chats))

    req = _requests(spark, 8)
    for tag in ("model_A", "model_B", "model_A"):
        assert {r["reply"] for r in inf.run_inference(req, fn_factory=loader(tag)).collect()} == {tag}


def test_one_bad_row_costs_no_other(spark):
    def picky(chats, params):
        if any(c[-1]["content"].endswith("p5") for c in chats):
            raise RuntimeError("bad row")
        return inf.echo_model(chats, params)

    out = inf.run_inference(_requests(spark, 32).coalesce(1), picky, batch_size=16, retries=0, backoff_seconds=0.0).collect()
    assert {r["row_id"] for r in out if r["reply"] is None} == {5} and len(out) == 32


def test_killed_run_keeps_its_finished_chunks(spark):
    path = tempfile.mkdtemp(prefix="rs-kill-") + "/out"
    req = _requests(spark, 40)
    chunk = {r[0]: r[1] for r in req.select("row_id", F.pmod(F.xxhash64(*inf.KEYS), F.lit(4)).alias("c")).collect()}
    third = min(i for i, c in chunk.items() if c == 2)

    def dies(chats, params):
        if any(c[-1]["content"].endswith(f"p{third}") for c in chats):
            raise SystemExit("killed")  # not a model failure: ends the task
        return inf.echo_model(chats, params)

    with pytest.raises(Exception):
        inf.run_resumable(spark, req, dies, path, chunks=4, batch_size=1)
    kept = {r[0] for r in spark.read.parquet(path).select("row_id").collect()}
    assert kept == {i for i, c in chunk.items() if c < 2}
    out = inf.run_resumable(spark, req, inf.echo_model, path, chunks=4)
    assert out.count() == 40 and out.where("reply is null").count() == 0


def test_one_row_per_key_after_a_retry(spark):
    path = tempfile.mkdtemp(prefix="rs-retry-") + "/out"

    def down(chats, params):
        raise RuntimeError("down")

    req = _requests(spark, 5)
    assert inf.run_resumable(spark, req, down, path, retries=0, backoff_seconds=0.0).where("error is not null").count() == 5
    out = inf.run_resumable(spark, req, inf.echo_model, path).collect()
    assert len(out) == 5 and all(r["reply"] and r["error"] is None for r in out)


def test_unreadable_path_is_not_taken_for_missing(spark):
    with pytest.raises(Exception):
        inf.run_resumable(spark, _requests(spark, 2), inf.echo_model, "nosuchfs://bucket/runs")
    assert not io.exists(spark, "/tmp/does/not/exist/at/all")


def test_null_prompts_are_not_sent(spark):
    req = _requests(spark, 4).withColumn("messages", F.when(F.col("row_id") != 2, F.col("messages")))

    def no_empty(chats, params):
        assert all(chats)
        return inf.echo_model(chats, params)

    out = {r["row_id"]: r for r in inf.run_inference(req, no_empty, batch_size=4).collect()}
    assert out[2]["reply"] is None and out[2]["error"] is None and out[1]["reply"]


def test_logprobs_come_back_as_json(spark):
    def scored(chats, params):
        return [{"reply": "a", "logprobs": [{"token": "a", "logprob": -0.5}]} for _ in chats]

    r = inf.run_inference(_requests(spark, 1), scored, logprobs=True).first()
    assert r["reply"] == "a" and r["logprobs"] == '[{"token": "a", "logprob": -0.5}]'


def test_a_chunk_reads_only_its_bucket(spark):
    path = tempfile.mkdtemp(prefix="rs-bucket-") + "/out"
    req = _requests(spark, 40)
    inf.run_resumable(spark, req, inf.echo_model, path, chunks=4)
    plan = inf.pending(req, inf.finished_in(spark, path, 4, 1))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan
    assert len(inf.finished_in(spark, path, 4, 1).inputFiles()) > 0
    files = set(inf.finished_in(spark, path, 4, 1).select(F.input_file_name()).distinct().toPandas().iloc[:, 0])
    assert all("/bucket=1/" in f for f in files)
    # Another number of chunks still finds every finished key.
    calls = spark.sparkContext.accumulator(0)

    def counting(chats, params):
        calls.add(len(chats))
        return inf.echo_model(chats, params)

    assert inf.run_resumable(spark, req, counting, path, chunks=3).count() == 40 and calls.value == 0


def test_of_two_replies_always_the_same(spark):
    path = tempfile.mkdtemp(prefix="rs-two-") + "/out"
    rows = [(1, "m", "standard", r, None, 1, 0) for r in ("b", "a", "c")] + [(1, "m", "standard", None, "down", 1, 0)]
    df = spark.createDataFrame(rows, "row_id long, model string, mode string, reply string, error string, buckets int, bucket int")
    for part in (df, df.orderBy("reply")):
        part.write.mode("append").partitionBy("model", "mode", "buckets", "bucket").parquet(path)
    picked = {inf.results(spark, path).first()["reply"] for _ in range(3)}
    assert len(picked) == 1 and picked <= {"a", "b", "c"}


def test_stream_batches_do_not_read_the_sink(spark):
    """A replayed micro-batch overwrites its own folder, and keys of earlier runs are known from the state."""
    base = tempfile.mkdtemp(prefix="rs-state-")
    src, sink, ckpt = f"{base}/in", f"{base}/out", f"{base}/ckpt"
    req = _requests(spark).select("row_id", "model", "mode", "messages", "temperature")
    for i in range(3):
        req.where(F.col("row_id") % 3 <= i).coalesce(1).write.mode("append").parquet(src)
    calls = spark.sparkContext.accumulator(0)

    def counting(chats, params):
        calls.add(len(chats))
        return inf.echo_model(chats, params)

    inf.stream_inference(spark, src, req.schema, counting, sink, ckpt, files_per_batch=1)
    inf.stream_inference(spark, src, req.schema, counting, sink, ckpt, files_per_batch=1)
    out = spark.read.parquet(sink)
    assert out.count() == calls.value == 30 and out.select("bucket").distinct().count() == 3


def test_a_stream_s_failures_are_for_the_batch_run(spark):
    base = tempfile.mkdtemp(prefix="rs-heal-")
    req = _requests(spark).select("row_id", "model", "mode", "messages", "temperature")
    req.write.parquet(f"{base}/in")

    def flaky(chats, params):
        if any(c[-1]["content"].endswith("p7") for c in chats):
            raise RuntimeError("down")
        return inf.echo_model(chats, params)

    inf.stream_inference(spark, f"{base}/in", req.schema, flaky, f"{base}/out", f"{base}/ckpt", batch_size=1, retries=0, backoff_seconds=0.0)
    calls = spark.sparkContext.accumulator(0)

    def counting(chats, params):
        calls.add(len(chats))
        return inf.echo_model(chats, params)

    out = inf.run_resumable(spark, req, counting, f"{base}/out", chunks=2)
    assert calls.value == 1 and out.count() == 30 and out.where("reply is null").count() == 0


def test_rows_stay_in_arrow_until_they_are_sent(spark):
    """a worker turns one call's chats into Python objects, not Spark's whole batch; keys come back as they are, nulls too."""
    rows = [(None if i == 3 else i, "m", None if i == 5 else "standard", i % 10) for i in range(25)]
    df = spark.createDataFrame(rows, "row_id long, model string, mode string, n int").coalesce(1)
    text = F.concat(F.lit("p"), F.col("n").cast("string"))
    req = df.withColumn("messages", F.array(prompts.msg("user", text))).withColumn("temperature", F.lit(0.0))

    def sizes(chats, params):
        return [f"{len(chats)}" for _ in chats]

    out = inf.run_inference(req, sizes, batch_size=10)
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    got = out.collect()
    assert [r["reply"] for r in got] == ["10"] * 20 + ["5"] * 5
    assert [(r["row_id"], r["mode"]) for r in got] == [(r[0], r[2]) for r in rows]
