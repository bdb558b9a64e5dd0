"""Runs of two calls per row: committed answers, no repeated call, answers that belong together."""

import tempfile

import pytest
from pyspark.sql import functions as F

from replyscope.streaming import inference as inf
from replyscope.streaming import stages as st


def _rows(spark, n=24):
    rows = [(i, "m", "two", i % 10, "Task.", "Answer: <markprompt>[Your Prompt]</markprompt>.", f"p{i}", f"want {i}") for i in range(n)]
    df = spark.createDataFrame(rows, "row_id long, model string, mode string, dataset_id int, task_def string, instruction string, prompt_en string, req_output string")
    return df.withColumn("prompt_instruction", F.concat(F.lit("Do. "), F.col("instruction")))


def _folder():
    return tempfile.mkdtemp(prefix="rs-stages-") + "/run"


def _counting(spark, dies=None):
    """A model that answers differently each time, counts its calls by stage and ends the task where ``dies`` says so."""
    calls = {"first": spark.sparkContext.accumulator(0), "second": spark.sparkContext.accumulator(0)}

    def model(chats, params):
        import time

        out = []
        for c in chats:
            stage = "first" if len(c) == 2 else "second"
            if dies and dies(stage, c):
                raise SystemExit("killed")  # not a model failure: ends the task
            calls[stage].add(1)
            given = c[2]["content"] if stage == "second" and len(c) == 6 else ""
            out.append(f"guess {time.time_ns()}" if stage == "first" else f"after {given}")
        return out

    return calls, model


def test_kill_between_the_stages_repeats_no_call(spark):
    path, df = _folder(), _rows(spark)
    _, dying = _counting(spark, dies=lambda stage, c: stage == "second")
    with pytest.raises(Exception):
        st.run_two_stage(spark, df, st.guess_stages(), dying, path, chunks=2)
    first = {r["row_id"]: r["reply"] for r in inf.results(spark, f"{path}/guess").collect()}
    assert len(first) == 24
    calls, model = _counting(spark)
    out = st.run_two_stage(spark, df, st.guess_stages(), model, path, chunks=2).collect()
    assert calls["first"].value == 0 and calls["second"].value == 24
    assert {r["row_id"]: r["side_output"] for r in out} == first
    assert all(r["reply"] == f"after {r['side_output']}" and r["messages"][2]["content"] == r["side_output"] for r in out)
    # A finished run calls nothing.
    again, model = _counting(spark)
    assert st.run_two_stage(spark, df, st.guess_stages(), model, path, chunks=2).count() == 24
    assert again["first"].value == again["second"].value == 0


def test_kill_within_a_stage_keeps_its_chunks(spark):
    path, df = _folder(), _rows(spark)
    chunk = {r[0]: r[1] for r in df.select("row_id", inf.key_bucket(inf.KEYS, 3).alias("c")).collect()}
    last = min(i for i, c in chunk.items() if c == 2)
    _, dying = _counting(spark, dies=lambda stage, c: c[-1]["content"].endswith(f"p{last}"))
    with pytest.raises(Exception):
        st.run_two_stage(spark, df, st.guess_stages(), dying, path, chunks=3, batch_size=1)
    calls, model = _counting(spark)
    assert st.run_two_stage(spark, df, st.guess_stages(), model, path, chunks=3).where("reply is null").count() == 0
    assert calls["first"].value == sum(c == 2 for c in chunk.values()) and calls["second"].value == 24


def test_a_changed_first_answer_is_asked_again(spark):
    """An answer given to another guess does not count."""
    path, df = _folder(), _rows(spark, 6)
    calls, model = _counting(spark)
    st.run_two_stage(spark, df, st.guess_stages(), model, path, chunks=1)
    moved = _folder()
    spark.read.parquet(f"{path}/answer").write.partitionBy("model", "mode", "buckets", "bucket").parquet(f"{moved}/answer")
    calls, model = _counting(spark)
    out = st.run_two_stage(spark, df, st.guess_stages(), model, moved, chunks=1).collect()
    assert calls["first"].value == 6 and calls["second"].value == 6 and len(out) == 6
    assert all(r["reply"] == f"after {r['side_output']}" for r in out)


def test_failed_first_answers_stop_their_row_only(spark):
    path, df = _folder(), _rows(spark, 8)

    def model(chats, params):
        if any(c[-1]["content"].endswith("p3") and len(c) == 2 for c in chats):
            raise RuntimeError("refused")
        return inf.echo_model(chats, params)

    out = {r["row_id"]: r for r in st.run_two_stage(spark, df, st.guess_stages(), model, path, chunks=2, retries=0, backoff_seconds=0.0).collect()}
    assert len(out) == 8 and out[3]["reply"] is None and "refused" in out[3]["error"] and out[3]["messages"] is None
    assert all(r["reply"] and r["error"] is None for i, r in out.items() if i != 3)
    healed = st.run_two_stage(spark, df, st.guess_stages(), inf.echo_model, path, chunks=2)
    assert healed.where("reply is null or error is not null").count() == 0


def test_gold_fills_the_written_prompt(spark):
    out = {r["row_id"]: r for r in st.run_two_stage(spark, _rows(spark, 4), st.gold_stages(), inf.echo_model, _folder(), chunks=1).collect()}
    r = out[2]
    assert "Do. Answer: [Your Prompt]." in r["side_output"] and r["side_output"].endswith("want 2")
    assert r["messages"][-1]["content"].startswith("Do. Answer: ") and r["side_output"] in r["messages"][-1]["content"]
    assert r["temperature"] is not None and r["reply"].endswith(r["messages"][-1]["content"])


def test_three_stages_chain(spark):
    ask = lambda name: st.Stage(name, lambda df: df.withColumn("messages", F.array(F.struct(F.lit("user").alias("role"), F.concat_ws("|", *[c for c in ("a", "b") if c in df.columns], F.lit(name)).alias("content")))).withColumn("temperature", F.lit(0.0)))
    out = st.run_stages(spark, _rows(spark, 2), [ask("a"), ask("b"), ask("c")], lambda chats, params: [c[-1]["content"] + "." for c in chats], _folder(), chunks=1)
    assert {r["c"] for r in out.collect()} == {"a.|a.|b.|c."}


def test_gold_rows_are_built_once(spark):
    """the stages and their result read the built rows, so the label table is not broadcast for each of them."""
    from replyscope.plans import catalog

    out = catalog.QUERIES["gold_two_stage"](spark, "/root/testdata/sf0.001")
    files = out.inputFiles()
    assert files and not any("documents.parquet" in f or "labels.parquet" in f for f in files), files


def test_answers_are_not_broadcast(spark):
    """rows and answers are joined by shuffles, the stages' results too."""
    from replyscope.plans import catalog

    out = catalog.QUERIES["gold_two_stage"](spark, "/root/testdata/sf0.001")
    out.count()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") >= 2
