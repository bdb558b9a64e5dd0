import pytest
from pyspark.sql import functions as F

from replyscope.functions import fixed
from replyscope.operators import prompts


def _df(spark):
    return spark.createDataFrame(
        [(1, 7, "Task 7.", "Text <markprompt>[Your Prompt]</markprompt> end", "hello", "g", "h1, h2", "task1161-3")],
        "row_id long, dataset_id int, task_def string, instruction string, prompt_en string, guess string, "
        "history string, nat_instr_id string")


def test_standard_chat(spark):
    r = prompts.build_messages(_df(spark)).first()
    assert [m["role"] for m in r["messages"]] == ["system", "user", "assistant", "user"]
    assert r["messages"][1]["content"] == "Task 7.  Only respond with the paragraph."
    assert r["messages"][3]["content"] == "Text hello end"
    assert r["temperature"] == 0.7


def test_modes(spark):
    g = prompts.build_messages(_df(spark), mode="guess_native").first()["messages"]
    assert g[2]["content"] == "g" and g[3]["content"].startswith("Next, execute  the following")
    h = prompts.build_messages(_df(spark), mode="add_history").first()["messages"]
    assert h[1]["content"] == fixed.HISTORY_INTRO + "h1, h2" and h[2]["content"] == "Ok."
    n = prompts.build_messages(_df(spark), mode="add_all_native").first()["messages"]
    assert n[0]["content"] == fixed.SYSTEM_NATIVE
    t = prompts.build_messages(_df(spark), trial=True).first()["messages"]
    assert len(t) == 2 and t[0]["content"].endswith(" Task 7.  Only respond with the paragraph.")


def test_conflicting_options_raise():
    with pytest.raises(ValueError):
        prompts.resolve_mode("guess_native", gold_mode="add_prompt_then_true")
    assert prompts.resolve_mode("add_history") == "add_history"


def test_judge_prompts_and_regroup(spark):
    df = _df(spark).withColumn("reply", F.lit("an article")).withColumn("final_prompt_en", F.lit("a title"))
    p = prompts.judge_prompts(df).orderBy("k").collect()
    assert [r["criterion"] for r in p] == ["fluency", "coherence", "relevance"]
    assert p[0]["prompt"].startswith("You will be given a article generated based on a title.")
    assert "Coherence (1-5)" in p[1]["prompt"] and "Relevance (1-5)" in p[2]["prompt"]
    other = _df(spark).withColumn("nat_instr_id", F.lit(None).cast("string")).withColumn("reply", F.lit("x")) \
        .withColumn("final_prompt_en", F.lit("y"))
    assert all(r["prompt"] is None for r in prompts.judge_prompts(other).collect())

    answers = spark.createDataFrame([(1, "fluency", " 3\n"), (1, "coherence", "4"), (1, "relevance", "5 ")],
                                    "row_id long, criterion string, answer string")
    r = prompts.regroup_judgements(answers).first()
    assert (r["fluency"], r["coherence"], r["relevance"]) == ("3", "4", "5")
    missing = answers.where("criterion != 'relevance'")
    with pytest.raises(Exception, match="Mismatch"):
        prompts.regroup_judgements(missing).collect()
