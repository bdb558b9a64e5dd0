from replyscope.operators import wide


def test_wide_to_long(spark):
    df = spark.createDataFrame(
        [(1, 3, "a", "b", "I guess native", "ctx", 1.0)],
        "row_id long, dataset_id int, `gpt3.5 replies` string, `gpt3.5 replies_guess_native` string, "
        "`gpt3.5 guessed_native` string, added_history string, `accuracy_score_gpt3.5 replies` double")
    out = {r["mode"]: r for r in wide.wide_to_long(df, "gpt3", keep=["dataset_id"]).collect()}
    assert set(out) == {"standard", "guess_native"}
    assert out["standard"]["reply"] == "a" and out["standard"]["accuracy"] == 1.0
    assert out["guess_native"]["side_output"] == "I guess native" and out["guess_native"]["accuracy"] is None


def test_model_names(spark):
    df = spark.createDataFrame([("qwen7B_chat",), ("mine",)], "model string")
    out = {r["model"]: (r["display"], r["checkpoint"]) for r in wide.with_model_names(df).collect()}
    assert out == {"qwen7B_chat": ("Qwen1.5-7B-Chat", "Qwen/Qwen1.5-7B-Chat"), "mine": ("mine", "mine")}


def test_history_columns_and_logprobs(spark):
    df = spark.createDataFrame(
        [(1, "h", "texts", "n", "native texts", "[-1]", "[-2]")],
        "row_id long, `gpt3.5 replies_history` string, added_history string, `gpt3.5 replies_history_native` string, "
        "added_history_native string, `gpt3.5 logprobs_history` string, `gpt3.5 logprobs_history_native` string")
    out = {r["mode"]: (r["reply"], r["side_output"], r["logprobs"]) for r in wide.wide_to_long(df, "gpt3").collect()}
    assert out == {"add_history": ("h", "texts", "[-1]"), "add_history_native": ("n", "native texts", "[-2]")}
