"""Query catalogue: name -> callable(spark, sf_dir) -> DataFrame, each a whole-table Spark plan over the driver
tables (or the surrogate views Spark derives from them). The DuckDB twin of each is in ``oracle.SQL``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replyscope.functions import fixed
from replyscope.functions import text as T
from replyscope.operators import accuracy as acc
from replyscope.operators import cohorts as coh
from replyscope.operators import joins, overlap, report, sampling, scores, stats, timing
from replyscope.operators import modelscores as ms
from replyscope.operators import prompts as P
from replyscope.operators import vectors as vx
from replyscope.operators import wide
from replyscope.sources import fixtures as fx
from replyscope.sources import io
from replyscope.streaming import inference as inf
from replyscope.streaming import stages as st

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RUN_KEYS = ("row_id", "model", "mode")
REPORT_COHORTS = (coh.NATIVE, coh.STRICT, "western_native_or_not")


def query(name: str):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


# ------------------------------------------------------------------------------------------------ shared inputs


def labeled(spark: SparkSession, sf: str) -> DataFrame:
    ann = fx.annotations(spark, sf)
    return coh.label_cohorts(ann, fx.cohorts(ann))


def scored_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs with cohort labels, guess labels and accuracy (the input of the run reports)."""
    runs = fx.runs(fx.annotations(spark, sf))
    runs = coh.label_cohorts(runs)
    runs = report.with_guess(runs)
    return acc.score_accuracy(runs)


# ------------------------------------------------------------------------------------------------ cohorts, accuracy


@query("cohort_labels")
def cohort_labels(spark, sf):
    return labeled(spark, sf).select(
        "row_id", "user_id", "nat_lang", coh.NATIVE, coh.STRICT, *coh.MEMBERSHIP_COLUMNS
    )


@query("cohort_membership_join")
def cohort_membership_join(spark, sf):
    ann = fx.annotations(spark, sf)
    students = fx.cohorts(ann).where(F.col("cohort") == "student").select("user_id")
    return ann.join(students, "user_id", "left_semi").select("row_id", "user_id")


def _accuracy_rows(spark, sf, ids=None):
    ann = fx.annotations(spark, sf)
    if ids is not None:
        ann = ann.where(F.col("dataset_id").isin(*ids))
    return acc.score_accuracy(ann).select("row_id", "dataset_id", "reply", "req_output", "accuracy")


query("accuracy_all")(lambda spark, sf: _accuracy_rows(spark, sf))
query("accuracy_ratings")(lambda spark, sf: _accuracy_rows(spark, sf, acc.RATING_DATASETS))
query("accuracy_options")(lambda spark, sf: _accuracy_rows(spark, sf, acc.OPTION_DATASETS))
query("accuracy_yesno")(lambda spark, sf: _accuracy_rows(spark, sf, acc.YES_NO_DATASETS))
query("accuracy_choice")(lambda spark, sf: _accuracy_rows(spark, sf, acc.CHOICE_DATASETS))


def _macro_accuracy(spark, sf, by=(), drop3=False):
    df = labeled(spark, sf).where(F.col("validated") == 1)
    if drop3:
        df = report.drop_dataset(df, 3)
    df = acc.score_accuracy(df)
    long = coh.unpivot_cohorts(df, REPORT_COHORTS, keep=["example_id", *by, "accuracy"])
    return report.macro_average(long, "cohort", by=["cohort_type", *by]).select(
        "cohort_type", "cohort", *by, "accuracy"
    )


query("macro_accuracy_overall")(lambda spark, sf: _macro_accuracy(spark, sf))
query("macro_accuracy_set")(lambda spark, sf: _macro_accuracy(spark, sf, by=("set_id",)))
query("macro_accuracy_dataset")(lambda spark, sf: _macro_accuracy(spark, sf, by=("dataset_id",)))
query("no3")(lambda spark, sf: _macro_accuracy(spark, sf, drop3=True))


@query("macro_accuracy_sets")
def macro_accuracy_sets(spark, sf):
    """A1-A3: overall, per set and per dataset in one pass."""
    df = acc.score_accuracy(labeled(spark, sf).where(F.col("validated") == 1))
    long = coh.unpivot_cohorts(df, REPORT_COHORTS, keep=["example_id", "set_id", "dataset_id", "accuracy"])
    return report.macro_average_sets(long, "cohort", by=["cohort_type"]).select(
        "level", "cohort_type", "cohort", "set_id", "dataset_id", "accuracy")


@query("guess_labels")
def guess_labels(spark, sf):
    runs = fx.runs(fx.annotations(spark, sf)).where(F.col("mode") == "guess_native")
    return runs.select("row_id", "side_output", coh.guess_label("side_output").alias("final_guess"))


@query("guess_counts")
def guess_counts(spark, sf):
    return report.guess_counts(scored_runs(spark, sf))


# ------------------------------------------------------------------------------------------------ text functions


STATS_COHORTS = (coh.NATIVE, coh.STRICT, "western_native_or_not", "african_or_not")
EVENT_COHORTS = (coh.NATIVE, coh.STRICT, "western_native_or_not", "african_or_not")


@query("placeholder_fill")
def placeholder_fill(spark, sf):
    ann = fx.annotations(spark, sf)
    return ann.select("row_id", "instruction", "prompt_en", T.fill_placeholder("instruction", "prompt_en").alias("final_prompt_en"))


@query("strip_tags")
def strip_tags(spark, sf):
    return fx.annotations(spark, sf).select("row_id", T.strip_tags("instruction").alias("stripped"))


def pair_text() -> F.Column:
    """Fixture: replies stored as stringified (guess, reply) pairs, with single or double quotes, or plain."""
    a, b = F.col("prompt_en"), F.col("reply")
    single = F.concat(F.lit("('"), a, F.lit("', '"), b, F.lit("')"))
    double = F.concat(F.lit('("'), a, F.lit('", "'), b, F.lit('")'))
    return F.when(F.col("row_id") % 3 == 0, single).when(F.col("row_id") % 3 == 1, double).otherwise(F.col("reply"))


@query("unwrap_pair")
def unwrap_pair(spark, sf):
    df = fx.annotations(spark, sf).select("row_id", pair_text().alias("pair"))
    return df.select("row_id", "pair", T.unwrap_pair("pair").alias("unwrapped"))


@query("digit_sum")
def digit_sum(spark, sf):
    ann = fx.annotations(spark, sf)
    return ann.select(
        "row_id", "dataset_id",
        T.digit_sum_text("reply").alias("reply_digit_sum"),
        T.digit_sum_text("prompt_en").alias("prompt_digit_sum"),
        acc.predicted_rating().cast("string").alias("predicted_rating"),
    )


@query("word_count_by_group")
def word_count_by_group(spark, sf):
    df = stats.with_word_counts(labeled(spark, sf))
    long = coh.unpivot_cohorts(df, STATS_COHORTS, keep=["dataset_id", "word_count_annotation", "word_count_generated"])
    return stats.mean_word_counts(long, ["cohort_type", "cohort", "dataset_id"])


@query("task_suffix")
def task_suffix(spark, sf):
    return fx.annotations(spark, sf).select("row_id", "dataset_id", P.task_definition().alias("task_definition"))


@query("temperature")
def temperature(spark, sf):
    return fx.annotations(spark, sf).select("row_id", "dataset_id", P.temperature().alias("temperature"))


@query("judge_kind")
def judge_kind(spark, sf):
    gen, comp = P.judge_kind()
    return fx.annotations(spark, sf).select("row_id", "nat_instr_id", gen.alias("doc_gen"), comp.alias("doc_comp"))


# ------------------------------------------------------------------------------------------------ time, histograms


def events_with_gap(spark, sf):
    ev = fx.table(spark, sf, "events")
    return timing.gap_to_previous(ev, user="user_id", ts="ts", tie=("event_id",))


@query("annotation_gap")
def annotation_gap(spark, sf):
    return events_with_gap(spark, sf).select("event_id", "user_id", "ts", timing.GAP)


def events_long(spark, sf):
    ev = events_with_gap(spark, sf)
    ev = coh.label_cohorts(ev.withColumn("nat_lang", fx.event_language()), fx.cohorts(ev))
    return coh.unpivot_cohorts(ev, EVENT_COHORTS, keep=[F.col("event_type").alias("set_id"), "user_id", timing.GAP])


@query("mean_gap_by_group")
def mean_gap_by_group(spark, sf):
    return timing.mean_gap(events_long(spark, sf), ["set_id", "cohort_type", "cohort"])


@query("total_time_by_group")
def total_time_by_group(spark, sf):
    return timing.total_time(events_long(spark, sf), ["set_id", "cohort_type", "cohort"])


@query("rating_histogram")
def rating_histogram(spark, sf):
    df = acc.score_accuracy(labeled(spark, sf))
    df = df.where((F.col("dataset_id") == 3) & (F.col("accuracy") == 0))
    df = df.select(
        *STATS_COHORTS,
        acc.predicted_rating().cast("double").alias("predicted"),
        F.col("req_output").try_cast("int").cast("double").alias("req_output"),
    )
    long = coh.unpivot_cohorts(df, STATS_COHORTS, keep=["predicted", "req_output"])
    values = long.unpivot(["cohort_type", "cohort"], ["predicted", "req_output"], "source", "value")
    return stats.histogram(values, "value", keys=["cohort_type", "cohort", "source"])


# ------------------------------------------------------------------------------------------------ history sampling


@query("history_sample_user")
def history_sample_user(spark, sf):
    return sampling.sample_history(fx.annotations(spark, sf), pool="user", keep=("row_id",)).select("row_id", "history")


@query("history_sample_cohort")
def history_sample_cohort(spark, sf):
    return sampling.sample_history(fx.annotations(spark, sf), pool="native", keep=("row_id",)).select("row_id", "history")


@query("history_sample_non_native")
def history_sample_non_native(spark, sf):
    return sampling.sample_history(fx.annotations(spark, sf), pool="non_native", keep=("row_id",)).select("row_id", "history")


# ------------------------------------------------------------------------------------------------ chats


def validated(spark, sf):
    return fx.annotations(spark, sf).where(F.col("validated") == 1)


def _flat(df, extra=("temperature",)):
    return P.flatten_messages(df, keys=("row_id", *extra))


@query("chat_standard")
def chat_standard(spark, sf):
    return _flat(P.build_messages(validated(spark, sf), mode="standard"))


@query("chat_native")
def chat_native(spark, sf):
    return _flat(P.build_messages(validated(spark, sf), mode="add_all_native"))


@query("chat_trial")
def chat_trial(spark, sf):
    return _flat(P.build_messages(validated(spark, sf), mode="standard", trial=True))


def guess_fixture() -> F.Column:
    return F.element_at(F.array(*[F.lit(t) for t in fx.GUESS_TEXTS]), (F.col("row_id") % len(fx.GUESS_TEXTS) + 1).cast("int"))


@query("chat_guess")
def chat_guess(spark, sf):
    df = validated(spark, sf)
    a = df.select("row_id", F.lit("a").alias("stage"), F.lit(0.0).alias("temperature"),
                  P.guess_question_chat(P.system_prompt("guess_native"), F.col("prompt_en")).alias("messages"))
    b = P.build_messages(df.withColumn("guess", guess_fixture()), mode="guess_native").select(
        "row_id", F.lit("b").alias("stage"), "temperature", "messages")
    return P.flatten_messages(a.unionByName(b), keys=("row_id", "stage", "temperature"))


# What a chat is built from: a row takes these columns, and no others, to where its history is.
CHAT_COLUMNS = ("row_id", "dataset_id", "task_def", "instruction", "prompt_en")


@query("chat_history")
def chat_history(spark, sf):
    df = sampling.sample_history(validated(spark, sf), pool="user", keep=CHAT_COLUMNS).where(F.col("history").isNotNull())
    return _flat(P.build_messages(df, mode="add_history"))


@query("chat_history_native")
def chat_history_native(spark, sf):
    """The chat of every row with texts of the native pool. The turn with the history is built where the drawn texts meet, the other turns where
    the row is, so that its own text does not move."""
    rows = validated(spark, sf)
    drawn = sampling.sample_history(rows, pool="native", keep=("row_id", "dataset_id"), meet="text").where(F.col("history").isNotNull())
    drawn = drawn.withColumns({c: F.lit(None).cast("string") for c in ("task_def", "instruction", "prompt_en")})
    asked = rows.where(sampling.has_history(rows, "native")).select(*CHAT_COLUMNS, F.lit(None).cast("string").alias("history"))
    told, others = [_flat(P.build_messages(df, mode="add_history_native")) for df in (drawn, asked)]
    return told.where(F.col("turn") == P.HISTORY_TURN).unionByName(others.where(F.col("turn") != P.HISTORY_TURN))


@query("chat_non_native")
def chat_non_native(spark, sf):
    return _flat(P.build_messages(validated(spark, sf), mode="add_all_non_native"))


@query("chat_gold")
def chat_gold(spark, sf):
    df = fx.annotations(spark, sf).withColumn("final_prompt_en", F.col("instruction"))
    a = df.select("row_id", F.lit("model_a").alias("model"), F.lit("gold").alias("mode"),
                  P.prompt_writer_chat(P.task_definition(), F.col("final_prompt_en"), F.col("req_output")).alias("messages"),
                  F.lit(0.0).alias("temperature"))
    written = inf.run_inference(a, inf.echo_model).select("row_id", F.col("reply").alias("written_prompt"))
    b = df.join(written, "row_id").select(
        "row_id", P.gold_answer_chat(P.task_definition(), F.col("final_prompt_en"), F.col("written_prompt")).alias("messages"),
        P.temperature().alias("temperature"))
    a2 = a.select("row_id", F.lit("a").alias("stage"), "temperature", "messages")
    return P.flatten_messages(a2.unionByName(b.withColumn("stage", F.lit("b"))), keys=("row_id", "stage", "temperature"))


# ------------------------------------------------------------------------------------------------ inference


def standard_requests(spark, sf):
    df = P.build_messages(validated(spark, sf), mode="standard")
    return df.withColumn("model", F.lit("model_a")).withColumn("mode", F.lit("standard"))


@query("infer_stub")
def infer_stub(spark, sf):
    return inf.run_inference(standard_requests(spark, sf), inf.echo_model)


def logprob_model(chats: list, params: list) -> list:
    """Stand-in model that answers with log-probabilities: one token, the length of the last turn."""
    lengths = [len(c[-1]["content"]) for c in chats]
    return [{"reply": str(n), "logprobs": [{"token": str(n), "logprob": -n / 8}]} for n in lengths]


@query("infer_logprobs")
def infer_logprobs(spark, sf):
    """Replies with their token log-probabilities as JSON text."""
    return inf.run_inference(standard_requests(spark, sf), logprob_model, logprobs=True)


@query("decoding_parameters")
def decoding_parameters(spark, sf):
    """The decoding parameters of each row's request and of its judge."""
    rows = fx.annotations(spark, sf).withColumn("temperature", P.temperature())
    out = rows.select("row_id", "dataset_id", inf.decoding_params().alias("p"), inf.judge_params().alias("j"))
    return out.select("row_id", "dataset_id", "p.*", *[F.col(f"j.{c}").alias(f"judge_{c}") for c in ("temperature", "top_p", "max_tokens", "seed")])


@query("guess_two_stage")
def guess_two_stage(spark, sf):
    """The stub's committed guess goes into the second chat, and both answers are kept."""
    df = validated(spark, sf).withColumn("model", F.lit(fx.RUN_MODEL)).withColumn("mode", F.lit("guess_native"))
    out = st.run_two_stage(spark, df, st.guess_stages(), inf.echo_model, io.new_folder(spark, "guess"), chunks=2)
    return out.select(*RUN_KEYS, "temperature", "side_output", "reply", "error")


@query("gold_two_stage")
def gold_two_stage(spark, sf):
    """The stub's committed prompt fills the prompt instruction, and is kept beside the answer."""
    df = fx.annotations(spark, sf).withColumn("prompt_instruction", fx.prompt_instruction())
    df = df.withColumn("model", F.lit(fx.RUN_MODEL)).withColumn("mode", F.lit("gold"))
    # Both stages' chunks and the result read the rows: built once, their label join broadcasts the labels once.
    df = io.materialize(df.select(*RUN_KEYS, "dataset_id", "task_def", "instruction", "prompt_instruction", "req_output"), "gold-rows")
    out = st.run_two_stage(spark, df, st.gold_stages(), inf.echo_model, io.new_folder(spark, "gold"), chunks=2)
    return out.select(*RUN_KEYS, "temperature", "side_output", "reply", "error")


@query("chat_gold_true")
def chat_gold_true(spark, sf):
    """Gold mode True answers the instruction as it stands."""
    return _flat(P.build_messages(validated(spark, sf), gold_mode="True"))


@query("stream_resume")
def stream_resume(spark, sf):
    """I1 as a stream: the requests arrive as files, half of them in a first run and all, the first ones again, in a second."""
    base = io.new_folder(spark, "stream")
    req = standard_requests(spark, sf).select(*RUN_KEYS, "messages", "temperature")
    for part in (req.where(F.col("row_id") % 2 == 0), req):
        part.write.mode("append").parquet(f"{base}/requests")
        inf.stream_inference(spark, f"{base}/requests", req.schema, inf.echo_model, f"{base}/replies", f"{base}/log")
    return spark.read.parquet(f"{base}/replies").select(*RUN_KEYS, "reply", "error")


@query("resume_pending")
def resume_pending(spark, sf):
    """Rows still to run for five requested modes, given the finished runs."""
    ann = validated(spark, sf)
    wanted = ann.select("row_id", F.lit(fx.RUN_MODEL).alias("model"),
                        F.explode(F.array(*[F.lit(m) for m in (*fx.RUN_MODES, "add_history")])).alias("mode"))
    done = fx.runs(fx.annotations(spark, sf)).select("row_id", "model", "mode", "reply")
    return inf.pending(wanted, done)


# ------------------------------------------------------------------------------------------------ judge


def judged_rows(spark, sf):
    """Generation rows of two runs with the prompt they answered."""
    runs = fx.runs(fx.annotations(spark, sf)).where(
        F.col("mode").isin("standard", "add_all_native") & F.col("dataset_id").isin(*fixed.GENERATION_DATASETS))
    return runs.withColumn("final_prompt_en", T.fill_placeholder("instruction", "prompt_en"))


@query("judge_prompts")
def judge_prompts(spark, sf):
    return P.judge_prompts(judged_rows(spark, sf), keys=RUN_KEYS)


@query("judge_requests_jsonl")
def judge_requests_jsonl(spark, sf):
    return io.judge_request_lines(P.judge_prompts(judged_rows(spark, sf), keys=RUN_KEYS), keys=RUN_KEYS)


@query("judge_regroup")
def judge_regroup(spark, sf):
    prompts = P.judge_messages(P.judge_prompts(judged_rows(spark, sf), keys=RUN_KEYS))
    answers = inf.run_inference(prompts, inf.echo_model, keys=(*RUN_KEYS, "k", "criterion"), params=inf.judge_params())
    return P.regroup_judgements(answers.withColumnRenamed("reply", "answer"), keys=RUN_KEYS)


# ------------------------------------------------------------------------------------------------ overlap metrics


# All metrics but ROUGE-Lsum, whose union of subsequences has no SQL form to check it by; ``run_comparison_all`` has all 13.
COMPARED_METRICS = tuple(m for m in report.metric_columns("all") if m != "rouge_lsum")


def _overlap_rows(spark, sf, **kw):
    return overlap.score_overlap(fx.annotations(spark, sf), reply="reply", gold="req_output", **kw)


query("char_bleu")(lambda spark, sf: _overlap_rows(spark, sf, rouge_n=False).select("row_id", "dataset_id", "bleu"))
query("rouge1")(lambda spark, sf: _overlap_rows(spark, sf, bleu=False).select("row_id", "dataset_id", "rouge_1"))
query("rouge2")(lambda spark, sf: _overlap_rows(spark, sf, bleu=False).select("row_id", "dataset_id", "rouge_2"))
query("rouge_l")(lambda spark, sf: _overlap_rows(spark, sf, bleu=False, rouge_n=False, rouge_l=True)
                 .select("row_id", "dataset_id", "rouge_l"))
query("rouge_lsum")(lambda spark, sf: _overlap_rows(spark, sf, bleu=False, rouge_n=False, rouge_lsum=True)
                    .select("row_id", "dataset_id", "rouge_lsum"))


@query("dataset_8")
def dataset_8(spark, sf):
    """the rows of one dataset."""
    return fx.annotations(spark, sf).where(F.col("dataset_id") == 8).select("row_id", "dataset_id", "prompt_en", "reply")


@query("full_instruction")
def full_instruction(spark, sf):
    """The source text of a caller's scorer."""
    df = fx.annotations(spark, sf).withColumn("final_prompt_en", T.fill_placeholder("instruction", "prompt_en"))
    return df.select("row_id", P.full_instruction(P.task_definition()).alias("full_instruction"))


@query("filled_accuracy")
def filled_accuracy(spark, sf):
    """P20: macro accuracy of the runs, classification rows without a score counted as wrong."""
    filled = report.fill_missing_accuracy(scored_runs(spark, sf))
    return report.compare_runs(filled, metrics=("accuracy",))


@query("model_names")
def model_names(spark, sf):
    """Rows dealt to the model aliases, with display name and checkpoint."""
    aliases = F.array(*[F.lit(a) for a, _, _ in fixed.MODEL_ALIASES], F.lit("other"))
    rows = fx.annotations(spark, sf).select("row_id", F.element_at(aliases, (F.col("row_id") % F.size(aliases) + 1).cast("int")).alias("model"))
    return wide.with_model_names(rows).select("row_id", "model", "display", "checkpoint")


@query("gold_join")
def gold_join(spark, sf):
    ann = fx.annotations(spark, sf)
    return joins.join_gold(ann, fx.gold(ann)).select("row_id", "nat_instr_id", "generated_req_output")


def score_runs(runs):
    """All metrics of ``runs``, the model-based ones from the stand-in models, whose vectors and log-probabilities come one row per text pair."""
    logprobs = fx.row_logprobs(fx.run_pairs(runs), keys=RUN_KEYS)
    return scores.score_all(runs, lambda pairs: fx.row_vectors(pairs, keys=(scores.PAIR,)), logprobs, "generated_req_output", RUN_KEYS)


def scored_runs_full(spark, sf):
    """Runs scored against the generated gold (approach 2): accuracy on the original gold, all other metrics against
    the gold join's answer, cohort and guess labels. The scores are those of one table that all reports of an application
    share: the first one that needs a score computes and stores it."""
    ann = fx.annotations(spark, sf)
    runs = joins.join_gold(fx.runs(ann), fx.gold(ann))
    path = io.application_folder(spark, f"scores/{sf.strip('/').replace('/', '-')}")
    scores.update_scores(runs, path, score_runs, RUN_KEYS)
    return scores.with_scores(report.with_guess(coh.label_cohorts(runs)), path, RUN_KEYS)


@query("scores_all")
def scores_all(spark, sf):
    """The score table of all runs."""
    return scored_runs_full(spark, sf).select(*RUN_KEYS, *COMPARED_METRICS)


@query("run_comparison_all")
def run_comparison_all(spark, sf):
    return report.compare_runs(scored_runs_full(spark, sf), metrics=report.metric_columns("all"))


@query("run_comparison")
def run_comparison(spark, sf):
    return report.compare_runs(scored_runs_full(spark, sf), metrics=COMPARED_METRICS)


@query("comparison_pivot")
def comparison_pivot(spark, sf):
    long = report.compare_runs(scored_runs_full(spark, sf), metrics=COMPARED_METRICS)
    return report.comparison_table(long, metrics=COMPARED_METRICS, models=[fx.RUN_MODEL])


@query("missing_counts")
def missing_counts(spark, sf):
    """Which rows have no BLEU score is known without computing one."""
    ann = fx.annotations(spark, sf)
    runs = acc.score_accuracy(joins.join_gold(fx.runs(ann), fx.gold(ann)))
    return report.missing_counts(runs.withColumn("bleu", F.when(overlap.scorable(gold="generated_req_output"), F.lit(0.0))))


# ------------------------------------------------------------------------------------------------ model-based scores


@query("greedy_match_score")
def greedy_match_score(spark, sf):
    return ms.score_embedding_match(fx.token_vectors(fx.conversation_pairs(spark, sf)))


@query("loglik_score")
def loglik_score(spark, sf):
    return ms.loglik_f1(fx.token_logprobs(fx.conversation_pairs(spark, sf), refs=1))


@query("multi_ref_score")
def multi_ref_score(spark, sf):
    lp = fx.token_logprobs(fx.conversation_pairs(spark, sf)).where(F.col("direction") == "precision")
    per_ref = ms.mean_loglik(lp, keys=("row_id", "ref_idx"))
    both = report.multi_ref(per_ref, agg=("mean", "max"), refs=2)
    return both.select("row_id", F.col("score_mean").alias("mean_score"), F.col("score_max").alias("max_score"))


# ------------------------------------------------------------------------------------------------ embeddings


def scaled_embeddings(spark, sf):
    return vx.standardize(fx.table(spark, sf, "embeddings"), vec="embedding", group="label")


@query("standardize_vectors")
def standardize_vectors(spark, sf):
    return scaled_embeddings(spark, sf).select(
        "vec_id", "label", F.posexplode("scaled").alias("dim", "value"))


@query("cosine_knn")
def cosine_knn(spark, sf):
    return vx.cosine_knn(scaled_embeddings(spark, sf), k=15).select("label", "vec_id", "rank", "neighbor_id")


@query("cosine_knn_lsh")
def cosine_knn_lsh(spark, sf):
    """E3 by hyperplane buckets; exact where a group fits in one bucket."""
    return vx.cosine_knn_lsh(scaled_embeddings(spark, sf), k=15).select("label", "vec_id", "rank", "neighbor_id")


@query("group_covariance")
def group_covariance(spark, sf):
    return vx.group_covariance(scaled_embeddings(spark, sf))


@query("pca_2d")
def pca_2d(spark, sf):
    return vx.project_2d(scaled_embeddings(spark, sf))


@query("projected_points")
def projected_points(spark, sf):
    """E5: the projected points with the cohort of their annotation, as a scatter plot by cohort needs them."""
    rows = labeled(spark, sf).select(F.col("row_id").alias("vec_id"), coh.NATIVE, coh.STRICT)
    return vx.project_2d(scaled_embeddings(spark, sf)).join(rows, "vec_id").select("label", "vec_id", coh.NATIVE, coh.STRICT, "pc1", "pc2")


@query("comparison_pivot_dataset")
def comparison_pivot_dataset(spark, sf):
    """U2 in dataset mode: one row per (dataset, metric), columns per run and cohort."""
    long = report.compare_runs(scored_runs_full(spark, sf), by=("dataset_id",), metrics=COMPARED_METRICS)
    return report.comparison_table(long, by=("dataset_id",), metrics=COMPARED_METRICS, models=[fx.RUN_MODEL])


# ------------------------------------------------------------------------------------------------ wide files, E1, S9

WIDE_MODEL = "gpt3"


@query("wide_results_roundtrip")
def wide_results_roundtrip(spark, sf):
    """The runs written in the original wide layout (one reply column per mode, a guess column), read
    back to long rows."""
    runs = fx.runs(fx.annotations(spark, sf))
    name = wide.display_name(WIDE_MODEL)
    w = runs.groupBy("row_id").pivot("mode", list(fx.RUN_MODES)).agg(
        F.first("reply").alias("r"), F.first("side_output").alias("s"))
    wide_df = w.select("row_id", *[F.col(f"{m}_r").alias(f"{name} replies{fixed.REPLY_SUFFIX[m]}") for m in fx.RUN_MODES],
                       F.col("guess_native_s").alias(f"{name} guessed_native"))
    return wide.wide_to_long(wide_df, WIDE_MODEL).select("row_id", "model", "mode", "reply", "side_output")


@query("wide_scores_roundtrip")
def wide_scores_roundtrip(spark, sf):
    """A wide table with accuracy and log-probability columns read back to long rows, absent columns as NULL."""
    rows = acc.score_accuracy(fx.runs(fx.annotations(spark, sf)).where(F.col("mode").isin("standard", "add_all_native")))
    name = wide.display_name(WIDE_MODEL)
    w = rows.groupBy("row_id").pivot("mode", ["standard", "add_all_native"]).agg(F.first("reply").alias("r"), F.first("accuracy").alias("a"))
    reply = {m: f"{name} replies{fixed.REPLY_SUFFIX[m]}" for m in ("standard", "add_all_native")}
    wide_df = w.select("row_id", *[F.col(f"{m}_r").alias(c) for m, c in reply.items()], F.col("standard_a").alias(f"accuracy_score_{reply['standard']}"),
                       F.concat(F.lit("[-"), F.length("standard_r"), F.lit("]")).alias(f"{name} logprobs{fixed.REPLY_SUFFIX['standard']}"))
    return wide.wide_to_long(wide_df, WIDE_MODEL).select("row_id", "model", "mode", "reply", "accuracy", "logprobs")


def text_features(texts: list) -> list:
    """Stand-in encoder for tests: (characters, spaces, newlines) of each text."""
    return [[float(len(t)), float(t.count(" ")), float(t.count("\n"))] for t in texts]


@query("embed_texts")
def embed_texts(spark, sf):
    docs = fx.table(spark, sf, "documents")
    return vx.embed(docs.select("doc_id", "text"), "text", text_features).select(
        "doc_id", F.posexplode("embedding").alias("dim", "value"))


@query("judge_request_manifest")
def judge_request_manifest(spark, sf):
    """The manifest of the written shards; the second write, as after a failure, adds nothing."""
    lines = io.judge_request_lines(P.judge_prompts(judged_rows(spark, sf), keys=RUN_KEYS), keys=RUN_KEYS)
    path = io.new_folder(spark, "requests")
    io.write_request_shards(lines.where(F.col("mode") == "standard"), path)
    return io.write_request_shards(lines, path).select("model", "mode", "shard", "n_requests", "n_bytes")


@query("scores_selected")
def scores_selected(spark, sf):
    """Accuracy rows of two approaches written by run, and the runs that a table of runs selects."""
    ann = fx.annotations(spark, sf)
    rows = acc.score_accuracy(fx.runs(ann)).select("row_id", F.lit("generated").alias("approach"), "model", "mode", "accuracy")
    rows = rows.unionByName(rows.withColumn("approach", F.lit("original")).withColumn("accuracy", F.lit(1.0) - F.col("accuracy")))
    base = io.new_folder(spark, "selected")
    io.write_table(rows, f"{base}/scores", partition_by=("approach", "model", "mode"), sort_within=("row_id",))
    runs = rows.select("approach", "model", "mode").distinct()
    chosen = (F.col("approach") == "generated") & F.col("mode").isin("standard", "guess_native")
    io.write_table(runs.withColumn("report", F.when(chosen, F.lit("main"))), f"{base}/runs")
    return io.read_scores_selected(spark, f"{base}/scores", spark.read.parquet(f"{base}/runs").where("report = 'main'")).select(
        "row_id", "approach", "model", "mode", "report", "accuracy")


@query("report_csv")
def report_csv(spark, sf):
    """Annotations and gold written and read with their readers, joined, and the macro accuracy against the
    generated gold as a CSV report, read back."""
    base = io.new_folder(spark, "csv")
    ann = fx.annotations(spark, sf)
    io.write_table(ann.withColumn("time", F.lit(None).cast("timestamp")).withColumn("prompt_instruction", fx.prompt_instruction()), f"{base}/annotations")
    io.write_table(fx.gold(ann).withColumnRenamed("generated_req_output", "answer"), f"{base}/gold")
    rows = io.read_annotations(spark, f"{base}/annotations").where(F.col("validated") == 1)
    rows = coh.label_cohorts(joins.join_gold(rows, io.read_gold(spark, f"{base}/gold", "answer")))
    scored = acc.score_accuracy(rows.withColumn("reply", F.col("generated_req_output")))
    io.write_report_csv(report.macro_average(scored, coh.NATIVE, by=["dataset_id"]), f"{base}/report")
    return spark.read.option("header", True).schema("native_or_not string, dataset_id int, accuracy double").csv(f"{base}/report")
