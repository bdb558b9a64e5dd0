"""Canonical schemas (long format: model and mode are data columns, not column names)."""

from pyspark.sql import types as T

ANNOTATIONS = T.StructType([
    T.StructField("row_id", T.LongType(), False),
    T.StructField("dataset_id", T.IntegerType(), True),
    T.StructField("set_id", T.IntegerType(), True),
    T.StructField("example_id", T.LongType(), True),
    T.StructField("nat_instr_id", T.StringType(), True),
    T.StructField("user_id", T.LongType(), True),
    T.StructField("nat_lang", T.StringType(), True),
    T.StructField("time", T.TimestampType(), True),
    T.StructField("validated", T.IntegerType(), True),
    T.StructField("task_def", T.StringType(), True),
    T.StructField("instruction", T.StringType(), True),
    T.StructField("prompt_instruction", T.StringType(), True),
    T.StructField("prompt_en", T.StringType(), True),
    T.StructField("req_output", T.StringType(), True),
])

GOLD = T.StructType([
    T.StructField("nat_instr_id", T.StringType(), True),
    T.StructField("generated_req_output", T.StringType(), True),
])

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
MESSAGES = T.ArrayType(MESSAGE)

RUNS = T.StructType([
    T.StructField("row_id", T.LongType(), False),
    T.StructField("model", T.StringType(), False),
    T.StructField("mode", T.StringType(), False),
    T.StructField("messages", MESSAGES, True),
    T.StructField("temperature", T.DoubleType(), True),
    T.StructField("reply", T.StringType(), True),
    T.StructField("side_output", T.StringType(), True),
    T.StructField("error", T.StringType(), True),
])

SCORES = T.StructType(
    [
        T.StructField("row_id", T.LongType(), False),
        T.StructField("model", T.StringType(), True),
        T.StructField("mode", T.StringType(), True),
        T.StructField("approach", T.StringType(), True),
    ]
    + [T.StructField(m, T.DoubleType(), True) for m in (
        "accuracy", "bleu", "rouge_1", "rouge_2", "rouge_l", "rouge_lsum",
        "bertscore_precision", "bertscore_recall", "bertscore_f1",
        "bartscore_faithful", "bartscore_precision", "bartscore_recall", "bartscore_f1",
    )]
)

JUDGEMENTS = T.StructType([
    T.StructField("row_id", T.LongType(), False),
    T.StructField("criterion", T.StringType(), False),
    T.StructField("prompt", T.StringType(), True),
    T.StructField("answer", T.StringType(), True),
])

TOKEN_VECTORS = T.StructType([
    T.StructField("row_id", T.LongType(), False),
    T.StructField("side", T.StringType(), False),
    T.StructField("pos", T.IntegerType(), False),
    T.StructField("token", T.StringType(), True),
    T.StructField("vec", T.ArrayType(T.FloatType()), True),
])

TOKEN_LOGPROBS = T.StructType([
    T.StructField("row_id", T.LongType(), False),
    T.StructField("direction", T.StringType(), False),
    T.StructField("pos", T.IntegerType(), False),
    T.StructField("logprob", T.DoubleType(), True),
    T.StructField("is_pad", T.BooleanType(), True),
])

COHORTS = T.StructType([T.StructField("user_id", T.LongType(), False), T.StructField("cohort", T.StringType(), False)])
