"""Runs of several model calls per row (C3 guess then answer, C6 write a prompt then answer it) that survive a failure between the calls.

Each stage has a results folder of its own. A stage's answers are committed there before the next stage reads them, so later stages
use exactly the committed answers and a rerun repeats no call: lost tasks of one stage never call the model of an earlier one again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replyscope.operators import prompts
from replyscope.streaming import inference

#: Fingerprint of the answers a later stage was asked with, part of its key.
AFTER = "after"


@dataclass(frozen=True)
class Stage:
    """One model call per row: ``chat`` adds ``messages`` and ``temperature`` to the rows; each earlier stage's answer is a column of that
    stage's name."""

    name: str
    chat: Callable[[DataFrame], DataFrame]


def run_stages(spark: SparkSession, df: DataFrame, stages: Sequence[Stage], fn: inference.ModelFn | None, path: str,
               keys: Sequence[str] = inference.KEYS, **kwargs) -> DataFrame:
    """Run ``stages`` one after the other over ``df``, resuming from what ``path`` already holds; further options are
    ``run_resumable``'s.

    Returns ``df``'s columns with, for each stage, its answer (column of the stage's name, NULL if it failed) and ``<name>_error``, and the
    last stage's ``messages`` and ``temperature``. A row whose answer is missing is not asked by later stages. Answers of a later stage are keyed by
    the row and a fingerprint of the answers before it, so an answer is never paired with another guess than the one it was given."""
    done = df
    stage_keys = list(keys)
    for n, stage in enumerate(stages):
        before = [s.name for s in stages[:n]]
        if before:
            done = done.withColumn(AFTER, F.xxhash64(*before))
            stage_keys = [*keys, AFTER]
        asked = stage.chat(done)
        sent = asked
        for name in before:
            sent = sent.where(F.col(name).isNotNull())
        answers = inference.run_resumable(spark, sent, fn, f"{path.rstrip('/')}/{stage.name}", stage_keys, **kwargs)
        answers = answers.select(*stage_keys, F.col("reply").alias(stage.name), F.col("error").alias(f"{stage.name}_error"))
        # Both sides have a row per request: neither is sent whole to the driver, however well short answers compress.
        done = asked.join(answers.hint("merge"), stage_keys, "left")
    return done.drop(AFTER)


def guess_stages() -> list[Stage]:
    """Ask for a guess about the writer, then for the answer with the guess in the chat."""

    def ask(df: DataFrame) -> DataFrame:
        chat = prompts.guess_question_chat(prompts.system_prompt("guess_native"), F.col("prompt_en"))
        return df.withColumn("messages", chat).withColumn("temperature", F.lit(0.0))

    return [Stage("guess", ask), Stage("answer", lambda df: prompts.build_messages(df, mode="guess_native"))]


def gold_stages(gold_mode: str = "add_prompt_then_true") -> list[Stage]:
    """Let the model write the missing prompt from task, instruction and desired output, then answer it. The instruction is the one that
    ``gold_mode`` chooses (T2)."""

    def write(df: DataFrame) -> DataFrame:
        chat = prompts.prompt_writer_chat(prompts.task_definition(), prompts.final_prompt(gold_mode), F.col("req_output"))
        return df.withColumn("messages", chat).withColumn("temperature", F.lit(0.0))

    return [Stage("written_prompt", write), Stage("answer", lambda df: prompts.build_messages(df, gold_mode=gold_mode))]


def run_two_stage(spark: SparkSession, df: DataFrame, stages: Sequence[Stage], fn: inference.ModelFn | None, path: str,
                  keys: Sequence[str] = inference.KEYS, **kwargs) -> DataFrame:
    """Two ``stages`` as rows of the ``runs`` schema: ``(*keys, messages, temperature, reply, side_output, error)``, ``side_output`` the first
    answer (the guess or the written prompt)."""
    first, last = stages
    out = run_stages(spark, df, stages, fn, path, keys, **kwargs)
    messages = F.when(F.col(first.name).isNotNull(), F.col("messages")).alias("messages")
    error = F.coalesce(f"{last.name}_error", f"{first.name}_error").alias("error")
    return out.select(*keys, messages, "temperature", F.col(last.name).alias("reply"), F.col(first.name).alias("side_output"), error)
