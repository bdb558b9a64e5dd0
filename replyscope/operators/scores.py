"""The score table (J4, S4): every metric of a run's row in one place, keyed by (row_id, model, mode).

``update_scores`` keeps a stored table up to date: only rows that it does not hold yet are scored and appended. A stored score carries a
fingerprint of the values it was made from, so a row whose reply or gold answer changed is scored again and its old score is not
read any more. Reports attach the stored scores with ``with_scores`` and compute no metric themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replyscope.functions import fixed
from replyscope.operators import accuracy, modelscores, overlap
from replyscope.sources import io

KEYS = ("row_id", "model", "mode")
# What a row's scores depend on, and the column that holds the fingerprint of it.
INPUTS = ("dataset_id", "reply", "req_output", "generated_req_output")
INPUT = "input_hash"
PAIR = "__pair"


def score_all(runs: DataFrame, vectors: DataFrame | Callable[[DataFrame], DataFrame], logprobs: DataFrame, gold: str = "req_output",
              keys: Sequence[str] = KEYS, rouge_lsum: bool = True) -> DataFrame:
    """``runs`` with accuracy (against ``req_output``), overlap metrics against ``gold``, ``bertscore_{precision,recall,f1}`` from
    ``vectors(*keys, side, pos, vec)`` and ``bartscore_{faithful,precision,recall,f1}`` from ``logprobs(*keys, direction, pos, logprob,
    is_pad)``, or ``(*keys, targets)`` with each direction's tokens in one array. Rows without tokens get NULL model-based scores. Overlap metrics depend on the two texts alone, so each pair of texts is scored
    once, however many runs gave that reply; so is the embedding match if ``vectors`` is a function, which is given the pairs (``PAIR``, reply,
    gold) and returns their tokens (``PAIR``, side, pos, vec) or one row per pair (``PAIR``, reply_vecs, reply_n, gold_vecs, gold_n, or ``vectors``, a struct of these). The pairs and their scores are written before they are used and joined back; a
    pair of many rows can then be split."""
    rows = accuracy.score_accuracy(runs)
    own = F.concat(F.lit("row:"), F.xxhash64(*keys).cast("string"))  # rows without a pair do not all share one key
    rows = rows.withColumn(PAIR, F.coalesce(F.when(overlap.scorable("reply", gold), F.concat(F.md5("reply"), F.md5(gold))), own))
    pairs = rows.where(overlap.scorable("reply", gold)).groupBy(PAIR).agg(F.any_value("reply").alias("reply"), F.any_value(gold).alias("gold"))
    pairs = io.materialize(pairs, "pairs")
    scored = overlap.score_overlap(pairs, gold="gold", keys=(PAIR,), datasets=None, rouge_l=True, rouge_lsum=rouge_lsum,
                                   row_local=True).drop("reply", "gold")
    if callable(vectors):
        given = vectors(pairs)
        match = modelscores.score_embedding_rows if {"reply_vecs", "vectors"} & set(given.columns) else modelscores.score_embedding_match
        scored = scored.join(_prefixed(match(given, (PAIR,)), (PAIR,), "bertscore"), PAIR, "left")
    out = rows.join(io.materialize(scored, "pair-scores"), PAIR, "left").drop(PAIR)
    if not callable(vectors):
        out = out.join(_prefixed(modelscores.score_embedding_match(vectors, keys), keys, "bertscore"), list(keys), "left")
    loglik = modelscores.loglik_f1_rows if "targets" in logprobs.columns else modelscores.loglik_f1
    return out.join(_prefixed(loglik(logprobs, keys), keys, "bartscore"), list(keys), "left")


def _prefixed(part: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    return part.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in part.columns if c not in keys])


def read_scored(spark: SparkSession, path: str, keys: Sequence[str] = KEYS) -> DataFrame | None:
    """The stored score table, one row per key and fingerprint; None if there is none yet."""
    if not io.exists(spark, path):
        return None
    return spark.read.parquet(path).dropDuplicates([*keys, INPUT])


def with_input(runs: DataFrame, inputs: Sequence[str] = INPUTS) -> DataFrame:
    return runs.withColumn(INPUT, F.xxhash64(*inputs))


def pending_scores(runs: DataFrame, path: str, keys: Sequence[str] = KEYS, inputs: Sequence[str] = INPUTS) -> DataFrame:
    """The rows of ``runs`` (with their fingerprint) that the table at ``path`` holds no score of."""
    rows = with_input(runs, inputs)
    done = read_scored(runs.sparkSession, path, keys)
    return rows if done is None else rows.join(done.select(*keys, INPUT), [*keys, INPUT], "left_anti")


def update_scores(runs: DataFrame, path: str, score: Callable[[DataFrame], DataFrame], keys: Sequence[str] = KEYS,
                  inputs: Sequence[str] = INPUTS, metrics: Sequence[str] = fixed.ALL_METRICS) -> None:
    """Append the ``metrics`` of the rows of ``runs`` that the table at ``path`` (Parquet, partitioned by model and mode) does not
    hold yet. ``score`` adds them to the rows it is given and keeps the other columns, e.g. ``score_all`` with its token tables. The rows to
    score are written once before, as they are read several times. A run that finds nothing new calls ``score`` not at all; one that dies
    appends nothing and is simply repeated."""
    new = pending_scores(runs, path, keys, inputs)
    if new.isEmpty():
        return
    scored = score(io.materialize(new, "to-score")).select(*keys, INPUT, *metrics)
    scored.write.mode("append").partitionBy(*[k for k in ("model", "mode") if k in keys]).parquet(path)


def with_scores(runs: DataFrame, path: str, keys: Sequence[str] = KEYS, inputs: Sequence[str] = INPUTS) -> DataFrame:
    """``runs`` with the metrics stored at ``path`` (NULL for rows not scored yet)."""
    stored = read_scored(runs.sparkSession, path, keys)
    if stored is None:
        raise ValueError(f"no score table at {path}: run update_scores first")
    return with_input(runs, inputs).join(stored, [*keys, INPUT], "left").drop(INPUT)
