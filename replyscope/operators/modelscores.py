"""Model-based metrics over caller-supplied token tables (the models stay outside):

- M6 greedy embedding match (BERTScore form): P = mean over reply tokens of the best cosine to any gold token,
  R the converse, F1 = 2PR/(P+R). Token weights (e.g. 0 for special tokens) are honoured.
- M7 target log-likelihood: sum of non-pad token log-probabilities / number of non-pad tokens.
- M8 log-likelihood F1 (BARTScore form): faithful, precision, recall directions and F1 = 2PR/(P+R) on the negative
  scores (NULL when P + R = 0).
- M9 multi-reference mean / max: ``report.multi_ref``.

M6 compares every reply token with every gold token of the same row. The pairs are never emitted as rows: each row's
vectors are gathered once (bounded by the encoder's sequence length) and an Arrow UDF computes the similarity
matrix block-wise in numpy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MATCH_TYPE = T.StructType([
    T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()),
    T.StructField("f1", T.DoubleType()),
])

BLOCK = 2048


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    norms[norms == 0] = 1.0
    return m / norms


def greedy_match(reply: np.ndarray, gold: np.ndarray, w_reply: np.ndarray, w_gold: np.ndarray):
    """(P, R, F1) for one row; rows are token vectors. The n x m similarity matrix is built in blocks of reply
    tokens, so memory is BLOCK x m."""
    if len(reply) == 0 or len(gold) == 0:
        return None
    a, b = _unit(reply.astype(np.float64)), _unit(gold.astype(np.float64))
    best_a = np.empty(len(a))
    best_b = np.full(len(b), -np.inf)
    for s in range(0, len(a), BLOCK):
        sims = a[s:s + BLOCK] @ b.T
        best_a[s:s + BLOCK] = sims.max(axis=1)
        np.maximum(best_b, sims.max(axis=0), out=best_b)
    wa, wb = w_reply.sum(), w_gold.sum()
    p = float((best_a * w_reply).sum() / wa) if wa > 0 else None
    r = float((best_b * w_gold).sum() / wb) if wb > 0 else None
    if p is None or r is None:
        return None
    f = 2 * p * r / (p + r) if (p + r) != 0 else None
    return p, r, f


def _rows(flat, weights) -> np.ndarray:
    return np.asarray(flat, dtype=np.float64).reshape(len(weights), -1)


def _matches(rows) -> pd.DataFrame:
    out = []
    for r, rw, g, gw in rows:
        res = greedy_match(_rows(r, rw), _rows(g, gw), rw, gw) if len(rw) and len(gw) else None
        out.append(res if res is not None else (None, None, None))
    return pd.DataFrame(out, columns=["precision", "recall", "f1"])


@F.pandas_udf(MATCH_TYPE)
def _match_udf(reply: pd.Series, reply_w: pd.Series, gold: pd.Series, gold_w: pd.Series) -> pd.DataFrame:
    return _matches(zip(reply, reply_w, gold, gold_w))


@F.pandas_udf(MATCH_TYPE)
def _match_rows(v: pd.DataFrame) -> pd.DataFrame:
    """``_match_udf`` with weight 1 for every token, from the struct of both sides' vectors and their numbers; a side that is NULL has no tokens."""
    ones = [[np.ones(0 if pd.isna(n) else int(n)) for n in v[c]] for c in ("reply_n", "gold_n")]
    return _matches(zip(v["reply_vecs"], ones[0], v["gold_vecs"], ones[1]))


def score_embedding_match(tokens: DataFrame, keys: Sequence[str] = ("row_id",), side: str = "side", vec: str = "vec",
                          weight: str | None = None, reply_side: str = "reply", gold_side: str = "gold") -> DataFrame:
    """M6 per row: ``(*keys, precision, recall, f1)`` from ``tokens(*keys, side, pos, vec[, weight])``. A row's vectors reach
    the UDF as one flat array per side; their number is bounded by its texts. An encoder that gives a row's vectors at once needs no row
    per token: see ``score_embedding_rows``."""
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    item = F.struct(F.col("pos"), F.col(vec).alias("vec"), w.alias("w"))
    sides = {"__r": reply_side, "__g": gold_side}
    grouped = tokens.groupBy(*keys).agg(
        *[F.array_sort(F.collect_list(F.when(F.col(side) == value, item))).alias(name) for name, value in sides.items()])
    flat = [c for name in sides for c in (F.flatten(F.col(f"{name}.vec")), F.col(f"{name}.w"))]
    m = grouped.select(*keys, _match_udf(*flat).alias("m"))
    return m.select(*keys, *[F.col(f"m.{c}").alias(c) for c in ("precision", "recall", "f1")])


def score_embedding_rows(rows: DataFrame, keys: Sequence[str] = ("row_id",), reply: str = "reply_vecs", gold: str = "gold_vecs",
                         reply_n: str = "reply_n", gold_n: str = "gold_n", vectors: str = "vectors") -> DataFrame:
    """M6 as ``score_embedding_match``, from one row per key that has the vectors of each side as one flat array, in order, and their number.
    No token becomes a row: nothing is shuffled, sorted or gathered. Where ``rows`` has a struct ``vectors`` of these four, as an encoder in Python
    returns it, the match takes place in the encoder's own call and no vector moves at all."""
    if vectors in rows.columns:
        return rows.select(*keys, _match_rows(vectors).alias("m")).select(*keys, *[F.col(f"m.{c}").alias(c) for c in ("precision", "recall", "f1")])
    ones = [F.array_repeat(F.lit(1.0), F.col(n)) for n in (reply_n, gold_n)]
    m = rows.select(*keys, _match_udf(F.col(reply), ones[0], F.col(gold), ones[1]).alias("m"))
    return m.select(*keys, *[F.col(f"m.{c}").alias(c) for c in ("precision", "recall", "f1")])


def mean_loglik(logprobs: DataFrame, keys=("row_id", "direction"), logprob: str = "logprob",
                pad: str = "is_pad") -> DataFrame:
    """M7: sum of non-pad log-probabilities over the number of non-pad target tokens, per key (one partial
    aggregate; NULL when a target has no non-pad token)."""
    real = ~F.coalesce(F.col(pad), F.lit(False))
    return logprobs.groupBy(*keys).agg(
        F.try_divide(F.sum(F.when(real, F.col(logprob))), F.count_if(real).cast("double")).alias("score")
    )


def loglik_f1(logprobs: DataFrame, keys: Sequence[str] = ("row_id",), direction: str = "direction") -> DataFrame:
    """M8: ``(*keys, faithful, precision, recall, f1)``; F1 = 2PR/(P+R) on the (negative) scores, NULL if P+R = 0."""
    per = mean_loglik(logprobs, keys=(*keys, direction))
    wide = per.groupBy(*keys).agg(*[
        F.max(F.when(F.col(direction) == d, F.col("score"))).alias(d) for d in ("faithful", "precision", "recall")
    ])
    p, r = F.col("precision"), F.col("recall")
    return wide.withColumn("f1", F.try_divide(F.lit(2.0) * p * r, p + r))


DIRECTIONS = ("faithful", "precision", "recall")


@F.pandas_udf(T.StructType([f for d in DIRECTIONS for f in (T.StructField(d, T.DoubleType()), T.StructField(f"{d}_n", T.LongType()))]))
def _loglik_sums(targets: pd.DataFrame) -> pd.DataFrame:
    out = {}
    for d in DIRECTIONS:
        real = [np.zeros(0) if x is None else np.asarray(x, dtype=np.float64)[~np.asarray(p, dtype=bool)] for x, p in zip(targets[d], targets[f"{d}_pad"])]
        out[d] = [float(x.sum()) for x in real]
        out[f"{d}_n"] = [len(x) for x in real]
    return pd.DataFrame(out)


def loglik_f1_rows(rows: DataFrame, keys: Sequence[str] = ("row_id",), targets: str = "targets") -> DataFrame:
    """M8 as ``loglik_f1``, from rows that have each direction's target log-probabilities as one array and which of them are padding. No token
    becomes a row: only a row's sums are shuffled."""
    sums = rows.select(*keys, _loglik_sums(targets).alias("s")).select(*keys, "s.*")
    per = sums.groupBy(*keys).agg(*[
        F.try_divide(F.sum(d), F.sum(f"{d}_n").cast("double")).alias(d) for d in DIRECTIONS])
    p, r = F.col("precision"), F.col("recall")
    return per.withColumn("f1", F.try_divide(F.lit(2.0) * p * r, p + r))
