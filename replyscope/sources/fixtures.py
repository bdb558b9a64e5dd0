"""Surrogate inputs built from the driver tables (``documents``, ``labels``, ``benchmark``, ``events``,
``conversations``, ``embeddings``).

The annotation view is one SQL text that runs unchanged on Spark SQL and DuckDB. The views derived from it
(gold, runs, cohorts, token tables) are written twice: as Spark DataFrame code here, and as SQL in
``replyscope.plans.oracle`` — two independent forms, so the oracle check means something.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replyscope.functions import digits

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

ANNOTATIONS_SQL = """
SELECT x.doc_id AS row_id,
  CAST(x.doc_id % 10 AS INT) AS dataset_id,
  CAST(x.k % 4 AS INT) AS set_id,
  x.doc_id % 60 AS example_id,
  CASE x.doc_id % 10 WHEN 6 THEN 'task1553-' WHEN 7 THEN 'task1161-' WHEN 8 THEN 'task177-'
       WHEN 1 THEN 'task105-' ELSE 'task900-' END || CAST(x.doc_id % 60 AS STRING) AS nat_instr_id,
  x.doc_id % 37 AS user_id,
  CASE WHEN x.k % 7 = 0 THEN '{en}' WHEN x.k % 5 = 0 THEN '{en,' || x.lang || '}'
       ELSE '{' || x.lang || '}' END AS nat_lang,
  COALESCE(l.quality, 1) AS validated,
  'Task ' || CAST(x.doc_id % 10 AS STRING) || '.' AS task_def,
  CASE x.k % 3 WHEN 0 THEN 'Answer: <markprompt>[Your Prompt]</markprompt>.'
       WHEN 1 THEN 'Complete <markprompt>[Your Prompt]</markprompt>? Thanks'
       ELSE 'Text <markprompt>[Your Prompt]</markprompt> end' END AS instruction,
  x.text AS prompt_en,
  CASE WHEN x.doc_id % 10 = 3 THEN CAST(1 + x.k % 5 AS STRING)
       WHEN x.doc_id % 10 IN (0, 2) THEN 'Option ' || CAST(1 + x.k % 2 AS STRING)
       WHEN x.doc_id % 10 IN (4, 5) THEN CASE WHEN x.k % 2 = 0 THEN 'Yes.' ELSE 'No.' END
       WHEN x.doc_id % 10 = 9 THEN substr('ABC', CAST(1 + x.k % 3 AS INT), 1)
       ELSE b.text END AS req_output,
  CASE WHEN x.doc_id % 10 = 3 THEN 'I rate it ' || CAST(1 + x.k % 4 AS STRING)
            || CASE WHEN x.k % 6 = 0 THEN ' of 5' ELSE '' END
       WHEN x.doc_id % 10 IN (0, 2) THEN CASE WHEN x.k % 4 = 0 THEN 'neither' ELSE 'option ' || CAST(1 + x.k % 3 AS STRING) END
       WHEN x.doc_id % 10 IN (4, 5) THEN CASE x.k % 4 WHEN 0 THEN 'YES' WHEN 1 THEN 'I know' WHEN 2 THEN 'yes and no' ELSE 'maybe' END
       WHEN x.doc_id % 10 = 9 THEN CASE x.k % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B. not A' WHEN 2 THEN 'A or C' ELSE 'C: yes' END
       ELSE x.text END AS reply
FROM (SELECT doc_id, text, lang, CAST((doc_id - doc_id % 10) / 10 AS BIGINT) AS k,
        doc_id % (SELECT max(item_id) + 1 FROM benchmark) AS item FROM documents) x
LEFT JOIN labels l ON l.doc_id = x.doc_id
LEFT JOIN benchmark b ON b.item_id = x.item
"""

# Invented surrogate data: run modes and their reply variants, guess texts, membership cohorts.
RUN_MODEL = "model_a"
RUN_MODES = ("standard", "add_all_native", "add_all_non_native", "guess_native")
# mode -> (modulus, remainder): rows with row_id % modulus == remainder answer with the gold text.
RUN_GOLD_REPLY = {"add_all_native": (3, 0), "add_all_non_native": (4, 1), "guess_native": (5, 2)}
GUESS_TEXTS = ("a native one", "a non-native writer", "non-native, not a native", "unclear")
# cohort -> (modulus, remainder) over user_id.
COHORT_RULES = {"western": (5, 0), "african": (7, 3), "student": (3, 1)}


def prompt_instruction() -> Column:
    """Invented instruction for the writer of a prompt."""
    return F.concat(F.lit("Write it for <markprompt>[Your Prompt]</markprompt>. "), F.col("instruction"))


def event_language() -> Column:
    """Invented language of an event's writer."""
    u = F.col("user_id")
    return F.when(u % 4 == 0, F.lit("{en}")).when(u % 4 == 1, F.lit("{en,nl}")).otherwise(F.lit("{nl}"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_base(spark: SparkSession, sf_dir: str, names=("documents", "labels", "benchmark")) -> None:
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The annotation table (schema of ``replyscope.schema.ANNOTATIONS`` minus time/prompt_instruction)."""
    register_base(spark, sf_dir)
    return spark.sql(ANNOTATIONS_SQL)


def gold(ann: DataFrame) -> DataFrame:
    """One row per task id: the reference answer of its lowest ``row_id``."""
    return (
        ann.where(F.col("nat_instr_id").isNotNull())
        .groupBy("nat_instr_id")
        .agg(F.min_by("req_output", "row_id").alias("generated_req_output"))
    )


def runs(ann: DataFrame) -> DataFrame:
    """Long-format runs: one row per (row_id, model, mode) with a reply and, for guesses, a side output."""
    modes = F.explode(F.array(*[F.lit(m) for m in RUN_MODES]))
    df = ann.select("*", modes.alias("mode"))
    reply = F.col("reply")
    for mode, (m, r) in RUN_GOLD_REPLY.items():
        reply = F.when((F.col("mode") == mode) & (F.col("row_id") % m == r), F.col("req_output")).otherwise(reply)
    guess = F.element_at(F.array(*[F.lit(t) for t in GUESS_TEXTS]), (F.col("row_id") % len(GUESS_TEXTS) + 1).cast("int"))
    return df.withColumn("reply", reply).select(
        *[c for c in ann.columns if c != "reply"],
        F.lit(RUN_MODEL).alias("model"),
        "mode",
        "reply",
        F.when(F.col("mode") == "guess_native", guess).alias("side_output"),
    )


def cohorts(ann: DataFrame) -> DataFrame:
    """Membership table ``(user_id, cohort)`` for the users of ``ann`` (invented rule on user ids)."""
    users = ann.select("user_id").where(F.col("user_id").isNotNull()).distinct()
    tags = F.array(*[F.when(F.col("user_id") % m == r, F.lit(name)) for name, (m, r) in COHORT_RULES.items()])
    return users.select("user_id", F.explode(tags).alias("cohort")).where(F.col("cohort").isNotNull())


# ------------------------------------------------------------------------------------------------ token tables

TOKEN_DIM = 8
GENERATION = (1, 6, 7, 8)


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reply/gold pairs from chat logs: each assistant turn is a reply, the user turn before it its gold text.
    ``row_id`` is the text ``conv_id:turn``."""
    conv = table(spark, sf_dir, "conversations")
    a = conv.where(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("reply"))
    u = conv.where(F.col("role") == "user").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("gold"))
    return a.join(u, ["conv_id", "turn"]).select(
        F.concat_ws(":", "conv_id", "turn").alias("row_id"), "reply", "gold")


def _hash_unit(*parts) -> Column:
    """A value in [-0.5, 0.5] from the first 4 hex digits of md5(parts joined by ':')."""
    key = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 4), 16, 10).cast("double") / F.lit(65535.0) - F.lit(0.5)


def run_pairs(scored: DataFrame) -> DataFrame:
    """Reply/gold pairs of the generation rows of ``scored`` runs, keyed by (row_id, model, mode)."""
    rows = scored.where(F.col("dataset_id").isin(*GENERATION) & F.col("reply").isNotNull())
    return rows.select("row_id", "model", "mode", "reply", F.col("generated_req_output").alias("gold"))


def _side_tokens(pairs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    from replyscope.functions.text import rouge_tokens

    sides = F.explode(F.array(
        F.struct(F.lit("reply").alias("side"), F.col("reply").alias("t")),
        F.struct(F.lit("gold").alias("side"), F.col("gold").alias("t")),
    ))
    s = pairs.select(*keys, sides.alias("s")).select(*keys, "s.side", "s.t")
    return s.select(*keys, "side", F.posexplode(rouge_tokens("t")).alias("pos", "token"))


def token_vectors(pairs: DataFrame, dim: int = TOKEN_DIM, keys: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Stand-in for an encoder's token embeddings: (*keys, side, pos, token, vec ARRAY<FLOAT>), vectors from token
    hashes (equal tokens get equal vectors)."""
    toks = _side_tokens(pairs, keys)
    vec = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: _hash_unit(F.col("token"), i).cast("float"))
    return toks.withColumn("vec", vec)


def _vectors(tokens: Sequence[str], dim: int) -> np.ndarray:
    """``token_vectors``' vectors of different tokens, one per row."""
    out = np.empty((len(tokens), dim), np.uint16)
    for lo in range(0, len(tokens), digits.CHUNK):
        part = tokens[lo:lo + digits.CHUNK]
        token, sizes, long = digits.token_bytes(part)
        rows = np.arange(len(part))
        for i in range(dim):
            tail = f":{i}".encode()
            m = digits.table(len(part), token.shape[1] + len(tail))
            m[:, :token.shape[1]] = token
            for k, c in enumerate(tail):
                m[rows, sizes + k] = c
            out[lo:lo + len(part), i] = digits.md5_digits(m, sizes + len(tail))
            for j in long:
                out[lo + j, i] = digits.digits_of(part[j].encode() + tail)
    return (out / 65535.0 - 0.5).astype(np.float32)


def _text_vectors(text: pd.Series, dim: int) -> tuple[list, list]:
    """The vectors of each text's tokens in order as one flat array, and their number."""
    from replyscope.operators.overlap import line_words

    tokens = [None if t is None else line_words(t).split() for t in text]
    known = {t: i for i, t in enumerate(dict.fromkeys(t for ts in tokens if ts for t in ts))}
    table = _vectors(list(known), dim)
    return [None if ts is None else table[[known[t] for t in ts]].ravel() for ts in tokens], [None if ts is None else len(ts) for ts in tokens]


VECTORS = T.StructType([T.StructField("vecs", T.ArrayType(T.FloatType())), T.StructField("n", T.IntegerType())])


@F.pandas_udf(VECTORS)
def _flat_vectors(text: pd.Series, dim: pd.Series) -> pd.DataFrame:
    vecs, n = _text_vectors(text, int(dim.max()) if len(dim) else 1)
    return pd.DataFrame({"vecs": pd.Series(vecs, dtype=object), "n": pd.Series(n, dtype="Int32")})


@F.pandas_udf(T.StructType([T.StructField(f"{side}_{f.name}", f.dataType) for side in ("reply", "gold") for f in VECTORS]))
def _row_vectors(reply: pd.Series, gold: pd.Series, dim: pd.Series) -> pd.DataFrame:
    out = {}
    for side, text in (("reply", reply), ("gold", gold)):
        vecs, n = _text_vectors(text, int(dim.max()) if len(dim) else 1)
        out |= {f"{side}_vecs": pd.Series(vecs, dtype=object), f"{side}_n": pd.Series(n, dtype="Int32")}
    return pd.DataFrame(out)


def row_vectors(pairs: DataFrame, dim: int = TOKEN_DIM, keys: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """``pair_vectors`` with both sides in one struct: (*keys, vectors), which a scorer in Python is given without a way through the JVM."""
    return pairs.select(*keys, _row_vectors("reply", "gold", F.lit(dim)).alias("vectors"))


def pair_vectors(pairs: DataFrame, dim: int = TOKEN_DIM, keys: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """``token_vectors`` as an encoder gives them, one row per pair: (*keys, reply_vecs, reply_n, gold_vecs, gold_n), the vectors of
    each side's tokens in order as one flat ARRAY<FLOAT> and their number."""
    both = pairs.select(*keys, _flat_vectors("reply", F.lit(dim)).alias("r"), _flat_vectors("gold", F.lit(dim)).alias("g"))
    return both.select(*keys, F.col("r.vecs").alias("reply_vecs"), F.col("r.n").alias("reply_n"),
                       F.col("g.vecs").alias("gold_vecs"), F.col("g.n").alias("gold_n"))


def token_logprobs(pairs: DataFrame, refs: int = 2, keys: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Stand-in for a scorer's target-token log-probabilities: (*keys, direction, ref_idx, pos, logprob, is_pad)
    for directions faithful/precision (target = reply) and recall (target = gold), ``refs`` references each. A row's targets are
    unfolded where the row is: no token is shuffled."""
    from replyscope.functions.text import rouge_tokens

    named = pairs
    for k in keys:
        named = named.where(F.col(k).isNotNull())
    toks = named.select(*keys, rouge_tokens("reply").alias("__r"), rouge_tokens("gold").alias("__g"))

    def target(d: str, i: int, tokens: str) -> Column:
        # The parts of the two hash keys that a target's tokens share are joined once, in the value that is exploded.
        return F.struct(F.lit(d).alias("d"), F.lit(i).alias("i"), F.col(tokens).alias("t"), F.concat_ws(":", F.lit(d), F.lit(i), *keys).alias("h"),
                        F.concat_ws(":", F.lit("pad"), *keys, F.lit(d), F.lit(i)).alias("p"))

    dirs = F.explode(F.array(*[target(d, i, t) for d, t in (("faithful", "__r"), ("precision", "__r"), ("recall", "__g")) for i in range(refs)]))
    spec = toks.select(*keys, dirs.alias("x"))
    j = spec.select(*keys, F.col("x.d").alias("direction"), F.col("x.i").alias("ref_idx"), F.col("x.h").alias("__h"), F.col("x.p").alias("__pad"),
                    F.posexplode("x.t").alias("pos", "token"))
    h = _hash_unit(F.col("__h"), F.col("pos"), F.col("token"))
    pad = _hash_unit(F.col("__pad"), F.col("pos"))
    return j.select(*keys, "direction", "ref_idx", "pos",
                    ((h - F.lit(0.5)) * F.lit(8.0)).alias("logprob"), (pad > F.lit(0.4)).alias("is_pad"))


DIRECTIONS = ("faithful", "precision", "recall")
TARGETS = T.StructType([f for d in DIRECTIONS for f in (
    T.StructField(d, T.ArrayType(T.DoubleType())), T.StructField(f"{d}_pad", T.ArrayType(T.BooleanType())))])


def _stacked(parts: list[np.ndarray]) -> np.ndarray:
    """The rows of all ``parts``, as wide as the widest."""
    out = np.zeros((sum(map(len, parts)), max(m.shape[1] for m in parts)), np.uint8)
    at = 0
    for m in parts:
        out[at:at + len(m), :m.shape[1]] = m
        at += len(m)
    return out


def _targets(jobs: list[tuple[bytes, bytes, list[str]]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """``token_logprobs``' logprob and is_pad of each job's tokens; a job is the parts of its two hash keys before the position, and its tokens."""
    hashed, padded, of_hash, of_pad, late = [], [], [], [], []
    at = 0
    ready = None
    for h, p, ts in jobs:
        if ready is not ts:  # two directions have one text
            ready, (token, sizes, long) = ts, digits.token_bytes(ts)
        n = len(h)
        m = digits.table(len(ts), n + 8 + token.shape[1])
        m[:, :n] = np.frombuffer(h, np.uint8)
        behind = np.empty(len(ts), np.int64)
        for lo, hi, k in digits.put_numbers(m, n):
            m[lo:hi, n + k] = ord(":")
            m[lo:hi, n + k + 1:n + k + 1 + token.shape[1]] = token[lo:hi]
            behind[lo:hi] = k
        hashed.append(m)
        of_hash.append(behind + n + 1 + sizes)
        late += [(at + j, h + f"{j}:{ts[j]}".encode()) for j in long]
        m = digits.table(len(ts), len(p) + 8)
        m[:, :len(p)] = np.frombuffer(p, np.uint8)
        digits.put_numbers(m, len(p))
        padded.append(m)
        of_pad.append(behind + len(p))
        at += len(ts)
    h = digits.md5_digits(_stacked(hashed), np.concatenate(of_hash))
    for j, message in late:
        h[j] = digits.digits_of(message)
    pad = digits.md5_digits(_stacked(padded), np.concatenate(of_pad)) / 65535.0 - 0.5 > 0.4
    logprob = (h / 65535.0 - 0.5 - 0.5) * 8.0
    ends = np.cumsum([len(ts) for _, _, ts in jobs])[:-1]
    return list(zip(np.split(logprob, ends), np.split(pad, ends)))


@F.pandas_udf(TARGETS)
def _row_targets(reply: pd.Series, gold: pd.Series, key: pd.Series) -> pd.DataFrame:
    from replyscope.operators.overlap import line_words

    out = {f.name: [None] * len(key) for f in TARGETS}
    jobs, places, waiting = [], [], 0

    def flush() -> None:
        for (i, d), (logprob, pad) in zip(places, _targets(jobs) if jobs else ()):
            out[d][i], out[f"{d}_pad"][i] = logprob, pad
        jobs.clear(), places.clear()

    for i, (r, g, k) in enumerate(zip(reply, gold, key)):
        words = [[] if t is None else line_words(t).split() for t in (r, g)]
        for d, ts in zip(DIRECTIONS, (words[0], *words)):
            if ts:
                jobs.append((f"{d}:0:{k}:".encode(), f"pad:{k}:{d}:0:".encode(), ts))
                places.append((i, d))
                waiting += len(ts)
        if waiting >= digits.CHUNK:
            flush()
            waiting = 0
    flush()
    return pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in out.items()})


def row_logprobs(pairs: DataFrame, keys: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """``token_logprobs`` with one reference as a scorer gives them, one row per pair: (*keys, targets), the log-probabilities of each direction's
    target tokens in order as one ARRAY<DOUBLE> and which of them are padding; NULL for a text without tokens."""
    named = pairs
    for k in keys:
        named = named.where(F.col(k).isNotNull())
    return named.select(*keys, _row_targets("reply", "gold", F.concat_ws(":", *keys)).alias("targets"))
