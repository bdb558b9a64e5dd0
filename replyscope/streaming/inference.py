"""Batch inference through a caller-supplied model function (C9, C10, C12) and resumable runs.

The model function is the caller's: ``fn(chats, params) -> list[str]`` receives a list of chats (each a list of
``{"role", "content"}`` dicts) and a list of parameter dicts, and returns one reply per chat. It runs inside
``mapInArrow`` on the executors, in batches of ``batch_size`` chats; nothing is collected to the driver. A failing
batch is retried with back-off and then chat by chat; rows that still fail come back with a NULL reply and the error text,
and stay pending for the next run. Results are keyed by (row_id, model, mode), so a rerun recomputes only missing keys
(``pending``) and appends; a lost task is simply recomputed by Spark. Runs of several stages are in ``stages``.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replyscope.functions import fixed
from replyscope.sources import io

KEYS = ("row_id", "model", "mode")
ModelFn = Callable[[list, list], list]


def decoding_params(temperature=None, max_tokens: int = fixed.MAX_NEW_TOKENS, seed: int = fixed.SEED,
                    top_logprobs: int = fixed.TOP_LOGPROBS):
    """The decoding parameters handed to the model function, as a struct column. Greedy decoding at
    temperature 0, else sampling with top_p 0.8 / top_k 20."""
    temperature = F.col("temperature") if temperature is None else temperature
    greedy = temperature == F.lit(0.0)
    return F.struct(
        temperature.cast("double").alias("temperature"),
        F.when(greedy, F.lit(None).cast("double")).otherwise(F.lit(fixed.SAMPLING_TOP_P)).alias("top_p"),
        F.when(greedy, F.lit(None).cast("int")).otherwise(F.lit(fixed.SAMPLING_TOP_K)).alias("top_k"),
        F.lit(max_tokens).alias("max_tokens"),
        F.lit(seed).alias("seed"),
        F.lit(top_logprobs).alias("top_logprobs"),
    )


def judge_params():
    """Judge decoding parameters."""
    return F.struct(
        F.lit(fixed.JUDGE_TEMPERATURE).alias("temperature"),
        F.lit(fixed.JUDGE_TOP_P).alias("top_p"),
        F.lit(None).cast("int").alias("top_k"),
        F.lit(fixed.JUDGE_MAX_TOKENS).alias("max_tokens"),
        F.lit(fixed.SEED).alias("seed"),
        F.lit(None).cast("int").alias("top_logprobs"),
    )


# Objects built by a caller's factory, by the name of the call that ships it: a model is loaded once per Python worker and
# call instead of being pickled into every task. Only the latest few stay.
_WORKER_OBJECTS: OrderedDict = OrderedDict()
WORKER_OBJECTS_KEPT = 4


def per_worker(factory: Callable[[], object], name: str):
    """The result of ``factory()``, built at most once for ``name`` in each Python worker process. ``name`` is made on the driver for
    each call, so two factories never share an object."""
    if name not in _WORKER_OBJECTS:
        _WORKER_OBJECTS[name] = factory()
        while len(_WORKER_OBJECTS) > WORKER_OBJECTS_KEPT:
            _WORKER_OBJECTS.popitem(last=False)
    _WORKER_OBJECTS.move_to_end(name)
    return _WORKER_OBJECTS[name]


def _answers(model: ModelFn, chats: list, params: list, retries: int, backoff: float) -> list[tuple]:
    """(answer, error) of each chat. A batch that still fails after its retries is sent again chat by chat, so that one bad chat
    costs no other its answer."""
    error = None
    for attempt in range(retries + 1):
        try:
            replies = list(model(chats, params))
            if len(replies) != len(chats):
                raise ValueError(f"model function returned {len(replies)} replies for {len(chats)} chats")
            return [(r, None) for r in replies]
        except Exception as e:  # noqa: BLE001 - any model failure becomes a pending row
            error = f"{type(e).__name__}: {e}"
            if attempt < retries:
                time.sleep(backoff * (2 ** attempt))
    if len(chats) == 1:
        return [(None, error)]
    return [a for c, p in zip(chats, params) for a in _answers(model, [c], [p], 0, backoff)]


def _call_batches(fn: ModelFn | None, kept: Sequence[str], batch_size: int, retries: int, backoff: float,
                  fn_factory: Callable[[], ModelFn] | None, name: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fn if fn is not None else per_worker(fn_factory, name)
        for rows in it:
            # Spark's batch stays in Arrow; only the chats of one call become Python objects.
            for start in range(0, rows.num_rows, batch_size):
                part = rows.slice(start, batch_size)
                messages, params = (part.column(c).to_pylist() for c in ("__messages", "__params"))
                sent = [i for i, m in enumerate(messages) if m is not None]
                chats = [json.loads(messages[i]) for i in sent]
                got: list[tuple] = [(None, None)] * len(messages)
                asked = [json.loads(params[i] or "{}") for i in sent]
                for i, answer in zip(sent, _answers(model, chats, asked, retries, backoff) if sent else []):
                    got[i] = answer
                full = [r if isinstance(r, dict) else {"reply": r} for r, _ in got]
                texts = {
                    "reply": [None if r.get("reply") is None else str(r["reply"]) for r in full],
                    "logprobs": [None if r.get("logprobs") is None else json.dumps(r["logprobs"]) for r in full],
                    "error": [e for _, e in got],
                }
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in kept], *[pa.array(t, pa.string()) for t in texts.values()]], names=[*kept, *texts])

    return run


def run_inference(df: DataFrame, fn: ModelFn | None = None, keys: Sequence[str] = KEYS, messages: str = "messages",
                  params=None, batch_size: int = fixed.JUDGE_BATCH_SIZE, retries: int = 1, backoff_seconds: float = 5.0,
                  partitions: int | None = None, fn_factory: Callable[[], ModelFn] | None = None,
                  logprobs: bool = False) -> DataFrame:
    """One reply per input row: ``(*keys, reply, error)``, with ``logprobs=True`` also ``logprobs`` (T14: JSON text).

    Pass either ``fn`` (a light function, pickled with the task) or ``fn_factory`` (called once per Python worker,
    e.g. to load a model). An answer is a text or a dict with ``reply`` and ``logprobs``. Rows whose messages are NULL are
    not sent and get a NULL reply without an error. ``partitions`` caps the number of concurrent calls (a rate limit): the
    input is repartitioned to that many tasks by key hash."""
    if (fn is None) == (fn_factory is None):
        raise ValueError("pass exactly one of fn and fn_factory")
    p = params if params is not None else decoding_params()
    keep_nulls = {"ignoreNullFields": "false"}  # every parameter key reaches the function, NULL as None
    src = df.select(*keys, F.to_json(messages, keep_nulls).alias("__messages"), F.to_json(p, keep_nulls).alias("__params"))
    if partitions:
        src = src.repartition(partitions, *keys)
    schema = T.StructType(
        [df.schema[k] for k in keys]
        + [T.StructField(c, T.StringType(), True) for c in ("reply", "logprobs", "error")]
    )
    run = _call_batches(fn, list(keys), batch_size, retries, backoff_seconds, fn_factory, uuid.uuid4().hex)
    out = src.mapInArrow(run, schema)
    return out if logprobs else out.drop("logprobs")


def pending(df: DataFrame, done: DataFrame | None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows without a finished reply (anti-join on the run keys)."""
    if done is None:
        return df
    finished = done.where(F.col("reply").isNotNull()).select(*keys)
    return df.join(finished, list(keys), "left_anti")


def results(spark: SparkSession, path: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per key of a results folder: a finished reply if there is one (of several always the same), else a failed attempt."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, *BUCKET_COLUMNS)]
    order = F.struct(F.col("reply").isNotNull(), F.xxhash64(*rest))
    best = F.max_by(F.struct(*rest), order).alias("r")
    return rows.groupBy(*keys).agg(best).select(*keys, "r.*")


# A results folder is laid out by (model, mode,) buckets, bucket: ``bucket`` is the row's key hash modulo ``buckets``.
BUCKET_COLUMNS = ("buckets", "bucket")


def key_bucket(keys: Sequence[str], buckets: int):
    """The bucket of a row's key."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def finished_in(spark: SparkSession, path: str, buckets: int, bucket: int) -> DataFrame | None:
    """The results at ``path`` that may hold keys of one bucket: its own folder and rows dealt to another number of buckets. Other buckets'
    folders are pruned, not read. None if there is no result yet."""
    if not io.exists(spark, path):
        return None
    rows = spark.read.parquet(path)
    if "bucket" not in rows.columns:
        return rows
    return rows.where(((F.col("buckets") == buckets) & (F.col("bucket") == bucket)) | (F.col("buckets") != buckets))


def run_resumable(spark: SparkSession, df: DataFrame, fn: ModelFn | None, path: str, keys: Sequence[str] = KEYS,
                  chunks: int = 8, **kwargs) -> DataFrame:
    """Infer only the rows of ``df`` that have no reply at ``path`` yet and append their results there
    (Parquet, partitioned by model, mode and key bucket). The rows are dealt to ``chunks`` buckets by key hash, each inferred and committed by
    a job of its own that reads the finished keys of its bucket only; a run that dies keeps the chunks before. Returns one row per key at
    ``path`` (read back, so the model is never called twice for one row). Rerunning a finished job writes no row."""
    for i in range(chunks):
        part = df.where(key_bucket(keys, chunks) == i) if chunks > 1 else df
        out = run_inference(pending(part, finished_in(spark, path, chunks, i), keys), fn, keys, **kwargs)
        out = out.withColumns({"buckets": F.lit(chunks), "bucket": F.lit(i)})
        out.write.mode("append").partitionBy(*[k for k in ("model", "mode") if k in keys], *BUCKET_COLUMNS).parquet(path)
    return results(spark, path, keys)


def stream_inference(spark: SparkSession, source_path: str, schema: T.StructType, fn: ModelFn | None, sink_path: str,
                     checkpoint: str, keys: Sequence[str] = KEYS, files_per_batch: int = 8,
                     watermark: tuple[str, str] | None = None, **kwargs):
    """I1 as Structured Streaming: new Parquet files of prepared rows (with ``messages`` and ``temperature``) are picked up and
    inferred, ``files_per_batch`` at a time, until all available input is done (``availableNow``).

    Keys seen so far are kept in the query's state store (a keyed ``dropDuplicates``), so a micro-batch looks up its own keys and reads
    nothing of the sink, however large that is. Each micro-batch writes partitions of its own (``buckets=0``, ``bucket`` its number), overwriting
    them when it is replayed after a failure, so a replay adds no row. The state holds every key; with ``watermark=(time column, delay)`` keys
    older than the delay are forgotten. A key is sent once: rows whose call failed stay without a reply until ``run_resumable`` runs over the
    same sink."""

    def batch(bdf: DataFrame, epoch: int) -> None:
        out = run_inference(bdf, fn, keys, **kwargs)
        out = out.withColumns({"buckets": F.lit(0), "bucket": F.lit(int(epoch))})
        by = [k for k in ("model", "mode") if k in keys]
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by, *BUCKET_COLUMNS).parquet(sink_path)

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source_path)
    if watermark:
        new = rows.withWatermark(*watermark).dropDuplicatesWithinWatermark(list(keys))
    else:
        new = rows.dropDuplicates(list(keys))
    q = (
        new.writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return q


# ------------------------------------------------------------------------------------------------ stub model


def echo_model(chats: list, params: list) -> list:
    """A deterministic stand-in model for tests: ``"{len % 5 + 1} echo {len}: {text}"`` of the whole last user turn
    (its digit prefix doubles as a judge score)."""
    out = []
    for chat in chats:
        last = next((m.get("content") or "" for m in reversed(chat) if m.get("role") == "user"), "")
        out.append(f"{len(last) % 5 + 1} echo {len(last)}: {last}")
    return out
