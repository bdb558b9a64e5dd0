"""Model aliases (P7) and the reader for wide result tables (P3, P4, P16): one column per run, named after the
model and the mode, becomes long rows keyed by (row_id, model, mode) in one pass (explode of an array of
structs, no union, no per-mode scan)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replyscope.functions import fixed


def model_table(spark: SparkSession) -> DataFrame:
    """``(alias, display, checkpoint)`` — a fixed 10-row table, safe to broadcast."""
    return spark.createDataFrame(list(fixed.MODEL_ALIASES), "alias string, display string, checkpoint string")


def with_model_names(df: DataFrame, alias: str = "model") -> DataFrame:
    """Add ``display`` and ``checkpoint`` for a model-alias column; unknown aliases keep their own name."""
    m = F.broadcast(model_table(df.sparkSession)).withColumnRenamed("alias", "__alias")
    out = df.join(m, df[alias] == F.col("__alias"), "left").drop("__alias")
    return out.withColumn("display", F.coalesce("display", F.col(alias))).withColumn(
        "checkpoint", F.coalesce("checkpoint", F.col(alias)))


def display_name(alias: str) -> str:
    return next((d for a, d, _ in fixed.MODEL_ALIASES if a == alias), alias)


def wide_to_long(df: DataFrame, model: str, modes: Sequence[str] = tuple(fixed.REPLY_SUFFIX), key: str = "row_id",
                 keep: Sequence[str] = ()) -> DataFrame:
    """Long rows ``(key, *keep, model, mode, reply, side_output, accuracy, logprobs)`` from a wide table whose reply column of
    each mode is ``"<display> replies<suffix>"`` and whose log-probabilities are in ``"<display> logprobs<suffix>"``, for guess
    runs ``"guess_native logprobs<suffix>"``. Absent columns read as NULL (P4); the accuracy column may be
    named ``accuracy_score_<reply column>`` or ``accuracy`` (P3). Modes without a reply column are skipped."""
    name = display_name(model)
    cols = set(df.columns)

    def col_or_null(c: str | None, dtype: str = "string"):
        return F.col(f"`{c}`").cast(dtype) if c is not None and c in cols else F.lit(None).cast(dtype)

    items = []
    for mode in modes:
        reply_col = f"{name} replies{fixed.REPLY_SUFFIX[mode]}"
        if reply_col not in cols:
            continue
        side = fixed.SIDE_OUTPUT_COLUMN.get(mode)
        side = side.format(model=name) if side else None
        acc = f"accuracy_score_{reply_col}"
        acc_col = acc if acc in cols else ("accuracy" if "accuracy" in cols else None)
        items.append(F.struct(
            F.lit(mode).alias("mode"), col_or_null(reply_col).alias("reply"), col_or_null(side).alias("side_output"),
            col_or_null(acc_col, "double").alias("accuracy"),
            col_or_null(f"{mode if mode == 'guess_native' else name} logprobs{fixed.REPLY_SUFFIX[mode]}").alias("logprobs")))
    if not items:
        raise ValueError(f"no reply column of model {model!r} in {sorted(cols)[:10]}…")
    return df.select(key, *keep, F.explode(F.array(*items)).alias("__r")).select(
        key, *keep, F.lit(model).alias("model"), "__r.mode", "__r.reply", "__r.side_output", "__r.accuracy", "__r.logprobs")
