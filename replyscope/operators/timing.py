"""Time per annotation: gap to the writer's previous annotation (W1), capped (W1b), and its group statistics
(A5 mean gap, A6 per-writer total then mean).

The gap needs each row's predecessor in (time, tie) order per writer. A window over a whole writer would put a
prolific writer (say a third of all rows) in one task, so it runs in two phases: ``lag`` inside
(writer, time bucket) windows, and for the first row of a bucket the last time of the writer's previous non-empty
bucket, taken from a (writer, bucket) table that has one row per bucket."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replyscope.functions import fixed

GAP = "gap_seconds"


def gap_to_previous(df: DataFrame, user: str = "user_id", ts: str = "time", tie: Sequence[str] = ("row_id",),
                    cap_minutes: float = fixed.GAP_CAP_MINUTES, bucket: str = "hour", out: str = GAP) -> DataFrame:
    """Add ``out``: seconds since the same writer's previous row in (ts, *tie) order, capped at ``cap_minutes``.
    A gap equal to the cap or above becomes the cap (strict ``<``); a writer's first row, a NULL time and a NULL
    writer get the cap. ``bucket`` is the ``date_trunc`` unit of the first phase."""
    cap = float(cap_minutes) * 60.0
    # Rows without a writer or a time need no order: they stay out of the windows, where they would all share one.
    placed = F.col(user).isNotNull() & F.col(ts).isNotNull()
    rest = df.where(~placed).withColumn(out, F.lit(cap))
    rows = df.where(placed).withColumn("__tb", F.date_trunc(bucket, F.col(ts)))
    order = [F.col(ts).asc(), *[F.col(t).asc_nulls_last() for t in tie]]
    rows = rows.withColumn("__prev", F.lag(ts).over(Window.partitionBy(user, "__tb").orderBy(*order)))
    last = rows.groupBy(user, "__tb").agg(F.max(ts).alias("__last"))
    last = last.withColumn("__carry", F.lag("__last").over(Window.partitionBy(user).orderBy("__tb"))).drop("__last")
    # Rows of a bucket other than its first have an in-bucket predecessor; the first takes the carried time.
    rows = rows.join(last, [user, "__tb"], "left")
    prev = F.coalesce(F.col("__prev"), F.col("__carry"))
    gap = F.timestamp_diff("MICROSECOND", prev, F.col(ts)) / F.lit(1e6)
    rows = rows.withColumn(out, F.when(gap < F.lit(cap), gap).otherwise(F.lit(cap)))
    return rows.select(*df.columns, out).unionByName(rest)


def mean_gap(df: DataFrame, keys: Sequence[str], gap: str = GAP) -> DataFrame:
    """A5: mean capped gap (seconds) per group."""
    return df.where(_keys_not_null(keys)).groupBy(*keys).agg(F.avg(gap).alias("mean_gap_seconds"))


def total_time(df: DataFrame, keys: Sequence[str], user: str = "user_id", gap: str = GAP) -> DataFrame:
    """Total capped time per (group, writer), then the mean of those totals per group (seconds)."""
    per_user = df.where(_keys_not_null([*keys, user])).groupBy(*keys, user).agg(F.sum(gap).alias("__total"))
    return per_user.groupBy(*keys).agg(F.avg("__total").alias("mean_total_seconds"))


def _keys_not_null(keys) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return cond
