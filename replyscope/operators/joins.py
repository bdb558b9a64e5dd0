"""Join helpers. Joins are plain equi-joins: AQE broadcasts a side whose measured bytes are small and splits hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_gold(df: DataFrame, gold: DataFrame, key: str = "nat_instr_id", gold_col: str = "generated_req_output",
              null_safe: bool = False) -> DataFrame:
    """Inner join of rows to their gold answer on ``key``. Unmatched rows are dropped; a duplicated gold key
    multiplies rows, as a hash merge does. ``null_safe=True`` also matches NULL keys to each other (the pandas
    merge behaviour)."""
    g = gold.select(F.col(key).alias("__gk"), gold_col)
    cond = df[key].eqNullSafe(g["__gk"]) if null_safe else df[key] == g["__gk"]
    return df.join(g, cond, "inner").drop("__gk")


def duplicate_keys(gold: DataFrame, key: str = "nat_instr_id") -> DataFrame:
    """Gold keys that occur more than once (each multiplies the rows that join to it)."""
    return gold.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
