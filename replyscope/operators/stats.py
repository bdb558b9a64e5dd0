"""Dataset statistics: word counts (T9, A7) and fixed-edge histograms (A10, E5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyscope.functions import fixed, text


def with_word_counts(df: DataFrame, prompt: str = "prompt_en", reply: str = "reply") -> DataFrame:
    """T9 on the annotator's prompt and the model's reply."""
    return df.withColumn("word_count_annotation", text.word_count(prompt)).withColumn(
        "word_count_generated", text.word_count(reply)
    )


def mean_word_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean word counts of prompt and reply per group."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return df.where(cond).groupBy(*keys).agg(
        F.avg("word_count_annotation").alias("avg_words_prompt"),
        F.avg("word_count_generated").alias("avg_words_reply"),
    )


def histogram_bin(value: Column, edges: Sequence[float] = fixed.HISTOGRAM_EDGES) -> Column:
    """Bin index of a value for ascending edges: [e0,e1) … [e(k-2), e(k-1)), the last bin closed; values outside
    (and NULL) get NULL."""
    v = value.cast("double")
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        lo, hi = float(edges[i]), float(edges[i + 1])
        inside = (v >= lo) & ((v <= hi) if i == len(edges) - 2 else (v < hi))
        out = F.when(inside, F.lit(i)).otherwise(out)
    return out


def histogram(df: DataFrame, value: str, keys: Sequence[str] = (), edges: Sequence[float] = fixed.HISTOGRAM_EDGES) -> DataFrame:
    """A10: counts per bin and group, every bin present (0 when empty), from one aggregate. Groups are those present in
    ``df``."""
    n_bins = len(edges) - 1
    counts = df.groupBy(*keys).agg(*[F.count_if(histogram_bin(F.col(value), edges) == i).alias(f"n{i}") for i in range(n_bins)])
    bins = F.posexplode(F.array(*[F.col(f"n{i}") for i in range(n_bins)])).alias("bin", "n")
    return counts.select(*keys, bins)
