"""Reports: two-stage macro averages (A1–A4), run comparison (U1, U2), counts (A8, A9), filters (F3, F7),
missing-score fill (P20) and multi-reference aggregation (A12).

All are partial (map-side) aggregations: the first stage is keyed by (cohort, group, example) and shrinks the data
to one row per key before the only shuffle; the second stage runs on that small table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyscope.functions import fixed
from replyscope.operators.cohorts import NATIVE, guess_label

RUN_OF_MODE = {
    "standard": "standard",
    "add_all_native": "native",
    "add_all_non_native": "non_native",
    "guess_native": "guess_native",
}


def _not_null(cols) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return cond


def macro_average(df: DataFrame, cohort: str, by: Sequence[str] = (), metrics: Sequence[str] = ("accuracy",),
                  example: str = "example_id") -> DataFrame:
    """A1–A3: mean of every metric per (cohort, *by, example), then mean of those means per (cohort, *by).

    NULL metrics are skipped at both stages (an all-NULL example is skipped by the outer mean); rows with a NULL
    key are dropped, as a pandas group-by does."""
    keys = [cohort, *by]
    inner = (
        df.where(_not_null([*keys, example]))
        .groupBy(*keys, example)
        .agg(*[F.avg(F.col(m).cast("double")).alias(m) for m in metrics])
    )
    return inner.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics])


def macro_average_sets(df: DataFrame, cohort: str, by: Sequence[str] = (), sets: Sequence[str] = ("set_id", "dataset_id"),
                       metrics: Sequence[str] = ("accuracy",), example: str = "example_id") -> DataFrame:
    """A1-A3 in one pass: ``macro_average`` overall and per each column of ``sets``, with ``GROUPING SETS`` for both stages.

    ``level`` names the column that a row is broken down by (``overall`` for none); the other columns of ``sets`` are NULL. The first
    stage's partial sums of all levels come from one scan and are the only data shuffled at full width."""
    keys = [cohort, *by]
    rows = df.where(_not_null([*keys, example]))
    levels = [[F.col(c) for c in (*keys, example, *extra)] for extra in [(), *[(c,) for c in sets]]]
    bit = {c: len(sets) - 1 - i for i, c in enumerate(sets)}  # a column's place in grouping_id: 1 where it is rolled up
    inner = rows.groupingSets(levels, *keys, example, *sets).agg(
        F.grouping_id().alias("__level"), *[F.avg(F.col(m).cast("double")).alias(m) for m in metrics])
    everything = (1 << len(sets)) - 1
    name = F.lit("overall")
    for c in sets:
        here = F.col("__level") == everything - (1 << bit[c])
        # Rows whose own key is NULL are dropped, as in the single reports.
        inner = inner.where(~here | F.col(c).isNotNull())
        name = F.when(here, F.lit(c)).otherwise(name)
    return inner.withColumn("level", name).groupBy("level", *keys, *sets).agg(*[F.avg(m).alias(m) for m in metrics])


def metric_columns(kind: str = "all") -> tuple[str, ...]:
    """A4: classification -> accuracy; generation -> bertscore_f1; all -> the 13 metric columns."""
    if kind == "classification":
        return ("accuracy",)
    if kind == "generation":
        return ("bertscore_f1",)
    if kind == "all":
        return fixed.ALL_METRICS
    raise ValueError("kind must be one of classification, generation, all")


def drop_dataset(df: DataFrame, dataset_id: int = 3) -> DataFrame:
    """drop one dataset; rows with a NULL dataset id are kept (pandas ``!=``)."""
    return df.where(~F.col("dataset_id").eqNullSafe(F.lit(dataset_id)))


def with_guess(df: DataFrame, guess: str = "side_output") -> DataFrame:
    """P19 + F7 inputs: ``final_guess`` from the guess text and ``guess_correct`` = final_guess == native_or_not."""
    return df.withColumn("final_guess", guess_label(guess)).withColumn(
        "guess_correct", F.coalesce(F.col("final_guess") == F.col(NATIVE), F.lit(False))
    )


def run_labels(mode: str = "mode") -> Column:
    """U1 without a union: each scored row carries the run(s) it belongs to. Guess rows that guessed right belong to
    ``guess_native`` and ``guess_native_correct``."""
    base = F.coalesce(*[F.when(F.col(mode) == m, F.lit(run)) for m, run in RUN_OF_MODE.items()], F.col(mode))
    return F.when(
        (F.col(mode) == "guess_native") & F.col("guess_correct"),
        F.array(base, F.lit("guess_native_correct")),
    ).otherwise(F.array(base))


def compare_runs(scores: DataFrame, cohort: str = NATIVE, by: Sequence[str] = (),
                 metrics: Sequence[str] = fixed.ALL_METRICS) -> DataFrame:
    """Macro averages of every run (standard, native, non_native, guess_native, guess_native_correct) per
    (model, cohort, *by), long format, computed in one aggregate over a ``run`` key."""
    df = scores
    if "guess_correct" not in df.columns:
        df = df.withColumn("guess_correct", F.lit(False))
    df = df.withColumn("run", F.explode(run_labels()))
    return macro_average(df, cohort, by=["model", "run", *by], metrics=metrics).select(
        "model", "run", cohort, *by, *metrics
    )


def round_half_even(c: Column, digits: int = 2) -> Column:
    """Round on the binary value, half to even (``DataFrame.round``): rint(x * 10^d) / 10^d."""
    scale = 10.0 ** digits
    return F.rint(c * F.lit(scale)) / F.lit(scale)


def comparison_table(long: DataFrame, cohort: str = NATIVE, by: Sequence[str] = (),
                     metrics: Sequence[str] = fixed.ALL_METRICS, cohort_values: Sequence[str] = fixed.NATIVE_LABELS,
                     runs: Sequence[str] = fixed.RUN_LABELS, *, models: Sequence[str]) -> DataFrame:
    """Transpose the long comparison to one row per metric (per ``by`` group) and one column per
    ``{model}_{run}_{cohort}``, values rounded to two places. All pivot values are given, so no job runs to
    discover them."""
    values = [f"{m}_{r}_{c}" for m in models for r in runs for c in cohort_values]
    stacked = long.unpivot(["model", "run", cohort, *by], list(metrics), "metric", "value")
    keyed = stacked.withColumn("column", F.concat_ws("_", "model", "run", cohort))
    wide = keyed.groupBy(*by, "metric").pivot("column", values).agg(F.first("value"))
    return wide.select(*by, "metric", *[round_half_even(F.col(f"`{v}`")).alias(v) for v in values])


def guess_counts(scores: DataFrame, cohort: str = NATIVE) -> DataFrame:
    """Rows of the guess run, native rows, and correctly guessed native / non-native rows (one aggregate)."""
    g = scores.where(F.col("mode") == "guess_native")
    return g.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(cohort) == "native").alias("n_native"),
        F.count_if(F.col("guess_correct") & (F.col(cohort) == "native")).alias("n_correct_native"),
        F.count_if(F.col("guess_correct") & (F.col(cohort) == "non_native")).alias("n_correct_non_native"),
    )


def missing_counts(scores: DataFrame, group: Sequence[str] = ("model", "mode")) -> DataFrame:
    """Classification rows without accuracy and generation rows without BLEU."""
    cls = F.col("dataset_id").isin(*fixed.CLASSIFICATION_DATASETS)
    gen = F.col("dataset_id").isin(*fixed.GENERATION_DATASETS)
    return scores.groupBy(*group).agg(
        F.count_if(cls & F.col("accuracy").isNull()).alias("missing_accuracy"),
        F.count_if(gen & F.col("bleu").isNull()).alias("missing_bleu"),
    )


def fill_missing_accuracy(scores: DataFrame) -> DataFrame:
    """P20 (off by default in reports): classification rows without accuracy count as wrong (0)."""
    cls = F.col("dataset_id").isin(*fixed.CLASSIFICATION_DATASETS)
    return scores.withColumn("accuracy", F.when(cls, F.coalesce(F.col("accuracy"), F.lit(0.0))).otherwise(F.col("accuracy")))


def multi_ref(scores: DataFrame, key: str = "row_id", ref: str = "ref_idx", score: str = "score",
              agg="mean", refs: int | None = None) -> DataFrame:
    """Combine the scores of several references per row by mean or max (``agg`` may also be a sequence,
    giving one ``<score>_<agg>`` column each, from one aggregate). Every row must have the same number of
    references, or the job fails: ``refs`` if given, which takes one pass over ``scores``, else the largest number of any
    row, for which the references are counted in a pass of their own."""
    aggs = [agg] if isinstance(agg, str) else list(agg)
    if any(a not in ("mean", "max") for a in aggs):
        raise NotImplementedError(agg)
    fns = {"mean": F.avg, "max": F.max}
    names = [score] if isinstance(agg, str) else [f"{score}_{a}" for a in aggs]
    per_row = scores.groupBy(key).agg(
        F.count(F.col(ref)).alias("n_refs"), *[fns[a](score).alias(n) for a, n in zip(aggs, names)])
    most = F.lit(refs) if refs is not None else scores.groupBy(key).agg(F.count(F.col(ref)).alias("n")).agg(F.max("n")).scalar()
    guard = F.when(F.col("n_refs") != most, F.raise_error(F.lit("rows have different numbers of references")).cast("double"))
    return per_row.select(key, *[F.coalesce(guard, F.col(n)).alias(n) for n in names])
