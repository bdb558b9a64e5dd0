"""Cohort labelling (P12, J6), guess labels (P19) and cohort unpivot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyscope.functions import fixed

NATIVE = "native_or_not"
STRICT = "strict_native_or_not"
LANGUAGE_COHORTS = (NATIVE, STRICT)
MEMBERSHIP_COLUMNS = tuple(c for c, _, _, _ in fixed.MEMBERSHIP_COHORTS)


def native_label(nat_lang="nat_lang") -> Column:
    """``native`` when the language text contains ``en`` (a substring test, as the original), else ``non_native``.
    A NULL language is ``non_native``."""
    c = F.col(nat_lang) if isinstance(nat_lang, str) else nat_lang
    yes, no = fixed.NATIVE_LABELS
    return F.when(c.contains(fixed.NATIVE_SUBSTRING), F.lit(yes)).otherwise(F.lit(no))


def strict_native_label(nat_lang="nat_lang") -> Column:
    """``strict native`` when the language text is exactly ``{en}``."""
    c = F.col(nat_lang) if isinstance(nat_lang, str) else nat_lang
    yes, no = fixed.STRICT_NATIVE_LABELS
    return F.when(c == F.lit(fixed.STRICT_NATIVE_VALUE), F.lit(yes)).otherwise(F.lit(no))


def label_cohorts(df: DataFrame, cohorts: DataFrame | None = None, nat_lang: str = "nat_lang",
                  user: str = "user_id") -> DataFrame:
    """Add the cohort columns.

    ``native_or_not`` and ``strict_native_or_not`` come from ``nat_lang``. With a membership table
    ``cohorts(user_id, cohort)`` (cohort in ``western``, ``african``, ``student``) the three membership columns are
    added by one left join of the per-user flags on the user id.
    """
    out = df
    if nat_lang in df.columns:
        out = out.withColumn(NATIVE, native_label(nat_lang)).withColumn(STRICT, strict_native_label(nat_lang))
    if cohorts is None:
        return out
    flags = cohorts.where(F.col(user).isNotNull()).groupBy(F.col(user).alias("__u")).agg(
        *[F.max((F.col("cohort") == name).cast("int")).alias(f"__{col}") for col, name, _, _ in fixed.MEMBERSHIP_COHORTS]
    )
    out = out.join(flags, out[user] == F.col("__u"), "left")
    for col, _, yes, no in fixed.MEMBERSHIP_COHORTS:
        out = out.withColumn(col, F.when(F.col(f"__{col}") == 1, F.lit(yes)).otherwise(F.lit(no)))
    return out.drop("__u", *[f"__{c}" for c in MEMBERSHIP_COLUMNS])


def guess_label(guess) -> Column:
    """``native`` / ``non_native`` / ``unknown`` from a free-text guess (case-sensitive, rules in order).

    1. contains ``native`` and not ``non-native`` -> native; 2. contains ``non-native`` and not `` native`` ->
    non_native; 3. otherwise (NULL included) unknown."""
    g = F.col(guess) if isinstance(guess, str) else guess
    rule1 = g.contains(fixed.GUESS_NATIVE) & ~g.contains(fixed.GUESS_NON_NATIVE_MARK)
    rule2 = g.contains(fixed.GUESS_NON_NATIVE_MARK) & ~g.contains(fixed.GUESS_NATIVE_WITH_SPACE)
    return F.when(rule1, F.lit("native")).when(rule2, F.lit("non_native")).otherwise(F.lit("unknown"))


def unpivot_cohorts(df: DataFrame, cohort_columns, keep) -> DataFrame:
    """One row per (input row, cohort column): ``cohort_type`` is the column name, ``cohort`` its value, so
    statistics over several cohort columns run as one aggregate with ``cohort_type`` as an extra key."""
    return df.unpivot(list(keep), list(cohort_columns), "cohort_type", "cohort")
