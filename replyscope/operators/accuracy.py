"""Rule-based accuracy of classification replies (K1–K6), as one CASE expression per row.

Scores are 1/0, or NULL where the rule cannot decide (ambiguous yes/no, several option letters, non-applicable
dataset, NULL reply or unparseable gold)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyscope.functions import text

RATING_DATASETS = (3,)
OPTION_DATASETS = (0, 2)
YES_NO_DATASETS = (4, 5)
CHOICE_DATASETS = (9,)


def _as_int(b: Column) -> Column:
    return b.cast("int")


def rating_score(reply: Column, gold: Column) -> Column:
    """K1: the digit-run sum of the reply equals the integer gold rating."""
    s = text.digit_sum(reply)
    # int(text): optional sign and blanks around ASCII digits; anything else is unparseable (NULL).
    g = F.when(gold.rlike(r"^\s*[+-]?\d+\s*$"), text.strip_ws(gold).try_cast("decimal(38,0)"))
    # A reply whose digit sum overflows 38 digits cannot equal a 38-digit gold: score 0.
    return F.when(reply.isNull() | g.isNull(), F.lit(None).cast("int")).when(s.isNull(), F.lit(0)).otherwise(_as_int(s == g))


def option_score(reply: Column, gold: Column) -> Column:
    """K2: the digit-run sum of the reply equals the first digit of the gold text."""
    s = text.digit_sum(reply)
    g = text.first_digit(gold).cast("decimal(38,0)")
    return F.when(reply.isNull() | g.isNull(), F.lit(None).cast("int")).when(s.isNull(), F.lit(0)).otherwise(_as_int(s == g))


def yes_no_score(reply: Column, gold: Column) -> Column:
    """K3: NULL if the lower-cased reply contains both ``no`` and ``yes``; else whether the normalised gold
    (lower case, dots removed) is a substring of the lower-cased reply."""
    r = F.lower(reply)
    both = r.contains("no") & r.contains("yes")
    return F.when(both, F.lit(None).cast("int")).otherwise(_as_int(r.contains(text.normalise_gold(gold))))


def _count(reply: Column, needles) -> Column:
    total = F.lit(0)
    for group in needles:
        hit = None
        for n in group:
            h = reply.contains(n)
            hit = h if hit is None else (hit | h)
        total = total + _as_int(hit)
    return total


def choice_score(reply: Column, gold: Column) -> Column:
    """K4: if exactly one of ``A``/``B``/``C`` occurs in the reply, whether the gold letter occurs in it; else if
    exactly one of ``X.``/``X:`` forms occurs, the same test on the whole reply; else NULL (case-sensitive)."""
    letters = _count(reply, (("A",), ("B",), ("C",)))
    marked = _count(reply, (("A.", "A:"), ("B.", "B:"), ("C.", "C:")))
    hit = _as_int(reply.contains(gold))
    return F.when(letters == 1, hit).when(marked == 1, hit).otherwise(F.lit(None).cast("int"))


def accuracy(dataset_id="dataset_id", reply="reply", gold="req_output") -> Column:
    """K1–K5 dispatched on the dataset id; generation datasets (and any other id) get NULL."""
    d = F.col(dataset_id) if isinstance(dataset_id, str) else dataset_id
    r = F.col(reply) if isinstance(reply, str) else reply
    g = F.col(gold) if isinstance(gold, str) else gold
    return (
        F.when(r.isNull(), F.lit(None).cast("int"))
        .when(d.isin(*RATING_DATASETS), rating_score(r, g))
        .when(d.isin(*OPTION_DATASETS), option_score(r, g))
        .when(d.isin(*YES_NO_DATASETS), yes_no_score(r, g))
        .when(d.isin(*CHOICE_DATASETS), choice_score(r, g))
        .otherwise(F.lit(None).cast("int"))
    )


def score_accuracy(df: DataFrame, reply: str = "reply", gold: str = "req_output", out: str = "accuracy") -> DataFrame:
    """Add the accuracy column (DOUBLE, like the other metrics)."""
    return df.withColumn(out, accuracy("dataset_id", reply, gold).cast("double"))


def predicted_rating(dataset_id="dataset_id", reply="reply") -> Column:
    """K6: the digit-run sum of the reply for rating rows (dataset 3), else NULL."""
    d = F.col(dataset_id) if isinstance(dataset_id, str) else dataset_id
    r = F.col(reply) if isinstance(reply, str) else reply
    return F.when(d.isin(*RATING_DATASETS), text.digit_sum(r))
