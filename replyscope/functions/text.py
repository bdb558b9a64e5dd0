"""String functions, Column -> Column, built only from Catalyst expressions (whole-stage codegen, no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from replyscope.functions import fixed

# Whitespace as Python's str.split()/str.strip() see it: Unicode White_Space plus the four ASCII
# information separators (0x1C-0x1F), which Python also treats as blanks.
_WS_CLASS = r"[\s\x1c\x1d\x1e\x1f]"
_WS_RUN = r"(?U)" + _WS_CLASS + "+"
_EDGE_WS = r"(?U)^" + _WS_CLASS + "+|" + _WS_CLASS + "+$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fill_placeholder(template, prompt) -> Column:
    """Replace ``<tag>[Your Prompt]</tag>.``, then ``…?``, then the bare tag by ``prompt`` (literal replace;
    the trailing ``.`` or ``?`` is swallowed)."""
    out = _c(template)
    for form in fixed.PLACEHOLDER_FORMS:
        out = F.replace(out, F.lit(form), _c(prompt))
    return out


def strip_tags(x) -> Column:
    """Remove the opening and closing tag markers."""
    return F.replace(F.replace(_c(x), F.lit(fixed.TAG_CLOSE), F.lit("")), F.lit(fixed.TAG_OPEN), F.lit(""))


def unwrap_pair(x) -> Column:
    """T4: a stringified pair ``('guess', 'reply')`` -> ``reply``; text after a further ``, '`` is dropped as in the
    original. Plain text is returned unchanged."""
    s = _c(x)
    single = F.replace(F.element_at(F.split(s, ", '"), 2), F.lit("')"), F.lit(""))
    double = F.replace(F.element_at(F.split(s, ', "'), 2), F.lit('")'), F.lit(""))
    return F.when(s.contains(", '"), single).when(s.contains(', "'), double).otherwise(s)


def digit_runs(x) -> Column:
    """All ASCII digit runs of a text, as strings."""
    return F.regexp_extract_all(_c(x), F.lit(r"(\d+)"), 1)


def digit_sum(x) -> Column:
    """T5: sum of all digit runs as DECIMAL(38,0); 0 when there is none; NULL for a NULL text or when a run or the
    sum exceeds 38 digits."""
    zero = F.lit(0).cast("decimal(38,0)")
    return F.aggregate(
        digit_runs(x),
        zero,
        lambda acc, d: F.try_add(acc, d.try_cast("decimal(38,0)")),
    )


def digit_sum_text(x) -> Column:
    """T5 without a limit: the sum of all digit runs as decimal text. Sums beyond 38 digits are added in limbs of nine
    digits, lowest first, with one carry pass."""
    runs = digit_runs(x)
    limbs = F.ceil(F.array_max(F.transform(runs, F.length)) / 9).cast("int") + 2
    width = limbs * 9

    def limb(run: Column, i: Column) -> Column:
        return F.substring(F.lpad(run, width, F.lit("0")), width - i * 9 - 8, F.lit(9)).cast("bigint")

    columns = F.transform(F.sequence(F.lit(0), limbs - 1), lambda i: F.aggregate(runs, F.lit(0).cast("bigint"), lambda acc, r: acc + limb(r, i)))
    start = F.struct(F.lit(0).cast("bigint").alias("carry"), F.lit("").alias("digits"))

    def add(acc: Column, s: Column) -> Column:
        t = acc["carry"] + s
        return F.struct(F.floor(t / F.lit(10**9)).cast("bigint").alias("carry"), F.concat(F.lpad((t % F.lit(10**9)).cast("string"), 9, "0"), acc["digits"]).alias("digits"))

    long = F.ltrim(F.aggregate(columns, start, add, lambda acc: acc["digits"]), F.lit("0"))
    return F.coalesce(digit_sum(x).cast("string"), F.when(long == "", F.lit("0")).otherwise(long))


def first_digit(x) -> Column:
    """The first single digit of a text as INT; NULL when there is none."""
    return F.nullif(F.regexp_extract(_c(x), r"(\d)", 1), F.lit("")).try_cast("int")


def normalise_gold(x) -> Column:
    """Lower case with every ``.`` removed."""
    return F.replace(F.lower(_c(x)), F.lit("."), F.lit(""))


def word_count(x) -> Column:
    """``len(text.split())``: number of non-empty pieces between Unicode whitespace runs; 0 for ''."""
    return F.size(F.filter(F.split(_c(x), _WS_RUN), lambda t: t != F.lit("")))


def join_texts(x) -> Column:
    """Join an array of texts with ', '."""
    return F.array_join(_c(x), fixed.HISTORY_SEPARATOR)


def strip_ws(x) -> Column:
    """``str.strip()``: remove leading and trailing Unicode whitespace."""
    return F.regexp_replace(_c(x), _EDGE_WS, "")


def request_id(row, k) -> Column:
    """``request-{row}-{k}``."""
    return F.format_string("request-%d-%d", _c(row), _c(k))


def char_tokens(x) -> Column:
    """Characters (code points) of a text, in order; ``[]`` for ''."""
    c = _c(x)
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.split(c, ""))


def rouge_tokens(x) -> Column:
    """Word tokens for ROUGE: lower case, every run of characters outside ``[a-z0-9]`` is a separator."""
    return F.filter(F.split(F.lower(_c(x)), r"[^a-z0-9]+"), lambda t: t != F.lit(""))


def logprobs_json(x) -> Column:
    """Token log-probabilities (an array of structs) serialised as one JSON text."""
    return F.to_json(_c(x))
