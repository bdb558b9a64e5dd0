"""Text-overlap metrics per row: character BLEU-4 (M1), ROUGE-1/2 (M2), ROUGE-L (M3), ROUGE-Lsum (M4); per-row
scores, no corpus aggregate (M5).

BLEU and ROUGE-N share one n-gram job: the rows are hash-partitioned by the row key once, each row's n-grams of
both texts are generated inside its projection (``slice`` over the token array, linear in text length), and the
clipped counts are summed by (row, n, gram), then by row. Every aggregate is keyed by the row key first, so all of
them reuse the one partitioning: no further exchange, and no key can be hotter than one text's n-grams.

ROUGE-L and ROUGE-Lsum need a longest common subsequence per row (O(n·m)); that row-local core runs in an Arrow
(pandas) UDF over token arrays that Spark has already produced, with a bit-parallel LCS on Python integers.

Where Python runs anyway, ``score_overlap(row_local=True)`` takes all counts and both LCS scores of a row in one such call: no n-gram
becomes a row, so memory and spilling do not depend on how many rows a partition has."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replyscope.functions import fixed, text


def char_ngrams(x, orders: Sequence[int]) -> Column:
    """All overlapping character n-grams (code points, newlines included) of a text for every n in ``orders``,
    concatenated. One regex look-ahead pass per n, JVM-side."""
    c = F.col(x) if isinstance(x, str) else x
    # (?!\p{Cs}) skips positions inside a surrogate pair, so grams are code points as in Python strings.
    return F.concat(*[F.regexp_extract_all(c, F.lit(f"(?s)(?!\\p{{Cs}})(?=(.{{{n}}}))"), 1) for n in orders])


def word_string(x) -> Column:
    """A text as ROUGE word tokens joined by single spaces."""
    c = F.col(x) if isinstance(x, str) else x
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))


def word_ngrams(words: Column, orders: Sequence[int]) -> Column:
    """All contiguous word n-grams (tokens joined by one space) of a ``word_string``, for every n in ``orders``."""
    tok = "[a-z0-9]+"
    return F.concat(*[
        F.regexp_extract_all(words, F.lit(f"(?<![a-z0-9])(?=({tok}(?: {tok}){{{n - 1}}}))"), 1) for n in orders
    ])


def char_order(g: Column) -> Column:
    return F.length(g)


def word_order(g: Column) -> Column:
    return F.length(g) - F.length(F.replace(g, F.lit(" "), F.lit(""))) + F.lit(1)


def overlap_counts(df: DataFrame, keys: Sequence[str], parts) -> DataFrame:
    """Clipped n-gram overlap per row for one or more gram families in one pass.

    ``parts`` is a list of ``(name, hyp_col, ref_col, orders, order_of)``: array columns of n-grams of all orders
    of one family (e.g. characters, words) and a function giving a gram's n. The result has
    ``(*keys, <name>_<n> ...)`` with the sum over n-grams of min(count in hyp, count in ref).

    All families are exploded together (``posexplode`` of hyp arrays ++ ref arrays; the family and the side follow
    from the position), counted once per (row, family, gram) and summed once per row. Rows without any common
    n-gram are absent (treat as 0)."""
    keys = list(keys)
    hyp_sizes = [F.size(h) for _, h, _, _, _ in parts]
    ref_sizes = [F.size(r) for _, _, r, _, _ in parts]
    arr = F.concat(*[F.col(h) for _, h, _, _, _ in parts], *[F.col(r) for _, _, r, _, _ in parts])
    grams = df.select(*keys, *[x.alias(f"__h{i}") for i, x in enumerate(hyp_sizes)],
                      *[x.alias(f"__r{i}") for i, x in enumerate(ref_sizes)],
                      F.posexplode(arr).alias("__p", "g"))
    p = F.col("__p")
    cum_h, cum_r = [], []
    for i in range(len(parts)):
        cum_h.append(F.col(f"__h{i}") if i == 0 else cum_h[-1] + F.col(f"__h{i}"))
        cum_r.append(F.col(f"__r{i}") if i == 0 else cum_r[-1] + F.col(f"__r{i}"))
    total_h = cum_h[-1]
    q = p - total_h
    fam_h = F.lit(len(parts) - 1)
    fam_r = F.lit(len(parts) - 1)
    for i in range(len(parts) - 2, -1, -1):
        fam_h = F.when(p < cum_h[i], F.lit(i)).otherwise(fam_h)
        fam_r = F.when(q < cum_r[i], F.lit(i)).otherwise(fam_r)
    is_h = p < total_h
    tagged = grams.select(*keys, "g", is_h.alias("__is_h"), F.when(is_h, fam_h).otherwise(fam_r).alias("__fam"))
    per_gram = tagged.groupBy(*keys, "__fam", "g").agg(
        F.count_if(F.col("__is_h")).alias("ch"), F.count_if(~F.col("__is_h")).alias("cr"))
    order = F.lit(None).cast("int")
    for i, (_, _, _, _, order_of) in enumerate(parts):
        order = F.when(F.col("__fam") == i, order_of(F.col("g"))).otherwise(order)
    clipped = per_gram.where((F.col("ch") > 0) & (F.col("cr") > 0)).select(
        *keys, "__fam", order.alias("n"), F.least("ch", "cr").alias("o"))
    sums = []
    for i, (name, _, _, orders, _) in enumerate(parts):
        for n in orders:
            hit = (F.col("__fam") == i) & (F.col("n") == n)
            sums.append(F.sum(F.when(hit, F.col("o")).otherwise(0)).alias(f"{name}_{n}"))
    return clipped.groupBy(*keys).agg(*sums)


def _f1(p: Column, r: Column) -> Column:
    return F.when((p + r) > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))


def bleu_from_counts(o: Sequence[Column], hyp_len: Column, ref_len: Column, max_n: int = 4) -> Column:
    """Sentence BLEU with uniform weights and no smoothing: clipped precisions o_n / max(1, #hyp n-grams); no
    unigram match -> 0; another zero precision counts as the smallest normal double; brevity penalty 1 if the
    hypothesis is longer, 0 if empty, else exp(1 - r/c)."""
    w = 1.0 / max_n
    logs = None
    for n in range(1, max_n + 1):
        total = F.greatest(hyp_len - F.lit(n - 1), F.lit(1)).cast("double")
        p = F.when(o[n - 1] > 0, o[n - 1].cast("double") / total).otherwise(F.lit(fixed.FLOAT_MIN))
        term = F.lit(w) * F.ln(p)
        logs = term if logs is None else logs + term
    bp = F.when(hyp_len > ref_len, F.lit(1.0)).when(hyp_len == 0, F.lit(0.0)).otherwise(
        F.exp(F.lit(1.0) - ref_len.cast("double") / hyp_len.cast("double")))
    return F.when(o[0] == 0, F.lit(0.0)).otherwise(bp * F.exp(logs))


def rouge_n_from_counts(o: Column, hyp_len: Column, ref_len: Column, n: int) -> Column:
    """ROUGE-N F1: P = o / max(#hyp n-grams, 1), R = o / max(#ref n-grams, 1)."""
    hyp_total = F.greatest(hyp_len - F.lit(n - 1), F.lit(0))
    ref_total = F.greatest(ref_len - F.lit(n - 1), F.lit(0))
    p = o.cast("double") / F.greatest(hyp_total, F.lit(1))
    r = o.cast("double") / F.greatest(ref_total, F.lit(1))
    return _f1(p, r)


def explode_partitions(df: DataFrame) -> int:
    """Partitions for a stage that explodes its input: ``spark.sql.shuffle.partitions``, the knob a deployment
    already sizes to its data (the input's own partition count is not used: reading it would execute the plan
    under adaptive execution). Pass ``partitions`` to ``score_overlap`` to override per call."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def scorable(reply: str = "reply", gold: str = "req_output", datasets: Sequence[int] | None = fixed.GENERATION_DATASETS) -> Column:
    """Whether a row gets overlap scores: both texts are there and its dataset is one of ``datasets``."""
    both = F.col(reply).isNotNull() & F.col(gold).isNotNull()
    return both if datasets is None else both & F.coalesce(F.col("dataset_id").isin(*datasets), F.lit(False))


def score_overlap(df: DataFrame, reply: str = "reply", gold: str = "req_output", keys: Sequence[str] = ("row_id",),
                  datasets: Sequence[int] | None = fixed.GENERATION_DATASETS, bleu: bool = True, rouge_n: bool = True,
                  rouge_l: bool = False, rouge_lsum: bool = False, partitions: int | None = None, row_local: bool = False) -> DataFrame:
    """Add ``bleu``, ``rouge_1``, ``rouge_2`` (and optionally ``rouge_l``, ``rouge_lsum``) to every row; rows outside
    ``datasets`` (generation tasks by default) and rows with a NULL text get NULL. ``keys`` must identify a row.

    The rows are hash-partitioned by ``keys`` into ``partitions`` partitions (default ``explode_partitions``). The
    number is explicit on purpose: the n-gram explode multiplies a partition's size about 20-fold, so the
    partitioning must not be coalesced by the (pre-explode) input size.

    ``row_local`` counts the n-grams of a row in one Python call, together with its LCS scores, instead of exploding them: the same
    scores, for jobs that run Python anyway."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    applicable = scorable(reply, gold, datasets)
    n_parts = partitions or explode_partitions(df)
    # One struct key, computed below the exchange: the aggregates and joins below then see exactly the
    # partitioning expression of the repartition, even when a key column is a constant that Catalyst would fold.
    row_keys = keys
    keys = ["__key"]
    rows = df.withColumn("__key", F.struct(*row_keys)).repartition(n_parts, "__key")
    if row_local:
        return _row_local_scores(rows, reply, gold, applicable, bleu, rouge_n, rouge_l, rouge_lsum).drop("__key")
    empty = F.array().cast("array<string>")
    out = rows
    if bleu or rouge_n:
        named, parts = [], []
        if bleu:
            named += [("__hc", char_ngrams(reply, (1, 2, 3, 4))), ("__rc", char_ngrams(gold, (1, 2, 3, 4)))]
            parts.append(("__c", "__hc", "__rc", (1, 2, 3, 4), char_order))
        if rouge_n:
            named += [("__hw", word_ngrams(word_string(reply), (1, 2))), ("__rw", word_ngrams(word_string(gold), (1, 2)))]
            parts.append(("__w", "__hw", "__rw", (1, 2), word_order))
        # Non-applicable rows get empty gram arrays rather than being filtered, so no filter is pushed below
        # the repartition.
        tok = rows.select(*keys, *[F.when(applicable, c).otherwise(empty).alias(n) for n, c in named])
        counts = overlap_counts(tok, keys, parts)
        out = out.join(counts, keys, "left")
        cnt = lambda c: F.coalesce(F.col(c), F.lit(0))
        if bleu:
            val = bleu_from_counts([cnt(f"__c_{n}") for n in (1, 2, 3, 4)], F.length(reply), F.length(gold))
            out = out.withColumn("bleu", F.when(applicable, val))
        if rouge_n:
            hl, rl = F.size(text.rouge_tokens(reply)), F.size(text.rouge_tokens(gold))
            for n in (1, 2):
                out = out.withColumn(f"rouge_{n}", F.when(applicable, rouge_n_from_counts(cnt(f"__w_{n}"), hl, rl, n)))
        out = out.drop(*[c for c in counts.columns if c not in keys])
    if rouge_l:
        out = out.withColumn("rouge_l", F.when(applicable, rouge_l_udf(text.rouge_tokens(reply), text.rouge_tokens(gold))))
    if rouge_lsum:
        out = out.withColumn("rouge_lsum", F.when(applicable, rouge_lsum_udf(line_tokens(reply), line_tokens(gold))))
    return out.drop("__key")


def _row_local_scores(rows: DataFrame, reply: str, gold: str, applicable: Column, bleu: bool, rouge_n: bool, rouge_l: bool,
                      rouge_lsum: bool) -> DataFrame:
    """``score_overlap``'s columns from one call of ``row_counts_udf`` per row; rows that get no scores are not sent."""
    sent = [F.when(applicable, F.col(c)) for c in (reply, gold)]
    out = rows.withColumn("__n", row_counts_udf(*sent, *map(F.lit, (bleu, rouge_n, rouge_l, rouge_lsum))))
    n = lambda c: F.col(f"__n.{c}")
    if bleu:
        val = bleu_from_counts([n(f"c{i}") for i in (1, 2, 3, 4)], F.length(reply), F.length(gold))
        out = out.withColumn("bleu", F.when(applicable, val))
    if rouge_n:
        for i in (1, 2):
            out = out.withColumn(f"rouge_{i}", F.when(applicable, rouge_n_from_counts(n(f"w{i}"), n("hyp_words"), n("ref_words"), i)))
    for name, wanted in (("rouge_l", rouge_l), ("rouge_lsum", rouge_lsum)):
        if wanted:
            out = out.withColumn(name, n(name))
    return out.drop("__n")


def line_tokens(x) -> Column:
    """ROUGE-Lsum input: non-empty lines (split on newline), each tokenised as for ROUGE."""
    c = F.col(x) if isinstance(x, str) else x
    return F.transform(F.filter(F.split(c, "\n"), lambda s: F.length(s) > 0), lambda s: text.rouge_tokens(s))


# ------------------------------------------------------------------------------------------------ LCS (row-local)


def _lcs_rows(ref, can) -> list[int]:
    """Bit-parallel LCS over ``can`` positions: after i tokens of ``ref``, the zero bits of rows[i] among the low j
    bits count LCS(ref[:i], can[:j])."""
    m = len(can)
    masks: dict = {}
    for j, t in enumerate(can):
        masks[t] = masks.get(t, 0) | (1 << j)
    full = (1 << m) - 1
    v = full
    rows = [v]
    for t in ref:
        u = v & masks.get(t, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    return rows


def lcs_length(a, b) -> int:
    """LCS length with O(len(b)) bits of state."""
    if len(a) == 0 or len(b) == 0:
        return 0
    masks: dict = {}
    for j, t in enumerate(b):
        masks[t] = masks.get(t, 0) | (1 << j)
    full = (1 << len(b)) - 1
    v = full
    for t in a:
        u = v & masks.get(t, 0)
        v = ((v + u) | (v - u)) & full
    return len(b) - v.bit_count()


def _lcs_path(ref, can) -> list[int]:
    """Positions in ``ref`` of one LCS, by the usual backtrack from the end (diagonal on equal tokens, else left
    when the left cell is strictly larger, else up)."""
    # A token that ``can`` lacks is always passed by an up step, and where no subsequence is left no step adds a position.
    known = set(can)
    at = [i for i, t in enumerate(ref) if t in known]
    rows = _lcs_rows([ref[i] for i in at], can)

    def t(i, j):
        return j - (rows[i] & ((1 << j) - 1)).bit_count()

    i, j = len(at), len(can)
    left = t(i, j)
    path = []
    while left > 0:
        if ref[at[i - 1]] == can[j - 1]:
            path.append(at[i - 1])
            i -= 1
            j -= 1
            left -= 1
            continue
        back, up = t(i, j - 1), t(i - 1, j)
        if back > up:
            j -= 1
            left = back
        else:
            i -= 1
            left = up
    path.reverse()
    return path


def _f(p: float, r: float) -> float:
    return 2 * p * r / (p + r) if p + r > 0 else 0.0


def rouge_l_value(hyp, ref) -> float:
    if len(hyp) == 0 or len(ref) == 0:
        return 0.0
    lcs = lcs_length(hyp, ref)
    return _f(lcs / len(hyp), lcs / len(ref))


def rouge_lsum_value(hyp_lines, ref_lines) -> float:
    """Summary-level LCS F1: union of per-line LCS hits, each token counted at most as often as it occurs in both."""
    ref_lines = [list(x) for x in ref_lines]
    hyp_lines = [list(x) for x in hyp_lines]
    m = sum(len(x) for x in ref_lines)
    n = sum(len(x) for x in hyp_lines)
    if not m or not n:
        return 0.0
    cnt_r = Counter(t for line in ref_lines for t in line)
    cnt_h = Counter(t for line in hyp_lines for t in line)
    hits = 0
    for r in ref_lines:
        union: set[int] = set()
        for h in hyp_lines:
            union.update(_lcs_path(r, h))
        for i in sorted(union):
            tok = r[i]
            if cnt_h[tok] > 0 and cnt_r[tok] > 0:
                hits += 1
                cnt_h[tok] -= 1
                cnt_r[tok] -= 1
    return _f(hits / n, hits / m)


@F.pandas_udf(T.DoubleType())
def rouge_l_udf(hyp: pd.Series, ref: pd.Series) -> pd.Series:
    return pd.Series([None if h is None or r is None else rouge_l_value(list(h), list(r)) for h, r in zip(hyp, ref)],
                     dtype="float64")


@F.pandas_udf(T.DoubleType())
def rouge_lsum_udf(hyp: pd.Series, ref: pd.Series) -> pd.Series:
    return pd.Series([None if h is None or r is None else rouge_lsum_value(h, r) for h, r in zip(hyp, ref)],
                     dtype="float64")


# ------------------------------------------------------------------------------------------------ all counts of a row


def clipped_counts(hyp: np.ndarray, ref: np.ndarray, max_n: int) -> list[int]:
    """For n = 1..max_n the sum over n-grams of min(count in ``hyp``, count in ``ref``); both are arrays of non-negative whole numbers. The
    n-grams of the shorter text are numbered; the longer one's are looked up there, and one that is missing is in no longer common n-gram."""
    few, many = sorted((hyp.astype(np.int64), ref.astype(np.int64)), key=len)
    radix = max(few.max(initial=0), many.max(initial=0)) + 1
    few_ids, at, many_ids = few, np.arange(len(many)), many  # numbers of the (n-1)-grams and where the longer text has them
    out = []
    for n in range(1, max_n + 1):
        if n > 1:
            few_ids = few_ids[:-1] * radix + few[n - 1:]
            inside = at + n - 1 < len(many)
            at, many_ids = at[inside], many_ids[inside]
            many_ids = many_ids * radix + many[at + n - 1]
        known, few_ids, few_counts = np.unique(few_ids, return_inverse=True, return_counts=True)
        if not len(known):
            out.extend([0] * (max_n - n + 1))
            break
        slot = np.minimum(np.searchsorted(known, many_ids), len(known) - 1)
        hit = known[slot] == many_ids
        at, many_ids = at[hit], slot[hit]
        out.append(int(np.minimum(np.bincount(many_ids, minlength=len(known)), few_counts).sum()))
    return out


def code_points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


ROW_COUNTS = T.StructType([T.StructField(n, T.LongType()) for n in ("c1", "c2", "c3", "c4", "w1", "w2", "hyp_words", "ref_words")]
                          + [T.StructField(n, T.DoubleType()) for n in ("rouge_l", "rouge_lsum")])


# Every byte but a-z, 0-9 and the newline becomes a space.
_WORD_BYTES = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789\n" else 32 for b in range(256))


def line_words(s: str) -> str:
    """A text's ROUGE word tokens: those of a line parted by spaces, lines by newlines."""
    return s.lower().encode("ascii", "replace").translate(_WORD_BYTES).decode()


def _common(hyp, ref) -> int:
    """Sum over the items of ``ref`` of min(count in ``hyp``, count in ``ref``)."""
    h = Counter(hyp)
    return sum(min(n, h[t]) for t, n in Counter(ref).items() if t in h)


def _row_counts(hyp: str, ref: str, bleu: bool, rouge_n: bool, rouge_l: bool, rouge_lsum: bool) -> tuple:
    hyp_words, ref_words = line_words(hyp), line_words(ref)
    h, r = hyp_words.split(), ref_words.split()
    lines = [[line.split() for line in side.split("\n")] for side in (hyp_words, ref_words)] if rouge_lsum else None
    return (*(clipped_counts(code_points(hyp), code_points(ref), 4) if bleu else (0, 0, 0, 0)),
            *((_common(h, r), _common(zip(h, h[1:]), zip(r, r[1:]))) if rouge_n else (0, 0)), len(h), len(r),
            rouge_l_value(h, r) if rouge_l else None, rouge_lsum_value(*lines) if rouge_lsum else None)


@F.pandas_udf(ROW_COUNTS)
def row_counts_udf(hyp: pd.Series, ref: pd.Series, bleu: pd.Series, rouge_n: pd.Series, rouge_l: pd.Series,
                   rouge_lsum: pd.Series) -> pd.DataFrame:
    out = [(None,) * len(ROW_COUNTS) if row[0] is None or row[1] is None else _row_counts(*row)
           for row in zip(hyp, ref, bleu, rouge_n, rouge_l, rouge_lsum)]
    cols = list(zip(*out)) if out else [()] * len(ROW_COUNTS)
    return pd.DataFrame({f.name: pd.Series(c, dtype="Int64" if f.dataType == T.LongType() else "float64") for f, c in zip(ROW_COUNTS, cols)})
