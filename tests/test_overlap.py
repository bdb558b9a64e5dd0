"""Overlap metrics: hand-worked values, properties, and ROUGE-Lsum against a direct implementation."""

import math
import random

import pytest
from pyspark.sql import functions as F

from replyscope.operators import overlap


def scores(spark, pairs, **kw):
    rows = [(i, 1, h, r) for i, (h, r) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "row_id long, dataset_id int, reply string, req_output string")
    out = overlap.score_overlap(df, **kw).orderBy("row_id").collect()
    return out


def test_bleu_values(spark):
    out = scores(spark, [("abcde", "abcdx"), ("ab", "ab"), ("xyz", "abc"), ("", "abc"), ("abcd", "abcdefgh"), (None, "a")])
    b = [r["bleu"] for r in out]
    assert b[0] == pytest.approx(0.2 ** 0.25, abs=1e-6)
    assert b[1] == pytest.approx(math.sqrt(2.2250738585072014e-308), rel=1e-9)
    assert b[2] == 0.0 and b[3] == 0.0
    assert b[4] == pytest.approx(math.exp(1 - 8 / 4), abs=1e-6)
    assert b[5] is None


def test_rouge_n_values(spark):
    out = scores(spark, [("the cat", "The cat sat"), ("", "a b")])
    assert out[0]["rouge_1"] == pytest.approx(0.8)
    assert out[0]["rouge_2"] == pytest.approx(2 / 3)
    assert out[1]["rouge_1"] == 0.0


def test_rouge_l_value(spark):
    out = scores(spark, [("a b c d", "b x d c")], rouge_l=True, bleu=False, rouge_n=False)
    assert out[0]["rouge_l"] == pytest.approx(0.5)


def test_non_generation_rows_null(spark):
    df = spark.createDataFrame([(1, 3, "a", "a")], "row_id long, dataset_id int, reply string, req_output string")
    r = overlap.score_overlap(df, rouge_l=True).first()
    assert r["bleu"] is None and r["rouge_1"] is None and r["rouge_l"] is None


def test_identity_properties(spark):
    random.seed(3)
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    texts = [" ".join(random.choice(words) for _ in range(random.randint(2, 12))) for _ in range(20)]
    out = scores(spark, [(t, t) for t in texts], rouge_l=True)
    for r in out:
        assert r["bleu"] == pytest.approx(1.0)
        assert r["rouge_1"] == pytest.approx(1.0) and r["rouge_2"] == pytest.approx(1.0)
        assert r["rouge_l"] == pytest.approx(1.0)


def test_symmetry_and_bounds(spark):
    random.seed(5)
    words = ["a", "b", "c", "d"]
    pairs = [(" ".join(random.choices(words, k=random.randint(1, 9))), " ".join(random.choices(words, k=random.randint(1, 9))))
             for _ in range(30)]
    fwd = scores(spark, pairs, rouge_l=True)
    bwd = scores(spark, [(b, a) for a, b in pairs], rouge_l=True)
    for f, b in zip(fwd, bwd):
        for m in ("rouge_1", "rouge_2", "rouge_l"):
            assert f[m] == pytest.approx(b[m])
            assert 0.0 <= f[m] <= 1.0
        assert f["rouge_l"] <= f["rouge_1"] + 1e-12


def _lsum_direct(hyp: str, ref: str) -> float:
    """Summary-level ROUGE-L written from its definition with full DP tables (test oracle)."""
    import re
    from collections import Counter

    def tok(s):
        return [t for t in re.split(r"\s+", re.sub(r"[^a-z0-9]+", " ", s.lower())) if re.match(r"^[a-z0-9]+$", t)]

    def lines(s):
        return [tok(x) for x in s.split("\n") if len(x)]

    def table(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                t[i][j] = t[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(t[i][j - 1], t[i - 1][j])
        return t

    def path(r, c):
        t = table(r, c)
        i, j, out = len(r), len(c), []
        while i > 0 and j > 0:
            if r[i - 1] == c[j - 1]:
                out.insert(0, i - 1)
                i, j = i - 1, j - 1
            elif t[i][j - 1] > t[i - 1][j]:
                j -= 1
            else:
                i -= 1
        return out

    R, H = lines(ref), lines(hyp)
    m, n = sum(map(len, R)), sum(map(len, H))
    if not m or not n:
        return 0.0
    cr, ch = Counter(t for x in R for t in x), Counter(t for x in H for t in x)
    hits = 0
    for r in R:
        u = set()
        for h in H:
            u |= set(path(r, h))
        for i in sorted(u):
            if ch[r[i]] > 0 and cr[r[i]] > 0:
                hits += 1
                ch[r[i]] -= 1
                cr[r[i]] -= 1
    p, rc = hits / n, hits / m
    return 2 * p * rc / (p + rc) if p + rc else 0.0


def test_rouge_lsum_against_direct(spark):
    random.seed(11)
    words = ["a", "b", "c", "d", "e"]

    def doc():
        return "\n".join(" ".join(random.choices(words, k=random.randint(0, 7))) for _ in range(random.randint(1, 4)))

    pairs = [(doc(), doc()) for _ in range(60)]
    out = scores(spark, pairs, rouge_lsum=True, rouge_l=True, bleu=False, rouge_n=False)
    for (h, r), row in zip(pairs, out):
        assert row["rouge_lsum"] == pytest.approx(_lsum_direct(h, r)), (h, r)
        if "\n" not in h and "\n" not in r:
            assert row["rouge_lsum"] == pytest.approx(row["rouge_l"])


def test_partition_count_independent(spark):
    pairs = [(f"text {i} and more {i % 3}", f"more text {i % 5}") for i in range(40)]
    rows = [(i, 1, h, r) for i, (h, r) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "row_id long, dataset_id int, reply string, req_output string")
    a = overlap.score_overlap(df, partitions=1).orderBy("row_id").collect()
    b = overlap.score_overlap(df, partitions=7).orderBy("row_id").collect()
    assert [(r["bleu"], r["rouge_1"], r["rouge_2"]) for r in a] == [(r["bleu"], r["rouge_1"], r["rouge_2"]) for r in b]
