import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from cases import documents, empty_documents, odd_rows

from replyscope.llm import periodic_runs as pr
from replyscope.llm.registry import QUERIES


def plain_runs(w):
    """Every period tried at every place, the smallest period of each stretch by trying all."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s = w[i : j + q]
            if len(s) >= max(6, 4 * q) and not any(s[: len(s) - r] == s[r:] for r in range(1, q)):
                out.append((i, len(s), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, planted):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if planted and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    text = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    milli = best[1] * 1000 // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def some_words(rng):
    n = rng.choice([0, 1, 5, 6, 8, 30, 120, 400])
    kind = rng.randrange(4)
    if kind == 0:
        return [rng.randint(0, 1) for _ in range(n)]
    if kind == 1:
        w = []
        while len(w) < n:
            u = [rng.randint(0, 3) for _ in range(rng.randint(1, 30))]
            w += u * rng.randint(1, 9)
            w = w[: len(w) - rng.randint(0, 2)]
        return w
    return ([0] * rng.randint(1, 20) + [1]) * rng.randint(1, 20) if kind == 2 else [7] * n


@pytest.mark.parametrize("seed", range(60))
def test_runs_against_every_period(seed):
    rng = random.Random(seed)
    texts = [some_words(rng) for _ in range(rng.randint(1, 6))]
    bounds = np.cumsum([0, *map(len, texts)])
    assert pr.find_runs(np.array([x for t in texts for x in t], np.uint64), bounds) == [plain_runs(t) for t in texts]


@pytest.mark.parametrize("b", [1, 2, 8, 64, 512])
def test_mismatch_is_exact(b):
    rng = np.random.default_rng(b)
    blocks, windows = (rng.integers(0, pr.PRIME, (k * b, 7)) for k in (1, 2))
    windows[b // 2 : b // 2 + b, 3] = blocks[:, 3]
    got = pr.mismatch(blocks.astype(float), windows.astype(float))
    want = [[sum((int(u) - int(w)) ** 2 for u, w in zip(blocks[:, c], windows[d : d + b, c])) % pr.PRIME for c in range(7)] for d in range(b)]
    assert got.tolist() == want and got[b // 2, 3] == 0
    back = pr.reduced(pr.inverse(pr.transform(windows.astype(float))) * pow(2 * b, pr.PRIME - 2, pr.PRIME)) % pr.PRIME
    assert (back == windows).all()


def test_extreme_terms_stay_exact():
    """All terms as large as they get, in the longest transform."""
    n = 2 * pr.BLOCK
    blocks, windows = np.full((n // 2, 1), pr.PRIME - 1.0), np.full((n, 1), pr.PRIME - 1.0)
    assert (pr.mismatch(blocks, windows) == 0).all()
    windows[5, 0] -= 1
    assert np.flatnonzero(pr.mismatch(blocks, windows)[:, 0]).tolist() == list(range(6))


def test_a_long_text_with_a_long_period():
    rng = random.Random(4)
    u = [rng.randint(0, 10**6) for _ in range(30_000)]
    w = np.array([1, 2, 3, *u * 4, u[0], u[1], 5, 6], np.uint64)
    assert pr.find_runs(w, np.array([0, len(w)])) == [[(3, 120_002, 30_000)]]
    # Blocks longer than those compared, and more words than the prime.
    u = rng.sample(range(10**6), 70_000)
    w = np.array([*u[:9], *u * 4, *u[:3]], np.uint64)
    assert pr.find_runs(w, np.array([0, len(w)])) == [[(9, 280_003, 70_000)]]
    same = np.full(100_000, 9, np.uint64)
    assert pr.find_runs(same, np.array([0, len(same)])) == [[(0, 100_000, 1)]]


@pytest.mark.parametrize("planted", [False, True])
def test_rows_against_the_plain_version(spark, tmp_path, planted):
    rng = random.Random(9)
    rows = [r[:2] for r in odd_rows()] + [(100 + i, " ".join(f"w{x}" for x in some_words(rng))) for i in range(200)] + [(7, "ha " * 40 + "ho\x0bho\fho ho ho ho\x85ho")]
    found = pr.periodic_runs(documents(spark, rows), planted=planted)
    assert found.columns == ["doc_id", "n_words", "runs", "collapsed"]
    got = sorted(map(tuple, pr.digest(found).collect()), key=repr)
    assert got == sorted([plain_row(d, t, planted) for d, t in rows], key=repr)
    assert any(plain_row(d, t, True) != plain_row(d, t, False) for d, t in rows)


def test_query_and_empty_table(spark, tmp_path):
    rows = [(i, f"a{i % 3} b c d e f g " * (i % 40 + 1)) for i in range(60)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(plain_row(d, t, True) for d, t in rows)
    assert pr.periodic_runs(empty_documents(spark)).count() == 0
    with pytest.raises(ValueError):
        pr.find_runs(np.zeros(4, np.uint64), np.array([0, 4]), periods=3)
