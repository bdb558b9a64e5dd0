import itertools
import random

import numpy as np
import pytest
import xxhash
from cases import documents, empty_documents, odd_rows, words
from pyspark.sql import functions as F

from replyscope.llm import simhash as S


def slow_fingerprint(text: str | None) -> int:
    b = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = b.split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def components(ids, fps, radius=3):
    """Smallest id reachable per row, null ids last."""
    n = len(fps)
    label = list(range(n))
    for _ in range(n):
        new = [min(label[j] for j in range(n) if (fps[i] ^ fps[j]).bit_count() <= radius) for i in range(n)]
        if new == label:
            break
        label = new
    low = {g: min((ids[i] for i in range(n) if label[i] == g and ids[i] is not None), default=None) for g in set(label)}
    return [low[g] for g in label]


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_pair(radius):
    masks = S.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for bits in itertools.combinations(range(0, 64, 1 if radius < 3 else 3), radius):
        diff = sum(1 << b for b in bits)
        assert any(not m & diff for m in masks)


def test_documents_against_brute_force(spark):
    rng = random.Random(2)
    base = [words(rng, 40) for _ in range(15)]
    rows = [(i, b) for i, b in enumerate(base)]
    for i in range(60):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = "changed"
        rows.append((100 - i, " ".join(w)))
    rows += [(r[0] + 1000 if r[0] else r[0], r[1]) for r in odd_rows()]
    docs = documents(spark, rows)
    got = S.simhash_components(docs).select("doc_id", "fingerprint", "component_id").collect()
    fps = [slow_fingerprint(r[1]) for r in rows]
    want = [(r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, components([r[0] for r in rows], fps))]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    kept = S.one_of_each(docs)
    assert kept.count() == len({c for c in components(list(range(len(rows))), fps)}) and kept.columns == docs.columns


def test_hot_buckets_link_alike(spark):
    rng = random.Random(4)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << rng.randrange(24) for _ in range(rng.randrange(5))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(50)})
    df = spark.createDataFrame([(S.signed(f),) for f in fps], "fp long")
    want = components([S.signed(f) for f in fps], fps)
    for hot in (8, 10_000):
        roots = {r.node: r.root for r in S.connected_components(S.link_fingerprints(df, 3, hot)).collect()}
        assert [roots.get(S.signed(f), S.signed(f)) for f in fps] == want


def test_spark_hash_is_the_same_xxh64(spark):
    got = spark.sql("select 'a b c' as s").select(F.xxhash64("s").alias("h")).first().h
    assert got == S.signed(xxhash.xxh64(b"a b c", seed=42).intdigest())
    assert S.fingerprint(b"A b\x0bC") == xxhash.xxh64(b"a b c", seed=42).intdigest() and S.fingerprint(b" \n") == 0


def test_empty_table(spark):
    assert S.simhash_components(empty_documents(spark)).count() == 0 and S.one_of_each(empty_documents(spark)).count() == 0


def test_long_text():
    w = [f"w{i}" for i in range(100_000)]
    text = " ".join(w)
    ones = np.zeros(64, int)
    for i in range(len(w) - 2):
        h = xxhash.xxh64_intdigest(f"w{i} w{i + 1} w{i + 2}".encode(), 42)
        ones += [(h >> k) & 1 for k in range(64)]
    assert S.fingerprint(text.encode()) == sum(1 << k for k in range(64) if 2 * ones[k] > len(w) - 2)


def test_components_of_stars_and_chains(spark):
    """A star of many leaves, chains, a cycle and edges in both directions, against union-find."""
    from replyscope.llm.components import connected_components

    edges = [(0, i) for i in range(1, 20_001)] + [(30_000 + i, 30_001 + i) for i in range(40)] + [(40_000 + i, 40_000 + (i + 1) % 9) for i in range(9)]
    edges += [(7, 50_000), (50_001, 50_000), (60_001, 60_000), (60_000, 60_001), (70_000, 70_000)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: find(x) for x in parent if x != 70_000}
    assert got == {x: r for x, r in want.items() if x != r}
