import math

import numpy as np
from pyspark.sql import functions as F

from replyscope.llm import ball_tree, cross_polytope

SCHEMA = "vec_id long, embedding array<float>, label int, v string, n int, h int, low int, dim string, shard int, score int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1, 2, 3, "d", 4, 5) for i, v in rows], SCHEMA)


def odd(d=16):
    one = [1.0] * d
    return [
        (9001, None), (9002, []), (9003, [0.0] * d), (9004, [1.0, None] + one[2:]), (9005, [float("nan")] + one[1:]),
        (9006, [float("inf")] + one[1:]), (None, one), (9007, [1.0, 2.0]), (9008, one), (9008, one), (9009, [-0.0] + one[1:]), (9010, [0.0] + one[1:]),
    ]


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def near_rows(seed=1, d=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    rows = []
    for i in range(300):
        v = centres[i % 12] + rng.normal(size=d) * rng.choice([0.0, 0.05, 0.2, 0.5])
        rows.append((300 - i, [float(x) for x in v.astype(np.float32)]))
    return rows + [(2000 + i, v) for i, v in rows[:4]]


def test_links_against_brute_force(spark):
    rows = near_rows() + odd()
    got = sorted((tuple(r) for r in cross_polytope.near_vectors(table(spark, rows), tables=12, probes=8, block=8).collect()), key=repr)
    x = [np.array(v, float) if i is not None and usable(v) and any(v) else None for i, v in rows]
    n = len(rows)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and x[i] is not None and x[j] is not None and len(x[i]) == len(x[j]):
                link[i, j] = x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= 0.95
    ids = [r[0] for r in rows]
    label = [i if i is not None else None for i in ids]
    while True:
        new = [
            min([label[i]] + [label[j] for j in range(n) if link[i, j] or (label[i] is not None and ids[i] == ids[j] and x[i] is not None and x[j] is not None)])
            if label[i] is not None else None
            for i in range(n)
        ]
        if new == label:
            break
        label = new
    want = sorted(((ids[i], int(link[i].sum()), label[i], ids[i] is not None and ids[i] == label[i]) for i in range(n)), key=repr)
    assert got == want


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z = rng.normal(size=a.shape)
    z -= (z * a).sum(axis=1, keepdims=True) * a
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    b = 0.952 * a + np.sqrt(1 - 0.952**2) * z
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([a, b]))]
    out = cross_polytope.near_vectors(table(spark, rows))
    assert out.where("n_links >= 1").count() >= 0.99 * 800 and out.where("n_links > 1").count() == 0


def test_hadamard_keeps_angles():
    x = np.random.default_rng(0).normal(size=(5, 32))
    assert np.allclose(cross_polytope.hadamard(x) @ cross_polytope.hadamard(x).T, x @ x.T)


def test_top_k_against_brute_force(spark):
    rows = near_rows(5) + odd() + [(20, [100.0] * 16), (40, [1.0, 2.0, 3.0]), (60, [1.0, 0.0, 0.0])]
    got = sorted(tuple(r) for r in ball_tree.top_k(table(spark, rows), F.col("vec_id") % 20 == 0, k=5, shard_rows=40).collect())
    seen = {(i, tuple(float(math.floor(64 * np.float64(np.float32(x)))) for x in v)) for i, v in rows if i is not None and usable(v)}
    want = []
    for q, v in seen:
        if q % 20 == 0:
            score = sorted((-int(np.dot(v, w)), i) for i, w in seen if i != q and len(w) == len(v))
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(score[:5])]
    assert got == sorted(want)


def expected_top(rows, asked, k):
    """Brute force in Python's integers."""
    seen = {(i, tuple(math.floor(64 * x) for x in v)) for i, v in rows}
    out = []
    for q, v in seen:
        if asked(q):
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in seen if i != q and len(w) == len(v))[:k]
            out += [(q, r + 1, i, min(max(-s, -(2**63)), 2**63 - 1)) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_large_components_are_exact(spark):
    """Scores above 2**53 in all arithmetics, far above the range of long too, next to small ones."""
    rng = np.random.default_rng(8)
    rows = [(0, [1e12, 1.0]), (20, [1e12, 1.0]), (1, [1e12, 1.0 + 1 / 64]), (2, [-1e12, 2.0]), (3, [1e300, -1e300]), (40, [-1e300, 1e200]), (4, [3e305, 0.0])]
    rows += [(100 + i, [float(x) for x in rng.normal(size=2) * 10.0 ** rng.integers(0, 11)]) for i in range(200)]
    rows += [(400 + i, [2.0**24 + i, 2.0**24 - i]) for i in range(60)]
    schema = "vec_id long, embedding array<double>"
    got = ball_tree.top_k(spark.createDataFrame(rows, schema), F.col("vec_id") % 20 == 0, k=7, shard_rows=16)
    assert got.schema["score"].dataType.simpleString() == "bigint"
    got = sorted(tuple(r) for r in got.collect())
    assert got == expected_top(rows, lambda q: q % 20 == 0, 7)
    assert any(2**53 < s < 2**63 - 1 and s % 2 for *_, s in got) and any(s == 2**63 - 1 for *_, s in got)
    # A component that scaled is not finite has no integer.
    assert ball_tree.top_k(spark.createDataFrame([(0, [1e307]), (1, [1.0])], schema), F.col("vec_id") == 0).count() == 0


def test_shards_out_of_reach_are_dropped(spark):
    """Clusters in different directions: most (query, shard) pairs go before the shuffle, and the result stays exact."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(16, 8)) * 4
    rows = [(i, [float(x) for x in centres[i % 16] + rng.normal(size=8) * 0.05]) for i in range(1600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    counted = []
    plain = ball_tree.away_rows
    ball_tree.away_rows = lambda asked, trees, balls: counted.append((asked.count(), sum(b["parts"] for b in balls), plain(asked, trees, balls).count())) or plain(asked, trees, balls)
    try:
        got = sorted(tuple(r) for r in ball_tree.top_k(df, F.col("vec_id") % 20 == 0, k=5, shard_rows=100).collect())
    finally:
        ball_tree.away_rows = plain
    assert got == expected_top(rows, lambda q: q % 20 == 0, 5)
    (asked, shards, sent), = counted
    assert shards >= 16 and sent < asked * (shards - 1) / 2, counted


def test_one_vector_repeated_is_dealt_out(spark):
    """Half of all rows share one vector: their leaf is dealt to several shards."""
    rows = [(i, [1.0, 2.0] if i % 2 else [float(i % 13), float(i % 7)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in ball_tree.top_k(df, F.col("vec_id") % 20 == 0, k=9, shard_rows=50).collect())
    assert got == expected_top(rows, lambda q: q % 20 == 0, 9)


def test_ties_and_few_candidates(spark):
    rows = [(i, [1.0, 0.0]) for i in range(0, 30)]
    got = ball_tree.top_k(table(spark, rows), F.col("vec_id") == 0, k=40, shard_rows=4).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(1, 30)) and {r.score for r in got} == {4096}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert cross_polytope.near_vectors(none).count() == 0
    assert ball_tree.top_k(none, F.col("vec_id") % 20 == 0).count() == 0
