"""Embeddings: standardisation, exact kNN and 2-D projection against numpy brute force."""

import numpy as np
from pyspark.sql import functions as F

from replyscope.operators import vectors


def _emb(spark, n=300, d=6, groups=3, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[:, 2] = 1.5  # a zero-variance dimension
    rows = [(i, int(i % groups), x[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>"), x


def _scaled_np(x, labels):
    out = np.zeros_like(x, dtype=np.float64)
    for g in np.unique(labels):
        m = labels == g
        xs = x[m].astype(np.float64)
        sd = xs.std(axis=0)
        sd[sd == 0] = 1.0
        out[m] = (xs - xs.mean(axis=0)) / sd
    return out


def test_standardize(spark):
    df, x = _emb(spark)
    labels = np.arange(len(x)) % 3
    want = _scaled_np(x, labels)
    got = {r["vec_id"]: r["scaled"] for r in vectors.standardize(df).collect()}
    for i in range(len(x)):
        assert np.allclose(got[i], want[i], atol=1e-9)


def test_cosine_knn_exact(spark):
    df, x = _emb(spark, n=500)
    labels = np.arange(len(x)) % 3
    s = _scaled_np(x, labels)
    scaled = vectors.standardize(df)
    got = {}
    for r in vectors.cosine_knn(scaled, k=15, block_rows=37).collect():
        got.setdefault(r["vec_id"], []).append((r["rank"], r["neighbor_id"]))
    u = s / np.linalg.norm(s, axis=1, keepdims=True)
    for i in range(len(x)):
        same = np.where(labels == labels[i])[0]
        same = same[same != i]
        sims = u[same] @ u[i]
        order = sorted(zip(-sims, same))[:15]
        assert [n for _, n in sorted(got[i])] == [int(n) for _, n in order]


def _clusters(n, d, centres, spread, seed):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(centres, d))[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, d))


def _neighbours(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["vec_id"], set()).add(r["neighbor_id"])
    return out


def test_lsh_recall_against_exact(spark):
    x = _clusters(6000, 32, 60, 0.4, 3)
    df = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, scaled array<double>")
    exact, near = _neighbours(vectors.cosine_knn(df)), vectors.cosine_knn_lsh(df, bucket_rows=256)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    rows = near.collect()
    assert all(r["vec_id"] != r["neighbor_id"] for r in rows) and len({(r["vec_id"], r["rank"]) for r in rows}) == len(rows)
    found = {}
    for r in rows:
        found.setdefault(r["vec_id"], set()).add(r["neighbor_id"])
    recall = sum(len(exact[i] & found.get(i, set())) for i in exact) / sum(map(len, exact.values()))
    assert recall >= 0.9, recall
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert all(abs(u[r["vec_id"]] @ u[r["neighbor_id"]] - r["sim"]) < 1e-9 for r in rows)


def test_lsh_is_exact_in_one_bucket_and_splits_a_hot_one(spark):
    df, _ = _emb(spark, n=300)
    scaled = vectors.standardize(df)
    cols = ["label", "vec_id", "rank", "neighbor_id"]
    assert sorted(map(tuple, vectors.cosine_knn_lsh(scaled).select(cols).collect())) == sorted(map(tuple, vectors.cosine_knn(scaled).select(cols).collect()))
    # Half of all vectors on one spot: their bucket is cut into blocks, and each still gets its nearest, smallest ids first.
    rows = [(i, 0, [1.0, 2.0, 3.0] if i % 2 else [float(i % 97), 1.0, -float(i % 89)]) for i in range(800)]
    hot = spark.createDataFrame(rows, "vec_id long, label int, scaled array<double>")
    got = {r["vec_id"]: r for r in vectors.cosine_knn_lsh(hot, k=3, bucket_rows=64, tables=2).where("rank = 3").collect()}
    assert all(got[i]["neighbor_id"] == (5 if i not in (1, 3, 5) else 7) and got[i]["sim"] > 1 - 1e-9 for i in range(1, 800, 2))


def test_knn_small_group(spark):
    rows = [(1, 0, [1.0, 0.0]), (2, 0, [0.0, 1.0]), (3, 1, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, scaled array<double>")
    out = sorted((r["vec_id"], r["neighbor_id"]) for r in vectors.cosine_knn(df, k=15).collect())
    assert out == [(1, 2), (2, 1)]


def test_project_2d(spark):
    df, x = _emb(spark, n=200, d=5, groups=2)
    scaled = vectors.standardize(df)
    got = {r["vec_id"]: (r["pc1"], r["pc2"]) for r in vectors.project_2d(scaled).collect()}
    labels = np.arange(len(x)) % 2
    s = _scaled_np(x, labels)
    for g in (0, 1):
        idx = np.where(labels == g)[0]
        xs = s[idx] - s[idx].mean(axis=0)
        _, _, vt = np.linalg.svd(xs, full_matrices=False)
        ref = xs @ vt[:2].T
        mine = np.array([got[i] for i in idx])
        for c in range(2):  # signs are arbitrary
            assert np.allclose(np.abs(mine[:, c]), np.abs(ref[:, c]), atol=1e-6)


def test_embed_with_encoder(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "abcd"), (3, None)], "id long, t string")

    def encoder(texts):
        return [[float(len(t)), 1.0] for t in texts]

    out = {r["id"]: list(r["embedding"]) for r in vectors.embed(df, "t", encoder, batch_size=2).collect()}
    assert out == {1: [2.0, 1.0], 2: [4.0, 1.0], 3: [0.0, 1.0]}


def test_text_keys_and_groups(spark):
    rows = [(f"v{i}", f"g{i % 2}", [float(i), float(i * i % 7), 1.0]) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id string, label string, embedding array<float>")
    scaled = vectors.standardize(df)
    knn = vectors.cosine_knn(scaled, k=3).collect()
    assert len(knn) == 36 and all(r["label"].startswith("g") and r["neighbor_id"].startswith("v") for r in knn)
    assert vectors.project_2d(scaled).count() == 12


def test_best_columns_against_sorting():
    rng = np.random.default_rng(4)
    ids = np.sort(rng.integers(0, 30, 40))
    starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    s = rng.integers(0, 4, (50, 40)) / 3.0  # many ties
    for k in (1, 5, 39, 40):
        rows, cols = vectors.best_columns(s, k, starts)
        for i in range(len(s)):
            got = cols[rows == i]
            order = np.lexsort((ids, -s[i]))
            assert sorted(zip(-s[i][got], ids[got]))[:k] == [(-s[i][j], ids[j]) for j in order[:k]]
            assert len(set(ids[got])) <= k


def test_equal_vectors_give_no_more_than_k_candidates(spark):
    """on a spot of equal vectors each keeps k of a block, not all."""
    rows = [(i, 0, [1.0, 2.0, 3.0]) for i in range(400)]
    base = vectors._unit_rows(spark.createDataFrame(rows, "vec_id long, label int, scaled array<double>"), "scaled", "label", "vec_id")
    found = vectors._cell_candidates(base, ["grp"], 3, vectors._large_cells(base, ["grp"], 100))
    assert 3 * 400 <= found.count() <= 3 * 400 * 8  # about four blocks
    assert found.groupBy("vec_id").count().where("count < 3").isEmpty()


def test_vectors_move_once(spark):
    """bucket sizes are counted from ids alone; a vector moves to its block, its candidates to their ranking."""
    df, _ = _emb(spark, n=50)
    unit = df.withColumnRenamed("embedding", "scaled").withColumn("scaled", F.col("scaled").cast("array<double>"))
    for name in ("cosine_knn", "cosine_knn_lsh"):
        plan = getattr(vectors, name)(unit)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan.split("FlatMapGroupsInArrow")[0] and "FlatMapGroupsInArrow" in plan
        moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        blocks = [line for line in moved if "bi#" in line]
        assert len(blocks) == 1 and plan.split("FlatMapGroupsInArrow")[0].count("Exchange hashpartitioning") == 1, name
