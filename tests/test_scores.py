"""The stored score table: only new or changed rows are scored, reports read what is stored."""

import tempfile

import pytest
from pyspark.sql import functions as F

from replyscope.operators import accuracy, overlap, report, scores


def _runs(spark, n=20):
    rows = [(i, "m", mode, 1 + i % 2 * 2, f"reply {i} {mode}", str(i % 5), f"reply {i} standard", "native", i % 3)
            for i in range(n) for mode in ("standard", "add_all_native")]
    return spark.createDataFrame(rows, "row_id long, model string, mode string, dataset_id int, reply string, req_output string, "
                                       "generated_req_output string, native_or_not string, example_id long")


METRICS = ("accuracy", "bleu", "rouge_1")


def _counting(seen):
    def score(new):
        seen.append(sorted((r["row_id"], r["mode"]) for r in new.collect()))
        return overlap.score_overlap(accuracy.score_accuracy(new), gold="generated_req_output", keys=scores.KEYS)

    return score


def test_a_second_run_scores_no_row(spark):
    path, seen, runs = tempfile.mkdtemp(prefix="rs-table-") + "/scores", [], _runs(spark)
    for _ in range(2):
        scores.update_scores(runs, path, _counting(seen), metrics=METRICS)
    assert [len(s) for s in seen] == [40]
    assert spark.read.parquet(path).count() == 40
    direct = overlap.score_overlap(accuracy.score_accuracy(runs), gold="generated_req_output", keys=scores.KEYS)
    stored = scores.with_scores(runs, path)
    assert stored.columns == [*runs.columns, *METRICS]
    assert sorted(map(tuple, stored.collect()), key=repr) == sorted(map(tuple, direct.select(*stored.columns).collect()), key=repr)


def test_new_and_changed_rows_are_scored(spark):
    path, seen, runs = tempfile.mkdtemp(prefix="rs-table-") + "/scores", [], _runs(spark)
    scores.update_scores(runs.where("row_id < 18"), path, _counting(seen), metrics=METRICS)
    changed = runs.withColumn("reply", F.when(F.col("row_id") == 4, F.lit("another")).otherwise(F.col("reply")))
    scores.update_scores(changed, path, _counting(seen), metrics=METRICS)
    assert sorted({r for r, _ in seen[1]}) == [4, 18, 19]
    out = scores.with_scores(changed, path)
    assert out.count() == 40 and out.where("row_id = 4 and mode = 'standard'").first()["accuracy"] == \
        accuracy.score_accuracy(changed.where("row_id = 4 and mode = 'standard'")).first()["accuracy"]
    # The first reply's score is still there for whoever has that reply.
    scores.update_scores(runs, path, _counting(seen), metrics=METRICS)
    assert len(seen) == 2


def test_a_run_that_dies_is_repeated(spark):
    path, seen, runs = tempfile.mkdtemp(prefix="rs-table-") + "/scores", [], _runs(spark, 4)
    boom = F.raise_error(F.lit("killed")).cast("double")

    def dies(new):
        return _counting(seen)(new).withColumn("bleu", F.when(F.col("row_id") == 3, boom).otherwise(F.col("bleu")))

    with pytest.raises(Exception, match="killed"):
        scores.update_scores(runs, path, dies, metrics=METRICS)
    scores.update_scores(runs, path, _counting(seen), metrics=METRICS)
    assert scores.with_scores(runs, path).where("accuracy is not null or dataset_id = 1").count() == 8 and len(seen[1]) == 8


def test_rows_stored_twice_count_once(spark):
    path, runs = tempfile.mkdtemp(prefix="rs-table-") + "/scores", _runs(spark, 6)
    scores.update_scores(runs, path, _counting([]), metrics=METRICS)
    spark.read.parquet(path).coalesce(1).write.parquet(path + "-copy")
    spark.read.parquet(path + "-copy").write.mode("append").partitionBy("model", "mode").parquet(path)
    assert scores.with_scores(runs, path).count() == 12


def test_reports_compute_no_metric(spark):
    path, runs = tempfile.mkdtemp(prefix="rs-table-") + "/scores", _runs(spark)
    with pytest.raises(ValueError):
        scores.with_scores(runs, path)
    scores.update_scores(runs, path, _counting([]), metrics=METRICS)
    out = report.compare_runs(scores.with_scores(runs, path), metrics=METRICS)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan.lower() and "Python" not in plan and out.count() == 2


def test_catalogue_reports_share_one_table(spark):
    """The five reports score each row once together."""
    from replyscope.plans import catalog

    calls = []
    plain = catalog.score_runs
    catalog.score_runs = lambda new: calls.append(1) or plain(new)
    try:
        smoke = "/root/testdata/sf0.001/../sf0.001"  # a name of its own, so that no other test has filled the table
        for name in ("run_comparison", "scores_all", "comparison_pivot", "comparison_pivot_dataset", "run_comparison_all"):
            catalog.QUERIES[name](spark, smoke)
    finally:
        catalog.score_runs = plain
    assert len(calls) == 1


def test_each_pair_of_texts_is_scored_once(spark):
    """Equal replies of several runs: one pair for overlap and match, the same scores for all their rows, as without pairing."""
    from replyscope.sources import fixtures as fx

    rows = [(i, "m", mode, 1 + i % 2 * 2, "same reply here" if mode == "a" else f"reply {i % 2}", "3", "gold text here" if i else None, i) for i in range(12) for mode in ("a", "b")]
    runs = spark.createDataFrame(rows, "row_id long, model string, mode string, dataset_id int, reply string, req_output string, generated_req_output string, example_id long")
    pairs_seen = []

    def vectors(pairs):
        pairs_seen.append(pairs.count())
        return fx.token_vectors(pairs, keys=(scores.PAIR,))

    texts = fx.run_pairs(runs)
    logprobs = fx.token_logprobs(texts, refs=1, keys=scores.KEYS)
    once = scores.score_all(runs, vectors, logprobs, "generated_req_output")
    each = scores.score_all(runs, fx.token_vectors(texts, keys=scores.KEYS), logprobs, "generated_req_output")
    assert pairs_seen == [2]  # generation rows have even ids
    cols = [*runs.columns, *report.metric_columns("all")]
    plain = overlap.score_overlap(runs, gold="generated_req_output", keys=scores.KEYS, rouge_l=True, rouge_lsum=True)
    one, two = (sorted(map(tuple, df.select(cols).collect()), key=repr) for df in (once, each))
    assert one == two and len(one) == 24
    names = ["row_id", "mode", "bleu", "rouge_1", "rouge_2", "rouge_l", "rouge_lsum"]
    assert sorted(map(tuple, once.select(names).collect()), key=repr) == sorted(map(tuple, plain.select(names).collect()), key=repr)


ODD = ["", " ", "\n", "a", "Ab ab", "İstanbul K 9", "\U0001F600\U0001F600 x\n\n\U0001F600", "the cat\nsat on the the mat", "one two\nthree two one two\n", None]


def _odd_pairs(spark):
    rows = [(f"{i}-{j}", 1, h, r) for i, h in enumerate(ODD) for j, r in enumerate(ODD)]
    return spark.createDataFrame(rows, "row_id string, dataset_id int, reply string, gold string")


def test_a_row_counted_at_once_scores_as_exploded(spark):
    """No n-gram becomes a row, so nothing spills; the scores are the same."""
    kw = dict(gold="gold", rouge_l=True, rouge_lsum=True)
    local, exploded = (overlap.score_overlap(_odd_pairs(spark), row_local=flag, **kw) for flag in (True, False))
    assert "Generate" not in local._jdf.queryExecution().executedPlan().toString()
    assert local.columns == exploded.columns
    one, two = (sorted(map(tuple, df.collect()), key=repr) for df in (local, exploded))
    assert one == two and len(one) == 100


def test_vectors_of_a_pair_are_its_tokens(spark):
    from replyscope.sources import fixtures as fx

    pairs = _odd_pairs(spark).where("reply is not null and gold is not null")
    tokens = {}
    for r in fx.token_vectors(pairs).orderBy("row_id", "side", "pos").collect():
        tokens.setdefault((r["row_id"], r["side"]), []).extend(r["vec"])
    at_once = fx.pair_vectors(pairs)
    for r in at_once.collect():
        for side in ("reply", "gold"):
            want = tokens.get((r["row_id"], side), [])
            assert list(r[f"{side}_vecs"]) == want and r[f"{side}_n"] * 8 == len(want)
    from replyscope.operators import modelscores as ms

    rows = {r["row_id"]: tuple(r) for r in ms.score_embedding_rows(at_once).collect()}
    for r in ms.score_embedding_match(fx.token_vectors(pairs)).collect():
        assert rows[r["row_id"]] == tuple(r)


def test_log_probabilities_move_no_token(spark):
    """A row's targets are unfolded where the row is, the same values as the hash of their parts."""
    import hashlib

    from replyscope.sources import fixtures as fx

    out = fx.token_logprobs(_odd_pairs(spark), keys=("row_id",))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    unit = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:4], 16) / 65535.0 - 0.5
    got = {(r["direction"], r["ref_idx"], r["pos"]): r for r in out.where("row_id = '7-4'").collect()}
    texts = {"faithful": "the cat sat on the the mat", "precision": "the cat sat on the the mat", "recall": "ab ab"}
    assert set(got) == {(d, i, p) for d, t in texts.items() for i in (0, 1) for p in range(len(t.split()))}
    for (d, i, p), r in got.items():
        assert r["logprob"] == pytest.approx((unit(f"{d}:{i}:7-4:{p}:{texts[d].split()[p]}") - 0.5) * 8.0)
        assert r["is_pad"] == (unit(f"pad:7-4:{d}:{i}:{p}") > 0.4)


def test_targets_of_a_row_equal_their_token_rows(spark):
    """The log-probability targets and vectors of a row in one call: the scores of the token rows, rows of one key added up, and no
    token a row of the plan."""
    from replyscope.operators import modelscores as ms
    from replyscope.sources import fixtures as fx

    long = " ".join(f"w{i % 7}{'x' * (i % 90)}" for i in range(1203))
    texts = [*ODD[:-1], long, "z" * 200]
    rows = [(i, "mé", mode, a, b) for i, a in enumerate(texts) for mode, b in zip("abc", (texts[-i], None, texts[i // 2]))]
    rows += [(3, "mé", "a", "once more", "x y"), (3, None, "a", "no key", "x"), (2, "mé", "b", None, "only gold")]
    pairs = spark.createDataFrame(rows, "row_id long, model string, mode string, reply string, gold string")
    at_once = ms.loglik_f1_rows(fx.row_logprobs(pairs, keys=scores.KEYS), scores.KEYS)
    assert "Generate" not in at_once._jdf.queryExecution().executedPlan().toString()
    got = {tuple(r)[:3]: tuple(r)[3:] for r in at_once.collect()}
    want = {tuple(r)[:3]: tuple(r)[3:] for r in ms.loglik_f1(fx.token_logprobs(pairs, refs=1, keys=scores.KEYS), scores.KEYS).collect()}
    assert want.keys() <= got.keys() and all(set(got[k]) == {None} for k in got.keys() - want.keys()) and (7, "mé", "a") in want
    assert all(x == (None if y is None else pytest.approx(y, rel=1e-12)) for k, w in want.items() for x, y in zip(got[k], w))
    whole = pairs.where("reply is not null and gold is not null")
    both = [sorted(map(tuple, ms.score_embedding_rows(f(whole), ("row_id",)).collect()), key=repr) for f in (fx.row_vectors, fx.pair_vectors)]
    assert both[0] == both[1] and len(both[0]) == whole.count()


def test_md5_digits_of_many_messages():
    import hashlib

    import numpy as np

    from replyscope.functions import digits

    texts = [b"ab" * n for n in (*range(70), 500)]
    m = digits.table(len(texts), 1000)
    for i, t in enumerate(texts):
        m[i, :len(t)] = np.frombuffer(t, np.uint8)
    assert digits.md5_digits(m, np.array([len(t) for t in texts])).tolist() == [int(hashlib.md5(t).hexdigest()[:4], 16) for t in texts]
