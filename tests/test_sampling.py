"""History sampling properties: n distinct rows, never the row itself, the right pool; reproducible; independent of
partitioning; uniform over the pool."""

from collections import Counter

from pyspark.sql import functions as F

from replyscope.operators import sampling


def _df(spark, n_rows=400):
    rows = [(i, i % 7 if i % 5 else 0, "{en}" if i % 3 == 0 else "{nl}", f"t{i}") for i in range(n_rows)]
    rows.append((10_000, 99, "{en}", "lonely"))  # a writer with one row
    return spark.createDataFrame(rows, "row_id long, user_id long, nat_lang string, prompt_en string")


def _parse(h):
    return [10_000 if x == "lonely" else int(x[1:]) for x in h.split(", ")]


def test_user_pool(spark):
    df = _df(spark)
    out = sampling.sample_history(df, pool="user").collect()
    user = {r["row_id"]: r["user_id"] for r in df.collect()}
    for r in out:
        if r["row_id"] == 10_000:
            assert r["history"] is None and r["history_error"] is not None
            continue
        picked = _parse(r["history"])
        assert len(picked) == 5 and len(set(picked)) == 5
        assert r["row_id"] not in picked
        assert all(user[p] == r["user_id"] for p in picked)


def test_cohort_pool(spark):
    df = _df(spark)
    out = sampling.sample_history(df, pool="native").collect()
    native = {r["row_id"] for r in df.collect() if "en" in r["nat_lang"]}
    for r in out:
        picked = _parse(r["history"])
        assert len(set(picked)) == len(picked) == 5
        assert r["row_id"] not in picked
        assert all(p in native for p in picked)


def test_reproducible_and_partition_independent(spark):
    df = _df(spark)
    a = {r["row_id"]: r["history"] for r in sampling.sample_history(df.repartition(1), bucket_rows=10**6).collect()}
    b = {r["row_id"]: r["history"] for r in sampling.sample_history(df.repartition(9), bucket_rows=10**6).collect()}
    assert a == b
    c = {r["row_id"]: r["history"] for r in sampling.sample_history(df, seed=7).collect()}
    assert c != a


def test_uniform_draws(spark):
    """200 writers with 11 rows each, one job: row 0 of a writer should pick each of its 10 others about half of
    the time (5 of 10)."""
    rows = [(u * 100 + i, u, "{en}", f"t{u * 100 + i}") for u in range(200) for i in range(11)]
    base = spark.createDataFrame(rows, "row_id long, user_id long, nat_lang string, prompt_en string")
    out = sampling.sample_history(base).where(F.col("row_id") % 100 == 0).collect()
    counts = Counter()
    for r in out:
        for p in _parse(r["history"]):
            counts[p % 100] += 1
    freq = [counts[j] / 200 for j in range(1, 11)]
    assert all(0.3 < f < 0.7 for f in freq), freq


def test_hot_writer(spark):
    """One writer holds a third of the rows: results stay exact, and no window is keyed by the writer alone."""
    rows = [(i, 0 if i % 3 == 0 else i % 97 + 1, "{en}", f"t{i}") for i in range(1500)]
    df = spark.createDataFrame(rows, "row_id long, user_id long, nat_lang string, prompt_en string")
    out = sampling.sample_history(df)
    user = {r[0]: r[1] for r in rows}
    for r in out.collect():
        picked = _parse(r["history"])
        assert len(set(picked)) == 5 and r["row_id"] not in picked and all(user[p] == user[r["row_id"]] for p in picked)
    plan = out._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "Window [row_number()" in line:
            assert "__b" in line.split("windowspecdefinition(")[1].split(",")[1], line


def test_draws_reach_the_end_of_a_huge_pool(spark):
    """Positions of a pool of 10^11 rows: every tenth of it is drawn about as often."""
    m = 10**11
    rows = spark.range(4000).select(F.array(*sampling.floyd_draws(F.lit(m), 5, 42, F.col("id"))).alias("d"))
    tenth = Counter(r[0] for r in rows.select(F.explode("d").alias("d")).select(F.floor(F.col("d") / F.lit(m // 10))).collect())
    assert set(tenth) == set(range(10)) and all(1700 < n < 2300 for n in tenth.values()), tenth


def test_small_buckets_give_the_same_pools(spark):
    df = _df(spark)
    user = {r["row_id"]: r["user_id"] for r in df.collect()}
    for r in sampling.sample_history(df, bucket_rows=8).where("history is not null").collect():
        picked = _parse(r["history"])
        assert len(set(picked)) == 5 and r["row_id"] not in picked and all(user[p] == r["user_id"] for p in picked)


def _odd(spark):
    """Rows without a key, a writer or a text, rows that come twice, and a text for each row else."""
    rows = [(i, i % 3, "{en}" if i % 4 else "{nl}", f"t{i}") for i in range(90)]
    rows += rows[:10] + [(None, 1, "{en}", "nameless"), (200, None, "{en}", "writerless"), (201, 2, "{en}", None), (202, 50, "{nl}", "lonely")]
    return spark.createDataFrame(rows, "row_id long, user_id long, nat_lang string, prompt_en string")


def test_groups_do_not_change_the_draws(spark):
    df = _odd(spark)
    for pool in ("user", "native"):
        found = [sorted(map(str, sampling.sample_history(df, pool=pool, group_rows=g).collect())) for g in (1, 7, 10**6)]
        assert found[0] == found[1] == found[2] and len(found[0]) == df.count()


def test_rows_without_key_or_writer_and_rows_that_come_twice(spark):
    out = {}
    for r in sampling.sample_history(_odd(spark), group_rows=9).collect():
        out.setdefault(r["row_id"], []).append(r)
    for k in (None, 200, 202):
        assert [(r["history"], r["history_error"]) for r in out[k]] == [(None, "fewer than 5 other rows in the user pool")]
    for k in range(10):
        twice = Counter(out[k][0]["history"].split(", "))
        assert len(out[k]) == 2 and out[k][0] == out[k][1] and sum(twice.values()) == 10 and out[k][0]["history_error"] is None
    assert len(out[50]) == 1 and len(out[50][0]["history"].split(", ")) == 5
    assert any("nameless" in (r["history"] or "") for rs in out.values() for r in rs)


def test_a_text_moves_twice(spark):
    """Once to its key and once to each group whose rows drew it; places are found without it, and only kept columns go to a row's group."""
    df = _df(spark).withColumn("other", F.lit("x").cast("string"))
    for pool in ("user", "native"):
        out = sampling.sample_history(df, pool=pool, keep=("row_id",)).select("row_id", "history")
        plan = out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        moved = [node for node in plan.split("\n\n") if "Exchange\n" in node and ("__text" in node or "prompt_en" in node)]
        assert len(moved) == 2 and not any("other" in node for node in moved), moved


def test_texts_that_meet_at_a_text_give_the_same_rows(spark):
    df = _odd(spark)
    for pool in ("user", "native"):
        group, text = [sorted(map(str, sampling.sample_history(df, pool=pool, meet=m, home_rows=7).collect())) for m in ("group", "text")]
        assert group == text and len(group) == df.count()


def test_texts_at_their_keys_are_shuffled_once(spark):
    """With ``meet="text"`` the texts at their keys are read twice, but no cast of a key makes Spark shuffle them again."""
    out = sampling.sample_history(_df(spark), pool="native", keep=("row_id",), meet="text")
    assert "cast(__by" not in out._jdf.queryExecution().executedPlan().toString()
    out.collect()
    assert any("ReusedExchange [__by" in line for line in out._jdf.queryExecution().executedPlan().toString().splitlines())


def test_has_history_is_what_sample_history_gives(spark):
    """Pools of fewer, as many and more rows than are drawn; rows without a key, and rows with the key of a row of the pool."""
    for size in (4, 5, 6):
        rows = [(i, 1, "{en}", "a") for i in range(size)] + [(2, 1, "{nl}", "b"), (50, 1, "{nl}", "c"), (50, 1, None, "d"), (None, 1, "{nl}", "e")]
        df = spark.createDataFrame(rows, "row_id long, user_id long, nat_lang string, prompt_en string")
        given = sampling.sample_history(df, pool="native", meet="text").where("history is not null")
        told = df.where(sampling.has_history(df, "native"))
        assert sorted(given.select("prompt_en").collect()) == sorted(told.select("prompt_en").collect()), size
        assert told.count() == {4: 0, 5: 2, 6: 9}[size]


def test_a_chat_s_own_text_does_not_move(spark):
    """The rows that move to their histories take no text along."""
    from replyscope.plans.catalog import QUERIES

    plan = QUERIES["chat_history_native"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    rows = [line for line in plan.splitlines() if " AS __row#" in line and "struct(" in line]
    assert rows and not any("prompt_en" in line for line in rows), rows
