import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from replyscope.operators import timing


def test_cap_and_first_row(spark):
    t0 = dt.datetime(2024, 1, 1, 12, 0, 0)
    rows = [(1, 7, t0), (2, 7, t0 + dt.timedelta(minutes=3)), (3, 7, t0 + dt.timedelta(minutes=13)),
            (4, 8, t0), (5, 8, t0 + dt.timedelta(minutes=10)), (6, None, t0), (7, 8, None)]
    df = spark.createDataFrame(rows, "row_id long, user_id long, time timestamp")
    out = {r["row_id"]: r[timing.GAP] for r in timing.gap_to_previous(df).collect()}
    assert out == {1: 600.0, 2: 180.0, 3: 600.0, 4: 600.0, 5: 600.0, 6: 600.0, 7: 600.0}


def test_two_phase_equals_plain_window(spark):
    random.seed(7)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(3000):
        u = 0 if i % 3 else random.randint(1, 20)  # user 0 holds two thirds of the rows
        rows.append((i, u, t0 + dt.timedelta(seconds=random.randint(0, 5 * 24 * 3600))))
    rows.append((99999, 0, rows[5][2]))  # tie in time: broken by row id
    df = spark.createDataFrame(rows, "row_id long, user_id long, time timestamp")
    got = {r["row_id"]: r[timing.GAP] for r in timing.gap_to_previous(df).collect()}
    by_user = {}
    for rid, u, t in rows:
        by_user.setdefault(u, []).append((t, rid))
    want = {}
    for u, lst in by_user.items():
        lst.sort()
        prev = None
        for t, rid in lst:
            gap = (t - prev).total_seconds() if prev is not None else None
            want[rid] = gap if gap is not None and gap < 600 else 600.0
            prev = t
    assert got == pytest.approx(want)


def test_time_statistics(spark):
    df = spark.createDataFrame([(0, 1, "a", 10.0), (0, 1, "a", 20.0), (0, 2, "a", 60.0), (1, 3, "b", 5.0)],
                               "set_id int, user_id long, c string, gap_seconds double")
    mean = {r["set_id"]: r["mean_gap_seconds"] for r in timing.mean_gap(df, ["set_id", "c"]).collect()}
    total = {r["set_id"]: r["mean_total_seconds"] for r in timing.total_time(df, ["set_id", "c"]).collect()}
    assert mean == {0: 30.0, 1: 5.0} and total == {0: 45.0, 1: 5.0}


def test_rows_without_writer_or_time_stay_out_of_the_windows(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, "2024-01-01 00:00:10"), (3, 7, None), (4, 7, "2024-01-01 00:00:00"), (5, 7, "2024-01-01 00:01:00")],
                               "row_id long, user_id long, t string").withColumn("time", F.to_timestamp("t")).drop("t")
    out = timing.gap_to_previous(df)
    assert {r["row_id"]: r[timing.GAP] for r in out.collect()} == {1: 600.0, 2: 600.0, 3: 600.0, 4: 600.0, 5: 60.0}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    windowed = plan[plan.index("Window"):]
    assert "isnotnull(user_id" in windowed and "isnotnull(cast(t" in windowed
