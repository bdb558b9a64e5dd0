from pyspark.sql import functions as F

from replyscope.operators import cohorts


def test_guess_labels(spark):
    df = spark.createDataFrame([("a non-native writer",), ("a native one",), ("non-native, not a native",),
                                ("Native",), ("non native",), (None,)], "g string")
    out = [r[0] for r in df.select(cohorts.guess_label("g")).collect()]
    assert out == ["non_native", "native", "unknown", "unknown", "native", "unknown"]


def test_label_cohorts(spark):
    df = spark.createDataFrame([(1, 7, "{en}"), (2, 8, "{ben}"), (3, 9, "{nl}"), (4, None, None)],
                               "row_id long, user_id long, nat_lang string")
    members = spark.createDataFrame([(7, "western"), (7, "student"), (9, "african")], "user_id long, cohort string")
    out = {r["row_id"]: r for r in cohorts.label_cohorts(df, members).collect()}
    assert out[1]["native_or_not"] == "native" and out[1]["strict_native_or_not"] == "strict native"
    assert out[2]["native_or_not"] == "native"  # substring test, as the original
    assert out[3]["native_or_not"] == "non_native" and out[3]["african_or_not"] == "african"
    assert out[1]["western_native_or_not"] == "western native" and out[1]["student_or_not"] == "student"
    assert out[4]["native_or_not"] == "non_native" and out[4]["student_or_not"] == "not student"
