"""Hand-worked accuracy rules (K1–K5) and their edge cases."""

from replyscope.operators.accuracy import accuracy


def score(spark, rows):
    df = spark.createDataFrame(rows, "dataset_id int, reply string, req_output string")
    return [r[0] for r in df.select(accuracy()).collect()]


def test_ratings(spark):
    assert score(spark, [(3, "4 out of 5", "4"), (3, "4", "4"), (3, "none", "0"), (3, "x", "bad"), (3, None, "4")]) == \
        [0, 1, 1, None, None]


def test_options(spark):
    assert score(spark, [(0, "option 2", "Option 2"), (2, "neither", "Option 1"), (0, "2 and 1", "Option 3"),
                         (2, "1", "none")]) == [1, 0, 1, None]


def test_yes_no(spark):
    assert score(spark, [(4, "I know", "No."), (5, "yes and no", "Yes."), (4, "YES", "Yes."), (5, "maybe", "No.")]) == \
        [1, None, 1, 0]


def test_choice(spark):
    assert score(spark, [(9, "A or B", "A"), (9, "B. not A", "A"), (9, "a", "A"), (9, "C: yes", "C"), (9, "B", "A")]) == \
        [None, 1, None, 1, 0]


def test_generation_rows_are_null(spark):
    assert score(spark, [(1, "x", "y"), (6, "x", "x"), (None, "x", "x")]) == [None, None, None]
