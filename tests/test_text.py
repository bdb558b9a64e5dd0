"""Hand-worked values for the string functions."""

from pyspark.sql import functions as F

from replyscope.functions import text


def ev(spark, expr, *values, schema="x string"):
    df = spark.createDataFrame([tuple(v) if isinstance(v, tuple) else (v,) for v in values], schema)
    return [r[0] for r in df.select(expr).collect()]


def test_fill_placeholder(spark):
    df = spark.createDataFrame([
        ("Q: <markprompt>[Your Prompt]</markprompt>.", "hi"),
        ("Q <markprompt>[Your Prompt]</markprompt>? ok", "hi"),
        ("Q <markprompt>[Your Prompt]</markprompt> end", "a $1 \\ b"),
        ("<markprompt>[Your Prompt]</markprompt>.", "<markprompt>[Your Prompt]</markprompt>"),
    ], "t string, p string")
    out = [r[0] for r in df.select(text.fill_placeholder("t", "p")).collect()]
    assert out[0] == "Q: hi"
    assert out[1] == "Q hi ok"
    assert out[2] == "Q a $1 \\ b end"  # replacement stays literal
    # A prompt containing the placeholder: each form is replaced in turn, as chained str.replace calls do.
    t, p = "<markprompt>[Your Prompt]</markprompt>.", "<markprompt>[Your Prompt]</markprompt>"
    py = t.replace(p + ".", p).replace(p + "?", p).replace(p, p)
    assert out[3] == py


def test_strip_tags(spark):
    assert ev(spark, text.strip_tags("x"), "a <markprompt>b</markprompt> c") == ["a b c"]


def test_unwrap_pair(spark):
    vals = ev(spark, text.unwrap_pair("x"), "('g', 'r')", '("g\'s", "r")', "plain", "('a', 'b', 'c')", None)
    # With a further ", '" only the second piece survives and its quote stays ("b'"), as split()[1] gives.
    assert vals == ["r", "r", "plain", "b'", None]


def test_digit_sum(spark):
    vals = ev(spark, text.digit_sum("x").cast("long"), "a 12 b3 4", "none", "", None)
    assert vals == [19, 0, 0, None]
    big = ev(spark, text.digit_sum("x").cast("string"), "99999999999999999999 1")
    assert big == ["100000000000000000000"]  # above 19 digits, exact in DECIMAL(38,0)
    assert ev(spark, text.digit_sum("x"), "9" * 40) == [None]  # beyond 38 digits: unknown


def test_first_digit(spark):
    assert ev(spark, text.first_digit("x"), "Option 2", "none", None) == [2, None, None]


def test_word_count(spark):
    vals = ev(spark, text.word_count("x"), "", "a", "  a  b ", "a b", "a\tb\nc", " ", None)
    assert vals == [0, 1, 2, 2, 3, 0, None]


def test_strip_ws(spark):
    assert ev(spark, text.strip_ws("x"), "  a b \n", " x　", "") == ["a b", "x", ""]


def test_rouge_tokens(spark):
    assert ev(spark, text.rouge_tokens("x"), "The cat, sat!") == [["the", "cat", "sat"]]
    assert ev(spark, text.rouge_tokens("x"), "") == [[]]


def test_char_tokens(spark):
    assert ev(spark, text.char_tokens("x"), "a😀b", "") == [["a", "😀", "b"], []]


def test_request_id(spark):
    df = spark.createDataFrame([(17, 2)], "r long, k int")
    assert df.select(text.request_id("r", "k")).first()[0] == "request-17-2"


def test_edge_cases(spark):
    # A no-break space separates words as str.split() does; non-ASCII digits are not digit runs (ASCII definition).
    assert ev(spark, text.word_count("x"), "a b", "a b c") == [2, 3]
    assert ev(spark, text.digit_sum("x").cast("long"), "٣ and 4") == [4]


def test_digit_sum_has_no_limit(spark):
    texts = ["9" * 20, "9" * 40 + " and 1", "7", "", "no digits", "0 " + "5" * 100 + " x " + "4" * 90, " ".join(["9" * 38] * 30)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    import re

    want = [str(sum(int(d) for d in re.findall(r"[0-9]+", t))) for t in texts]
    assert [r[0] for r in df.select(text.digit_sum_text("t")).collect()] == want
