"""The search for answers: one pattern and the token rules agree, and a row's gold is normalised once."""

from pyspark.sql import functions as F

from rewardmill.functions import answers as an
from rewardmill.operators import scoring as sc


def test_price_at_the_end_of_a_formula(spark):
    """An escaped dollar before the closing mark stays in the body, however the formula is found."""
    rows = [(r"The answer is $5\$$", r"5\$"), (r"The answer is $5\$$. Not $7$", r"5\$"), (r"The answer is $$5\$$$", r"5\$")]
    df = spark.createDataFrame(rows, "t string, expected string")
    got = df.select("expected", an.final_answer(F.col("t")).alias("f"), an.last_span(F.col("t")).alias("s"), an.normalise(F.lit(r"5\$")).alias("n")).collect()
    assert [r.f for r in got] == [r.expected for r in got]
    assert [r.s for r in got] == [r"5\$", "7", r"5\$"] and got[0].n == "5"


def test_one_formula_and_token_rules_agree(spark):
    """Texts with one formula, with marks besides it, and with several answer words."""
    rows = [
        ("The final answer is: $x = 5$.", "x = 5"), ("Answer $1$ or the final answer is $2$, answer $3$", "2"), ("answer: cost \\$5, so $6$", "6"),
        ("$4$ is no answer", None), ("the answers differ. ANSWER $\\frac{1}{2}$", "\\frac{1}{2}"), ("answer $ $", None), ("answer $$", None),
        ("answer \\(8\\)", "8"), ("a" * 600 + " final answer is $9$" + " b" * 300, "9"), ("answer is $1$. Then $2$", "1"), ("answer $$3$$", "3"),
    ]
    got = spark.createDataFrame(rows, "t string, expected string").select("t", "expected", an.anchored_span(F.col("t")).alias("f")).collect()
    assert [(r.t, r.f) for r in got] == [(r.t, r.expected) for r in got]


def test_plain_answers_with_blanks_and_names(spark):
    rows = [("5\n", "5"), ("x = 5", "5"), ("y=\\frac{1}{2}", "\\frac{1}{2}"), ("1 2", "12"), ("x = 1,000", "1000"), ("+4", "+4"), ("", ""), (None, None)]
    got = spark.createDataFrame(rows, "t string, expected string").select("expected", an.normalise(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [r.expected for r in got]


def test_a_gold_is_normalised_once(spark):
    df = spark.createDataFrame([("$5$", "5", "5"), ("about 7", "7", None), ("", None, None)], "solution string, gold string, latex string")
    read = sc._golds(df, "solution", "g", "l")
    assert [(r.g, r.l) for r in read.collect()] == [(r.gold, r.latex) for r in read.collect()]
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("{1,3}(?:,") == 1  # the pattern of grouped digits, the last of the rewrite rules
