"""Step markers are counted by Arrow, and a solution's only formula is found without a walk over its tokens."""

from pyspark.sql import functions as F

from rewardmill.functions import answers as an
from rewardmill.functions import rewards as rw


def test_markers_of_odd_texts(spark):
    cases = {
        None: 0, "": 0, "1. a": 1, "\n1. a": 0, "12.": 1, "a 1. b": 0, "1.\n- b\n* c": 3, "First,Second,Next,Finally,": 4, "First;\n+": 0,
        "Step 1:Step 22: Step x: Step 3": 2, "١. Step ٢:": 2, "\n\n-\n-": 2, "1. 2. 3.": 1,
    }
    df = spark.createDataFrame(list(cases.items()), "t string, n int")
    assert [(r.t, r.n) for r in df.select("t", "n", rw.step_markers(F.col("t")).alias("x")).collect() if r.x != r.n] == []


def test_text_is_handed_over_once(spark):
    rows = spark.createDataFrame([("Step 1: a a a a",)], "t string")
    both = rows.select(rw.step_markers(F.col("t")).alias("s"), rw.repetition_of(F.col("t")).alias("r"))
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert [tuple(r) for r in both.collect()] == [(1, -0.25)]


def test_only_formula(spark):
    texts = ["$12$", "so $ x $ then", "$ $", "$$", "$$5$$", "the answer is $3$.", "answer. no $4$", "$1$ and $2$", r"\$5 and $6$", "5", None, "a\n$7$\n", r"\(8\) $9$", "answer $1$. $2$"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    walk = F.coalesce(an.anchored_span(F.col("t")), an.last_span(F.col("t")))
    assert [tuple(r) for r in df.select("t", an.latex_gold(F.col("t")).alias("a"), walk.alias("b")).collect() if r.a != r.b] == []
    first = df.select("t", an.latex_gold(F.col("t")).alias("g")).collect()
    assert [r.g for r in first][:3] == ["12", "x", None]
