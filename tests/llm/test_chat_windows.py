import random

import pytest
from pyspark.sql import functions as F

from compare import compare, connect
from rewardmill.llm import chat_queries
from rewardmill.llm import chat_windows as cw

ODD = [
    "\\### Assistant: </turn> ok", "<turn>user<says>x</turn>\n", "<\\turn>", "\\", "\\\\<says>", "", None, "<</turn>", "a\nb\\n",
    "é 😀 中", "</turn", "<turn>" * 3, "word " * 900, "x",
]


def conversations():
    r = random.Random(4)
    rows = []
    for conv in [*range(25), None]:
        n = r.randint(1, 40)
        for t in range(n):
            role = "system" if t == 0 and r.random() < 0.5 else r.choice(["user", "assistant", "assistant", "too<says>l\\", None])
            text = r.choice(ODD) if r.random() < 0.3 else " ".join(["w"] * r.randint(0, 60))
            rows.append((conv, r.choice([t, t * 300, 3]), role, text))
    rows += [(50, 0, "system", "alone")] + [(51, None, "user", "q")] * 3 + [(52, 1, "assistant", "w " * 5000)]
    return rows


def ordered(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [(role, text) for _, role, text in sorted(v, key=lambda x: (x[0], x[1].encode(), x[2].encode()))] for c, v in by.items()}


@pytest.mark.parametrize("budget,history", [(200, 50), (200, 0), (64, 20), (10**6, 100)])
def test_round_trip_budget_and_mask(spark, budget, history):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, tokens int, place string")
    windows = cw.budgeted_windows(df, budget, history)
    read = windows.select("*", cw.read_turns(F.col("text")).alias("said"), cw.read_targets(F.col("text"), F.col("loss_spans")).alias("targets"))
    by = {}
    for w in read.collect():
        by.setdefault(w.conv_id, []).append(w)
    want = ordered(rows)
    assert set(by) == set(want)
    for conv, turns in want.items():
        got, targets, seen = [], [], []
        system = turns[0] if turns[0][0] == "system" and len(turns) > 1 else None
        for w in sorted(by[conv], key=lambda w: w.window_start):
            said = [tuple(t) for t in w.said]
            assert len(said) == w.turns
            if system:
                assert said[0] == system
            repeated = said[: w.repeated]
            past = repeated[1:] if system and got else repeated
            assert past == (got[len(got) - len(past) :] if past else [])
            got += said[w.repeated :]
            targets += w.targets
            assert w.over_budget == (w.tokens > budget)
            if w.over_budget:
                assert len(said) - w.repeated - (1 if system and not w.repeated else 0) <= 1 or budget <= 64
            seen.append(w.window_start)
        assert len(set(seen)) == len(seen)
        assert got == turns
        assert targets == [t for role, t in turns if role == "assistant"]


def test_history_is_limited_and_repeated(spark):
    df = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", "w " * 6) for i in range(60)], "conv_id long, turn long, role string, text string")
    rows = cw.budgeted_windows(df, 100, 20).orderBy("window_start").collect()
    assert len(rows) > 5 and all(r.repeated == 2 for r in rows[1:]) and all(r.tokens <= 100 for r in rows)


def test_empty_and_bad_parameters(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cw.budgeted_windows(df).count() == 0
    with pytest.raises(ValueError):
        cw.budgeted_windows(df, 10, 10)


def test_no_python_in_the_plan(spark, small):
    plan = chat_queries.op1_chat_windows(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_equals_oracle(spark, small):
    for sf in (small, small.replace("0.001", "0.01")):
        name = "op1_chat_windows"
        assert compare(spark, connect(sf), sf, name, chat_queries.QUERIES[name], chat_queries.ORACLES[name]) is None
