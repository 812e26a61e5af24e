import math
import random

import pytest
from pyspark.sql import functions as F

from rewardmill.functions import tokens as tk
from rewardmill.operators import groups as gr
from rewardmill.operators import losses as ls


def one(spark, schema, row, column):
    return spark.createDataFrame([row], schema).select(column.alias("x")).head()["x"]


def test_masks(spark):
    ids = F.col("ids")
    assert one(spark, "ids array<int>", ([5, 9, 0, 7, 0],), tk.completion_mask(ids, 0)) == [1, 1, 1, 0, 0]
    assert one(spark, "ids array<int>", ([5, 9, 1, 7, 3],), tk.completion_mask(ids, 0)) == [1] * 5
    assert one(spark, "ids array<int>", ([5, 9, 0],), tk.first_eos(ids, 0)) == 2
    assert one(spark, "ids array<int>", ([5, 9],), tk.first_eos(ids, 0)) == 2
    assert one(spark, "ids array<int>, n int", ([1, 2, 3], 2), tk.after_prompt_mask(ids, F.col("n"))) == [0, 0, 1]
    assert one(spark, "ids array<int>, n int", ([1, 2], 5), tk.after_prompt_mask(ids, F.col("n"))) == [0, 0]


def test_truncate_and_pad(spark):
    assert one(spark, "ids array<int>", ([1, 2, 3, 4],), tk.left_truncate(F.col("ids"), 2)) == [3, 4]
    assert one(spark, "ids array<int>", ([1],), tk.left_truncate(F.col("ids"), 2)) == [1]
    df = spark.createDataFrame([(0, [1], [2, 3]), (0, [4, 5], [6])], "b int, prompt_ids array<int>, completion_ids array<int>")
    rows = ls.pad_to_batch(df, ["b"], ["prompt_ids"], ["completion_ids"], value=9).collect()
    assert sorted((r["prompt_ids"], r["completion_ids"]) for r in rows) == [([4, 5], [6, 9]), ([9, 1], [2, 3])]


def test_divergence(spark):
    schema = "c array<double>, r array<double>"
    assert one(spark, schema, ([-1.0, -2.0], [-1.0, -2.0]), tk.token_kl(F.col("c"), F.col("r"))) == [0.0, 0.0]
    rng = random.Random(0)
    row = ([-rng.random() for _ in range(50)], [-rng.random() for _ in range(50)])
    assert min(one(spark, schema, row, tk.token_kl(F.col("c"), F.col("r")))) >= 0


def test_clipped_surrogate(spark):
    schema = "ratio array<double>, a double"
    loss = tk.clipped_surrogate(F.col("ratio"), F.col("a"))
    assert one(spark, schema, ([1.5], 1.0), loss) == pytest.approx([-1.1])
    assert one(spark, schema, ([1.5], -1.0), loss) == pytest.approx([1.5])
    assert one(spark, schema, ([0.5, 1.05], 1.0), loss) == pytest.approx([-0.5, -1.05])
    assert one(spark, schema, ([0.5], -1.0), loss) == pytest.approx([0.9])


def token_table(spark, n=24, size=12):
    rng = random.Random(2)
    rows = [
        (
            i,
            i // 4,
            [rng.choice([0, 1, 2, 3, 4, 5]) for _ in range(size)],
            [-rng.random() for _ in range(size)],
            [-rng.random() for _ in range(size)],
            rng.randint(0, size),
            float(rng.randint(0, 3)),
            rng.choice([1.0, 0.5]),
        )
        for i in range(n)
    ]
    schema = (
        "id int, minibatch_id int, completion_ids array<int>, cur_logps array<double>, ref_logps array<double>, "
        "prompt_len int, reward double, importance_weight double"
    )
    return rows, spark.createDataFrame(rows, schema)


def test_off_policy_loss_against_loops(spark):
    rows, df = token_table(spark)
    sequences = gr.with_batch_advantages(ls.off_policy_sequences(df), ["minibatch_id"])
    got = {r["minibatch_id"]: r for r in ls.off_policy_loss(sequences).collect()}
    for batch in range(6):
        part = [r for r in rows if r[1] == batch]
        base = sum(r[6] for r in part) / len(part)
        losses, kls, ratios = [], [], []
        for r in part:
            tokens = range(r[5], 12)
            ratio = [math.exp(r[3][t] - r[4][t]) for t in tokens]
            a = r[6] - base
            loss = [-min(x * a, min(max(x, 0.9), 1.1) * a) for x in ratio]
            kl = [math.exp(r[4][t] - r[3][t]) - (r[4][t] - r[3][t]) - 1 for t in tokens]
            losses.append(r[7] * sum(loss) / (len(loss) + 1e-12))
            kls.append(sum(kl) / (len(kl) + 1e-12))
            ratios += ratio
        policy, kl = sum(losses) / len(losses), sum(kls) / len(kls)
        assert got[batch]["policy_loss"] == pytest.approx(policy)
        assert got[batch]["loss"] == pytest.approx(policy + 0.04 * kl)
        assert got[batch]["avg_ratio"] == pytest.approx(sum(ratios) / len(ratios))
        assert got[batch]["clip_fraction"] == pytest.approx(sum(x > 1.1 or x < 0.9 for x in ratios) / len(ratios))
    stats = ls.mean_statistics(ls.off_policy_loss(sequences)).head()
    assert stats["n_steps"] == 6
    assert stats["loss"] == pytest.approx(sum(r["loss"] for r in got.values()) / 6)


def test_on_policy_loss_against_loops(spark):
    rows, df = token_table(spark)
    sequences = gr.with_advantages(ls.on_policy_sequences(df, 0), ["minibatch_id"])
    advantage = {r["id"]: r["advantage"] for r in sequences.collect()}
    sums, counts = [], []
    for r in rows:
        n = r[2].index(0) + 1 if 0 in r[2] else 12
        kl = [math.exp(r[4][t] - r[3][t]) - (r[4][t] - r[3][t]) - 1 for t in range(n)]
        sums.append(sum(-(advantage[r[0]] - 0.04 * k) for k in kl))
        counts.append(n)
    seq = ls.on_policy_loss(sequences).head()["loss"]
    token = ls.on_policy_loss(sequences, scale_rewards=False).head()["loss"]
    assert seq == pytest.approx(sum(s / n for s, n in zip(sums, counts)) / len(sums))
    assert token == pytest.approx(sum(sums) / sum(counts))


def test_losses_shuffle_no_token_arrays(spark):
    _, df = token_table(spark)
    sequences = ls.off_policy_sequences(df)
    assert not set(sequences.columns) & set(ls.TOKEN_COLUMNS)
