"""The rank by length of many groups at once against that of each group by itself."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from rewardmill.operators import list_rewards as lr
from rewardmill.plans.record_queries import brevity_rank


def test_many_groups_at_once():
    reward = brevity_rank()
    rng = np.random.default_rng(0)
    sizes = np.append(rng.integers(1, 12, 300), [1, 5000, 1, 2])
    rows = pd.DataFrame({"length": rng.integers(0, 9, sizes.sum())})
    ends = np.cumsum(sizes)
    each = [rows.iloc[a:b] for a, b in zip([0, *ends[:-1]], ends)]
    expected = [np.nan if x is None else x for part in each for x in reward.score(part, reward.summarise(part))]
    assert np.allclose(reward.score_groups(rows, ends), expected, rtol=0, atol=0, equal_nan=True)


def test_small_groups_are_not_scored_one_by_one(spark):
    whole = brevity_rank()

    def one_by_one(rows, summary):
        raise ValueError("a group by itself")

    reward = lr.ListReward(whole.name, one_by_one, whole.inputs, whole.summarise, whole.merge, whole.score_groups)
    df = spark.range(3000).select((F.col("id") % 700).alias("g"), "id", (F.col("id") * 7 % 11).alias("length"))
    got = {r.id: r.brevity_rank for r in lr.score_lists(df, reward, ["g"], ["id"]).collect()}
    lengths = {}
    for i in range(3000):
        lengths.setdefault(i % 700, []).append(i * 7 % 11)
    for i in range(3000):
        group = lengths[i % 700]
        assert got[i] == sum(x > i * 7 % 11 for x in group) / (len(group) - 1)
