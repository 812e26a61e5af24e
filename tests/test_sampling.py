import hashlib

import pytest
from pyspark.sql import functions as F

from rewardmill.operators import sampling as sa


def ids(spark, n):
    return spark.range(n).select(F.col("id"), (F.col("id") * 7 % 5).alias("k"))


def shuffled(n, seed=42):
    return sorted(range(n), key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


def test_shuffled_rank_is_the_seeded_order(spark):
    got = sa.shuffled_rank(ids(spark, 500), 42, ["id"]).orderBy("order_rank").collect()
    assert [r["order_rank"] for r in got] == list(range(500))
    assert [r["id"] for r in got] == shuffled(500)


def test_rank_does_not_depend_on_partitions(spark):
    a = sa.shuffled_rank(ids(spark, 500).repartition(1), 1, ["id"])
    b = sa.shuffled_rank(ids(spark, 500).repartition(13), 1, ["id"])
    assert a.exceptAll(b).count() == 0


def test_ordered_rank(spark):
    got = sa.ordered_rank(ids(spark, 777).repartition(5), ["k", "id"]).orderBy("order_rank").collect()
    assert [r["order_rank"] for r in got] == list(range(777))
    assert [(r["k"], r["id"]) for r in got] == sorted((i * 7 % 5, i) for i in range(777))


def test_repeat(spark):
    got = sa.repeat_shuffled(ids(spark, 4), 2, 3, ["id"]).orderBy("order_rank", "gen_id").collect()
    order = [r["id"] for r in got]
    assert order[0::2] == order[1::2] == shuffled(4, 3)


def test_sample(spark):
    got = [r["id"] for r in sa.sample_rows(ids(spark, 100), 10, 42, ["id"]).collect()]
    assert sorted(got) == sorted(shuffled(100)[:10])


def test_wide_columns_stay_out_of_the_ranking(spark):
    df = ids(spark, 100).withColumn("wide", F.lit("w"))
    rows = sa.sample_rows(df, 40, 42, ["id"])
    assert sorted(r["id"] for r in rows.collect()) == sorted(shuffled(100)[:40]) and "wide" in rows.columns
    plan = sa.minibatches(df, 8, 42, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "rangepartitioning" not in plan


def test_a_repeated_row_key_fails(spark):
    df = ids(spark, 20).union(ids(spark, 1)).withColumn("wide", F.lit("w"))
    with pytest.raises(Exception, match="several rows for one key"):
        sa.shuffled_rank(df, 42, ["id"]).collect()


def test_first_rows(spark):
    assert [r["id"] for r in sa.first_rows(ids(spark, 500), ["id"]).collect()] == list(range(100))
    assert sa.first_rows(ids(spark, 5), ["id"]).count() == 5


@pytest.mark.parametrize("n, shards, sizes", [(10, 3, [3, 3, 4]), (2, 3, [2]), (9, 3, [3, 3, 3])])
def test_shard_sizes(spark, n, shards, sizes):
    for sharded in (
        sa.shard_contiguous(ids(spark, n), shards, ["id"]),
        sa.shard_shuffled(ids(spark, n), shards, 42, ["id"]),
    ):
        counts = sharded.groupBy("shard").count().orderBy("shard").collect()
        assert [r["count"] for r in counts] == sizes
        assert sharded.select("id").distinct().count() == n


def test_contiguous_shards_keep_the_order(spark):
    rows = sa.shard_contiguous(ids(spark, 10), 3, ["id"]).orderBy("id").collect()
    assert [r["shard"] for r in rows] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 2]


def test_minibatches_and_schedule(spark):
    batched = sa.minibatches(ids(spark, 10), 4, 42, ["id"])
    sizes = {r["minibatch_id"]: r["count"] for r in batched.groupBy("minibatch_id").count().collect()}
    assert sizes == {0: 4, 1: 4, 2: 2}
    steps = sa.schedule_minibatches(ids(spark, 10), 4, 5, 42, ["id"])
    got = {r["step"]: r["b"] for r in steps.groupBy("step").agg(F.first("minibatch_id").alias("b")).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 0, 4: 1}
    order = lambda low, high: [r["id"] for r in steps.filter(F.col("step").between(low, high)).orderBy("step", "id").collect()]
    assert sorted(order(0, 2)) == list(range(10)) and order(0, 1) != order(3, 4)
    assert sa.schedule_minibatches(ids(spark, 10), 4, 2, 42, ["id"]).select("minibatch_id").distinct().count() == 2
    assert sa.schedule_minibatches(ids(spark, 0), 4, 2, 42, ["id"]).count() == 0


def test_process_slice(spark):
    rows = sa.process_slice(ids(spark, 12), 1, 4, ["id"]).orderBy("id").collect()
    assert [r["id"] for r in rows] == [4, 5, 6, 7]
