import pytest

from rewardmill.functions import rewards as rw
from rewardmill.operators.groups import with_advantages
from rewardmill.operators.scoring import score
from rewardmill.streaming import scores as ss
from test_streaming import FILES, WEIGHTS, rollouts

REWARDS = [rw.format_tags(), rw.accuracy()]
KEEP = ["run_id", "step", "prompt_id"]


def test_groups_over_two_deliveries_are_scored_whole(spark, tmp_path):
    """Group 5 comes in two deliveries, group 2 stays short, group 6 is too large: scored and side rows are all rows."""
    files = [*FILES, [(6, "a", 130), (6, "b", 130), (6, "c", 130)]]
    stream, batch = rollouts(spark, str(tmp_path), files)

    def to(name):
        return lambda rows, number: rows.write.mode("overwrite").parquet(f"{tmp_path}/{name}/batch={number}")

    ss.score_batches(stream, REWARDS, WEIGHTS, to("out"), f"{tmp_path}/cp", generations=2, aside=to("side"), keep=KEEP).awaitTermination()
    ss.close_batches(spark, f"{tmp_path}/cp", to("side"))
    got, side = spark.read.parquet(f"{tmp_path}/out").drop("batch"), spark.read.parquet(f"{tmp_path}/side")
    full = batch.filter("prompt_id NOT IN (2, 6)")
    want = with_advantages(score(full, REWARDS, WEIGHTS, keep=KEEP), ss.GROUP_KEYS)
    assert got.count() == want.count() == 8 and got.select(*want.columns).exceptAll(want).count() == 0
    assert sorted(r.prompt_id for r in side.collect()) == [2, 6, 6, 6]


def test_a_closed_stream_goes_on_with_new_groups(spark, tmp_path):
    """Closing twice tells the same; rows given aside do not come back, and no batch takes their number."""
    stream, _ = rollouts(spark, str(tmp_path), FILES[:2])
    seen = {}

    def to(name):
        def keep(rows, number):
            seen[name, number] = sorted((r.prompt_id for r in rows.collect()))
        return keep

    def run():
        ss.score_batches(stream, REWARDS, WEIGHTS, to("out"), f"{tmp_path}/cp", generations=3, aside=to("side"), keep=KEEP).awaitTermination()

    run()
    held = sum(len(f) for f in FILES[:2]) - sum(len(v) for v in seen.values())
    before = set(seen)
    for _ in range(2):
        ss.close_batches(spark, f"{tmp_path}/cp", to("side"))
    (closing,) = set(seen) - before
    assert closing[1] < 0 and len(seen[closing]) == held > 0
    stream, _ = rollouts(spark, str(tmp_path), FILES[2:3])
    run()
    ss.close_batches(spark, f"{tmp_path}/cp", to("side"))
    assert sum(len(v) for v in seen.values()) == sum(len(f) for f in FILES[:3])


def test_a_stream_without_rows_has_nothing_to_close(spark, tmp_path):
    ss.close_batches(spark, f"{tmp_path}/never", lambda rows, number: pytest.fail("nothing was held"))


def test_batches_free_what_they_persist(spark, tmp_path):
    stream, _ = rollouts(spark, str(tmp_path), FILES)
    held = len(spark.sparkContext._jsc.getPersistentRDDs())
    for name, options in (("alone", {}), ("held", {"generations": 2, "aside": lambda rows, number: rows.count()})):
        ss.score_batches(stream, REWARDS, WEIGHTS, lambda rows, number: rows.count(), f"{tmp_path}/{name}", keep=KEEP, **options).awaitTermination()
        assert len(spark.sparkContext._jsc.getPersistentRDDs()) == held
