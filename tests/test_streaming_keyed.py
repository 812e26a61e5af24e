from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rewardmill.streaming import keyed as kd
from rewardmill.streaming.closing import run_to_the_end, with_closing

SCHEMA = "g int, x int, reward double, ts timestamp"


def deliver(spark, path, files):
    """Each file is one delivery of (group, number, reward, minute) rows; a minute of None is no time."""
    kd.use_keyed_state(spark)
    for rows in files:
        df = spark.createDataFrame(rows, "g int, x int, reward double, m double")
        df.withColumn("ts", F.timestamp_seconds(F.col("m") * 60)).drop("m").coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def run(spark, path, made, stream, closing=True):
    def start():
        writer = made.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp")
        return writer.trigger(availableNow=True).start()

    if closing:
        run_to_the_end(start, stream, f"{path}/end")
    else:
        start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


FILES = [
    [(1, 0, 1.0, 0.0), (1, 1, 2.0, 0.0), (2, 2, 5.0, 0.0)],
    [(3, 3, 1.0, 30.0)],
    [(3, 4, 3.0, 29.0), (4, 5, 0.0, 60.0), (4, 6, 1.0, 61.0), (4, 7, 9.0, 61.0)],
    [(5, 8, 1.0, 119.0), (2, 9, 7.0, 3.0), (4, 10, 4.0, 62.0), (None, 11, 8.0, 119.0), (6, 12, None, 119.0)],
    [(5, 13, 4.0, 125.0), (7, 14, 2.0, None), (6, 15, 6.0, 119.0)],
    [(1, 16, 6.0, 300.0), (1, 17, 8.0, 300.0)],
]


def test_every_row_comes_out_once(spark, tmp_path):
    """Out of order over six micro-batches: full groups at once, short ones at their timer, late ones and later ones aside."""
    stream = deliver(spark, str(tmp_path), FILES)
    groups = kd.settled_groups(with_closing(stream, f"{tmp_path}/end"), 2, ["g"], ["x"], wait="10 minutes")
    got = {r.x: (r.outcome, r.group_size, r.group_mean) for r in run(spark, tmp_path, groups, stream).collect()}
    assert got == {
        0: ("complete", 2, 1.5), 1: ("complete", 2, 1.5), 2: ("short", 1, 5.0), 3: ("complete", 2, 2.0), 4: ("complete", 2, 2.0),
        5: ("complete", 2, 0.5), 6: ("complete", 2, 0.5), 7: ("extra", 1, 9.0), 8: ("complete", 2, 2.5), 9: ("late", 1, 7.0), 10: ("extra", 1, 4.0),
        11: ("short", 1, 8.0), 12: ("complete", 2, 6.0), 13: ("complete", 2, 2.5), 14: ("late", 1, 2.0), 15: ("complete", 2, 6.0),
        16: ("complete", 2, 7.0), 17: ("complete", 2, 7.0),
    }


def test_full_groups_do_not_wait(spark, tmp_path):
    """Without a closing row and without any later event a full group is out; a short one is not."""
    stream = deliver(spark, str(tmp_path), FILES[:3])
    got = run(spark, tmp_path, kd.settled_groups(stream, 2, ["g"], ["x"]), stream, closing=False).collect()
    assert {r.x for r in got if r.outcome == "complete"} == {0, 1, 3, 4, 5, 6}


@pytest.mark.parametrize("closing", [True, False])
def test_empty_stream(spark, tmp_path, closing):
    kd.use_keyed_state(spark)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    groups = kd.settled_groups(with_closing(stream, f"{tmp_path}/end"), 2, ["g"], ["x"])
    assert run(spark, tmp_path, groups, stream, closing).count() == 0


def test_windows_and_late_rows_are_the_batch_result(spark, tmp_path):
    files = [
        [(1, 0, 1.0, 5.0), (1, 1, 3.0, 50.0), (2, 2, None, 10.0)],
        [(1, 3, 5.0, 130.0), (1, 4, 2.0, 20.0)],
        [(1, 5, 8.0, 15.0), (1, 6, 4.0, 131.0), (2, 7, 6.0, 59.0)],
        [(1, 8, 9.0, 600.0)],
    ]
    stream = deliver(spark, str(tmp_path), files)
    named = lambda df: df.select(F.col("g").alias("run_id"), F.lit("loss").alias("name"), "ts", F.col("reward").alias("value"))
    metrics = named(stream)
    out = run(spark, tmp_path, kd.settled_windows(with_closing(metrics, f"{tmp_path}/end")), metrics)
    late = {(r.run_id, r.value) for r in out.filter("outcome = 'late'").collect()}
    assert late == {(1, 8.0), (2, 6.0)}
    merged = out.groupBy("run_id", "window_start").agg(F.sum(F.col("value") * F.col("n_values")).alias("total"), F.sum("n_values").alias("n"))
    batch = named(spark.read.schema(SCHEMA).parquet(f"{tmp_path}/in"))
    want = batch.groupBy("run_id", F.date_trunc("hour", "ts").alias("window_start")).agg(F.sum("value").alias("total"), F.count("value").alias("n"))
    assert merged.exceptAll(want).count() == 0 and merged.count() == want.count()


def test_windows_of_many_runs_take_few_groups(spark, tmp_path, monkeypatch):
    """State is kept for lanes of a window, in parts of bounded size: sums of several batches and null keys are merged, and groups do not grow with the runs."""
    monkeypatch.setattr(kd, "KEYS_PER_PART", 7)
    files = [[(g if g % 50 else None, n, float(g + n), 5.0) for g in range(300)] for n in range(2)]
    stream = deliver(spark, str(tmp_path), files)
    named = lambda df: df.select(F.col("g").alias("run_id"), F.when(F.col("g") % 3 > 0, "loss").alias("name"), "ts", F.col("reward").alias("value"))
    metrics = named(stream)
    counted = []
    made = kd.settled_windows(with_closing(metrics, f"{tmp_path}/end"), lanes=4)

    def start():
        query = made.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        counted.append(query)
        return query

    run_to_the_end(start, metrics, f"{tmp_path}/end")
    held = [p["stateOperators"][0]["numRowsTotal"] for query in counted for p in query.recentProgress if p["stateOperators"]]
    # A lane has its parts and what its timer needs, and there are four of them.
    assert max(held) < 300
    out = spark.read.parquet(f"{tmp_path}/out")
    assert {r.outcome for r in out.collect()} == {"window"}
    batch = named(spark.read.schema(SCHEMA).parquet(f"{tmp_path}/in"))
    want = batch.groupBy("run_id", "name").agg(F.avg("value").alias("value"), F.count("value").alias("n_values"))
    got = out.select("run_id", "name", "value", "n_values")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_open_groups_of_the_query_do_not_lie_in_the_heap(spark, small, monkeypatch):
    """Whatever store the session had, the state of the completed groups is written as that of a store on disk, in bounded memory."""
    from rewardmill.plans import stream_queries as sq

    monkeypatch.setattr(sq, "scratch_path", lambda session, name, make=sq.scratch_path: made.setdefault(name, make(session, name)))
    made = {}
    store = spark.conf.get(kd._STORE_KEY)
    spark.conf.unset(kd._STORE_KEY)
    try:
        got = sq.stream_completed_groups(spark, small)
        orders = spark.read.parquet(f"{small}/lineitem.parquet").select("l_orderkey").distinct().count()
        assert got.count() == orders
        files = {f.suffix for f in Path(made["offsets"].removeprefix("file:")).glob("state/0/*/*")}
        assert ".delta" not in files and files & {".zip", ".changelog"}
        assert spark.conf.get(kd._BOUNDED_KEY) == "true"
    finally:
        spark.conf.set(kd._STORE_KEY, store)
