import pytest
from pyspark.sql import functions as F

from rewardmill.functions import rewards as rw
from rewardmill.operators.groups import with_advantages
from rewardmill.operators.scoring import score
from rewardmill.streaming import metrics as sm
from rewardmill.streaming import scores as ss
from rewardmill.streaming.closing import run_to_the_end, with_closing

SCHEMA = "run_id string, step int, process_id int, prompt_id int, completion string, solution string, ts timestamp"


def rollouts(spark, path, files):
    """Each file is one delivery of (prompt_id, text, minute) rows."""
    for number, rows in enumerate(files):
        data = [("r", p, 0, p, t, "$1$", m) for p, t, m in rows]
        df = spark.createDataFrame(data, SCHEMA.replace("ts timestamp", "m int"))
        df = df.withColumn("ts", F.timestamp_seconds(F.col("m") * 60)).drop("m")
        df.coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    return stream, spark.read.schema(SCHEMA).parquet(f"{path}/in")


FILES = [
    [(1, "\\boxed{1}", 0), (1, "no", 0), (2, "\\boxed{1}", 0)],
    [(3, "\n</think>\n", 30), (3, "\\boxed{1}", 30)],
    [(4, "later", 90), (4, "later", 90)],
    [(5, "one", 119)],
    [(5, "two", 121)],
]
REWARDS, WEIGHTS = [rw.format_tags(), rw.accuracy()], [1.0, 2.0]


def test_stream_equals_batch(spark, tmp_path):
    stream, batch = rollouts(spark, str(tmp_path), FILES)
    scored = ss.score_stream(stream, REWARDS, WEIGHTS, keep=["prompt_id"])
    ss.append_to(scored, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    want = score(batch, REWARDS, WEIGHTS, keep=["prompt_id"])
    assert got.count() == 9 and got.select(*want.columns).exceptAll(want).count() == 0
    with pytest.raises(ValueError):
        ss.score_stream(stream, [rw.length()], [1.0])


def test_groups_come_out_once_their_time_has_passed(spark, tmp_path):
    stream, _ = rollouts(spark, str(tmp_path), FILES)
    scored = ss.score_stream(stream, REWARDS, WEIGHTS, keep=["run_id", "step", "prompt_id", "ts"])
    groups = ss.completed_groups(with_closing(scored, f"{tmp_path}/end"), generations=2)
    run_to_the_end(lambda: ss.append_to(groups, f"{tmp_path}/out", f"{tmp_path}/cp"), scored, f"{tmp_path}/end")
    got = {r["prompt_id"]: (r["group_size"], r["group_mean"], r["is_complete"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {1: (2, 1.0, True), 2: (1, 2.0, False), 3: (2, 1.5, True), 4: (2, 0.0, True), 5: (2, 0.0, True)}


def test_batches_score_whole_groups(spark, tmp_path):
    stream, batch = rollouts(spark, str(tmp_path), FILES[:3])
    rewards = [rw.length(), rw.accuracy()]

    def sink(rows, number):
        rows.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")

    keep = ["run_id", "step", "prompt_id"]
    ss.score_batches(stream, rewards, WEIGHTS, sink, f"{tmp_path}/cp", keep=keep).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    want = with_advantages(score(batch, rewards, WEIGHTS, keep=keep), ss.GROUP_KEYS)
    assert got.count() == want.count() and got.select(*want.columns).exceptAll(want).count() == 0


def test_metric_windows_on_stream_and_table(spark, tmp_path):
    rows = [("r", "loss", float(i), i * 1200) for i in range(12)]
    df = spark.createDataFrame(rows, "run_id string, name string, value double, s int")
    df = df.withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    want = {(r["window_start"], r["value"]) for r in sm.windowed_means(df).collect()}
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    query = (
        sm.windowed_means(stream).writeStream.outputMode("complete").format("memory").queryName("windows")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert {(r["window_start"], r["value"]) for r in spark.table("windows").collect()} == want and len(want) == 4
