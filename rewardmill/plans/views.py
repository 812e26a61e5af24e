"""Input tables of the registered queries, derived from the given tables.

The given tables hold no rollouts, log-probabilities or predictions, so these
are formed from whole tables by plain projections and equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardmill.operators.curation import conversations_from_turns
from rewardmill.session import compiled_parts

ROLLOUT_KEY = ("prompt_id", "part_key", "supp_key", "line_no")
EVAL_KEY = ("doc", "part_key", "supp_key", "seed")
EOS = 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal rows out to ``partitions`` tasks (``tasks_for`` by default) ahead of costly per-row work.

    The given tables are single files of one row group, which one task would read
    and score alone. Call it only for such tables; a stream is left as it is.
    """
    if df.isStreaming:
        return df
    return df.repartition(partitions or tasks_for(df))


def tasks_for(source: DataFrame) -> int:
    """Tasks for costly work on the rows of a table as it is read: several for each core, and more the larger its files are.

    Rows kept for two readers are computed once only if the second reader comes to a part after the first has
    finished it; with one part for each core it would compute again what other executors are at.
    """
    compiled_parts(source.sparkSession)
    return 4 * max(source.sparkSession.sparkContext.defaultParallelism, source.rdd.getNumPartitions())


def rounded(*columns: str, places: int = 6) -> list[Column]:
    """Doubles as they are compared: rounded, and without negative zero."""
    return [(F.round(F.col(c), places) + F.lit(0.0)).alias(c) for c in columns]


def rollouts(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    """Every line of every order as a completion; the order is the prompt.

    Answers come boxed, as a final-answer phrase or not at all, and as integer,
    fraction, decimal or equation; some golds are empty, some are bare numbers.
    ``lineitem`` may be a stream.
    """
    lines = spread(table(spark, sf_dir, "lineitem") if lineitem is None else lineitem)
    bench = table(spark, sf_dir, "benchmark")
    n_items = bench.count()
    joined = lines.join(bench, F.pmod(F.col("l_partkey"), F.lit(n_items)) == F.col("item_id"))

    gold = (F.pmod("l_orderkey", F.lit(50)) + 1).cast("string")
    right = F.col("l_discount") < 0.05
    value = F.when(right, F.pmod("l_orderkey", F.lit(50)) + 1).otherwise(F.col("l_quantity").cast("bigint"))
    form = F.pmod("l_partkey", F.lit(4))
    answer = (
        F.when(form == 0, value.cast("string"))
        .when(form == 1, F.concat(F.lit("\\frac{"), (value * 2).cast("string"), F.lit("}{2}")))
        .when(form == 2, F.concat(value.cast("string"), F.lit(".0")))
        .otherwise(F.concat(F.lit("x = "), value.cast("string")))
    )
    ending = (
        F.when(F.col("l_tax") < 0.005, F.lit("<answer>none</answer>"))
        .when(F.col("l_tax") > 0.065, F.concat(F.lit("The final answer is: $"), answer, F.lit("$.")))
        .otherwise(F.concat(F.lit("<answer>$\\boxed{"), answer, F.lit("}$</answer>")))
    )
    completion = F.concat(
        F.when(F.col("l_linenumber") % 2 == 0, F.lit("<think>\n")).otherwise(F.lit("")),
        F.lit("Step 1: "),
        F.expr("repeat(concat(text, ' '), l_linenumber % 3 + 1)"),
        F.when(F.col("l_returnflag") == "R", F.lit("\n- First, check\n* Next, verify")).otherwise(F.lit("")),
        F.when(F.col("l_linestatus") == "F", F.lit("\n</think>\n")).otherwise(F.lit("")),
        ending,
    )
    kind = F.pmod("l_orderkey", F.lit(50))
    solution = (
        F.when(kind == 0, F.lit("")).when(kind == 1, gold).otherwise(F.concat(F.lit("$"), gold, F.lit("$")))
    )
    return joined.select(
        F.col("l_orderkey").alias("prompt_id"),
        F.col("l_partkey").alias("part_key"),
        F.col("l_suppkey").alias("supp_key"),
        F.col("l_linenumber").alias("line_no"),
        F.lit("r0").alias("run_id"),
        F.expr("l_orderkey div 64").alias("step"),
        F.pmod("l_orderkey", F.lit(2)).alias("process_id"),
        F.pmod("l_suppkey", F.lit(3)).alias("worker_id"),
        (F.lit(100) + F.pmod("l_partkey", F.lit(3901))).alias("target_length"),
        (F.col("l_extendedprice") / 10000.0).alias("model_score"),
        completion.alias("completion"),
        solution.alias("solution"),
    )


def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as the log-probabilities of one sequence; its neighbour is the reference."""
    vectors = table(spark, sf_dir, "embeddings")
    n = vectors.count()
    reference = vectors.select(
        F.pmod(F.col("vec_id") - 1, F.lit(n)).alias("vec_id"), F.col("embedding").alias("ref")
    )
    ids = F.transform(F.col("embedding"), lambda x: F.floor(F.abs(x.cast("double")) * 1000).cast("int"))
    return vectors.join(reference, "vec_id").select(
        "vec_id",
        F.expr("vec_id div 8").alias("minibatch_id"),
        F.expr("vec_id div 64").alias("step"),
        F.transform("embedding", lambda x: -F.abs(x.cast("double"))).alias("cur_logps"),
        F.transform("ref", lambda x: -F.abs(x.cast("double"))).alias("ref_logps"),
        F.transform(ids, lambda i: F.when(i % 17 == 0, F.lit(EOS)).otherwise(i)).alias("completion_ids"),
        (F.pmod("vec_id", F.lit(16)) + 4).cast("int").alias("prompt_len"),
        F.col("label").cast("double").alias("reward"),
        F.lit(1.0).alias("importance_weight"),
    )


def metrics(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Every event as a logged metric value. ``events`` may be a stream."""
    rows = table(spark, sf_dir, "events") if events is None else events
    return rows.select(
        F.col("user_id").alias("run_id"),
        F.col("event_type").alias("name"),
        "value",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("step"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line joined to its part as a benchmark prediction of one model, task and seed."""
    lines = spread(table(spark, sf_dir, "lineitem"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    q = F.col("l_quantity").cast("bigint")
    half = (q.cast("double") / F.lit(2.0)).cast("string")
    letter = F.expr("substr('ABCD', cast(l_partkey % 4 as int) + 1, 1)")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat_ws("/", "l_returnflag", "l_linestatus").alias("model"),
        F.col("l_returnflag").alias("base"),
        F.col("l_linestatus").alias("checkpoint"),
        F.col("p_type").alias("task"),
        F.col("l_linenumber").alias("seed"),
        F.col("l_orderkey").alias("doc"),
        F.col("l_partkey").alias("part_key"),
        F.col("l_suppkey").alias("supp_key"),
        F.concat(F.lit("$\\frac{"), q.cast("string"), F.lit("}{2}$")).alias("gold"),
        F.pmod("l_suppkey", F.lit(4)).cast("int").alias("gold_index"),
        F.when(F.col("l_discount") < 0.05, F.concat(F.lit("answer $\\boxed{"), half, F.lit("}$")))
        .otherwise(F.concat(F.lit("Answer: "), letter))
        .alias("prediction"),
    )


def raw_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation with its messages in turn order."""
    return conversations_from_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn")


def question_pairs(turns: DataFrame) -> DataFrame:
    """Every user turn with the assistant turn that follows it."""
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    replied = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return asked.join(replied, ["conv_id", "turn"]).withColumn(
        "solution", F.concat(F.lit("because "), F.lower("question"))
    )


def messages_as_text(messages: Column) -> Column:
    """Messages as one string, for comparison across engines."""
    return F.array_join(
        F.transform(messages, lambda m: F.concat(m["role"], F.lit("="), F.coalesce(m["content"], F.lit("")))), "|"
    )
