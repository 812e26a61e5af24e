"""Registered queries whose right result is known from the columns that built their input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardmill.functions import answers as an
from rewardmill.functions import tokens as tk
from rewardmill.operators import curation as cu
from rewardmill.operators import scoring as sc
from rewardmill.operators import workers as wk
from rewardmill.plans import oracle as o
from rewardmill.plans import views as v
from rewardmill.registry import training_dataset

KEY = list(v.ROLLOUT_KEY)


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _forms(value: Column, depth: Column) -> tuple[Column, Column]:
    """The gold's and the answer's way to write a value, by ``l_partkey % 8``."""
    s = value.cast("string")
    digit = F.pmod(value, F.lit(9)).cast("string")
    padded = F.lpad(s, 3, "0")
    gold = [
        _text(s, "^{2}"), _text(s, "\\frac{1}{2}"), _text("\\frac{", s, "\\pi}{2}"), _text("\\frac{\\sqrt{", s, "}}{2}"),
        _text(s, "\\times10^{-3}"), _text("10000000000000", padded), _text("\\frac", digit, "2"),
        _text(F.repeat(F.lit("\\sqrt{1+"), depth), s, F.repeat(F.lit("}"), depth)),
    ]
    answer = [
        (value * value).cast("string"), _text(s, ".5"), _text("\\frac{", s, "}{2}\\pi"), _text("\\frac{1}{2}\\sqrt{", s, "}"),
        _text("0.", padded), _text("010000000000000", padded, ".0"), _text("\\frac{", digit, "}2"), gold[7],
    ]

    def pick(forms: list[Column]) -> Column:
        form = F.pmod("l_partkey", F.lit(8))
        chosen = forms[7]
        for n in range(7):
            chosen = F.when(form == n, forms[n]).otherwise(chosen)
        return chosen

    return pick(gold), pick(answer)


def answer_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golds and answers that write one value in two ways, nested and far from the answer word."""
    lines = v.spread(v.table(spark, sf_dir, "lineitem"))
    value = F.pmod("l_orderkey", F.lit(50)) + 1
    wrong = F.when(F.col("l_discount") < 0.05, 0).otherwise(1)
    depth = (F.col("l_linenumber") * 3).cast("int")
    gold, _ = _forms(value, depth)
    _, answer = _forms(value + wrong, depth)
    far = F.concat(
        F.repeat(F.lit(" so"), (F.col("l_quantity") * 10).cast("int")),
        # Commands, a price and other formulas on the way to the value.
        F.when(F.col("l_suppkey") % 3 == 0, ", since \\frac12 of $x=3$ is small,").when(F.col("l_suppkey") % 3 == 1, " costs \\$5 and so").otherwise(""),
    )
    said = F.when(F.col("l_linenumber") % 2 == 0, _text("The answer", far, " $", answer, "$")).otherwise(
        _text("We get \\boxed{", answer, "} and \\boxed{cut off {")
    )
    rows = lines.select(
        F.col("l_orderkey").alias("prompt_id"), F.col("l_partkey").alias("part_key"), F.col("l_suppkey").alias("supp_key"),
        F.col("l_linenumber").alias("line_no"), said.alias("completion"), _text("$", gold, "$").alias("solution"),
    )
    read = sc.with_answers(rows)
    return read.select(*KEY, an.same_answer(F.col("gold"), F.col("answer")).alias("correct"))


def flatten_with_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List-valued responses of one order to one row per completion, rewards along."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_discount")
    lists = v.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    name = lambda x: F.concat_ws("/", *[x[c].cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey")])
    responses = lists.select(
        F.col("l_orderkey").alias("prompt_id"),
        F.transform("lines", name).alias("completions"),
        F.transform("lines", lambda x: x["l_discount"]).alias("rewards"),
    )
    return wk.flatten_completions(responses).select("prompt_id", "completion", *v.rounded("reward"))


def attention_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask of a left-padded prompt joined with the completion's."""
    mask = tk.attention_mask(F.col("prompt_len"), F.lit(20), F.col("completion_ids"), v.EOS)
    return v.token_rows(spark, sf_dir).select("vec_id", F.array_join(mask, ",").alias("mask"))


def weighted_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged responses whose importance weight is a column's."""
    orders = v.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("prompt"), F.col("o_orderpriority").alias("completion"),
        F.col("o_totalprice").alias("reward"), F.pmod("o_custkey", F.lit(3)).alias("worker_id"),
    )
    weight = lambda: F.col("reward") / (F.col("worker_id") + 1)
    return wk.aggregated_set(orders, weight).select("prompt", "completion", *v.rounded("reward", "importance_weight"), "worker_id")


def prompt_column_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset with ``prompt`` and no ``question``; only the prompt is kept in the end."""
    part = v.table(spark, sf_dir, "part").select(F.col("p_name").alias("prompt"), F.col("p_brand").alias("answer"))
    dataset = training_dataset("limr")
    built = cu.build_prompts(cu.normalise_dataset(part, dataset), dataset)
    kept = cu.signature_only(built, enabled=True)
    return kept.select(F.element_at("prompt", -1)["content"].alias("problem"))


QUERIES = {
    "answer_forms": answer_forms,
    "flatten_with_rewards": flatten_with_rewards,
    "attention_mask": attention_mask,
    "weighted_set": weighted_set,
    "prompt_column_dataset": prompt_column_dataset,
}

ORACLES = {
    # Right by construction: a wrong answer writes the next value.
    "answer_forms": "SELECT l_orderkey AS prompt_id, l_partkey AS part_key, l_suppkey AS supp_key, l_linenumber AS line_no, "
    "l_discount < 0.05::DOUBLE AS correct FROM lineitem",
    "flatten_with_rewards": "SELECT l_orderkey AS prompt_id, l_linenumber || '/' || l_partkey || '/' || l_suppkey AS completion, "
    f"{o.r('l_discount', 'reward')} FROM lineitem",
    "attention_mask": o.with_ctes(
        """SELECT vec_id, repeat('0,', 20 - prompt_len) || repeat('1,', prompt_len) || repeat('1,', CAST(n_tokens AS INTEGER) - 1) || '1'
  || repeat(',0', CAST(size - n_tokens AS INTEGER)) AS mask FROM v_masked""",
        o.TOKENS,
    ),
    "weighted_set": f"SELECT CAST(o_orderkey AS VARCHAR) AS prompt, o_orderpriority AS completion, {o.r('o_totalprice', 'reward')}, "
    f"{o.r('o_totalprice / (o_custkey % 3 + 1)', 'importance_weight')}, o_custkey % 3 AS worker_id FROM orders",
    "prompt_column_dataset": "SELECT p_name AS problem FROM part",
}
