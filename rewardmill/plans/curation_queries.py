"""Registered queries: dataset shapes, prompts, SFT pairs, templates, evaluation questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardmill.functions import chat
from rewardmill.operators import curation as cu
from rewardmill.operators import evaluation as ev
from rewardmill.plans import oracle as o
from rewardmill.plans import views as v
from rewardmill.registry import (
    BOXED_SYSTEM_PROMPT,
    CHOICE_QUERY,
    DEFAULT_SYSTEM_PROMPT,
    MATH_QUERY,
    SFT_SOURCES,
    TASKS,
    training_dataset,
)
from rewardmill.sources.datasets import Location, read_benchmark, read_sft_set, read_training_set

SEED = 42


def _at(sf_dir: str, name: str):
    """Every source id leads to one of the given tables."""
    return lambda source, config, split: Location(f"{sf_dir}/{name}.parquet")


def normalize_answer_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    dataset = training_dataset("limr")
    return _problems(spark, sf_dir, dataset)


def normalize_answer_over_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read_training_set(spark, "deepscaler", _at(sf_dir, "part")).select(
        "p_partkey",
        F.col("p_name").alias("problem"),
        F.col("p_type").alias("solution"),
        F.col("p_brand").alias("answer"),
    )
    return cu.normalise_dataset(raw, training_dataset("deepscaler"))


def normalize_messages_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.get_json_object("props", "$.k")
    info = v.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("conv_id"),
        F.concat(F.lit('{"answer":{"value":"'), value, F.lit('"}}')).alias("verification_info"),
    )
    raw = v.raw_conversations(spark, sf_dir).join(info, "conv_id")
    return cu.normalise_dataset(raw, training_dataset("2thought"))


def _problems(spark: SparkSession, sf_dir: str, dataset) -> DataFrame:
    raw = read_training_set(spark, dataset.name, _at(sf_dir, "part")).select(
        "p_partkey", F.col("p_name").alias("question"), F.col("p_brand").alias("answer")
    )
    return cu.normalise_dataset(raw, dataset)


def _build(dataset_name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        dataset = training_dataset(dataset_name)
        built = cu.build_prompts(_problems(spark, sf_dir, dataset), dataset, SEED, ["p_partkey"])
        kept = cu.prompt_and_solution(built, "p_partkey", "target_length")
        return kept.withColumn("prompt", v.messages_as_text(F.col("prompt")))

    return run


def _sft(trace_free: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        turns = read_sft_set(spark, "qwen_rationale_limo", _at(sf_dir, "conversations"))
        built = cu.sft_conversations(v.question_pairs(turns), SFT_SOURCES["qwen_rationale_limo"], trace_free)
        return cu.render(built, "plain", eos="</s>").select("conv_id", "turn", "text")

    return run


def render_plain_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = cu.render(v.raw_conversations(spark, sf_dir), "plain", eos="</s>", add_generation_prompt=True)
    return rendered.select("conv_id", "text")


def render_reasoning_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = cu.render(v.raw_conversations(spark, sf_dir), "reasoning", add_generation_prompt=True)
    return rendered.select("conv_id", "text")


def render_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in which two of three replies are tool calls and the turn after a call is the tool's output."""
    place = F.col("conv_id") + F.col("turn")
    calls = (F.col("role") == "assistant") & (place % 3 != 0)
    output = (F.col("role") == "user") & (F.col("turn") >= 2) & (place % 3 != 1)

    def call(name: str) -> Column:
        arguments = F.concat(F.lit('{"turn": '), F.col("turn").cast("string"), F.lit("}"))
        return F.struct(F.lit("function").alias("type"), F.struct(F.lit(name).alias("name"), arguments.alias("arguments")).alias("function"))

    several = F.when(F.col("conv_id") % 2 == 0, F.array(call("find"))).otherwise(F.array(call("find"), call("read")))
    message = F.struct(
        F.when(output, "tool").otherwise(F.col("role")).alias("role"),
        F.when(~calls, F.col("text")).alias("content"),
        F.when(calls, several).alias("tool_calls"),
    )
    turns = v.table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", message.alias("message")).alias("m"))
    messages = F.transform(F.sort_array(F.collect_list("m")), lambda m: m["message"])
    gathered = turns.groupBy("conv_id").agg(messages.alias("messages"))
    return cu.render(gathered, "reasoning", add_generation_prompt=True).select("conv_id", "text")


def prefill_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.raw_conversations(spark, sf_dir).select(
        "conv_id",
        F.col("messages").cast(chat.MESSAGES).alias("prompt"),
        F.concat(F.lit(" and so on for "), F.col("conv_id").cast("string")).alias("completion"),
    )
    merged = cu.with_full_conversation(cu.merge_prefill(rows))
    return merged.select(
        "conv_id",
        F.size("prompt").cast("bigint").alias("n_prompt"),
        v.messages_as_text(F.col("completion")).alias("completion"),
        v.messages_as_text(F.col("full")).alias("full_text"),
    )


def eval_math_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_benchmark(spark, "math_500", _at(sf_dir, "part")).select(
        "p_partkey", F.col("p_name").alias("problem"), F.col("p_brand").alias("solution")
    )
    docs = ev.eval_docs(rows, TASKS["math_500"], keep=["p_partkey"])
    return docs.select("p_partkey", "task_name", "query", F.col("choices")[0].alias("gold"), "gold_index")


def eval_choice_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_benchmark(spark, "gpqa:diamond", _at(sf_dir, "part")).select(
        "p_partkey",
        F.concat(F.lit("Which one? "), F.col("p_name")).alias("Question"),
        F.col("p_brand").alias("Correct Answer"),
        F.col("p_type").alias("Incorrect Answer 1"),
        F.col("p_name").alias("Incorrect Answer 2"),
        F.col("p_size").alias("Incorrect Answer 3"),
    )
    docs = ev.eval_docs(rows, TASKS["gpqa:diamond"], seed=SEED, row_key=["p_partkey"], keep=["p_partkey"])
    return docs.select("p_partkey", "task_name", "query", "gold_index")


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_HASH_BITS = "(" + " + ".join(
    f"(instr('0123456789abcdef', substr(md5('{SEED}:' || p_partkey), {i}, 1)) - 1) * {16 ** (7 - i)}"
    for i in range(1, 8)
) + ")"
_TARGET = f"(100 + {_HASH_BITS} % 3901)"


def _math_query_sql() -> str:
    before, after = MATH_QUERY.split("{Question}")
    return f"{_sql_text(before)} || p_name || {_sql_text(after)}"


def _choice_query_sql() -> str:
    parts, rest = [], CHOICE_QUERY
    for name, value in (
        ("Question", "'Which one? ' || p_name"),
        ("A", "options[1]"),
        ("B", "options[2]"),
        ("C", "options[3]"),
        ("D", "options[4]"),
    ):
        before, rest = rest.split("{" + name + "}", 1)
        parts += [_sql_text(before), value]
    return " || ".join([*parts, _sql_text(rest)])


_SFT_SQL = """
SELECT q.conv_id, q.turn,
       '<|user|>' || chr(10) || q.text || '</s>' || chr(10) || '<|assistant|>' || chr(10) ||
       'think: ' || chr(10) || {thinking} || chr(10) || ' answer: ' || a.text || '</s>' || chr(10) AS text
FROM conversations q JOIN conversations a
  ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND q.role = 'user' AND a.role = 'assistant'
"""

QUERIES = {
    "normalize_answer_dataset": normalize_answer_dataset,
    "normalize_answer_over_derivation": normalize_answer_over_derivation,
    "normalize_messages_json": normalize_messages_json,
    "build_prompts": _build("open_rs3"),
    "build_prompts_length_budget": _build("l1_exact"),
    "sft_pairs": _sft(False),
    "sft_pairs_trace_free": _sft(True),
    "render_plain_template": render_plain_template,
    "render_reasoning_template": render_reasoning_template,
    "render_tool_calls": render_tool_calls,
    "prefill_merge": prefill_merge,
    "eval_math_prompts": eval_math_prompts,
    "eval_choice_prompts": eval_choice_prompts,
}

ORACLES = {
    "normalize_answer_dataset": "SELECT p_partkey, p_name AS problem, '$' || p_brand || '$' AS solution FROM part",
    "normalize_answer_over_derivation": "SELECT p_partkey, p_name AS problem, p_type AS solution_archive, "
    "'$' || p_brand || '$' AS solution FROM part",
    "normalize_messages_json": o.with_ctes(
        """SELECT m.conv_id, m.messages[1].content AS problem,
       '$' || json_extract_string(e.props, '$.k') || '$' AS solution
FROM v_messages m JOIN events e ON e.event_id = m.conv_id""",
        o.CONVERSATIONS,
    ),
    "build_prompts": f"SELECT p_partkey, 'system=' || {_sql_text(BOXED_SYSTEM_PROMPT)} || '|user=' || p_name AS prompt, "
    "'$' || p_brand || '$' AS solution FROM part",
    "build_prompts_length_budget": f"SELECT p_partkey, CAST({_TARGET} AS INTEGER) AS target_length, "
    f"'system=' || {_sql_text(DEFAULT_SYSTEM_PROMPT)} || chr(10) || 'Think for ' || {_TARGET} || ' tokens.|user=' || p_name AS prompt, "
    "'$' || p_brand || '$' AS solution FROM part",
    "sft_pairs": _SFT_SQL.format(thinking="'because ' || lower(q.text)"),
    "sft_pairs_trace_free": _SFT_SQL.format(thinking="a.text"),
    "render_plain_template": """
SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || text || '</s>' || chr(10), '' ORDER BY turn)
                || '<|assistant|>' || chr(10) AS text
FROM conversations GROUP BY conv_id""",
    "render_reasoning_template": """
SELECT conv_id, '<｜begin▁of▁sentence｜>' || coalesce(arg_max(text, turn) FILTER (WHERE role = 'system'), '')
       || coalesce(string_agg(CASE role WHEN 'user' THEN '<｜User｜>' || text
                                        WHEN 'assistant' THEN '<｜Assistant｜>' || text || '<｜end▁of▁sentence｜>'
                                        ELSE '' END, '' ORDER BY turn), '')
       || '<｜Assistant｜>' AS text
FROM conversations GROUP BY conv_id""",
    # Each turn is written by its neighbours and by the first call and output of its conversation.
    "render_tool_calls": """
WITH t AS (
  SELECT conv_id, turn, text, conv_id % 2 = 1 AS two,
         CASE WHEN role = 'assistant' AND (conv_id + turn) % 3 <> 0 THEN 'call'
              WHEN role = 'user' AND turn >= 2 AND (conv_id + turn) % 3 <> 1 THEN 'tool' ELSE role END AS kind
  FROM conversations),
s AS (SELECT conv_id, coalesce(arg_max(text, turn), '') AS system FROM t WHERE kind = 'system' GROUP BY conv_id),
w AS (
  SELECT *, lag(kind) OVER (PARTITION BY conv_id ORDER BY turn) AS before,
         min(CASE WHEN kind = 'call' THEN turn END) OVER (PARTITION BY conv_id) AS first_call,
         min(CASE WHEN kind = 'tool' THEN turn END) OVER (PARTITION BY conv_id) AS first_output
  FROM t WHERE kind <> 'system'),
b AS (
  SELECT *, '<｜tool▁call▁begin｜>function<｜tool▁sep｜>' AS opens,
         chr(10) || '```json' || chr(10) || '{"turn": ' || turn || '}' || chr(10) || '```<｜tool▁call▁end｜>' AS closes
  FROM w),
x AS (
  SELECT conv_id, turn, kind, CASE kind
    WHEN 'user' THEN '<｜User｜>' || text
    WHEN 'assistant' THEN CASE WHEN before = 'tool' THEN '<｜tool▁outputs▁end｜>' ELSE '<｜Assistant｜>' END || text || '<｜end▁of▁sentence｜>'
    WHEN 'tool' THEN CASE WHEN turn = first_output THEN '<｜tool▁outputs▁begin｜>' ELSE chr(10) END
                     || '<｜tool▁output▁begin｜>' || text || '<｜tool▁output▁end｜>'
    ELSE CASE WHEN turn = first_call THEN '<｜Assistant｜><｜tool▁calls▁begin｜>' || opens || 'find' || closes
              ELSE chr(10) || opens || 'find' || closes || '<｜tool▁calls▁end｜><｜end▁of▁sentence｜>' END
         || CASE WHEN two THEN chr(10) || opens || 'read' || closes || '<｜tool▁calls▁end｜><｜end▁of▁sentence｜>' ELSE '' END
    END AS piece
  FROM b),
r AS (SELECT conv_id, string_agg(piece, '' ORDER BY turn) AS body, arg_max(kind, turn) AS last FROM x GROUP BY conv_id)
SELECT c.conv_id, '<｜begin▁of▁sentence｜>' || coalesce(s.system, '') || coalesce(r.body, '')
       || CASE WHEN r.last = 'tool' THEN '<｜tool▁outputs▁end｜>' ELSE '<｜Assistant｜>' END AS text
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s USING (conv_id) LEFT JOIN r USING (conv_id)""",
    "prefill_merge": o.with_ctes(
        """, v_split AS (
  SELECT conv_id, messages[-1].role = 'assistant' AS pre, len(messages) AS n,
         CASE WHEN messages[-1].role = 'assistant' THEN messages[-1].content ELSE '' END
           || ' and so on for ' || conv_id AS reply,
         CASE WHEN messages[-1].role = 'assistant' THEN messages[1:-2] ELSE messages END AS kept
  FROM v_messages)
SELECT conv_id, CASE WHEN pre THEN n - 1 ELSE n END AS n_prompt, 'assistant=' || reply AS completion,
       array_to_string(list_transform(kept, lambda m: m.role || '=' || m.content) || ['assistant=' || reply], '|') AS full_text
FROM v_split""",
        o.CONVERSATIONS,
    ),
    "eval_math_prompts": f"SELECT p_partkey, 'math_500' AS task_name, {_math_query_sql()} AS query, "
    "p_brand AS gold, 0 AS gold_index FROM part",
    "eval_choice_prompts": f"""
SELECT p_partkey, 'gpqa:diamond' AS task_name, {_choice_query_sql()} AS query, gold_index
FROM (SELECT *, [p_type, p_name, CAST(p_size AS VARCHAR)][1:gold_index] || [p_brand]
                || [p_type, p_name, CAST(p_size AS VARCHAR)][gold_index + 1:3] AS options
      FROM (SELECT *, CAST({_HASH_BITS} % 4 AS INTEGER) AS gold_index FROM part))""",
}
