"""Bring differently shaped question/answer sets to one (prompt, solution) table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rewardmill.functions import chat
from rewardmill.registry import TARGET_LENGTH_RANGE, TrainingDataset, sft_columns


def wrap_in_math(answer: Column) -> Column:
    """``$answer$``; a missing answer stays missing."""
    return F.concat(F.lit("$"), answer.cast("string"), F.lit("$"))


def from_answer_columns(df: DataFrame) -> DataFrame:
    """Rename to ``problem`` and ``solution`` by what is present; drop ``messages``.

    ``question`` is preferred to ``prompt`` as the problem. An ``answer`` that takes
    the place of a missing ``solution`` is wrapped as math.
    """
    if "solution" not in df.columns and "answer" in df.columns:
        df = df.withColumnRenamed("answer", "solution").withColumn("solution", wrap_in_math(F.col("solution")))
    for candidate in ("question", "prompt"):
        if "problem" not in df.columns and candidate in df.columns:
            df = df.withColumnRenamed(candidate, "problem")
    return df.drop("messages")


def answer_over_derivation(df: DataFrame) -> DataFrame:
    """The final answer becomes the solution; the derivation is kept as ``solution_archive``."""
    return (
        df.withColumnRenamed("solution", "solution_archive")
        .withColumnRenamed("answer", "solution")
        .withColumn("solution", wrap_in_math(F.col("solution")))
    )


def from_messages_and_json(df: DataFrame) -> DataFrame:
    """Problem from the first message, solution from ``answer.value`` of the JSON column."""
    value = F.get_json_object(F.col("verification_info"), "$.answer.value")
    return df.select(
        *[c for c in df.columns if c not in ("messages", "verification_info", "problem", "solution")],
        F.get(F.col("messages"), F.lit(0))["content"].alias("problem"),
        wrap_in_math(value).alias("solution"),
    )


def normalise_dataset(df: DataFrame, dataset: TrainingDataset) -> DataFrame:
    """All shape rules for one named dataset. The message shape is read before ``messages`` is dropped."""
    if dataset.messages_and_json:
        return from_answer_columns(from_messages_and_json(df))
    if dataset.answer_over_derivation:
        renamed = df
        if "solution" not in df.columns:
            renamed = df.withColumn("solution", F.lit(None).cast("string"))
        return from_answer_columns(answer_over_derivation(renamed))
    return from_answer_columns(df)


def build_prompts(df: DataFrame, dataset: TrainingDataset, seed: int = 42, row_key: Sequence[str] = ()) -> DataFrame:
    """Add the chat ``prompt``; length-budget datasets also get a seeded ``target_length``.

    ``row_key`` names the columns that identify a row. It is needed only for the
    length budget, where the target must not depend on partitioning.
    """
    problem = F.col("problem")
    if not dataset.length_budget:
        return df.withColumn("prompt", chat.chat_prompt(problem, dataset.system_prompt))
    if not row_key:
        raise ValueError("a length-budget dataset needs row_key columns")
    low, high = TARGET_LENGTH_RANGE
    return with_length_budget(df, dataset.system_prompt, low, high, seed, row_key)


def with_length_budget(
    df: DataFrame, system_prompt: str, low: int, high: int, seed: int, row_key: Sequence[str]
) -> DataFrame:
    target = chat.target_length(seed, low, high, *[F.col(k) for k in row_key])
    budgeted = df.withColumn("target_length", target)
    return budgeted.withColumn(
        "prompt", chat.length_budget_prompt(F.col("problem"), system_prompt, F.col("target_length"))
    )


def prompt_and_solution(df: DataFrame, *extra: str) -> DataFrame:
    """Keep ``prompt`` and, where present, ``solution`` and the named extras."""
    return df.select(*[c for c in ("prompt", "solution", *extra) if c in df.columns])


def signature_only(df: DataFrame, enabled: bool = False) -> DataFrame:
    """Optionally keep nothing but the prompt."""
    return df.select("prompt") if enabled else df


def sft_conversations(df: DataFrame, source: str, trace_free: bool = False) -> DataFrame:
    """Add the SFT ``messages`` of a known source; trace-free shows the attempt as the thinking."""
    trajectory, attempt = sft_columns(source)
    thinking = attempt if trace_free else trajectory
    return df.withColumn(
        "messages", chat.rationale_pair(F.col("question"), F.col(thinking), F.col(attempt))
    )


def conversations_from_turns(turns: DataFrame, key: str, order: str) -> DataFrame:
    """One row per conversation from one row per turn.

    A conversation is one value of the data model, so its turns do meet in one
    task; its size is bounded by what a single cell may hold.
    """
    ordered = F.array_sort(F.collect_list(F.struct(order, "role", F.col("text").alias("content"))))
    return turns.groupBy(key).agg(
        F.transform(ordered, lambda m: chat.message(m["role"], m["content"])).alias("messages")
    )


def _has_tool_calls(df: DataFrame, messages: str) -> bool:
    element = df.schema[messages].dataType.elementType
    return "tool_calls" in element.fieldNames()


def render(
    df: DataFrame,
    template: str = "reasoning",
    messages: str = "messages",
    output: str = "text",
    bos: str = "<｜begin▁of▁sentence｜>",
    eos: str = chat.END_OF_SENTENCE,
    add_generation_prompt: bool = False,
) -> DataFrame:
    """Render conversations to text with one of the two templates."""
    column = F.col(messages)
    if template == "plain":
        text = chat.render_plain(column, eos, add_generation_prompt)
    elif template == "reasoning":
        text = chat.render_reasoning(column, bos, add_generation_prompt, _has_tool_calls(df, messages))
    else:
        raise ValueError(f"unknown template {template!r}")
    return df.withColumn(output, text)


def is_conversational(df: DataFrame, column: str = "prompt") -> bool:
    """Whether a column holds messages rather than plain text."""
    data_type = df.schema[column].dataType
    return isinstance(data_type, T.ArrayType) and isinstance(data_type.elementType, T.StructType)


def merge_prefill(df: DataFrame) -> DataFrame:
    """Turn completion text into a message, moving a prefilled assistant turn out of the prompt.

    Plain-text prompts are left as they are.
    """
    if not is_conversational(df):
        return df
    prompt, bootstrap = chat.split_prefill(F.col("prompt"))
    completion = chat.assistant_completion(bootstrap, F.col("completion"))
    others = [c for c in df.columns if c not in ("prompt", "completion")]
    return df.select(*others, prompt.alias("prompt"), completion.alias("completion"))


def with_full_conversation(df: DataFrame, output: str = "full") -> DataFrame:
    """Prompt followed by completion, for messages and for text alike."""
    return df.withColumn(output, F.concat(F.col("prompt"), F.col("completion")))
