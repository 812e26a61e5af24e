"""Conversations as arrays of ``{role, content}`` and their text renderings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rewardmill.functions.text import let, seeded_int

MESSAGES = "array<struct<role:string,content:string>>"

# Marker strings of the two chat templates.
PLAIN_ROLES = ("user", "system", "assistant")
USER = "<｜User｜>"
ASSISTANT = "<｜Assistant｜>"
END_OF_SENTENCE = "<｜end▁of▁sentence｜>"
TOOL_CALLS_BEGIN = "<｜tool▁calls▁begin｜>"
TOOL_CALLS_END = "<｜tool▁calls▁end｜>"
TOOL_CALL_BEGIN = "<｜tool▁call▁begin｜>"
TOOL_CALL_END = "<｜tool▁call▁end｜>"
TOOL_SEPARATOR = "<｜tool▁sep｜>"
TOOL_OUTPUTS_BEGIN = "<｜tool▁outputs▁begin｜>"
TOOL_OUTPUTS_END = "<｜tool▁outputs▁end｜>"
TOOL_OUTPUT_BEGIN = "<｜tool▁output▁begin｜>"
TOOL_OUTPUT_END = "<｜tool▁output▁end｜>"


def message(role: str | Column, content: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), content.alias("content"))


def content_of(message_column: Column) -> Column:
    return message_column.getField("content")


def chat_prompt(problem: Column, system_prompt: str) -> Column:
    return F.array(message("system", F.lit(system_prompt)), message("user", problem)).cast(MESSAGES)


def target_length(seed: int, low: int, high: int, *row_key: Column) -> Column:
    return seeded_int(seed, low, high, *row_key)


def length_budget_prompt(problem: Column, system_prompt: str, target: Column) -> Column:
    budget = F.concat(F.lit(system_prompt + "\nThink for "), target.cast("string"), F.lit(" tokens."))
    return F.array(message("system", budget), message("user", problem)).cast(MESSAGES)


def rationale_pair(question: Column, trajectory: Column, attempt: Column) -> Column:
    """User question and assistant answer with its thinking written out."""
    reply = F.concat(F.lit("think: \n"), trajectory, F.lit("\n answer: "), attempt)
    return F.array(message("user", question), message("assistant", reply)).cast(MESSAGES)


def render_plain(messages: Column, eos: str, add_generation_prompt: bool = False) -> Column:
    """One tagged block per message; roles other than the three known ones are left out."""
    def block(m: Column) -> Column:
        return F.concat(
            F.lit("<|"), m["role"], F.lit("|>\n"), F.coalesce(m["content"], F.lit("")), F.lit(eos + "\n")
        )

    known = F.filter(messages, lambda m: m["role"].isin(*PLAIN_ROLES))
    text = F.array_join(F.transform(known, block), "")
    return F.concat(text, F.lit("<|assistant|>\n")) if add_generation_prompt else text


def render_reasoning(
    messages: Column, bos: str, add_generation_prompt: bool = False, tool_calls: bool = False
) -> Column:
    """The reasoning template: the last system message first, then the turns.

    Whether a turn opens a tool block depends only on its position: on the role
    before it, on the first tool message and on the first tool call. So one
    ``transform`` by index is enough. Two quirks of the template are kept: the
    call list is closed only from the second call on, and "first call" is never
    reset within a conversation. ``tool_calls`` says whether messages have that field.
    """
    systems = F.filter(messages, lambda m: m["role"] == "system")
    system_text = F.coalesce(F.try_element_at(systems, F.lit(-1))["content"], F.lit(""))
    turns = F.filter(messages, lambda m: m["role"].isin("user", "assistant", "tool"))
    body = let(turns, lambda ts: _reasoning_turns(ts, add_generation_prompt, tool_calls))
    return F.concat(F.lit(bos), system_text, body)


def _reasoning_turns(turns: Column, add_generation_prompt: bool, tool_calls: bool) -> Column:
    def has_calls(m: Column) -> Column:
        return (m["role"] == "assistant") & m["content"].isNull() & (F.size(m["tool_calls"]) > 0)

    def first_index(of: Column) -> Column:
        return F.array_position(of, True) - 1

    first_output = first_index(F.transform(turns, lambda m: m["role"] == "tool"))
    first_calls = (
        first_index(F.transform(turns, lambda m: F.coalesce(has_calls(m), F.lit(False))))
        if tool_calls
        else F.lit(-1)
    )
    marks = F.struct(first_output.alias("output"), first_calls.alias("calls"))

    def turn(m: Column, i: Column, first: Column) -> Column:
        after_tool = F.get(turns, i - 1)["role"] == "tool"
        calls = _tool_calls(m, i == first["calls"]) if tool_calls else F.lit("")
        reply = F.concat(
            F.when(after_tool, F.lit(TOOL_OUTPUTS_END)).otherwise(F.lit(ASSISTANT)),
            m["content"],
            F.lit(END_OF_SENTENCE),
        )
        output = F.concat(
            F.when(i == first["output"], F.lit(TOOL_OUTPUTS_BEGIN)).otherwise(F.lit("\n")),
            F.lit(TOOL_OUTPUT_BEGIN),
            F.coalesce(m["content"], F.lit("")),
            F.lit(TOOL_OUTPUT_END),
        )
        return (
            F.when(m["role"] == "user", F.concat(F.lit(USER), F.coalesce(m["content"], F.lit(""))))
            .when(m["role"] == "tool", output)
            .when(m["content"].isNull(), calls)
            .otherwise(reply)
        )

    blocks = let(marks, lambda first: F.transform(turns, lambda m, i: turn(m, i, first)))
    in_tool = F.coalesce(F.try_element_at(turns, F.lit(-1))["role"] == "tool", F.lit(False))
    ending = F.when(in_tool, F.lit(TOOL_OUTPUTS_END)).otherwise(
        F.lit(ASSISTANT if add_generation_prompt else "")
    )
    return F.concat(F.array_join(blocks, ""), ending)


def _tool_calls(m: Column, opens: Column) -> Column:
    def call(tool: Column, j: Column) -> Column:
        first = opens & (j == 0)
        return F.concat(
            F.when(first, F.lit(ASSISTANT + TOOL_CALLS_BEGIN)).otherwise(F.lit("\n")),
            F.lit(TOOL_CALL_BEGIN),
            tool["type"],
            F.lit(TOOL_SEPARATOR),
            tool["function"]["name"],
            F.lit("\n```json\n"),
            tool["function"]["arguments"],
            F.lit("\n```" + TOOL_CALL_END),
            F.when(first, F.lit("")).otherwise(F.lit(TOOL_CALLS_END + END_OF_SENTENCE)),
        )

    return F.coalesce(F.array_join(F.transform(m["tool_calls"], call), ""), F.lit(""))


def split_prefill(prompt: Column) -> tuple[Column, Column]:
    """A trailing assistant message is the start of the completion: (prompt without it, its text)."""
    last = F.try_element_at(prompt, F.lit(-1))
    prefilled = F.coalesce(last["role"] == "assistant", F.lit(False))
    shorter = F.slice(prompt, F.lit(1), F.greatest(F.size(prompt) - 1, F.lit(0)))
    return (
        F.when(prefilled, shorter).otherwise(prompt),
        F.when(prefilled, F.coalesce(last["content"], F.lit(""))).otherwise(F.lit("")),
    )


def assistant_completion(bootstrap: Column, completion: Column) -> Column:
    return F.array(message("assistant", F.concat(bootstrap, completion))).cast(MESSAGES)
