import random

import pytest
from pyspark.sql import functions as F

from rewardmill.functions import chat
from rewardmill.operators import curation as cu
from rewardmill.registry import BOXED_SYSTEM_PROMPT, DEFAULT_SYSTEM_PROMPT, training_dataset

MESSAGE = "struct<role:string,content:string>"
TOOL_MESSAGE = (
    "struct<role:string,content:string,"
    "tool_calls:array<struct<type:string,function:struct<name:string,arguments:string>>>>"
)


def test_answer_columns(spark):
    df = spark.createDataFrame([("q", "a", "p")], "question string, answer string, prompt string")
    got = cu.from_answer_columns(df)
    assert got.head().asDict() == {"problem": "q", "solution": "$a$", "prompt": "p"}
    df = spark.createDataFrame([("p", "s")], "prompt string, solution string")
    assert cu.from_answer_columns(df).head().asDict() == {"problem": "p", "solution": "s"}
    df = spark.createDataFrame([("q", None)], "question string, answer string")
    assert cu.from_answer_columns(df).head()["solution"] is None


def test_answer_over_derivation(spark):
    df = spark.createDataFrame([("q", "long", "7")], "problem string, solution string, answer string")
    got = cu.normalise_dataset(df, training_dataset("deepscaler")).head().asDict()
    assert got == {"problem": "q", "solution": "$7$", "solution_archive": "long"}


def test_messages_and_json(spark):
    df = spark.createDataFrame(
        [([("user", "q"), ("assistant", "x")], '{"answer":{"value":"7"}}'), ([("user", "r")], "broken")],
        f"messages array<{MESSAGE}>, verification_info string",
    )
    got = [r.asDict() for r in cu.normalise_dataset(df, training_dataset("2thought")).collect()]
    assert got == [{"problem": "q", "solution": "$7$"}, {"problem": "r", "solution": None}]


def test_prompts(spark):
    df = spark.createDataFrame([("q", "s", 1)], "problem string, solution string, id int")
    row = cu.prompt_and_solution(cu.build_prompts(df, training_dataset("open_rs3"))).head()
    assert [tuple(m) for m in row["prompt"]] == [("system", BOXED_SYSTEM_PROMPT), ("user", "q")]
    row = cu.build_prompts(df, training_dataset("limr")).head()
    assert row["prompt"][0]["content"] == DEFAULT_SYSTEM_PROMPT
    assert cu.signature_only(cu.build_prompts(df, training_dataset("limr")), True).columns == ["prompt"]


def test_length_budget(spark):
    df = spark.range(3000).select(F.col("id"), F.lit("q").alias("problem"))
    got = cu.build_prompts(df, training_dataset("l1_max"), 42, ["id"])
    low, high, n = got.agg(F.min("target_length"), F.max("target_length"), F.countDistinct("target_length")).head()
    assert 100 <= low < 120 and 3980 < high <= 4000 and n > 1500
    again = cu.build_prompts(df.repartition(7), training_dataset("l1_max"), 42, ["id"])
    assert got.select("id", "target_length").exceptAll(again.select("id", "target_length")).count() == 0
    fixed = cu.with_length_budget(df.limit(1), "S", 100, 100, 1, ["id"]).head()
    assert fixed["target_length"] == 100
    assert fixed["prompt"][0]["content"] == "S\nThink for 100 tokens."


def test_sft_pairs(spark):
    df = spark.createDataFrame([("q", "t", "a")], "question string, solution string, answer string")
    pair = cu.sft_conversations(df, "GAIR/LIMO").head()["messages"]
    assert pair[1]["content"] == "think: \nt\n answer: a"
    pair = cu.sft_conversations(df, "GAIR/LIMO", trace_free=True).head()["messages"]
    assert pair[1]["content"] == "think: \na\n answer: a"
    with pytest.raises(ValueError):
        cu.sft_conversations(df, "unknown/source")


def test_plain_template(spark):
    df = spark.createDataFrame(
        [([("user", "u"), ("critic", "c"), ("assistant", "a")],)], f"messages array<{MESSAGE}>"
    )
    text = cu.render(df, "plain", eos="</s>", add_generation_prompt=True).head()["text"]
    assert text == "<|user|>\nu</s>\n<|assistant|>\na</s>\n<|assistant|>\n"


def test_reasoning_template_hoists_last_system(spark):
    df = spark.createDataFrame(
        [([("system", "s1"), ("user", "u"), ("system", "s2"), ("assistant", "a")],)], f"messages array<{MESSAGE}>"
    )
    text = cu.render(df, bos="<B>").head()["text"]
    assert text == "<B>s2<｜User｜>u<｜Assistant｜>a<｜end▁of▁sentence｜>"


def walk(messages, bos, generation):
    """The template's rules as a plain walk over the messages."""
    system, out, in_tool, any_call, any_output = "", "", False, False, False
    for role, content, calls in messages:
        if role == "system":
            system = content
    for role, content, calls in messages:
        if role == "user":
            in_tool = False
            out += "<｜User｜>" + content
        elif role == "assistant" and content is None:
            in_tool = False
            for kind, (name, arguments) in calls or []:
                block = f"<｜tool▁call▁begin｜>{kind}<｜tool▁sep｜>{name}\n```json\n{arguments}\n```<｜tool▁call▁end｜>"
                if not any_call:
                    out += "<｜Assistant｜><｜tool▁calls▁begin｜>" + block
                    any_call = True
                else:
                    out += "\n" + block + "<｜tool▁calls▁end｜><｜end▁of▁sentence｜>"
        elif role == "assistant":
            out += ("<｜tool▁outputs▁end｜>" if in_tool else "<｜Assistant｜>") + content + "<｜end▁of▁sentence｜>"
            in_tool = False
        elif role == "tool":
            in_tool = True
            out += "\n" if any_output else "<｜tool▁outputs▁begin｜>"
            any_output = True
            out += f"<｜tool▁output▁begin｜>{content}<｜tool▁output▁end｜>"
    if in_tool:
        out += "<｜tool▁outputs▁end｜>"
    elif generation:
        out += "<｜Assistant｜>"
    return bos + system + out


@pytest.mark.parametrize("generation", [False, True])
def test_reasoning_template_with_tools(spark, generation):
    rng = random.Random(11)

    def message():
        role = rng.choice(["user", "assistant", "assistant", "tool", "tool", "system"])
        if role == "assistant" and rng.random() < 0.5:
            calls = [("function", (f"f{i}", f'{{"x": {i}}}')) for i in range(rng.randint(0, 3))]
            return (role, None, calls if calls or rng.random() < 0.5 else None)
        return (role, f"{role}{rng.randint(0, 99)}", None)

    rows = [([message() for _ in range(rng.randint(0, 8))],) for _ in range(200)]
    df = spark.createDataFrame(rows, f"messages array<{TOOL_MESSAGE}>")
    got = cu.render(df, bos="<B>", add_generation_prompt=generation).select("text").collect()
    assert [r["text"] for r in got] == [walk(m, "<B>", generation) for (m,) in rows]


def test_prefill(spark):
    df = spark.createDataFrame(
        [([("user", "u"), ("assistant", "So ")], "done"), ([("user", "u")], "done")],
        f"prompt array<{MESSAGE}>, completion string",
    )
    first, second = cu.merge_prefill(df).collect()
    assert [tuple(m) for m in first["prompt"]] == [("user", "u")]
    assert [tuple(m) for m in first["completion"]] == [("assistant", "So done")]
    assert [tuple(m) for m in second["completion"]] == [("assistant", "done")]
    plain = spark.createDataFrame([("p", "c")], "prompt string, completion string")
    assert cu.with_full_conversation(cu.merge_prefill(plain)).head()["full"] == "pc"
    assert not cu.is_conversational(plain)
    assert chat.MESSAGES == "array<struct<role:string,content:string>>"
