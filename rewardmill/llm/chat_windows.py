"""Chat formatting in budgeted windows.

A conversation becomes training texts of at most ``budget`` tokens. Prefix sums
of the turns' tokens place every turn on a line that is cut into equal cells;
turns that end in one cell make a window, so windows hold whole turns and every
turn is fresh in exactly one. Each window repeats the system turn and the last
turns before it, up to ``history`` tokens. Only fresh assistant turns are
under the loss mask: a repeated target is masked out.

Rendered turn: ``<turn>role<says>text</turn>`` and a line feed. Inside roles and
texts every backslash is doubled and each of the three marks gets one after its
``<``, so no text can close or open a turn, and reading takes the backslashes off again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rewardmill.llm.common import stored

# The template.
OPEN, SAYS, CLOSE = "<turn>", "<says>", "</turn>\n"
#: Tokens of a rendered turn besides those of its text.
OVERHEAD = 4
#: Turn numbers of one block of the prefix sums; a long conversation is summed block by block.
BLOCK = 256


def word_tokens(text: Column) -> Column:
    """Runs of letters and digits, and single other signs."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^ \t\n\x0B\f\r\p{L}\p{N}]"))


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), "<(/?turn|says)>", r"<\\$1>")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _placed(turns: DataFrame, budget: int, history: int, count_tokens: Callable[[Column], Column]) -> DataFrame:
    """Turns with their place on the token line, their cell, and the system turn of their conversation.

    Sums are taken within blocks of turn numbers and over the blocks' totals, so no task
    needs all turns of a conversation.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.select(
        key.alias("conv"), "conv_id", "turn", role.alias("role"), text.alias("text"),
        F.coalesce(F.expr(f"turn div {BLOCK}"), F.lit(-(2**62))).alias("block"), (count_tokens(text) + OVERHEAD).cast("long").alias("tokens"),
    )
    turn = F.struct("turn", "role", "text", "tokens")
    blocks = rows.groupBy("conv", "block").agg(F.sum("tokens").alias("sum"), F.count(F.lit(1)).alias("n"), F.min(turn).alias("least"))
    conversation = Window.partitionBy("conv")
    in_order = conversation.orderBy("block")
    first = F.first("least").over(in_order)
    blocks = blocks.select(
        "conv", "block",
        F.coalesce(F.sum("sum").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        (F.row_number().over(in_order) == 1).alias("first_block"),
        F.when((first["role"] == "system") & (F.sum("n").over(conversation) > 1), first).alias("system"),
    )
    within = Window.partitionBy("conv", "block").orderBy("turn", "role", "text")
    system_tokens = F.coalesce(F.col("system.tokens"), F.lit(0))
    fresh = F.greatest(F.lit(budget - history) - system_tokens, F.lit(1))
    placed = rows.join(blocks, ["conv", "block"]).select(
        "conv", "conv_id", "role", "text", "tokens", "system",
        (F.col("system").isNotNull() & F.col("first_block") & (F.row_number().over(within) == 1)).alias("is_system"),
        (F.col("before") + F.sum("tokens").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens") - system_tokens).alias("place"),
        fresh.alias("fresh"),
    )
    cell_size = F.expr("fresh - fresh div 4")
    end_cell = F.floor((F.col("place") + F.col("tokens") - 1) / F.col("cell_size")).cast("long")
    crosses = F.floor(F.col("place") / F.col("cell_size")).cast("long") != F.col("cell")
    return (
        placed.withColumn("cell_size", cell_size)
        .withColumn("cell", end_cell)
        .withColumn("alone", crosses & (F.col("tokens") > F.expr("fresh div 4")))
        .drop("cell_size", "fresh")
    )


def budgeted_windows(
    turns: DataFrame, budget: int = 2048, history: int = 256, count_tokens: Callable[[Column], Column] = word_tokens
) -> DataFrame:
    """Windows of ``turns`` (conv_id, turn, role, text): conv_id, window_start, text, loss_spans, turns, repeated, tokens, over_budget.

    ``window_start`` is the number of tokens of the turns before the window's first fresh turn, so it
    orders a conversation's windows. ``loss_spans`` are places (from, to) in code points of
    ``text``. The first ``repeated`` of its ``turns`` are the system turn (from the second window
    on) and history. A window exceeds the budget only if one turn does, with the
    system turn and history: ``over_budget``.

    Turns follow each other by (turn, role, text), nulls first; repeated rows are turns of
    their own. A null text or role is empty; a null conv_id is a conversation. The first turn is the
    system turn if its role is ``system`` and others follow.
    """
    if not 0 <= history < budget:
        raise ValueError("history must be less than the budget")
    rows = stored(_placed(turns, budget, history, count_tokens), "turns")
    spoken = rows.filter(~F.col("is_system"))
    windows = spoken.groupBy("conv", "cell", "alone").agg(F.min("place").alias("window_start"), F.first("conv_id").alias("conv_id"))
    fresh = spoken.join(windows.drop("conv_id"), ["conv", "cell", "alone"]).select(
        "conv", "window_start", "place", F.lit(False).alias("is_repeated"), "role", "text", "tokens"
    )
    parts = [fresh]
    if history:
        bucket = F.expr(f"place div {history}")
        near = spoken.withColumn("bucket", F.explode(F.array(bucket, bucket + 1)))
        starts = windows.select("conv", "window_start", F.expr(f"window_start div {history}").alias("bucket"))
        behind = (F.col("place") < F.col("window_start")) & (F.col("place") >= F.col("window_start") - history)
        before = near.join(starts, ["conv", "bucket"]).filter(behind)
        parts.append(before.select("conv", "window_start", "place", F.lit(True).alias("is_repeated"), "role", "text", "tokens"))
    systems = rows.filter("is_system").select("conv", "role", "text", "tokens")
    parts.append(
        windows.join(systems, "conv").select("conv", "window_start", F.lit(-1).cast("long").alias("place"), (F.col("window_start") > 0).alias("is_repeated"), "role", "text", "tokens")
    )
    said = parts[0]
    for part in parts[1:]:
        said = said.unionByName(part)

    head, body = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(SAYS)), escaped(F.col("text"))
    window = Window.partitionBy("conv", "window_start").orderBy("place")
    rendered = said.select("conv", "window_start", "place", "is_repeated", "role", "tokens", head.alias("head"), body.alias("body")).withColumn(
        "length", F.length("head") + F.length("body") + F.lit(len(CLOSE))
    )
    begin = F.coalesce(F.sum("length").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("head")
    target = (F.col("role") == "assistant") & ~F.col("is_repeated")
    span = F.struct(F.col("begin").alias("from"), (F.col("begin") + F.length("body")).alias("to"))
    texts = (
        rendered.withColumn("begin", begin)
        .groupBy("conv", "window_start")
        .agg(
            F.array_sort(F.collect_list(F.struct("place", F.concat("head", "body", F.lit(CLOSE)).alias("turn")))).alias("said"),
            F.array_sort(F.collect_list(F.when(target, span))).alias("loss_spans"),
            F.count(F.lit(1)).alias("turns"),
            F.count_if("is_repeated").alias("repeated"),
            F.sum("tokens").alias("tokens"),
        )
    )
    return texts.join(windows.select("conv", "window_start", "conv_id"), ["conv", "window_start"]).select(
        "conv_id", "window_start", F.array_join(F.transform("said", lambda x: x["turn"]), "").alias("text"), "loss_spans",
        "turns", "repeated", "tokens", (F.col("tokens") > budget).alias("over_budget"),
    )


def read_turns(text: Column) -> Column:
    """The turns of a window's text as an array of (role, text), with the escapes taken off."""
    pieces = F.split(text, CLOSE, -1)

    def turn(piece: Column) -> Column:
        role_and_text = F.split(F.substr(piece, F.lit(len(OPEN) + 1)), SAYS, 2)
        return F.struct(unescaped(role_and_text[0]).alias("role"), unescaped(role_and_text[1]).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def read_targets(text: Column, loss_spans: Column) -> Column:
    """The texts under the loss mask, in order, with the escapes taken off."""
    return F.transform(loss_spans, lambda s: unescaped(F.substr(text, (s["from"] + 1).cast("int"), (s["to"] - s["from"]).cast("int"))))
